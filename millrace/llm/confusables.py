"""Visually identical text with different characters.

A skeleton is made of a text by decomposing it, replacing every character by its prototype from a look-alike table and
decomposing again. Texts with equal skeletons look the same. Case, accents and visible punctuation stay as they are;
what can't be seen goes, and the width of letters, digits and spaces doesn't count.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.plans.session import written

# Letters of other scripts and the Latin letter each looks like.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l", "г": "r", "ь": "b", "Ь": "b", "ѡ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "ρ": "p", "σ": "o", "υ": "u", "ϱ": "p", "ϙ": "q", "Ϝ": "F",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G",
    "Ꮒ": "h", "Ꮓ": "Z", "Ꮞ": "4", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    # Armenian, Latin and letter-like
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l",
    # Dashes that look like the hyphen-minus, and marks written with another code point
    "‐": "-", "‑": "-", "‒": "-", "ʼ": "’", ";": ";", "·": "·",
}


@lru_cache(1)
def _table() -> dict[int, str | None]:
    """Code point to prototype, for ``str.translate``: the fixed look-alikes, and by rule what is invisible, spaces of
    any width, and compatibility forms of letters and digits that differ in width, font or joining only."""
    table: dict[int, str | None] = {}
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            table[c] = " "
        elif kind == "Cf" or 0xFE00 <= c <= 0xFE0F or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
            table[c] = None
        elif kind[0] in "LN" and (form := unicodedata.decomposition(ch)).startswith(("<wide>", "<narrow>", "<font>", "<compat>")):
            plain = unicodedata.normalize("NFKD", ch)
            if plain.isalnum() and (len(plain) == 1 or 0xFB00 <= c <= 0xFB06):
                table[c] = "".join(LOOK_ALIKES.get(x, x) for x in plain)
    for c in range(0xE0100, 0xE01F0):
        table[c] = None
    for ch, to in LOOK_ALIKES.items():
        table[ord(ch)] = to
    del table[ord("ſ")]  # long s is seen as such
    table[0xFB05] = "ſt"
    return table


def skeleton(text: str | None) -> str | None:
    """The skeleton of one text. Null stays null, the empty string stays empty; there is no length limit.

    >>> skeleton("ｃａｆé") == skeleton("cafe" + chr(0x301))
    True
    """
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_table()))


@F.arrow_udf(StringType())
def _skeletons(texts: pa.Array) -> pa.Array:
    return pa.array([skeleton(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def with_skeleton(df: DataFrame, text_col: str, skeleton_col: str = "skeleton") -> DataFrame:
    """``df`` with the skeleton of one column.

    Texts of ASCII characters only are their own skeletons and don't leave the JVM. All other columns stay, one named
    like ``skeleton_col`` is replaced. Null gives null.
    """
    text = F.col(f"`{text_col}`")
    return df.withColumn(skeleton_col, F.when(_ascii(text), text).otherwise(_skeletons(F.when(~_ascii(text), text))))


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows of one table with texts that look the same but aren't equal: (table_name, id_a, id_b), id_a < id_b.

    rows: table_name STRING, id BIGINT, text STRING. Null texts are in no pair, empty texts and texts of invisible
    characters only look the same. Rows with equal ids and texts count once. Only groups of at least two different
    texts are joined, on two independent 64-bit hashes of the skeleton, so copies of one text meet nobody; within a
    group the join is on the group and a salt of the left row's id, which spreads a hot group over many tasks.
    """
    # The hashes are written, so that texts are scanned and skeletons made once.
    keyed = written(
        with_skeleton(rows.select("table_name", "id", "text").filter("text is not null"), "text")
        .select("table_name", "id", F.xxhash64("skeleton").alias("k1"), F.xxhash64("skeleton", F.lit(7)).alias("k2"), F.xxhash64("text", F.lit(3)).alias("t"))
    )
    group = ["table_name", "k1", "k2"]
    mixed = keyed.groupBy(*group).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    # One salt for each 512 rows of a group: the right side is repeated so often, the left side is split.
    members = keyed.join(mixed.select(*group, F.ceil(F.col("n") / 512).cast("int").alias("salts")), group)
    left = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(11)), F.col("salts")).cast("int"))
    right = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    pairs = left.alias("a").join(right.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*group, "salt"]] + [F.col("a.id") < F.col("b.id"), F.col("a.t") != F.col("b.t")])
    return pairs.select(F.col("a.table_name").alias("table_name"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def canonical_form(rows: DataFrame) -> DataFrame:
    """(table_name, id, text, canonical, changed): each text in its one consistent form, the composed skeleton."""
    made = with_skeleton(rows.select("table_name", "id", "text"), "text", "_s")
    canonical = F.when(_ascii(F.col("_s")), F.col("_s")).otherwise(_composed(F.when(~_ascii(F.col("_s")), F.col("_s"))))
    return made.select("table_name", "id", "text", canonical.alias("canonical")).withColumn("changed", ~F.col("text").eqNullSafe(F.col("canonical")))
