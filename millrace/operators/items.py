"""Knowledge items: flattening, checking against the source, merging repeats."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import first_words, normalize_text, split_words, word_count
from millrace.plans.session import cut_lineage, written

#: Lines of a transcript in one section.
SECTION_LINES = 4_096
#: From here on lines are numbered that have no number in their locator.
UNNUMBERED = 1 << 40


def flat_items(entries: DataFrame) -> DataFrame:
    """One row per knowledge item of the distinct entries, with its position in the entry."""
    one = entries.select("entry_id", "knowledge_items").distinct()
    return one.select("entry_id", F.posexplode("knowledge_items").alias("pos", "i")).select("entry_id", "pos", "i.*")


def transcript_lines(segments: DataFrame) -> DataFrame:
    """(entry_id, no, segment_id, text, ts, locator): of rows with one locator number the smallest segment_id.

    Rows without a number follow the others by segment_id, from ``UNNUMBERED`` on, and none repeats another.
    """
    no = F.coalesce(F.regexp_extract("locator", r"(\d+)\s*$", 1).try_cast("long"), F.col("segment_id").cast("long") + F.lit(UNNUMBERED))
    rows = segments.select("entry_id", no.alias("no"), F.struct("segment_id", "text", "ts", "locator").alias("row")).filter("entry_id is not null")
    return rows.groupBy("entry_id", "no").agg(F.min("row").alias("row")).select("entry_id", "no", "row.*")


def normalized_sections(lines: DataFrame, shared: int) -> DataFrame:
    """(entry_id, section, text): the normalised transcript in sections of ``SECTION_LINES`` lines with words, each with
    the first ``shared`` lines behind it too. Any stretch of ``shared`` words lies within a section.

    Lines are numbered without gaps: inside the sections of their numbers, and by how many lines stand before these.
    """
    worded = lines.select("entry_id", "no", normalize_text(F.coalesce("text", F.lit(""))).alias("t"), F.floor(F.col("no") / SECTION_LINES).alias("own")).filter("t <> ''")
    sizes = worded.groupBy("entry_id", "own").agg(F.count(F.lit(1)).alias("n"))
    earlier = sizes.select("entry_id", "own", (F.sum("n").over(Window.partitionBy("entry_id").orderBy("own")) - F.col("n")).alias("before"))
    placed = worded.withColumn("r", F.row_number().over(Window.partitionBy("entry_id", "own").orderBy("no")) - 1).join(earlier, ["entry_id", "own"]).withColumn("at", F.col("r") + F.col("before"))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - shared) / SECTION_LINES)).cast("long")
    spread = placed.select("entry_id", "at", "t", F.explode(F.sequence(first, F.floor(F.col("at") / SECTION_LINES).cast("long"))).alias("section"))
    # A section's own lines and those it shares; a line of a section far behind isn't its own.
    spread = spread.filter(F.col("at") < (F.col("section") + 1) * SECTION_LINES + shared)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"])
    return spread.groupBy("entry_id", "section").agg(F.array_join(ordered, " ").alias("text"))


def _pairs(text: Column) -> Column:
    """Hashes of the distinct pairs of neighbouring words."""
    words = F.split(text, " ")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))


def _containing(quotes: DataFrame, texts: DataFrame, place: str) -> DataFrame:
    """(entry_id, q, place): quotes and the texts of their entry that contain them.

    quotes: entry_id, q; texts: entry_id, place, text, both normalised. They meet on the entry and a pair of neighbouring
    words that must be whole in the text, so a long transcript isn't joined with all its quotes; quotes of under four
    words meet on the entry alone. Only the pairs that meet fetch the texts.
    """
    words = F.split("q", " ")
    once = quotes.filter("q <> ''").select("entry_id", "q").distinct()
    long = once.filter(F.size(words) >= 4).withColumn("pair", F.xxhash64(F.element_at(words, 2), F.element_at(words, 3)))
    met = long.join(texts.select("entry_id", place, F.explode(_pairs(F.col("text"))).alias("pair")), ["entry_id", "pair"]).select("entry_id", "q", place)
    short = once.filter(F.size(words) < 4).join(texts.select("entry_id", place), "entry_id").select("entry_id", "q", place)
    return met.unionAll(short).join(texts, ["entry_id", place]).filter(F.contains("text", "q")).select("entry_id", "q", place)


def faithful(items: DataFrame, segments: DataFrame) -> DataFrame:
    """(entry_id, item_id, quote, faithful): whether the quote stands in the entry's transcript, case and signs aside.

    A null or empty quote isn't faithful, nor is any quote of an entry without a transcript. A quote may run over any
    number of lines: the sections of a transcript share as many lines as the longest quote has words.
    """
    quotes = items.select("entry_id", "item_id", F.col("provenance.quote").alias("quote")).withColumn("q", normalize_text(F.coalesce("quote", F.lit(""))))
    longest = quotes.agg(F.max(F.size(F.split("q", " ")))).first()[0] or 0
    sections = normalized_sections(transcript_lines(segments), longest)
    hits = _containing(quotes, sections, "section").select("entry_id", "q").distinct().withColumn("hit", F.lit(True))
    return quotes.join(hits, ["entry_id", "q"], "left").select("entry_id", "item_id", "quote", F.coalesce("hit", F.lit(False)).alias("faithful"))


def backfilled(items: DataFrame, segments: DataFrame) -> DataFrame:
    """(entry_id, item_id, locator, ts, no): null locators and times filled from the first line that holds the quote; no
    is null where there is none or it has no number."""
    lines = transcript_lines(segments).withColumn("n_text", normalize_text(F.coalesce("text", F.lit(""))))
    quotes = items.select("entry_id", "item_id", F.col("provenance.locator").alias("own_locator"), F.col("provenance.timestamp").alias("own_ts"), normalize_text(F.coalesce("provenance.quote", F.lit(""))).alias("q"))
    hit = _containing(quotes, lines.select("entry_id", "no", F.col("n_text").alias("text")), "no").groupBy("entry_id", "q").agg(F.min("no").alias("no"))
    first = hit.join(lines.select("entry_id", "no", "locator", "ts"), ["entry_id", "no"])
    number = F.when(F.col("no") < UNNUMBERED, F.col("no"))
    return quotes.join(first, ["entry_id", "q"], "left").select("entry_id", "item_id", F.coalesce("own_locator", "locator").alias("locator"), F.coalesce("own_ts", "ts").alias("ts"), number.alias("no"))


def short_quotes(items: DataFrame, most: int = 14) -> DataFrame:
    """(entry_id, item_id, quote, n_words): quotes cut to their first words."""
    quote = first_words(F.col("provenance.quote"), most)
    return items.select("entry_id", "item_id", quote.alias("quote")).withColumn("n_words", word_count(F.col("quote")))


def transcript_sizes(segments: DataFrame, least: int = 50, thin: int = 500) -> DataFrame:
    """(entry_id, n_words, status): 'rejected' under the floor, 'thin' under the second bound, else 'ok'."""
    words = transcript_lines(segments).groupBy("entry_id").agg(F.sum(word_count(F.col("text"))).cast("long").alias("n_words"))
    return words.withColumn("status", F.when(F.col("n_words") < least, "rejected").when(F.col("n_words") < thin, "thin").otherwise("ok"))


def folded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one key as one row: (*keys, item_id, rationale, scope, gotchas, preconditions, mentions, n).

    rows: keys, pos, item_id, rationale, scope, gotchas, preconditions, entity_mentions. The first in order of pos stays;
    its empty scalars are filled from the next that has one, arrays are joined without repeats in order of appearance,
    mentions once for each name and kind. Values are made distinct before they are collected, so the size of a group
    doesn't matter, only that of its distinct values.
    """
    # Read four times, and what led to the rows may be long.
    rows = written(rows.select(*keys, "pos", "item_id", "rationale", "scope", "gotchas", "preconditions", "entity_mentions"))
    out = rows.groupBy(*keys).agg(
        F.min_by("item_id", "pos").alias("item_id"), F.min_by("rationale", F.when(F.col("rationale").isNotNull(), F.col("pos"))).alias("rationale"),
        F.min_by("scope", F.when(F.col("scope").isNotNull(), F.col("pos"))).alias("scope"), F.count(F.lit(1)).alias("n"),
    )
    mentions = F.transform("entity_mentions", lambda m: F.concat_ws(":", m["kind"], m["name"]))
    none = F.expr("cast(array() as array<string>)")
    for name, values in (("preconditions", F.col("preconditions")), ("gotchas", F.col("gotchas")), ("mentions", mentions)):
        once = rows.select(*keys, "pos", F.posexplode(values).alias("k", "v")).groupBy(*keys, "v").agg(F.min(F.struct("pos", "k")).alias("m"))
        gathered = once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda x: x["v"]).alias(name))
        out = out.join(gathered, keys, "left").withColumn(name, F.coalesce(name, none))
    return out.select(*keys, "item_id", "rationale", "scope", "gotchas", "preconditions", "mentions", "n")


def merged_repeats(items: DataFrame) -> DataFrame:
    """Items of one entry with one normalised statement as one row, folded: (entry_id, key, item_id, ..., n). Null
    statements are one key."""
    return folded(items.withColumn("key", F.coalesce(normalize_text(F.col("statement")), F.lit(""))), ["entry_id", "key"])


def merged_restatements(items: DataFrame, leaders: DataFrame) -> DataFrame:
    """Items folded into the one that leads them: (entry_id, leader, item_id, ..., n). leaders: entry_id, pos, leader."""
    return folded(items.join(leaders, ["entry_id", "pos"]), ["entry_id", "leader"])


def _letters(texts: list[str]) -> np.ndarray:
    """How often each character occurs in each text, characters counted in 64 bins."""
    out = np.zeros((len(texts), 64), np.int32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
    return out


def _common_bound(text: str) -> Callable[[str], int]:
    """The length of the longest common subsequence with a text, by bits: matching blocks add up to no more."""
    full = (1 << len(text)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(text):
        places[c] = places.get(c, 0) | 1 << i

    def common(other: str) -> int:
        v = full
        for c in other:
            u = v & places.get(c, 0)
            v = ((v + u) | (v - u)) & full
        return len(text) - v.bit_count()

    return common


def _similar_in_block(ratio: float):
    def match(group: str, early: list, late: list, out: list) -> None:
        """Pairs whose later member stands in ``late``. The matcher sees those alone that two bounds on its ratio let
        through: common characters, for all at once, and the longest common subsequence."""
        if not early or not late:
            return
        matcher = SequenceMatcher(None)
        places, keys = np.array([p for p, _ in late]), [k for _, k in late]
        sizes, letters = np.array([len(k) for k in keys]), _letters(keys)
        for (earlier, text), own in zip(early, _letters([t for _, t in early])):
            need = ratio * (sizes + len(text)) / 2 - 1e-9
            near = np.flatnonzero((places > earlier) & (np.minimum(sizes, len(text)) >= need) & (np.minimum(letters, own).sum(axis=1) >= need))
            if not len(near):
                continue
            matcher.set_seq2(text)
            common = _common_bound(text)
            for i in near:
                if keys[i] != text:
                    if common(keys[i]) < need[i]:
                        continue
                    matcher.set_seq1(keys[i])
                    if matcher.ratio() < ratio:
                        continue
                out.append((group, earlier, int(places[i])))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for (group, _, _), block in rows.groupby(["group_id", "lo", "hi"], dropna=False, sort=False):
            side = {s: block.loc[block["side"] == s, ["pos", "norm"]].values.tolist() for s in (0, 1, 2)}
            match(group, side[2], side[2], out)
            match(group, side[0], side[1], out)
            match(group, side[1], side[0], out)
        return pd.DataFrame(out, columns=["group_id", "earlier", "later"])

    return run


def fuzzy_leaders(items: DataFrame, ratio: float = 0.85, chunk: int = 512) -> DataFrame:
    """Greedy removal of restatements within a group: (group_id, pos, leader).

    items: group_id STRING, pos BIGINT, statement. In order of pos, an item joins the first kept one whose normalised
    statement is similar by the sequence-matching ratio, else it is kept and leads itself. A group is compared in
    blocks of chunks of about ``chunk`` rows, so no task holds a whole group; the greedy order is then resolved on the
    similar pairs alone, each round settling the items whose earlier neighbours are settled. Null statements are empty.
    """
    rows = cut_lineage(items.select("group_id", F.col("pos").cast("long").alias("pos"), normalize_text(F.coalesce("statement", F.lit(""))).alias("norm")))
    sizes = rows.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    placed = rows.join(sizes, "group_id").withColumn("c", F.pmod(F.xxhash64("pos"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    blocks = placed.withColumn("o", other).select("group_id", "pos", "norm", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1).alias("side"), "chunks")
    # Small groups share a task call, about 4 * chunk rows of them; a block of a large group has one of its own.
    calls = F.when(F.col("lo") == F.col("hi"), F.pmod(F.xxhash64("group_id"), F.lit(max(1, -(-rows.count() // (4 * chunk)))))).otherwise(F.lit(-1))
    alone = F.when((F.col("lo") < F.col("hi")) | (F.col("chunks") > 1), F.col("group_id"))
    called = blocks.withColumns({"call": calls, "alone": alone, "alone_lo": F.when(alone.isNotNull(), F.col("lo")), "alone_hi": F.when(alone.isNotNull(), F.col("hi"))}).drop("chunks")
    pairs = cut_lineage(called.groupBy("call", "alone", "alone_lo", "alone_hi").applyInPandas(_similar_in_block(ratio), "group_id string, earlier long, later long").distinct())
    state = cut_lineage(rows.select("group_id", "pos").join(pairs.select("group_id", F.col("later").alias("pos")).distinct().withColumn("open", F.lit(True)), ["group_id", "pos"], "left").select("group_id", "pos", F.when(F.col("open").isNull(), F.col("pos")).alias("leader")))
    while not state.filter("leader is null").isEmpty():  # every round settles the first open item of each group at least
        seen = pairs.join(state.select("group_id", F.col("pos").alias("earlier"), F.col("leader").alias("of")), ["group_id", "earlier"])
        # The first earlier neighbour that leads; and whether an unsettled one stands before it.
        now = seen.groupBy("group_id", F.col("later").alias("pos")).agg(
            F.min(F.when(F.col("of") == F.col("earlier"), F.col("earlier"))).alias("lead"), F.min(F.when(F.col("of").isNull(), F.col("earlier"))).alias("waits")
        )
        settled = F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.col("lead").isNotNull() & (F.col("waits").isNull() | (F.col("waits") > F.col("lead"))), F.col("lead")).when(F.col("lead").isNull() & F.col("waits").isNull(), F.col("pos"))
        state = cut_lineage(state.join(now, ["group_id", "pos"], "left").select("group_id", "pos", settled.alias("leader")))
    return state


def greedy_chunks(documents: DataFrame, id_col: str, sentence_list: Column, target: int = 12_000) -> DataFrame:
    """Sentences packed into chunks of about ``target`` characters, none split: (id, chunk, text).

    A sentence longer than the target is a chunk of its own; a text without sentences has no chunk.
    """
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        full = acc["open"].isNotNull() & (F.length(acc["open"]) + 1 + F.length(s) > target)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"),
        )

    folded = F.aggregate(sentence_list, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return documents.select(id_col, F.posexplode(folded).alias("chunk", "text"))


def chunk_contexts(chunks: DataFrame, id_col: str, overlap: int = 1_200) -> DataFrame:
    """Each chunk with the end of the one before, from after the first sentence end in it: (id, chunk, context)."""
    before = F.lag("text").over(Window.partitionBy(id_col).orderBy("chunk"))
    tail = F.right(F.col("before"), F.lit(overlap))
    at = F.locate(". ", F.col("tail"))
    snapped = F.when((at > 0) & (at < F.length("tail") - 1), F.substring("tail", at + 2, F.lit(overlap))).otherwise(F.col("tail"))
    return chunks.withColumn("before", before).withColumn("tail", tail).select(id_col, "chunk", snapped.alias("context"))
