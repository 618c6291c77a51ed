"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import bound, word_tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for null, empty, zero or unequally long vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(F.lit(0.0))


def bow_cells(text: Column, dim: int = 64) -> Column:
    """ARRAY<STRUCT<idx, sign>>: the bucket and sign of every word of a text by the MD5 of the word."""
    def cell(word: Column) -> Column:
        code = F.md5(word)
        idx = F.conv(F.right(code, F.lit(2)), 16, 10).cast("int") % dim
        odd = F.conv(F.substring(code, 30, 1), 16, 10).cast("int") % 2
        return F.struct(idx.alias("idx"), F.when(odd == 0, 1.0).otherwise(-1.0).alias("sign"))

    return F.transform(word_tokens(text), cell)


def bow_embedding(text: Column, dim: int = 64) -> Column:
    """Hashed signed bag of words of unit length; zeros for a text without words."""
    # Bound by a lambda, the cells are made once a row and not once for every position.
    raw = bound(
        bow_cells(text, dim),
        lambda cells: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.when(c["idx"] == i, c["sign"]).otherwise(0.0))),
    )
    return bound(raw, unit)


def unit(vector: Column) -> Column:
    return bound(F.struct(vector.alias("v"), F.sqrt(dot(vector, vector)).alias("n")), lambda x: F.when(x["n"] > 0, F.transform(x["v"], lambda y: y / x["n"])).otherwise(x["v"]))
