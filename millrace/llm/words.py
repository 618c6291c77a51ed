"""Words and their hashes, as Spark expressions and as NumPy functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits are words.
NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits in order; null and wordless texts give an empty array."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD, " ")), " ")
    return F.array_remove(parts, "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
