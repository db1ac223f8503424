"""A filter of fixed size for tasks: which keys may be wanted, whatever their number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a filter, as power of two: 8 MB for any number of keys.
BITS = 26
_BUCKET = 1 << 15


def key_filter(df: DataFrame, key: Column) -> np.ndarray:
    """The bits of the keys (BIGINT, well mixed) of ``df``, put together in the tasks; what comes to the driver has the
    filter's size at most. The more keys, the more others pass, so what passes is still to be joined with the keys."""
    place = F.pmod(key, F.lit(1 << BITS)) + 1
    parts = df.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << BITS - 3, "u1")
    for r in parts.collect():
        at = (r.bucket - 1) * (_BUCKET >> 3)
        out[at : at + (_BUCKET >> 3)] = np.frombuffer(r.bits, "u1")
    return out


class Passing(dict):
    """Whether the filter of ``xxhash64`` of strings lets a string pass; what was asked is remembered, up to ``most``."""

    def __init__(self, filter_: np.ndarray, most: int = 1 << 20):
        self.bits, self.most = filter_, most

    def __missing__(self, word: str) -> bool:
        from xxhash import xxh64_intdigest

        p = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & (1 << BITS) - 1  # the seed of Spark's function
        if len(self) >= self.most:
            self.clear()
        self[word] = got = bool(self.bits[p >> 3] >> (p & 7) & 1)
        return got


def may_hold(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (unsigned 64 bits) the filter lets pass; all that were put in do."""
    p = keys & np.uint64((1 << BITS) - 1)
    return (filter_[(p >> np.uint64(3)).astype("i8")] >> (p & np.uint64(7)).astype("u1") & 1).astype(bool)
