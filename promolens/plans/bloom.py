"""A Bloom filter in SQL functions: drop rows of a large side before the shuffle of a join.

``might_match`` builds a bit table from the keys of the small side (``bit_or`` per 64-bit word, so
partial sums of at most ``bits / 64`` rows), carries it as a scalar subquery and tests each row of the
large side against it inside its scan stage. Rows that pass by chance are dropped by the join that
follows, so the result does not change. The table's size follows the counted keys; beyond
``MOST_BITS`` (16 MB, proven before anything is sent to a task) no filter is built and the join stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27
BITS_PER_KEY = 10
#: Hash seeds: three probes at ten bits a key leave under 2 % of foreign keys.
SEEDS = (11, 23, 47)
_WORD = 64


def bits_for(n_keys: int) -> int:
    """Power of two with at least ``BITS_PER_KEY`` bits for each key."""
    return max(1024, 1 << (max(1, n_keys) * BITS_PER_KEY - 1).bit_length())


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key.cast("long"), F.lit(s)).bitwiseAND(F.lit(bits - 1)) for s in SEEDS]


def bit_table(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row, one column ``words``: the filter of the keys as an array of longs."""
    at = keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("at"))
    one = F.lit(1).cast("long")
    set_ = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("at").bitwiseAND(F.lit(_WORD - 1)).cast("int"))).alias("bits"))
    # At most bits / 64 words: one bounded task puts them in order, absent words as zeros.
    every = keys.sparkSession.range(bits // _WORD).withColumnRenamed("id", "word").join(set_, "word", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
    return listed.select(F.transform("w", lambda x: x["bits"]).alias("words"))


def holds(table: DataFrame, key: Column, bits: int) -> Column:
    """Whether a key may be among those of the filter; never false for one that is."""
    words = table.scalar()
    tests = [F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(_WORD - 1)).cast("int"))) != 0
        for at in _positions(key, bits)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def might_match(large: DataFrame, large_key: str, small: DataFrame, small_key: str, n_keys: int,
                most_bits: int = MOST_BITS) -> DataFrame:
    """``large`` without most rows whose key is not in ``small`` (``n_keys`` keys, counted by the caller)."""
    bits = bits_for(n_keys)
    if bits > most_bits:
        return large
    return large.where(holds(bit_table(small, small_key, bits), F.col(large_key), bits))
