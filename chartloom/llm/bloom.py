"""A blocked Bloom filter made and probed with DataFrame operations only.

The filter is a table (word, bits): a key sets two of the 64 bits of one word.
It never has more than ``words`` rows, however many keys there are, so that it
can be broadcast: at most 2**21 rows of two longs.  Past its capacity it
answers *maybe* more often and stays right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 1 << 21
"""Rows of the largest filter, hence the bound of what is broadcast."""


def words_for(keys: int) -> int:
    """A word for four keys (16 bits a key), as a power of two within the bound."""
    return min(MAX_WORDS, 1 << max(10, (keys // 4).bit_length()))


def _parts(key: Column, words: int) -> tuple[Column, Column, Column]:
    return key.bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(63)), F.shiftrightunsigned(key, 44).bitwiseAND(F.lit(63))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def of(keys: DataFrame, key: str, words: int, least: int = 1) -> DataFrame:
    """The filter over 64-bit hashes; with ``least`` = 2, of bits that two rows or more have set."""
    word, b0, b1 = _parts(F.col(key), words)
    bits = keys.select(word.alias("word"), F.explode(F.array_distinct(F.array(b0, b1))).alias("bit"))
    if least > 1:
        bits = bits.groupBy("word", "bit").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return bits.groupBy("word").agg(F.bit_or(_bit(F.col("bit"))).alias("bits"))


def flagged(df: DataFrame, key: str, bloom: DataFrame, words: int, flag: str) -> DataFrame:
    """``df`` with a boolean: the key may be in the filter.  ``df`` itself is not shuffled."""
    word, b0, b1 = _parts(F.col(key), words)
    mask = _bit(b0).bitwiseOR(_bit(b1))
    side = F.broadcast(bloom.select(F.col("word").alias(f"{flag}_w"), F.col("bits").alias(f"{flag}_b")))
    out = df.join(side, word == F.col(f"{flag}_w"), "left")
    hit = F.coalesce(F.col(f"{flag}_b").bitwiseAND(mask) == mask, F.lit(False))
    return out.withColumn(flag, hit).drop(f"{flag}_w", f"{flag}_b")


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``df`` less the rows whose id is in ``ids`` (one column, no null); only rows that may be are shuffled."""
    name = ids.columns[0]
    n = 1
    while any(f"{'_' * n}gone{x}" in (c.lower() for c in df.columns) for x in ("", "_w", "_b", "_k")):
        n += 1
    flag = "_" * n + "gone"
    words = words_for(ids.count())
    made = of(ids.select(F.xxhash64(F.col(name).cast("long")).alias(flag)), flag, words)
    key = f"{flag}_k"
    seen = flagged(df.withColumn(key, F.xxhash64(F.col(id_col).cast("long"))), key, made, words, flag)
    straight = seen.where(~F.col(flag) | F.col(id_col).isNull()).select(*df.columns)
    some = seen.where(F.col(flag) & F.col(id_col).isNotNull()).select(*df.columns)
    gone = ids.select(F.col(name).alias(key)).distinct()
    return straight.unionByName(some.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti"))
