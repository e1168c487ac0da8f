"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations.

The first pass counts filter bits over the 64-bit hashes of all texts and keeps
the bits that were set twice.  The second pass probes each row: a row whose
bits were all set twice may be a copy and is shuffled by the SHA-256 of its
text; any other row is alone and passes straight through, in the partition
where it was read.  The filter is bounded (see ``bloom``), the shuffled part
is aggregated before it is dealt out, and Spark splits a large group of copies
when it joins the aggregate back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .scratch import Scratch


class ExactDedup:
    """Groups of rows with the same text; of each group the row with the largest id stays.

    A null text counts as empty.  ``normalise`` maps the text column before
    texts are compared; by default texts are equal when identical.  Ids may be
    null or repeat: a null id is below any other, and of rows with the same id
    and text ``deduplicate`` keeps one.  Columns beside id and text are kept by
    ``deduplicate``, whatever their names, and ignored by ``groups``.  An empty
    table gives an empty result.
    """

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", normalise=lambda c: c):
        self.id_col, self.text_col, self.normalise = id_col, text_col, normalise

    def _text(self) -> Column:
        return self.normalise(F.coalesce(F.col(self.text_col), F.lit("")))

    def _suspects(self, df: DataFrame, key: str, flag: str) -> DataFrame:
        """``df`` with the boolean ``flag``: another row may have the same key."""
        words = bloom.words_for(df.count())
        return bloom.flagged(df, key, bloom.of(df.select(key), key, words, least=2), words, flag)

    def groups(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``."""
        rows = docs.select(F.col(self.id_col).alias("doc_id"), self._text().alias("text"))
        rows = rows.withColumn("key", F.xxhash64("text"))
        seen = self._suspects(rows, "key", "maybe")
        digest = F.sha2(F.encode("text", "UTF-8"), 256)
        seen = seen.select("doc_id", digest.alias("text_sha256"), "maybe")
        alone = seen.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        some = seen.where("maybe")
        sizes = some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        # Written, so that the join reads two plain shuffles, whose large partitions Spark splits.
        sizes = Scratch(docs.sparkSession).keep(sizes, "sizes")
        same = some.join(sizes, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
        return alone.union(same)

    def deduplicate(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the rows whose text a row with a larger id has."""
        taken = {c.lower() for c in docs.columns}
        key, flag, digest, keep = ("_" * n + name for name in ("key", "maybe", "digest", "keep") for n in [next(n for n in range(1, 99) if all(("_" * n + x) not in taken for x in ("key", "maybe", "digest", "keep", "maybe_w", "maybe_b")))])
        seen = self._suspects(docs.withColumn(key, F.xxhash64(self._text())), key, flag)
        alone = seen.where(~F.col(flag)).select(*docs.columns)
        some = seen.where(flag).withColumn(digest, F.sha2(F.encode(self._text(), "UTF-8"), 256))
        best = Scratch(docs.sparkSession).keep(some.groupBy(digest).agg(F.max(self.id_col).alias(keep)), "best")
        stay = some.join(best.withColumnRenamed(digest, digest + "2"), (F.col(digest) == F.col(digest + "2")) & F.col(self.id_col).eqNullSafe(F.col(keep)))
        return alone.unionByName(stay.dropDuplicates([digest]).select(*docs.columns))
