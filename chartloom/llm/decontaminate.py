"""Benchmark decontamination by template canonicalisation, in DataFrame operations.

A text becomes words (runs of letters or digits) in which numbers, capitalised
names and units are typed placeholders, the rest lower case.  Windows of five
such template words of the benchmark are hashed and joined with windows of the
documents.  Windows start at every word on both sides, so that every
shared run of five words or more is met.  Where a document and an
item meet, the two are laid over each other at that offset and compared word by
word: a word counts where templates, or words but for case, agree in a run of five words or more and,
at a placeholder, where the item's value goes to one value of the document throughout
(slot consistency).  A document is contaminated by an item when such words
make up ``percent`` of the item, or ``passage`` of them lie in a row at one
offset, as large a share of which are equal words as a template window has literals.

Templates alone would lose text in other case and runs of names or numbers, so
windows of the words as they are, but for case, are joined beside them.

Both sides of the window join are counted first: the benchmark's windows are
broadcast only up to ``broadcast_windows`` rows, and else shuffled.  Texts of
documents that met an item are read again and only they are shuffled; a bounded
Bloom filter picks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .scratch import Scratch

UNITS = "mm|cm|m|km|g|kg|mg|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|mph|kmh|meters|metres|miles|feet|inches|euros|dollars|cents|percent|degrees"
"""Words that are units after a number."""
NUMBER, NAME, UNIT = "#", "@", "%"


def plain(text: Column) -> Column:
    """Words of a text with one space between: runs of letters and digits; digit groups are one number."""
    out = F.coalesce(text, F.lit(""))
    digits = out.rlike("[0-9]")
    grouped = F.regexp_replace(F.regexp_replace(out, "(?<=[0-9])[.,](?=[0-9])", ""), r"(?<=[0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])", " ")
    return F.trim(F.regexp_replace(F.when(digits, grouped).otherwise(out), r"[^\p{L}\p{N}]+", " "))


def template(words: Column) -> Column:
    """The placeholders of a plain text, word for word."""
    out = F.regexp_replace(words, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}[\p{L}]*", NAME)
    out = F.lower(out)
    numbers = F.regexp_replace(F.regexp_replace(out, r"(?<![\p{L}\p{N}])[0-9]+(?![\p{L}\p{N}])", NUMBER), rf"(?<={NUMBER} )(?:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.when(out.rlike("[0-9]"), numbers).otherwise(out)


class BenchmarkDecontamination:
    """Pairs of documents and the benchmark items they hold, numbers, names and units changed or not.

    A null or blank text holds nothing and is held by nothing; so is an item of
    fewer than ``window`` words.  A template window counts with ``literals`` words that are no
    placeholders at least; windows of the words as they are all count.  Ids may repeat: rows with one id are judged apart and reported
    as one.  ``clean`` judges each row by its own text, whatever its id.  Other columns are kept by
    ``clean``, whatever their names.  Empty tables give an empty result.
    """

    def __init__(self, window: int = 5, literals: int = 2, percent: int = 80, passage: int = 13, broadcast_windows: int = 1_000_000):
        self.window, self.literals, self.percent, self.passage, self.most = window, literals, percent, passage, broadcast_windows

    def _windows(self, hashes: Column, kind: int) -> Column:
        """Hashes of the windows of an array of word hashes; template words (kind 0) and words as they are but for case (1) never meet."""
        last = F.size(hashes) - self.window
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(kind), *(F.get(hashes, i + k) for k in range(self.window))))

    def _found(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """(row, doc_id, item, item_id, size, covered, slots, changed, quoted): contaminated pairs of rows and items."""
        spark = docs.sparkSession
        scratch = Scratch(spark)
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain(F.col("text")).alias("raw"))
        items = items.select("item_id", F.split("raw", " ").alias("raw"), F.split(template(F.col("raw")), " ").alias("tpl")).where(F.size("tpl") >= self.window)
        items = scratch.keep(items.select(F.xxhash64("item_id", "raw").alias("item"), "item_id", "raw", "tpl").dropDuplicates(["item"]), "items")
        hashed = items.select("item", "tpl", F.transform("tpl", lambda w: F.xxhash64(w)).alias("h0"), F.transform("raw", lambda w: F.xxhash64(F.lower(w))).alias("h1"))
        spots = hashed.select("item", "tpl", F.posexplode(self._windows(F.col("h0"), 0)).alias("at", "hash"))
        marks = F.aggregate(F.slice("tpl", F.col("at") + 1, self.window), F.lit(0), lambda n, w: n + F.when(w.isin(NUMBER, NAME, UNIT), 0).otherwise(1))
        spots = spots.where(marks >= self.literals).select("item", "at", "hash", F.lit(0).alias("kind"))
        spots = scratch.keep(spots.unionByName(hashed.select("item", F.posexplode(self._windows(F.col("h1"), 1)).alias("at", "hash"), F.lit(1).alias("kind"))), "spots")
        near = spots.count() <= self.most

        src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).where("text is not null")
        src = src.withColumn("row", _row("doc_id", "text"))
        tpl = src.select("row", plain(F.col("text")).alias("raw"))
        tpl = tpl.select("row", F.split(template(F.col("raw")), " ").alias("tpl"), F.split(F.lower("raw"), " ").alias("raw"))
        # Each word is hashed once, a window from five hashes.
        tpl = tpl.select("row", F.transform("tpl", lambda w: F.xxhash64(w)).alias("h0"), F.transform("raw", lambda w: F.xxhash64(w)).alias("h1"))
        tpl = tpl.select("row", self._windows(F.col("h0"), 0).alias("w0"), self._windows(F.col("h1"), 1).alias("w1"))
        # Both kinds in one list: template windows, then as many of words as they are.
        there = tpl.select("row", F.size("w0").alias("m"), F.posexplode(F.concat("w0", "w1")).alias("n", "hash"))
        side = F.broadcast(spots) if near else spots
        place = F.col("n") - F.when(F.col("kind") == 1, F.col("m")).otherwise(0)
        met = there.join(side, "hash").select("row", "item", (place - F.col("at")).cast("int").alias("shift"), "kind")
        met = scratch.keep(met.groupBy("row", "item", "shift").agg(F.min("kind").alias("kind")), "met")

        rows = met.select("row").distinct()
        words = bloom.words_for(rows.count())
        some = bloom.flagged(src, "row", bloom.of(rows, "row", words), words, "maybe").where("maybe").drop("maybe")
        held = some.join(rows, "row").dropDuplicates(["row"]).select("row", "doc_id", F.split(plain(F.col("text")), " ").alias("raw"))
        held = held.withColumn("tpl", F.split(template(F.array_join("raw", " ")), " "))
        over = met.join(held, "row")
        # The document's words under the item, and no others, go on.
        size = F.size("itpl")
        named = items.select("item", "item_id", F.col("raw").alias("iraw"), F.col("tpl").alias("itpl"))
        over = over.join(F.broadcast(named) if near else named, "item")
        low = F.greatest(F.lit(0), -F.col("shift"))
        high = F.least(size, F.size("tpl") - F.col("shift"))
        cut = over.select(
            "row", "doc_id", "item", "item_id", "shift", "kind", size.alias("size"), low.alias("low"),
            F.slice("iraw", low + 1, high - low).alias("iraw"), F.slice("itpl", low + 1, high - low).alias("itpl"),
            F.slice("raw", low + F.col("shift") + 1, high - low).alias("draw"), F.slice("tpl", low + F.col("shift") + 1, high - low).alias("dtpl"),
        )
        pairs = cut.select("row", "doc_id", "item", "item_id", "shift", "kind", "size", "low", F.posexplode(F.arrays_zip("iraw", "itpl", "draw", "dtpl")).alias("k", "w"))
        pairs = pairs.select("row", "doc_id", "item", "item_id", "shift", "kind", "size", (F.col("low") + F.col("k")).alias("at"), "w.*").where("itpl = dtpl OR lower(iraw) = lower(draw)")
        # Runs of agreeing words: places less their rank in the run are constant.
        order = "PARTITION BY row, item, shift ORDER BY at"
        pairs = pairs.withColumn("run", F.expr(f"at - row_number() OVER ({order})"))
        pairs = pairs.withColumn("long", F.expr("count(*) OVER (PARTITION BY row, item, shift, run)")).where(F.col("long") >= self.window)
        # Where no template window met, a run has as large a share of equal words as a template window has of literals.
        pairs = pairs.withColumn("same", F.expr("sum(int(lower(iraw) = lower(draw))) OVER (PARTITION BY row, item, shift, run)"))
        pairs = pairs.where((F.col("kind") == 0) | (F.col("same") * self.window >= self.literals * F.col("long")))
        # A slot's value must go to one value: the one it goes to most often, the least of equals.
        slot = F.col("itpl").isin(NUMBER, NAME, UNIT)
        value = F.when(slot, F.lower("iraw"))
        goes = pairs.withColumn("from", F.coalesce(value, F.lit(""))).withColumn("to", F.when(slot, F.lower("draw")).otherwise(F.lit("")))
        goes = goes.withColumn("votes", F.expr("count(*) OVER (PARTITION BY row, item, shift, itpl, from, to)"))
        goes = goes.withColumn("best", F.expr("max(struct(votes, to)) OVER (PARTITION BY row, item, shift, itpl, from)"))
        fine = goes.where(~slot | (F.col("best.to") == F.col("to")))
        # What is left of a run where slots are inconsistent, in parts of their own.
        fine = fine.withColumn("part", F.expr(f"at - row_number() OVER ({order})"))
        part = "OVER (PARTITION BY row, item, shift, part)"
        fine = fine.withColumn("quoted", F.expr(f"count(*) {part}")).withColumn("equal", F.expr(f"sum(int(lower(iraw) = lower(draw))) {part}"))
        quoted = (F.col("quoted") >= self.passage) & (F.col("equal") * self.window >= self.literals * F.col("quoted"))
        place = fine.groupBy("row", "doc_id", "item", "item_id", "size", "at").agg(
            F.max(slot.cast("int")).alias("slot"), F.min(F.when(slot, (F.col("from") != F.col("to")).cast("int")).otherwise(0)).alias("changed"), F.max(quoted).alias("quoted")
        )
        whole = place.groupBy("row", "doc_id", "item", "item_id", "size").agg(F.count("*").alias("covered"), F.sum("slot").alias("slots"), F.sum("changed").alias("changed"), F.max("quoted").alias("quoted"))
        good = whole.where((100 * F.col("covered") >= self.percent * F.col("size")) | F.col("quoted"))
        return good

    def matches(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """(doc_id, item_id, covered, item_words, slots, changed), a row for each contaminated pair.

        ``covered`` of the item's words were found at the best place; ``changed``
        of its ``slots`` placeholders there have another value in the document.
        """
        good = self._found(docs, benchmark)
        best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", (-F.col("changed")).alias("same"), F.col("size").alias("item_words"), "slots")).alias("m"))
        return best.select("doc_id", "item_id", F.col("m.covered").cast("long").alias("covered"), F.col("m.item_words").cast("long").alias("item_words"), F.col("m.slots").cast("long").alias("slots"), (-F.col("m.same")).cast("long").alias("changed"))

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """``docs`` without the documents that hold an item; all columns stay."""
        scratch = Scratch(docs.sparkSession)
        gone = scratch.keep(self._found(docs, benchmark).select("row").distinct(), "gone")
        n = next(n for n in range(1, 99) if not any(c.lower().startswith("_" * n + "row") for c in docs.columns))
        row = "_" * n + "row"
        return bloom.without(docs.withColumn(row, _row("doc_id", "text")), row, gone).drop(row)


def _row(doc_id: str, text: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.lit(0), F.col(text))
