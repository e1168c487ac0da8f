"""Removal of word passages that occur more than once, by level-wise doubling.

A window of n words can repeat only if each of its parts does.  So windows are
first judged by parts of n / 4 words, those that survive by parts of n / 2, and
those that survive by all n words; each level counts only what the level
before found repeated, and the levels end where nothing survives.  Whole windows are equal
when 80 bits of hashes over their words are.

At the levels below n a window is judged by one part: the one with the least
hash of all its parts of that length.  Equal windows have equal least parts, so
no repeated window is lost, and neighbouring windows mostly share theirs, so
that a level counts about 2 (n - l + 2)^-1 parts a word, not one.

Documents with the same word sequence are one for the counting: all their
windows repeat.  Only documents that still have candidates are read again; a
bounded Bloom filter picks them before they are shuffled.  Of rows with the same
key in one run of texts, two go where the key is dealt to, to tell the others; the
rest are known to repeat and are dealt by document.  So a passage that a third of all
documents share does not meet in one task.  Rows stream through sorted
partitions, two at a time, and need no memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import words as W
from .scratch import Scratch, tidy

EMPTY = hashlib.sha256(b"").hexdigest()


def levels(window: int) -> list[int]:
    """Part lengths: a quarter, a half and the whole of the window, rounded up."""
    return sorted({max(1, -(-window // 4)), max(1, -(-window // 2)), window})


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Parts:
    """For one run of texts: which part each window is judged by at a level."""

    def __init__(self, w: W.Words, window: int):
        self.w, self.window = w, window
        self.count = max(0, len(w.hashes) - window + 1)
        self.whole, self.valid = w.windows(window)

    def least(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(part hashes by start word, least part hash by window)."""
        if length == self.window:
            return self.whole, self.whole
        parts, _ = self.w.windows(length)
        if not self.count:
            return parts, np.zeros(0, np.uint64)
        return parts, sliding(parts, self.window - length + 1, np.minimum)

    def chosen(self, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, start words) of the parts by which the windows of ``alive`` are judged; each part once."""
        parts, least = self.least(length)
        if length == self.window:
            at = np.flatnonzero(alive)
            return parts[at], at
        width = self.window - length + 1
        used = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        used[width - 1 : width - 1 + len(least)] = np.where(alive, least, np.uint64(0))
        at = np.flatnonzero(sliding(used, width, np.maximum) == parts) if self.count else np.zeros(0, np.int64)
        return parts[at], at


def _sequences(w: W.Words) -> np.ndarray:
    """A 64-bit identity of the word sequence of each text."""
    k = len(w.hashes)
    up, down = W.powers(W.WORD_BASE, k)
    with np.errstate(over="ignore"):
        total = np.zeros(k + 1, np.uint64)
        np.cumsum(w.hashes * up[:k], out=total[1:])
        a, b = w.first[:-1], w.first[1:]
        return W.mix((total[b] - total[a]) * down[np.minimum(a, len(down) - 1)] + (b - a).astype(np.uint64), 5)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list array of n rows; ``owner`` is sorted."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values))


def surplus(key: np.ndarray) -> np.ndarray:
    """Marks of all but two of the rows of each key."""
    order = np.argsort(key, kind="stable")
    same = key[order]
    out = np.zeros(len(key), bool)
    out[order[2:]] = same[2:] == same[:-2]
    return out


def _describe(window: int, length: int):
    names = ["doc_id", "rid", "n_words", "seq", "sha", "parts", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, w in W.rows(batch, "text"):
                p = Parts(w, window)
                seq = _sequences(w).view(np.int64)
                data = w.buf.tobytes()
                sha = [hashlib.sha256(b" ".join(data[x:y].translate(_ONE_SPACE).split())).hexdigest() for x, y in zip(*_spans(w))]
                fresh = np.zeros(b - a, bool)
                for i, x in enumerate(seq.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                key, at = p.chosen(length, p.valid)
                owner = np.searchsorted(w.first, at, "right") - 1
                use = fresh[owner]
                key, owner = key[use], owner[use]
                more = surplus(key)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("rid").slice(a, b - a), pa.array(np.diff(w.first)), pa.array(seq), pa.array(sha), _lists(key[~more], owner[~more], b - a), _lists(key[more], owner[more], b - a)], names=names)

    return run, "doc_id long, rid long, n_words long, seq long, sha string, parts array<long>, known array<long>"


_ONE_SPACE = bytes(32 if W.SPACE[b] else b for b in range(256))


def _spans(w: W.Words) -> tuple[list[int], list[int]]:
    """Byte range of each text from its first to its last word."""
    a, b = w.first[:-1], w.first[1:]
    some = b > a
    start, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    start[some], end[some] = w.starts[a[some]], w.ends[b[some] - 1]
    return start.tolist(), end.tolist()


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, check, ..., known) sorted by key and check, those that are known to repeat or do not have both alone."""
    held, before, names = None, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names[:-1]
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        known = columns.pop()
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[known]) for c in columns], names=names)
            columns = [c[~known] for c in columns]
            if not len(columns[0]):
                continue
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        key, check = columns[:2]
        same = np.zeros(len(key) + 1, bool)
        same[0] = before
        same[1:-1] = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        take = np.flatnonzero((same[:-1] | same[1:])[:-1])
        held, before = [c[-1:] for c in columns], bool(same[-2])
        yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in columns], names=names)
    if held is not None and before:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``repeated`` leaves, without the keys."""
    for batch in repeated(batches):
        yield batch.select(["num", "place"])


def _extend(window: int, before: int, length: int):
    """Numbered texts with the repeated keys of the level before: the parts of the next level.

    Windows of the whole length are told apart by 16 bits more.
    """
    names = ["key", "check", "num", "place", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in W.rows(batch, "text"):
                p = Parts(w, window)
                known = batch.column("keys").slice(a, b - a).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                _, least = p.least(before)
                key, at = p.chosen(length, p.valid & np.isin(least, known))
                owner = np.searchsorted(w.first, at, "right") - 1
                num = batch.column("num").slice(a, b - a).to_numpy()[owner]
                check = np.zeros(len(at), np.int16)
                if length == window:
                    # Another sum over the words' hashes.
                    other = W.Words.windows(_Mixed(w), window)[0][at]
                    check = (other >> np.uint64(48)).astype(np.uint16).view(np.int16)
                more = surplus(key ^ W.mix(check.view(np.uint16).astype(np.uint64), 7))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check), pa.array(num), pa.array((at - w.first[owner]).astype(np.int32)), pa.array(more)], names=names)

    return run, "key long, check smallint, num long, place int, known boolean"


class _Mixed:
    """Words under other hashes."""

    def __init__(self, w: W.Words):
        self.hashes, self.first = W.mix(w.hashes, 61), w.first


def _remove(window: int, with_text: bool):
    names = ["seq", "n_removed", "kept_sha"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in W.rows(batch, "text", hashed=False):
                places = batch.column("places").slice(a, b - a)
                gone = np.zeros(len(w.starts) + 1, np.int64)
                flat = places.flatten().to_numpy(zero_copy_only=False)
                count = np.diff(places.offsets.to_numpy())
                start = flat + np.repeat(w.first[:-1], count)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
                out = np.cumsum(gone)[:-1] > 0
                data, kept = w.buf.tobytes(), []
                for i in range(b - a):
                    at = np.flatnonzero(~out[w.first[i] : w.first[i + 1]]) + w.first[i]
                    kept.append(b" ".join([data[x:y] for x, y in zip(w.starts[at].tolist(), w.ends[at].tolist())]))
                total = np.concatenate([[0], np.cumsum(out)])
                columns = [batch.column("seq").slice(a, b - a), pa.array(total[w.first[1:]] - total[w.first[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([k.decode() for k in kept])] * with_text, names=names)

    return run, "seq long, n_removed long, kept_sha string" + ", kept string" * with_text


class SubstringDedup:
    """Removes each word that a window of ``window`` words covers which also starts elsewhere.

    Windows are judged on the input: every copy of a passage goes.  A null text
    has no words; a text of fewer words than a window keeps them all.  Ids may be
    null or repeat: each row is a text.  Other columns are ignored by
    ``report`` and kept by ``clean``, whatever their names; an empty table gives an empty result.
    """

    def __init__(self, window: int = 35, id_col: str = "doc_id", text_col: str = "text"):
        self.window, self.id_col, self.text_col = window, id_col, text_col

    def _run(self, docs: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame]:
        """Descriptions of all rows, and what is removed by word sequence where anything is."""
        spark = docs.sparkSession
        scratch = Scratch(spark)
        n, steps = self.window, levels(self.window)
        src = docs.select(F.col(self.id_col).cast("long").alias("doc_id"), self._rid().alias("rid"), F.col(self.text_col).alias("text"))
        run, shape = _describe(n, steps[0])
        full = scratch.keep(src.mapInArrow(tidy(run), shape), "full")
        rows = full.select("seq", F.explode("parts").alias("key"), F.lit(False).alias("known"))
        rows = rows.union(full.where("size(known) > 0").select("seq", F.explode("known").alias("key"), F.lit(True).alias("known")))
        rows = rows.select("key", F.lit(0).cast("smallint").alias("check"), "seq", "known")
        found = scratch.keep(self._repeated(rows, repeated, "key long, check smallint, seq long"), "level0")
        described = scratch.keep(full.drop("parts", "known"), "described")
        scratch.drop("full")
        keys = found.groupBy("seq").agg(F.collect_set("key").alias("keys"))

        # One row stands for each word sequence that has candidates; others that a filter of these lets by go with the copies.
        held = scratch.keep(described.join(found.select("seq").distinct(), "seq", "left_semi").groupBy("seq").agg(F.min("rid").alias("rid")), "held")
        words = bloom.words_for(held.count())
        some = bloom.flagged(src.drop("doc_id"), "rid", bloom.of(held.select("rid"), "rid", words), words, "maybe").where("maybe").select("text")
        run, shape = _named()
        # Small numbers stand for the sequences from here on: rows of windows are narrower.
        work = scratch.keep(some.mapInArrow(tidy(run), shape).dropDuplicates(["seq"]).withColumn("num", F.monotonically_increasing_id()), "work")

        for i, (before, length) in enumerate(zip(steps, steps[1:]), 1):
            run, shape = _extend(n, before, length)
            rows = work.join(keys, keys.columns[0]).select("num", "text", "keys").mapInArrow(tidy(run), shape)
            if length == n:
                found = self._repeated(rows, places, "num long, place int")
            else:
                found = self._repeated(rows.drop("place"), repeated, "key long, check smallint, num long")
            found = scratch.keep(found, f"level{i}")
            scratch.drop(f"level{i - 1}")
            if length == n or found.isEmpty():
                break
            keys = found.groupBy("num").agg(F.collect_set("key").alias("keys"))
        at = found.groupBy("num").agg(F.collect_list("place" if "place" in found.columns else F.lit(None).cast("int")).alias("places"))
        copies = described.groupBy("seq").agg(F.count("*").alias("copies")).where("copies > 1").withColumnRenamed("seq", "cseq")
        run, shape = _remove(n, with_text)
        removed = work.join(at, "num").select("seq", "text", "places").mapInArrow(tidy(run), shape)
        return described.join(copies, F.expr("seq = cseq"), "left").drop("cseq"), removed

    def _rid(self) -> Column:
        """A hash of a row's id and text."""
        return F.xxhash64(F.col(self.id_col).cast("long"), F.lit(0), F.col(self.text_col))

    def _repeated(self, rows: DataFrame, run, shape: str) -> DataFrame:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartition(2 * parts, F.when(F.col("known"), F.xxhash64(rows.columns[2], "key")).otherwise(F.col("key")))
        return dealt.sortWithinPartitions("key", "check").mapInArrow(tidy(run), shape)

    def report(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256), a row for each row of ``docs``."""
        described, removed = self._run(docs, False)
        out = described.join(removed, "seq", "left")
        all_ = F.col("copies").isNotNull() & (F.col("n_words") >= self.window)
        return out.select(
            "doc_id", "n_words",
            F.when(all_, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(all_, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        )

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the words that stay in each text, one space between; texts that lose no word are as they were."""
        described, removed = self._run(docs, True)
        all_ = F.col("copies").isNotNull() & (F.col("n_words") >= self.window)
        new = described.join(removed, "seq", "left").where(all_ | (F.col("n_removed") > 0)).select("rid", F.when(all_, F.lit("")).otherwise(F.col("kept")).alias("kept"))
        new = Scratch(docs.sparkSession).keep(new.dropDuplicates(["rid"]), "new")
        k = next(k for k in range(1, 99) if not any(c.lower().startswith("_" * k + "rid") for c in docs.columns))
        rid = "_" * k + "rid"
        out = docs.withColumn(rid, self._rid()).join(new.select(F.col("rid").alias(f"{rid}2"), F.col("kept").alias(f"{rid}3")), F.col(rid) == F.col(f"{rid}2"), "left")
        return out.select(*(F.coalesce(f"{rid}3", self.text_col).alias(c) if c == self.text_col else F.col(c) for c in docs.columns))


def _named():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts under the identities of their word sequences."""
        for batch in batches:
            for a, b, w in W.rows(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_sequences(w).view(np.int64)), batch.column("text").slice(a, b - a)], names=["seq", "text"])

    return run, "seq long, text string"
