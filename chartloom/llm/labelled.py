"""A bounded sample of labelled texts for the classifiers, and training in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import tidy


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, each: int, fit: Callable[[list[str], list[int], float], Any]) -> Any:
    """What ``fit`` makes of at most ``each`` whole texts of either label, their labels, and the share of label 1.

    The texts with the least hashes of their ids are taken, the same in any order of rows and
    on any number of machines; the share is that of all allowed rows.  Labels other than 0 and 1, null
    ids and rows not ``allowed`` are left out; of an id with several labels the largest counts.
    One task does the fitting; the driver gets the model only.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    marks = marks.where(F.coalesce(allowed, F.lit(False)))
    counts = dict(marks.groupBy("label").count().collect())
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    ids = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in (0, 1)]
    rows = docs.join(F.broadcast(ids[0].union(ids[1])), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], str] = {}
        for batch in batches:
            for i, t, k in zip(*(c.to_pylist() for c in batch.columns)):
                seen[i, k] = max(t, seen.get((i, k), t))
        keys = sorted(seen)
        model = fit([seen[k] for k in keys], [k[1] for k in keys], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.repartition(1).mapInArrow(tidy(run), "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], [], share)
