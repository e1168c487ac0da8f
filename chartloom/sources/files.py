"""Delimited files, with a path guard, and packed or JSON output."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite

MAX_BYTES = 100 * 1024 * 1024
# What a path may not hold, in any case.
DENIED = re.compile(
    r"/\.ssh/|/\.aws/|/\.env|/\.git/|/\.gnupg/|/\.config/gh/|\.pem$|\.key$|\.p12$|\.pfx$|/etc/passwd|/etc/shadow|credentials|secrets?\.|/\.kube/|/\.docker/|/\.npmrc|/\.netrc|id_rsa|id_ed25519", re.I
)


class PathError(ValueError):
    """A path that may not be read, with the reason."""


def guard(path: str, allowed: Sequence[str] = (), limit: int = MAX_BYTES) -> str:
    """The real path of a local file, or PathError: outside the allowed folders, denied, missing, no file, too large."""
    real = os.path.realpath(path)
    if DENIED.search(real) or DENIED.search(os.path.abspath(path)):
        raise PathError(f"access to {path} is denied")
    if allowed and not any(real == os.path.realpath(a) or real.startswith(os.path.realpath(a).rstrip("/") + "/") for a in allowed):
        raise PathError(f"{path} is outside the allowed folders {list(allowed)}")
    if not os.path.exists(real):
        raise PathError(f"{path} does not exist")
    if not os.path.isfile(real):
        raise PathError(f"{path} is not a file")
    if os.path.getsize(real) > limit:
        raise PathError(f"{path} has more than {limit} bytes")
    return real


def leading_number(c: Column) -> Column:
    """The number at the start of a text, as a lenient parser reads it; NULL without one."""
    return F.regexp_extract(F.trim(c), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")


def _raw(spark: SparkSession, path: str, sep: str) -> DataFrame:
    df = spark.read.option("header", True).option("sep", sep).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def load_delimited(spark: SparkSession, path: str, x: str | None = None, y: str | None = None, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """((x, y) rows that are finite in both, (rows, skipped_rows)).

    x is the first column and y the second, or the first if there is one, unless named.  Quotes
    have no meaning; numbers are read from the start of a field.
    """
    df = _raw(spark, path, sep)
    names = {"x": x or df.columns[0], "y": y or df.columns[min(1, len(df.columns) - 1)]}
    for c in names.values():
        if c not in df.columns:
            raise PathError(f"no column {c!r}; there are {', '.join(df.columns)}")
    both = df.select(*(leading_number(F.col(f"`{c}`")).alias(k) for k, c in names.items()))
    return both.where(finite("x", "y")), both.agg(F.count_if(finite("x", "y")).alias("rows"), F.count_if(~finite("x", "y")).alias("skipped_rows"))


def inspect_delimited(spark: SparkSession, path: str, sep: str = ",") -> dict:
    """columns, numeric_columns by the first five rows, row_count and those rows."""
    df = _raw(spark, path, sep)
    head = [r.asDict() for r in df.limit(5).collect()]
    probe = df.limit(5).select(*(F.bool_and(leading_number(F.col(f"`{c}`")).isNotNull()).alias(c) for c in df.columns)).first() if head else {}
    return {"columns": df.columns, "numeric_columns": [c for c in df.columns if head and probe[c]], "row_count": df.count(), "sample": head}


def to_json(df: DataFrame) -> DataFrame:
    """(json): one document for each row; NaN and infinities are null."""
    kinds = dict(df.dtypes)
    return df.select(F.to_json(F.struct(*(F.when(finite(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def pack(df: DataFrame, order: Sequence[str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., values...): each column of the rows of a key as one array, in order.  For results, which are small."""
    one = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *(v for v in values if v not in order)))).alias("__r"))
    return one.select(*by, *(F.col(f"__r.{v}").alias(v) for v in values))


def interleave(df: DataFrame, order: Sequence[str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., packed): x0, y0, x1, y1 and so on, as one array of doubles."""
    one = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), F.array(*(F.col(v).cast("double") for v in values)).alias("v")))).alias("__r"))
    return one.select(*by, F.flatten(F.col("__r.v")).alias("packed"))


def deinterleave(df: DataFrame, packed: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., names...): the arrays that ``interleave`` put into one; of an incomplete last group nothing is kept."""
    k = len(names)
    full = F.floor(F.size(packed) / k).cast("int")
    places = F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>"))

    def every(at: int) -> Column:
        return F.transform(places, lambda i: F.get(packed, i * k + at))

    cells = [every(at).alias(n) for at, n in enumerate(names)]
    return df.select(*by, *cells)
