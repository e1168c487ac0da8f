import pandas as pd
from pyspark.sql import functions as F

from chartloom.streaming import incremental


def source(spark, tmp_path, rows=60):
    df = spark.range(rows).select(F.col("id").alias("idx"), (F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") % 3).alias("k"), (F.col("id") * 1.5).alias("value"))
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_equal_the_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    want = incremental.window_stats(batch, "ts", "value", "10 minutes").orderBy("start").collect()
    got = run(incremental.window_stats(stream, "ts", "value", "10 minutes", late="1 day"), "complete", tmp_path, "tumbling").orderBy("start").collect()
    rows = lambda all_: [(r["start"], r["count"], r["min"], r["max"], round(r["mean"], 9), round(r["std_dev"], 9)) for r in all_]
    assert rows(got) == rows(want) and len(got) == 6
    assert incremental.session_stats(batch, "ts", "value", "5 minutes").count() == 1
    assert incremental.window_histogram(batch, "ts", "value", "1 hour", 0, 90, 3).agg(F.sum("count")).first()[0] == 60


def test_rolling_stream_equals_pandas(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = run(incremental.rolling_stream(stream, "k", "idx", "value", 4), "append", tmp_path, "rolling").toPandas().sort_values("idx")
    pdf = batch.toPandas().sort_values("idx")
    want = pdf.groupby("k")["value"].transform(lambda s: s.rolling(4, min_periods=1).mean())
    assert len(got) == 60
    pd.testing.assert_series_equal(got["mean"].reset_index(drop=True), want.reset_index(drop=True), check_names=False)


def test_redraw_keeps_a_bounded_buffer(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    seen = {}
    sink = incremental.redraw(str(tmp_path / "buf"), "x", "value", "idx", 40, 8, lambda df, n: seen.update({n: df.count()}))
    q = stream.withColumn("x", F.col("idx").cast("double")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c_redraw")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert list(seen.values()) == [8]
    assert spark.read.parquet(str(tmp_path / "buf/0")).count() == 40
