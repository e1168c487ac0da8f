from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    """Each stage keeps the columns, and what it keeps equals its operator on what it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        rows = now.collect()
        seen[name] = rows
        if name != "pack":
            assert now.columns == docs.columns
            now = spark.createDataFrame(rows, docs.schema)
    texts = {}
    for r in seen["quality"]:
        texts.setdefault(r["text"], []).append(r["doc_id"])
    assert {r["doc_id"] for r in seen["exact_dedup"]} == {max(v) for v in texts.values()}
    assert {r["doc_id"] for r in seen["decontaminate"]} <= {r["doc_id"] for r in seen["near_dedup"]} <= {r["doc_id"] for r in seen["exact_dedup"]}
    assert {r["doc_id"] for r in seen["pack"]} == {r["doc_id"] for r in seen["decontaminate"]}
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, seen["pack"]))


def test_stages_of_odd_rows(spark):
    """Null ids and texts, repeated rows, ties and columns whose names clash: columns stay, and each stage's rule holds."""
    base = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(30)
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "", "en", "s", 0), (5, None, "en", "s", 0)], base.schema)
    docs = base.union(base).union(odd).withColumns({"rid": F.lit(1), "_rid": F.lit(2), "key": F.lit(3), "row": F.lit(4), "gone": F.lit(5), "score": F.lit(6)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= {tuple(r) for r in docs.collect()}
        if name == "exact_dedup":
            assert len(rows) == len({r["text"] or "" for r in docs.collect()})
        if name == "near_dedup":
            assert len({r[:2] for r in rows if r[1]}) == sum(1 for r in rows if r[1]) and sum(1 for r in rows if not r[1]) == 3
    assert corpus_pipeline.pack(spark, docs, SF).count() >= docs.count()


def test_empty_input(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
