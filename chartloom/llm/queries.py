"""The ``opN_`` queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import BenchmarkDecontamination
from .exact_dedup import ExactDedup
from .jaccard_join import NgramJaccardJoin
from .packing import SequencePacker
from .pii import PiiFinder
from .quality import QualityClassifier
from .secret_scan import SecretScanner
from .substring_dedup import SubstringDedup
from .toxicity import ToxicityClassifier
from .warc_zstd import WarcArchive


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJaccardJoin(shingle=3, percent=90).components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    tool = ToxicityClassifier(folds=5, held=0)
    return tool.score(docs, tool.train(docs, labels))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return BenchmarkDecontamination().matches(docs, benchmark)


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = WarcArchive(spark)
    manifest = archive.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archive.read(manifest, with_payload=False).drop("url")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactDedup().groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SubstringDedup(window=35).report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return QualityClassifier(folds=3, held=1).score(docs, labels)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PiiFinder().find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return SequencePacker(tokenizer or tokenizer_path()).pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SecretScanner().scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_warc_zstd": op4_warc_zstd,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d)
        SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(m) AS component_id
        FROM documents JOIN r ON r.d = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to FROM q""",
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM w, range(1, len(w) - 33) r(i)),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
        x AS (SELECT DISTINCT doc_id, i + j AS p FROM d, range(35) r(j)),
        l AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(list_filter(w, lambda v, k: gone IS NULL OR NOT list_contains(gone, k)), ' ')) AS kept_sha256
        FROM w LEFT JOIN l USING (doc_id)""",
}
