"""The registered queries of this subpackage and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundlake.llm import attention, content_sort, forest, licenses, mixing, negatives, occurrences, quality, ranking, sampling, secrets, simhash, toxicity
from moundlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query("op3_mixing", mixing.sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce("row.source", F.lit("")).alias("source"), "epoch", "block", "tokens", "start", "quota"
    )


@query("op4_hash_forest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return forest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    counts = [F.size(secrets.of_kinds([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed(secrets.of_kinds(base)), 256).alias("base_sha256"), secrets.listed("spans").alias("spans")
    )


@query("op6_sampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations a document."""
    encoded = sampling.encode(table(spark, sf_dir, "documents"), k=2)
    rows = encoded.select("doc_id", F.posexplode("samples").alias("sample", "s")).select("doc_id", "sample", "s.*")
    return rows.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "log_prob", "log_inclusion", "exact", "ids")


@query("op7_licenses", licenses.sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), carry_text=False)
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


@query("op9_attention_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort.exact_dedup(docs, keep="largest").select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("content_sha256").alias("text_sha256")
    )


@query("op11_jaccard_join", occurrences.sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.groups(table(spark, sf_dir, "documents"))


@query("op12_term_pipeline", ranking.sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_angular_negatives", negatives.sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
