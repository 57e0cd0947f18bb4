"""The queries of the training-data operators: each applies its operator to the whole documents table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import fingerprint, importance, language, lm, media, mixing, near_dedup, packing, periodic, pii, quality, simhash, toxicity
from factweave.llm.common import documents, fold


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.shares(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    counts = [pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir), fold("id", 5) != 0)
    found = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, labels(spark, sf_dir), fold("id", 3) != 1)
    found = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs, fold("id", 4) != 2)
    found = language.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = lm.Model(documents(spark, sf_dir), fold("doc_id", 7) != 2, order=lm.ORDER)
    found = model.score().withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, folder = media.media_table(documents(spark, sf_dir))
    found = media.with_samples(catalog, folder).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.col("stored_sha256").alias("media_sha256"), "feature", "width", "height")


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def with_tail(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words of a document; where crc32(doc_id) % 10 = 0 they go on periodically from one of them on, as the contract of op13 has it."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(documents(spark, sf_dir), edit=with_tail).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    digests = [F.sha2(x.cast("binary"), 256).alias(n) for n, x in (("runs_sha256", listed), ("collapsed_sha256", F.col("collapsed")))]
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *best, exponent, *digests)


_ALL = (
    op1_best_fit_packing, op2_fingerprints, op3_toxicity, op4_minhash_near_dedup, op5_quality,
    op6_lm_scoring, op7_media_columns, op8_mixing, op9_language_id, op10_pii,
    op11_simhash_near_dedup, op12_importance_resampling, op13_period_runs,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {"op8_mixing": mixing.ORACLE_SQL, "op12_importance_resampling": importance.ORACLE_SQL}
