"""Small fixed tables: the metric taxonomy and its aliases. Their sizes are those of the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.functions import vocabulary as V


def metrics(spark: SparkSession) -> DataFrame:
    rows = [(m.canonical, m.label, m.category, list(m.keywords), m.value_kind, m.is_flow, m.subject, list(m.requires), list(m.exclude_near)) for m in V.METRICS]
    return spark.createDataFrame(rows, "canonical string, label string, category string, keywords array<string>, value_kind string, is_flow boolean, subject string, requires array<string>, exclude_near array<string>")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m.canonical) for m in V.METRICS for k in m.keywords], "alias string, canonical string")
