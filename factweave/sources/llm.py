"""Settings and the cached call to a language model. The call itself is given by whoever has one; without it all is off."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources import scratch

MODES = ("off", "hybrid", "full")


class Unavailable(Exception):
    """The model gave no usable answer."""


@dataclass(frozen=True)
class Settings:
    key: str = ""
    mode: str = "off"
    model_fast: str = ""
    model_strong: str = ""

    @property
    def enabled(self) -> bool:
        return bool(self.key) and self.mode != "off"


def env_file(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file, quotes stripped; comments and an unreadable file give nothing."""
    try:
        with open(path, encoding="utf-8") as lines:
            pairs = [line.partition("=") for line in map(str.strip, lines) if line and line[0] != "#" and "=" in line]
    except OSError:
        return {}
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def settings(path: str = ".env", prefix: str = "FACTWEAVE_", environment: dict[str, str] | None = None) -> Settings:
    """The environment wins over the file; without a key, or with an unknown mode, the mode is off."""
    env = os.environ if environment is None else environment
    found = env_file(path) | {k: v for k, v in env.items() if k.startswith(prefix)}
    get = lambda name, default="": found.get(prefix + name, default)
    mode = get("MODE", "hybrid").lower()
    return Settings(get("KEY"), mode if get("KEY") and mode in MODES else "off", get("MODEL_FAST"), get("MODEL_STRONG"))


def cache_key(model: str, prompt_version: str, schema_version: str, prompt: str) -> str:
    return hashlib.sha256("\0".join((model, prompt_version, schema_version, prompt)).encode()).hexdigest()


def cache_key_column(*parts: Column) -> Column:
    """cache_key of four columns."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def json_call(spark: SparkSession, path: str, call: Callable[[str], str], prompt: str, model: str = "", prompt_version: str = "1", schema_version: str = "1") -> str:
    """The JSON object that call(prompt) answers, kept under path (Parquet, by key) and taken from there the next time.

    Anything but a JSON object, or any failure of the call, raises Unavailable; only objects are kept.
    """
    key = cache_key(model, prompt_version, schema_version, prompt)
    kept = cached(spark, path)
    hit = kept.where(F.col("key") == key).first() if kept is not None else None
    if hit:
        return hit.answer
    try:
        answer = call(prompt)
        fits = isinstance(json.loads(answer), dict)
    except Exception as failure:
        raise Unavailable(str(failure)) from failure
    if not fits:
        raise Unavailable("not an object")
    spark.createDataFrame([(key, answer)], "key string, answer string").coalesce(1).write.mode("append").parquet(path)
    return answer


#: Parts of the bulk cache, by key.
PARTS = 64
_ANSWERS = "key string, answer string, part int"


def json_calls(prompts: DataFrame, path: str, call: Callable[[str], str], prompt: str = "prompt", model: str = "", prompt_version: str = "1", schema_version: str = "1") -> DataFrame:
    """Rows of prompts with key, answer and error: the JSON objects that call gives, each different prompt asked once and kept below path.

    Prompts are made distinct, those whose keys are kept already drop out, and the rest are called in tasks, a part of the keys each. What is no object,
    and any failure of a call, is that prompt's error (its answer is null) and is not kept; it fails no task, so no task's other calls are made again.
    Answers are appended by one write, which counts once whatever attempts its tasks needed; only the loss of a worker makes that worker's open
    calls again. A null prompt has neither answer nor error.
    """
    spark = prompts.sparkSession
    key = cache_key_column(F.lit(model), F.lit(prompt_version), F.lit(schema_version), F.col(prompt))
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    asked = prompts.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt"), key.alias("key")).distinct().withColumn("part", part)
    kept = _bulk(spark, path)
    missing = asked.join(kept, ["key", "part"], "left_anti").repartition("part").select("key", "part", "prompt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for text in batch.column(2).to_pylist():
                try:
                    answer = call(text)
                    error = None if isinstance(json.loads(answer), dict) else "not an object"
                except Exception as failure:
                    answer, error = None, str(failure) or type(failure).__name__
                answers.append(answer if error is None else None)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["key", "part", "answer", "error"])

    # Written before anything reads it, so the calls are made by this write alone.
    told = scratch.path(spark, "answers")
    missing.mapInArrow(run, "key string, part int, answer string, error string").write.parquet(told)
    answered = spark.read.schema("key string, part int, answer string, error string").parquet(told)
    answered.where("error is null").select("key", "answer", "part").write.mode("append").partitionBy("part").parquet(path)
    every = kept.select("key", "answer", F.lit(None).cast("string").alias("error")).unionByName(answered.select("key", "answer", "error"))
    return prompts.withColumn("key", key).join(every, "key", "left").withColumn("answer", F.when(F.col(prompt).isNotNull(), F.col("answer")))


def _bulk(spark: SparkSession, path: str) -> DataFrame:
    """The kept answers as they are now: a list of their files is made here, so later answers are not among them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], _ANSWERS)
    return spark.read.schema(_ANSWERS).parquet(path)


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """The kept answers, or None before the first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema("key string, answer string").parquet(path)
