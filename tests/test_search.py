import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factweave.operators import search
from factweave.sources import llm


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("abÄé 1%_😀") for _ in range(rnd.randrange(60))), "x") for i in range(400)] + [(400, None, "x"), (401, "", "x"), (7, "again ab1", "x")]
    df = spark.createDataFrame(rows, "id long, body string, gram string")
    path = str(tmp_path_factory.mktemp("search") / "postings")
    search.write_postings(df, "id", "body", path)
    return df, path


@pytest.mark.parametrize("question", ["ab1", "AB1", "äé ", "a%_b", "no such thing", "a", "", "bbbbb", "ab ab", "a😀b", "😀😀"])
def test_same_rows_as_contains(texts, question):
    df, path = texts
    want = df.where(F.contains(F.lower("body"), F.lower(F.lit(question)))).collect()
    assert sorted(search.search(df, "id", "body", question, path).collect()) == sorted(want)


def test_only_the_parts_of_the_question_are_read(spark, texts):
    _, path = texts
    whole = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    found = search.postings(spark, path, "long", ["ab1"])
    read = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) <= search.SALTS < len(whole) and "PartitionFilters: [" in found._jdf.queryExecution().toString()


def test_no_question_has_no_rows(texts):
    df, path = texts
    assert search.search(df, "id", "body", None, path).collect() == []


def _grams(text):
    data = text.lower().encode()
    return {int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)}


@pytest.mark.parametrize("size", [1, 50, 1 << 22])
def test_lists_hold_each_id_of_a_trigram_once(monkeypatch, size):
    """Of texts by slices of any size, nulls, short and empty ones and a cut batch included, as counted by hand."""
    rnd = random.Random(size)
    texts = [None, "", "ab", "aaaaaa", "aaaa", "é😀é😀", None, *["".join(rnd.choice("abé 😀") for _ in range(rnd.randrange(40))) for _ in range(60)], ""]
    ids = [f"n{i}" if i % 9 else None for i in range(len(texts))]
    monkeypatch.setattr(search, "SLICE", size)
    whole = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([t if t is None else t.encode() for t in texts], pa.binary())], names=["id", "body"])
    got = [r for b in search._listed(iter([whole.slice(0, 11), whole.slice(11), whole.slice(0, 0)])) for r in b.to_pylist()]
    pairs = sorted((r["gram"], str(i)) for r in got for i in r["ids"])
    assert pairs == sorted((g, str(i)) for i, t in zip(ids, texts, strict=True) if t for g in _grams(t))
    assert all(r["n"] == len(r["ids"]) > 0 and r["part"] == search._part(r["gram"]) in range(search.PARTS) for r in got)


def test_postings_are_lists_made_by_all_tasks(spark, tmp_path):
    """A trigram is a row for each slice of texts, not for each id; and texts that lie in one split are dealt before they are read."""
    rows = spark.range(6000).select("id", F.expr("array_join(transform(sequence(0, 9), i -> sha2(concat(id, '-', i), 512)), 'zzz')").alias("body")).coalesce(1)  # 8 MB: two slices if one task had them all
    path = str(tmp_path / "postings")
    search.write_postings(rows, "id", "body", path)
    lists = search.postings(spark, path, "long", ["zzz"])
    assert sorted(r.id for r in lists.select(F.explode("ids").alias("id")).collect()) == list(range(6000))
    assert lists.agg(F.sum("n")).first()[0] == 6000 and 4 <= lists.count() < 60


@pytest.mark.parametrize("kind", ["long", "string", "decimal(12,2)", "timestamp", "struct<x: long>"])
def test_ids_of_any_type_null_ones_included(spark, tmp_path, kind):
    rows = spark.range(40).select(F.expr("nullif(id, 3)").alias("key"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("say ÄÉ "), F.col("id"))).alias("able"), F.lit(1).alias("n"))
    rows = rows.withColumn("key", F.struct(F.col("key").alias("x")) if kind.startswith("struct") else F.col("key").cast("timestamp") if kind == "timestamp" else F.col("key").cast(kind))
    path = str(tmp_path / "postings")
    search.write_postings(rows, "key", "able", path)
    for question, many in (("äé", 14), ("y äÉ 3", 5), ("äéé", 0)):
        got = search.search(rows, "key", "able", question, path)
        assert got.columns == rows.columns and sorted(got.collect(), key=str) == sorted(rows.where(F.contains(F.lower("able"), F.lower(F.lit(question)))).collect(), key=str) and got.count() == many


def test_calls_in_bulk(spark, tmp_path):
    """Each different prompt is asked once in a run with repeats and failures, kept answers are not asked for again."""
    asked = str(tmp_path / "asked")

    def call(prompt):
        with open(asked, "a") as log:
            log.write(prompt + "\n")
        if "fails" in prompt:
            raise ValueError("no answer")
        return "[1]" if "list" in prompt else '{"about": "%s"}' % prompt

    def calls():
        with open(asked) as log:
            return sorted(log.read().split("\n")[:-1])

    rows = [(f"p{i % 7}", i) for i in range(40)] + [("fails", 40), ("fails", 41), ("list", 42), (None, 43)]
    df = spark.createDataFrame(rows, "prompt string, key_no int").repartition(6)
    path = str(tmp_path / "cache")
    got = llm.json_calls(df, path, call).collect()
    assert len(got) == len(rows) and calls() == sorted({f"p{i}" for i in range(7)} | {"fails", "list"})
    assert {(r.prompt, r.answer, r.error) for r in got} == {(f"p{i}", '{"about": "p%d"}' % i, None) for i in range(7)} | {("fails", None, "no answer"), ("list", None, "not an object"), (None, None, None)}
    again = llm.json_calls(df.where("prompt like 'p%'").unionByName(spark.createDataFrame([("p9", 1)], "prompt string, key_no int")), path, call).collect()
    assert calls().count("p3") == 1 and calls().count("p9") == 1 and len(again) == 41 and all(r.answer for r in again)
    assert all(r.key == llm.cache_key("", "1", "1", r.prompt) for r in again)
    assert llm.json_calls(df.limit(0), path, call).count() == 0
