"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factweave.plans import queries as relational
from factweave.plans import views
from factweave.sources import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("~" if v is None or v != v else repr(v) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(relational.SQL))
def test_query_equals_sql(spark, db, name):
    want, got = db.execute(relational.SQL[name]).fetchdf(), relational.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)
    assert len(got) > 0 or name == "truncate_facts"


@pytest.mark.parametrize("name", sorted(set(relational.QUERIES) - set(relational.SQL)))
def test_query_runs(spark, name):
    assert relational.QUERIES[name](spark, SF).count() > 0


def test_quotes_wherever_they_stand(spark, tmp_path):
    texts = ["(one two three four five)", "x-one  two", "zone two three four five six", "one two three four five", "one\ttwo three four five", "", "two"]
    quotes = ["one two three four five", "one", "two", " two three four ", "ne two three four five s", "six seven"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = sorted((d, i, t.index(q)) for d, t in enumerate(texts) for i, q in enumerate(quotes) if q in t)
    got = relational.QUERIES["evidence_locate"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r["at"]) for r in got) == want


def test_quotes_by_words_equal_quotes_by_automaton(spark, monkeypatch):
    texts = ["(one two three four five) one two three four five", None, "zone two three four five six", "", "two"]
    quotes = ["one two three four five", "one", "", None, "ne two three four five s", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    found = sorted(views.quoted(docs, asked).collect())
    monkeypatch.setattr(views, "AUTOMATON", -1)
    assert found == sorted(views.quoted(docs, asked).collect()) and (4, 2, 0) in found and len(found) == 11


def test_places_of_quotes(spark):
    rows = [("alpha beta gamma delta", "alpha beta", -1, 0), ("x alpha beta", "alpha beta", 2, 2), ("x alpha beta", "alpha beta", 0, 2), ("x alpha", "beta", -1, None), ("alpha beta", "alpha beta", None, 0)]
    table = spark.createDataFrame(rows, "page string, quote string, stored int, want int")
    assert all(r["at"] == r.want for r in table.withColumn("at", views.locate(F.col("quote"), F.col("page"), F.col("stored"))).collect())


def test_stored_tables_follow_their_source(spark, tmp_path):
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(str(tmp_path / "t.parquet"))
        assert scratch.kept(spark, "n", str(tmp_path), lambda: spark.read.parquet(str(tmp_path / "t.parquet"))).count() == n


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_delta_equals_full_has_a_row_a_pair(spark, db):
    """every pair is a row with both its ids; none is summed up by bucket."""
    got = relational.QUERIES["match_delta_equals_full"](spark, SF)
    pairs = db.execute(f"{relational.oracle.PAIRS} SELECT count(*) FROM pairs").fetchone()[0]
    assert got.columns == ["one", "other"] and got.count() == got.distinct().count() == pairs


def test_first_labels_without_a_sort_of_all_facts(spark):
    """Labels of metrics are counted by hashing; no operator sorts what it reads from the fact table."""
    rows = [("m.a", "A two", 5), ("m.a", "A one", 2), ("m.a", None, 1), ("m.b", "B", 3), ("m.c", "C", 9), ("m.a", "A two", 0)]
    facts = spark.createDataFrame(rows, "metric_canonical string, metric string, fact_seq long")
    found = views.discovered(facts, spark.createDataFrame([("m.c",)], "canonical string"))
    assert sorted(map(tuple, found.collect())) == [("m.a", 4, "A two"), ("m.b", 1, "B")]
    facts = facts.withColumns({"normalized_numeric_value": F.lit(1.0), "period": F.lit("FY2024")})
    plan = views.metrics_available(facts)._jdf.queryExecution().executedPlan().toString().splitlines()
    below = plan[max((i for i, line in enumerate(plan) if "HashAggregate" in line), default=0) :]
    assert len(below) < len(plan) and not any("Sort" in line for line in below)
