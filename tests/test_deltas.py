"""Views kept by signed rows against a rebuild, after uploads, replacements and deletes in any order."""

import itertools

import pytest
from pyspark.sql import functions as F

from factweave.operators.reasoning import judge
from factweave.plans import claims, views
from factweave.schema import FACTS
from factweave.streaming.deltas import UPLOADS, Maintained

SF = "/root/testdata/sf0.001"
DOCS = ("d1", "d2", "d6", "d12", "d13")


@pytest.fixture(scope="module")
def facts(spark):
    return claims.facts(spark, SF).where(F.col("document_id").isin(*DOCS)).where("fact_seq % 1000000 < 60000").cache()


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def changed(facts):
    """The same documents with other figures, under the same ids."""
    return facts.withColumns({"numeric_value": F.col("numeric_value") * 2, "normalized_numeric_value": F.col("normalized_numeric_value") * 2})


def put(facts, name, upload):
    return facts.where(F.col("document_id") == name).select("*", F.lit(upload).cast("long").alias("upload"), F.lit(False).alias("deleted"))


def gone(spark, facts, name, upload):
    (named,) = facts.where(F.col("document_id") == name).select("document_name").distinct().collect()
    none = [None] * len(FACTS.fields)
    none[FACTS.fieldNames().index("document_name")] = named[0]
    return spark.createDataFrame([(*none, upload, True)], UPLOADS)


def equal_to_rebuild(store, want):
    rels = judge(want)
    assert rels.count() > 0
    assert rows(store.facts()) == rows(want.select(*FACTS.fieldNames()))
    assert rows(store.relationships()) == rows(rels)
    assert rows(store.view("verdicts")) == rows(rels.groupBy("relationship_type", "divergence_factor", "match_basis", "cross_document").agg(F.count(F.lit(1)).alias("n")))
    assert rows(store.coverage()) == rows(views.metric_coverage(want, rels).drop("label"))
    assert rows(store.health()) == rows(views.document_health(want, rels).drop("low_confidence"))
    matrix = rels.groupBy(F.least("a_document_id", "b_document_id").alias("doc_a"), F.greatest("a_document_id", "b_document_id").alias("doc_b"), "relationship_type").agg(F.count(F.lit(1)).alias("n"))
    assert rows(store.view("pairs")) == rows(matrix)


def test_uploads_replacements_and_deletes_equal_a_rebuild(spark, tmp_path, facts):
    store = Maintained(spark, str(tmp_path / "store"), parts=3, merged=2)
    only = lambda *names: facts.where(F.col("document_id").isin(*names))
    store.apply(put(facts, "d1", 1).unionByName(put(changed(facts), "d2", 1)).unionByName(put(facts, "d12", 1)), 0)
    equal_to_rebuild(store, only("d1", "d12").unionByName(changed(only("d2"))))
    # d2 replaced under the same ids, d12 gone, d13 new, d6 told twice in a batch
    store.apply(put(facts, "d2", 2).unionByName(gone(spark, facts, "d12", 2)).unionByName(put(facts, "d13", 1)).unionByName(put(changed(facts), "d6", 1)).unionByName(put(facts, "d6", 2)), 1)
    equal_to_rebuild(store, only("d1", "d2", "d13", "d6"))
    # an old upload that comes late, one that comes again, one back after its delete, a delete of what was never there
    store.apply(put(changed(facts), "d12", 1).unionByName(put(facts, "d2", 2)), 2)
    equal_to_rebuild(store, only("d1", "d2", "d13", "d6"))
    again = put(facts, "d12", 3).unionByName(gone(spark, facts, "d1", 2))
    store.apply(again, 3)
    equal_to_rebuild(store, only("d2", "d13", "d6", "d12"))
    store.apply(again, 3)  # the same batch once more, as after a failure
    equal_to_rebuild(store, only("d2", "d13", "d6", "d12"))
    assert store._base("verdicts") == 3


def test_any_order_of_batches_gives_the_same(spark, tmp_path, facts):
    want = None
    steps = [put(changed(facts), "d2", 1).unionByName(put(facts, "d1", 1)), put(facts, "d2", 2), gone(spark, facts, "d1", 5)]
    for i, order in enumerate(itertools.islice(itertools.permutations(steps), 1, 6, 2)):
        store = Maintained(spark, str(tmp_path / f"store{i}"), parts=2)
        for number, step in enumerate(order):
            store.apply(step, number)
        found = rows(store.facts()), rows(store.view("verdicts")), rows(store.health())
        want = want or found
        assert found == want
    assert len(want[0]) == facts.where("document_id = 'd2'").count()


def test_a_stream_of_uploads_starts_again_where_it_ended(spark, tmp_path, facts):
    store = Maintained(spark, str(tmp_path / "store"), parts=2)
    into = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: store.start(spark.readStream.schema(UPLOADS).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    into(put(facts, "d1", 1).unionByName(put(changed(facts), "d2", 1)))
    run()
    into(put(facts, "d2", 2))
    run()
    run()
    equal_to_rebuild(store, facts.where("document_id in ('d1', 'd2')"))


def test_empty_batches_and_an_empty_store(spark, tmp_path):
    store = Maintained(spark, str(tmp_path / "store"))
    assert store.facts().count() == store.relationships().count() == store.health().count() == store.coverage().count() == 0
    store.apply(spark.createDataFrame([], UPLOADS), 0)
    assert store.facts().count() == store.relationships().count() == store.view("pairs").count() == 0
