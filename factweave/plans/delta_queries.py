"""The views as they are kept by signed rows while documents come, are replaced and go, against SQL over what is left in the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans import claims, oracle
from factweave.plans.queries import query
from factweave.schema import FACTS
from factweave.sources import scratch
from factweave.streaming.deltas import UPLOADS, Maintained

#: What happens to the documents after all have come: some had wrong figures and are replaced, one goes for good, one goes and comes again.
WRONG, GOES, RETURNS = ("d2", "d10"), "d13", "d6"


def _uploads(facts: DataFrame, number: int) -> DataFrame:
    return facts.select("*", F.lit(number).cast("long").alias("upload"), F.lit(False).alias("deleted"))


def _deletes(facts: DataFrame, number: int) -> DataFrame:
    names = facts.groupBy("document_name").agg(F.lit(number).cast("long").alias("upload"))
    return names.select(*[F.col(f.name) if f.name in names.columns else F.lit(f.name == "deleted" or None).cast(f.dataType).alias(f.name) for f in UPLOADS])


def kept_views(spark: SparkSession, sf: str) -> Maintained:
    """A store after three batches of uploads, replacements and deletes of the lifted claims."""
    facts = claims.facts(spark, sf).select(*FACTS.fieldNames())
    of = lambda *ids: facts.where(F.col("document_id").isin(*ids))
    wrong = F.col("document_id").isin(*WRONG)
    first = facts.withColumns({c: F.when(wrong, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("numeric_value", "normalized_numeric_value")})
    store = Maintained(spark, scratch.path(spark, "kept-views"))
    batches = (_uploads(first, 1), _uploads(of(*WRONG), 2).unionByName(_deletes(of(GOES, RETURNS), 2)), _uploads(of(RETURNS), 3))
    for number, batch in enumerate(batches):
        store.apply(batch, number)
    return store


def _long(df: DataFrame, view: str, keys: list[str], sums: list[str]) -> DataFrame:
    """One row for each figure: view, a, b, c, n."""
    named = [*[F.coalesce(F.col(k), F.lit("")) for k in keys], *[F.lit("")] * (2 - len(keys))]
    return df.select(F.lit(view).alias("view"), named[0].alias("a"), named[1].alias("b"), F.explode(F.array(*[F.struct(F.lit(s).alias("c"), F.col(s).cast("long").alias("n")) for s in sums])).alias("f")).select("view", "a", "b", "f.c", "f.n")


@query(f"""{oracle.JUDGED},
left_ AS (SELECT * FROM rels WHERE a_document_id <> '{GOES}' AND b_document_id <> '{GOES}'), held AS (SELECT *, confidence >= 0.6 AS fit FROM facts WHERE document_id <> '{GOES}'),
touched AS (SELECT DISTINCT unnest([a_id, b_id]) AS id FROM left_),
health AS (SELECT document_id, count(*) AS facts, count(*) FILTER (fit) AS matchable, count(t.id) AS linked FROM held LEFT JOIN touched t USING (id) GROUP BY ALL),
coverage AS (SELECT metric_canonical, count(*) AS facts, count(DISTINCT document_id) AS documents FROM held WHERE fit GROUP BY ALL),
evidence AS (SELECT metric_canonical, count(*) FILTER (relationship_type = 'CORROBORATED') AS corroborated, count(*) FILTER (relationship_type = 'CONTRADICTION') AS conflicting FROM left_ WHERE cross_document GROUP BY ALL),
told AS (SELECT metric_canonical, facts, documents, coalesce(corroborated, 0) AS corroborated, coalesce(conflicting, 0) AS conflicting FROM coverage LEFT JOIN evidence USING (metric_canonical))
SELECT 'verdicts' AS "view", relationship_type AS a, coalesce(divergence_factor, '') AS b, 'n' AS c, count(*) AS n FROM left_ GROUP BY ALL
UNION ALL SELECT 'pairs', least(a_document_id, b_document_id) || ' ' || greatest(a_document_id, b_document_id), relationship_type, 'n', count(*) FROM left_ GROUP BY ALL
UNION ALL SELECT 'health', document_id, '', c, n FROM (UNPIVOT health ON facts, matchable, linked INTO NAME c VALUE n)
UNION ALL SELECT 'coverage', metric_canonical, '', c, n FROM (UNPIVOT told ON facts, documents, corroborated, conflicting INTO NAME c VALUE n)""")
def views_by_increments(spark, sf):
    """Verdicts, documents against documents, health and coverage, kept while documents are replaced, deleted and come again."""
    store = kept_views(spark, sf)
    verdicts = store.view("verdicts").groupBy("relationship_type", "divergence_factor").agg(F.sum("n").alias("n"))
    pairs = store.view("pairs").withColumn("pair", F.concat_ws(" ", "doc_a", "doc_b"))
    told = [
        _long(verdicts, "verdicts", ["relationship_type", "divergence_factor"], ["n"]), _long(pairs, "pairs", ["pair", "relationship_type"], ["n"]),
        _long(store.health(), "health", ["document_id"], ["facts", "matchable", "linked"]),
        _long(store.coverage(), "coverage", ["metric_canonical"], ["facts", "documents", "corroborated", "conflicting"]),
    ]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])
