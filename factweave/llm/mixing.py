"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Each source has a target number of words (a share by weight, at most twice its size, the excess shared out again).
Of the ratio of target to size, the whole part is taken as certain whole copies of every document. The rest is drawn
without replacement: a document of inclusion probability p (in proportion to ln(1 + words)) and random u ranks by
u / (1 - u) divided by p / (1 - p), and documents are taken in this order until the words come nearest the target.
The cut in that order is found digit by digit: counts of words by (source, digit of the rank) are small tables, so a
source with a third of all rows is nobody's task; only the documents that share the last digit are sorted.

Defined results: a null text has size 0; the null source is a source of its own, last in order; documents of size 0 are
taken with 0 words; rows that repeat id and text draw the same random number; an empty table, or one without words, takes
nothing; other columns are ignored here and kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import WORD, fresh, materialize, row_key

#: Weights by rank of the source, repeating; total of the targets as a share of all words; most copies of a document.
WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2
#: The rank is cut into this many base-256 digits.
DIGITS = 3


def _random(id_col: str, text: str) -> Column:
    """Uniform in (0, 1) from the document's id and text, the same in every run."""
    part = F.substring(F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))), 1, 13)
    return (F.conv(part, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """source, source_size, target, whole (certain copies), words (to draw), norm of (source, size): one row a source.

    The norm is a sum of decimals, which no order of rows can change.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.log1p("size") * F.col("size")).cast("decimal(38,6)")).cast("double").alias("norm"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(copies))
    # The sources at their cap are the first by cap / weight; the others share what is left in proportion to weight.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    total = F.sum("source_size").over(Window.partitionBy()) * share
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - before) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    common = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("weight")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    by = by.withColumn("whole", whole).withColumn("words", F.col("target") - F.col("whole") * F.col("source_size"))
    return by.select("source", "source_size", "target", "whole", "words", "norm")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def shares(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(rk, doc_id, source, size, source_size, target, copies) for every row: how often the mix takes it."""
    rows = docs.select(
        row_key(id_col, text).alias("rk"), F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _random(id_col, text).alias("u"),
    )
    rows = materialize(rows, "sizes")
    by = materialize(source_targets(rows), "targets").withColumnRenamed("source", "of")
    chance = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("words") * F.log1p("size"), F.col("norm")), F.lit(0.0)))
    odds = F.col("u") / (1 - F.col("u"))
    rank = F.when(F.col("chance") >= 1, 0.0).when(F.col("chance") > 0, odds * (1 - F.col("chance")) / F.col("chance"))
    rows = rows.join(by, _same(rows["source"], by["of"])).drop("of").withColumn("chance", chance).withColumn("rank", rank)
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * float(256**DIGITS)).cast("int")
    rows = rows.withColumn("place", F.least(F.lit(256**DIGITS - 1), place))
    rows = materialize(rows.select("rk", "doc_id", "source", "size", "source_size", "target", "whole", "words", "rank", "place"), "ranked")

    cut = by.where("words > 0").select("of", "words", F.lit(0).alias("at"), F.lit(0.0).alias("before"))
    drawn = rows.where("words > 0 and size > 0").select("source", "size", "place")
    for k in range(DIGITS):
        unit = 256 ** (DIGITS - 1 - k)
        own = cut.select("of", "at", "before", F.col("words").alias("goal"))
        inside = drawn.join(own, _same(drawn["source"], own["of"])).where(F.floor(F.col("place") / (unit * 256)) == F.col("at"))
        digits = inside.groupBy("of", "goal", "before", F.floor(F.col("place") / unit).cast("int").alias("digit")).agg(F.sum("size").alias("size"))
        up_to = F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy("digit"))
        reach = digits.withColumn("up_to", up_to).withColumn("last", F.max("digit").over(Window.partitionBy("of")))
        reach = reach.where((F.col("up_to") >= F.col("goal")) | (F.col("digit") == F.col("last")))
        cut = materialize(reach.groupBy("of", F.col("goal").alias("words")).agg(F.min("digit").alias("at"), F.min(F.col("up_to") - F.col("size")).alias("before")), "cut")

    edge = cut.select("of", F.col("at").alias("edge"), "before")
    met = rows.join(edge, _same(rows["source"], edge["of"]), "left").drop("of")
    at_edge = met.where("words > 0 and size > 0 and place = edge")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "rk").rowsBetween(Window.unboundedPreceding, -1)
    near = at_edge.withColumn("extra", (F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("words")).cast("int"))
    away = met.where("not coalesce(words > 0 and size > 0 and place = edge, false)").withColumn("extra", F.coalesce((F.col("words") > 0) & (F.col("size") > 0) & (F.col("place") < F.col("edge")), F.lit(False)).cast("int"))
    out = away.unionByName(near)
    return out.select("rk", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, all columns as they were."""
    taken = materialize(shares(docs, id_col, text, source), "shares")
    key, many, origin = fresh(docs, "rk", "copies", "origin")
    # Rows that repeat id, text and source are taken alike.
    by = taken.groupBy(F.col("rk").alias(key), F.col("source").alias(origin)).agg(F.max("copies").alias(many)).where(F.col(many) != 1)
    keyed = docs.withColumn(key, row_key(id_col, text))
    joined = keyed.join(by, (keyed[key] == by[key]) & keyed[source].cast("string").eqNullSafe(by[origin]), "left").drop(by[key]).drop(origin)
    return joined.withColumn(many, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(many), F.lit(1))))).where(F.col(many) > 0).drop(key, many)


#: The mix of `documents` in DuckDB: the same random numbers and the same order, with one window a source.
ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CAST(ln(1 + size::DOUBLE) * size AS DECIMAL(38, 6))) AS DOUBLE) AS norm,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank_ FROM rows_ GROUP BY source),
w AS (SELECT *, CASE (rank_ - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT *, CASE WHEN level * weight >= cap THEN cap
    ELSE weight * (SELECT g.level FROM f g WHERE g.level * g.weight < g.cap ORDER BY g.cap / g.weight, g.rank_ LIMIT 1) END AS target FROM f),
d AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (
  SELECT r.doc_id, r.source, r.size, d.source_size, d.target, d.whole, d.target - d.whole * d.source_size AS words, r.u,
    least(1.0::DOUBLE, (d.target - d.whole * d.source_size) * ln(1 + r.size::DOUBLE) / d.norm) AS chance
  FROM rows_ r JOIN d ON r.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, CASE WHEN chance >= 1 THEN 0.0::DOUBLE WHEN chance > 0 THEN u / (1 - u) * (1 - chance) / chance END AS rank_ FROM p),
c AS (
  SELECT *, coalesce(sum(CASE WHEN words > 0 AND size > 0 THEN size END) OVER
    (PARTITION BY source ORDER BY rank_ NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM q)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN words > 0 AND size > 0 AND before_ + size / 2.0::DOUBLE <= words THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
