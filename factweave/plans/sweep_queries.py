"""Queries of the joins that are sweeps (nearest in time, one to one, claims of intervals) and of verdicts counted without pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators import search, spatial, sweep, tally
from factweave.plans import claims, oracle
from factweave.plans.queries import query
from factweave.sources import scratch


def _events(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type") == kind).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")


_EVENTS = """bought AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
clicks AS (SELECT user_id, ts, min(event_id) AS click FROM events WHERE event_type = 'click' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_EVENTS} SELECT b.event_id, coalesce(c.click, -1) AS click, coalesce(epoch_us(b.ts) - epoch_us(c.ts), -1) AS micros FROM bought b ASOF LEFT JOIN clicks c ON b.user_id = c.user_id AND b.ts >= c.ts")
def asof_last_click(spark, sf):
    """Each purchase with the last click of its user at or before it; -1 where there is none."""
    met = sweep.asof_join(_events(spark, sf, "purchase"), _events(spark, sf, "click"), ["user_id"], "ts", "backward")
    micros = F.unix_micros("ts") - F.unix_micros("match.ts")
    return met.select("event_id", F.coalesce("match.event_id", F.lit(-1)).alias("click"), F.coalesce(micros, F.lit(-1)).alias("micros"))


@query(f"""WITH {_EVENTS}, back AS (SELECT b.event_id, b.ts, c.click, c.ts AS seen FROM bought b ASOF LEFT JOIN clicks c ON b.user_id = c.user_id AND b.ts >= c.ts),
ahead AS (SELECT b.event_id, c.click, c.ts AS seen FROM bought b ASOF LEFT JOIN clicks c ON b.user_id = c.user_id AND b.ts <= c.ts),
met AS (SELECT b.event_id, b.ts, CASE WHEN a.seen IS NULL OR epoch_us(b.ts) - epoch_us(b.seen) <= epoch_us(a.seen) - epoch_us(b.ts) THEN [epoch_us(b.seen), b.click] ELSE [epoch_us(a.seen), a.click] END AS m FROM back b JOIN ahead a USING (event_id))
SELECT event_id, CASE WHEN abs(epoch_us(ts) - m[1]) <= 3600000000 THEN m[2] ELSE -1 END AS click FROM met""")
def asof_nearest_click(spark, sf):
    """Each purchase with the click of its user nearest in time, either way, at most an hour off (else -1); equally near, the earlier one."""
    near = F.abs(F.unix_micros("ts") - F.unix_micros("match.ts")) <= 3_600_000_000
    met = sweep.asof_join(_events(spark, sf, "purchase"), _events(spark, sf, "click"), ["user_id"], "ts", "nearest", reach=near)
    return met.select("event_id", F.coalesce("match.event_id", F.lit(-1)).alias("click"))


@query("""WITH a AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'),
pairs AS (SELECT a.user_id, a.event_id AS view_id, b.event_id AS purchase_id, a.t, b.t AS u, CASE WHEN b.t >= a.t THEN b.t - a.t ELSE a.t - b.t + 7200 END AS gap FROM a JOIN b USING (user_id) WHERE gap <= 86400),
taken AS (SELECT user_id, list_reduce(list([{'view_id': view_id, 'purchase_id': purchase_id, 'gap': gap}] ORDER BY gap, t, u, view_id, purchase_id),
  lambda done, x: CASE WHEN len(list_filter(done, lambda y: y.view_id = x[1].view_id OR y.purchase_id = x[1].purchase_id)) > 0 THEN done ELSE list_concat(done, x) END) AS done FROM pairs GROUP BY user_id)
SELECT user_id, m.view_id, m.purchase_id, m.gap FROM (SELECT user_id, unnest(done) AS m FROM taken)""")
def match_views_to_purchases(spark, sf):
    """Each view with a purchase of its user within a day, nearest pairs first, no event twice; a purchase before its view counts two hours more."""
    sides = [_events(spark, sf, kind).select("user_id", F.unix_seconds("ts").alias("at"), "event_id") for kind in ("view", "purchase")]
    met = sweep.match_one_to_one(*sides, ["user_id"], "at", "event_id", reach=86_400, behind=7_200)
    return met.select("user_id", F.col("a_id").alias("view_id"), F.col("b_id").alias("purchase_id"), "gap")


_PRIORITY = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(f"""WITH rows_ AS (SELECT l_suppkey, {', '.join(_PRIORITY)}, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INT) % 7) AS e FROM lineitem WHERE l_shipdate IS NOT NULL AND l_quantity IS NOT NULL),
taken AS (SELECT l_suppkey, list_reduce(list([{{'s': s, 'e': e, 'k': {{{', '.join(f"'{c}': {c}" for c in _PRIORITY)}}}}}] ORDER BY {', '.join(_PRIORITY)}, s, e),
  lambda done, x: CASE WHEN len(list_filter(done, lambda y: NOT (x[1].e <= y.s OR x[1].s >= y.e))) > 0 THEN done ELSE list_concat(done, x) END) AS done FROM rows_ GROUP BY l_suppkey)
SELECT l_suppkey, m.k.l_orderkey, m.k.l_linenumber, m.k.l_partkey, epoch_us(m.s) AS start_us, epoch_us(m.e) AS end_us FROM (SELECT l_suppkey, unnest(done) AS m FROM taken)""")
def claim_loading_days(spark, sf):
    """A supplier's ramp is taken from a line's shipping day on for some days, by the first order that asks; later ones that overlap go without."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).withColumn("until", F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int") % 7))
    held = sweep.claim_intervals(rows.select("l_suppkey", *_PRIORITY, "l_shipdate", "until"), ["l_suppkey"], "l_shipdate", "until", list(_PRIORITY))
    return held.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.unix_micros("l_shipdate").alias("start_us"), F.unix_micros("until").alias("end_us"))


@query(f"{oracle.JUDGED} SELECT relationship_type, divergence_factor, match_basis, cross_document, count(*) AS n FROM rels GROUP BY ALL")
def verdict_tally(spark, sf):
    """Verdicts of all pairs of the fact table, counted from contexts and sorted values; no pair is made."""
    return tally.verdict_counts(claims.facts(spark, sf))


@query(f"""{oracle.JUDGED} SELECT least(a_document_id, b_document_id) AS doc_a, greatest(a_document_id, b_document_id) AS doc_b, relationship_type, CAST(count(*) AS BIGINT) AS n FROM rels GROUP BY ALL""")
def document_tally(spark, sf):
    """Verdict counts of each pair of documents, counted without pairs of facts."""
    return tally.verdict_counts(claims.facts(spark, sf), per_document=True).groupBy("doc_a", "doc_b", "relationship_type").agg(F.sum("n").alias("n"))


_LINES = "lines AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS ix, min(l_suppkey) AS s, min(CAST(l_quantity AS BIGINT)) AS q, l_partkey AS p, l_linenumber AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey, l_linenumber, l_partkey)"
_SIDES = {
    "v": "p % 7 * 20 AS x0, n * 20 + q % 15 AS y0, p % 7 * 20 + 60 AS x1, n * 20 + q % 15 + 12 AS y1",
    "l": "s % 7 * 20 + 3 AS x0, n * 22 + page % 9 AS y0, s % 7 * 20 + 63 AS x1, n * 22 + page % 9 + 12 AS y1",
}
_BOXES = f"""{_LINES},
amounts AS (SELECT page, ix, {_SIDES['v']} FROM lines),
names AS (SELECT page, ix, {_SIDES['l']} FROM lines)"""


@query(f"""WITH {_BOXES},
near AS (SELECT v.page, v.ix AS value_ix, l.ix AS label_ix, CASE WHEN l.y0 - v.y1 BETWEEN -6 AND 28 THEN l.y0 - v.y1 WHEN v.y0 - l.y1 BETWEEN -6 AND 28 THEN v.y0 - l.y1 + 10 END AS d
  FROM amounts v JOIN names l ON v.page = l.page AND l.x0 < v.x1 AND l.x1 > v.x0 AND abs(l.x0 - v.x0) <= 40),
asked AS (SELECT page, value_ix, list({{'v': value_ix, 'l': label_ix, 'd': d}} ORDER BY d, label_ix) AS wishes FROM near WHERE d IS NOT NULL GROUP BY ALL),
told AS (SELECT page, list_reduce(list_prepend([], list(wishes ORDER BY value_ix)), lambda done, x: list_concat(done, list_filter(x, lambda y: NOT list_contains(list_transform(done, lambda z: z.l), y.l))[1:1])) AS done FROM asked GROUP BY page)
SELECT page, m.v AS value_ix, m.l AS label_ix, CAST(m.d AS DOUBLE) AS d FROM (SELECT page, unnest(done) AS m FROM told)""")
def tiles_by_grid(spark, sf):
    """An order is a page whose lines put an amount and a name on it; each amount takes its nearest free name, in block order."""
    lines = spark.sql(f"WITH lineitem AS (SELECT * FROM {{lineitem}}), {_LINES} SELECT * FROM lines", lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))
    both = F.array(*[F.struct(F.lit(side).alias("side"), *[F.expr(c).cast("double").alias(c.split()[-1]) for c in boxes.split(", ")]) for side, boxes in _SIDES.items()])  # both sides of a line from one reading
    boxes = lines.select("page", F.col("ix").alias("block_ix"), F.explode(both).alias("box")).select("page", "block_ix", "box.*")
    return spatial.pair_boxes(boxes, ["page"])


_QUESTION = "tion De"


@query(f"SELECT doc_id FROM documents WHERE contains(lower(text), lower('{_QUESTION}'))")
def search_documents(spark, sf):
    """Documents that contain a phrase, by their trigrams and the exact test."""
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    path = scratch.path(spark, "postings")
    search.write_postings(rows, "doc_id", "text", path)
    return search.search(rows, "doc_id", "text", _QUESTION, path).select("doc_id")
