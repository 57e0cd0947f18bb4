"""Predicate families: labels that name one thing, grouped outside and read here with tolerance.

Few labels go into one prompt. More of them go in rounds of prompts of bounded size: labels that are alike stand together first, each family that a round
tells goes on as one of its labels, and in the last round every two that are left meet in some prompt. Families that share a label become one. So
if the answer on two labels does not depend on what stands beside them, the families are those of one prompt with all labels.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V
from factweave.sources import scratch
from factweave.sources.llm import Unavailable, json_calls

#: Labels of a prompt at most; a round that leaves more than this share of its labels is the last one before all meet.
SIZE, FALLS = 400, 0.9


def labels(facts: DataFrame) -> DataFrame:
    """Distinct non-empty labels."""
    return facts.where(F.coalesce("metric", F.lit("")) != "").select("metric").distinct()


def parse(payload: DataFrame, column: str = "payload", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, raw, family, confidence) of JSON payloads: what has the wrong shape is left out, the last word on a label counts (by: of each prompt).

    Every level is read as text first, so a malformed piece costs that piece alone.
    """
    families = F.from_json(F.get_json_object(column, "$.families"), "array<string>")
    rows = payload.select(*by, F.posexplode(families).alias("f", "family"))
    rows = rows.select(*by, "f", F.trim(F.get_json_object("family", "$.family_id")).alias("family_id"), F.from_json(F.get_json_object("family", "$.members"), "array<string>").alias("members"))
    members = rows.where("family_id <> ''").select(*by, "f", "family_id", F.posexplode("members").alias("m", "member"))
    read = members.select(*by, "f", "m", "family_id", F.trim(F.get_json_object("member", "$.raw")).alias("raw"), F.coalesce(F.get_json_object("member", "$.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"))
    kept = read.where((F.col("raw") != "") & (F.col("confidence") >= V.FAMILY_MEMBER_CONFIDENCE))
    last = kept.groupBy(*by, "raw").agg(F.max_by(F.struct("family_id", "confidence"), F.struct("f", "m")).alias("last"))
    return last.select(*by, "raw", F.col("last.family_id").alias("family"), F.col("last.confidence").alias("confidence"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch.path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _near(names: DataFrame, order: Column, size: int) -> DataFrame:
    """(place, raw): labels in blocks of at most `size` that are neighbours in an order."""
    rows = names.select("raw", order.alias("order"))
    at = rows.repartitionByRange("order", "raw").sortWithinPartitions("order", "raw").withColumn("at", F.monotonically_increasing_id())
    within = F.col("at").bitwiseAND((1 << 33) - 1)
    return _written(at.select(F.concat_ws("-", F.shiftright("at", 33), F.floor(within / size)).alias("place"), "raw"), "blocks")


def _all_met(names: DataFrame, size: int) -> DataFrame:
    """(place, raw): every two labels in a prompt together: the pairs of blocks of half the size."""
    halves = _near(names, F.col("raw"), max(1, size // 2))
    numbered = halves.groupBy().agg(F.sort_array(F.collect_set("place")).alias("places")).select(F.posexplode("places").alias("own", "place"), F.size("places").alias("k"))  # one row a block
    met = halves.join(numbered, "place").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("own <> other or k = 1")
    return met.select(F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("place"), "raw")


def _asked(placed: DataFrame, call: Callable[[list[str]], str], cache: str) -> DataFrame:
    """(place, raw, family, confidence): what the prompts say of the labels that stand in them; a prompt without an answer says nothing."""
    prompts = placed.groupBy("place").agg(F.to_json(F.sort_array(F.collect_list("raw"))).alias("prompt"))
    told = json_calls(prompts, cache, lambda text: call(json.loads(text)), prompt_version="families")
    return _written(parse(told, "answer", ("place",)).join(placed, ["place", "raw"], "left_semi"), "told")


def connected(edges: DataFrame) -> DataFrame:
    """(raw, root) of edges (a, b): the smallest label that each label's links reach, itself included.

    Each round every label takes the smallest root among its neighbours, and then its root's root; rounds follow the logarithm of the longest chain or so.
    """
    both = _written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = _written(both.groupBy(F.col("a").alias("raw")).agg(F.min(F.least("a", "b")).alias("root")), "roots")
    while True:
        near = both.join(roots, F.col("b") == F.col("raw")).groupBy("a").agg(F.min("root").alias("least"))
        joined = roots.join(near, F.col("raw") == F.col("a")).select("raw", "root", F.least("root", "least").alias("least"))
        up = roots.select(F.col("raw").alias("least"), F.col("root").alias("above"))
        new = _written(joined.join(up, "least").select("raw", F.least("least", "above").alias("root"), F.col("root").alias("before")), "roots")
        if new.where("root <> before").isEmpty():
            return new.select("raw", "root")
        roots = new.select("raw", "root")


def in_batches(names: DataFrame, call: Callable[[list[str]], str], cache: str | None = None, size: int = SIZE) -> DataFrame:
    """(raw, family, confidence) of any number of distinct labels (metric), from prompts of at most `size` labels each.

    A family has the smallest of the names it was given; where two families end with one name, the one with the smaller label has it and the others
    have their own label behind it. A label's confidence is the highest it was given; one that no prompt speaks of is left out.
    """
    cache = cache or scratch.path(names.sparkSession, "families")
    reps, told = _written(names.select(F.trim("metric").alias("raw")).where("raw <> ''").distinct(), "labels"), None
    count = reps.count()
    orders = [F.array_join(F.array_sort(F.split(F.lower("raw"), r"[^\p{L}\p{N}]+")), " "), F.reverse(F.lower("raw"))]
    turn = 0
    while count > size:
        heard = _asked(_near(reps, orders[turn % 2], size), call, cache)
        told = heard.withColumn("turn", F.lit(turn)) if told is None else told.unionByName(heard.withColumn("turn", F.lit(turn)))
        first = heard.groupBy("place", "family").agg(F.min("raw").alias("first"))
        behind = heard.join(first, ["place", "family"]).where("raw <> first").select("raw")
        reps = _written(reps.join(behind, "raw", "left_anti"), "labels")
        left, turn = reps.count(), turn + 1
        if left > FALLS * count:
            break
        count = left
    last = _asked(_all_met(reps, size), call, cache).withColumn("turn", F.lit(turn))
    told = last if told is None else told.unionByName(last)
    told = _written(told, "told")
    stars = told.groupBy("turn", "place", "family").agg(F.min("raw").alias("first"))
    roots = connected(told.join(stars, ["turn", "place", "family"]).select(F.col("raw").alias("a"), F.col("first").alias("b")))
    own = told.groupBy("raw").agg(F.max("confidence").alias("confidence"), F.min("family").alias("named")).join(roots, "raw")
    named = own.groupBy("root").agg(F.min("named").alias("family"))
    keeps = named.groupBy("family").agg(F.min("root").alias("keeper"))
    final = named.join(keeps, "family").select("root", F.when(F.col("root") == F.col("keeper"), F.col("family")).otherwise(F.concat_ws(" ", "family", F.concat(F.lit("("), "root", F.lit(")")))).alias("family"))
    return own.join(final, "root").select("raw", "family", "confidence")


def assign(facts: DataFrame, families: DataFrame) -> DataFrame:
    """facts with predicate_family and its confidence; a change never shares the family of its level."""
    own = families.select(F.col("raw").alias("metric"), F.col("family"), F.col("confidence").alias("sure"))
    joined = facts.join(own, "metric", "left")
    family = F.coalesce("family", "metric_canonical")
    apart = F.col("metric_canonical").endswith(".change") & ~family.endswith(".change")
    named = {"predicate_family": F.when(apart, F.concat(family, F.lit(".change"))).otherwise(family), "predicate_family_confidence": F.bround(F.coalesce("sure", F.lit(1.0)), 2)}
    return joined.withColumns(named).select(*facts.columns)


def fallback(facts: DataFrame) -> DataFrame:
    """Each metric its own family."""
    return facts.withColumns({"predicate_family": F.col("metric_canonical"), "predicate_family_confidence": F.lit(1.0)})


def group(spark: SparkSession, facts: DataFrame, call: Callable[[list[str]], str] | None, size: int = SIZE) -> DataFrame:
    """facts with the families that call(labels) gives as JSON; without a call, or if it is unavailable, the fallback.

    Up to `size` labels go into one prompt, which is what is collected here; more of them go in batches, called in tasks.
    """
    if call is None:
        return fallback(facts)
    names = sorted(r.metric for r in labels(facts).limit(size + 1).collect())
    if not names:
        return fallback(facts)
    if len(names) > size:
        return assign(facts, in_batches(labels(facts), call, size=size))
    try:
        payload = call(names)
    except Unavailable:
        return fallback(facts)
    return assign(facts, parse(spark.createDataFrame([(payload,)], "payload string")))


PROMPT = """Group these metric labels into families. Labels of one family name the same quantity and can be compared.
Never put a level and a change of that level into one family. Every label belongs to exactly one family.
Answer as JSON: {"families": [{"family_id": ..., "family_label": ..., "members": [{"raw": ..., "confidence": 0 to 1}]}]}

"""


def prompt(names: list[str]) -> str:
    return PROMPT + "\n".join(f"- {n}" for n in names)
