"""Which facts are compared: bucketed equi-joins, in full and by increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V

#: What the comparison of two facts reads; evidence stays behind and is joined to the results.
COMPARED = (
    "fact_seq", "id", "document_id", "entity", "entity_canonical", "metric", "metric_canonical", "predicate_family", "raw_value", "numeric_value",
    "normalized_numeric_value", "normalized_unit", "period_raw", "period", "scope", "accounting_standard", "sub_metric", "qualifiers", "page_number",
    "char_start", "confidence",
)
#: Columns of facts that a comparison reads too, if they are there: what follows from one fact alone is worked out once a fact, not once a pair.
PREPARED = ("text", "identifier", "words")


def _compared(facts: DataFrame) -> list[str]:
    return [*COMPARED, *[c for c in PREPARED if c in facts.columns]]


def family_key() -> Column:
    """The predicate family where there is one, else the metric."""
    return F.coalesce(F.nullif(F.col("predicate_family"), F.lit("")), F.col("metric_canonical"))


def eligible(facts: DataFrame) -> DataFrame:
    """Facts confident enough, with a known period or being attributes."""
    return facts.where((F.col("confidence") >= V.MATCH_THRESHOLD) & ((F.col("period") != "unknown") | F.col("metric_canonical").startswith("attr.")))


def _side(facts: DataFrame, letter: str) -> DataFrame:
    rows = eligible(facts).where(F.col("entity_canonical").isNotNull() & F.col("normalized_unit").isNotNull())
    own = [F.col(c).alias(f"{letter}_{c}") for c in _compared(facts)]
    return rows.select(F.col("entity_canonical").alias("k_entity"), family_key().alias("k_family"), F.col("normalized_unit").alias("k_unit"), *own)


def _admitted(pairs: DataFrame) -> DataFrame:
    """Pairs of different facts of one metric or of one named family."""
    family = (F.col("a_predicate_family") != "") & (F.col("a_predicate_family") == F.col("b_predicate_family"))
    return pairs.where((F.col("a_id") != F.col("b_id")) & ((F.col("a_metric_canonical") == F.col("b_metric_canonical")) | F.coalesce(family, F.lit(False))))


KEYS = ["k_entity", "k_family", "k_unit"]


#: Facts of a bucket beyond which it is dealt in blocks, and facts of a block.
BLOCK = 1024


def heavy_buckets(facts: DataFrame, block: int) -> DataFrame:
    """KEYS and n of the buckets of more than `block` facts; they are no more than all facts by block."""
    return _side(facts, "x").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)


def light(facts: DataFrame) -> bool:
    """Whether no bucket of facts, and so none of any part of them, is heavy."""
    return heavy_buckets(facts, BLOCK).isEmpty()


def _dealt(facts: DataFrame, heavy: DataFrame, block: int) -> DataFrame:
    """Facts of heavy buckets, each once for every pair of blocks of its bucket that it is in: KEYS, here <= there, own, columns x_*.

    A bucket has as many blocks as hold `block` facts each on average; facts are dealt to them by a hash.
    """
    parts = F.ceil(F.col("n") / block).cast("int")
    rows = _side(facts, "x").join(heavy, KEYS).withColumn("parts", parts).drop("n")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("x_fact_seq"), F.col("parts")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumns({"here": F.least("own", "other"), "there": F.greatest("own", "other")}).drop("parts", "other")


def _triangles(dealt: DataFrame) -> DataFrame:
    """The pairs of dealt facts, the earlier one first: each pair of blocks meets once, in a group of its own."""
    group = [*KEYS, "here", "there"]
    columns = [c.removeprefix("x_") for c in dealt.columns if c.startswith("x_")]
    one = dealt.where("own = here").select(*group, *[F.col(f"x_{c}").alias(f"one_{c}") for c in columns])
    two = dealt.where("own = there").select(*group, *[F.col(f"x_{c}").alias(f"two_{c}") for c in columns])
    first, second = F.col("one_fact_seq"), F.col("two_fact_seq")
    met = one.join(two, group).where(F.when(F.col("here") == F.col("there"), first < second).otherwise(first != second))
    ordered = [F.when((first < second) == F.lit(side == "a"), F.col(f"one_{c}")).otherwise(F.col(f"two_{c}")).alias(f"{side}_{c}") for side in "ab" for c in columns]
    return met.select(*KEYS, *ordered)


def bucket_pairs(facts: DataFrame, block: int | None = None, none_heavy: bool = False) -> DataFrame:
    """Every admitted pair of a bucket once, the earlier fact first: columns a_* and b_*.

    Heavy buckets, if there are any (they are counted first), are triangles of blocks: a bucket of n facts is n * n / 2 comparisons in groups of at most
    two blocks, whatever share of the facts it has, and each fact is copied once a block. All others meet in one plain join.
    none_heavy: that there are none is known (`light`), and nothing is counted.
    """
    heavy = heavy_buckets(facts, block or BLOCK)
    a, b = _side(facts, "a"), _side(facts, "b")
    if none_heavy or heavy.isEmpty():
        return _admitted(a.join(b, KEYS).where("a_fact_seq < b_fact_seq"))
    light = a.join(heavy.select(*KEYS), KEYS, "left_anti").join(b, KEYS).where("a_fact_seq < b_fact_seq")
    return _admitted(light.unionByName(_triangles(_dealt(facts, heavy, block or BLOCK))))


def delta_pairs(new: DataFrame, old: DataFrame, ordered: bool = False, none_heavy: bool = False) -> DataFrame:
    """The pairs that new facts add: each new fact (as a) with every old one, and with later new ones.

    ordered: the earlier fact is a, whichever of the two is new, so a pair is the same in whatever batch it is made.
    """
    met = _side(new, "a").join(_side(old, "b"), KEYS)
    if ordered:
        first = F.col("a_fact_seq") < F.col("b_fact_seq")
        met = met.select(*KEYS, *[F.when(first == F.lit(s == "a"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"{s}_{c}") for s in "ab" for c in _compared(new)])
    return _admitted(met).unionByName(bucket_pairs(new, none_heavy=none_heavy))


def bucket_sizes(facts: DataFrame) -> DataFrame:
    """entity, family, unit, facts and pairs of each bucket: what the self-join will cost."""
    rows = _side(facts, "a").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("facts"))
    return rows.withColumn("pairs", (F.col("facts") * (F.col("facts") - 1) / 2).cast("bigint"))
