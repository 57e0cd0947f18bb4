"""Verdicts of all pairs of comparable facts, counted without making the pairs.

A verdict follows from two contexts (metric, scope, basis, part, kind of claim), from whether the periods are equal, whether the document or the
sentence is one, and from whether the values agree. So the facts of a bucket are counted by context, and n facts of one context and m of another are n * m pairs:

* Levels. All pairs of a bucket are counted as if they crossed documents; those inside a document, and those inside a sentence, are
  counted again, taken off as what they are not and added as what they are. Pairs of equal period are set right in the same way.
* Values of numbers matter for equal periods only. Two numbers agree if they are no further apart than the wider one of their
  tolerances, so from a value the agreeing smaller ones reach down to one border. Facts with equal values are one row with a weight;
  how many rows lie between a value and its border is a difference of running sums over the range-sorted values (`sweep.scan`): n log n, and a bucket may be
  any share of the rows. The border is exact: it is the last double that the comparison of the ladder itself accepts, found by
  halving (numpy, a column at a time; the only Python on the way of numbers).
* Texts of equal wording are one row with a weight, and each pair of different wordings is judged once.

Ids and fact_seq are unique, values of numbers finite, and attributes share families with attributes only; then the counts are those of `reasoning.judge`. (The
similarity of two different identifiers is taken in the order of their characters, not of their arrival.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V
from factweave.functions.numbers import rounding_half_unit
from factweave.functions.texts import identifier_shaped, similarity_tokens, words_similarity
from factweave.operators import sweep
from factweave.operators.matching import KEYS, eligible, family_key
from factweave.operators.reasoning import NUMBERS, TEXTS, Rung, context, identifier_similarity, ladder, likeness
from factweave.schema import column_type

#: Columns that name the pairs which a row of counts is about: bucket, level, document and sentence, period.
GROUP = (*KEYS, "level", "g_document", "g_page", "g_start", "dated", "g_period")
WHOLE, DOCUMENT, SENTENCE = 0, 1, 2
_ASKED = ("estimate", "partial_period", "share_of", "exclusions_apply")


@F.pandas_udf(column_type("double"))
def _border(x: pd.Series, rounding: pd.Series, percent: pd.Series) -> pd.Series:
    """The value furthest from x, from x towards -x, that still agrees with it."""
    v, r, points = x.to_numpy(float), rounding.to_numpy(float), percent.to_numpy(bool)
    top = np.abs(v)

    def agree(y: np.ndarray) -> np.ndarray:
        delta = np.abs(v - y)
        return np.where(points, delta <= np.maximum(V.PERCENT_POINT_TOLERANCE, r), (delta * 100.0 / top <= V.VALUE_TOLERANCE_PCT) | (delta <= r))

    # Doubles of one sign are in the order of their bits; with the sign put in front, so are all of them, as whole numbers.
    line = lambda y: np.where(y < 0, -1, 1) * np.abs(y).view(np.int64)
    value = lambda k: np.where(k < 0, -1.0, 1.0) * np.abs(k).view(np.float64)
    near, far = line(v), line(-v)  # near agrees
    near = np.where(agree(-v), far, near)
    while True:
        middle = near // 2 + far // 2 + (near % 2 + far % 2) // 2
        apart = (middle != near) & (middle != far)
        if not apart.any():
            return pd.Series(value(near))
        ok = agree(value(middle))
        near, far = np.where(apart & ok, middle, near), np.where(apart & ~ok, middle, far)


def _members(facts: DataFrame, per_document: bool, sentences: bool) -> DataFrame:
    """Each fact once for every group that it is counted in."""
    rows = eligible(facts).where(F.col("entity_canonical").isNotNull() & F.col("normalized_unit").isNotNull())
    rows = rows.withColumns({"k_entity": F.col("entity_canonical"), "k_family": family_key(), "k_unit": F.col("normalized_unit")})
    levels = [F.struct(F.lit(WHOLE).alias("level"), F.lit("").alias("g_document"), F.lit(-1).alias("g_page"), F.lit(-1).alias("g_start"))]
    if not per_document:
        levels.append(F.struct(F.lit(DOCUMENT).alias("level"), F.col("document_id").alias("g_document"), F.lit(-1).alias("g_page"), F.lit(-1).alias("g_start")))
    if sentences:
        placed = F.col("page_number").isNotNull() & F.col("char_start").isNotNull()
        levels.append(F.when(placed, F.struct(F.lit(SENTENCE).alias("level"), F.col("document_id").alias("g_document"), F.col("page_number").cast("int").alias("g_page"), F.col("char_start").cast("int").alias("g_start"))))
    rows = rows.withColumn("at", F.explode(F.array(*levels))).where("at is not null").select("*", "at.*")
    undated = F.struct(F.lit(False).alias("dated"), F.lit("").alias("g_period"))
    dated = F.when(F.col("period") != "unknown", F.struct(F.lit(True).alias("dated"), F.col("period").alias("g_period")))
    return rows.withColumn("when", F.explode(F.array(undated, dated))).where("when is not null").select("*", "when.*").drop("at", "when")


def _sum_pairs(a: Column, b: Column, n: Column, m: Column) -> Column:
    return F.when(a == b, n * (n - 1) / 2).otherwise(n * m).cast("long")


def _met(classes: DataFrame, on: tuple[str, ...], weight: str) -> DataFrame:
    """(on, a, b, n): pairs of classes (column ctx) with equal columns on, and of how many members."""
    a = classes.select(*on, F.col("ctx").alias("a"), F.col(weight).alias("n"))
    b = classes.select(*on, F.col("ctx").alias("b"), F.col(weight).alias("m"))
    return a.join(b, list(on)).where("a <= b").select(*on, "a", "b", _sum_pairs(F.col("a"), F.col("b"), F.col("n"), F.col("m")).alias("n"))


def _agreeing(rows: DataFrame) -> DataFrame:
    """(GROUP, a, b, same): how many pairs of two contexts agree in value, in groups where that matters."""
    asked = rows.where(F.col("x").isNotNull() & (F.col("dated") | F.col("ctx.identifier")))
    nodes = sweep.stored(asked.groupBy(*GROUP, "ctx", "x", "rounding").agg(F.count(F.lit(1)).alias("w")), "nodes")
    equal = _met(nodes.groupBy(*GROUP, "ctx", "x").agg(F.sum("w").alias("w")), (*GROUP, "x"), "w").select(*GROUP, "a", "b", F.col("n").alias("same"))
    others = nodes.select(*GROUP, F.col("ctx").alias("other"), F.col("rounding").alias("other_rounding")).distinct()
    x = F.col("x")
    border = _border(x, F.greatest("rounding", "other_rounding"), F.col("k_unit") == "PERCENT")
    asks = nodes.where("x <> 0").join(others, list(GROUP)).withColumn("border", border).where("border <> x")
    # Between x and its border, x left out: for x > 0 from the border on, for x < 0 up to it; -x itself counts for x > 0 alone.
    up = x > 0
    to_x, to_border = F.when(up, 0).otherwise(2), F.when(up | (F.col("border") == -x), 0).otherwise(2)
    sign = F.when(up, 1).otherwise(-1)
    step = lambda y, kind, times: F.struct(y.alias("y"), kind.alias("kind"), times.alias("times"))
    edges = F.array(step(x, to_x, sign * F.col("w")), step(F.col("border"), to_border, -sign * F.col("w")))
    key = F.struct(*GROUP, F.col("other").alias("ctx"), F.col("other_rounding").alias("rounding"))
    asks = asks.select(key.alias("list"), "ctx", F.explode(edges).alias("at")).select("list", "at.y", "at.kind", "at.times", "ctx", F.lit(None).cast("long").alias("w"))
    points = nodes.select(F.struct(*GROUP, "ctx", "rounding").alias("list"), x.alias("y"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("times"), F.lit(None).cast(nodes.schema["ctx"].dataType).alias("ctx"), "w")
    order = ["list", "y", "kind"]
    seen = sweep.scan(sweep.lined_up(asks.unionByName(points), order), order, below=sweep.total(F.col("w"))).where("times is not null")
    one, two = F.col("ctx"), F.col("list.ctx")
    near = seen.select(*[F.col(f"list.{c}").alias(c) for c in GROUP], F.least(one, two).alias("a"), F.greatest(one, two).alias("b"), (F.col("times") * F.col("below")).alias("same"))
    return equal.unionByName(near)


def _sides(pairs: DataFrame) -> DataFrame:
    """The contexts a and b as columns a_* and b_*, of pairs of one metric or of one named family."""
    fields = pairs.schema["a"].dataType.names
    out = pairs.withColumns({f"{side}_{c}": F.col(side)[c] for side in "ab" for c in fields})
    family = (F.col("a_predicate_family") != "") & (F.col("a_predicate_family") == F.col("b_predicate_family"))
    return out.where((F.col("a_metric_canonical") == F.col("b_metric_canonical")) | F.coalesce(family, F.lit(False))).drop("a", "b")


_CASES = "array<struct<times:bigint,period_ok:boolean,same_document:boolean,same_sentence:boolean,same_value:boolean>>"


def _case(n: Column, period_ok: bool, same_document: Column | bool, same_sentence: bool = False, same_value: bool = False) -> Column:
    flags = {"period_ok": F.lit(period_ok), "same_document": same_document if isinstance(same_document, Column) else F.lit(same_document), "same_sentence": F.lit(same_sentence), "same_value": F.lit(same_value)}
    return F.struct(n.cast("long").alias("times"), *[c.alias(k) for k, c in flags.items()])


def _by_level(cases, per_document: bool) -> Column:
    """The cases of a row of counts, taken on and off by what its pairs are; cases(sign, same_document, same_sentence) lists them."""
    inside = F.col("a_document_id") == F.col("b_document_id") if per_document else F.lit(False)
    parts = F.when(F.col("level") == WHOLE, F.array(*cases(1, inside, False)))
    parts = parts.when(F.col("level") == DOCUMENT, F.array(*cases(-1, False, False), *cases(1, True, False)))
    return parts.otherwise(F.array(*cases(-1, True, False), *cases(1, True, True)))


def _judged(pairs: DataFrame, rungs: tuple[Rung, ...], per_document: bool) -> DataFrame:
    basis = F.when(F.col("family_only"), "family").otherwise("exact").alias("match_basis")
    documents = [F.least("a_document_id", "b_document_id").alias("doc_a"), F.greatest("a_document_id", "b_document_id").alias("doc_b")] if per_document else []
    shown = pairs.select(ladder(rungs, lambda r: F.lit(r.verdict)).alias("relationship_type"), ladder(rungs, lambda r: F.lit(r.factor)).alias("divergence_factor"), basis, (~F.col("same_document")).alias("cross_document"), *documents, "times")
    return shown.groupBy(*shown.columns[:-1]).agg(F.sum("times").alias("n"))


def _numbers(facts: DataFrame, per_document: bool) -> DataFrame:
    rows = _members(facts.where("numeric_value is not null"), per_document, True)
    asked = F.filter(F.array(*map(F.lit, _ASKED)), lambda q: F.coalesce(F.array_contains("qualifiers", q), F.lit(False)))
    own = ["metric_canonical", "predicate_family", "scope", "accounting_standard", "sub_metric", asked.alias("qualifiers"), identifier_shaped(F.lower(F.trim("raw_value"))).alias("identifier"), *["document_id"] * per_document]
    value = F.col("normalized_numeric_value") + F.lit(0.0)  # no negative zero
    rows = sweep.stored(rows.select(*GROUP, F.struct(*own).alias("ctx"), value.alias("x"), rounding_half_unit(F.col("raw_value")).alias("rounding")), "members")
    classes = rows.groupBy(*GROUP, "ctx").agg(F.count(F.lit(1)).alias("w"))
    nothing = F.lit(0).cast("long")
    pairs = _met(classes, GROUP, "w").withColumn("same", nothing).unionByName(_agreeing(rows).select(*GROUP, "a", "b", nothing.alias("n"), "same"))
    pairs = context(_sides(pairs.groupBy(*GROUP, "a", "b").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))))
    n, same, fixed = F.col("n"), F.col("same"), F.coalesce(F.col("a_identifier") & F.col("b_identifier"), F.lit(False))

    def valued(sign, inside, sentence):
        return [_case(sign * same, True, inside, sentence, True), _case(sign * (n - same), True, inside, sentence)]

    def undated(sign, inside, sentence):
        return [_case(sign * n, False, inside, sentence)]

    def dated(sign, inside, sentence):
        return [*valued(sign, inside, sentence), *undated(-sign, inside, sentence)]

    # All pairs of a group count as of unequal periods, unless both are identifiers; those of equal periods are set right.
    cases = F.when(F.col("dated") & fixed, F.array().cast(_CASES)).when(F.col("dated"), _by_level(dated, per_document)).when(fixed, _by_level(valued, per_document)).otherwise(_by_level(undated, per_document))
    return _judged(pairs.withColumn("case", F.explode(cases)).select("*", "case.*").where("times <> 0"), NUMBERS, per_document)


def _texts(facts: DataFrame, per_document: bool) -> DataFrame:
    rows = _members(facts.where("numeric_value is null").withColumn("text", F.lower(F.trim("raw_value"))), per_document, False)
    rows = rows.where(~F.col("dated") | ~F.col("metric_canonical").startswith("attr."))  # verdicts on attributes have no period
    own = F.struct("metric_canonical", "predicate_family", "text", *["document_id"] * per_document)
    classes = rows.select(*GROUP, own.alias("ctx")).groupBy(*GROUP, "ctx").agg(F.count(F.lit(1)).alias("w"))
    # Most dated facts are alone in their group; what a comparison costs is worked out for pairs alone, words only where the wordings differ.
    pairs = _sides(_met(classes, GROUP, "w").where("n > 0"))
    a, b, unlike = F.col("a_text"), F.col("b_text"), F.col("a_text") != F.col("b_text")
    identifier = lambda side: F.coalesce(identifier_shaped(F.col(f"{side}_text")), F.lit(False))
    pairs = pairs.withColumn("identifiers", identifier("a") & identifier("b"))
    ids, n = F.col("identifiers"), F.col("n")
    words = {f"{side}_words": F.when(unlike & ~ids, similarity_tokens(F.col(f"{side}_text"))) for side in "ab"}
    plain = words_similarity(F.col("a_words"), F.col("b_words"), a == b)
    # Only pairs of two different identifiers go to Python.
    same, codes = pairs.where(~(ids & F.coalesce(unlike, F.lit(True)))).withColumns(words), pairs.where(ids & F.coalesce(unlike, F.lit(True)))
    pairs = likeness(same, plain).drop(*words).unionByName(likeness(codes, identifier_similarity(a, b)))
    pairs = pairs.withColumn("family_only", F.col("a_metric_canonical") != F.col("b_metric_canonical"))

    def undated(sign, inside, _):
        return [_case(sign * n, False, inside)]

    def fixed(sign, inside, _):
        return [_case(sign * n, True, inside)]

    def dated(sign, inside, _):
        return [*fixed(sign, inside, _), *undated(-sign, inside, _)]

    cases = F.when(F.col("dated") & ids, F.array().cast(_CASES)).when(F.col("dated"), _by_level(dated, per_document)).when(ids, _by_level(fixed, per_document)).otherwise(_by_level(undated, per_document))
    return _judged(pairs.withColumn("case", F.explode(cases)).select("*", "case.*"), TEXTS, per_document)


def verdict_counts(facts: DataFrame, per_document: bool = False) -> DataFrame:
    """relationship_type, divergence_factor, match_basis, cross_document and n, over all pairs that `reasoning.judge` would make of facts.

    per_document adds doc_a and doc_b, the two documents of the pairs in order; then contexts are told apart by document.
    """
    both = _numbers(facts, per_document).unionByName(_texts(facts, per_document))
    keys = [c for c in both.columns if c != "n"]
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
