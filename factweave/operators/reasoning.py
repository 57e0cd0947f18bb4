"""The verdict on a pair of facts: an ordered ladder of conditions, as one CASE over columns a_* and b_*.

Numbers and texts have ladders of their own. Each rung names its verdict, what sets the facts apart, and a confidence for pairs
of one metric and for pairs that only a family brought together. Only identifiers' character similarity needs Python
(Arrow batches, and only where two different identifiers meet); everything else is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V
from factweave.functions.numbers import rounding_half_unit
from factweave.functions.texts import alignment, identifier_shaped, similarity_tokens, words_similarity
from factweave.operators.matching import bucket_pairs, delta_pairs, light
from factweave.schema import column_type

AGREE, CONFLICT, EXPLAINED, REVIEW = "CORROBORATED", "CONTRADICTION", "CONTEXTUALLY_EXPLAINED", "INSUFFICIENT_EVIDENCE"


@dataclass(frozen=True)
class Rung:
    when: str
    verdict: str
    factor: str | None
    confidence: float
    by_family: float | None = None


# Verdicts, factors and confidences, first rung that holds. The conditions are columns of `judged`.
NUMBERS = (
    Rung("same_value AND period_ok AND context_ok", AGREE, None, 0.95, 0.80),
    Rung("same_value AND period_ok", AGREE, None, 0.85, 0.72),
    Rung("NOT period_ok", EXPLAINED, "DIFFERENT_PERIODS", 0.90),
    Rung("sub_metric_differs AND NOT basis_differs AND NOT scope_differs", EXPLAINED, "SUB_METRIC_DIFFERENCE", 0.88),
    Rung("basis_differs OR scope_differs", EXPLAINED, "SCOPE_OR_BASIS", 0.88),
    Rung("estimate_differs", EXPLAINED, "DATA_VINTAGE", 0.85),
    Rung("share_differs", EXPLAINED, "DIFFERENT_DEFINITION", 0.85),
    Rung("exclusions_differ", EXPLAINED, "EXCLUSIONS_DIFFER", 0.80),
    Rung("partial_differs", EXPLAINED, "PARTIAL_PERIOD", 0.80),
    Rung("same_sentence", REVIEW, "SAME_SENTENCE", 0.50),
    Rung("same_document", REVIEW, "SAME_LABEL_DIFFERENT_SUBJECTS", 0.50),
    Rung("family_only", REVIEW, "FAMILY_MATCH_ONLY", 0.45),
    Rung("both_estimates", CONFLICT, "COMPETING_ESTIMATES", 0.70),
    Rung("TRUE", CONFLICT, "VALUE_CONFLICT", 0.85),
)
TEXTS = (
    Rung("attribute AND same_text AND equal_text", AGREE, None, 0.90),
    Rung("attribute AND same_text", AGREE, None, 0.75),
    Rung("attribute AND identifiers AND similarity >= 0.88", EXPLAINED, "IDENTIFIER_REVISED", 0.85),
    Rung("attribute AND NOT identifiers AND similarity >= 0.3", REVIEW, "PARTIAL_TEXT_MATCH", 0.50),
    Rung("attribute AND family_only", REVIEW, "FAMILY_MATCH_ONLY", 0.45),
    Rung("attribute", CONFLICT, "ATTRIBUTE_CONFLICT", 0.70),
    Rung("same_text AND period_ok", AGREE, None, 0.90),
    Rung("same_text", AGREE, None, 0.75),
    Rung("NOT period_ok", EXPLAINED, "STATUS_CHANGED_OVER_TIME", 0.88),
    Rung("family_only", REVIEW, "FAMILY_MATCH_ONLY", 0.45),
    Rung("TRUE", CONFLICT, "STATUS_CONFLICT", 0.80),
)


@F.pandas_udf(column_type("double"))
def _identifier_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alignment(x, y)[0] if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(column_type("struct<differing:int,length:int>"))
def character_difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """(characters that differ, length of the longer) of two identifiers; nulls give nulls."""
    rows = [alignment(x, y)[1:] if isinstance(x, str) and isinstance(y, str) else (None, None) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame(rows, columns=["differing", "length"]).astype("Int32")


def identifier_similarity(a: Column, b: Column) -> Column:
    """Twice the aligned characters over all characters; 1 for equal texts, without a call to Python."""
    unlike = a != b
    return F.when(unlike, _identifier_similarity(F.when(unlike, a), F.when(unlike, b))).otherwise(1.0)


def _one_side(qualifier: str) -> Column:
    return F.coalesce(F.array_contains("a_qualifiers", qualifier), F.lit(False)) != F.coalesce(F.array_contains("b_qualifiers", qualifier), F.lit(False))


def _both(qualifier: str) -> Column:
    return F.coalesce(F.array_contains("a_qualifiers", qualifier) & F.array_contains("b_qualifiers", qualifier), F.lit(False))


def context(pairs: DataFrame) -> DataFrame:
    """What sets the contexts of two claims apart, whatever their values, periods and places."""
    narrow = F.col("a_scope").isin("standalone", "segment", "industry") | F.col("b_scope").isin("standalone", "segment", "industry")
    told = (F.col("a_scope") != "unspecified") & (F.col("b_scope") != "unspecified")
    parts = F.array_sort(F.array("a_sub_metric", "b_sub_metric"))
    named = (F.col("a_sub_metric") != "unspecified") & (F.col("b_sub_metric") != "unspecified") & (F.col("a_sub_metric") != "") & (F.col("b_sub_metric") != "")
    out = pairs.withColumns({
        "family_only": F.col("a_metric_canonical") != F.col("b_metric_canonical"),
        "scope_differs": F.coalesce((F.col("a_scope") != F.col("b_scope")) & (told | narrow), F.lit(False)),
        "basis_differs": F.coalesce(F.col("a_accounting_standard") != F.col("b_accounting_standard"), F.lit(False)),
        "sub_metric_differs": F.coalesce((F.col("a_sub_metric") != F.col("b_sub_metric")) & named & (parts != F.array(F.lit("operations"), F.lit("total"))), F.lit(False)),
        "estimate_differs": _one_side("estimate"), "partial_differs": _one_side("partial_period"), "share_differs": _one_side("share_of"),
        "exclusions_differ": _one_side("exclusions_apply"), "both_estimates": _both("estimate"),
    })
    odd = ("scope_differs", "basis_differs", "sub_metric_differs", "estimate_differs", "partial_differs", "share_differs", "exclusions_differ")
    context_ok = F.lit(True)
    for c in odd:
        context_ok = context_ok & ~F.col(c)
    return out.withColumn("context_ok", context_ok)


def prepared(facts: DataFrame) -> DataFrame:
    """facts with their wording, whether it is an identifier, and its words: `bucket_pairs` carries them, and the ladders need not read it again for each pair."""
    out = facts.withColumn("text", F.lower(F.trim("raw_value")))
    return out.withColumns({"identifier": identifier_shaped(F.col("text")), "words": similarity_tokens(F.col("text"))})


def _compared(pairs: DataFrame) -> DataFrame:
    """The columns that both ladders ask for."""
    out = context(pairs)
    for side in "ab":
        if f"{side}_text" not in out.columns:
            out = out.withColumn(f"{side}_text", F.lower(F.trim(f"{side}_raw_value")))
            out = out.withColumns({f"{side}_identifier": identifier_shaped(F.col(f"{side}_text")), f"{side}_words": similarity_tokens(F.col(f"{side}_text"))})
    known = (F.col("a_period") != "unknown") & (F.col("b_period") != "unknown")
    out = out.withColumns({
        "identifiers": F.col("a_identifier") & F.col("b_identifier"),
        "same_document": F.col("a_document_id") == F.col("b_document_id"),
    })
    same_page = F.col("same_document") & (F.col("a_page_number") == F.col("b_page_number")) & (F.col("a_char_start") == F.col("b_char_start"))
    return out.withColumns({
        "period_ok": F.col("identifiers") | F.coalesce(known & (F.col("a_period") == F.col("b_period")), F.lit(False)),
        "same_sentence": F.coalesce(same_page, F.lit(False)),
    })


def ladder(rungs: tuple[Rung, ...], pick) -> Column:
    first, *rest = rungs
    out = F.when(F.expr(first.when), pick(first))
    for rung in rest:
        out = out.when(F.expr(rung.when), pick(rung))
    return out


def _confidence(rung: Rung) -> Column:
    return F.lit(rung.confidence) if rung.by_family is None else F.when(F.col("family_only"), rung.by_family).otherwise(rung.confidence)


def _judge(out: DataFrame, rungs: tuple[Rung, ...]) -> DataFrame:
    least = F.least("a_confidence", "b_confidence")
    return out.withColumns({
        "relationship_type": ladder(rungs, lambda r: F.lit(r.verdict)),
        "divergence_factor": ladder(rungs, lambda r: F.lit(r.factor)),
        "confidence": F.bround(ladder(rungs, _confidence) * least / 0.9, 2),
        "match_basis": F.when(F.col("family_only"), "family").otherwise("exact"),
        "cross_document": ~F.col("same_document"),
        "id": F.sha2(F.concat_ws("|", F.lit("rel"), "a_id", "b_id"), 256),
    })


def judge_numbers(pairs: DataFrame) -> DataFrame:
    """Verdicts on pairs whose both sides have a number."""
    out = _compared(pairs.where("a_numeric_value is not null and b_numeric_value is not null"))
    x, y = F.col("a_normalized_numeric_value"), F.col("b_normalized_numeric_value")
    delta, top = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
    rounding = F.greatest(rounding_half_unit(F.col("a_raw_value")), rounding_half_unit(F.col("b_raw_value")))
    out = out.withColumns({"delta": delta, "delta_pct": F.when(top == 0, 0.0).otherwise(F.try_divide(delta * 100.0, top)), "rounding": rounding})
    percent = F.col("a_normalized_unit") == "PERCENT"
    close = F.when(percent, F.col("delta") <= F.greatest(F.lit(V.PERCENT_POINT_TOLERANCE), F.col("rounding"))).otherwise((F.col("delta_pct") <= V.VALUE_TOLERANCE_PCT) | (F.col("delta") <= F.col("rounding")))
    out = _judge(out.withColumn("same_value", close), NUMBERS)
    return out.withColumns({"delta_percentage": F.bround("delta_pct", 2), "delta_absolute": F.bround("delta", 4)})


def likeness(pairs: DataFrame, similarity: Column) -> DataFrame:
    """The columns that the ladder of texts asks for, besides periods."""
    out = pairs.withColumns({"attribute": F.col("a_metric_canonical").startswith("attr."), "equal_text": F.col("a_text") == F.col("b_text"), "similarity": similarity})
    return out.withColumn("same_text", F.col("equal_text") | (~F.col("identifiers") & (F.col("similarity") >= V.TEXT_SAME)))


def judge_texts(pairs: DataFrame, no_identifiers: bool = False) -> DataFrame:
    """Verdicts on pairs of which a side has no number: attributes and states. no_identifiers: no pair is of two identifiers, so none goes to Python."""
    out = _compared(pairs.where("a_numeric_value is null or b_numeric_value is null"))
    a, b, ids = F.col("a_text"), F.col("b_text"), F.col("identifiers")
    similarity = words_similarity(F.col("a_words"), F.col("b_words"), a == b)
    if not no_identifiers:
        similarity = F.when(ids, identifier_similarity(F.when(ids, a), F.when(ids, b))).otherwise(similarity)
    out = likeness(out, similarity)
    return _judge(out, TEXTS).withColumns({"delta_percentage": F.lit(None).cast("double"), "delta_absolute": F.lit(None).cast("double")})


RESULT = (
    "id", "a_id", "b_id", "a_document_id", "b_document_id", "relationship_type", "divergence_factor", "confidence", "match_basis", "cross_document",
    "delta_percentage", "delta_absolute", "a_entity_canonical", "a_metric_canonical",
)


def judge(facts: DataFrame, old: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Relationships among facts, or those that facts add to old ones (ordered: as delta_pairs has it).

    A fact's unit is TEXT exactly if it has no number, and the unit is part of the bucket; so numbers and texts never share a
    bucket and are joined apart, which keeps Python out of the numbers' plan. Pairs of two identifiers are made by themselves, so that
    only they go through it. Buckets are counted once for all three.
    """
    none_heavy = light(facts)
    pairs = lambda f: bucket_pairs(f, none_heavy=none_heavy) if old is None else delta_pairs(f, old, ordered, none_heavy)
    facts, old = prepared(facts), old if old is None else prepared(old)
    numbers, texts = pairs(facts.where("numeric_value is not null")), facts.where("numeric_value is null")
    words = pairs(texts).where(~F.coalesce(F.col("a_identifier") & F.col("b_identifier"), F.lit(False)))
    codes = pairs(texts.where("identifier")).where("a_identifier and b_identifier")
    named = [F.col(c).alias(c.replace("a_entity", "entity").replace("a_metric", "metric")) for c in RESULT]
    return judge_numbers(numbers).select(*named).unionByName(judge_texts(words, no_identifiers=True).select(*named)).unionByName(judge_texts(codes).select(*named))


def checks(judged: DataFrame) -> DataFrame:
    """judged pairs with the five steps of their comparison as an array of structs."""
    def step(n: int, name: str, passed: Column, yes: Column, no: Column) -> Column:
        return F.struct(F.lit(n).alias("step_number"), F.lit(name).alias("name"), passed.alias("passed"), F.when(passed, yes).otherwise(no).alias("explanation"))

    against = lambda c: F.concat_ws(" against ", F.col(f"a_{c}"), F.col(f"b_{c}"))
    alike = F.col("same_value") if "same_value" in judged.columns else F.col("same_text")
    metric = F.when(F.col("family_only"), F.concat(against("metric"), F.lit(" share the family "), F.col("a_predicate_family"))).otherwise(F.concat(F.lit("both are "), F.col("a_metric_canonical")))
    return judged.withColumn("checks", F.array(
        step(1, "Entity", F.lit(True), F.concat(F.lit("both about "), F.col("a_entity_canonical")), F.lit("")),
        step(2, "Metric", F.lit(True), metric, F.lit("")),
        step(3, "Period", F.col("period_ok"), F.when(F.col("identifiers"), "an identifier has no period").otherwise(F.concat(F.lit("both for "), F.col("a_period"))), against("period")),
        step(4, "Context", F.col("context_ok"), F.lit("same scope, basis and kind of claim"), F.lit("scope, basis or kind of claim differ")),
        step(5, "Value" if "same_value" in judged.columns else "Text", alike, against("raw_value"), against("raw_value")),
    ))
