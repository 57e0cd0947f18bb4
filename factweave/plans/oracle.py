"""The same tables in DuckDB's SQL: facts, eligible facts, judged pairs.

Everything that is judged here (rungs, factors, confidences, tolerances, scales, stop words) is written out, and nothing
is imported from the operators: the two may only agree because both are right. The facts themselves are the shared fixture.
"""

from __future__ import annotations

from factweave.plans.claims_sql import FACTS_SQL

_COLUMNS = (
    "fact_seq", "id", "document_id", "entity", "entity_canonical", "metric", "metric_canonical", "predicate_family", "raw_value", "numeric_value",
    "normalized_numeric_value", "normalized_unit", "period_raw", "period", "scope", "accounting_standard", "sub_metric", "qualifier_list", "page_number",
    "char_start", "confidence",
)
_NUMBER_VERDICT = """CASE WHEN same_value AND period_ok THEN 'CORROBORATED'
  WHEN NOT period_ok OR sub_metric_differs OR basis_differs OR scope_differs OR estimate_differs OR share_differs OR exclusions_differ OR partial_differs THEN 'CONTEXTUALLY_EXPLAINED'
  WHEN same_sentence OR same_document OR family_only THEN 'INSUFFICIENT_EVIDENCE' ELSE 'CONTRADICTION' END"""
_NUMBER_FACTOR = """CASE WHEN same_value AND period_ok THEN NULL WHEN NOT period_ok THEN 'DIFFERENT_PERIODS'
  WHEN basis_differs OR scope_differs THEN 'SCOPE_OR_BASIS' WHEN sub_metric_differs THEN 'SUB_METRIC_DIFFERENCE' WHEN estimate_differs THEN 'DATA_VINTAGE'
  WHEN share_differs THEN 'DIFFERENT_DEFINITION' WHEN exclusions_differ THEN 'EXCLUSIONS_DIFFER' WHEN partial_differs THEN 'PARTIAL_PERIOD'
  WHEN same_sentence THEN 'SAME_SENTENCE' WHEN same_document THEN 'SAME_LABEL_DIFFERENT_SUBJECTS' WHEN family_only THEN 'FAMILY_MATCH_ONLY'
  WHEN both_estimates THEN 'COMPETING_ESTIMATES' ELSE 'VALUE_CONFLICT' END"""
_NUMBER_CONFIDENCE = """CASE WHEN same_value AND period_ok AND context_ok AND family_only THEN 0.80 WHEN same_value AND period_ok AND context_ok THEN 0.95
  WHEN same_value AND period_ok AND family_only THEN 0.72 WHEN same_value AND period_ok THEN 0.85 WHEN NOT period_ok THEN 0.90
  WHEN basis_differs OR scope_differs OR sub_metric_differs THEN 0.88 WHEN estimate_differs OR share_differs THEN 0.85 WHEN exclusions_differ OR partial_differs THEN 0.80
  WHEN same_sentence OR same_document THEN 0.50 WHEN family_only THEN 0.45 WHEN both_estimates THEN 0.70 ELSE 0.85 END"""
_TEXT_VERDICT = """CASE WHEN same_text AND (attribute OR period_ok) THEN 'CORROBORATED' WHEN attribute AND identifiers AND similarity >= 0.88 THEN 'CONTEXTUALLY_EXPLAINED'
  WHEN attribute AND ((NOT identifiers AND similarity >= 0.3) OR family_only) THEN 'INSUFFICIENT_EVIDENCE' WHEN attribute THEN 'CONTRADICTION'
  WHEN same_text THEN 'CORROBORATED' WHEN NOT period_ok THEN 'CONTEXTUALLY_EXPLAINED' WHEN family_only THEN 'INSUFFICIENT_EVIDENCE' ELSE 'CONTRADICTION' END"""
_TEXT_FACTOR = """CASE WHEN same_text THEN NULL WHEN attribute AND identifiers AND similarity >= 0.88 THEN 'IDENTIFIER_REVISED'
  WHEN attribute AND NOT identifiers AND similarity >= 0.3 THEN 'PARTIAL_TEXT_MATCH' WHEN attribute AND family_only THEN 'FAMILY_MATCH_ONLY' WHEN attribute THEN 'ATTRIBUTE_CONFLICT'
  WHEN NOT period_ok THEN 'STATUS_CHANGED_OVER_TIME' WHEN family_only THEN 'FAMILY_MATCH_ONLY' ELSE 'STATUS_CONFLICT' END"""
_TEXT_CONFIDENCE = """CASE WHEN same_text AND equal_text AND attribute THEN 0.90 WHEN same_text AND attribute THEN 0.75 WHEN same_text AND period_ok THEN 0.90 WHEN same_text THEN 0.75
  WHEN attribute AND identifiers AND similarity >= 0.88 THEN 0.85 WHEN attribute AND NOT identifiers AND similarity >= 0.3 THEN 0.50 WHEN attribute AND family_only THEN 0.45
  WHEN attribute THEN 0.70 WHEN NOT period_ok THEN 0.88 WHEN family_only THEN 0.45 ELSE 0.80 END"""


def _verdicts(verdict: str, factor: str, confidence: str) -> str:
    return f"""{verdict} AS relationship_type, {factor} AS divergence_factor, round_even(({confidence})::DOUBLE * least(a_confidence, b_confidence) / 0.9::DOUBLE, 2) AS confidence,
  CASE WHEN family_only THEN 'family' ELSE 'exact' END AS match_basis, NOT same_document AS cross_document, sha256('rel|' || a_id || '|' || b_id) AS id"""


def _odd(q: str) -> str:
    return f"(contains(',' || a_qualifier_list || ',', ',{q},') <> contains(',' || b_qualifier_list || ',', ',{q},'))"


_SCALES = """WHEN 'crore' THEN 1e7 WHEN 'crores' THEN 1e7 WHEN 'cr' THEN 1e7 WHEN 'lakh' THEN 1e5 WHEN 'lakhs' THEN 1e5 WHEN 'million' THEN 1e6 WHEN 'millions' THEN 1e6
  WHEN 'mn' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'billions' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'b' THEN 1e9 WHEN 'trillion' THEN 1e12 WHEN 'tn' THEN 1e12
  WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3"""
_FIGURE = r"(\d[\d,]*)(?:\.(\d+))?\s*([A-Za-z]+)?"


def rounding(raw: str) -> str:
    return f"""CASE WHEN regexp_matches({raw}, '\\d') THEN 0.5::DOUBLE * pow(10::DOUBLE, -length(regexp_extract({raw}, '{_FIGURE}', 2)))
    * (CASE lower(regexp_extract({raw}, '{_FIGURE}', 3)) {_SCALES} ELSE 1 END)::DOUBLE ELSE 0 END"""


def _words(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}')), lambda w: w NOT IN ('the', 'and', 'of', 'at', 'in', 'on'))"


def token_similarity(a: str, b: str) -> str:
    return f"""CASE WHEN len({_words(a)}) = 0 OR len({_words(b)}) = 0 THEN (CASE WHEN lower(trim({a})) = lower(trim({b})) THEN 1 ELSE 0 END)::DOUBLE
    ELSE len(list_intersect({_words(a)}, {_words(b)}))::DOUBLE / len(list_distinct(list_concat({_words(a)}, {_words(b)}))) END"""


def _identifier(t: str) -> str:
    return f"(NOT regexp_matches({t}, '\\s') AND length({t}) >= 6 AND regexp_matches({t}, '\\p{{L}}') AND regexp_matches({t}, '\\p{{N}}'))"


_GROUP = "relationship_type, metric_canonical, a_period, entity_canonical, least(a_document_name, b_document_name), greatest(a_document_name, b_document_name)"
_NARROW = "('standalone', 'segment', 'industry')"
FACTS = f"WITH {FACTS_SQL}"
PAIRS = f"""{FACTS},
elig AS (SELECT *, coalesce(nullif(predicate_family, ''), metric_canonical) AS fam FROM facts WHERE confidence >= 0.6 AND (period <> 'unknown' OR starts_with(metric_canonical, 'attr.'))),
pairs AS (SELECT {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in _COLUMNS)}, a.document_name AS a_document_name, b.document_name AS b_document_name
  FROM elig a JOIN elig b ON a.entity_canonical = b.entity_canonical AND a.fam = b.fam AND a.normalized_unit = b.normalized_unit AND a.fact_seq < b.fact_seq)"""
JUDGED = f"""{PAIRS},
seen AS (SELECT *, lower(trim(a_raw_value)) AS a_text, lower(trim(b_raw_value)) AS b_text, a_metric_canonical <> b_metric_canonical AS family_only, a_document_id = b_document_id AS same_document,
  a_scope <> b_scope AND ((a_scope <> 'unspecified' AND b_scope <> 'unspecified') OR a_scope IN {_NARROW} OR b_scope IN {_NARROW}) AS scope_differs,
  a_accounting_standard <> b_accounting_standard AS basis_differs,
  coalesce(a_sub_metric <> b_sub_metric AND a_sub_metric NOT IN ('', 'unspecified') AND b_sub_metric NOT IN ('', 'unspecified') AND least(a_sub_metric, b_sub_metric) || greatest(a_sub_metric, b_sub_metric) <> 'operationstotal', FALSE) AS sub_metric_differs,
  {_odd('estimate')} AS estimate_differs, {_odd('partial_period')} AS partial_differs, {_odd('share_of')} AS share_differs, {_odd('exclusions_apply')} AS exclusions_differ,
  contains(a_qualifier_list, 'estimate') AND contains(b_qualifier_list, 'estimate') AS both_estimates,
  a_document_id = b_document_id AND a_page_number = b_page_number AND a_char_start = b_char_start AS same_sentence FROM pairs),
known AS (SELECT *, {_identifier('a_text')} AND {_identifier('b_text')} AS identifiers,
  NOT (scope_differs OR basis_differs OR sub_metric_differs OR estimate_differs OR partial_differs OR share_differs OR exclusions_differ) AS context_ok FROM seen),
dated AS (SELECT *, identifiers OR (a_period <> 'unknown' AND b_period <> 'unknown' AND a_period = b_period) AS period_ok FROM known),
measured AS (SELECT *, abs(a_normalized_numeric_value - b_normalized_numeric_value) AS delta, greatest(abs(a_normalized_numeric_value), abs(b_normalized_numeric_value)) AS top,
  greatest({rounding('a_raw_value')}, {rounding('b_raw_value')}) AS rounding FROM dated WHERE a_numeric_value IS NOT NULL AND b_numeric_value IS NOT NULL),
sized AS (SELECT *, CASE WHEN top = 0 THEN 0 ELSE delta * 100::DOUBLE / top END AS delta_pct FROM measured),
numbers AS (SELECT *, CASE WHEN a_normalized_unit = 'PERCENT' THEN delta <= greatest(0.05::DOUBLE, rounding) ELSE delta_pct <= 1.0 OR delta <= rounding END AS same_value FROM sized),
texts AS (SELECT *, starts_with(a_metric_canonical, 'attr.') AS attribute, a_text = b_text AS equal_text,
  CASE WHEN NOT identifiers THEN {token_similarity('a_text', 'b_text')} WHEN a_text = b_text THEN 1
    WHEN left(a_text, 3) = left(b_text, 3) THEN (length(a_text) - 1)::DOUBLE / length(a_text) ELSE (length(a_text) - 3)::DOUBLE / length(a_text) END AS similarity
  FROM dated WHERE a_numeric_value IS NULL OR b_numeric_value IS NULL),
alike AS (SELECT *, equal_text OR (NOT identifiers AND similarity >= 0.6) AS same_text FROM texts),
judged_numbers AS (SELECT *, {_verdicts(_NUMBER_VERDICT, _NUMBER_FACTOR, _NUMBER_CONFIDENCE)}, round_even(delta_pct, 2) AS delta_percentage, round_even(delta, 4) AS delta_absolute FROM numbers),
judged_texts AS (SELECT *, {_verdicts(_TEXT_VERDICT, _TEXT_FACTOR, _TEXT_CONFIDENCE)}, NULL::DOUBLE AS delta_percentage, NULL::DOUBLE AS delta_absolute FROM alike),
rels AS MATERIALIZED (SELECT id, a_id, b_id, a_document_id, b_document_id, relationship_type, divergence_factor, confidence, match_basis, cross_document, delta_percentage, delta_absolute, a_entity_canonical AS entity_canonical, a_metric_canonical AS metric_canonical FROM judged_numbers
  UNION ALL SELECT id, a_id, b_id, a_document_id, b_document_id, relationship_type, divergence_factor, confidence, match_basis, cross_document, delta_percentage, delta_absolute, a_entity_canonical, a_metric_canonical FROM judged_texts),
enriched AS (SELECT r.*, {', '.join(f'{s}.{c} AS {s}_{c}' for s in 'ab' for c in ('fact_seq', 'document_name', 'entity', 'metric', 'period', 'period_raw', 'raw_value', 'normalized_unit', 'exact_quote'))}, a.confidence AS a_confidence, b.confidence AS b_confidence
  FROM rels r JOIN facts a ON a.id = r.a_id JOIN facts b ON b.id = r.b_id),
scored AS (SELECT *, CASE WHEN relationship_type = 'CONTRADICTION' AND cross_document THEN 100 WHEN relationship_type = 'CONTRADICTION' THEN 55 WHEN relationship_type = 'INSUFFICIENT_EVIDENCE' AND cross_document THEN 45 WHEN relationship_type = 'INSUFFICIENT_EVIDENCE' THEN 35 END AS base FROM enriched),
severe AS (SELECT *, round_even(base::DOUBLE * confidence + CASE WHEN delta_percentage IS NOT NULL THEN least(25.0::DOUBLE, delta_percentage / 4) WHEN a_normalized_unit = 'TEXT' THEN 12 ELSE 0 END, 1) AS severity FROM scored WHERE base IS NOT NULL),
grouped AS (SELECT *, count(*) OVER (PARTITION BY {_GROUP}) - 1 AS also, row_number() OVER (PARTITION BY {_GROUP} ORDER BY severity DESC, a_fact_seq, b_fact_seq) AS rank_ FROM severe),
queue AS (SELECT * FROM grouped WHERE rank_ = 1),
linked AS MATERIALIZED (SELECT DISTINCT unnest([a_id, b_id]) AS id FROM rels)"""
