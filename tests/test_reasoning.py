import itertools

import pytest

from factweave.operators import matching, reasoning
from factweave.schema import FACTS, flatten, nest, with_defaults

BASE = {
    "document_name": "d.pdf", "entity": "Acme", "entity_canonical": "acme", "metric": "Revenue", "metric_canonical": "financial.revenue", "predicate_family": "financial.revenue",
    "raw_value": "Rs. 150 Cr", "numeric_value": 150.0, "normalized_numeric_value": 1.5e9, "unit": "INR Cr", "normalized_unit": "INR", "period_raw": "FY24", "period_type": "fiscal_year",
    "period": "FY2024", "scope": "unspecified", "accounting_standard": "As reported", "qualifiers": [], "page_number": 1, "char_start": 0, "confidence": 0.9, "sub_metric": "total",
}
TEXT = {"numeric_value": None, "normalized_numeric_value": None, "normalized_unit": "TEXT", "unit": ""}


def facts(spark, *rows):
    full = [BASE | {"fact_seq": i, "id": f"f{i}", "document_id": f"d{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in FACTS.fieldNames()) for r in full], FACTS)


def verdict(spark, a, b):
    rows = reasoning.judge(facts(spark, a, b)).collect()
    return (rows[0].relationship_type, rows[0].divergence_factor) if rows else None


ID = TEXT | {"metric_canonical": "attr.cin", "predicate_family": "attr.cin", "period": "not_applicable"}
PAIRS = [
    ({}, {"raw_value": "Rs. 1500 Mn", "numeric_value": 1500.0}, ("CORROBORATED", None)),
    ({}, {"normalized_numeric_value": 1.2e9, "period": "FY2023"}, ("CONTEXTUALLY_EXPLAINED", "DIFFERENT_PERIODS")),
    ({}, {"normalized_numeric_value": 1.8e9, "accounting_standard": "Non-GAAP (adjusted)"}, ("CONTEXTUALLY_EXPLAINED", "SCOPE_OR_BASIS")),
    ({"normalized_unit": "PERCENT", "raw_value": "6.4%", "normalized_numeric_value": 6.4, "qualifiers": ["estimate"]}, {"normalized_unit": "PERCENT", "raw_value": "6.5%", "normalized_numeric_value": 6.5}, ("CONTEXTUALLY_EXPLAINED", "DATA_VINTAGE")),
    ({}, {"normalized_numeric_value": 1.7e9}, ("CONTRADICTION", "VALUE_CONFLICT")),
    ({}, {"normalized_unit": "USD"}, None),
    ({"normalized_unit": "TONNES", "raw_value": "1.4 Mn", "normalized_numeric_value": 1.4e6}, {"normalized_unit": "TONNES", "raw_value": "1,429K", "normalized_numeric_value": 1.429e6}, ("CORROBORATED", None)),
    ({}, {"normalized_numeric_value": 1.7e9, "document_id": "d0"}, ("INSUFFICIENT_EVIDENCE", "SAME_SENTENCE")),
    ({}, {"normalized_numeric_value": 1.7e9, "document_id": "d0", "char_start": 9}, ("INSUFFICIENT_EVIDENCE", "SAME_LABEL_DIFFERENT_SUBJECTS")),
    ({}, {"normalized_numeric_value": 1.7e9, "metric_canonical": "metric.sales"}, ("INSUFFICIENT_EVIDENCE", "FAMILY_MATCH_ONLY")),
    ({"sub_metric": "segment"}, {"normalized_numeric_value": 1.7e9}, ("CONTEXTUALLY_EXPLAINED", "SUB_METRIC_DIFFERENCE")),
    ({"sub_metric": "operations"}, {"normalized_numeric_value": 1.7e9}, ("CONTRADICTION", "VALUE_CONFLICT")),
    ({"qualifiers": ["share_of"]}, {"normalized_numeric_value": 1.7e9}, ("CONTEXTUALLY_EXPLAINED", "DIFFERENT_DEFINITION")),
    ({"qualifiers": ["exclusions_apply"]}, {"normalized_numeric_value": 1.7e9}, ("CONTEXTUALLY_EXPLAINED", "EXCLUSIONS_DIFFER")),
    ({"qualifiers": ["partial_period"]}, {"normalized_numeric_value": 1.7e9}, ("CONTEXTUALLY_EXPLAINED", "PARTIAL_PERIOD")),
    ({"qualifiers": ["estimate"]}, {"normalized_numeric_value": 1.7e9, "qualifiers": ["estimate"]}, ("CONTRADICTION", "COMPETING_ESTIMATES")),
    (TEXT | {"raw_value": "active", "period": "2022-05-14"}, TEXT | {"raw_value": "ceased", "period": "2023-09-27"}, ("CONTEXTUALLY_EXPLAINED", "STATUS_CHANGED_OVER_TIME")),
    (TEXT | {"raw_value": "active"}, TEXT | {"raw_value": "ceased"}, ("CONTRADICTION", "STATUS_CONFLICT")),
    (ID | {"raw_value": "U63090DL2011PLC221234"}, ID | {"raw_value": "L63090DL2011PLC221234"}, ("CONTEXTUALLY_EXPLAINED", "IDENTIFIER_REVISED")),
    (ID | {"raw_value": "INE040A01034"}, ID | {"raw_value": "XJ998877ZZQ1"}, ("CONTRADICTION", "ATTRIBUTE_CONFLICT")),
    (ID | {"raw_value": "GB123456789"}, ID | {"raw_value": "GB123456780"}, ("CONTEXTUALLY_EXPLAINED", "IDENTIFIER_REVISED")),
    (ID | {"raw_value": "INE040A01034"}, ID | {"raw_value": "ine040a01034"}, ("CORROBORATED", None)),
    (ID | {"raw_value": "12 Long Road, Big City, North"}, ID | {"raw_value": "99 Long Road, Small City, South"}, ("INSUFFICIENT_EVIDENCE", "PARTIAL_TEXT_MATCH")),
    (ID | {"raw_value": "one two", "metric_canonical": "attr.x"}, ID | {"raw_value": "six ten"}, ("INSUFFICIENT_EVIDENCE", "FAMILY_MATCH_ONLY")),
    ({"confidence": 0.5}, {}, None),
    ({"period": "unknown"}, {}, None),
]


@pytest.mark.parametrize(("a", "b", "want"), PAIRS)
def test_ladder(spark, a, b, want):
    assert verdict(spark, a, b) == want


def test_verdict_is_the_same_for_the_swapped_pair(spark):
    for a, b, want in PAIRS[:7]:
        assert verdict(spark, b, a) == want


def test_confidence_and_basis(spark):
    exact, family = ({}, {}), ({}, {"metric_canonical": "metric.sales"})
    rows = [reasoning.judge(facts(spark, *p)).first() for p in (exact, family)]
    assert [(r.match_basis, r.confidence) for r in rows] == [("exact", 0.95), ("family", 0.8)]


def test_checks(spark):
    pairs = matching.bucket_pairs(facts(spark, {}, {"period": "FY2023", "normalized_numeric_value": 1.2e9}))
    steps = reasoning.checks(reasoning.judge_numbers(pairs)).first().checks
    assert [(s.step_number, s.name, s.passed) for s in steps] == [(1, "Entity", True), (2, "Metric", True), (3, "Period", False), (4, "Context", True), (5, "Value", False)]


def test_delta_and_old_pairs_are_all_pairs(spark):
    table = facts(spark, *[{"normalized_numeric_value": 1e9 + i} for i in range(7)])
    ids = lambda df: {tuple(sorted((r.a_id, r.b_id))) for r in df.collect()}
    new, old = table.where("fact_seq % 3 = 0"), table.where("fact_seq % 3 <> 0")
    assert ids(matching.delta_pairs(new, old)) | ids(matching.bucket_pairs(old)) == ids(matching.bucket_pairs(table)) and len(ids(matching.bucket_pairs(table))) == 21


def test_partitions_do_not_change_results(spark):
    table = facts(spark, *[{"normalized_numeric_value": 1e9 + i, "period": f"FY{2020 + i % 3}"} for i in range(9)])
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(reasoning.judge(table.repartition(int(n))).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_nested_form_and_defaults(spark):
    table = facts(spark, {}, {})
    assert flatten(nest(table)).collect() == table.collect()
    old = with_defaults(table.drop("predicate_family", "period_source", "predicate_family_confidence")).first()
    assert (old.predicate_family, old.predicate_family_confidence, old.period_source) == (None, 0.0, "quote")


def test_pairs_read_what_was_worked_out_once_a_fact(spark):
    """the text plan has one reading of words a fact, below the join, and none above it; verdicts are those of pairs that read both sides."""
    texts = ["SKU123456", "SKU123457", "alpha beta", "beta alpha", "the of", "the of", None, "gamma"]
    table = facts(spark, *[{"numeric_value": None, "normalized_numeric_value": None, "normalized_unit": "TEXT", "raw_value": t, "metric_canonical": "attr.name", "document_id": f"d{i}"} for i, t in enumerate(texts)])
    columns = ("a_id", "b_id", "relationship_type", "divergence_factor", "confidence")
    want = reasoning.judge_texts(matching.bucket_pairs(table)).select(*columns).collect()
    got = reasoning.judge(table).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == len(texts) * (len(texts) - 1) // 2
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    reads = [i for i, line in enumerate(lines) if "regexp_extract_all" in line]
    for i in reads:
        below = itertools.takewhile(lambda line: depth(line) > depth(lines[i]), lines[i + 1 :])  # noqa: B023
        assert not any("Join Inner" in line for line in below)
    assert reads
