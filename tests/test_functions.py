import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave.functions import numbers, periods, texts
from factweave.operators import reasoning


def column(spark, build, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(build(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Rs. 150 Crore", 1.5e9), ("Rs. 1500 Mn", 1.5e9), ("₹8,142 Cr", 81_420_000_000.0), ("₹81,415Mn", 81_415_000_000.0), ("781 bps", 7.81), ("I 650.02 million", 650_020_000.0), ("$ 5", 5.0)],
)
def test_single_values(text, want):
    assert numbers.single_value(text)[1] == want


def test_values():
    assert numbers.single_value("1,429K tonnes")[3] == "TONNES"
    assert [v.normalized for v in numbers.values(numbers.prepared("FY23: ₹(452) Cr / (6.3%)"), [(0, 4)])] == [-4.52e9, -6.3]
    assert numbers.values("revenue as of Fiscal 2021 grew, see note 3") == []
    assert numbers.single_value("none") == (None, None, "", "TEXT") and numbers.single_value("7")[3] == "COUNT"
    assert [v.count_word for v in numbers.values("18,500 pin-codes and 99")] == ["pin codes"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("FY 2023-24", "FY2024"), ("FY24", "FY2024"), ("Fiscal 2021", "FY2021"), ("2024-25", "FY2025"), ("FY2024/25", "FY2025"), ("Q4 FY24", "FY2024-Q4"), ("Q2 of FY24", "FY2024-Q2"),
        ("Q3 of fiscal 2025", "FY2025-Q3"), ("as of March 31, 2024", "2024-03-31"), ("nine months period ended December 31, 2021", "9M-ended-2021-12-31"), ("in 2024", "CY2024"),
        ("first half of FY24", "FY2024-H1"), ("during March 2023", "2023-03"), ("year ended December 31, 2024", "FY2024"), ("second quarter of FY2024", "FY2024-Q2"),
    ],
)
def test_periods(text, want):
    assert [p.canonical for _, _, p in periods.periods(text)] == [want]


def test_period_edges():
    assert periods.periods("between 2015-2030") == [] and periods.single_period("").canonical == "unknown"
    assert periods.single_period("March 31, 2024", flow=True).canonical == "FY2024" and periods.single_period("March 31, 2024").canonical == "2024-03-31"


def test_numeric_columns(spark):
    assert column(spark, numbers.rounding_half_unit, "1.4 Mn", "1,429K", "8,142 Cr", "none") == [50_000.0, 500.0, 5_000_000.0, 0.0]
    assert column(spark, numbers.accounting_negatives, "₹(452) Cr", "(6.3%)", "(452 Cr)", None) == ["₹-452 Cr", "-6.3%", "-452 Cr", None]
    assert column(spark, numbers.to_double, "(1,000)", "2.5", "x", "(x)") == [-1000.0, 2.5, None, None]
    assert column(spark, numbers.scale_factor, "Crore", "k", "") == [1e7, 1e3, 1.0]


def test_text_columns(spark):
    assert column(spark, texts.entity_slug, "Northwind Limited", "NORTHWIND LIMITED", "", None, "The Co.") == ["northwind", "northwind", "unknown_entity", "unknown_entity", "unknown_entity"]
    assert column(spark, texts.person_slug, "Mr. Amit Rao") == ["amit_rao"] and column(spark, texts.metric_slug, "Some New Label!") == ["metric.some_new_label"]
    assert column(spark, texts.identifier_shaped, "INE040A01034", "Q4", "two words1") == [True, False, False]
    assert column(spark, periods.english_date, "March 31, 2024", "31/3/2024") == ["2024-03-31", None]
    one, other = "42 Bandra-Kurla Complex, Mumbai 400051", "42, Bandra Kurla Complex, Mumbai - 400051"
    assert spark.range(1).select(texts.token_similarity(F.lit(one), F.lit(other))).first()[0] > 0.6
    assert [texts.metric_key(x)[0] for x in ("Revenue from Operations", "Topline", "Adjusted EBITDA", "Odd thing")] == ["financial.revenue", "financial.revenue", "financial.ebitda", "metric.odd_thing"]


def test_identifier_similarity(spark):
    a, b = "U63090DL2011PLC221234", "L63090DL2011PLC221234"
    row = spark.range(1).select(reasoning.identifier_similarity(F.lit(a), F.lit(b)).alias("s"), reasoning.character_difference(F.lit(a), F.lit(b)).alias("d")).first()
    assert row.s == pytest.approx(20 / 21) and (row.d.differing, row.d.length) == (1, 21)


@given(st.integers(1000, 999_999), st.sampled_from(["crore", "lakh", "mn", "bn"]))
def test_values_scale_alike(n, scale):
    small, large = (numbers.single_value(f"Rs. {k} {scale}")[1] for k in (n, n * 10))
    assert large == pytest.approx(small * 10)


@given(st.text(max_size=80))
def test_tokenizers_take_any_text(text):
    for v in numbers.values(numbers.prepared(text)):
        assert 0 <= v.start < v.end
    spans = [(a, b) for a, b, _ in periods.periods(text)]
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
