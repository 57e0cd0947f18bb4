import json

import pytest
from pyspark.sql import functions as F

from factweave.operators import context, extract, families, layout
from factweave.operators import sentences as S
from factweave.sources import llm, tables


def page_table(spark, pages, entity="Acme Limited", hint=None, period=None, country=None, date="2024-03-31"):
    rows = [("d", "d.pdf", i + 1, t, hint, [], entity, country, date, period) for i, t in enumerate(pages)]
    return spark.createDataFrame(rows, "document_id string, document_name string, page_number int, text string, period_hint string, tiles array<struct<value_text:string,label_text:string,bbox:array<double>,start:int,end:int>>, primary_entity string, subject_country string, document_date string, document_period string")


def facts(spark, *pages, **rest):
    docs = spark.createDataFrame([("d", 0)], "document_id string, document_seq long")
    return extract.extract(page_table(spark, pages, **rest), docs).orderBy("fact_seq").collect()


def test_sentences():
    text = "Mr. Rao of Acme Ltd. said so. Revenue rose 5.5% to Rs. 10 Cr.\nA new line here"
    spans = S.sentences(text)
    assert [s for s, _, _ in spans] == ["Mr. Rao of Acme Ltd. said so.", "Revenue rose 5.5% to Rs. 10 Cr.", "A new line here"]
    assert all(text[a:b] == s for s, a, b in spans)


def test_comparison_sentence(spark):
    rows = facts(spark, "FY24 EBITDA increased by ₹578 Cr to ₹127 Cr from ₹(452) Cr in FY23.")
    got = {(r.metric_canonical, r.normalized_numeric_value, r.period) for r in rows}
    assert {("financial.ebitda", 1.27e9, "FY2024"), ("financial.ebitda", -4.52e9, "FY2023"), ("financial.ebitda.change", 5.78e9, "FY2024")} <= got


def test_elided_scale(spark):
    rows = facts(spark, "Net loss reduced from ₹(10,077.79) million in FY23 to ₹(2,491.86) in FY24.")
    assert {r.period: r.normalized_numeric_value for r in rows}["FY2024"] == -2_491_860_000.0


def test_two_levels_take_their_own_periods(spark):
    rows = facts(spark, "Revenue from operations was ₹81,415 Mn for FY24 as against ₹72,253 Mn for FY23.")
    assert {(r.normalized_numeric_value, r.period, r.confidence) for r in rows} == {(81_415e6, "FY2024", 0.9), (72_253e6, "FY2023", 0.9)}


def test_running_header_lowers_confidence(spark):
    (r,) = facts(spark, "ECONOMIC REVIEW headline inflation during 2024-25 as compared with 61 per cent a year ago.", country="India")
    assert r.confidence < 0.6 and "header" in r.notes and r.entity_canonical == "india"


@pytest.mark.parametrize(
    ("text", "value", "partial"),
    [("Retail inflation moderated from 5.4 per cent in FY24 to 4.9 per cent in FY25 (April-December).", 4.9, True), ("Revenue was 250 million in FY23 while Rs. 250 million, and the company turned profitable in Q3 FY24.", 250e6, False)],
)
def test_partial_windows(spark, text, value, partial):
    rows = [r for r in facts(spark, text) if r.normalized_numeric_value == value]
    assert rows and all(("partial_period" in r.qualifiers) == partial for r in rows if r.period_type == "fiscal_year")


def test_share_basis_and_sign(spark):
    share, adjusted = facts(spark, "The share of net profit was ₹86.95 million in FY24.\nAdjusted EBITDA was a loss of ₹5 crore in FY24.")
    assert "share_of" in share.qualifiers and adjusted.accounting_standard == "Non-GAAP (adjusted)" and adjusted.normalized_numeric_value == -5e7


def test_attributes(spark):
    rows = facts(spark, "Registered Office: 42 Example Street, Example City\nCIN: U63090DL2011PLC221234\nDate: 5 May 2020")
    by = {r.metric_canonical: r for r in rows}
    assert by["attr.registered_office"].raw_value == "42 Example Street, Example City" and by["attr.corporate_identity_number_cin"].period == "not_applicable"
    assert by["attr.corporate_identity_number_cin"].raw_value == "U63090DL2011PLC221234" and "attr.date" not in by


def test_governance(spark):
    rows = facts(spark, "Mr. Amit Rao resigned from the board with effect from May 14, 2022.\nAppointment of Ms. Asha Verma as a member with effect from June 1, 2023.\nAsha Verma is a Nominee Director of our Company.")
    assert {(r.entity_canonical, r.raw_value, r.period) for r in rows if r.metric_canonical == "governance.board_status"} == {("amit_rao", "ceased", "2022-05-14"), ("asha_verma", "appointed", "2023-06-01"), ("asha_verma", "active", "2024-03-31")}


def test_tables_print_figures_back(spark):
    rows = [r for r in facts(spark, "in €m FY2023 FY2024\nRevenue 1,040 2,345\nComments\nRevenue 9 9") if r.extraction_method == "rule_table"]
    assert [(r.raw_value, r.normalized_numeric_value, r.period) for r in rows] == [("€1,040 million", 1.04e9, "FY2023"), ("€2,345 million", 2.345e9, "FY2024")]


def test_open_schema_and_duplicates(spark):
    text = "Warehouse space was 1,200 units in FY24."
    one, = facts(spark, text, text, "Other words without figures.")
    assert one.metric_canonical == "metric.warehouse_space_units" and one.confidence == 0.7 and one.notes.endswith("Also stated on p.2.")


def test_empty_and_null_pages(spark):
    assert facts(spark, "", None) == []
    docs = spark.createDataFrame([], "document_id string, document_seq long")
    assert extract.extract(page_table(spark, []), docs).count() == 0


def test_context(spark):
    pages = [("a", 1, "Contents\nReserve Bank of India\nEconomic Survey 2023-24"), ("a", 2, "Zed Corporation said. Zed Corporation works."), ("b", 1, "Contents"), *[("b", i, "said Acme Institute and Acme Institute") for i in range(2, 5)], ("c", 1, "x")]
    table = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    docs = spark.createDataFrame([(d, f"01-{d}-file.pdf", 3, a) for d, a in (("a", None), ("b", None), ("c", "Unijoin"))], "id string, original_name string, page_count int, pdf_author string")
    got = {r.document_id: r for r in context.resolve(docs, table).collect()}
    assert [got[d].primary_entity for d in "abc"] == ["Reserve Bank of India", "Acme Institute", "Unijoin"]
    assert got["a"].document_kind == "macro_report" and got["b"].document_date is None


def test_layout(spark):
    blocks = [("d", 1, 600.0, 0, 20.0, 100.0, 200.0, 120.0, 0, "double-\ndeck • and"), ("d", 1, 600.0, 1, 20.0, 140.0, 200.0, 160.0, 0, "goes on. I 65.2 million\n7"), ("d", 1, 600.0, 2, 320.0, 90.0, 500.0, 95.0, 0, "Right side."), ("d", 1, 600.0, 3, 0.0, 0.0, 1.0, 1.0, 1, "image")]
    table = spark.createDataFrame(blocks, "document_id string, page_number int, page_width double, block_ix int, x0 double, y0 double, x1 double, y1 double, block_type int, text string")
    (page,) = layout.pages(table).collect()
    assert page.text == "doubledeck • and goes on. ₹65.2 million\nRight side." and page.token_estimate == 9 and page.tiles == []
    assert layout.is_value_only("₹127Cr / 1.6%") and not layout.is_value_only("1,234") and layout.is_label("EBITDA margin") and not layout.is_label("As at March 31")


def test_families(spark):
    bad = ['{"families": "x"}', '{"families": [3, {"family_id": "f", "members": 5}]}', "no json", None]
    good = json.dumps({"families": [{"family_id": "sales", "members": [{"raw": "Sales", "confidence": 0.88}, {"raw": "Turnover", "confidence": 0.2}, {"raw": "Sales change", "confidence": 0.9}, 7]}]})
    payload = spark.createDataFrame([(x,) for x in [*bad, good]], "payload string")
    parsed = families.parse(payload)
    assert {(r.raw, r.family, r.confidence) for r in parsed.collect()} == {("Sales", "sales", 0.88), ("Sales change", "sales", 0.9)}
    rows = spark.createDataFrame([("Sales", "m.s", "", 0.0), ("Sales change", "m.s.change", "", 0.0), ("Other", "m.o", "", 0.0)], "metric string, metric_canonical string, predicate_family string, predicate_family_confidence double")
    assert {(r.metric, r.predicate_family, r.predicate_family_confidence) for r in families.assign(rows, parsed).collect()} == {("Sales", "sales", 0.88), ("Sales change", "sales.change", 0.9), ("Other", "m.o", 1.0)}

    def down(_):
        raise llm.Unavailable

    assert {r.predicate_family for r in families.group(spark, rows, down).collect()} == {"m.s", "m.s.change", "m.o"}
    assert {r.predicate_family for r in families.group(spark, rows, lambda names: good).collect()} == {"sales", "sales.change", "m.o"}


def test_settings_and_cache(spark, tmp_path):
    (tmp_path / ".env").write_text("# no\nFACTWEAVE_KEY='abc'\nFACTWEAVE_MODE=full\nbad line\n")
    assert llm.settings(str(tmp_path / ".env"), environment={}).enabled and not llm.settings(str(tmp_path / "none"), environment={}).enabled
    assert llm.settings(str(tmp_path / ".env"), environment={"FACTWEAVE_MODE": "odd"}).mode == "off"
    calls = []
    for _ in range(2):
        assert llm.json_call(spark, str(tmp_path / "cache"), lambda p: calls.append(p) or '{"a": 1}', "prompt") == '{"a": 1}'
    assert len(calls) == 1
    with pytest.raises(llm.Unavailable):
        llm.json_call(spark, str(tmp_path / "cache"), lambda p: "[1]", "other")


def test_files_and_presets(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "b.pdf").write_bytes(b"text b")
    (tmp_path / "one" / "a.pdf").write_bytes(b"\xff")
    assert tables.presets(spark, str(tmp_path)).collect() == [("one", ["a.pdf", "b.pdf"])]
    decode = lambda data, name: [{"page_number": 1, "page_width": 1.0, "block_ix": 0, "block_type": 0, "text": data.decode()}]
    got = {(r.document_id, r.block_type, r.text) for r in tables.read_files(spark, str(tmp_path), decode).collect()}
    assert {x[:2] for x in got} == {("b.pdf", 0), ("a.pdf", -1)} and ("b.pdf", 0, "text b") in got
    assert tables.file_info(spark, str(tmp_path)).count() == 2 and tables.accepted(spark.createDataFrame([("x.PDF",), ("y.txt",)], "name string")).count() == 1


def test_snapshot_that_is_not_there_is_empty(spark, tmp_path):
    a, b = tables.read_snapshot(spark, str(tmp_path / "none"), "id string")
    assert a.count() == 0 and b.count() == 0


def test_csv_lines(spark):
    rows = spark.createDataFrame([(1, *['a"b'] * 14)], "fact_seq long, " + ", ".join(f"{c} string" for c in tables.CSV_COLUMNS))
    assert tables.csv_lines(rows).first().line.startswith('"a""b","a""b"') and tables.csv_lines(rows.withColumn("entity", F.lit(None))).count() == 1


@pytest.mark.parametrize(
    ("row", "want"),
    [("EBITDA 1,200 12.5% 1,300", [1.2e10, 1.3e10]), ("EBITDA 12.5 % 1,200 7%", [1.2e10]), ("EBITDA 1,200 -3% +1,300.5", [1.2e10, 1.3005e10]), ("EBITDA 5%", [])],
)
def test_percentages_are_no_figures_of_a_table(spark, row, want):
    rows = [r for r in facts(spark, f"in Rs. crore FY2023 FY2024\n{row}") if r.extraction_method == "rule_table"]
    assert [r.normalized_numeric_value for r in rows] == want


def test_fact_numbers_have_no_bounds(spark):
    rows = [(f"d{d}", p, 0, o) for d, p, o in ((0, 1, 0), (1, 100_001, 0), (1, 100_001, 100_000), (1, 7, 3), (2, 1, 0), (3, 1, 0))]
    names = [c for c in extract.FACTS.fieldNames() if c not in ("document_id", "page_number")]
    table = spark.createDataFrame(rows, "document_id string, page_number int, stage int, ordinal int").selectExpr("*", *[f"cast(null as string) as {c}" for c in names])
    docs = spark.createDataFrame([("d0", 5), ("d1", 2_000_000), ("d2", 2_000_000), ("d3", 10**12)], "document_id string, document_seq long")
    got = extract.number_facts(table, docs, 40).orderBy("fact_seq").select("fact_seq", "document_id", "page_number").collect()
    assert [tuple(r) for r in got] == [(40, "d0", 1), (41, "d1", 7), (42, "d1", 100_001), (43, "d1", 100_001), (44, "d2", 1), (45, "d3", 1)]


def test_decoders_in_turn_and_what_files_tell_of_themselves(spark, tmp_path):
    for name, data in (("a.pdf", b"A"), ("b.pdf", b"B"), ("c.pdf", b"C"), ("d.pdf", b"D")):
        (tmp_path / name).write_bytes(data)

    def first(data, name):
        if data != b"A":
            raise ValueError("not A")
        return [{"title": "  On A ", "author": ""}, {"page_number": 1, "block_ix": 0, "block_type": 0, "text": "by the first", "author": "Jane Doe"}]

    def second(data, name):
        if data == b"C":
            raise ValueError("not C")
        return [{"page_number": 1, "block_ix": 0, "block_type": 0, "text": "by the second"}] if data == b"B" else []

    got = sorted((r.document_id, r.block_type, r.text) for r in tables.read_files(spark, str(tmp_path), first, second).collect())
    assert got == [("a.pdf", 0, "by the first"), ("b.pdf", 0, "by the second"), ("c.pdf", -1, "not C")]
    info = sorted(tuple(r) for r in tables.read_info(spark, str(tmp_path), first, second).collect())
    assert info == [("a.pdf", 0, "On A", "Jane Doe", None), ("b.pdf", 1, None, None, None), ("c.pdf", -1, None, None, "not C"), ("d.pdf", 1, None, None, None)]


def test_abbreviations_in_long_lines():
    text = "x" * 5000 + " Mr. Rao met Dr. Sen. " + "y " * 3000 + "end. Another one follows here."
    assert [s[-20:] for s, _, _ in S.sentences(text)][-1].endswith("follows here.") and len(S.sentences(text)) == 2


def test_pages_of_one_file_are_read_in_many_tasks(spark):
    pages = spark.range(40, numPartitions=1).selectExpr(
        "concat('p', id) AS document_id", "'a.pdf' AS document_name", "1 AS page_number", "'Revenue was Rs. 5 crore in FY24.' AS text", "cast(null AS string) AS period_hint",
        "cast(null AS array<struct<value_text:string,label_text:string,bbox:array<double>,start:int,end:int>>) AS tiles", "'Acme Limited' AS primary_entity",
        "cast(null AS string) AS subject_country", "cast(null AS string) AS document_date", "cast(null AS string) AS document_period",
    )
    read = extract.read(pages)
    tasks = read.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in tasks) == 40


def test_sentences_are_counted_without_their_texts(spark):
    """Only the count comes back from Python, and it is that of the spans; nulls and empty texts have none."""
    rows = [(i, t) for i, t in enumerate(["Costs of labour rose to 5.5 crore. Mr. Smith of No. 7 agreed.\nShort.", None, "", "Ünïcode sentences are counted 😀 too. Another one follows here!", "x" * 40])]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    both = docs.select(layout.sentence_count(F.col("text")).alias("n"), layout.sentence_spans(F.col("text")).alias("spans"), "text").collect()
    assert [r.n for r in both] == [len(r.spans) for r in both] == [2, 0, 0, 2, 1]
    assert all(r.text[s.start : s.end] == s.text for r in both for s in r.spans)
    from factweave.plans import document_queries

    plan = document_queries.sentence_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sentence_spans" not in plan and "sentence_count(" in plan
