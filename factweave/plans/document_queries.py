"""Queries of the operators on documents: reports templated from the star schema, whose facts SQL can foretell."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import numbers, periods, texts
from factweave.operators import context, extract, families, layout
from factweave.operators import sentences as S
from factweave.plans import claims, claims_sql, oracle
from factweave.plans.queries import query
from factweave.sources import scratch, tables

# One report for each nation and fiscal year of the ledger; v is its revenue in hundredths of a crore.
_SALES = f"""ledger AS (SELECT cast(c_nationkey as bigint) AS k, cast({claims_sql.FY.format('o_orderdate')} as bigint) AS fy, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) AS cents, cast(count(*) as bigint) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
sales AS (SELECT k, fy, n + 100 AS n, cast(round(cents / 10000000.0) as bigint) AS v, 'r' || cast(k as string) || '-' || cast(fy as string) AS document_id FROM ledger)"""
_CRORE = "cast(cast(floor(v / 100) as bigint) as string) || '.' || lpad(cast(v % 100 as string), 2, '0')"
_TEXT = f"""'Annual Report of Example Industries' || chr(10)
 || 'Registered Office: ' || cast(n as string) || ' Example Street, City ' || cast(k as string) || chr(10)
 || 'Revenue from operations was Rs. ' || {_CRORE} || ' crore in FY' || cast(fy as string) || '. Warehouse space was ' || cast(n as string) || ' units in FY' || cast(fy as string) || '.' || chr(10)
 || 'Ms. Asha Verma resigned as a member with effect from March 31, ' || cast(fy as string) || '.' || chr(10)
 || 'Figures in Rs crore FY' || cast(fy - 1 as string) || ' FY' || cast(fy as string) || chr(10) || 'EBITDA 1,0' || lpad(cast(n % 100 as string), 2, '0') || ' 2,0' || lpad(cast(k as string), 2, '0')"""


def sales(spark: SparkSession, sf: str) -> DataFrame:
    names = ("orders", "customer")
    prefix = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in names)
    return spark.sql(f"WITH {prefix}, {_SALES} SELECT *, {_TEXT} AS text FROM sales", **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in names})


def _none(kind: str) -> F.Column:
    return F.lit(None).cast(kind)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = sales(spark, sf)
    tile = F.array(F.struct(F.concat(F.lit("₹"), F.col("n").cast("string"), F.lit(" Cr")).alias("value_text"), F.lit("Total income / FY24").alias("label_text"), F.array(F.lit(0.0)).alias("bbox"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    return rows.select(
        "document_id", F.col("document_id").alias("document_name"), F.lit(1).alias("page_number"), "text", F.lit("FY2024").alias("period_hint"), tile.alias("tiles"),
        F.lit("Example Industries Limited").alias("primary_entity"), _none("string").alias("subject_country"), F.concat(F.col("fy").cast("string"), F.lit("-03-31")).alias("document_date"), _none("string").alias("document_period"),
    )


def _built(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return extract.build(extract.read(_pages(spark, sf))).where(F.col("extraction_method") == method)


_FACT = "SELECT document_id, {metric} AS metric_canonical, {raw} AS raw_value, {value}::DOUBLE AS normalized_numeric_value, {unit} AS normalized_unit, {period} AS period, {confidence}::DOUBLE AS confidence FROM sales"
_SHOWN = ("document_id", "metric_canonical", "raw_value", "normalized_numeric_value", "normalized_unit", "period", "confidence")


def _fact(metric: str, raw: str, value: str, unit: str, period: str, confidence: float) -> str:
    return _FACT.format(metric=f"'{metric}'", raw=raw, value=value, unit=f"'{unit}'", period=period, confidence=confidence)


_BY = {
    "rule_sentence": _fact("financial.revenue", f"'Rs. ' || {_CRORE} || ' crore'", "v * 100000", "INR", "'FY' || fy", 0.9),
    "rule_open_schema": _fact("metric.warehouse_space_units", "n || ' units'", "n", "COUNT", "'FY' || fy", 0.68),
    "rule_attribute": _fact("attr.registered_office", "n || ' Example Street, City ' || k", "NULL", "TEXT", "fy || '-03-31'", 0.7),
    "rule_tile": _fact("financial.total_income", "'₹' || n || ' Cr'", "n * 10000000", "INR", "'FY2024'", 0.85),
    "rule_governance": _fact("governance.board_status", "'ceased'", "NULL", "TEXT", "fy || '-03-31'", 0.88),
    "rule_table": _fact("financial.ebitda", "'₹1,0' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') || ' crore'", "(1000 + n % 100) * 10000000", "INR", "'FY' || (fy - 1)", 0.9)
    + " UNION ALL " + _fact("financial.ebitda", "'₹2,0' || lpad(CAST(k AS VARCHAR), 2, '0') || ' crore'", "(2000 + k) * 10000000", "INR", "'FY' || fy", 0.9),
}


def _reader(name: str, method: str, doc: str) -> None:
    def run(spark, sf):
        return _built(spark, sf, method).select(*_SHOWN)

    run.__name__, run.__doc__ = name, doc
    query(f"WITH {_SALES} {_BY[method]}")(run)


_reader("facts_from_sentences", "rule_sentence", "X1, X7.")
_reader("open_schema_facts", "rule_open_schema", "X2, J6.")
_reader("attribute_lines", "rule_attribute", "X3.")
_reader("tile_facts", "rule_tile", "X4.")
_reader("governance_events", "rule_governance", "X5.")
_reader("table_facts", "rule_table", "X6, J14.")


@query(f"WITH {_SALES}, every AS ({' UNION ALL '.join(_BY.values())}) SELECT document_id, count(*) AS facts, CAST(round_even(sum(confidence), 2) AS DOUBLE) AS confidence FROM every GROUP BY ALL")
def extract_documents(spark, sf):
    """X1-X8 in one go: facts of each report, numbered and without duplicates."""
    pages = _pages(spark, sf)
    docs = pages.select("document_id", F.pmod(F.xxhash64("document_id"), F.lit(1_000_000)).alias("document_seq"))
    return extract.extract(pages, docs).groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.bround(F.sum("confidence"), 2).alias("confidence"))


_STATED = f"WITH {_SALES}, stated AS (SELECT k, fy, unnest(range(1, 2 + CAST(fy % 3 AS BIGINT))) AS page FROM sales)"


@query(f"{_STATED} SELECT k, fy, count(*) AS stated, round_even(least(0.98::DOUBLE, 0.9::DOUBLE + 0.02 * (count(*) - 1)), 2) AS confidence, CASE WHEN count(*) > 1 THEN string_agg('Also stated on p.' || page || '.', ' ' ORDER BY page) FILTER (page > 1) END AS notes FROM stated GROUP BY ALL")
def fact_dedupe(spark, sf):
    """A claim that one to three pages of a report state."""
    rows = sales(spark, sf).select("document_id", "k", "fy", F.explode(F.sequence(F.lit(1), (F.col("fy") % 3 + 1).cast("int"))).alias("page_number"), "v")
    facts = rows.select(
        "document_id", F.lit("m").alias("metric_canonical"), F.lit("e").alias("entity_canonical"), F.col("v").cast("double").alias("normalized_numeric_value"), F.lit("x").alias("raw_value"), F.lit("INR").alias("normalized_unit"),
        F.lit("FY").alias("period"), F.lit("s").alias("scope"), F.lit("b").alias("accounting_standard"), "page_number", F.lit(0).alias("stage"), F.lit(0).alias("ordinal"), F.lit(0.9).alias("confidence"), _none("string").alias("notes"), "k", "fy",
    )
    return extract.dedupe(facts).select("k", "fy", (F.col("fy") % 3 + 1).alias("stated"), "confidence", "notes")


_DOUBT = """CASE fy % 5 WHEN 0 THEN 'Revenue was Rs. 5 crore.' WHEN 1 THEN 'Revenue was Rs. 512 in FY2001.' WHEN 2 THEN 'Revenue of the sector was Rs. 5 crore in FY2001.' WHEN 3 THEN 'Revenue grew by Rs. 5 crore.' ELSE 'Revenue was above Rs. 5 crore in FY2001.' END"""


@query(f"WITH {_SALES} SELECT document_id, (CASE fy % 5 WHEN 0 THEN 0.55 WHEN 1 THEN 0.6 WHEN 2 THEN 0.2 WHEN 3 THEN 0.2 ELSE 0.65 END)::DOUBLE AS confidence FROM sales")
def fact_confidence(spark, sf):
    """The confidence model: no period, no scale, an industry's figure, a change, a threshold."""
    pages = _pages(spark, sf).drop("text").join(sales(spark, sf).select("document_id", F.expr(_DOUBT).alias("text")), "document_id").withColumn("tiles", F.slice("tiles", 1, 0))
    facts = extract.build(extract.read(pages)).where("extraction_method = 'rule_sentence'")
    return facts.select("document_id", "confidence")


# Tokenizers


def _arrow(fn, kind: str):
    @F.pandas_udf(kind)
    def run(text):
        return text.map(fn)

    return run


@query(f"WITH {_SALES} SELECT document_id, {_CRORE} || ' crore;' || n || ' units' AS found FROM sales")
def value_tokens(spark, sf):
    """Values of a sentence, its period masked."""
    def found(t: str) -> str:
        masked = [(a, b) for a, b, _ in periods.periods(t)]
        return ";".join(v.raw for v in numbers.values(t, masked))

    text = F.expr(f"{_CRORE} || ' crore in FY' || fy || ' on ' || n || ' units'")
    return sales(spark, sf).select("document_id", _arrow(found, "string")(text).alias("found"))


@query(f"WITH {_SALES} SELECT document_id, 'FY' || fy || '-Q2;' || CASE WHEN fy >= 2001 THEN 'FY' || fy || ';' ELSE '' END || fy || '-03-31' AS found FROM sales")
def period_tokens(spark, sf):
    """Quarters and days of any year, ranges that begin in 20xx."""
    text = F.expr("'in Q2 of FY' || fy || ' and ' || (fy - 1) || '-' || lpad(cast(fy % 100 as string), 2, '0') || ' until March 31, ' || fy")
    return sales(spark, sf).select("document_id", F.array_join(F.transform(periods.found(text), lambda p: p["canonical"]), ";").alias("found"))


#: A text in each form that a period has (g: a year, gg: its last two digits), and what it says: type, period, first and last day. The last one says none.
_PERIOD_FORMS = (
    ("'nine months ended December 31, ' || g", "'date_range'", "'9M-ended-' || g || '-12-31'", "NULL", "g || '-12-31'"),
    ("'the financial year ended March 31, ' || g", "'fiscal_year'", "'FY' || g", "NULL", "g || '-03-31'"),
    ("'the first half of FY' || g", "'date_range'", "'FY' || g || '-H1'", "NULL", "NULL"),
    ("'in H2 FY' || gg", "'date_range'", "'FY' || g || '-H2'", "NULL", "NULL"),
    ("'Q3 of FY' || gg", "'quarter'", "'FY' || g || '-Q3'", "NULL", "NULL"),
    ("g || 'Q1 figures'", "'quarter'", "'FY' || g || '-Q1'", "NULL", "NULL"),
    ("'second quarter of fiscal ' || g", "'quarter'", "'FY' || g || '-Q2'", "NULL", "NULL"),
    ("'FY' || (g - 1) || '-' || gg", "'fiscal_year'", "'FY' || g", "(g - 1) || '-04-01'", "g || '-03-31'"),
    ("'growth in FY' || gg", "'fiscal_year'", "'FY' || g", "(g - 1) || '-04-01'", "g || '-03-31'"),
    ("'fiscal year ' || g", "'fiscal_year'", "'FY' || g", "(g - 1) || '-04-01'", "g || '-03-31'"),
    ("g || ' fiscal year'", "'fiscal_year'", "'FY' || g", "(g - 1) || '-04-01'", "g || '-03-31'"),
    ("(g - 1) || '-' || gg || ' (RE)'", "'fiscal_year'", "'FY' || g", "(g - 1) || '-04-01'", "g || '-03-31'"),
    ("'as of June 30, ' || g", "'point_in_time'", "g || '-06-30'", "g || '-06-30'", "g || '-06-30'"),
    ("'in June ' || g", "'point_in_time'", "g || '-06'", "NULL", "NULL"),
    ("'calendar year ' || g", "'fiscal_year'", "'CY' || g", "g || '-01-01'", "g || '-12-31'"),
    ("'between ' || g || '-' || (g + 15)", "NULL", "NULL", "NULL", "NULL"),
)


def _by_form(column: int) -> str:
    return "CASE form " + " ".join(f"WHEN {i} THEN {f[column]}" for i, f in enumerate(_PERIOD_FORMS)) + " END"


@query(f"""WITH {_SALES}, years AS (SELECT document_id, 2010 + fy % 50 AS g, CAST(10 + fy % 50 AS VARCHAR) AS gg, unnest(range({len(_PERIOD_FORMS) - 1})) AS form FROM sales)
SELECT document_id, CAST(form AS INT) AS form, {_by_form(1)} AS period_type, {_by_form(2)} AS canonical, coalesce({_by_form(3)}, '') AS start_date, coalesce({_by_form(4)}, '') AS end_date FROM years""")
def period_forms(spark, sf):
    """D1, D1a-i, D3: every form of a period in a sentence of each report, found by SQL functions; a range of more than a year is none."""
    years = sales(spark, sf).selectExpr("document_id", "2010 + fy % 50 AS g", "cast(10 + fy % 50 AS string) AS gg", f"explode(sequence(0, {len(_PERIOD_FORMS) - 1})) AS form")
    found = years.select("document_id", "form", F.explode(periods.found(F.concat(F.lit("Up by a third, "), F.expr(_by_form(0)), F.lit(".")))).alias("p"))
    return found.select("document_id", "form", "p.period_type", "p.canonical", *[F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c) for c in ("start_date", "end_date")])


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'financial.ebitda_margin' WHEN 1 THEN 'financial.revenue;financial.net_income' ELSE '' END AS found FROM part")
def metric_mentions(spark, sf):
    """Longer names first."""
    text = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'adjusted ebitda margin' WHEN 1 THEN 'revenue and net profit' ELSE 'patent costs' END")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", _arrow(lambda t: ";".join(m.metric.canonical for m in texts.mentions(t)), "string")(text).alias("found"))


@query("SELECT p_partkey, 'Costs of ' || p_name || ' rose to 5.5 crore.|Mr. Smith of No. 7 agreed.' AS found FROM part")
def sentence_split(spark, sf):
    """Abbreviations and decimals end no sentence."""
    text = F.concat(F.lit("Costs of "), "p_name", F.lit(" rose to 5.5 crore. Mr. Smith of No. 7 agreed. Short.\n"))
    spans = layout.sentence_spans(text)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(F.transform(spans, lambda s: s["text"]), "|").alias("found"))


@query()
def sentence_counts(spark, sf):
    """P6 over all documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", layout.sentence_count(F.col("text")).alias("sentences"))


@query("SELECT doc_id, CAST(length(text) AS INT) AS char_count, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS INT) AS token_estimate FROM documents")
def page_stats(spark, sf):
    """P12."""
    return layout.with_stats(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "char_count", "token_estimate")


@query(f"WITH {_SALES} SELECT document_id, CASE WHEN fy % 2 = 0 THEN 'financial.revenue' ELSE 'financial.ebitda' END AS owner FROM sales")
def value_owner_nearest(spark, sf):
    """The metric in front of a value owns it, or the only one behind it."""
    def own(t: str) -> str:
        named = {m.start: m for m in texts.mentions(t)}
        return named[S.owner(numbers.values(t)[-1], list(named.values()))].metric.canonical

    text = F.expr("CASE WHEN fy % 2 = 0 THEN 'ebitda fell while revenue was 512 crore' ELSE '512 crore of ebitda' END")
    return sales(spark, sf).select("document_id", _arrow(own, "string")(text).alias("owner"))


@query(f"WITH {_SALES} SELECT document_id, (n || ':FY' || fy || ';' || (n + 1) || ':FY' || (fy - 1)) AS bound FROM sales")
def value_period_range_join(spark, sf):
    """Each value takes the period next to it, each period serves once."""
    def bound(t: str) -> str:
        return ";".join(f"{c.value.numeric:.0f}:{c.period.canonical}" for c in S.claims(t))

    text = F.expr("'Revenue was Rs. ' || n || ' crore for FY' || fy || ' as against Rs. ' || (n + 1) || ' crore for FY' || (fy - 1)")
    return sales(spark, sf).select("document_id", _arrow(bound, "string")(text).alias("bound"))


@query(f"WITH {_SALES} SELECT document_id, (n + 200)::DOUBLE * 10000000 AS level, n::DOUBLE * 10000000 AS change FROM sales")
def clause_bindings(spark, sf):
    """X1b, X1e: a change, the new level and the old one of a comparison."""
    text = F.expr("'FY' || fy || ' EBITDA increased by Rs. ' || n || ' crore to Rs. ' || (n + 200) || ' crore from Rs. 200 crore in FY' || (fy - 1)")
    pages = _pages(spark, sf).drop("text").join(sales(spark, sf).select("document_id", text.alias("text"), F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("fy")), "document_id").withColumn("tiles", F.slice("tiles", 1, 0))
    facts = extract.build(extract.read(pages.drop("fy"))).where("extraction_method = 'rule_sentence'").join(sales(spark, sf).select("document_id", F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("period")), ["document_id", "period"])
    level, change = (F.max(F.when(F.col("metric_canonical") == m, F.col("normalized_numeric_value"))) for m in ("financial.ebitda", "financial.ebitda.change"))
    return facts.groupBy("document_id").agg(level.alias("level"), change.alias("change"))


@query(f"WITH {_SALES} SELECT document_id, (n * 10000000)::DOUBLE AS normalized FROM sales")
def elided_scale(spark, sf):
    """A bare amount of a comparison takes the sentence's scale."""
    def last(t: str) -> float:
        return S.share_scale(t, numbers.values(t))[0][-1].normalized

    text = F.expr("'revenue rose from rs. 4 crore to rs. ' || n")
    return sales(spark, sf).select("document_id", _arrow(last, "double")(text).alias("normalized"))


@query(f"""WITH {_SALES} SELECT document_id, unnest(['Annual Report of Example Industries', 'Registered Office: ' || n || ' Example Street, City ' || k, 'Warehouse space was ' || n || ' units in FY' || fy || '.',
'Ms. Asha Verma resigned as a member with effect from March 31, ' || fy || '.', 'Figures in Rs crore FY' || (fy - 1) || ' FY' || fy, 'EBITDA 1,0' || lpad(CAST(n % 100 AS VARCHAR), 2, '0') || ' 2,0' || lpad(CAST(k AS VARCHAR), 2, '0')]) AS sentence FROM sales""")
def label_coverage_anti(spark, sf):
    """Sentences of the reports that the taxonomy left alone."""
    pages = _pages(spark, sf)
    return extract.uncovered(pages, extract.read(pages)).select("document_id", "sentence")


@query(f"WITH {_SALES} SELECT document_id, 'FY' || fy AS current, 'FY' || (fy - 1) AS previous FROM sales")
def implied_period(spark, sf):
    """The year under review and the one before, by the document's own period."""
    text = F.lit("in the year under review, against the previous year")
    both = periods.implied(text, F.concat(F.lit("FY"), F.col("fy").cast("string")))
    return sales(spark, sf).select("document_id", F.get(both, 0)["canonical"].alias("current"), F.get(both, 1)["canonical"].alias("previous"))


@query(f"WITH {_SALES} SELECT document_id, fy % 2 = 0 AS partial FROM sales")
def partial_window(spark, sf):
    """D8."""
    text = F.expr("'growth in fy' || fy || CASE WHEN fy % 2 = 0 THEN ' (april-december)' ELSE ' and april to december' END")
    return sales(spark, sf).select("document_id", periods.follows_window(text, F.expr("'FY' || fy")).alias("partial"))


# Document context


@query(f"WITH {_SALES} SELECT document_id, 'annual_report' AS kind, CASE WHEN fy >= 2001 THEN 'FY' || fy END AS period, CASE WHEN fy >= 2001 THEN fy || '-03-31' END AS day, 'Zeta Freight Limited' AS company, 'India' AS country FROM sales")
def document_context(spark, sf):
    """C1-C10 together: company, country, date, period and kind of a report."""
    text = F.expr("'Annual Report ' || (fy - 1) || '-' || lpad(cast(fy % 100 as string), 2, '0') || chr(10) || repeat('Zeta Freight Limited works in India and elsewhere. ', 5)")
    rows = sales(spark, sf)
    pages = rows.select("document_id", F.lit(1).alias("page_number"), text.alias("text"))
    docs = rows.select(F.col("document_id").alias("id"), F.concat("document_id", F.lit(".pdf")).alias("original_name"), F.lit(1).alias("page_count"), _none("string").alias("pdf_author"))
    found = context.resolve(docs, pages)
    return found.select("document_id", F.col("document_kind").alias("kind"), F.col("document_period").alias("period"), F.col("document_date").alias("day"), F.col("primary_entity").alias("company"), F.col("subject_country").alias("country"))


@query(f"WITH {_SALES} SELECT 'n' || k AS document_id, 'Firm ' || chr(CAST(65 + k AS INT)) || ' Limited' AS name, count(*) AS votes FROM sales GROUP BY ALL")
def corporate_name_mode(spark, sf):
    """C1."""
    pages = sales(spark, sf).select(F.expr("'n' || k").alias("document_id"), F.col("fy").cast("int").alias("page_number"), F.expr("'the Firm ' || chr(65 + k) || ' Limited'").alias("text"))
    return context.company_votes(pages).select("document_id", "name", "votes")


@query(f"WITH {_SALES} SELECT 'n' || k AS document_id, 'Acme Institute' AS phrase, count(*) AS total, count(*) AS pages FROM sales GROUP BY ALL HAVING count(*) >= 4")
def repeated_phrase(spark, sf):
    """C4."""
    pages = sales(spark, sf).select(F.expr("'n' || k").alias("document_id"), F.col("fy").cast("int").alias("page_number"), F.lit("said Acme Institute today").alias("text"))
    return context.repeated_phrases(pages)


@query(f"WITH {_SALES} SELECT 'n' || k AS document_id, CASE WHEN count(*) >= 5 THEN 'Japan' END AS subject_country FROM sales GROUP BY ALL")
def subject_country(spark, sf):
    """C7."""
    pages = sales(spark, sf).select(F.expr("'n' || k").alias("document_id"), F.col("fy").cast("int").alias("page_number"), F.lit("Trade with Japan rose.").alias("text"))
    return context.subject_country(pages)


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Unijoin' WHEN 1 THEN 'Acme Bank' WHEN 2 THEN 'Global Fund' END AS organisation FROM supplier")
def author_organisation(spark, sf):
    """C5."""
    author = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'Unijoin' WHEN 1 THEN 'Jane Doe (Acme Bank, Delhi)' WHEN 2 THEN 'Global Fund' ELSE 'Jane Doe' END")
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", context.author_organisation(author).alias("organisation"))


@query("SELECT s_suppkey, 'The ' || s_suppkey % 9 || ' outlook of trade' AS title FROM supplier")
def title_line(spark, sf):
    """C6."""
    text = F.expr("'Contents' || chr(10) || 'Chapter no. 3 of the book' || chr(10) || ' The ' || s_suppkey % 9 || ' outlook of trade ' || chr(10) || 'Another line of text'")
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", context.title_line(text).alias("title"))


# Layout: each supplier has a page of five blocks


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/supplier.parquet")
    block = lambda i, x0, y0, x1, y1, text: F.struct(F.lit(i).alias("block_ix"), *[F.lit(float(v)).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], F.lit(0).alias("block_type"), text.alias("text"))
    name = F.col("s_name")
    all_ = F.array(
        block(0, 320, 100, 560, 120, F.concat(F.lit("right of "), name)), block(1, 20, 150, 280, 170, F.lit("continues here.")), block(2, 20, 100, 280, 120, F.concat(F.lit("• left "), name, F.lit(" and"))),
        block(3, 20, 10, 90, 30, F.concat(F.lit("₹"), (F.col("s_suppkey") + 1).cast("string"), F.lit(" Cr"))), block(4, 22, 34, 90, 44, F.lit("Total income")), block(5, 500, 10, 560, 20, F.lit("FY24")),
    )
    return rows.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("document_id"), F.lit(1).alias("page_number"), F.lit(600.0).alias("page_width"), F.explode(all_).alias("b")).select("document_id", "page_number", "page_width", "b.*")


@query("SELECT 's' || s_suppkey AS document_id, unnest([3, 4, 2, 1, 5, 0]) AS block_ix, unnest([1, 2, 3, 4, 5, 6]) AS place FROM supplier")
def reading_order(spark, sf):
    """P1-P3."""
    return layout.reading_order(_blocks(spark, sf)).select("document_id", "block_ix", "place")


@query("SELECT 's' || s_suppkey AS document_id, '₹' || (s_suppkey + 1) || ' Cr' || chr(10) || 'Total income left ' || s_name || ' and continues here.' || chr(10) || 'FY24 right of ' || s_name AS text FROM supplier")
def continuation_merge(spark, sf):
    """P4, P5."""
    return layout.page_texts(_blocks(spark, sf)).select("document_id", "text")


@query("SELECT 's' || s_suppkey AS document_id, '₹' || (s_suppkey + 1) || ' Cr' AS value, 'Total income' AS label, 0 AS start, 'FY2024' AS hint FROM supplier")
def tile_pairing(spark, sf):
    """P7-P11, J11."""
    rows = layout.pages(_blocks(spark, sf)).select("document_id", F.explode("tiles").alias("t"), "period_hint")
    return rows.select("document_id", F.col("t.value_text").alias("value"), F.col("t.label_text").alias("label"), F.col("t.start").alias("start"), F.col("period_hint").alias("hint"))


# Families


def _payload(spark: SparkSession, sf: str) -> DataFrame:
    part = spark.read.parquet(f"{sf}/part.parquet")
    member = F.struct(F.concat(F.lit("label "), F.col("p_partkey").cast("string")).alias("raw"), ((F.col("p_partkey") % 10) / 10).alias("confidence"))
    json = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("fam"), (F.col("p_partkey") % 5).cast("string")).alias("family_id"), F.array(member).alias("members"))).alias("families")))
    return part.select(F.when(F.col("p_partkey") % 7 == 0, '{"families": "none"}').otherwise(json).alias("payload"))


@query("SELECT 'label ' || p_partkey AS raw, 'fam' || p_partkey % 5 AS family, p_partkey % 10 / 10::DOUBLE AS confidence FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 10 >= 6")
def families_parse(spark, sf):
    """F2."""
    return families.parse(_payload(spark, sf))


@query(f"{oracle.FACTS} SELECT id, CASE WHEN metric IN ('discount_rate', 'rebate') THEN 'rate' ELSE metric_canonical END AS family, (CASE WHEN metric IN ('discount_rate', 'rebate') THEN 0.9 ELSE 1 END)::DOUBLE AS confidence FROM facts")
def families_assign(spark, sf):
    """F1, F3."""
    known = spark.createDataFrame([("discount_rate", "rate", 0.9), ("rebate", "rate", 0.9)], "raw string, family string, confidence double")
    return families.assign(claims.facts(spark, sf), known).select("id", F.col("predicate_family").alias("family"), F.col("predicate_family_confidence").alias("confidence"))


@query(f"{oracle.FACTS} SELECT id, metric_canonical AS family FROM facts")
def families_fallback(spark, sf):
    """F4."""
    return families.group(spark, claims.facts(spark, sf), None).select("id", F.col("predicate_family").alias("family"))


def _by_brand(names: list[str]) -> str:
    """What a model would answer that takes labels of one brand (the last word) for one thing."""
    brands: dict[str, list[dict]] = {}
    for n in names:
        brands.setdefault(n.rpartition(" ")[2], []).append({"raw": n, "confidence": 0.9})
    return json.dumps({"families": [{"family_id": b, "members": m} for b, m in brands.items()]})


@query("SELECT DISTINCT trim(p_name || ' ' || p_brand) AS raw, regexp_extract(p_brand, '[^ ]*$') AS family FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL")
def families_in_batches(spark, sf):
    """Labels of all parts in rounds of prompts of at most 200 labels; families are those of one prompt with all of them."""
    names = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws(" ", "p_name", "p_brand").alias("metric")).where("p_name is not null and p_brand is not null")
    return families.in_batches(names, _by_brand, size=200).select("raw", "family")


# Sinks and streams


@query(f"{oracle.FACTS} SELECT raw_value, metric, confidence, page_number FROM facts")
def csv_export_roundtrip(spark, sf):
    """S13."""
    path = scratch.path(spark, "csv")
    tables.write_csv(claims.facts(spark, sf), path)
    return tables.read_csv(spark, path).select("raw_value", "metric", "confidence", "page_number")


@query(f"{oracle.FACTS} SELECT id, raw_value, confidence, period, scope, CAST(CASE WHEN qualifier_list = '' THEN 0 ELSE len(string_split(qualifier_list, ',')) END AS INT) AS qualifiers FROM facts")
def json_snapshot_roundtrip(spark, sf):
    """S9, S10."""
    path = scratch.path(spark, "snapshot")
    facts = claims.facts(spark, sf)
    tables.write_snapshot(facts, facts.select("id"), path)
    back, _ = tables.read_snapshot(spark, path, "id string")
    return back.select("id", "raw_value", "confidence", "period", "scope", F.size("qualifiers").alias("qualifiers"))


@query(f"{oracle.JUDGED} SELECT id, relationship_type FROM rels")
def stream_incremental(spark, sf):
    """All documents arrive as a stream, in three batches; all pairs are found, whichever batch brings them."""
    from factweave.schema import FACTS
    from factweave.streaming import incremental

    root = scratch.path(spark, "stream")
    claims.facts(spark, sf).repartition(12, "id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    incremental.start(stream, f"{root}/store", f"{root}/checkpoint", ordered=True).awaitTermination()
    return spark.read.parquet(f"{root}/store/relationships").select("id", "relationship_type")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY ALL")
def events_json(spark, sf):
    """JSON fields of the event stream, read and summed."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query()
def llm_cache_key(spark, sf):
    """S17."""
    from factweave.sources.llm import cache_key_column

    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", cache_key_column(F.lit("m"), F.lit("1"), F.lit("1"), F.col("s_name")).alias("key"))


@query("SELECT s_suppkey, CASE WHEN abs(s_acctbal) >= 1000 THEN round_even(s_acctbal / 1000, 1) || 'K' ELSE CAST(s_acctbal AS VARCHAR) END AS shown FROM supplier")
def compact_display(spark, sf):
    """N10."""
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", numbers.compact(F.col("s_acctbal")).alias("shown"))


@query(f"WITH {_SALES} SELECT document_id, row_number() OVER (ORDER BY k, fy) + 6 AS fact_seq FROM sales")
def document_arrival(spark, sf):
    """Q1: the order in which documents arrive, made explicit in the numbers of their facts."""
    order = sales(spark, sf).select("document_id", (F.col("k") * 1_000_000 + F.col("fy")).alias("document_seq"))
    return extract.number_facts(_built(spark, sf, "rule_sentence"), order, 7).select("document_id", "fact_seq")


# Small lookups and display


@query("SELECT item_id, text, CAST(length(text) AS INT) AS char_count FROM benchmark WHERE item_id = 3")
def page_lookup(spark, sf):
    """One page by its key."""
    return layout.with_stats(spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 3")).select("item_id", "text", "char_count")


@query(f"{oracle.FACTS} SELECT document_id, any_value(document_name) AS document_name, count(*) AS facts FROM facts GROUP BY ALL")
def documents_list(spark, sf):
    """R2."""
    return claims.facts(spark, sf).groupBy("document_id").agg(F.any_value("document_name").alias("document_name"), F.count(F.lit(1)).alias("facts"))


@query("SELECT 'p' || p_partkey AS document_id, CASE p_partkey % 4 WHEN 0 THEN 'India' WHEN 3 THEN 'Unknown entity' ELSE 'Acme Limited' END AS subject FROM part")
def subject_resolve(spark, sf):
    """A macro metric is about the country if one is known, everything else about the company if one is known."""
    key = F.col("p_partkey") % 4
    pages = spark.read.parquet(f"{sf}/part.parquet").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("document_id"), F.lit("a.pdf").alias("document_name"), F.lit(1).alias("page_number"),
        F.when(key <= 1, "Retail inflation was 5.5 per cent in FY24.").otherwise("Revenue was Rs. 5 crore in FY24.").alias("text"), _none("string").alias("period_hint"),
        _none("array<struct<value_text:string,label_text:string,bbox:array<double>,start:int,end:int>>").alias("tiles"), F.when(key != 3, "Acme Limited").alias("primary_entity"),
        F.when(key != 1, "India").alias("subject_country"), _none("string").alias("document_date"), _none("string").alias("document_period"),
    )
    return extract.read(pages).select("document_id", F.col("entity").alias("subject"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS fits FROM part")
def value_compatible(spark, sf):
    """Employees fit a headcount, parcels do not, nor does money; a bare number only near the keyword."""
    def fits(t: str) -> bool:
        m = texts.mentions(t.lower())[0]
        return S.fits(m.metric, numbers.values(t)[0], m.end)

    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'headcount of 512 employees' WHEN 1 THEN 'headcount of 512 parcels' WHEN 2 THEN 'headcount cost of Rs. 512 crore' ELSE 'headcount of 512' END")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", _arrow(fits, "boolean")(text).alias("fits"))


@query("SELECT c_custkey, CASE WHEN c_custkey < 1024 THEN c_custkey || ' B' ELSE round_even(c_custkey / 1024, 1) || ' KB' END AS shown FROM customer")
def byte_size(spark, sf):
    """N10."""
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", numbers.byte_size(F.col("c_custkey")).alias("shown"))


@query("SELECT k, CAST(CASE WHEN top <= step THEN step WHEN top <= 2 * step THEN 2 * step WHEN top <= 5 * step THEN 5 * step ELSE 10 * step END AS DOUBLE) AS axis FROM (SELECT c_nationkey AS k, CAST(count(*) AS DOUBLE) AS top, CAST(pow(10, length(CAST(count(*) AS VARCHAR)) - 1) AS DOUBLE) AS step FROM customer GROUP BY ALL)")
def axis_scale(spark, sf):
    """The top of an axis, one, two or five times a power of ten."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("top"))
    return rows.select("k", numbers.axis_top(F.col("top")).alias("axis"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def upload_gate(spark, sf):
    """Only files of the right kind."""
    name = F.expr("'file' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.pdf.zip' END")
    return tables.accepted(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", name.alias("name"))).select("o_orderkey")


@query(f"{oracle.FACTS} SELECT id FROM facts WHERE FALSE")
def truncate_facts(spark, sf):
    """S12."""
    return tables.truncated(claims.facts(spark, sf)).select("id")


@query(f"{oracle.FACTS} SELECT fact_seq, '\"' || entity || '\",\"' || metric || '\"' AS head FROM facts")
def csv_lines(spark, sf):
    """Fields as they stand in the export."""
    rows = tables.csv_lines(claims.facts(spark, sf))
    return rows.select("fact_seq", F.array_join(F.slice(F.split("line", ","), 1, 2), ",").alias("head"))
