"""The SQL text of the lifted claims: a fixture of fifteen "documents" over the star schema, alike in Spark and in DuckDB.

Nothing of the operators is in it: it is the input that they and their oracle are given.
"""

from __future__ import annotations

FY = "year({} + interval '9' month)"
_MONEY = "cast(floor({0} / 100) as bigint) || '.' || lpad(cast({0} % 100 as string), 2, '0')"


def _claim(doc: int, name: str, source: str, seq: str, entity: str, metric: str, raw: str, numeric: str, normalized: str, unit: str, period: str, **rest: str) -> str:
    """One document's facts as a SELECT; rest overrides the plain context."""
    at = {
        "canonical": f"'{metric}'", "category": "'financial_flow'", "sub_metric": "'total'", "family": f"'{metric}'", "scope": "'unspecified'",
        "basis": "'As reported'", "qualifiers": "''", "page": "1", "start": "0", "confidence": "0.5 + 0.05 * ((k * 7 + fy * 3) % 10)",
        "period_type": "'fiscal_year'", "period_end": "cast(fy as string) || '-03-31'", "method": "'rule_sentence'", "notes": "cast(null as string)",
        "label": f"'{metric.split('.')[-1]}'", "written": unit,
    } | rest
    return f"""SELECT cast({doc} as bigint) * 1000000000000 + {seq} AS fact_seq, 'f{doc}-' || cast({seq} as string) AS id, 'd{doc}' AS document_id, '{name}.pdf' AS document_name,
  {entity} AS entity, lower({entity}) AS entity_canonical, {at['label']} AS metric, {at['canonical']} AS metric_canonical, {at['category']} AS metric_category,
  {at['sub_metric']} AS sub_metric, {at['family']} AS predicate_family, {raw} AS raw_value, cast({numeric} as double) AS numeric_value,
  cast({normalized} as double) AS normalized_numeric_value, {at['written']} AS unit, {unit} AS normalized_unit, {period} AS period_raw, {at['period_type']} AS period_type,
  {period} AS period, {at['period_end']} AS period_end, {at['scope']} AS scope, {at['basis']} AS accounting_standard, {at['qualifiers']} AS qualifier_list,
  {at['page']} AS page_number, {at['label']} || ' was ' || {raw} AS exact_quote, {at['start']} AS char_start, cast({at['confidence']} as double) AS confidence,
  {at['method']} AS extraction_method, {at['notes']} AS notes FROM {source}"""


_REVENUE = {"seq": "k * 10000 + fy", "entity": "'Nation_' || cast(k as string)", "unit": "'INR'", "period": "'FY' || cast(fy as string)"}
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ceased' WHEN 'O' THEN 'active' ELSE 'appointed' END"
_CLAIMS = (
    _claim(1, "ledger", "ledger", metric="financial.revenue", raw="'Rs. ' || " + _MONEY.format("cents"), numeric="cents / 100.0", normalized="cents / 100.0", **_REVENUE),
    _claim(2, "deck", "ledger", metric="financial.revenue", raw="cast(cast(round(cents / 10000000.0) as bigint) as string) || ' lakh'", numeric="round(cents / 10000000.0)", normalized="round(cents / 10000000.0) * 100000", **_REVENUE),
    _claim(3, "shipments", "shipped", metric="financial.revenue", raw="'Rs. ' || " + _MONEY.format("cents"), numeric="cents / 100.0", normalized="cents / 100.0", **_REVENUE),
    _claim(4, "plan", "ledger", metric="financial.revenue", raw="'Rs. ' || cast(cast(round(cents * 1.08 / 100) as bigint) as string)", numeric="round(cents * 1.08 / 100)", normalized="round(cents * 1.08 / 100)", qualifiers="'estimate'", **_REVENUE),
    _claim(5, "forecast", "ledger", metric="financial.revenue", raw="'Rs. ' || cast(cast(round(cents * 1.03 / 100) as bigint) as string)", numeric="round(cents * 1.03 / 100)", normalized="round(cents * 1.03 / 100)", qualifiers="CASE WHEN fy % 2 = 0 THEN 'estimate,exclusions_apply' ELSE 'estimate' END", **_REVENUE),
    _claim(6, "segments", "segmented", metric="financial.revenue", raw="'Rs. ' || " + _MONEY.format("cents"), numeric="cents / 100.0", normalized="cents / 100.0", scope="'segment'", sub_metric="'segment_' || lower(segment)", start="n", **(_REVENUE | {"seq": "k * 10000 + fy + 1000000 * n"})),
    _claim(7, "adjusted", "ledger", metric="financial.revenue", raw="'Rs. ' || cast(cast(round(cents * 0.9 / 100) as bigint) as string)", numeric="round(cents * 0.9 / 100)", normalized="round(cents * 0.9 / 100)", basis="'Non-GAAP (adjusted)'", qualifiers="'adjusted_non_gaap'", notes="'Basis stated once. Second sentence.'", **_REVENUE),
    _claim(8, "rates", "rated", metric="ops.discount_rate", raw="cast(rate as string) || '%'", numeric="rate", normalized="rate", category="'operational'", **(_REVENUE | {"unit": "'PERCENT'"})),
    _claim(9, "rates-rounded", "rated", metric="ops.rebate", raw="cast(cast(round(rate) as bigint) as string) || '%'", numeric="round(rate)", normalized="round(rate)", family="'ops.discount_rate'", category="'operational'", qualifiers="CASE WHEN k % 3 = 0 THEN 'partial_period' WHEN k % 3 = 1 THEN 'share_of' ELSE '' END", **(_REVENUE | {"unit": "'PERCENT'"})),
    _claim(10, "counts", "ledger", metric="ops.orders", raw="cast(n as string) || ' orders'", numeric="n", normalized="n", written="'orders'", page="CASE WHEN fy % 2 = 0 THEN 1 ELSE 2 END", **(_REVENUE | {"unit": "'COUNT'", "period": "CASE WHEN fy % 4 = 0 THEN 'unknown' ELSE 'FY' || cast(2000 + fy % 2 as string) END"})),
    _claim(11, "status", "orders", "o_orderkey", "'Customer_' || cast(o_custkey as string)", "governance.board_status", _STATUS, "null", "null", "'TEXT'", "cast(cast(o_orderdate as date) as string)", category="'governance'", sub_metric="cast(null as string)", scope="'corporate'", basis="'n/a'", confidence="0.55 + 0.05 * (o_orderkey % 9)", period_type="'point_in_time'", period_end="cast(cast(o_orderdate as date) as string)", method="'rule_governance'", notes="CASE WHEN o_orderkey % 9 = 0 THEN 'Date missing.' END"),
    _claim(12, "catalog", "part", "p_partkey", "'Part_' || cast(p_partkey as string)", "attr.sku", "'SKU' || lpad(cast(p_partkey as string), 9, '0')", "null", "null", "'TEXT'", "'undated'", category="'corporate'", sub_metric="'attribute'", scope="'corporate'", basis="'n/a'", confidence="0.85", period_type="'not_applicable'", period_end="cast(null as string)", method="'rule_attribute'"),
    _claim(13, "labels", "part", "p_partkey", "'Part_' || cast(p_partkey as string)", "attr.sku", "CASE p_partkey % 3 WHEN 0 THEN 'SKU' || lpad(cast(p_partkey as string), 9, '0') WHEN 1 THEN 'SKU' || substr(lpad(cast(p_partkey as string), 9, '0'), 1, 8) || 'X' ELSE 'ITM' || lpad(cast(p_partkey as string), 9, '0') END", "null", "null", "'TEXT'", "'not_applicable'", category="'corporate'", sub_metric="'identifier'", scope="'corporate'", basis="'n/a'", confidence="0.7", period_type="'not_applicable'", period_end="cast(null as string)", method="'rule_attribute'"),
    _claim(14, "names", "part", "p_partkey", "'Part_' || cast(p_partkey as string)", "attr.name", "p_name || ' of the ' || p_type || ' range'", "null", "null", "'TEXT'", "'undated'", category="'corporate'", sub_metric="'attribute'", scope="'corporate'", basis="'n/a'", confidence="0.8", period_type="'not_applicable'", period_end="cast(null as string)", method="'rule_attribute'"),
    _claim(15, "names-short", "part", "p_partkey", "'Part_' || cast(p_partkey as string)", "attr.name", "CASE p_partkey % 4 WHEN 0 THEN p_name || ' of the ' || p_type || ' range' WHEN 1 THEN p_type || ' ' || p_name || ' range' WHEN 2 THEN p_name ELSE 'unlisted' END", "null", "null", "'TEXT'", "'undated'", category="'corporate'", sub_metric="'attribute'", scope="'corporate'", basis="'n/a'", confidence="0.9", period_type="'not_applicable'", period_end="cast(null as string)", method="'rule_attribute'"),
)

#: The facts from ledger, shipped, segmented, rated and the tables orders and part.
CLAIMS_SQL = " UNION ALL ".join(_CLAIMS)
FACTS_SQL = f"""
ledger AS (SELECT cast(c_nationkey as bigint) AS k, cast({FY.format('o_orderdate')} as bigint) AS fy, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) AS cents, cast(count(*) as bigint) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
shipped AS (SELECT cast(c_nationkey as bigint) AS k, cast({FY.format('l_shipdate')} as bigint) AS fy, cast(sum(cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)) as bigint) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
segmented AS (SELECT cast(c_nationkey as bigint) AS k, cast({FY.format('o_orderdate')} as bigint) AS fy, c_mktsegment AS segment, cast(ascii(c_mktsegment) as int) AS n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) AS cents
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4),
rated AS (SELECT cast(c_nationkey as bigint) AS k, cast({FY.format('l_shipdate')} as bigint) AS fy, cast(round(10000.0 * sum(cast(round(l_discount * 100) as bigint)) / (count(*) * 100)) as double) / 100 AS rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
facts AS ({CLAIMS_SQL})
"""
