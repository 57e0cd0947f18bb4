"""Row types: the flat fact table that operators work on, its nested form, pages and relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _split(text: str) -> list[str]:
    """text cut at the commas that are in no angle bracket."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def column_type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(column_type(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n, column_type(k)) for n, _, k in (x.partition(":") for x in _split(text[7:-1]))])
    return _PLAIN[text]


def _schema(text: str) -> T.StructType:
    """A StructType from column definitions; needs no session, so workers can import this module."""
    return T.StructType([T.StructField(n, column_type(k.strip())) for n, _, k in (x.partition(" ") for x in _split(text))])


PAGE_BLOCKS = _schema("document_id string, page_number int, page_width double, block_ix int, x0 double, y0 double, x1 double, y1 double, block_type int, text string")
DOCUMENTS = _schema(
    "id string, filename string, original_name string, page_count int, file_size_bytes bigint, upload_time string, status string, error_message string, "
    "extracted_facts_count int, parser string, pdf_title string, pdf_author string, primary_entity string, subject_country string, document_date string, "
    "document_kind string, document_period string"
)
SENTENCE = "struct<text:string,start:int,end:int>"
TILE = "struct<value_text:string,label_text:string,bbox:array<double>,start:int,end:int>"
PAGES = _schema(f"document_id string, page_number int, text string, char_count int, token_estimate int, period_hint string, sentences array<{SENTENCE}>, tiles array<{TILE}>")
FACTS = _schema(
    "fact_seq bigint, id string, document_id string, document_name string, entity string, entity_canonical string, metric string, metric_canonical string, "
    "metric_category string, sub_metric string, predicate_family string, predicate_family_confidence double, raw_value string, numeric_value double, "
    "normalized_numeric_value double, unit string, normalized_unit string, period_raw string, period_type string, period string, period_start string, "
    "period_end string, period_source string, scope string, accounting_standard string, qualifiers array<string>, segment_name string, page_number int, "
    "exact_quote string, char_start int, char_end int, confidence double, extraction_method string, notes string"
)
RELATIONSHIPS = _schema(
    "id string, fact_a_id string, fact_b_id string, relationship_type string, confidence double, divergence_factor string, entity_canonical string, "
    "metric_canonical string, match_basis string, delta_percentage double, delta_absolute double, "
    "checks array<struct<step_number:int,name:string,passed:boolean,explanation:string>>"
)

_NESTED = {
    "period": {"raw": "period_raw", "period_type": "period_type", "canonical": "period", "start_date": "period_start", "end_date": "period_end", "source": "period_source"},
    "context": {"scope": "scope", "accounting_standard": "accounting_standard", "qualifiers": "qualifiers", "segment_name": "segment_name"},
    "source_evidence": {"document_id": "document_id", "document_name": "document_name", "page_number": "page_number", "exact_quote": "exact_quote", "char_start": "char_start", "char_end": "char_end"},
}


def nest(facts: DataFrame) -> DataFrame:
    """The flat fact table in its published nested form."""
    flat = {c for group in _NESTED.values() for c in group.values()} - {"document_id", "document_name", "period"}
    structs = [F.struct(*[F.col(c).alias(n) for n, c in group.items()]).alias(name) for name, group in _NESTED.items()]
    return facts.select(*[c for c in facts.columns if c not in flat and c != "period"], *structs)


def flatten(facts: DataFrame) -> DataFrame:
    """The inverse of nest."""
    back = [F.col(f"{name}.{n}").alias(c) for name, group in _NESTED.items() for n, c in group.items() if not (name == "source_evidence" and n.startswith("document"))]
    return facts.select(*[c for c in facts.columns if c not in _NESTED], *back).select(*FACTS.fieldNames())


def with_defaults(facts: DataFrame) -> DataFrame:
    """Facts of an older snapshot with the columns they lack, at their defaults."""
    defaults = {"predicate_family_confidence": 0.0, "period_source": "quote"}
    for field in FACTS.fields:
        if field.name not in facts.columns:
            facts = facts.withColumn(field.name, F.lit(defaults.get(field.name)).cast(field.dataType))
    return facts.select(*FACTS.fieldNames())
