"""The fixed questions over facts and relationships: lists, queues, matrices, coverage, timelines, health."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factweave.functions import vocabulary as V
from factweave.operators.reasoning import AGREE, CONFLICT, EXPLAINED, REVIEW

#: What a view shows of each side of a relationship.
SHOWN = ("fact_seq", "document_name", "entity", "metric", "period", "period_raw", "raw_value", "confidence", "normalized_unit", "exact_quote")
#: What the review queue reads of them.
QUEUED = ("fact_seq", "document_name", "period", "normalized_unit")
# Scores of the review queue and the order of explained cases.
QUEUE_SCORES = ((CONFLICT, True, 100.0), (CONFLICT, False, 55.0), (REVIEW, True, 45.0), (REVIEW, False, 35.0))
EXPLAINED_CASES = ("IDENTIFIER_REVISED", "SCOPE_OR_BASIS", "STATUS_CHANGED_OVER_TIME", "DATA_VINTAGE", "PARTIAL_PERIOD", "DIFFERENT_PERIODS")


def enrich(rels: DataFrame, facts: DataFrame, shown: Sequence[str] = SHOWN) -> DataFrame:
    """Relationships with both their facts (columns shown of each); those that have lost one go."""
    for side in "ab":
        own = facts.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in shown])
        rels = rels.join(own, f"{side}_id")
    return rels


def matchable() -> Column:
    return F.col("confidence") >= V.MATCH_THRESHOLD


def facts_filter(facts: DataFrame, document: str | None = None, entity: str | None = None, metric: str | None = None, least: float = 0.0, q: str | None = None) -> DataFrame:
    """Facts by document, parts of entity and metric names, confidence, and a text found in quote, metric or value."""
    if document:
        facts = facts.where(F.col("document_id") == document)
    if entity:
        facts = facts.where(F.lower("entity").contains(entity.lower()) | F.col("entity_canonical").contains(entity.lower()))
    if metric:
        facts = facts.where(F.lower("metric").contains(metric.lower()) | F.col("metric_canonical").contains(metric.lower()))
    if least:
        facts = facts.where(F.col("confidence") >= least)
    if q:
        facts = facts.where(F.lower("exact_quote").contains(q.lower()) | F.lower("metric").contains(q.lower()) | F.lower("raw_value").contains(q.lower()))
    return facts


def relationships_filter(enriched: DataFrame, verdict: str | None = None, scope: str = "all", metric: str | None = None, entity: str | None = None) -> DataFrame:
    """Relationships by verdict, across or within documents, and parts of metric and entity; surest across documents first."""
    if verdict:
        enriched = enriched.where(F.col("relationship_type") == verdict)
    if scope in ("cross", "intra"):
        enriched = enriched.where(F.col("cross_document") == F.lit(scope == "cross"))
    if metric:
        enriched = enriched.where(F.col("metric_canonical").contains(metric.lower()))
    if entity:
        enriched = enriched.where(F.col("entity_canonical").contains(entity.lower()))
    return enriched.orderBy(F.desc("cross_document"), F.desc("confidence"), "a_fact_seq", "b_fact_seq")


def _case_order() -> list[Column]:
    alike = F.lower("a_raw_value") == F.lower("b_raw_value")
    return [F.desc("cross_document"), F.desc(F.least("a_confidence", "b_confidence")), F.asc(alike.cast("int")), F.asc("a_fact_seq"), F.asc("b_fact_seq")]


def cases(enriched: DataFrame, top: int = 3) -> DataFrame:
    """The best `top` relationships of each verdict; of the explained ones, the best of each of six factors."""
    by = F.when(F.col("relationship_type") == EXPLAINED, F.col("divergence_factor")).otherwise(F.col("relationship_type"))
    named = enriched.withColumn("case", by).where((F.col("relationship_type") != EXPLAINED) | F.col("divergence_factor").isin(*EXPLAINED_CASES))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(*_case_order())))
    # The literal bound lets each task keep its first rows only; the explained ones are cut further then.
    return ranked.where(F.col("rank") <= top).where((F.col("relationship_type") != EXPLAINED) | (F.col("rank") == 1))


def low_confidence_reasons(facts: DataFrame, top: int = 8) -> DataFrame:
    """First sentences of the notes of facts below the threshold, by how often they occur."""
    first = F.regexp_replace(F.substring_index(F.coalesce("notes", F.lit("Low confidence")), ". ", 1), r"\.+$", "")
    return facts.where(~matchable()).groupBy(first.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def low_confidence_examples(facts: DataFrame, top: int = 8) -> DataFrame:
    return facts.where(~matchable()).orderBy("confidence", "fact_seq").limit(top)


def review_queue(enriched: DataFrame) -> DataFrame:
    """Conflicts and open questions by severity, near-identical rows behind the sharpest one (column also)."""
    score = F.lit(None).cast("double")
    for verdict, cross, base in QUEUE_SCORES:
        score = F.when((F.col("relationship_type") == verdict) & (F.col("cross_document") == F.lit(cross)), base).otherwise(score)
    spread = F.when(F.col("delta_percentage").isNotNull(), F.least(F.lit(25.0), F.col("delta_percentage") / 4)).when(F.col("a_normalized_unit") == "TEXT", 12.0).otherwise(0.0)
    rows = enriched.withColumn("base", score).where("base is not null").withColumn("severity", F.bround(F.col("base") * F.col("confidence") + spread, 1))
    group = ["relationship_type", "metric_canonical", "a_period", "entity_canonical", F.least("a_document_name", "b_document_name"), F.greatest("a_document_name", "b_document_name")]
    sharpest = F.min_by(F.struct(*rows.drop("base").columns), F.struct(-F.col("severity"), "a_fact_seq", "b_fact_seq"))
    best = rows.groupBy(*[g if isinstance(g, str) else g.alias(f"document_{i}") for i, g in enumerate(group)]).agg(sharpest.alias("best"), F.count(F.lit(1)).alias("n"))
    return best.select("best.*", (F.col("n") - 1).alias("also"))


def doc_matrix(rels: DataFrame) -> DataFrame:
    """Verdict counts of each unordered pair of documents."""
    rows = rels.groupBy(F.least("a_document_id", "b_document_id").alias("doc_a"), F.greatest("a_document_id", "b_document_id").alias("doc_b"))
    return rows.pivot("relationship_type", [AGREE, CONFLICT, EXPLAINED, REVIEW]).count().na.fill(0)


def metric_coverage(facts: DataFrame, rels: DataFrame) -> DataFrame:
    """Facts and documents of each metric, and its agreements and conflicts across documents."""
    per = facts.where(matchable()).groupBy("metric_canonical").agg(F.min_by("metric", "fact_seq").alias("label"), F.count(F.lit(1)).alias("facts"), F.count_distinct("document_id").alias("documents"))
    met = rels.where("cross_document").groupBy("metric_canonical").agg(F.count_if(F.col("relationship_type") == AGREE).alias("corroborated"), F.count_if(F.col("relationship_type") == CONFLICT).alias("conflicting"))
    return per.join(met, "metric_canonical", "left").na.fill(0, ["corroborated", "conflicting"])


def linked_ids(rels: DataFrame) -> DataFrame:
    """Facts that are in a relationship."""
    return rels.select(F.explode(F.array("a_id", "b_id")).alias("id")).distinct()


def document_health(facts: DataFrame, rels: DataFrame) -> DataFrame:
    """Of each document: facts, matchable and other ones, and matchable ones in a relationship."""
    linked = linked_ids(rels).withColumn("linked", F.lit(True))
    rows = facts.join(linked, "id", "left")
    return rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(matchable()).alias("matchable"), F.count_if(~matchable()).alias("low_confidence"),
        F.count_if(matchable() & F.col("linked")).alias("linked"),
    )


def unconfirmed(facts: DataFrame, rels: DataFrame) -> DataFrame:
    """Matchable facts without a relationship."""
    return facts.where(matchable()).join(linked_ids(rels), "id", "left_anti")


def headline(facts: DataFrame, rels: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row of the figures above all views."""
    queue = review_queue(enriched).agg(
        F.count(F.lit(1)).alias("needs_attention"), F.count_if(F.col("relationship_type") == CONFLICT).alias("conflicts"),
        F.count_if((F.col("relationship_type") == REVIEW) & F.col("cross_document")).alias("review_cross"),
        F.count_if((F.col("relationship_type") == REVIEW) & ~F.col("cross_document")).alias("review_intra"),
    )
    whole = facts.agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("facts"), F.count_if(matchable()).alias("matchable"))
    agree = rels.where(F.col("relationship_type") == AGREE)
    told = linked_ids(agree).agg(F.count(F.lit(1)).alias("agreements")).join(agree.agg(F.count(F.lit(1)).alias("agreement_pairs")))
    alone = unconfirmed(facts, rels).agg(F.count(F.lit(1)).alias("unconfirmed"))
    return queue.join(whole).join(told).join(alone)  # rows of one, each


def taxonomy_counts(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """The taxonomy with the number of facts of each metric."""
    counts = facts.groupBy(F.col("metric_canonical").alias("canonical")).agg(F.count(F.lit(1)).alias("facts"))
    return dim.join(counts, "canonical", "left").na.fill(0, ["facts"])


def _first_labels(facts: DataFrame, count: Column) -> DataFrame:
    """metric_canonical, facts (a count) and label (that of the first fact) of each metric.

    Labels are counted first, which hashes them: the first label of all facts of a metric would be found by sorting all facts.
    """
    labels = facts.groupBy("metric_canonical", "metric").agg(count.alias("facts"), F.min("fact_seq").alias("first"))
    return labels.groupBy("metric_canonical").agg(F.sum("facts").alias("facts"), F.min_by("metric", "first").alias("label"))


def discovered(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Metrics outside the taxonomy with their first label."""
    own = facts.join(dim.select(F.col("canonical").alias("metric_canonical")), "metric_canonical", "left_anti")
    return _first_labels(own, F.count(F.lit(1)))


def _dated() -> Column:
    return F.col("normalized_numeric_value").isNotNull() & (F.col("period") != "unknown")


def timeline(facts: DataFrame, metric: str, entity: str | None = None) -> DataFrame:
    """Dated numbers of a metric in the order of their periods' ends."""
    rows = facts.where(_dated() & (F.col("metric_canonical") == metric))
    rows = rows.where(F.col("entity_canonical") == entity) if entity else rows
    return rows.orderBy(F.coalesce(F.nullif("period_end", F.lit("")), "period"), "document_name", "fact_seq")


def metrics_available(facts: DataFrame) -> DataFrame:
    """Metrics with dated numbers, how many, and the first label of any fact."""
    return _first_labels(facts, F.count_if(_dated())).where("facts > 0")


def evaluation(facts: DataFrame, rels: DataFrame) -> DataFrame:
    """One row: facts, matchable ones, those with evidence, mean confidence in percent, verdict counts."""
    fit = matchable() & ((F.col("period") != "unknown") | F.col("metric_canonical").startswith("attr."))
    whole = facts.agg(
        F.count(F.lit(1)).alias("total_facts"), F.count_if(fit).alias("matchable_facts"), F.count_if(~fit).alias("low_confidence_facts"),
        F.count_if((F.col("exact_quote") != "") & (F.col("page_number") > 0)).alias("facts_with_evidence"),
        F.bround(F.coalesce(F.avg("confidence"), F.lit(0.0)) * 100, 1).alias("avg_confidence_pct"),
    )
    verdicts = [F.count_if(F.col("relationship_type") == v).alias(n) for v, n in ((AGREE, "corroborations"), (CONFLICT, "contradictions"), (EXPLAINED, "contextually_explained"), (REVIEW, "needs_review"))]
    return whole.join(rels.agg(F.count(F.lit(1)).alias("total"), F.count_if("cross_document").alias("cross_document"), *verdicts))


# What a user interface asks of the same tables


# What verdicts and divergence factors are called on screen.
VERDICT_LABELS = {
    "CORROBORATED": "Corroborated", "CONTRADICTION": "Contradiction", "CONTEXTUALLY_EXPLAINED": "Explained by context", "INSUFFICIENT_EVIDENCE": "Needs review",
    "NO_MATCH": "No match",
}
FACTOR_LABELS = {
    "DIFFERENT_PERIODS": "different periods", "SCOPE_OR_BASIS": "scope or accounting basis", "DATA_VINTAGE": "estimate against a reported figure",
    "PARTIAL_PERIOD": "partial period", "STATUS_CHANGED_OVER_TIME": "status changed over time", "VALUE_CONFLICT": "values differ",
    "COMPETING_ESTIMATES": "competing estimates", "ATTRIBUTE_CONFLICT": "attribute differs", "STATUS_CONFLICT": "status differs",
    "PARTIAL_TEXT_MATCH": "partial text match", "SAME_LABEL_DIFFERENT_SUBJECTS": "same label, probably different subjects",
    "IDENTIFIER_REVISED": "identifier revised", "EXCLUSIONS_DIFFER": "different exclusions", "DIFFERENT_DEFINITION": "defined differently",
    "FAMILY_MATCH_ONLY": "related labels, not the same measurement",
}


def _labelled(code: Column, labels: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code)


def verdict_label(code: Column) -> Column:
    return _labelled(code, VERDICT_LABELS)


def factor_label(code: Column) -> Column:
    """What a factor is called; one without a name is its code in small words."""
    return F.coalesce(_labelled(code, FACTOR_LABELS), F.lower(F.replace(code, F.lit("_"), F.lit(" "))))


def short_name(name: Column) -> Column:
    """A file's name without its ending, the number in front, and dashes."""
    return F.replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"^\d+-", ""), F.lit("-"), F.lit(" "))


def fact_list(facts: DataFrame, document: str | None = None, method: str | None = None, matched: bool = False, q: str | None = None, top: int | None = 60) -> DataFrame:
    """Facts of a document and a method, matchable ones if asked, with a text anywhere in what a row shows; attributes last,
    surest first."""
    if document:
        facts = facts.where(F.col("document_name") == document)
    if method:
        facts = facts.where(F.col("extraction_method") == method)
    if matched:
        facts = facts.where(matchable())
    if q:
        shown = F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in ("metric", "metric_canonical", "entity", "raw_value", "exact_quote")]), " ")
        facts = facts.where(F.lower(shown).contains(q.lower()))
    rows = facts.orderBy(F.col("metric_canonical").startswith("attr."), F.desc("confidence"), "metric_canonical", "period", "fact_seq")
    return rows if top is None else rows.limit(top)


def disagrees() -> Column:
    """Whether the figures of a pair differ for the same period, with or without a reason."""
    return (F.col("relationship_type") == CONFLICT) | ((F.col("relationship_type") == EXPLAINED) & ~F.col("divergence_factor").eqNullSafe(F.lit("DIFFERENT_PERIODS")))


def _listed(kind: str = "ALL", scope: str = "all", metric: str | None = None, pair: tuple[str, str] | None = None) -> Column:
    """What `relationship_list` asks of a relationship itself."""
    out = F.lit(True) if pair is None else _of_pair(*pair)
    if kind == "RECONCILED":
        out = out & (F.col("relationship_type") == EXPLAINED) & disagrees()
    elif kind == "NOT_COMPARABLE":
        out = out & (F.col("relationship_type") == EXPLAINED) & ~disagrees()
    elif kind != "ALL":
        out = out & (F.col("relationship_type") == kind)
    if scope in ("cross", "intra"):
        out = out & (F.col("cross_document") == F.lit(scope == "cross"))
    return out & (F.col("metric_canonical") == metric) if metric else out


def _holds(q: str | None) -> Column:
    """Whether a text is anywhere in what a row shows."""
    shown = F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in ("a_raw_value", "b_raw_value", "a_entity", "metric_canonical", "a_exact_quote", "b_exact_quote")]), " ")
    return F.lower(shown).contains(q.lower()) if q else F.lit(True)


def relationship_list(enriched: DataFrame, kind: str = "ALL", scope: str = "all", metric: str | None = None, pair: tuple[str, str] | None = None, q: str | None = None) -> DataFrame:
    """Relationships under a chip (a verdict, RECONCILED, NOT_COMPARABLE or ALL), across or within documents, of one metric, of
    two documents, and with a text anywhere in what a row shows. enriched: with quotes a_exact_quote and b_exact_quote."""
    return enriched.where(_listed(kind, scope, metric, pair) & _holds(q))


def relationship_lists(rels: DataFrame, facts: DataFrame, asked: dict[str, dict]) -> DataFrame:
    """Several lists in one pass over relationships: columns of `enrich` and list, the name of one; asked: what `relationship_list` takes, by name.

    Relationships that are on no list go before they meet their facts.
    """
    conditions = {name: _listed(**{k: v for k, v in how.items() if k != "q"}) for name, how in asked.items()}
    names = F.array_compact(F.array(*[F.when(c, name) for name, c in conditions.items()]))
    rows = enrich(rels.withColumn("list", F.explode(names)), facts, ("entity", "raw_value", "exact_quote"))
    held = F.lit(False)
    for name, how in asked.items():
        held = held | ((F.col("list") == name) & _holds(how.get("q")))
    return rows.where(held)


def facets(facts: DataFrame) -> DataFrame:
    """The choices that a list of facts offers: documents, methods and metrics that occur together."""
    return facts.select("document_id", "extraction_method", "metric_canonical").distinct()


def fact_lookup(facts: DataFrame, fact_id: str) -> DataFrame:
    """The fact with an id; no row if there is none."""
    return facts.where(F.col("id") == fact_id)


def chip_counts(rels: DataFrame) -> DataFrame:
    """How many relationships each filter chip would leave; a relationship may be under several. What context explains is
    under RECONCILED if its figures disagree for the same period, else under NOT_COMPARABLE."""
    explained = F.col("relationship_type") == EXPLAINED
    chips = F.array(
        F.lit("ALL"), F.when(~explained, F.col("relationship_type")), F.when(explained, F.when(disagrees(), "RECONCILED").otherwise("NOT_COMPARABLE")),
        F.when(F.col("cross_document"), "CROSS").otherwise("INTRA"),
    )
    return rels.select(F.explode(F.array_compact(chips)).alias("chip")).groupBy("chip").agg(F.count(F.lit(1)).alias("n"))


def _of_pair(one: str, other: str) -> Column:
    return F.sort_array(F.array("a_document_id", "b_document_id")) == F.sort_array(F.array(F.lit(one), F.lit(other)))


def pair_filter(rels: DataFrame, one: str, other: str) -> DataFrame:
    """Relationships of two documents, whichever is first."""
    return rels.where(_of_pair(one, other))


def trend_pivot(facts: DataFrame, metric: str, entity: str, documents: list[str]) -> DataFrame:
    """A metric's values by period, a column for each document that has one value a period, else null."""
    rows = facts.where(_dated() & (F.col("metric_canonical") == metric) & (F.col("entity_canonical") == entity))
    one = F.when(F.count_distinct("normalized_numeric_value") == 1, F.min("normalized_numeric_value"))
    return rows.groupBy("period").pivot("document_id", documents).agg(one)


def category_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("metric_category").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("metric_canonical").alias("metrics"))


def document_labels(facts: DataFrame) -> DataFrame:
    """A name for each document: what it is about, if that is a different thing for each, else its own name."""
    own = facts.groupBy("document_id").agg(F.min("document_name").alias("document_name"), F.min_by("entity", "fact_seq").alias("entity"))
    all_ = own.agg(F.count_distinct("entity").alias("kinds"), F.count(F.lit(1)).alias("n"))
    return own.join(all_).select("document_id", F.when(F.col("kinds") == F.col("n"), F.col("entity")).otherwise(F.regexp_replace("document_name", r"\.pdf$", "")).alias("label"))


def bars(counts: DataFrame, value: str) -> DataFrame:
    """value with its share of the largest."""
    top = counts.agg(F.max(value).alias("largest"))
    return counts.join(top).withColumn("share", F.try_divide(F.col(value).cast("double"), F.col("largest").cast("double"))).drop("largest")


def locate(quote: Column, page: Column, stored: Column) -> Column:
    """Where a quote is on a page: the stored place, else where it or its first six words are found, else null."""
    words = F.array_join(F.slice(F.split(quote, r"\s+"), 1, 6), " ")
    there = (stored >= 0) & (F.substring(page, stored + 1, F.char_length(quote)) == quote)
    return F.coalesce(F.when(there, stored), F.nullif(F.position(quote, page), F.lit(0)) - 1, F.nullif(F.position(words, page), F.lit(0)) - 1)


#: Characters of all quotes together up to which they are looked for in one pass, with an automaton in every task.
AUTOMATON = 1 << 20


def quoted(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id, at) of every quote that a document contains, at its first place. docs: doc_id, text; quotes: item_id, quote.

    Quotes of up to AUTOMATON characters in all, a stated query set, meet every document in one pass over its text; more of
    them are joined by words. Both give the same rows. Null texts and null quotes give none.
    """
    quotes = quotes.select("item_id", "quote").where("quote is not null")
    size = quotes.agg(F.coalesce(F.sum(F.char_length("quote") + 1), F.lit(0)).alias("n")).first().n
    return _by_automaton(docs, quotes) if size <= AUTOMATON else _by_words(docs, quotes)


def _by_automaton(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    known = quotes.collect()  # at most AUTOMATON characters
    by: dict[str, list] = {}
    for r in known:
        by.setdefault(r.quote, []).append(r.item_id)
    empty = by.pop("", [])
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(quotes.dtypes)['item_id']}, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for quote in by:
            machine.add_word(quote, quote)
        machine.make_automaton()
        for batch in batches:
            rows, items, places = [], [], []
            for i, text in enumerate(batch.column(1)):
                value = text.as_py()
                if value is None:
                    continue
                first: dict[str, int] = {"": 0} if empty else {}
                for end, quote in machine.iter(value) if by else ():
                    first.setdefault(quote, end - len(quote) + 1)
                for quote, at in first.items():
                    for item in by.get(quote, empty):
                        rows.append(i)
                        items.append(item)
                        places.append(at)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(items, item_type), pa.array(places, pa.int32())], ["doc_id", "item_id", "at"])

    item_type = to_arrow_type(quotes.schema["item_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def _by_words(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """A quote's inner words are whole words of the document wherever the passage stands, so it meets only documents that
    hold its second to fourth word; one without three inner words meets all documents."""
    words = F.split("text", r"\s+")
    triple = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    triples = docs.select("doc_id", words.alias("words")).where(F.size("words") >= 3).select("doc_id", F.explode(F.array_distinct(triple)).alias("key"))
    # What stands before the first blank and behind the last may be parts of words.
    inner = quotes.withColumn("inner", F.split("quote", r"\s+")).withColumn("inner", F.slice("inner", F.lit(2), F.greatest(F.size("inner") - 2, F.lit(0))))
    keyed = inner.where(F.size("inner") >= 3).select("item_id", "quote", F.array_join(F.slice("inner", 1, 3), " ").alias("key"))
    hits = triples.join(keyed.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    long = hits.join(docs.select("doc_id", "text"), "doc_id").join(keyed.drop("key"), "item_id").where("contains(text, quote)")
    short = docs.select("doc_id", "text").join(inner.where(F.size("inner") < 3).select("item_id", "quote"), F.expr("contains(text, quote)"))
    rows = long.select("doc_id", "item_id", "text", "quote").union(short.select("doc_id", "item_id", "text", "quote"))
    return rows.select("doc_id", "item_id", locate(F.col("quote"), F.col("text"), F.lit(None).cast("int")).cast("int").alias("at"))
