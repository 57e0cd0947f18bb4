"""Personal data: base patterns, and terms that give a protected entity away (information-theoretic sanitisation).

A base match (email, ip, card, phone) is a protected entity. The words of the documents that hold it are candidates
for disclosing it: of a term t and an entity e, with probabilities estimated over all documents, the disclosure is
PMI(t; e) / IC(e), which is 1 if t only ever occurs together with e. What lies inside a base match is no word of a
document. A term that is in as many different documents of the entity as its support asks for (copies count once) and
discloses at least THRESHOLD of it is a span of its own in the documents that hold the entity, and is generalised there
like the entity itself. The support is the number of the entity's different documents, from 2 to SUPPORT: in a single
document every rare word would pass, since nothing tells them apart. All of it is SQL functions: match offsets come from
the lengths of the pieces between the matches.

Defined results: a null text is an empty one without spans; rows that repeat count as copies; spans may overlap between
kinds; an empty table gives an empty result; other columns are ignored here and kept by `sanitize`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import fresh, materialize, row_key, whole_text

KINDS = ("email", "ip", "card", "phone", "term")
# Possessive and anchored forms of the patterns: the same matches, without backtracking into long runs. A match begins
# where the last one ended (\G) or where its first character class begins.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters that each kind cannot do without, looked for first.
NEEDS = {"email": "@", "ip": ".", "card": "[0-9][0-9 -]{10}", "phone": "+"}
#: Different documents that a term must share with an entity that has as many or more; the share of an entity's
#: information content that a term may disclose.
SUPPORT, THRESHOLD = 3, 0.8
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Elements of a piece of an array that is run over at a time.
PIECE = 64


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Before each element, what op makes of 0 and all elements in front of it; in pieces, since an array that grows by
    one is copied every time."""

    def over(part: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, none, lambda acc, x: F.struct(op(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    n = F.ceil(F.size(values) / PIECE).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * PIECE + 1, F.lit(PIECE)))
    whole = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: op(a, x).cast("int")))
    return F.when(n > 0, F.flatten(F.zip_with(parts, over(whole, F.lit(0)), over))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: Column) -> Column:
    """All matches in order: array of (start, end, value), offsets in code points from 0, end exclusive."""
    values = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)), F.lit(1), F.size(values))
    begins = running(F.zip_with(gaps, values, lambda gap, value: gap + F.char_length(value)), lambda a, b: a + b)
    starts = F.zip_with(begins, gaps, lambda a, b: a + b)
    return F.zip_with(starts, values, lambda at, value: F.struct(at.alias("start"), (at + F.char_length(value)).alias("end"), value.alias("value")))


def _luhn(digits: Column) -> Column:
    """Digit sum with every second digit from the right doubled, modulo 10."""
    each = F.split(F.reverse(digits), "")
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.ltrim(x, F.lit("0")).rlike("^([0-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(digits).between(12, 19) & (_luhn(digits) == 0)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _valid_match(kind: str, m: Column) -> Column:
    return _valid(kind, m["value"])


def _shaped(kind: int, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """SPAN of the base patterns, by start, then kind."""
    none = F.array().cast(SPAN)
    kinds = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        found = F.filter(matches(text, F.lit(pattern)), partial(_valid_match, kind))
        shaped = F.transform(found, partial(_shaped, i))
        likely = text.rlike(NEEDS[kind]) if kind == "card" else text.contains(NEEDS[kind])
        kinds.append(F.when(likely & text.rlike(pattern), shaped.cast(SPAN)).otherwise(none))
    return F.array_sort(F.concat(*kinds))


def counted(spans: Column, kind: str) -> Column:
    """How many of the spans are of the kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    """Distinct lower-case words (letters, marks and digits, of any length), without what surrounds them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"]))))


def revealing_terms(docs: DataFrame, based: DataFrame, text: str, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term) above the disclosure threshold. based: rk, text, spans of documents that have spans.

    Documents with the same words outside base matches are one context. Entities of one context go before any word is
    dealt out; of the others each task sends an (entity, term) once, however often they meet there.
    """
    outside = redact(F.col("text"), F.col("spans"), (" ",) * len(KINDS))
    own = based.select("spans", "text", _words(outside).alias("words")).withColumn("context", F.xxhash64("words"))
    held = own.select("context", F.explode(_entities(F.col("spans"))).alias("entity")).groupBy("entity", "context").agg(F.count(F.lit(1)).alias("n"))
    held = materialize(held, "held")
    having = held.groupBy("entity").agg(F.count(F.lit(1)).alias("needed"), F.sum("n").alias("docs_e")).where("needed > 1")
    having = materialize(having.withColumn("needed", F.least("needed", F.lit(support))), "having")
    if having.isEmpty():
        return having.select("entity", F.lit("").alias("term"))
    pairs = held.join(having.select("entity"), "entity", "left_semi")
    words = own.select("context", "words").join(pairs.select("context").distinct(), "context", "left_semi").dropDuplicates(["context"])
    near = pairs.join(words, "context").select("entity", "n", F.explode("words").alias("term"))
    joint = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("both"))
    joint = materialize(joint.join(having, "entity").where("contexts >= needed"), "joint")
    total = docs.count()
    terms = materialize(joint.select("term").distinct(), "terms")
    if terms.isEmpty():
        return joint.select("entity", "term")
    # Every word's document count is summed where the documents lie; only the counts move to meet the candidates.
    spread = docs.select(F.explode(_words(whole_text(text))).alias("term")).groupBy(F.xxhash64("term").alias("key")).agg(F.count(F.lit(1)).alias("docs_t"))
    spread = terms.withColumn("key", F.xxhash64("term")).join(spread, "key").drop("key")
    # Documents that have the word only inside base matches do not count.
    inside = own.select(F.explode(F.array_except(_words(F.col("text")), F.col("words"))).alias("term")).join(terms, "term", "left_semi")
    spread = spread.join(inside.groupBy("term").agg(F.count(F.lit(1)).alias("inside")), "term", "left")
    p_t, p_e = (F.col("docs_t") - F.coalesce("inside", F.lit(0))) / total, F.col("docs_e") / total
    told = F.log(F.col("both") / total / (p_t * p_e)) / -F.log(F.greatest(F.least(p_e, F.lit(1 - 1e-12)), F.lit(1e-300)))
    return joint.join(spread, "term").where(told >= threshold).select("entity", "term")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(rk, doc_id, base SPAN, spans SPAN) for every row."""
    rows = docs.select(row_key(id_col, text).alias("rk"), F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    base = rows.withColumn("base", base_spans(F.col("text")))
    found = materialize(base.select("rk", "doc_id", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "base")
    based = found.where("text is not null")
    told = materialize(revealing_terms(docs, based.select("rk", "text", F.col("base").alias("spans")), text), "told")
    if told.isEmpty():
        return found.select("rk", "doc_id", "base", F.col("base").alias("spans"))
    entities = based.select("rk", F.explode(_entities(F.col("base"))).alias("entity")).distinct()
    terms = entities.join(told, "entity").groupBy("rk").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    joined = found.join(terms, "rk", "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    extra = F.transform(matches(F.col("text"), pattern), partial(_shaped, KINDS.index("term"))).cast(SPAN)
    return joined.select("rk", "doc_id", "base", F.when(F.col("terms").isNotNull(), F.array_sort(F.concat("base", extra))).otherwise(F.col("base")).alias("spans"))


def redact(text: Column, spans: Column, shown: tuple[str, ...] = tuple(f"[{k.upper()}]" for k in KINDS)) -> Column:
    """The text with each span replaced by what is shown for its kind; of overlapping spans the first names the whole."""
    names = F.array(*[F.lit(k) for k in shown])
    done = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

    def piece(s: Column, at: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.get(names, s["kind"]))).otherwise("")

    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.concat(F.array_join(F.zip_with(spans, done, piece), ""), F.substring(text, last + 1, F.char_length(text)))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with personal data in text replaced, and n_chars (if there is such a column) counted again where it was."""
    key, span = fresh(docs, "rk", "spans")
    found = find(docs, id_col, text).where(F.size("spans") > 0).select(F.col("rk").alias(key), F.col("spans").alias(span)).dropDuplicates([key])
    found = materialize(found, "found")
    joined = docs.withColumn(key, row_key(id_col, text)).join(found, key, "left")
    clean = joined.withColumn(text, F.when(F.col(span).isNotNull(), redact(F.col(text), F.col(span))).otherwise(F.col(text)))
    if n_chars in docs.columns:
        kind = dict(docs.dtypes)[n_chars]
        clean = clean.withColumn(n_chars, F.when(F.col(span).isNotNull(), F.char_length(text).cast(kind)).otherwise(F.col(n_chars)))
    return clean.select(docs.columns)
