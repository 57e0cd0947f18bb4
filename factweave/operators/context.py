"""What a document is about: names, country, date, period and kind, as aggregations over its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import periods
from factweave.functions import vocabulary as V

# How names, organisations and headings look.
_COMPANY = r"((?:[A-Z][A-Za-z0-9&'\-]*\.?\s+){1,5}(?:Limited|Ltd\.?|Inc\.?|Incorporated|Corporation|Corp\.?|PLC|LLC|LLP|Pvt\.?\s?Ltd\.?|Private Limited)(?![a-z]))"
_NAME_STOP = r"(?i)^(?:(?:for|the|of|by|and|with|to|in|on|at|yours|sincerely|faithfully|dear|from|our|company|limited|ltd|a|an|as|or|sub|re)[.,]*\s+)+"
_NO_COMPANY = r"(?i)\b(?:annual report|prospectus|table|contents|offer|act|regulations?)\b"
_PHRASE = r"\b((?:(?:[A-Z]{2,5}|[A-Z][a-z]{1,})\s+){1,3}(?:[A-Z]{2,5}|[A-Z][a-z]{2,}))\b"
_HEADING = r"(?i)\b(?:chapter|page|table|chart|box|figure|annex|appendix|contents|source|note|introduction|section|part|preface|abbreviations)\b"
_ROLE = r"\b(?:Company|Officer|Director|Board|Secretary|Deputy|Chief|Head|President|Managing|Executive|Independent|Nominee|Member|Committee|Limited|Post|Annual|General|Meeting|Financial|Year|Date|Report)\b"
_ORGANISATION = r"(?i)\b(?:bank|fund|ministry|department|government|institute|university|corporation|corp|council|authority|commission|agency|group|association|foundation|society|board|office|limited|ltd|inc|llc|llp|plc|ag|se|company|co)\b"
_CONTENTS = r"(?i)\b(?:page|chapter|table|figure|annex)\s*(?:no\.?|number)\b|\.{3,}|^contents\b"
#: Pages that count as the front of a document.
FRONT = 3


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def company_votes(pages: DataFrame) -> DataFrame:
    """document_id, name, votes and first place of company names on any page; the winner is the first by votes, then place."""
    found = pages.select("document_id", "page_number", F.posexplode(F.regexp_extract_all("text", F.lit(_COMPANY), F.lit(1))).alias("at", "name"))
    bare = F.regexp_replace(F.regexp_replace(_squeezed(F.col("name")), r"^[ ,.]+|[ ,.]+$", ""), _NAME_STOP, "")
    kept = found.withColumn("name", bare).where(F.char_length("name").between(5, 59) & ~F.col("name").rlike(_NO_COMPANY))
    return kept.groupBy("document_id", "name").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("page_number", "at")).alias("first"))


def repeated_phrases(pages: DataFrame, least: int = 4, least_pages: int = 3) -> DataFrame:
    """document_id, phrase, total, pages of capitalised phrases that a document repeats across its pages."""
    found = pages.select("document_id", "page_number", F.explode(F.regexp_extract_all("text", F.lit(_PHRASE), F.lit(1))).alias("phrase"))
    kept = found.withColumn("phrase", _squeezed(F.col("phrase"))).where(~F.col("phrase").rlike(_HEADING) & ~F.col("phrase").rlike(_ROLE))
    return kept.groupBy("document_id", "phrase").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("page_number").alias("pages")).where((F.col("total") >= least) & (F.col("pages") >= least_pages))


def author_organisation(author: Column) -> Column:
    """The organisation that a file's author field names, in brackets or alone; null for a person."""
    name = F.trim(F.coalesce(author, F.lit("")))
    inside = F.trim(F.regexp_extract(name, r"\(([^,)]+)(?:,[^)]*)?\)", 1))
    name = F.when((inside != "") & inside.rlike(_ORGANISATION), inside).otherwise(name)
    return F.when(F.char_length(name).between(2, 60) & (~name.rlike(r"\s") | name.rlike(_ORGANISATION)), name)


def title_line(text: Column) -> Column:
    """The first line of 3 to 12 words that is no furniture of a table of contents."""
    def fits(x: Column) -> Column:
        return F.size(F.split(x, r"\s+")).between(3, 12) & x.rlike(r"[A-Za-z]{3}") & ~x.rlike(r"\d{3,}|\t") & ~x.rlike(_CONTENTS)

    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), fits), 0)


def occurrences(text: Column, word: Column | str) -> Column:
    """How often a word stands in a text, without overlaps."""
    word = F.lit(word) if isinstance(word, str) else word
    return ((F.char_length(text) - F.char_length(F.replace(text, word, F.lit("")))) / F.char_length(word)).cast("long")


def subject_country(pages: DataFrame, least: int = 5) -> DataFrame:
    """document_id and the country it names most, at least five times; of equals the first of the list."""
    counts = [F.sum(occurrences(F.lower("text"), c.lower())).alias(f"n{i}") for i, c in enumerate(V.COUNTRIES)]
    rows = pages.groupBy("document_id").agg(*counts)
    best = F.array_max(F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("name")) for i, c in enumerate(V.COUNTRIES)]))
    return rows.select("document_id", F.when(best["n"] >= least, best["name"]).alias("subject_country"))


def fronts(pages: DataFrame) -> DataFrame:
    """document_id, head (text of its first pages), first_text (page one)."""
    rows = F.array_sort(F.collect_list(F.when(F.col("page_number") <= FRONT, F.struct("page_number", "text"))))
    texts = F.transform(rows, lambda s: s["text"])
    return pages.groupBy("document_id").agg(F.array_join(texts, "\n").alias("head"), F.coalesce(F.get(texts, 0), F.lit("")).alias("first_text"))


def _report_year(head: Column) -> Column:
    pattern = r"(?i)annual report\s+(20\d\d)\s?[-–]\s?(\d{2,4})"
    first, last = F.regexp_extract(head, pattern, 1), F.regexp_extract(head, pattern, 2)
    return F.when(first != "", F.when(F.length(last) == 4, last).otherwise(F.concat(F.substring(first, 1, 2), F.substring(last, 1, 2))))


def document_date(head: Column) -> Column:
    """The day that a document is dated or speaks as of, else the end of its report's year, else the first day it names."""
    told = F.regexp_extract(head, rf"(?i)\b(?:dated|as of|as on)\s+({V.DAY})", 1)
    year, any_day = _report_year(head), F.regexp_extract(head, rf"({V.DAY})", 1)
    return F.when(told != "", periods.english_date(told)).when(year.isNotNull(), F.concat(year, F.lit("-03-31"))).when(any_day != "", periods.english_date(any_day))


def document_period(head: Column) -> Column:
    """The fiscal year that a document reports on: its report's years, its report's year, the year that ended, the FY named most."""
    year = _report_year(head)
    single = F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in (r"(?i)annual report\s+(20\d\d)", r"(?i)(20\d\d)\s+annual report")])
    ended = periods.english_date(F.regexp_extract(head, rf"(?i)year\s+ended\s+({V.DAY})", 1))
    named = F.regexp_extract_all(head, F.lit(r"\bFY\s?(\d{2,4})\b"), F.lit(1))
    # The most frequent, the first named of equals: positions break ties.
    ranked = F.array_max(F.transform(F.array_distinct(named), lambda y: F.struct(F.size(F.filter(named, lambda z: z == y)).alias("n"), (-F.array_position(named, y)).alias("order"), y.alias("y"))))
    modal = F.when(F.length(ranked["y"]) == 2, F.concat(F.lit("20"), ranked["y"])).otherwise(ranked["y"])
    return F.concat(F.lit("FY"), F.coalesce(year, single, F.substring(ended, 1, 4), modal))


def document_kind(head: Column, page_count: Column, institution: Column, surveys: Column) -> Column:
    low = F.lower(head)
    shown = low.rlike(r"\b(?:earnings|investor|results)\b.*\b(?:presentation|update)\b") | ((page_count < 40) & low.contains("q4"))
    macro = institution.isNotNull() | low.rlike(r"economic survey|article iv|staff report") | (surveys >= 3)
    return F.when(low.contains("prospectus"), "prospectus").when(low.contains("annual report"), "annual_report").when(shown, "presentation").when(macro, "macro_report").otherwise("unknown")


def resolve(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents with primary_entity, subject_country, document_date, document_period and document_kind filled in."""
    one = lambda rows, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).where("rank = 1")
    front = fronts(pages)
    company = one(company_votes(pages), F.desc("votes"), F.asc("first"), "name").select("document_id", F.col("name").alias("company"), "votes")
    phrase = one(repeated_phrases(pages), F.desc("total"), F.desc("pages"), F.desc("phrase")).select("document_id", "phrase")
    surveys = pages.groupBy("document_id").agg(F.sum(occurrences(F.lower("text"), "economic survey")).alias("surveys"), *[F.sum(occurrences(F.lower("text"), n.lower())).alias(f"i{k}") for k, n in enumerate(V.INSTITUTIONS)])
    keep = [c for c in documents.columns if c not in ("primary_entity", "subject_country", "document_date", "document_period", "document_kind")]
    rows = documents.select(*keep).withColumnRenamed("id", "document_id")
    for part in (front, company, phrase, surveys, subject_country(pages)):
        rows = rows.join(part, "document_id", "left")
    low = F.lower("head")
    institution = F.coalesce(*[F.when(low.contains(n.lower()), F.lit(n)) for n in V.INSTITUTIONS])
    cited = F.coalesce(*[F.when(F.col("institution") == n, F.col(f"i{k}")) for k, n in enumerate(V.INSTITUTIONS)], F.lit(0))
    file_name = F.initcap(F.regexp_replace(F.regexp_replace("original_name", r"(?i)^[0-9]+-|\.pdf$", ""), "[-_]", " "))
    rows = rows.withColumn("institution", institution).withColumn("cited", cited)
    up_front = F.coalesce(low.contains(F.lower("company")), F.lit(False))
    publisher = F.col("institution").isNotNull() & (~up_front | (F.col("votes") < 3) | (F.col("cited") >= F.col("votes")))
    other = F.coalesce("phrase", author_organisation(F.col("pdf_author")), title_line(F.col("first_text")), F.when(F.char_length(file_name) > 3, file_name).otherwise("Unknown entity"))
    head = F.coalesce("head", F.lit(""))
    rows = rows.withColumns({
        "primary_entity": F.when(publisher, F.col("institution")).when(up_front | (F.col("votes") >= 20), F.col("company")).otherwise(other),
        "document_date": document_date(head), "document_period": document_period(head),
        "document_kind": document_kind(head, F.col("page_count"), F.col("institution"), F.coalesce("surveys", F.lit(0))),
    })
    new = ["primary_entity", "subject_country", "document_date", "document_period", "document_kind"]
    return rows.select(*["document_id" if c == "id" else c for c in keep], *new)
