"""Entities, metrics, context and similarity of texts: Column functions, and the scan for metric mentions."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V

_CORPORATE = r"\b(?:" + "|".join(V.CORPORATE_WORDS) + r")\b"


def entity_slug(name: Column) -> Column:
    """Lower case, corporate words dropped, blanks as _; unknown_entity if nothing is left."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(low, _CORPORATE + r"\.?", " "), r"[^\p{L}\p{N}_\s]", " ")
    slug = F.regexp_replace(F.trim(bare), r"\s+", "_")
    return F.when(slug == "", "unknown_entity").otherwise(slug)


def person_slug(name: Column) -> Column:
    """entity_slug without a leading title."""
    return entity_slug(F.regexp_replace(F.trim(name), r"^(?:Mr|Ms|Mrs|Dr)\.?\s+", ""))


def metric_slug(label: Column) -> Column:
    """metric.<slug> of a label outside the taxonomy, the slug of 60 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}_\s.]", ""), r"[^\p{L}\p{N}_]+", "_")
    slug = F.substring(F.regexp_replace(clean, r"^_+|_+$", ""), 1, 60)
    return F.concat(F.lit("metric."), F.when(slug == "", "unknown").otherwise(slug))


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def qualifiers(text: Column) -> Column:
    """Array of the qualifiers that a lower-case sentence carries, in a fixed order."""
    window = rf"\b{V.MONTH}\s*(?:-|–|to)\s*{V.MONTH}\b"
    told = (
        ("estimate", _any(text, V.ESTIMATE_WORDS)),
        ("pro_forma", _any(text, ("pro forma", "proforma"))),
        ("exclusions_apply", _any(text, ("excluding", "excl.", "ex-"))),
        ("yoy_growth_present", _any(text, ("yoy", "year-on-year", "y-o-y"))),
        ("partial_period", text.rlike(window) | text.rlike(r"\bh[12]\b|first half|second half|nine months|six months|\bq[1-4]\b")),
        ("rate_or_capacity", text.rlike(r"\bper\s+(?:day|hour|month|annum|year)\b|\b(?:capacity|throughput|daily)\b")),
        ("cumulative", text.rlike(r"\bsince (?:inception|incorporation)\b|\bcumulative\b|\btill date\b")),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in told]))


def scope(text: Column) -> Column:
    """standalone, consolidated, industry, segment or unspecified, the first that a lower-case sentence tells."""
    industry = text.rlike(r"\b(?:industry|overall|market|sector|nationwide|across india|in india|country[- ]wide)\b") | text.rlike(r"\b(?:india|country)\s+(?:shipped|produced|consumed|generated|delivered|handled|reached)\b")
    segment = text.rlike(r"\b(?:segment|division|business unit|service line|business line|subsidiary|business)\b") | _any(text, ("other revenue", "other income"))
    segment = segment | text.rlike(r"\brevenues?\s+from\s+(?!operations\b|services\b|contracts\b)[a-z0-9\- ]+\s+services\b")
    return F.when(text.contains("standalone"), "standalone").when(_any(text, ("consolidated", "group")), "consolidated").when(industry, "industry").when(segment, "segment").otherwise("unspecified")


def sub_metric(text: Column, metric: Column, page_head: Column) -> Column:
    """What part of the metric a lower-case sentence is about; total if it names none."""
    lines = "(" + "|".join(V.BUSINESS_LINES) + ")"

    def named(line: Column) -> Column:
        return F.concat(F.lit("segment_"), F.replace(F.replace(line, F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and")))

    line = text.rlike(rf"\b{lines}\s+(?:division|business unit|segment|business)\b")
    head = F.regexp_extract(F.lower(F.trim(F.coalesce(page_head, F.lit("")))), rf"^\s*{lines}\b", 1)
    planned = (metric.contains("capex") | text.contains("guidance")) & text.rlike(r"\b(?:planned|target|range between)\b")
    return (
        F.when(_any(text, ("other revenue", "other income", "other operating")), "other_revenue")
        .when(_any(text, ("accrued revenue", "trade receivables")), "accrued_revenue")
        .when(text.contains("net capex"), "net_capex")
        .when(_any(text, ("tangible fixed assets", "tangible assets")), "tangible_assets")
        .when(planned, "planned_target")
        .when(line, named(F.regexp_extract(text, rf"\b{lines}\b", 1)))
        .when(head != "", named(head))
        .when(text.rlike(r"\b(?:division|business unit|service line|segment|subsidiary)\b"), "segment")
        .when(_any(text, ("underlying", "adjusted")), "adjusted")
        .when(_any(text, ("attributable to dpag", "attributable to shareholders")), "parent_shareholders")
        .when(_any(text, ("revenue from operations", "revenues from operations", "revenue from services")), "operations")
        .otherwise("total")
    )


def similarity_tokens(text: Column) -> Column:
    """Distinct lower-case runs of two or more letters and digits, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))), F.array(*[F.lit(w) for w in V.SIMILARITY_STOP]))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of token sets; where one is empty, 1 for equal texts and 0 for others."""
    return words_similarity(similarity_tokens(a), similarity_tokens(b), F.lower(F.trim(a)) == F.lower(F.trim(b)))


def words_similarity(x: Column, y: Column, equal: Column) -> Column:
    """token_similarity of two texts from their sets of tokens, and whether the texts are equal."""
    both = F.size(F.array_intersect(x, y))
    return F.when(equal, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1)))


def identifier_shaped(text: Column) -> Column:
    """One token of letters and digits, long enough to be an identifier."""
    t = F.trim(text)
    return ~t.rlike(r"\s") & (F.char_length(t) >= V.IDENTIFIER_LENGTH) & t.rlike(r"\p{L}") & t.rlike(r"\p{N}")


def alignment(a: str, b: str) -> tuple[float, int, int]:
    """(similarity, differing characters, length of the longer) of two identifiers, from one alignment of their characters."""
    matcher = difflib.SequenceMatcher(None, a, b)
    longest = max(len(a), len(b))
    return matcher.ratio(), longest - sum(m.size for m in matcher.get_matching_blocks()), longest


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    metric: V.Metric
    keyword: str


def _alias_table(metrics: tuple[V.Metric, ...]) -> list[tuple[re.Pattern, str, V.Metric]]:
    pairs = sorted(((k, m) for m in metrics for k in m.keywords), key=lambda p: -len(p[0]))
    return [(re.compile(rf"(?<![a-z]){re.escape(k)}(?![a-z])"), k, m) for k, m in pairs]


_ALIASES = _alias_table(V.METRICS)


def mentions(sentence: str) -> list[Mention]:
    """Taxonomy keywords in a lower-case sentence, longer ones first to claim their span, in order of place."""
    found: list[Mention] = []
    for pattern, keyword, metric in _ALIASES:
        if keyword in sentence and all(r in sentence for r in metric.requires):
            for m in pattern.finditer(sentence):
                if not any(m.start() < f.end and f.start < m.end() for f in found):
                    found.append(Mention(m.start(), m.end(), metric, keyword))
    return sorted(found, key=lambda f: f.start)


def plain_slug(name: str) -> str:
    """entity_slug for a Python string."""
    bare = re.sub(r"[^\w\s]", " ", re.sub(_CORPORATE + r"\.?", " ", (name or "").lower().strip()))
    return re.sub(r"\s+", "_", bare.strip()) or "unknown_entity"


def metric_key(label: str) -> tuple[str, str]:
    """(canonical key, category) of a free label: the first taxonomy metric it mentions, else a slug."""
    if not label:
        return "general.unknown", "general"
    clean = re.sub(r"\s+", " ", re.sub(r"[^\w\s.]", "", label.lower()).strip())
    hits = mentions(clean)
    if hits:
        return hits[0].metric.canonical, hits[0].metric.category
    return f"metric.{re.sub(r'[^\w]+', '_', clean).strip('_')[:60] or 'unknown'}", "general"
