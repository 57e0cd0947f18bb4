"""Numbers and units: Column functions, and the tokenizer that finds every value with its offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import vocabulary as V

_SCALE_WORD = r"(?:crores?|cr|lakhs?|lacs?|millions?|mn|mm|m\b|billions?|bn|b\b|trillions?|tn|thousands?|k)"
_PLAIN = r"\d[\d,]*(?:\.\d+)?"
# Bracketed amounts by what follows the digits inside the bracket, in the order they are rewritten.
_BRACKETED = (rf"\(({_PLAIN})\s?(%|per\s?cent)\)", rf"(?i)\(({_PLAIN})(\s?{_SCALE_WORD})\)", rf"\(({_PLAIN})()\)")


def accounting_negatives(text: Column) -> Column:
    """(452) as -452, (6.3%) as -6.3%, (452 Cr) as -452 Cr. A null stays null."""
    for pattern in _BRACKETED:
        text = F.regexp_replace(text, pattern, "-$1$2")
    return text


def to_double(text: Column) -> Column:
    """The number in text without commas; in brackets it is negative; anything else is null."""
    size = F.regexp_replace(text, r"[(),]", "").try_cast("double")
    return F.when(text.startswith("(") & text.endswith(")"), -F.abs(size)).otherwise(size)


def scale_factor(word: Column) -> Column:
    """The factor of a scale word, 1 for any other."""
    table = F.create_map(*[F.lit(x) for pair in V.SCALES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(word)), F.lit(1.0))


def rounding_half_unit(raw: Column) -> Column:
    """Half a unit of the last printed decimal, times the scale word behind the number; 0 without a number."""
    found = r"(\d[\d,]*)(?:\.(\d+))?\s*([A-Za-z]+)?"
    word = F.lower(F.regexp_extract(raw, found, 3))
    table = F.create_map(*[F.lit(x) for pair in V.ROUNDING_SCALES.items() for x in pair])
    scale = F.coalesce(F.try_element_at(table, word), F.lit(1.0))
    places = F.length(F.regexp_extract(raw, found, 2))
    return F.when(raw.rlike(r"\d"), 0.5 * F.pow(F.lit(10.0), -places) * scale).otherwise(F.lit(0.0))


def signed(value: Column, before: Column, around: Column, loss_metric: Column, change: Column) -> Column:
    """A positive value made negative where the words before it, or around a loss metric, say so."""
    told = before.rlike(r"(?:\b(?:loss of|negative|deficit of)|\(loss\))\s*$")
    losing = loss_metric & ~change & around.contains("loss") & ~before.rlike(r"\bprofit of\s*$")
    return F.when((value > 0) & (told | losing), -value).otherwise(value)


def compact(value: Column) -> Column:
    """A value in short form: 1.2T, 3.4B, 5.6M, 7.8K, or as it is."""
    size = F.abs(value)
    out = value.cast("string")
    for unit, letter in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(size >= unit, F.concat(F.bround(value / unit, 1).cast("string"), F.lit(letter))).otherwise(out)
    return out


def byte_size(size: Column) -> Column:
    """A size in B, KB or MB of 1024."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = F.when(size >= 1024**power, F.concat(F.bround(size / 1024**power, 1).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def axis_top(top: Column) -> Column:
    """The least of 1, 2, 5 or 10 times a power of ten that is not below a positive value."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(top)))
    return F.when(top <= step, step).when(top <= 2 * step, 2 * step).when(top <= 5 * step, 5 * step).otherwise(10 * step)


@dataclass
class Value:
    raw: str
    numeric: float
    normalized: float
    unit: str
    normalized_unit: str
    kind: str
    start: int
    end: int
    count_word: str = ""


_NUMBER = r"\(?-?\d{1,3}(?:,\d{2,3})+(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?"
_NOUN = r"(?:tonnes?|tons?|employees|people|persons|parcels|shipments|orders|pin[\s-]?codes|customers|days|units|vehicles|tractors|sq\.?\s?ft\.?|square\s+feet|sqft|kilomet(?:re|er)s?|km|cities|states|countries|facilities|cent(?:re|er)s|hubs|stores|branches)"
_VALUE = re.compile(
    rf"(?P<currency>(?:[₹$€£]|\bRs\.?|\bINR|\bUSD|\bUS\$|\bI(?=\s\d))\s?)?(?P<number>{_NUMBER})"
    rf"(?:\s?(?P<scale>{_SCALE_WORD})\b)?(?:\s?(?P<percent>%|per\s?cent|percent|percentage\s+points?|pp|bps))?(?:\s?(?P<noun>{_NOUN})\b)?",
    re.IGNORECASE,
)


def prepared(text: str) -> str:
    """accounting_negatives for a Python string."""
    for pattern in _BRACKETED:
        text = re.sub(pattern, r"-\1\2", text)
    return text


def _currency(written: str) -> str:
    token = written.strip().lower()
    return next((code for code, forms in V.CURRENCIES.items() if token in forms), "")


def values(text: str, masked: list[tuple[int, int]] = ()) -> list[Value]:
    """Every value of a text, left to right; digits inside masked spans are not values."""
    out = []
    for m in _VALUE.finditer(text):
        number = m["number"]
        lo, hi = m.span("number")
        if any(lo < e and s < hi for s, e in masked) or not re.search(r"[1-9]", number):
            continue
        size = float(re.sub(r"[(),]", "", number))
        size = -abs(size) if number[0] == "(" and number[-1] == ")" else size
        currency, scale, noun = m["currency"] or "", (m["scale"] or "").lower(), (m["noun"] or "").lower()
        bare = not (currency or scale or m["percent"] or noun)
        if bare and (re.fullmatch(r"(?:19|20)\d\d", number.strip("()")) or re.fullmatch(r"\d{1,2}", number) or abs(size) < 100):
            continue
        code, factor = _currency(currency), V.SCALES.get(scale, 1.0)
        if m["percent"]:
            kind, base, unit, factor = "percent", "PERCENT", "%", 0.01 if m["percent"].lower() == "bps" else 1.0
        elif code:
            kind, base, unit = "money", code, f"{code} {scale.title()}".strip()
        elif noun in V.TONNES:
            kind, base, unit = "count", "TONNES", f"{scale} tonnes".strip()
        elif not scale and not noun and abs(size) < 100:
            continue
        else:
            kind, base, unit = "count", "COUNT", f"{scale} {noun}".strip() or "count"
        out.append(Value(m[0].strip().lstrip("("), size, round(size * factor, 6), unit, base, kind, m.start(), m.end(), re.sub(r"[\s-]+", " ", noun)))
    return out


def single_value(text: str) -> tuple[float | None, float | None, str, str]:
    """(as written, in base units, unit, base unit) of the first value; any number counts; without one the unit is TEXT."""
    ready = prepared(text.strip())
    found = values(ready)
    if found:
        v = found[0]
        return v.numeric, v.normalized, v.unit, v.normalized_unit
    m = re.search(_NUMBER, ready)
    if not m:
        return None, None, "", "TEXT"
    size = float(re.sub(r"[(),]", "", m[0]))
    return size, size, "count", "COUNT"
