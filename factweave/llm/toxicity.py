"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of a lexicon (words and word beginnings that the labelled sample ties to toxic
documents), their nearness to second-person words, rates of capitals, of punctuation and of obfuscated words, and its length. Words are
compared in a plain form: lower case, look-alike digits and signs read as letters, marks inside and around dropped, runs
of a letter shortened, and single spaced-out letters joined.

Defined results: a null text is an empty one and scored like it; without labels of both kinds every score is the labels'
mean (0 without any); rows that repeat are scored each; extra columns are ignored, and kept by `drop_toxic`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import boosting
from factweave.llm.common import fresh
from factweave.llm.labelled import labelled_texts

#: Labelled rows that the model is fitted on at most; words of the lexicon.
SAMPLE, LEXICON = 20_000, 320
#: Lengths of the word beginnings that may be in the lexicon.
STEMS = (5, 6, 7)
_LOOKS = str.maketrans("013457@$!|", "oieastasil")
_YOU = frozenset("you your yours youre yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_MARKS = re.compile(r"[^\w]|[\d_]")
_RUNS = re.compile(r"(.)\1{2,}")
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_NAMES = ("strong", "weak", "log_strong", "top", "mean_weight", "stems", "log_stems", "top_stem", "masked", "masked_hits", "near_you", "you", "capitals", "exclaims", "asks", "marks", "digits", "length", "word_length", "spread")


def plain(token: str) -> str:
    """The plain form of a lower-case token."""
    word = _MARKS.sub("", token)
    return _RUNS.sub(r"\1", word)


def unmasked(token: str) -> str:
    """The plain form with look-alikes read as letters."""
    core = token.strip(".,;:!?\"'()[]{}#%&*$|-_…")
    return _RUNS.sub(r"\1", _MARKS.sub("", core.translate(_LOOKS)))


def forms(token: str) -> set[str]:
    """The lexicon's keys for a token: its plain forms, and its longer beginnings as prefix*."""
    simple, deep = plain(token), unmasked(token)
    return {w for w in (simple, deep) if len(w) >= 2} | {simple[:k] + "*" for k in STEMS if len(simple) > k}


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; three or more single letters in a row are one."""
    found = text.lower().split()
    if list(map(len, found)).count(1) < 3:
        return found
    out: list[str] = []
    run: list[str] = []
    for t in [*found, "  "]:
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        out.append(t)
    return out[:-1]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: boosting.Boosted
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        margin = self.trees.margin(features(texts, self.lexicon))
        return np.clip(0.999 * np.interp(margin, self.knots, self.values) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def features(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """Dense features; lexicon: weights of words and, as prefix*, of word beginnings."""
    words = {w: z for w, z in lexicon.items() if w[-1:] != "*"}
    stems = {w[:-1]: z for w, z in lexicon.items() if w[-1:] == "*"}
    strong_from = 0.5 * max(words.values(), default=1.0)
    known: dict[str, tuple[float, float, bool, bool] | None] = {}

    def look(token: str) -> tuple[float, float, bool, bool] | None:
        simple, deep = plain(token), unmasked(token)
        weight = max(words.get(simple, 0.0), words.get(deep, 0.0))
        stem = max([stems.get(simple[:k], 0.0) for k in STEMS if len(simple) > k], default=0.0)
        masked = deep != simple and any(c.isalpha() for c in token)
        return (weight, stem, masked, simple in _YOU) if weight or stem or masked or simple in _YOU else None

    out = np.zeros((len(texts), len(_NAMES)))
    for i, text in enumerate(texts):
        found = tokens_of(text)
        many = Counter(found)
        if len(known) > 100_000:
            known.clear()
        n, hits, weak, masked, hidden, you, stem_n, top, total, top_stem = max(1, len(found)), 0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0
        strong_words, you_words = set(), set()
        for t, c in many.items():
            if t in known:
                fact = known[t]
            else:
                fact = known[t] = look(t)
            if fact is None:
                continue
            weight, stem, odd, second = fact
            masked += c * odd
            if second:
                you += c
                you_words.add(t)
            if weight:
                total, top, hidden = total + c * weight, max(top, weight), hidden + c * odd
                if weight >= strong_from:
                    hits += c
                    strong_words.add(t)
                else:
                    weak += c
            if stem:
                stem_n, top_stem = stem_n + c, max(top_stem, stem)
        close = 0
        if strong_words and you_words:
            spots = np.array([-(10**9), *(k for k, t in enumerate(found) if t in you_words), 10**9])
            at = np.array([k for k, t in enumerate(found) if t in strong_words])
            near = np.searchsorted(spots, at)
            close = int((np.minimum(at - spots[near - 1], spots[near] - at) <= 3).sum())
        body = text.encode("utf-8", "replace")
        size = max(1, len(body))
        upper = len(body) - len(body.translate(None, _LETTERS.upper()))
        lower = len(body) - len(body.translate(None, _LETTERS))
        digits = len(body) - len(body.translate(None, b"0123456789"))
        marks = len(body) - len(body.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        out[i] = (
            100 * hits / n, 100 * weak / n, math.log1p(hits), top, total / n, 100 * stem_n / n, math.log1p(stem_n), top_stem,
            masked / n, hidden, close, you / n, upper / max(1, upper + lower), 100 * text.count("!") / size, 100 * text.count("?") / size,
            marks / size, digits / size, math.log1p(len(found)), size / n, len(many) / n,
        )
    return out


def _document_counts(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(word, n): documents with each lexicon key, among those in `only` if it is told."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many: Counter = Counter()
        for pdf in batches:
            for text in pdf.text:
                found = {w for t in set(tokens_of(text)) for w in forms(t)}
                many.update(found if only is None else found & only)
        yield pd.DataFrame(list(many.items()), columns=["word", "n"])

    return rows.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words by the z-score of their log odds between toxic and other documents (document counts, additive prior)."""
    sizes = sample.groupBy("label").count().collect()
    bad_n, good_n = sum(r["count"] for r in sizes if r.label), sum(r["count"] for r in sizes if not r.label)
    # Words of five toxic documents or more, of a bounded sample; the other documents are asked for these alone.
    bad = {r.word: r.n for r in _document_counts(sample.where("label = 1")).where("n >= 5").collect()}
    if not bad:
        return {}
    good = {r.word: r.n for r in _document_counts(sample.where("label = 0"), frozenset(bad)).collect()}

    def z(word: str) -> float:
        a, b = bad[word] + 0.5, good.get(word, 0) + 0.5
        odds = math.log(a / (bad_n + 1 - bad[word] + 0.5)) - math.log(b / (good_n + 1 - good.get(word, 0) + 0.5))
        return odds / math.sqrt(1 / a + 1 / b)

    ranked = sorted(((-z(w), w) for w in bad))[:LEXICON]
    return {w: -score for score, w in ranked if score < -3}


def fit(docs: DataFrame, labels: DataFrame, learn, rows: int = SAMPLE) -> Model:
    """The model from at most `rows` labelled documents whose id meets `learn`; every fourth only calibrates."""
    sample = labelled_texts(docs, labels, "toxic", learn, rows)
    lexicon = _lexicon(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": list(features(list(pdf.text), lexicon)), "y": pdf.label, "key": [zlib.crc32(f"{i} calibrate".encode()) for i in pdf.id]})

    found = sample.select("id", "text", "label").mapInPandas(run, "x array<double>, y int, key long").toPandas().sort_values("key", kind="stable")
    x, y = np.array(found.x.tolist(), float).reshape(len(found), len(_NAMES)), found.y.to_numpy(float)
    hold = found.key.to_numpy() % 4 == 0
    trees = boosting.fit(x[~hold], y[~hold]) if len(y) else boosting.Boosted(-20.0)
    knots, values = boosting.isotonic(trees.margin(x[hold]), y[hold]) if hold.any() and len(trees.leaves) else (np.array([0.0]), np.array([y.mean() if len(y) else 0.0]))
    return Model(lexicon, trees, knots, values)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if not told) and `out`: the calibrated probability of toxic."""
    keep = docs.columns if keep is None else keep
    at, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows themselves stay Arrow columns: through pandas, a null would turn large ids into rounded doubles.
        for batch in batches:
            found = model.score([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, pa.float64())], [*keep, out])

    return docs.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, learn=None, rows: int = SAMPLE) -> DataFrame:
    """docs without the rows whose score is at least 0.5, all columns as they were; learns from all labelled rows if not told."""
    model = fit(docs, labels, F.lit(True) if learn is None else learn, rows)
    (value,) = fresh(docs, "score")
    return score(docs, model, "text", value).where(F.col(value) < 0.5).drop(value)


