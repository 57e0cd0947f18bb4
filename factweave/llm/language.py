"""Language identification by interpolated Kneser-Ney character models, one for each language.

Texts are lower-cased, letters kept, everything else a single blank. Each language's model interpolates absolute
discounting over orders 1 to ORDER, with continuation counts below the highest order, down to a uniform share of the
alphabet and one unknown character. The n-grams of all languages stand in one sorted array of 64-bit hashes an order,
with a row of log probabilities; the contexts stand in arrays of their own, with a row of log back-off weights. A
character costs one binary search where its n-gram is known; where it is not, its context's back-off weight counts and
the next lower order goes on, so that the characters' probabilities sum to 1 in every context. The language with the lowest
cross-entropy per character wins; its score is a softmax whose temperature is fitted on labelled documents that the counts
left out, halved where the cross-entropy is above what the language's own documents reach (rejected).

The alphabet holds the characters of the sample (the 65,535 most frequent ones); all others are the unknown one.

Defined results: `und` with score 0 if a text is null or has no letter; without any labelled row every text is `und`; rows that
repeat are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import tokens
from factweave.llm.common import materialize, whole_text

#: Labelled rows that the models are fitted on at most; order of the models.
SAMPLE, ORDER = 8_000, 4
#: Bits of a character's number in a packed n-gram; number 0 is the unknown character.
BITS = 16
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets): each text as letters with a single blank behind each run of them; nothing without a letter."""
    lowered = [t.lower() if isinstance(t, str) else "" for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(t + " " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + 1)
    letter = _is_letter()[codes]
    before = np.concatenate([[False], letter[:-1]])
    # A blank behind every run of letters; the ORDER - 1 blanks in front are added as context.
    keep = letter | before
    clean = np.where(letter, codes, 32)[keep]
    off = np.concatenate([[0], np.cumsum(keep)[ends - 1]]) if len(ends) else np.zeros(1, np.int64)
    return clean.astype(np.uint32), off


def numbered(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The characters' numbers in the sorted alphabet, from 1; 0 if they are not in it."""
    if not len(alphabet):
        return np.zeros(len(codes), np.uint64)
    spot = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    return np.where(alphabet[spot] == codes, spot + 1, 0).astype(np.uint64)


def grams(numbers: np.ndarray, off: np.ndarray, order: int, blank: int) -> np.ndarray:
    """Packed n-gram that ends at each character, the last one lowest; blanks (by their number) stand before a text."""
    first = np.arange(len(numbers)) - np.repeat(off[:-1], np.diff(off))
    out = np.zeros(len(numbers), np.uint64)
    for back in range(order - 1, -1, -1):
        c = np.full(len(numbers), blank, np.uint64)
        c[back:] = numbers[: len(numbers) - back]
        c[first < back] = blank
        out = (out << np.uint64(BITS)) | c
    return out


def last(packed: np.ndarray, n: int) -> np.ndarray:
    """The last n characters of packed n-grams."""
    return packed if n == ORDER else packed & np.uint64((1 << BITS * n) - 1)


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    spot = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return spot, sorted_keys[spot] == keys


@dataclass
class Level:
    """Of one order: sorted n-gram hashes with, for each language, the log10 probability of the last character; sorted hashes
    of the contexts with, for each language, the log10 weight of the lower order."""

    keys: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backs: np.ndarray


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray
    levels: list[Level]
    temperature: float
    limits: np.ndarray

    def packed(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        return grams(numbered(codes, self.alphabet), off, ORDER, blank_of(self.alphabet))

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """log10 of each language's probability of the last character, given those before it."""
        at = np.zeros((len(packed), len(self.languages)), np.float32)
        todo = np.arange(len(packed))
        for n in range(ORDER, 0, -1):
            level = self.levels[n - 1]
            spot, hit = found(level.keys, tokens.mix(last(packed, n)))
            at[todo[hit]] += level.logs[spot[hit]]
            todo, packed = todo[~hit], packed[~hit]
            spot, hit = found(level.contexts, tokens.mix(last(packed, n) >> np.uint64(BITS)))
            at[todo[hit]] += level.backs[spot[hit]]
        at[todo] -= np.float32(np.log10(len(self.alphabet) + 1))
        return at

    def entropies(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Cross-entropy per character [texts, languages]; texts without letters have zeros."""
        at = self.log_probabilities(self.packed(codes, off))
        n = np.diff(off)
        full = np.flatnonzero(n)
        out = np.zeros((len(n), len(self.languages)))
        if len(full):
            out[full] = -np.add.reduceat(at, off[:-1][full], 0, np.float64) / n[full][:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        codes, off = characters(texts)
        n = np.diff(off)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), n >= 0
        h = self.entropies(codes, off)
        best = h.argmin(1)
        share = softmax(h, n, self.temperature)[np.arange(len(n)), best]
        odd = h[np.arange(len(n)), best] > self.limits[best]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, np.where(odd, share / 2, share), 0.0), odd | (n == 0)


def blank_of(alphabet: np.ndarray) -> int:
    return int(numbered(np.array([32], np.uint32), alphabet)[0])


def softmax(h: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    z = -(h - h.min(1, keepdims=True)) * np.minimum(n, 400)[:, None] ** 0.5 / temperature
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def kneser_ney(counts: dict[int, tuple[np.ndarray, np.ndarray]], languages: int, characters_n: int) -> list[Level]:
    """Levels of orders 1 to ORDER; counts: for each language its packed n-grams of the highest order and their counts."""
    per: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for lang in range(languages):
        keys, many = counts.get(lang, (np.zeros(0, np.uint64), np.zeros(0)))
        per[ORDER - 1].append((keys, many.astype(float)))
        for n in range(ORDER - 1, 0, -1):
            keys, many = np.unique(last(keys, n), return_counts=True)
            per[n - 1].append((keys, many.astype(float)))
    lower_keys, lower = np.zeros(1, np.uint64), np.full((1, languages), 1.0 / (characters_n + 1))
    levels = []
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in per[n - 1]]))
        heads = np.unique(keys >> np.uint64(BITS))
        gamma = np.ones((len(heads), languages))
        alpha = np.zeros((len(keys), languages))
        for lang in range(languages):
            own, many = per[n - 1][lang]
            if not len(own):
                continue
            ones, twos = (many == 1).sum(), (many == 2).sum()
            cut = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            contexts, place = np.unique(own >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.bincount(place, many), np.bincount(place)
            gamma[np.searchsorted(heads, contexts), lang] = cut * kinds / total
            alpha[np.searchsorted(keys, own), lang] = (many - cut) / total[place]
        shorter = last(keys, n - 1) if n > 1 else np.zeros(len(keys), np.uint64)
        p = alpha + gamma[np.searchsorted(heads, keys >> np.uint64(BITS))] * lower[np.searchsorted(lower_keys, shorter)]
        level = []
        for own, value in ((keys, p), (heads, gamma)):
            hashed = tokens.mix(own)
            order = np.argsort(hashed)
            level += [hashed[order], np.log10(value[order]).astype(np.float32)]
        levels.append(Level(*level))
        lower_keys, lower = keys, p
    return levels


def quotas(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """How many rows each language gives: alike, unless it has fewer; the rest is shared among the others."""
    out, left = {}, rows
    for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(1, left // (len(sizes) - i)))
        left -= out[name]
    return out


def _picked(docs: DataFrame, learn, rows: int, id_col: str, lang: str) -> DataFrame:
    """(id, lang) of the documents to learn from: of each language the first by a hash, as many as its quota says."""
    own = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang")).where(learn)
    sizes = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return own.limit(0)
    share = quotas(sizes, rows)
    # Few more than the quota pass the threshold on the hash, whatever the size of the language.
    table = [(n, k, min(1.0, (k + 8 * k**0.5 + 32) / sizes[n])) for n, k in share.items()]
    bounds = docs.sparkSession.createDataFrame(table, "lang string, quota long, chance double")
    number = F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1 << 52))
    near = own.distinct().withColumn("number", number).join(F.broadcast(bounds), "lang").where(F.col("number") < F.col("chance") * float(1 << 52))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("number", "id"))
    return near.withColumn("rank", rank).where("rank <= quota").select("id", "lang")


def fit(docs: DataFrame, learn, rows: int = SAMPLE, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The models from at most `rows` documents with a language whose id meets `learn`, shared out among the languages;
    every fifth only calibrates."""
    picked = materialize(_picked(docs, learn, rows, id_col, lang), "picked")
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"), whole_text(text).alias("text"))
    sample = materialize(texts.join(F.broadcast(picked), ["id", "lang"], "left_semi"), "sample")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    number = {name: i for i, name in enumerate(languages)}
    hold = F.crc32(F.concat(F.col("id").cast("string"), F.lit(" calibrate"))) % 5 == 0

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code, many = np.unique(characters(list(pdf.text))[0], return_counts=True)
            yield pd.DataFrame({"code": code.astype(np.int64), "many": many})

    spelt = sample.where(~hold).select("text").mapInPandas(spell, "code long, many long").groupBy("code").agg(F.sum("many").alias("many"))
    codes = spelt.orderBy(F.desc("many"), "code").limit((1 << BITS) - 1).select("code").toPandas().code
    alphabet = np.sort(codes.to_numpy().astype(np.uint32))
    blank = blank_of(alphabet)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("lang"):
                code, off = characters(list(part.text))
                keys, many = np.unique(grams(numbered(code, alphabet), off, ORDER, blank), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": keys.astype(np.int64), "many": many})

    table = sample.where(~hold).select("lang", "text").mapInPandas(count, "lang string, gram long, many long").groupBy("lang", "gram").agg(F.sum("many").alias("many")).toPandas()
    counts = {}
    for name, part in table.groupby("lang"):
        keys = part.gram.to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        counts[number[name]] = keys[order], part.many.to_numpy()[order]
    model = Model(languages, alphabet, kneser_ney(counts, len(languages), len(alphabet)) if languages else [], 1.0, np.full(len(languages), np.inf))
    if not languages:
        return model

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, off = characters(list(pdf.text))
            yield pd.DataFrame({"lang": pdf.lang, "n": np.diff(off), "h": list(model.entropies(codes, off))})

    seen = sample.where(hold).select("lang", "text").mapInPandas(measure, "lang string, n long, h array<double>").toPandas()
    seen = seen[seen.n > 0]
    if len(seen):
        h, n, y = np.array(seen.h.tolist()), seen.n.to_numpy(), seen.lang.map(number).to_numpy()
        ts = np.exp(np.linspace(-4, 2, 49))
        loss = [-np.log(np.maximum(softmax(h, n, t)[np.arange(len(y)), y], 1e-12)).mean() for t in ts]
        model.temperature = float(ts[int(np.argmin(loss))])
        for i in range(len(languages)):
            own_h = h[y == i, i]
            if len(own_h) >= 20:
                model.limits[i] = np.quantile(own_h, 0.995) * 1.15
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", 1 << 20):
                names, share, odd = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(odd, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
