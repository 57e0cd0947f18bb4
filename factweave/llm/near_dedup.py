"""MinHash near-dedup on SetSketch registers.

Each text becomes the set of its distinct k-word shingles. A SetSketch keeps, for each of m hash functions, the minimum
of an exponential variable over the set, as a truncated exponent to base b; sketches of two sets merge by the register's
maximum and agree in a register with a probability close to their Jaccard similarity. Bands of registers give the
candidates, the joint likelihood of two sketches (with both set sizes known) drops hopeless pairs with a bucket's pivot,
and the full shingle sets, built again from the whole texts, decide every link.

Defined results: a null or blank text has an empty set, is linked with nothing and is its own component; rows that repeat
id and text share one class; a null id never is a component's name while the class has another; tables may be empty; other
columns are ignored here and kept by `drop_near_duplicates`. Rows whose sets are equal form one class before any pair
is made. There is no cap on buckets: each member meets its bucket's pivot, then every member of another component
meets all of its bucket, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import tokens
from factweave.llm.common import fresh, materialize, row_key, whole_text
from factweave.llm.graph import components

REGISTERS, BASE, RATE = 252, 1.001, 20.0
#: Rows of a block of a bucket.
BLOCK = 512
#: A candidate is dropped only if its likelihood estimate is this many standard errors below the threshold.
SLACK = 5.0
MISS = 1e-5


@lru_cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint16 SetSketch registers [texts, m] of sorted shingle sets; an empty set has zeros."""
    full = np.flatnonzero(off[1:] > off[:-1])
    out = np.zeros((len(off) - 1, REGISTERS), np.uint16)
    if not len(full):
        return out
    a, b = _permutations()
    low = np.empty((REGISTERS, len(full)), np.uint32)
    x, starts = (values >> np.uint64(32)).astype(np.uint32), off[:-1][full]
    for j in range(REGISTERS):
        low[j] = np.minimum.reduceat(x * a[j] + b[j], starts)
    h = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)) + 2**14, 0, 2**16 - 1).astype(np.uint16)
    return out


def band_rows(percent: int) -> int:
    """Most registers a band for which a pair at the threshold is missed with a probability of at most MISS."""
    fits = [r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS]
    return max(fits)


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from joint register counts and known set sizes, for pairs of rows."""
    more, less = (x > y).sum(-1), (x < y).sum(-1)
    same = x.shape[-1] - more - less
    u, v = nx / (nx + ny), ny / (nx + ny)
    step = (BASE - 1) / BASE

    def likelihood(j: np.ndarray) -> np.ndarray:
        up = -np.log1p(-np.clip(u - v * j, 1e-12, 1) * step) / np.log(BASE)
        down = -np.log1p(-np.clip(v - u * j, 1e-12, 1) * step) / np.log(BASE)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = likelihood(a) > likelihood(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


def _gate(percent: int) -> float:
    t = percent / 100
    return t - SLACK * (t * (1 - t) / REGISTERS) ** 0.5


def sketches(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(rk, id, sig, n, sketch) for every row: row key, id, 128-bit name of the shingle set, its size, registers."""
    rows = docs.select(row_key(id_col, text).alias("rk"), F.col(id_col).alias("id"), whole_text(text).alias("text"))
    id_type = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                values, off = tokens.shingles(*tokens.words(*tokens.raw(part.column(2))), k)
                sk = registers(values, off)
                n = np.diff(off)
                sig = [xxhash.xxh3_128_digest(values[off[i] : off[i + 1]].tobytes()) for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array([r.tobytes() for r in sk], pa.binary())], ["rk", "id", "sig", "n", "sketch"])

    return rows.mapInArrow(run, f"rk binary, id {id_type}, sig binary, n long, sketch binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), REGISTERS)


def _verify(pairs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; members: node, n, sketch, text."""
    left = members.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ska"), F.col("text").alias("ta"))
    right = members.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("skb"), F.col("text").alias("tb"))
    wide = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    floor = _gate(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}

        def sets(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[node] = tokens.shingles(*tokens.words(*tokens.raw(pa.array([text]))), k)[0]
            return kept[node]

        for pdf in batches:
            if len(pdf):
                pdf = pdf[estimate(_matrix(pdf.ska), _matrix(pdf.skb), pdf.na.to_numpy(float), pdf.nb.to_numpy(float)) >= floor]
            ok = []
            for a, b, ta, tb in zip(pdf.a, pdf.b, pdf.ta, pdf.tb, strict=True):
                x, y = sets(a, ta), sets(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(ok, bool), ["a", "b"]] if ok else pdf[["a", "b"]].iloc[:0]

    return wide.select("a", "na", "ska", "ta", "b", "nb", "skb", "tb").mapInPandas(run, "a long, b long")


def _hopeful(pdf: pd.DataFrame, ask: np.ndarray, have: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (place in ask, place in have) of different components whose sizes, joint likelihood and bands ask for a look
    at their sets. A pair is looked at in the first band that it shares."""
    comp, n, band, r = pdf.comp.to_numpy(), pdf.n.to_numpy(float), int(pdf.band.iloc[0]), band_rows(percent)
    sketch = _matrix(pdf.sketch)
    found = []
    for at in range(0, len(ask), 64):
        rows = ask[at : at + 64]
        small, great = np.minimum(n[rows][:, None], n[have][None, :]), np.maximum(n[rows][:, None], n[have][None, :])
        x, y = np.nonzero((comp[rows][:, None] != comp[have][None, :]) & (100 * small >= percent * great))
        for lo in range(0, len(x), 1 << 16):
            i, j = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
            left, right = sketch[rows[i]], sketch[have[j]]
            same = left == right
            before = same[:, : band * r].reshape(len(i), band, r).all(2).any(1) if band else np.zeros(len(i), bool)
            near = ~before
            near[near] = estimate(left[near], right[near], n[rows[i[near]]], n[have[j[near]]]) >= _gate(percent)
            found.append(np.stack([i[near] + at, j[near]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _links_of_bucket(pdf: pd.DataFrame, k: int, percent: int) -> pd.DataFrame:
    """Links (a, b) between the seekers and the residents of one pair of blocks: for each seeker, one link at most to each
    other component. The joint likelihood of the sketches picks the pairs, the full sets decide: all intersections at once
    are a product of incidence matrices."""
    seeks = pdf.seeks.to_numpy(bool)
    ask, have = np.flatnonzero(seeks), np.flatnonzero(~seeks)
    pairs = _hopeful(pdf, ask, have, percent)
    comp, node = pdf.comp.to_numpy(), pdf.node.to_numpy()
    if not len(pairs):
        return pd.DataFrame({"a": node[:0], "b": node[:0]})
    mine, theirs = np.unique(pairs[:, 0]), np.unique(pairs[:, 1])
    ask, have = ask[mine], have[theirs]
    wanted = np.zeros((len(ask), len(have)), bool)
    wanted[np.searchsorted(mine, pairs[:, 0]), np.searchsorted(theirs, pairs[:, 1])] = True
    rows = np.concatenate([ask, have])
    values, off = tokens.shingles(*tokens.words(*tokens.raw(pa.array(pdf.text.iloc[rows], pa.large_string()))), k)
    size = np.diff(off)
    owner = np.repeat(np.arange(len(rows)), size)
    _, column = np.unique(values, return_inverse=True)
    total, asks = int(column.max(initial=-1)) + 1, owner < len(ask)
    shared = (np.bincount(column[asks], minlength=total) > 0) & (np.bincount(column[~asks], minlength=total) > 0)
    keep = shared[column]
    column, owner, asks = (np.cumsum(shared) - 1)[column][keep], owner[keep], asks[keep]
    by = np.argsort(column, kind="stable")
    column, owner, asks = column[by], owner[by], asks[by]
    both, wide = np.zeros((len(ask), len(have)), np.float32), 4096
    for at in range(0, int(shared.sum()), wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        c, o, m = column[lo:hi] - at, owner[lo:hi], asks[lo:hi]
        x, y = np.zeros((len(ask), wide), np.float32), np.zeros((len(have), wide), np.float32)
        x[o[m], c[m]] = 1
        y[o[~m] - len(ask), c[~m]] = 1
        both += x @ y.T
    union = size[: len(ask)][:, None] + size[len(ask) :][None, :] - both
    hit_a, hit_b = np.nonzero(wanted & (100 * both >= percent * union))
    found = pd.DataFrame({"a": node[ask[hit_a]], "b": node[have[hit_b]], "of": comp[have[hit_b]]})
    return found.drop_duplicates(["a", "of"])[["a", "b"]]


def _blocked(rows: DataFrame, pool: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) inside open buckets: rows key, band, node, comp, pivot_comp, size; pool node, n, sketch, text.

    Members outside the pivot's component (the seekers) meet the whole bucket, for any pair of different components has
    one of them at least. Both are cut into blocks, so a task holds two blocks at a time.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    seekers = rows.where("comp <> pivot_comp")
    ask = seekers.select("key", "band", own.alias("here"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("there"), "node", "comp", F.lit(True).alias("seeks"))
    at = seekers.select("key", own.alias("here")).distinct()
    have = rows.join(at, "key").select("key", "band", "here", own.alias("there"), "node", "comp", F.lit(False).alias("seeks"))
    both = ask.union(have).join(pool, "node")
    dealt = both.repartition("key", "here", "there").sortWithinPartitions("key", "here", "there")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            ends = np.flatnonzero((pdf[["key", "here", "there"]].to_numpy()[1:] != pdf[["key", "here", "there"]].to_numpy()[:-1]).any(1)) + 1
            rest = pdf.iloc[ends[-1] :] if len(ends) else pdf
            for lo, hi in zip([0, *ends[:-1]], ends, strict=False):
                yield _links_of_bucket(pdf.iloc[lo:hi], k, percent)
        if rest is not None:
            yield _links_of_bucket(rest, k, percent)

    return dealt.mapInPandas(run, "a long, b long")


def classes_and_components(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows rk, id, sig, n; classes sig, node, comp with one row for each distinct non-empty set."""
    written = materialize(sketches(docs, id_col, text, k), "sketches")
    rows = written.select("rk", "id", "sig", "n")
    classes = written.where("n > 0").groupBy("sig").agg(F.min("rk").alias("rk"), F.max("n").alias("n"), F.min("sketch").alias("sketch"))
    # The numbers of classes are drawn once and written, so they stay what they are.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    r = band_rows(percent)
    spans = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * r * 2 + 1, r * 2)) for i in range(REGISTERS // r)])
    bands = classes.select("node", F.posexplode(spans).alias("band", "key"))
    buckets = materialize(bands.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = materialize(bands.join(buckets, "key"), "members")

    needed = classes.join(members.select("node").distinct(), "node", "left_semi").select("rk", "node", "n", "sketch")
    # Rows that repeat id and text share a key: one text is enough.
    texts = docs.select(row_key(id_col, text).alias("rk"), whole_text(text).alias("text"))
    texts = texts.join(needed.select("rk"), "rk", "left_semi").groupBy("rk").agg(F.any_value("text").alias("text"))
    pool = materialize(needed.join(texts, "rk").drop("rk"), "pool")

    first = materialize(_verify(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), pool, k, percent), "links")
    comp = components(first)

    label = comp.select("node", "comp")
    named = members.where("size > 2").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tip = label.select(F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"))
    named = materialize(named.join(tip, "pivot", "left").withColumn("pivot_comp", F.coalesce("pivot_comp", "pivot")), "named")
    open_keys = named.where("comp <> pivot_comp").select("key").distinct()
    rest = materialize(named.join(open_keys, "key", "left_semi"), "rest")

    second = materialize(_blocked(rest, pool, k, percent), "links")
    final = components(first.union(second)) if not second.isEmpty() else comp
    return rows, classes.select("sig", "node").join(final, "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(rk, id, n_shingles, component_id, keeper) for every row; component_id: smallest id reachable; keeper: row key kept of it."""
    rows, classes = classes_and_components(docs, id_col, text, shingle, percent)
    lead = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull(), "id", "rk")).alias("best")).join(classes, "sig")
    best = lead.groupBy("comp").agg(F.min("id").alias("component_id"), F.min("best").alias("best"))
    named = lead.select("sig", "comp").join(best, "comp").select("sig", "component_id", F.col("best.rk").alias("keeper"))
    alone = rows.where("n = 0").select("rk", "id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"), F.col("rk").alias("keeper"))
    linked = rows.where("n > 0").join(named, "sig").select("rk", "id", F.col("n").alias("n_shingles"), "component_id", "keeper")
    return linked.union(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate component (the smallest id), all columns as they were.

    Rows that repeat both id and text count as copies: one of them stays, if its text has words. Texts without words stay.
    """
    found = materialize(near_duplicates(docs, id_col, text, shingle, percent), "near")
    (key,) = fresh(docs, "rk")
    out = docs.withColumn(key, row_key(id_col, text))
    lost = found.where("rk <> keeper").select(F.col("rk").alias(key)).distinct()
    out = out.join(lost, key, "left_anti")
    again = found.where("rk = keeper and n_shingles > 0").groupBy("rk").count().where("count > 1").select(F.col("rk").alias(key))
    if not again.isEmpty():
        twice = out.join(again, key, "left_semi")
        out = out.join(again, key, "left_anti").unionByName(twice.dropDuplicates([key]))
    return out.drop(key)
