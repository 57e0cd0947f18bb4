"""SimHash near-dedup by pigeonhole blocks.

A fingerprint has 64 bits; each is the majority of that bit over the XXH64 values of all k-word shingles, repeats included.
Two fingerprints that differ in at most d bits agree in all but d of any b > d blocks, so they share one of the C(b, d) keys
that join b - d blocks. Only distinct fingerprints are keyed; those that share a key meet, their Hamming distance is
verified, and a bucket gives its members with the first one that its links connect them with: fewer rows than members, never all pairs. Buckets of
more than BLOCK fingerprints are cut into blocks and each pair of blocks is a group of its own, so none is capped and
no task holds more than two blocks of a bucket. The number of blocks only sets the cost: it grows with the number of fingerprints, so that a key
of random fingerprints stays rare.

Defined results: a null text or one without words has fingerprint zero and links like any other; fewer than k words are one
shingle; rows that repeat are rows of the result as often; a null id never names a component while it has another id; an
empty table gives an empty result; other columns are ignored. Texts are read in windows of WINDOW bytes, so a long one
needs no more memory than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import tokens
from factweave.llm.common import materialize
from factweave.llm.graph import components

SEED = 42
#: Fingerprints of one block of a bucket; bytes of text whose words are listed at a time; shingles counted at a time.
BLOCK, WINDOW, AT_ONCE = 1024, 1 << 20, 8192
#: Expected members of a key if fingerprints were random, beyond which more blocks are taken.
CROWD = 16


def word_windows(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, as many as begin in each window."""
    at = 0
    while at < len(data):
        end = at + WINDOW
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[at:end].lower().split()  # bytes: A-Z and ASCII white space alone
        at = end


def fingerprint(data: bytes, k: int = 4, seed: int = SEED) -> int:
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for words in word_windows(data):
        words = carried + words
        if len(words) < k:
            carried = words
            continue
        joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends])[: len(words) - k + 1].tolist()
        stops = (ends[k - 1 :] - 1).tolist()
        for at in range(0, len(starts), AT_ONCE):
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + AT_ONCE], stops[at : at + AT_ONCE], strict=True)], ">u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(starts)
        carried = words[len(words) - k + 1 :]
    if not total and carried:
        return xxhash.xxh64_intdigest(b" ".join(carried), seed)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp) for every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                found = np.array([fingerprint((v.as_buffer() or b"") and v.as_buffer().to_pybytes(), shingle) for v in part.column(1).cast(pa.large_binary())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks of all choices of blocks - distance blocks out of blocks equal ones."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(own, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, distance: int) -> int:
    """The least number of blocks (two more than the distance at least) whose keys are rare among n random fingerprints."""
    blocks = distance + 2
    while blocks < 3 * distance and n > CROWD << (64 * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the pairs (a, b) connect it with."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]


def _close(prints: np.ndarray, first: np.ndarray, size: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of close pairs inside groups that follow each other: small groups by lags, all at once, large ones as a matrix.

    side: 0 or 1 where a group holds two blocks, of which only members of different sides meet; 2 where all meet.
    """
    found = []
    meets = lambda i, j: (np.bitwise_count(prints[i] ^ prints[j]) <= distance) & ((side[i] == 2) | (side[i] != side[j]))
    small = size <= 64
    begin, many = first[small], size[small]
    ends = np.repeat(begin + many, many)
    place = np.arange(len(ends)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    for lag in range(1, int(many.max(initial=0))):
        inside = place + lag < ends
        place, ends = place[inside], ends[inside]
        ok = meets(place, place + lag)
        found.append((place[ok], place[ok] + lag))
    for a, n in zip(first[~small], size[~small], strict=True):
        for lo in range(a, a + n, 256):
            i, j = np.meshgrid(np.arange(lo, min(lo + 256, a + n)), np.arange(lo, a + n), indexing="ij")
            i, j = i[i < j], j[i < j]
            ok = meets(i, j)
            found.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Forests of the links inside groups (key columns: band, key, here, there; then fp, side) that arrive sorted."""
    rest: pa.Table | None = None

    def solve(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        prints = table.column("fp").to_numpy().view(np.uint64)
        size = np.diff(first, append=len(prints))
        many = size > 1
        a, b = _close(prints, first[many], size[many], table.column("side").to_numpy(), distance)
        root = forest(len(prints), a, b)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(prints[child].view(np.int64)), pa.array(prints[root[child]].view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([table.column(c).to_numpy() for c in ("band", "key", "here", "there")], 1)
        first = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])
        if len(first) > 1:
            yield solve(table.slice(0, first[-1]), first[:-1])
        rest = table.slice(first[-1])
    if rest is not None:
        yield solve(rest, np.zeros(1, np.int64))


def close_links(prints: DataFrame, distance: int, blocks: int | None = None) -> DataFrame:
    """Rows (a, b) that connect just what the pairs of at most distance differing bits connect; prints: fp, each once, a stored table."""
    masks = block_masks(blocks or blocks_for(prints.count(), distance), distance)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    bands = prints.select("fp", F.explode(keys).alias("to")).select("to.band", "to.key", "fp")
    sizes = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    members = bands.join(sizes, ["band", "key"]).select("band", "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    own, other = F.col("own"), F.col("other")
    side = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    dealt = members.select("band", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("band", "key", F.least(own, other).alias("here"), F.greatest(own, other).alias("there"), "fp", side.cast("int").alias("side"))
    group = ["band", "key", "here", "there"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(lambda batches: _links(batches, distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable over links of at most distance differing bits."""
    assert 0 < distance < 32 and comb(distance + 2, distance) < 1000
    rows = materialize(fingerprints(docs, id_col, text, shingle), "prints")
    classes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    links = materialize(close_links(classes.select("fp"), distance, blocks), "links")
    found = components(links).withColumnRenamed("node", "fp")
    named = classes.join(found, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    lowest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(lowest, "comp").select("fp", "component_id"), "fp").select("id", "fp", "component_id")
