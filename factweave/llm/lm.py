"""LM scoring by deleted interpolation of word n-grams, counted over the whole corpus.

The text of a word model: the words of a document (A-Z lower-cased) and one end token. Estimates of orders 1 to ORDER and
a uniform one are mixed with weights that depend on how often the context was seen (a bucket for each power of two).
The weights come from expectation-maximisation on held-out counts: each training n-gram is judged by the estimates with its
own occurrence taken out (deleted estimation), over a table of probabilities, binned and with the mean of each bin, that has the same size for any corpus.

How it is dealt out: each task cuts its documents into blocks of bounded size, a row each, in a table bucketed by block.
A block merges the n-gram hashes of all its documents, sorted, and sends its own counts, packed, to ranges of the hash
space; a range holds about as many bytes of text as any other and as before, however large the corpus. It adds up the
counts of all blocks and answers each block with the totals in the block's own order, so answers are numbers alone. No key
is hot: an n-gram reaches its range once from a block, however frequent it is. Only the answers move to meet the blocks.
Word hashes have 64 bits; longer n-grams keep as many as make a chance match rarer than one in 2^SPARE.

Defined results: a null or blank text is the end token alone; with no training document, N and V are 0, every base score is 0
and so is the score; rows that repeat are scored, and counted, each; other columns are ignored.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import tokens
from factweave.llm.common import materialize, scratch_path, whole_text

#: Order of the query's model; bytes of text of a block and of a range at most, about, and of what a block works on at a time.
ORDER, BLOCK_BYTES, RANGE_BYTES, CHUNK_BYTES = 3, 4 << 20, 16 << 20, 2 << 20
#: Buckets of context counts; bins of log10 probabilities, BIN wide; bits that an n-gram's hash has beyond the logarithm of the corpus.
BUCKETS, BIN, SPARE = 24, 0.5, 20
END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def lines(body: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end token behind each text, for each text the index of its first token, and the total)."""
    h, bounds = tokens.words(body, off)
    n = np.diff(bounds)
    out = np.full(len(h) + len(n), END, np.uint64)
    starts = bounds[:-1] + np.arange(len(n))
    place = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    out[place] = h
    return out, np.append(starts, len(out))


def ngrams(line: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each token; start marks stand before a text."""
    if order == 1:
        return line
    first = np.arange(len(line)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = np.full(len(line), np.uint64(order))
    for back in range(order - 1, -1, -1):
        w = np.full(len(line), _START)
        w[back:] = line[: len(line) - back]
        w[first < back] = _START
        out = tokens.mix(out * _STEP + w)
    return out


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps, in byte planes as wide as the largest step needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    full = np.zeros((planes.shape[1], 8), np.uint8)
    full[:, : data[0]] = planes.T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for one of the 64-bit counts behind."""
    large_ones = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large_ones].astype("<i8").tobytes() + len(counts).to_bytes(8, "little")


def large(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-8:], "little")
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[n:-8], "<i8")
    return counts


@dataclass
class Part:
    """Some documents of a block: their rows, tokens, and of each order where each token's n-gram is among the block's kinds."""

    rows: pa.RecordBatch
    line: np.ndarray
    bounds: np.ndarray
    places: list[np.ndarray]


@dataclass
class Block:
    """A block's documents in parts of bounded size, and of each order its sorted kinds of n-grams."""

    parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]
    kinds: list[np.ndarray]
    bits: int

    @classmethod
    def of(cls, own: pa.Table, order: int, bits: int, chunk: int) -> Block:
        batches = own.combine_chunks().to_batches()
        parts = [(piece, *lines(*tokens.raw(piece.column("text")))) for b in batches for piece in tokens.slices(b, "text", chunk)]
        kinds = [[tokens.distinct(shortened(ngrams(line, bounds, n), n, bits)) for _, line, bounds in parts] for n in range(1, order + 1)]
        return cls(parts, [tokens.distinct(np.concatenate(k)) if len(k) > 1 else k[0] for k in kinds], bits)

    def __iter__(self) -> Iterator[Part]:
        for rows, line, bounds in self.parts:
            places = []
            for n, kinds in enumerate(self.kinds, 1):
                own, place = np.unique(shortened(ngrams(line, bounds, n), n, self.bits), return_inverse=True)
                places.append(np.searchsorted(kinds, own)[place])  # sorted questions are far quicker than as they come
            yield Part(rows, line, bounds, places)


def shortened(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    return keys if n == 1 else keys >> np.uint64(64 - bits)


@dataclass
class Totals:
    """Corpus counts by token: c[n - 1] of its n-gram and h[n - 1] of its context (of order 1: all tokens)."""

    c: list[np.ndarray]
    h: list[np.ndarray]


def totals(part: Part, answers: list[np.ndarray], tokens_n: int, texts_n: int) -> Totals:
    """A context was seen as often as the n-gram that ends at the token before; a text's first one as often as texts."""
    c = [total[place] for total, place in zip(answers, part.places, strict=True)]
    h = [np.full(len(part.line), tokens_n, np.int64)]
    for lower in c[:-1]:
        before = np.roll(lower, 1)
        before[part.bounds[:-1]] = texts_n
        h.append(before)
    return Totals(c, h)


def buckets(h: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 if unseen, then one for each power of two."""
    return np.minimum(np.where(h > 0, np.floor(np.log2(np.maximum(h, 1))).astype(np.int64) + 1, 0), BUCKETS - 1)


def estimates(t: Totals, kinds_n: int, less: np.ndarray | int = 0) -> list[np.ndarray]:
    """Probabilities of orders 0 (uniform over the kinds and one unknown) to ORDER; less: occurrences taken out of each count."""
    out = [np.full(len(t.c[0]), 1.0 / (kinds_n + 1))]
    for c, h in zip(t.c, t.h, strict=True):
        top, low = np.maximum(c - less, 0), np.maximum(h - less, 0)
        out.append(np.where(low > 0, top / np.maximum(low, 1), 0.0))
    return out


def mixed(p: list[np.ndarray], t: Totals, weights: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
    """From the uniform estimate up: each order's own share by its context's bucket, the rest the lower order's."""
    out = p[0]
    for n in range(1, len(p)):
        low = np.maximum(t.h[n - 1] - less, 0)
        share = np.where(low > 0, weights[n - 1][buckets(low)], 0.0)
        out = share * p[n] + (1 - share) * out
    return out


def bins(p: np.ndarray, width: float) -> np.ndarray:
    """Bins of log10 p, 254 at most; -1 is 0."""
    return np.where(p > 0, np.minimum(np.round(-np.log10(np.maximum(p, 1e-300)) / width).astype(np.int64), 253), -1)


class Model:
    """Everything that scoring needs: the table of blocks, the ranges' answers to each, and the mixture's weights."""

    def __init__(self, docs: DataFrame, learn: Column, order: int = 2, id_col: str = "doc_id", text: str = "text"):
        self.order, self.spark = order, docs.sparkSession
        rows = docs.select(F.col(id_col).alias("id"), learn.alias("learns"), whole_text(text).alias("text"))
        self.id_type = dict(rows.dtypes)["id"]
        self.blocks = self._cut(rows)
        size = self.blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts")).first()
        self.ranges, self.texts_n = max(1, -(-int(size.bytes) // RANGE_BYTES)), int(size.texts)
        self.bits = min(64, max(40, int(size.bytes).bit_length() + SPARE - 2))
        self.answers, self.tokens_n, self.kinds_n = self._count()
        self.weights = self._learn()

    def _cut(self, rows: DataFrame) -> DataFrame:
        """block, bytes, texts (that learn), payload: the documents of a block as a compressed Arrow table; bucketed by block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

            def block() -> pa.RecordBatch:
                table = pa.Table.from_batches(held)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table)
                texts = sum(table.column("learns").to_pylist())
                return pa.RecordBatch.from_arrays([pa.array([(part << 24) + number], pa.int64()), pa.array([size], pa.int64()), pa.array([texts], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "bytes", "texts", "payload"])

            for batch in batches:
                for piece in tokens.slices(batch, "text", CHUNK_BYTES // 2):
                    held.append(piece)
                    size += len(tokens.raw(piece.column(2))[0]) + 8 * piece.num_rows
                    if size >= BLOCK_BYTES:
                        yield block()
                        number, held, size = number + 1, [], 0
            if held:
                yield block()

        name = f"factweave_blocks_{uuid.uuid4().hex}"
        buckets_n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        cut = rows.mapInArrow(run, "block long, bytes long, texts long, payload binary")
        cut.write.format("parquet").option("path", scratch_path(self.spark, "blocks")).bucketBy(buckets_n, "block").saveAsTable(name)
        atexit.register(_drop, self.spark, name)
        return self.spark.table(name)

    def _count(self) -> tuple[DataFrame, int, int]:
        order, ranges, bits = self.order, self.ranges, self.bits

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    block = Block.of(_table(payload), order, bits, CHUNK_BYTES)
                    counts = [np.zeros(len(kinds), np.int64) for kinds in block.kinds]
                    for part in block:
                        learns = _learns(part)
                        for many, place in zip(counts, part.places, strict=True):
                            many += np.bincount(place[learns], minlength=len(many))
                    out = []
                    for n, (many, kinds) in enumerate(zip(counts, block.kinds, strict=True), 1):
                        top = (kinds >> np.uint64((64 if n == 1 else bits) - 32)).astype(np.int64) * ranges >> 32
                        edges = np.searchsorted(top, np.arange(ranges + 1))
                        out += [(r, n, pack(kinds[a:b]), small(many[a:b])) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
                    r, n, keys, many = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(n, pa.int32()), pa.array([number] * len(r), pa.int64()), pa.array(keys, pa.binary()), pa.array(many, pa.binary())], ["range", "order", "block", "keys", "own"])

        def answer(pdf: pd.DataFrame) -> pd.DataFrame:
            keys = [unpack(k) for k in pdf["keys"]]
            kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.rint(np.bincount(place, np.concatenate([large(c) for c in pdf.own]), len(kinds))).astype(np.int64)
            ends = np.cumsum([len(k) for k in keys])
            seen, sums = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            seen[0], sums[0] = (total > 0).sum(), total.sum()
            return pd.DataFrame({"block": pdf.block, "range": pdf.range, "order": pdf.order, "total": [small(total[place[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)], "kinds": seen, "tokens": sums})

        sent = self.blocks.select("block", "payload").mapInArrow(send, "range int, order int, block long, keys binary, own binary")
        answered = materialize(sent.groupBy("range", "order").applyInPandas(answer, "block long, range int, order int, total binary, kinds long, tokens long"), "answers")
        n = answered.where("order = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
        return answered.select("block", "range", "order", "total"), int(n.n), int(n.v)

    def _meet(self, work, schema: str) -> DataFrame:
        """work((part, totals of its tokens) of a block's parts) over all blocks; the blocks stay in their buckets."""
        order, bits, tokens_n, texts_n = self.order, self.bits, self.tokens_n, self.texts_n
        lists = self.answers.groupBy("block").agg(F.collect_list(F.struct("order", "range", "total")).alias("answers"))
        both = self.blocks.select("block", "payload").hint("merge").join(lists, "block").select("payload", F.array_sort("answers").alias("answers"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload, answers in zip(batch.column(0), batch.column(1), strict=True):
                    block = Block.of(_table(payload), order, bits, CHUNK_BYTES)
                    by: list[list[np.ndarray]] = [[] for _ in range(order)]
                    for a in answers.as_py():
                        by[a["order"] - 1].append(large(a["total"]))
                    found = [np.concatenate(x) for x in by]
                    yield from work((part, totals(part, found, tokens_n, texts_n)) for part in block)

        return both.mapInArrow(run, schema)

    def _learn(self) -> np.ndarray:
        """Weights [order, bucket] by expectation-maximisation, one order upon the other."""
        order, kinds_n = self.order, self.kinds_n
        weights = np.full((order, BUCKETS), 0.5)
        names, means = [f"k{i}" for i in range(2 * order)], [f"p{i}" for i in range(order)]

        def held(parts: Iterator[tuple[Part, Totals]]) -> Iterator[pa.RecordBatch]:
            cells = []
            for part, t in parts:
                learns = _learns(part)
                p = [x[learns] for x in estimates(t, kinds_n, 1)[1:]]
                code = np.zeros(int(learns.sum()), np.int64)
                for c in [*(buckets(np.maximum(h - 1, 0))[learns] for h in t.h), *(bins(x, BIN) + 1 for x in p)]:
                    code = code * 256 + c
                cells.append(_summed(code, [np.ones(len(code)), *p]))
            kind, (many, *sums) = _summed(np.concatenate([k for k, _ in cells]), [np.concatenate(x) for x in zip(*(v for _, v in cells), strict=True)])
            parts_of = [kind >> (8 * k) & 255 for k in range(2 * order - 1, -1, -1)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in parts_of), pa.array(many.astype(np.int64)), *(pa.array(x, pa.float64()) for x in sums)], [*names, "many", *means])

        schema = ", ".join([*(f"{k} long" for k in names), "many long", *(f"{k} double" for k in means)])
        table = self._meet(held, schema).groupBy(*names).agg(*(F.sum(c).alias(c) for c in ("many", *means))).toPandas()
        if not len(table):
            return weights
        table = table.sort_values(names)
        many = table.many.to_numpy(float)
        p = [table[c].to_numpy() / many for c in means]
        low = np.full(len(many), 1.0 / (kinds_n + 1))
        for n in range(order):
            b = table[f"k{n}"].to_numpy()
            for _ in range(50):
                w = weights[n][b]
                share = w * p[n] / np.maximum(w * p[n] + (1 - w) * low, 1e-300)
                top, every = np.bincount(b, many * share, BUCKETS), np.bincount(b, many, BUCKETS)
                weights[n] = np.clip(np.where(every > 0, top / np.maximum(every, 1), weights[n]), 0, 0.999)
            weights[n][0] = 0.0
            w = weights[n][b]
            low = w * p[n] + (1 - w) * low
        return weights

    def score(self) -> DataFrame:
        """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
        tokens_n, kinds_n, weights = self.tokens_n, self.kinds_n, self.weights

        def work(parts: Iterator[tuple[Part, Totals]]) -> Iterator[pa.RecordBatch]:
            for part, t in parts:
                starts = part.bounds[:-1]
                base = full = np.zeros(len(starts))
                if tokens_n:
                    base = np.add.reduceat(np.log10((t.c[0] + 1) / (tokens_n + kinds_n + 1)), starts)
                    full = np.add.reduceat(np.log10(mixed(estimates(t, kinds_n), t, weights)), starts)
                known = np.add.reduceat((t.c[0] > 0).astype(np.int64), starts)
                columns = [pa.array(np.diff(part.bounds), pa.int64()), pa.array(known, pa.int64()), pa.array([tokens_n] * len(starts), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.rows.column("id"), *columns], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return self._meet(work, f"id {self.id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _summed(code: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct codes and, of each array of values, their sums by code."""
    kind, place = np.unique(code, return_inverse=True)
    return kind, [np.bincount(place, x, len(kind)) for x in values]


def _learns(part: Part) -> np.ndarray:
    """Whether each token is in a document to learn from."""
    return np.repeat(np.array(part.rows.column("learns").to_pylist(), bool), np.diff(part.bounds))


def _table(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_py()).read_all()


def _drop(spark, name: str) -> None:
    """Drop the table of blocks when the driver ends, if its session still lives."""
    if spark.getActiveSession() is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
