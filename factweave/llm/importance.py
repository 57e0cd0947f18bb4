"""Target-distribution importance resampling over hashed n-grams of words.

A document's features are all runs of 1 to n consecutive words, hashed into buckets; a bucket's gain is the logarithm of how much
more likely the target text makes it than the corpus does. A document's weight is the mean gain of its features, and
the documents with the greatest weights plus Gumbel noise are drawn: that is sampling without replacement in proportion to
exp(weight). Bucket counts are summed in every task over all documents; only the counts (one a bucket) reach the driver.

Overlap chunking: texts of more than CHUNK bytes are cut at word boundaries, and each chunk carries the n - 1 words that
follow it. A chunk owns the runs that start in it, so chunks have the features of the whole text, each once; they are dealt over all tasks,
and their counts and gains are summed by document. Shorter texts stay where they are read.

Defined results: a null text is an empty one; a document without words has no features and weight 0; ties go to the smaller id, a
null id first; rows that repeat are drawn each for itself; an empty table, or one without documents of enough words, draws none;
without target text all gains follow from the corpus alone; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import tokens
from factweave.llm.common import materialize, row_key, whole_text

BUCKETS, ORDER = 10_000, 2
#: Bytes of a text beyond which it is cut, and of its chunks.
CHUNK = 1 << 17
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_INSIDE = np.array([not _GAP.match(bytes([c])) for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()
#: Bytes of a word up to which all words of a slice are hashed together, byte by byte.
_TOGETHER = 48


def _extended(state: np.ndarray, body: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the words body[start : start + length]."""
    by = np.argsort(-np.minimum(length, _TOGETHER + 1), kind="stable")
    c, at, size = state[by], start[by], length[by]
    long = int(np.count_nonzero(size > _TOGETHER))
    for i in range(long):
        c[i] = zlib.crc32(body[at[i] : at[i] + size[i]].tobytes(), int(c[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = np.searchsorted(-size[long:], -np.arange(_TOGETHER), "left") + long  # words longer than k bytes
    for k in range(int(size[long:].max(initial=0))):
        part = slice(long, live[k])
        c[part] = _CRC[(c[part] ^ body[at[part] + k]) & 255] ^ (c[part] >> np.uint32(8))
    out = np.empty_like(c)
    out[by] = c
    return out


def features(body: np.ndarray, off: np.ndarray, carry: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every run of 1 to order words that a text owns, and each text's own words.

    body and off: texts as in `tokens.raw`; carry: words at a text's end that only complete runs which start before them.
    """
    body = _LOWER[body]
    inside = _INSIDE[body]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    first[off[:-1][full]] = inside[off[:-1][full]]
    last[off[1:][full] - 1] = inside[off[1:][full] - 1]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    bounds = np.searchsorted(start, off)
    words = np.diff(bounds)
    owner = np.repeat(np.arange(len(words)), words)
    end, mine = bounds[1:][owner], np.arange(len(start)) < (bounds[1:] - carry)[owner]
    head = np.flatnonzero(mine)
    state = np.full(len(head), 0xFFFFFFFF, np.uint32)
    found = []
    for n in range(order):
        inner = head + n < end[head]
        head, state = head[inner], state[inner]
        if n:
            state = _CRC[(state ^ 0x20) & 255] ^ (state >> np.uint32(8))
        state = _extended(state, body, start[head + n], length[head + n])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % buckets, owner[head]))
    bucket, of = (np.concatenate(x) for x in zip(*found, strict=True))
    return bucket.astype(np.int64), of, words - carry


def chunks(data: bytes, size: int, order: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, words carried over from the next) of a text, cut between words."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        end = gap.start() if gap else len(data)
        stop, carried = end, 0
        for word in _WORD.finditer(data, end):
            if carried == order - 1:
                break
            stop, carried = word.end(), carried + 1
        yield data[at:stop], carried
        at = end


def _parts(docs: DataFrame, text: str, order: int, **more) -> tuple[DataFrame, DataFrame]:
    """(whole texts, dealt chunks of longer ones), both with piece, carry (words), part (the number of the chunk) and the columns of more."""
    rows = docs.select(*[c.alias(n) for n, c in more.items()], F.monotonically_increasing_id().alias("at"), whole_text(text).alias("piece"))
    short = rows.where(F.octet_length("piece") <= CHUNK).withColumns({"carry": F.lit(0), "part": F.lit(0)})
    long = rows.where(F.octet_length("piece") > CHUNK)
    head = [c for c in rows.columns if c != "piece"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(len(head))[i].as_py().encode()
                for part, (piece, carry) in enumerate(chunks(data, CHUNK, order)):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(len(head))), pa.array([piece.decode()]), pa.array([carry], pa.int32()), pa.array([part], pa.int32())], [*head, "piece", "carry", "part"])

    types = ", ".join(f"`{n}` {t}" for n, t in rows.select(*head).dtypes)
    return short, long.mapInArrow(cut, f"{types}, piece string, carry int, part int").repartition("at", "part")


def _read(batch: pa.RecordBatch, order: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for part in tokens.slices(batch, "piece"):
        carry = part.column(part.schema.get_field_index("carry")).to_numpy()
        yield part, *features(*tokens.raw(part.column(part.schema.get_field_index("piece"))), carry, order, buckets)


def bucket_counts(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _, _ in _read(batch, order, buckets):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["bucket", "n"])

    short, long = _parts(docs, text, order)
    each = short.mapInArrow(run, "bucket long, n long").unionByName(long.mapInArrow(run, "bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, n_features, weight) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bucket, of, words in _read(batch, order, len(gain)):
                sums = np.zeros(part.num_rows, np.int64)
                np.add.at(sums, of, gain[bucket])
                counts = np.bincount(of, minlength=part.num_rows)
                keep = [part.column(part.schema.get_field_index(c)) for c in ("id", "rk", "part")]
                yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x.astype(np.int64)) for x in (words, counts, sums))], ["id", "rk", "part", "n_words", "n_features", "gained"])

    short, long = _parts(docs, text, order, id=F.col(id_col), rk=row_key(id_col, text))
    schema = f"id {dict(short.dtypes)['id']}, rk binary, part int, n_words long, n_features long, gained long"
    # Rows that repeat id and text share a key: their first chunks tell how many they are.
    copies = F.count_if(F.col("part") == 0)
    sums = [F.expr(f"sum({c}) div count_if(part = 0)").alias(c) for c in ("n_words", "n_features", "gained")]
    joined = long.mapInArrow(run, schema).groupBy("id", "rk").agg(*sums, copies.alias("copies"))
    joined = joined.select("id", "n_words", "n_features", "gained", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    every = short.mapInArrow(run, schema).select("id", "n_words", "n_features", "gained").unionByName(joined)
    down = F.expr("(gained - pmod(gained, n_features)) div n_features")
    return every.select("id", "n_words", "n_features", F.when(F.col("n_features") > 0, down).otherwise(F.lit(0)).cast("long").alias("weight"))


def scored(found: DataFrame, seed: int = 7) -> DataFrame:
    """Adds score: the weight plus Gumbel noise, in thousandths, from a digest of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    return found.withColumn("score", F.col("weight") + noise)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of a row in this slice of the sorted rows, and the slice."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(seen, seen + batch.num_rows)
        seen += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(len(place), part, "int32"))], [*batch.schema.names, "place", "slice"])


def ranked(found: DataFrame, percent: int) -> DataFrame:
    """Adds rank (1, 2, ...) to the rows of a stored table id, score, ... with the percent highest scores; it is null in the others.

    The rows are range-sorted; a row's rank is its place in its slice, which its task counts, behind the rows of the slices before.
    """
    spark = found.sparkSession
    order = [F.desc("score"), F.asc_nulls_first("id"), F.asc("tie")]  # the last lets repeated rows part between slices
    lined = found.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    types = ", ".join(f"`{n}` {t}" for n, t in lined.dtypes)
    lined = materialize(lined.mapInArrow(_numbered, f"{types}, place long, slice int"), "lined")
    sizes, base = [], 0
    for r in sorted(lined.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a slice
        sizes.append((r.slice, base))
        base += r.n
    if not sizes:
        return lined.select(*found.columns, F.lit(None).cast("long").alias("rank"))
    drawn = percent * base // 100
    rank = F.col("base") + F.col("place") + 1
    met = lined.join(F.broadcast(spark.createDataFrame(sizes, "slice int, base long")), "slice")
    return met.select(*found.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of docs; rank is null where a row is not drawn."""
    gain = gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, target_text, order, buckets))
    every = materialize(scored(weights(docs, gain, id_col, text, order), seed), "weights")
    few = every.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(every.where(F.col("n_words") >= least_words), percent).unionByName(few).drop("n_words")


ORACLE_SQL = r"""
WITH table_ AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
cut AS (SELECT 'd' AS kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
runs AS (SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS run FROM cut),
counted AS MATERIALIZED (SELECT kind, doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, hex(encode(run)) AS hx FROM (SELECT DISTINCT run FROM counted)),
hashed AS MATERIALIZED (SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i: CAST('0x' || hx[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM bytes, table_),
bucketed AS MATERIALIZED (SELECT kind, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (run) GROUP BY ALL),
per AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (kind = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (kind = 'b'), 0) AS DOUBLE) AS t FROM bucketed GROUP BY ALL),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM per) + 10000) / ((s + 1) * ((SELECT sum(t) FROM per) + 10000)))) AS BIGINT) AS g FROM per),
summed AS (SELECT doc_id, sum(n) AS n_features, sum(n * g) AS gained FROM bucketed JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY ALL),
weighed AS (SELECT c.doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CASE WHEN n_features > 0 THEN CAST((gained - ((gained % n_features) + n_features) % n_features) // n_features AS BIGINT) ELSE 0 END AS weight FROM cut c LEFT JOIN summed USING (doc_id) WHERE kind = 'd'),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= (SELECT count(*) FROM noisy WHERE n_words >= 20) * 25 // 100 THEN r END AS rank FROM placed
"""
