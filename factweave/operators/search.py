"""Substring search by trigrams: a posting table, the rarest trigrams of the question, and the exact test on what they leave.

Trigrams are runs of three bytes of the lower-cased UTF-8 text: a text that contains the question has all of its bytes in a row, so all of its trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of the posting table, and of each part, so that a frequent trigram is no single task; trigrams of a question that are looked up.
PARTS, SALTS, RAREST = 64, 8, 3
#: Bytes of text whose rows share their lists of ids; a longer text has lists of its own.
SLICE = 1 << 22


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigram as a number, place of its text) of binary texts, each once, by trigram and place; none for a null or a shorter text."""
    texts = texts.fill_null(b"").cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].astype(np.int64)
    place = np.repeat(np.arange(len(texts)), np.diff(off))
    both = ((body[:-2] << 16 | body[1:-1] << 8 | body[2:]) << 32 | place[:-2])[place[:-2] == place[2:]]
    both.sort()
    both = both[np.flatnonzero(np.diff(both, prepend=-1))]
    return both >> 32, both & 0xFFFFFFFF


def _part(gram: np.ndarray | int) -> np.ndarray | int:
    return (gram * 0x9E3779B1 >> 20) % PARTS


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into parts of at most SLICE bytes of text; a longer text is a part of its own."""
    end = np.cumsum(pc.binary_length(batch.column("body")).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, to - at)
        at = to


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for own in _slices(batch):
            gram, place = trigrams(own.column("body"))
            first = np.flatnonzero(np.diff(gram, prepend=-1))
            ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)), pa.int32()), own.column("id").take(pa.array(place)))
            heads = gram[first]
            columns = {"part": _part(heads), "gram": heads, "n": np.diff(first, append=len(gram))}
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns.values()], ids], names=[*columns, "ids"])


def write_postings(rows: DataFrame, id_col: str, text: str, path: str) -> None:
    """(gram, n, ids) of all rows as a table by parts of the trigrams, sorted by trigram within a file: one list for each slice of texts, not a row for each id."""
    texts = rows.select(F.col(id_col).alias("id"), F.col(text).alias("body")).where(F.col("body").isNotNull()).repartition("id", "body")  # one split may hold all texts
    texts = texts.select("id", F.lower("body").cast("binary").alias("body"))
    each = texts.mapInArrow(_listed, f"part int, gram int, n int, ids array<{dict(rows.dtypes)[id_col]}>").withColumn("salt", F.spark_partition_id() % SALTS)
    each.repartition("part", "salt").drop("salt").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(path)


def _grams(spark: SparkSession, texts: list[str]) -> list[int]:
    """The distinct trigrams of some texts, lower-cased as those of rows are."""
    lower = spark.range(1).select(F.array(*[F.lower(F.lit(t)).cast("binary") for t in texts])).first()[0]
    return np.unique(trigrams(pa.array([bytes(t or b"") for t in lower], pa.binary()))[0]).tolist()


def _lists(spark: SparkSession, path: str, id_type: str, grams: list[int]) -> DataFrame:
    stored = spark.read.schema(f"gram int, n int, ids array<{id_type}>, part int").parquet(path)
    return stored.where(F.col("part").isin(sorted({_part(g) for g in grams})) & F.col("gram").isin(grams)).select("gram", "n", "ids")


def postings(spark: SparkSession, path: str, id_type: str, texts: list[str]) -> DataFrame:
    """(gram, n, ids), the lists of the trigrams of some texts: only their parts are listed and read."""
    return _lists(spark, path, id_type, _grams(spark, texts))


def search(rows: DataFrame, id_col: str, text: str, question: str, path: str) -> DataFrame:
    """Rows whose text contains the question, letters alike in either case: what `contains` on all rows would give.

    Rows must be those that `write_postings` saw. The trigrams of the question are counted, the rarest ones' rows are intersected, and their texts are
    tested. A question of fewer than three bytes tests all rows, for no trigram is in it.
    """
    spark = rows.sparkSession
    holds = F.contains(F.lower(F.col(text)), F.lower(F.lit(question)))
    grams = _grams(spark, [question])
    if not grams:
        return rows.where(holds)
    found = _lists(spark, path, dict(rows.dtypes)[id_col], grams)
    counts = {r.gram: r.n for r in found.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # one row a trigram of the question
    rare = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    ids = found.where(F.col("gram").isin(rare)).select("gram", F.explode("ids").alias("id"))
    able = ids.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select("id")
    return rows.join(able, rows[id_col].eqNullSafe(able["id"]), "left_semi").where(holds)
