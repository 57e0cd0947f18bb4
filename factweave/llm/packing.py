"""Best-fit packing of token pieces into sequences of a fixed capacity, bulk-synchronously.

Documents are tokenised where they lie; longer ones are cut into full pieces behind a first piece with the rest. A piece
longer than half the capacity opens a sequence of its own. Then supersteps over the rows that are left, until none is:

1. Pieces and gaps are range-sorted by size, equal sizes with the pieces first. A gap stands as often as the largest
   piece that fits it goes into it, so whatever takes these places fits together.
2. Successor sweep: a piece goes up a step, a place goes down one. The depth is a running sum: inside a slice of the sorted
   rows by its task, and between slices by their sums (one row a slice).
3. Conflicts are resolved by rank: on each level of depth steps up and down alternate, so the next step down is the
   smallest place that no larger piece has taken, as if the pieces had chosen one by one, longest first. A level is
   crossed once up and once down by each size at most, so it never has more than two rows for each unit of capacity, whatever repeats.
4. Gaps shrink by what they took; those smaller than every piece close. New sequences open only where pieces of some length or
   more need more room than all gaps of that length or more have, and only as many as this deficit fills.

Only counts by length and by room come to the driver, at most two for each unit of capacity.

Defined results: a null text is an empty one and still is a piece (its end token); rows that repeat are packed as often
as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import materialize, whole_text

VOCABULARY = "byte_bpe_50k"


@functools.lru_cache
def _encoder(vocabulary: str):
    """ids of a text, as `tokenizers` gives them with add_special_tokens=False: an added token's string is its id, and the
    texts between are encoded each for itself, by tiktoken from the ranks file, or by the json file where that fails."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    slow = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    added = {token.content: number for number, token in slow.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as failure:  # the regex engine gives up on some extreme texts with a panic, which is no Exception
            if type(failure).__name__ != "PanicException":
                raise
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, behind a first one with the rest."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(docs: DataFrame, id_col: str, text: str, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and a key: the task and the number of the piece in it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = _encoder(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of, out = batch.column(0), []
            at = []
            for i, value in enumerate(batch.column(1)):
                ids = np.array([*encode(value.as_py()), end_id], "<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    out.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes()), key))
                    key += 1
                    at.append(i)
            k, start, n, crc, keys = (list(x) for x in zip(*out, strict=True)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, n, crc, keys))], ["doc_id", "piece", "start", "length", "ids_crc32", "key"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, key long")


def _counts(left: DataFrame, gaps: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """(pieces by length, gaps by room that some piece fits): at most one row of each for each unit of capacity, by one job."""
    rows = left.select("length", F.lit(0).alias("gap")).union(gaps.select("room", F.lit(1))).groupBy("gap", "length").count().collect()
    lengths, rooms = ({r.length: r["count"] for r in rows if r.gap == kind} for kind in (0, 1))
    least = min(lengths, default=0)
    return lengths, {room: n for room, n in rooms.items() if room >= least}


def wanted(lengths: dict[int, int], rooms: dict[int, int], capacity: int) -> int:
    """New sequences without which pieces of some length or more cannot all find room (lengths, rooms: counts by size)."""
    need = room = lack = 0
    left = sorted(rooms)
    for length in sorted(lengths, reverse=True):
        need += length * lengths[length]
        while left and left[-1] >= length:
            size = left.pop()
            room += size * rooms[size]
        lack = max(lack, need - room)
    return -(-lack // capacity)


def places(lengths: dict[int, int], rooms: dict[int, int]) -> list[tuple[int, int]]:
    """(room, places): as many as the largest piece that fits goes into it, but no more than twice the pieces there are for all gaps."""
    sizes = np.array(sorted(lengths))
    most = 1 + 2 * sum(lengths.values()) // max(1, sum(rooms.values()))
    return [(room, min(room // int(sizes[np.searchsorted(sizes, room, "right") - 1]), most)) for room in rooms]


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the depth behind each row inside this slice of the sorted rows, and the slice."""
    part, depth = TaskContext.get().partitionId(), 0
    for batch in batches:
        if batch.num_rows:
            steps = depth + np.cumsum(1 - 2 * batch.column(1).to_numpy().astype("int64"))
            depth = int(steps[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps), pa.array(np.full(len(steps), part, "int32"))], [*batch.schema.names, "depth", "slice"])


def sweep(left: DataFrame, gaps: DataFrame, lengths: dict[int, int], rooms: dict[int, int]) -> DataFrame:
    """One superstep: rows size, kind (0 piece, 1 place in a gap), key, sequence_id (of a piece that found one), taken (length a place took)."""
    spark = left.sparkSession
    table = F.broadcast(spark.createDataFrame(places(lengths, rooms), "room long, places int"))  # at most a row for each unit of capacity
    spots = gaps.join(table, "room").select(F.col("room").alias("size"), F.lit(1).alias("kind"), F.col("sequence_id").alias("key"), F.explode(F.sequence(F.lit(1), "places")).alias("place"))
    both = left.select(F.col("length").alias("size"), F.lit(0).alias("kind"), "key", F.lit(0).alias("place")).unionByName(spots)
    order = ["size", "kind", "key", "place"]
    lined = both.repartitionByRange(*order).sortWithinPartitions(*order)
    lined = materialize(lined.mapInArrow(_depths, "size long, kind int, key long, place int, depth long, slice int"), "lined")
    sums, base = [], 0
    for r in sorted(lined.groupBy("slice").agg(F.sum(1 - 2 * F.col("kind")).alias("steps")).collect()):  # one row a slice
        sums.append((r.slice, base))
        base += r.steps
    level = F.col("base") + F.col("depth") + F.col("kind")
    on_level = Window.partitionBy("level").orderBy(*order)
    met = lined.join(F.broadcast(spark.createDataFrame(sums, "slice int, base long")), "slice").withColumn("level", level)
    piece = F.col("kind") == 0
    return met.select(
        "size", "kind", "key",
        F.when(piece, F.lead(F.when(~piece, F.col("key"))).over(on_level)).alias("sequence_id"),
        F.when(~piece, F.lag(F.when(piece, F.col("size"))).over(on_level)).alias("taken"),
    )


def sequences(cuts: DataFrame, capacity: int) -> DataFrame:
    """key, length and sequence_id of every piece shorter than the capacity (cuts: key and length, a stored table)."""
    spark, opened = cuts.sparkSession, 0
    rows = cuts.where(F.col("length") < capacity).select("key", "length")
    alone = F.col("length") * 2 > capacity
    done = [rows.where(alone).withColumn("sequence_id", F.col("key"))]
    gaps = done[0].select("sequence_id", (F.lit(capacity) - F.col("length")).alias("room"))
    left = rows.where(~alone)
    while True:
        lengths, rooms = _counts(left, gaps)
        if not lengths:
            return functools.reduce(DataFrame.unionByName, done)
        gaps = gaps.where(F.col("room") >= min(lengths))
        if new := wanted(lengths, rooms, capacity):
            gaps = gaps.unionByName(spark.range(new).select((F.lit(-1 - opened) - F.col("id")).alias("sequence_id"), F.lit(capacity).cast("long").alias("room")))
            opened, rooms[capacity] = opened + new, new + rooms.get(capacity, 0)
        met = materialize(sweep(left, gaps, lengths, rooms), "met")
        found = met.where("kind = 0").select("key", F.col("size").alias("length"), "sequence_id")
        done.append(found.where("sequence_id is not null"))
        left = found.where("sequence_id is null").drop("sequence_id")
        gaps = met.where("kind = 1").groupBy(F.col("key").alias("sequence_id")).agg((F.max("size") - F.coalesce(F.sum("taken"), F.lit(0))).alias("room"))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = materialize(pieces(docs, id_col, text, capacity, end_id, vocabulary), "pieces")
    own = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "key").rowsBetween(Window.unboundedPreceding, -1)
    spots = sequences(cuts, capacity).select("key", "sequence_id", F.coalesce(F.sum("length").over(own), F.lit(0)).alias("offset"))
    full = F.col("length") == capacity  # a sequence of their own
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = cuts.where(full).withColumns({"sequence_id": F.col("key"), "offset": F.lit(0).cast("long")})
    return cuts.where(~full).join(spots, "key").select(*names).unionByName(whole.select(*names))
