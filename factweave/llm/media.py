"""Media columns: payloads stored by content in tar shards, with headers read by range.

A payload is written as an 8-bit greyscale PNG, WIDTH samples to a row, into tar shards in the shared folder. Rows carry its
digest and its place (shard, offset, length): inside a shard a payload that repeats is stored once. Shard names hold
the task and a random part, so a second attempt of a task writes shards of its own and the rows of the attempt
that succeeded point at complete files. Metadata columns come from the first HEADER bytes at the place, the samples from
the whole range; all of it goes through the file system that the folder's URI names.

Defined results: a null text is an empty one (one row of padding); rows that repeat, or equal texts, have equal values, whichever
shard holds them; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm.common import materialize, scratch_path, whole_text

#: Samples to a row of the image; the filler of the last row; bytes of the header range; bytes after which a shard is closed;
#: stored bytes that a task reads back.
WIDTH, FILL, HEADER, SHARD, RANGE = 576, b"\xff", 33, 128 << 20, 8 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """data up to a positive multiple of WIDTH."""
    return data + FILL * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 1) -> bytes:
    """The payload as an 8-bit greyscale PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first HEADER bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", first[16:25])


def decode(stored: bytes) -> bytes:
    """The samples of a PNG that encode() wrote, its chunks' check sums verified."""
    width, height, depth = header(stored[:HEADER])
    at, packed = 8, []
    while at < len(stored):
        (size,) = struct.unpack(">I", stored[at : at + 4])
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("unexpected depth or filter")
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and a 64-bit mean hash (8 by 8 cells) of the samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    cells = x.reshape(64, -1).mean(1) > mean
    return f"{mean:.4f}:{x.std():.4f}:{int.from_bytes(np.packbits(cells).tobytes(), 'big'):016x}"


class _Shard:
    """A tar file that is being written; add() gives the offset of a member's bytes."""

    def __init__(self, folder: str, part: int):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"shard-{part:05d}-{uuid.uuid4().hex}.tar"
        self.out, self.at, self.places = fs.open_output_stream(f"{path}/{self.name}"), 0, {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        if digest in self.places:
            return self.places[digest]
        head = bytearray(512)
        for at, field in ((0, f"{digest}.png".encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % len(data)), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
            head[at : at + len(field)] = field
        head[148:156] = b"%06o\0 " % sum(head)
        self.out.write(bytes(head) + data + bytes(-len(data) % 512))
        self.places[digest] = self.at + 512, len(data)
        self.at += 512 + len(data) + -len(data) % 512
        return self.places[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media_sha256, shard, offset, length) of every row, its payload being in a shard in folder."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = None, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for value in batch.column(1):
                data = value.as_py().encode("utf-8", "surrogatepass")
                stored = encode(padded(data))
                digest = hashlib.sha256(stored).hexdigest()
                if shard is None or shard.at > SHARD:
                    if shard is not None:
                        shard.close()
                    shard = _Shard(folder, part)
                out.append((len(data), digest, shard.name, *shard.add(digest, stored)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "media_sha256", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    fields = [T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("media_sha256", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))]
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *fields]))


def _ranged(catalog: DataFrame, folder: str, size, names: list[str], kinds: list, fill) -> DataFrame:
    """catalog with columns that fill(bytes of the range) gives; size(length) is how many bytes of a place are read."""
    columns = catalog.columns
    places = [columns.index(c) for c in ("shard", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        opened, files = None, None
        last: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                if shard != opened:
                    if files is not None:
                        files.close()
                    opened, files, last = shard, fs.open_input_file(f"{path}/{shard}"), {}
                if (offset,) not in last:
                    if len(last) > 10_000:
                        last.clear()
                    last[(offset,)] = fill(files.read_at(size(length), offset))
                out.append(last[(offset,)])
            new = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k[1]) for c, k in zip(new, kinds, strict=True))], [*columns, *names])
        if files is not None:
            files.close()

    schema = T.StructType([*catalog.schema.fields, *(T.StructField(n, k[0]) for n, k in zip(names, kinds, strict=True))])
    return catalog.mapInArrow(run, schema)


_LONG, _STRING = (T.LongType(), pa.int64()), (T.StringType(), pa.string())


def with_headers(catalog: DataFrame, folder: str) -> DataFrame:
    """catalog with width, height and depth, from the header range of each place alone."""
    return _ranged(catalog, folder, lambda n: min(n, HEADER), ["width", "height", "depth"], [_LONG] * 3, header)


def with_samples(catalog: DataFrame, folder: str) -> DataFrame:
    """catalog with what the stored bytes, read back and decoded, say of the payload."""

    def fill(stored: bytes) -> tuple:
        payload = decode(stored)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(stored).hexdigest(), feature(payload)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "stored_sha256", "feature"]
    return _ranged(catalog, folder, lambda n: n, names, [_LONG, _STRING, _LONG, _STRING, _STRING], fill)


def media_table(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """(catalog with header columns, folder of its shards)."""
    folder = scratch_path(docs.sparkSession, "media")
    catalog = materialize(store(docs, folder, id_col, text), "catalog")
    return with_headers(spread(catalog), folder), folder


def spread(catalog: DataFrame) -> DataFrame:
    """catalog dealt so that each task reads about RANGE stored bytes, one after the other: its own rows are few and small."""
    total = catalog.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return catalog.repartitionByRange(max(1, -(-total // RANGE)), "shard", "offset").sortWithinPartitions("shard", "offset")
