import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factweave.llm.packing import _counts, cut, pack, places, sequences, sweep, wanted
from factweave.llm.queries import QUERIES


def check(rows, texts, capacity=1024):
    """rows: piece rows; texts: the text of each id, ids once."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for d, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, s, n) for k, (s, n) in enumerate(cut(len(ids), capacity))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bins, least = check(QUERIES["op1_best_fit_packing"](spark, sf).collect(), texts)
    assert bins <= least * 1.01 + 2


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def best_fit(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        opened += not fit
        gap = min(fit) if fit else capacity
        if fit:
            gaps.remove(gap)
        gaps.append(gap - n)
    return opened


def pieces_of(spark, lengths):
    return spark.createDataFrame(list(enumerate(map(int, lengths))), "key long, length long").repartition(5)


def test_sweep_is_best_fit_one_by_one(spark):
    """Longest piece first, each into the smallest place that is free: the sizes that meet are the same."""
    rng = np.random.default_rng(3)
    lengths, rooms = rng.integers(1, 40, 300).tolist() + [7] * 150, rng.integers(1, 60, 200).tolist() + [9] * 80
    left = pieces_of(spark, lengths)
    gaps = spark.createDataFrame(list(enumerate(rooms)), "sequence_id long, room long").where(f"room >= {min(lengths)}")
    many, sizes = _counts(left, gaps)
    met = sweep(left, gaps, many, sizes).collect()
    free = sorted(room for room, k in places(many, sizes) for _ in range(k * sizes[room]))
    want = []
    for n in sorted(lengths, reverse=True):
        fit = next((i for i, room in enumerate(free) if room >= n), None)
        if fit is not None:
            want.append((n, free.pop(fit)))
    room_of = dict(enumerate(rooms))
    found = [r for r in met if r.kind == 0 and r.sequence_id is not None]
    assert sorted((r.size, room_of[r.sequence_id]) for r in found) == sorted(want)
    taken = [r for r in met if r.taken is not None]
    assert sorted((r.taken, r.key) for r in taken) == sorted((r.size, r.sequence_id) for r in found)


def test_wanted():
    assert wanted({3: 2}, {}, 4) == 2 and wanted({3: 2}, {4: 2}, 4) == 0 and wanted({3: 2, 1: 9}, {2: 5}, 4) == 2 and wanted({}, {4: 1}, 4) == 0


def test_sequences_are_few_and_hold_their_pieces(spark):
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 65, 700), [1] * 900, [20] * 300 + [44] * 100, [33, 31] * 40, [64] * 9, []):
        lengths = [int(n) for n in lengths]
        rows = sequences(pieces_of(spark, lengths), 64).collect()
        assert sorted((r.key, r.length) for r in rows) == [(i, n) for i, n in enumerate(lengths) if n < 64]
        load = {}
        for r in rows:
            load[r.sequence_id] = load.get(r.sequence_id, 0) + r.length
        assert max(load.values(), default=0) <= 64
        assert len(load) + lengths.count(64) <= best_fit(lengths, 64) * 1.02 + 1


def test_edges(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "a b c " * 3000, 7), (4, "<|endoftext|> \U0001f600 é", 7), (None, "x", 7), (5, "a <|endoftext|> b", 7), (6, "x  <|endoftext|><|endoftext|>\n\n <|endoftext|", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check(pack(df).collect(), {r[0]: r[1] for r in rows})
    assert next((r.length, r.ids_crc32) for r in pack(df).collect() if r.doc_id == 5) == (5, 3672784330)
    twice = pack(df.union(df)).collect()
    assert len(twice) == 2 * len(pack(df).collect())
    assert pack(df.limit(0)).count() == 0
