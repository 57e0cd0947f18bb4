import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from factweave.llm import importance
from factweave.llm.queries import ORACLE, QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, order=2, k=10_000):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % k for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, percent=25, least=20, order=2, k=10_000):
    """docs: (id, text); returns (id, n_features, weight, score, rank) of each, for ids once."""
    cut = [buckets(t, order, k) for _, t in docs]
    s, t = Counter(b for _, bs in cut for b in bs), Counter(b for text in target for b in buckets(text, order, k)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + k) / ((s[b] + 1) * (t_all + k)))) for b in s}
    out = []
    for (d, _), (n, bs) in zip(docs, cut, strict=True):
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs, target = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    want = by_hand([(r.doc_id, r.text) for r in docs], [r.text for r in target])
    assert sorted(map(tuple, QUERIES["op12_importance_resampling"](spark, sf).collect())) == sorted(want)
    assert "op12_importance_resampling" in ORACLE and sum(r[4] is not None for r in want) > 20


@pytest.mark.parametrize("order", [1, 2, 3])
def test_chunks_own_each_run_once(spark, monkeypatch, order):
    texts = ["Ab1 c-d \x00eéf " * 60, "x" * 500 + " y " + "中文" * 80, "one", "", " - ", None, ("p q " * 200)[:-1], "same words again " * 30, "same words again " * 30]
    docs = [(i if i < 7 else 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, bucket int")
    target = spark.createDataFrame([("p q one",), (None,), ("same words",)], "text string")
    want = by_hand(docs, ["p q one", None, "same words"], 50, 3, order, 97)
    for size in (importance.CHUNK, 50, 1):
        monkeypatch.setattr(importance, "CHUNK", size)
        found = importance.resample(df, target, percent=50, least_words=3, order=order, buckets=97)
        assert sorted(map(str, map(tuple, found.select("id", "n_features", "weight", "score", "rank").collect()))) == sorted(map(str, want))


def test_chunks():
    data = b"one two-three, four five"
    assert list(importance.chunks(data, 4, 2)) == [(b"one two-three", 1), (b"-three, four", 1), (b", four five", 1), (b" five", 0)]
    assert list(importance.chunks(data, 99, 3)) == [(data, 0)] and list(importance.chunks(b"", 4, 2)) == []
    assert b"".join(c for c, _ in importance.chunks(data, 1, 1)) == data


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (2, None, 1), (1, "a b c", 1), (1, "a b c", 1)], "doc_id int, text string, rank int")
    none = spark.createDataFrame([], "text string")
    rows = importance.resample(df, none, percent=100, least_words=3).collect()
    assert sorted(r.rank for r in rows if r.rank is not None) == [1, 2, 3] and all(r.rank is None for r in rows if r.id == 2)
    assert len({r.score for r in rows if r.id == 1}) == 1
    assert importance.resample(df, none, percent=10, least_words=3).where("rank is not null").count() == 0
    empty = importance.resample(df.limit(0), none)
    assert empty.count() == 0 and empty.columns == ["id", "n_features", "weight", "score", "rank"]


def test_rank_is_a_total_order(spark):
    rows = [(i, 0, i % 7 * 10) for i in range(500)] + [(5, 0, 50)] * 100
    df = spark.createDataFrame(rows, "id long, n_words int, score long").repartition(5)
    ranks = sorted((r.rank, -r.score, r.id) for r in importance.ranked(df, 50).where("rank is not null").collect())
    assert [r[0] for r in ranks] == list(range(1, 301))
    assert [r[1:] for r in ranks] == sorted((-s, i) for i, _, s in rows)[:300]
