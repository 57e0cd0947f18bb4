import hashlib
import random
import zlib

import pytest
from brute import WORDS

from factweave.llm import periodic
from factweave.llm.queries import QUERIES


def by_hand(w, least=24, times=3):
    """All runs by trying every period: (start, end, period)."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        letters = rnd.choice([1, 2, 2, 3, 5, 30, 200])
        w = [rnd.randrange(letters) for _ in range(rnd.randint(0, 300))]
        for _ in range(rnd.randint(0, 4)):
            unit = [rnd.randrange(letters) for _ in range(rnd.randint(1, 30))]
            if rnd.random() < 0.4 and len(w) > 60:
                at = rnd.randrange(len(w) - 50)
                unit = w[at : at + rnd.randint(1, 60)]
            at = rnd.randint(0, len(w))
            w[at:at] = (unit * rnd.randint(3, 6))[: rnd.randint(24, 160)]
        yield w


@pytest.mark.parametrize("least, times", [(24, 3), (9, 3), (8, 4)])
def test_runs_by_every_period(least, times):
    seen = 0
    for w in sequences(least + times, 250):
        want = by_hand(w, least, times)
        seen += len(want)
        assert periodic.runs(w, least, times) == want == periodic.runs_of_stretch(w, least, times)
    assert seen > 200


def test_factors():
    for w in sequences(9, 60):
        at = 0
        for start, end, source in periodic.factors(w):
            assert start == at and end > start
            earlier = [s for s in range(start) if w[s : s + end - start] == w[start:end]]
            assert (source in earlier) if source >= 0 else (not earlier and end == start + 1)
            longer = w[start : end + 1]
            assert end == len(w) or not any(w[s : s + len(longer)] == longer for s in range(start))
            at = end
        assert at == len(w)


def test_long_runs_are_linear():
    assert periodic.runs([0] * 100_000) == [(0, 100_000, 1)]
    w = list(range(2000)) * 20
    assert periodic.runs(w + [-1]) == [(0, 40_000, 2000)]


def contract(doc_id, text):
    w = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = by_hand(w)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2])) if found else None
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    return (doc_id, len(found), *shown, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, QUERIES["op13_period_runs"](spark, sf).collect()))
    want = sorted(contract(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert rows == want and sum(r[1] > 0 for r in want) > 10


def test_edges(spark):
    rows = [(1, None, 1), (1, "", 1), (2, " \t\n", 1), (None, "a " * 30, 1), (3, ("b " * 9 + "c ") * 3 + "x " * 24, 1), (3, ("b " * 9 + "c ") * 3 + "x " * 24, 1), (4, "a " * 40, 1), (5, "X x " * 12, 1), (6, "x " * 23, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = sorted(((r.id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.detect(df).collect()), key=str)
    want = [(1, [], ""), (1, [], ""), (2, [], ""), (None, [(0, 30, 1)], "a"), (4, [], "a " * 40), (5, [(0, 24, 2)], "X x"), (6, [], " ".join("x" * 23))]
    twice = (3, [(0, 30, 10), (30, 24, 1)], " ".join("b" * 9 + "cx"))
    assert found == sorted([*want, twice, twice], key=str)
    assert periodic.detect(df.limit(0)).count() == 0


def test_strongest(spark):
    runs = [[(5, 30, 10), (2, 24, 8), (40, 60, 20)], [], [(0, 31, 10), (9, 30, 9)], None]
    df = spark.createDataFrame([(r,) for r in runs], "r array<struct<start:long,length:long,period:long>>")
    got = [r.b and tuple(r.b) for r in df.select(periodic.strongest(df.r).alias("b")).collect()]
    assert got == [(2, 24, 8), None, (9, 30, 9), None]
