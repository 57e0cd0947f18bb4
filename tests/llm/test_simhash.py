import numpy as np
import xxhash
from brute import words

from factweave.llm import simhash
from factweave.llm.queries import QUERIES

MOST = 4


def by_hand(text, k):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows, distance=MOST):
    """rows: (id, fingerprint); the smallest id that each reaches."""
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(QUERIES["op11_simhash_near_dedup"](spark, sf).collect())
    want = [(d, by_hand(texts[d], 4)) for d in sorted(texts)]
    assert [(r.doc_id, r.fingerprint) for r in rows] == [(d, f"{f:016x}") for d, f in want]
    assert [r.component_id for r in rows] == components_by_hand(want)


def test_whole_table_against_all_pairs(spark):
    """All distinct fingerprints of 10,000 documents against each other, in blocks of rows."""
    found = QUERIES["op11_simhash_near_dedup"](spark, "/root/testdata/sf0.1").collect()
    prints = {}
    for r in found:
        prints[r.fingerprint] = min(r.doc_id, prints.get(r.fingerprint, r.doc_id))
    names = sorted(prints)
    x = np.array([int(n, 16) for n in names], np.uint64)
    pairs = [(at + i, j) for at in range(0, len(x), 500) for i, j in zip(*np.nonzero(np.bitwise_count(x[at : at + 500, None] ^ x[None, :]) <= MOST), strict=True) if at + i < j]
    root = simhash.forest(len(x), *np.array(pairs, np.int64).reshape(-1, 2).T)
    low = {}
    for n, r in zip(names, root.tolist(), strict=True):
        low[r] = min(prints[n], low.get(r, prints[n]))
    want = {n: low[r] for n, r in zip(names, root.tolist(), strict=True)}
    assert len(pairs) > 5 and all(r.component_id == want[r.fingerprint] for r in found)


def test_windows(monkeypatch):
    text = "a B\tc d e　f " * 40 + "\x00 x" + " \x0b\x1f y" * 9 + "w" * 300
    monkeypatch.setattr(simhash, "WINDOW", 7)
    monkeypatch.setattr(simhash, "AT_ONCE", 3)
    for k in (1, 2, 4, 5, 10_000):
        assert simhash.fingerprint(text.encode(), k) == by_hand(text, k)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \t\n") == 0


def test_edges(spark):
    rows = [(5, None, 1), (3, "", 1), (4, "one two", 1), (9, "ONE  two", 1), (None, "one two", 1), (9, "one two", 1), (7, "x " * 50_000, 1), (None, "lonely words are these here", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    prints = [(d, by_hand(t, 5)) for d, t, _ in rows]
    assert got == sorted([(d, f, c) for (d, f), c in zip(prints, components_by_hand(prints), strict=True)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_pigeonhole_finds_every_link(spark, monkeypatch):
    """Random fingerprints with chains of near ones, many of which share keys: blocks of a bucket meet too."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60)
    prints = {int(b) for b in base}
    for b in base[:30]:
        x = int(b)
        for _ in range(int(rng.integers(1, 40))):
            for bit in rng.choice(63, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    hot = int(base[0]) & ~0xFFFFF
    prints |= {hot | int(v) for v in rng.integers(0, 2**20, 200)}
    rows = sorted(prints)
    df = spark.createDataFrame([(p,) for p in rows], "fp long")
    want = components_by_hand([(i, p) for i, p in enumerate(rows)])
    for blocks in (5, 6, 8):
        links = simhash.close_links(df, MOST, blocks).distinct().collect()
        place = {p: i for i, p in enumerate(rows)}
        root = simhash.forest(len(rows), np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]))
        assert root.tolist() == want


def test_masks_and_blocks():
    for blocks in (5, 6, 7):
        masks = [m % 2**64 for m in simhash.block_masks(blocks, 4)]
        rng = np.random.default_rng(1)
        for _ in range(200):
            gone = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not m & gone for m in masks)
    assert simhash.blocks_for(10, 4) == 6 and simhash.blocks_for(10**9, 4) == 7 and simhash.blocks_for(10**11, 4) == 9
