import random

import brute
from factweave.llm import near_dedup
from factweave.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, node int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1) for d, t in rows], SCHEMA)


def planted(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 120))] for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(9):
            own = list(b)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [rows[0]] * 5 + [rows[0].upper(), None, "", "   ", "One", "one two", "ONE two", "one", "a b c " * 4000, "a b c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark, monkeypatch):
    rows = planted()
    for block in (512, 4):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        for k, percent in ((3, 85), (5, 80)):
            got = {(r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), shingle=k, percent=percent).collect()}
            assert got == set(brute.near(rows, k, percent))


def test_one_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(240):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = {(r.id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), shingle=3, percent=85).collect()}
    assert got == set(brute.near(rows, 3, 85)) and len({c for _, _, c in got}) > 1


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op4_minhash_near_dedup"](spark, sf).collect()}
    assert got == {(d, n, c, d == c) for d, n, c in brute.near(rows, 3, 85)}


def test_drop_keeps_columns_one_row_of_each_group(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text), (3, text), (None, text), (9, None), (9, None), (None, None), (8, "other words here")]
    out = near_dedup.drop_near_duplicates(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rk", "node"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) == [(False, 3, text), (False, 8, "other words here"), (False, 9, ""), (False, 9, ""), (True, 0, "")]


def test_empty_table(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.drop_near_duplicates(frame(spark, [])).count() == 0
