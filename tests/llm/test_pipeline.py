import corpus_pipeline
from factweave.llm import near_dedup
from factweave.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        seen[name] = [r.asDict() for r in docs.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    left = spark.createDataFrame([(r["doc_id"], r["text"]) for r in seen["near_dedup"]], "doc_id long, text string")
    assert all(r.id == r.component_id for r in near_dedup.near_duplicates(left).collect())
    assert len(seen["pii"]) == len(seen["near_dedup"]) and all(r["n_chars"] == len(r["text"]) for r in seen["pii"])
    assert not any("@mail" in r["text"] for r in seen["pii"])
    pieces = corpus_pipeline.run(spark, SF).collect()
    rows = seen["mixing"]
    texts = {}
    for r in rows:
        texts[r["doc_id"]] = r["text"]
    many = {d: sum(r["doc_id"] == d for r in rows) for d in texts}
    assert len(pieces) >= len(rows) and max(many.values()) <= 2
    firsts = [p for p in pieces if p.piece == 0]
    assert sorted(p.doc_id for p in firsts) == sorted(r["doc_id"] for r in rows)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_large_ids_beside_nulls(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "some words", {"k": 1}, None), (None, "other words", None, big)], "doc_id long, text string, extra map<string,int>, rk_source long")
    for name, stage in [s for s in corpus_pipeline.STAGES if s[0] in ("toxicity", "near_dedup", "pii")]:
        rows = stage(spark, docs, SF).collect()
        assert {r.doc_id for r in rows} == {big, None} and {r.rk_source for r in rows} == {big, None}, name


def test_edges(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 1), (2, "mail me at a@b.cd now", "en", "a", 21, 1), (2, "mail me at a@b.cd now", "en", "a", 21, 1), (3, "x " * 30000, None, "b", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() > 0) == (table is docs)
