from factweave.plans import views
from factweave.plans.engine import Engine

DOCS = "document_id string, original_name string, pdf_author string"
PAGES = "document_id string, page_number int, text string, char_count int, token_estimate int, period_hint string, tiles array<struct<value_text:string,label_text:string,bbox:array<double>,start:int,end:int>>"
ONE = "Northwind Freight Limited annual report.\nNorthwind Freight Limited reported revenue from operations of Rs. 1,240 crore in FY24.\nEBITDA was Rs. 96 crore in FY24."
TWO = "Northwind Freight Limited review.\nRevenue from operations of Northwind was Rs. 1,180 crore in FY24.\nEBITDA stood at Rs. 96 crore in FY24."


def upload(engine, name, text, doc=None, **rest):
    spark = engine.spark
    doc = doc or name
    engine.upload(spark.createDataFrame([(doc, name, None)], DOCS), spark.createDataFrame([(doc, 1, text, len(text), 1, None, [])], PAGES), **rest)


def verdicts(engine):
    return sorted((r.metric_canonical, r.relationship_type) for r in engine.table("relationships").collect())


def test_life_of_an_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.status() == {"families_called": False, "documents": 0, "facts": 0, "relationships": 0}
    upload(engine, "one.pdf", ONE)
    upload(engine, "two.pdf", TWO)
    want = [("financial.ebitda", "CORROBORATED"), ("financial.revenue", "CONTRADICTION")]
    assert [v for v in verdicts(engine) if v[0].startswith("financial")] == want
    assert {r.primary_entity for r in engine.table("documents").collect()} == {"Northwind Freight Limited"}
    incremental = verdicts(engine)
    engine.rebuild()
    assert verdicts(engine) == incremental
    queue = views.review_queue(engine.enriched()).collect()
    assert [(q.metric_canonical, q.also) for q in queue] == [("financial.revenue", 0)]
    upload(engine, "two.pdf", TWO.replace("1,180", "1,240"), doc="again")
    assert [v for v in verdicts(engine) if v[0].startswith("financial")] == [("financial.ebitda", "CORROBORATED"), ("financial.revenue", "CORROBORATED")]
    assert engine.table("documents").count() == 2 and engine.page("again", 1).count() == 1 and engine.page("two.pdf", 1).count() == 0
    engine.delete("again")
    assert verdicts(engine) == [] and engine.table("facts").where("document_id = 'again'").count() == 0
    engine.clear()
    assert engine.status()["facts"] == 0


def test_families_bring_labels_together(spark, tmp_path):
    payload = '{"families": [{"family_id": "space", "members": [{"raw": "Warehouse space (units)", "confidence": 0.9}, {"raw": "Storage area (units)", "confidence": 0.9}]}]}'
    engine = Engine(spark, str(tmp_path / "store"), lambda names: payload)
    text = "Northwind Freight Limited.\n{} was 1,200 units in FY24."
    upload(engine, "one.pdf", text.format("Warehouse space"))
    upload(engine, "two.pdf", text.format("Storage area"))
    (r,) = engine.table("relationships").collect()
    assert (r.relationship_type, r.match_basis) == ("CORROBORATED", "family")


def folders(engine):
    return engine._listed(engine.version())


def test_an_upload_adds_and_copies_nothing(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    upload(engine, "one.pdf", ONE)
    before = folders(engine)
    upload(engine, "two.pdf", TWO)
    after = folders(engine)
    assert all(after[n][: len(before[n])] == before[n] and len(after[n]) == len(before[n]) + 1 for n in after)
    grown = verdicts(engine)
    engine.rebuild()
    assert verdicts(engine) == grown and [len(folders(engine)[n]) for n in ("documents", "facts", "relationships")] == [2, 1, 1]


def test_of_two_racing_writers_one_does_its_change_again(spark, tmp_path):
    store = str(tmp_path / "store")
    slow, fast = Engine(spark, store), Engine(spark, store)
    upload(slow, "one.pdf", ONE)
    real, tries = slow._uploaded, []

    def overtaken(*args):
        tries.append(slow._base)
        found = real(*args)
        if len(tries) == 1:
            upload(fast, "two.pdf", TWO)
        return found

    slow._uploaded = overtaken
    upload(slow, "three.pdf", TWO.replace("1,180", "1,181"))
    assert tries == [1, 2] and slow.version() == 3
    assert {r.original_name for r in fast.table("documents").collect()} == {"one.pdf", "two.pdf", "three.pdf"}
    seqs = [r.fact_seq for r in fast.table("facts").collect()]
    assert len(seqs) == len(set(seqs))
    lost = verdicts(fast)
    fast.rebuild()
    assert verdicts(fast) == lost
