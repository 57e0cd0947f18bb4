"""Files as a stream into the engine: replaced by name, read once, the same as uploads at once."""

from pyspark.sql import functions as F

from factweave.plans.engine import Engine
from factweave.sources import tables
from factweave.streaming import pages

ONE = "Northwind Freight Limited annual report.\nNorthwind Freight Limited reported revenue from operations of Rs. 1,240 crore in FY24.\nEBITDA was Rs. 96 crore in FY24."
TWO = "Northwind Freight Limited review.\nRevenue from operations of Northwind was Rs. 1,180 crore in FY24.\nEBITDA stood at Rs. 96 crore in FY24."


def decoder(seen):
    """Lines of a text as blocks of one page; what is read is told in a file."""

    def decode(data, name):
        with open(seen, "a") as out:
            out.write(f"{name}\n")
        lines = data.decode().split("\n")
        return [{"page_number": 1, "page_width": 600.0, "block_ix": i, "x0": 10.0, "y0": 20.0 * i, "x1": 500.0, "y1": 20.0 * i + 12, "block_type": 0, "text": t, "title": name} for i, t in enumerate(lines)]

    return decode


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode())


def found(engine):
    return sorted((r.metric_canonical, r.relationship_type) for r in engine.table("relationships").where("metric_canonical like 'financial.%'").collect())


def test_files_arrive_and_replace(spark, tmp_path):
    seen = str(tmp_path / "seen")
    engine = Engine(spark, str(tmp_path / "store"))
    run = lambda: pages.start(engine, str(tmp_path / "in"), str(tmp_path / "ck"), decoder(seen)).awaitTermination()
    put(tmp_path / "in" / "a", "one.pdf", ONE)
    put(tmp_path / "in" / "a", "two.pdf", TWO)
    put(tmp_path / "in" / "a", "three.txt", TWO)
    run()
    assert found(engine) == [("financial.ebitda", "CORROBORATED"), ("financial.revenue", "CONTRADICTION")]
    documents = engine.table("documents").orderBy("document_id").collect()
    assert [(r.document_id, r.page_count, r.pdf_title, r.file_size_bytes) for r in documents] == [("one.pdf", 1, "one.pdf", len(ONE)), ("two.pdf", 1, "two.pdf", len(TWO))]
    read = sorted(open(seen).read().split())
    run()  # nothing new: nothing is read again, and no version is made
    assert sorted(open(seen).read().split()) == read and engine.version() == 1
    put(tmp_path / "in" / "b", "two.pdf", TWO.replace("1,180", "1,240"))
    run()
    assert found(engine) == [("financial.ebitda", "CORROBORATED"), ("financial.revenue", "CORROBORATED")]
    assert engine.table("documents").count() == 2 and "one.pdf" not in open(seen).read().split()[len(read):]
    engine.rebuild()
    assert found(engine) == [("financial.ebitda", "CORROBORATED"), ("financial.revenue", "CORROBORATED")]


def test_the_last_of_one_name_counts_and_broken_files_are_told(spark, tmp_path):
    files = spark.createDataFrame([("x/a.pdf", "a.pdf", "2024-01-01 00:00:00"), ("y/a.pdf", "a.pdf", "2024-01-02 00:00:00"), ("z/b.pdf", "b.pdf", "2024-01-01 00:00:00"), ("w/b.pdf", "b.pdf", "2024-01-01 00:00:00")], "path string, name string, upload_time string")
    assert sorted(r.path for r in pages.latest(files).collect()) == ["y/a.pdf", "z/b.pdf"]
    engine = Engine(spark, str(tmp_path / "store"))
    put(tmp_path / "in", "one.pdf", ONE)
    (tmp_path / "in" / "bad.pdf").write_bytes(b"\xff\xfe")
    pages.start(engine, str(tmp_path / "in"), str(tmp_path / "ck"), decoder(str(tmp_path / "seen"))).awaitTermination()
    assert {r.original_name for r in engine.table("documents").collect()} == {"one.pdf", "bad.pdf"}
    assert engine.table("facts").where("document_id = 'bad.pdf'").count() == 0 and engine.table("facts").where("document_id = 'one.pdf'").count() > 0


def test_batch_and_stream_read_the_same_blocks(spark, tmp_path):
    decode = decoder(str(tmp_path / "seen"))
    for i in range(5):
        put(tmp_path / "in" / f"f{i % 2}", f"n{i}.pdf", f"line {i}\nsecond")
    stream = tables.decoded_blocks(tables.stream_files(spark, str(tmp_path / "in"), files=2), decode)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    key = F.concat_ws("|", "document_id", "block_ix", "text")
    got = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select(key).collect())
    assert got == sorted(r[0] for r in tables.read_files(spark, str(tmp_path / "in"), decode).select(key).collect()) and len(got) == 10
