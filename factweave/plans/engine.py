"""The engine behind the views: documents, facts and relationships as versioned tables below one path.

A version is one small file that lists the folders of each table. A change writes new folders and then, as its last step, the file of the next
version, which must not be there yet: of two writers that began at one version the later one fails to put its file, and does its
change again on what the other left. A change that breaks off leaves the old state. What a change only adds to is not copied: an
upload that replaces nothing adds a folder of its own documents, pages and relationships (facts too, where no families are asked for).
An upload meets the stored facts incrementally; a rebuild judges all, and leaves one folder a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.operators import context, extract, families, layout
from factweave.operators.reasoning import judge
from factweave.plans import views
from factweave.schema import FACTS
from factweave.sources import scratch, tables

NAMES = ("documents", "pages", "facts", "relationships")
RELATIONSHIPS = (
    "id string, a_id string, b_id string, a_document_id string, b_document_id string, relationship_type string, divergence_factor string, confidence double, match_basis string, "
    "cross_document boolean, delta_percentage double, delta_absolute double, entity_canonical string, metric_canonical string"
)
DOCUMENTS = (
    "document_id string, original_name string, page_count int, file_size_bytes long, upload_time string, pdf_title string, pdf_author string, document_seq long, primary_entity string, "
    "subject_country string, document_date string, document_period string, document_kind string"
)
PAGES = "document_id string, page_number int, text string, char_count int, token_estimate int, period_hint string, tiles array<struct<value_text:string,label_text:string,bbox:array<double>,start:int,end:int>>"
#: How often a change is done again when other writers are faster.
TRIES = 5
_SHAPES = {"documents": DOCUMENTS, "pages": PAGES, "facts": FACTS, "relationships": RELATIONSHIPS}


class Conflict(Exception):
    """A change could not be made on top of any version before another writer had made the next one."""


class Engine:
    """families: a callable from labels to a JSON payload of families, or None for each metric its own."""

    def __init__(self, spark: SparkSession, path: str, families_call: Callable[[list[str]], str] | None = None):
        self.spark, self.path, self.call = spark, path.rstrip("/"), families_call
        self._base: int | None = None

    # Versions

    def _fs(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _log(self, version: int):
        return self._fs()[1].Path(f"{self.path}/log/{version:012d}.json")

    def _listed(self, version: int) -> dict[str, list[str]]:
        """Folders by table of a version; of version 0 none."""
        if not version:
            return {n: [] for n in NAMES}
        opened = self._fs()[0].open(self._log(version))
        try:
            return json.loads(bytes(opened.readAllBytes()))
        finally:
            opened.close()

    def version(self) -> int:
        """The highest version; 0 before any."""
        fs, hadoop = self._fs()
        found = fs.globStatus(hadoop.Path(f"{self.path}/log/*.json")) or []
        return max((int(s.getPath().getName()[:-5]) for s in found if s.getLen()), default=0)

    def table(self, name: str) -> DataFrame:
        """One of NAMES as it is now, or as it was when the change under way began; empty before the first change."""
        folders = self._listed(self.version() if self._base is None else self._base)[name]
        if not folders:
            return self.spark.createDataFrame([], _SHAPES[name])
        return self.spark.read.schema(_SHAPES[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def _change(self, work: Callable[[], tuple[dict[str, DataFrame], dict[str, DataFrame]]]) -> None:
        """One change: work() tells the tables that are new as a whole, and the rows that others get; again if another writer was faster."""
        for _ in range(TRIES):
            self._base = self.version()
            try:
                whole, more = work()
                listed = self._listed(self._base)
                for name, df in [*whole.items(), *more.items()]:
                    columns = [f.name for f in self.spark.createDataFrame([], _SHAPES[name]).schema]
                    folder = f"data/{name}-{uuid.uuid4().hex}"
                    df.select(*columns).write.parquet(f"{self.path}/{folder}")
                    listed[name] = [folder] if name in whole else [*listed[name], folder]
                if self._put(self._base + 1, listed):
                    return
            finally:
                self._base = None
        raise Conflict(f"{TRIES} times another writer was faster")

    def _put(self, version: int, listed: dict[str, list[str]]) -> bool:
        """The version's file, unless it is there already."""
        fs, _ = self._fs()
        try:
            opened = fs.create(self._log(version), False)
        except Py4JJavaError as failure:
            if "AlreadyExists" in failure.java_exception.getClass().getName() or fs.exists(self._log(version)):
                return False
            raise
        opened.write(bytearray(json.dumps(listed).encode()))
        opened.close()
        return True

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """df written to the scratch folder and read again: judging joins it many times, and neither derives nor plans it again."""
        path = scratch.path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # Changes

    def upload(self, documents: DataFrame, pages: DataFrame, incremental: bool = True) -> None:
        """Documents (document_id, original_name, ..., pdf_author) with their pages (PAGES).

        One that comes again under its name replaces the old one, before anything is matched.
        """
        self._change(lambda: self._uploaded(documents, pages, incremental))

    def _uploaded(self, documents: DataFrame, pages: DataFrame, incremental: bool) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        names = documents.select("original_name")
        old_docs = self.table("documents")
        gone = old_docs.join(names, "original_name", "left_semi").select("document_id")
        kept = old_docs.join(gone, "document_id", "left_anti")
        last = old_docs.agg(F.coalesce(F.max("document_seq"), F.lit(-1))).first()[0]
        shape = {f.name: f.dataType for f in self.spark.createDataFrame([], DOCUMENTS).schema}
        counts = pages.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
        rows = documents.drop("page_count").join(counts, "document_id", "left").withColumn("document_seq", F.row_number().over(Window.orderBy("original_name")) + F.lit(last))
        for name, kind in shape.items():
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        new_docs = self._written(context.resolve(rows.withColumnRenamed("document_id", "id"), pages), "documents")
        told = new_docs.select("document_id", F.col("original_name").alias("document_name"), "primary_entity", "subject_country", "document_date", "document_period")
        highest = self.table("facts").agg(F.coalesce(F.max("fact_seq"), F.lit(-1))).first()[0]
        new = self._written(extract.extract(pages.join(told, "document_id"), new_docs, highest + 1), "new")
        own_pages = pages.select(*self.table("pages").columns)
        if gone.isEmpty() and incremental and self.call is None:  # no fact that is stored changes
            added = self._written(self._grouped(new).select(*FACTS.fieldNames()), "facts")
            return {}, {"documents": new_docs.select(*kept.columns), "pages": own_pages, "facts": added, "relationships": judge(added, self.table("facts"))}
        facts, rels = tables.delete_documents(self.table("facts"), self.table("relationships"), gone)
        every = self._written(self._grouped(facts.unionByName(new)), "facts")
        ids = new_docs.select("document_id")
        grouped_new, grouped_old = every.join(ids, "document_id", "left_semi").select(*FACTS.fieldNames()), every.join(ids, "document_id", "left_anti").select(*FACTS.fieldNames())
        linked = judge(grouped_new, grouped_old) if incremental else judge(every)
        if gone.isEmpty():
            return {"facts": every} | ({} if incremental else {"relationships": linked}), {"documents": new_docs.select(*kept.columns), "pages": own_pages} | ({"relationships": linked} if incremental else {})
        all_pages = self.table("pages").join(gone, "document_id", "left_anti").unionByName(own_pages)
        return {"documents": kept.unionByName(new_docs.select(*kept.columns)), "pages": all_pages, "facts": every, "relationships": rels.unionByName(linked) if incremental else linked}, {}

    def upload_blocks(self, documents: DataFrame, blocks: DataFrame, incremental: bool = True) -> None:
        """upload from page blocks (schema.PAGE_BLOCKS)."""
        self.upload(documents, layout.pages(blocks), incremental)

    def load_preset(self, root: str, name: str, *decoders: tables.Decoder, replace: bool = True) -> None:
        """All files of a folder below root by the first decoder that reads each, instead of what is there or beside it."""
        if replace:
            self.clear()
        info = tables.file_info(self.spark, f"{root}/{name}").withColumn("document_id", F.col("original_name"))
        info = info.join(tables.read_info(self.spark, f"{root}/{name}", *decoders).select("document_id", "pdf_title", "pdf_author"), "document_id", "left")
        self.upload_blocks(info, tables.read_files(self.spark, f"{root}/{name}", *decoders), incremental=not replace)

    def _grouped(self, facts: DataFrame) -> DataFrame:
        return families.group(self.spark, facts, self.call)

    def rebuild(self) -> None:
        """Families and relationships of all facts anew."""
        def work():
            facts = self._written(self._grouped(self.table("facts")), "facts")
            return {"facts": facts, "relationships": judge(facts)}, {}

        self._change(work)

    def delete(self, document_id: str) -> None:
        """A document, its pages, facts and their relationships; the rest is judged anew."""
        ids = self.spark.createDataFrame([(document_id,)], "document_id string")

        def work():
            left = {n: self.table(n).join(ids, "document_id", "left_anti") for n in ("documents", "pages", "facts")}
            left["facts"] = self._written(self._grouped(left["facts"]), "facts")
            return left | {"relationships": judge(left["facts"])}, {}

        self._change(work)

    def clear(self) -> None:
        self._change(lambda: ({n: self.spark.createDataFrame([], _SHAPES[n]) for n in NAMES}, {}))

    # Reads

    def status(self) -> dict[str, int | bool]:
        return {"families_called": self.call is not None} | {n: self.table(n).count() for n in ("documents", "facts", "relationships")}

    def page(self, document_id: str, number: int) -> DataFrame:
        """One page; no row if there is none."""
        return self.table("pages").where((F.col("document_id") == document_id) & (F.col("page_number") == number))

    def fact(self, fact_id: str) -> DataFrame:
        return self.table("facts").where(F.col("id") == fact_id)

    def enriched(self) -> DataFrame:
        return views.enrich(self.table("relationships"), self.table("facts"))
