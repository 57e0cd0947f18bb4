"""Views of documents that come, are replaced and go, kept as signed rows.

A batch tells uploads: facts of documents with the number of their upload, and deletions. What a document had before is taken back by rows of
sign -1, what it has now comes with sign 1, and a view is the sum of its signed rows. A batch reads the facts of the parts that its own
come and go in, never all of them, and no relationship that is stored: those of a fact that goes are judged once more and taken off.

Uploads are numbered, and of a document's uploads the highest counts in whatever order they arrive: an older one that comes late, or the same one
again, changes nothing. An upload tells its document whole, in one batch. A batch writes its folders under its own number with overwrite and reads
only those of lower numbers, so one that is repeated after a failure leaves what it left before. Numbers of facts (fact_seq) differ among all facts that
are there at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from factweave.operators.reasoning import AGREE, CONFLICT, judge
from factweave.plans.views import matchable
from factweave.schema import FACTS
from factweave.streaming.incremental import part

#: What a stream tells: facts with the number of their upload; a row with `deleted` set names a document that goes.
UPLOADS = StructType([*FACTS.fields, StructField("upload", LongType()), StructField("deleted", BooleanType())])
#: Parts of the stored facts, and batches after which the rows of views are summed up.
PARTS, MERGED = 32, 16
_ROWS = StructType([*FACTS.fields, StructField("batch", LongType()), StructField("part", IntegerType())])
_GONE = StructType([*FACTS.fields, StructField("since", LongType()), StructField("batch", LongType()), StructField("part", IntegerType())])
_NAMES = StructType([StructField("document_name", StringType()), StructField("upload", LongType()), StructField("batch", LongType())])
_PAIRS = (
    "id string, a_id string, b_id string, a_document_id string, b_document_id string, relationship_type string, divergence_factor string, confidence double, match_basis string, "
    "cross_document boolean, delta_percentage double, delta_absolute double, entity_canonical string, metric_canonical string, sign long, batch long"
)
#: The views: what their rows are of, and what is summed.
KEYS = {
    "verdicts": "relationship_type string, divergence_factor string, match_basis string, cross_document boolean",
    "documents": "document_id string", "pairs": "doc_a string, doc_b string, relationship_type string", "metrics": "metric_canonical string, document_id string",
    "evidence": "metric_canonical string", "degrees": "id string, document_id string",
}
SUMS = {"verdicts": ("n",), "documents": ("facts", "matchable"), "pairs": ("n",), "metrics": ("facts",), "evidence": ("corroborated", "conflicting"), "degrees": ("links",)}


def _keys(view: str) -> list[str]:
    return [k.split()[0] for k in KEYS[view].split(", ")]


def signed_views(facts: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The rows that signed facts and signed relationships add to each view."""
    count = lambda of: F.sum(F.when(of, F.col("sign")).otherwise(0))
    ends = F.explode(F.array(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_document_id").alias("document_id")) for s in "ab"])).alias("end")
    return {
        "verdicts": pairs.groupBy(*_keys("verdicts")).agg(F.sum("sign").alias("n")),
        "documents": facts.groupBy("document_id").agg(F.sum("sign").alias("facts"), count(matchable()).alias("matchable")),
        "pairs": pairs.groupBy(F.least("a_document_id", "b_document_id").alias("doc_a"), F.greatest("a_document_id", "b_document_id").alias("doc_b"), "relationship_type").agg(F.sum("sign").alias("n")),
        "metrics": facts.where(matchable()).groupBy("metric_canonical", "document_id").agg(F.sum("sign").alias("facts")),
        "evidence": pairs.where("cross_document").groupBy("metric_canonical").agg(count(F.col("relationship_type") == AGREE).alias("corroborated"), count(F.col("relationship_type") == CONFLICT).alias("conflicting")),
        "degrees": pairs.select("sign", ends).groupBy("end.id", "end.document_id").agg(F.sum("sign").alias("links")),
    }


class Maintained:
    """The store below a path: added and removed facts, uploads, signed relationships, signed rows of views."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, merged: int = MERGED):
        self.spark, self.path, self.parts, self.merged = spark, path.rstrip("/"), parts, merged

    def _there(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _read(self, name: str, shape: StructType | str, before: int | None = None) -> DataFrame:
        """A stored table, of the batches before one; empty where nothing is."""
        if not self._there(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, number: int, by_part: bool = False) -> None:
        rows = rows.repartition("part") if by_part else rows
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("part") if by_part else writer).parquet(f"{self.path}/{name}/batch={number}")

    def _latest(self, before: int | None = None) -> DataFrame:
        """document_name, upload and since (the batch it came in) of each document's highest upload, deletions included."""
        rows = self._read("uploads", _NAMES, before)
        return rows.groupBy("document_name").agg(F.max(F.struct("upload", "batch")).alias("last")).select("document_name", "last.upload", F.col("last.batch").alias("since"))

    def _live(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """Facts as they stand, with since; of some parts."""
        added, gone = self._read("added", _ROWS, before).withColumnRenamed("batch", "since"), self._read("removed", _GONE, before).select("id", "since", "part")
        if parts is not None:
            added, gone = added.where(F.col("part").isin(parts)), gone.where(F.col("part").isin(parts))
        return added.join(gone, ["id", "since", "part"], "left_anti")

    def apply(self, batch: DataFrame, number: int) -> None:
        """One batch of UPLOADS."""
        known = self._latest(number)
        told = batch.where(F.col("document_name").isNotNull()).groupBy("document_name").agg(F.max("upload").alias("upload"))
        newer = told.join(known.withColumnRenamed("upload", "before"), "document_name", "left").where("before is null or upload > before")
        self._write(newer.select("document_name", "upload"), "uploads", number)
        names = self._read("uploads", _NAMES).where(F.col("batch") == number).select("document_name", "upload")

        facts = batch.where(~F.coalesce("deleted", F.lit(False))).join(names, ["document_name", "upload"], "left_semi")
        self._write(facts.select(*FACTS.fieldNames()).withColumn("part", part(self.parts)), "added", number, by_part=True)
        old = known.select("document_name", "since").join(names.select("document_name"), "document_name", "left_semi")
        since = [r.since for r in old.select("since").distinct().collect()]  # numbers of batches
        had = self._read("added", _ROWS, number).where(F.col("batch").isin(since)).withColumnRenamed("batch", "since").join(old, ["document_name", "since"], "left_semi")
        self._write(had.select(*FACTS.fieldNames(), "since", "part"), "removed", number, by_part=True)

        new = self._read("added", _ROWS).where(F.col("batch") == number)
        gone = self._read("removed", _GONE).where(F.col("batch") == number)
        parts = [r.part for r in new.select("part").union(gone.select("part")).distinct().collect()]  # at most self.parts numbers
        stay = self._live(number, parts).join(gone.select("id", "since", "part"), ["id", "since", "part"], "left_anti").select(*FACTS.fieldNames())
        sides = [(rows.select(*FACTS.fieldNames()), F.lit(sign).cast("long").alias("sign")) for rows, sign in ((new, 1), (gone, -1))]
        pairs = [judge(rows, stay, ordered=True).select("*", sign) for rows, sign in sides]
        self._write(pairs[0].unionByName(pairs[1]), "relationships", number)

        marked = [rows.select("*", sign) for rows, sign in sides]
        own = self._read("relationships", _PAIRS).where(F.col("batch") == number)
        for view, rows in signed_views(marked[0].unionByName(marked[1]), own).items():
            self._write(self._nonzero(rows, view), f"views/{view}", number)
        if number % self.merged == self.merged - 1:
            self.merge(number)

    def start(self, uploads: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """A stream of UPLOADS into this store."""
        writer = uploads.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    # Reads

    @staticmethod
    def _nonzero(rows: DataFrame, view: str) -> DataFrame:
        return rows.where(" or ".join(f"{c} <> 0" for c in SUMS[view]))

    def _shape(self, view: str) -> str:
        return ", ".join([KEYS[view], *[f"{c} long" for c in SUMS[view]], "batch long"])

    def _base(self, view: str) -> int:
        """The last batch that a finished sum of a view's rows covers; -1 if there is none."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(f"{self.path}/sums/{view}/batch=*/_SUCCESS")
        found = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(top) or []
        return max((int(s.getPath().getParent().getName().partition("=")[2]) for s in found), default=-1)

    def view(self, view: str, upto: int | None = None) -> DataFrame:
        """A view as it stands: the last sum of its rows and what came after."""
        base = self._base(view)
        rows = self._read(f"views/{view}", self._shape(view)).where(F.col("batch") > base)
        if upto is not None:
            rows = rows.where(F.col("batch") <= upto)
        if base >= 0:
            rows = rows.unionByName(self._read(f"sums/{view}", self._shape(view)).where(F.col("batch") == base))
        return self._nonzero(rows.groupBy(*_keys(view)).agg(*[F.sum(c).alias(c) for c in SUMS[view]]), view)

    def merge(self, number: int) -> None:
        """Sum the rows of all views up to a batch, so that reads need not go through each batch; a repeated batch sums the same."""
        for view in KEYS:
            if self._base(view) < number:
                self._write(self.view(view, number), f"sums/{view}", number)

    def facts(self) -> DataFrame:
        return self._live().select(*FACTS.fieldNames())

    def relationships(self) -> DataFrame:
        """The relationships that stand: those whose signs do not cancel out."""
        rows = self._read("relationships", _PAIRS).drop("batch")
        names = [c for c in rows.columns if c != "sign"]
        return rows.groupBy(*names).agg(F.sum("sign").alias("sign")).where("sign <> 0").select(*names)

    def coverage(self) -> DataFrame:
        """Facts and documents of each metric, and its agreements and conflicts across documents."""
        per = self.view("metrics").groupBy("metric_canonical").agg(F.sum("facts").alias("facts"), F.count_if(F.col("facts") > 0).alias("documents"))
        return per.join(self.view("evidence"), "metric_canonical", "left").na.fill(0, ["corroborated", "conflicting"])

    def health(self) -> DataFrame:
        """Of each document: facts, matchable ones, and those of them in a relationship (only matchable ones ever are)."""
        linked = self.view("degrees").groupBy("document_id").agg(F.count(F.lit(1)).alias("linked"))
        return self.view("documents").join(linked, "document_id", "left").na.fill(0, ["linked"])
