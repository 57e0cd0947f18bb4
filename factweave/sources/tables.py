"""Reading and writing: page blocks and files, presets, snapshots, CSV, replacing and deleting documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schema


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Page blocks from Parquet, with the declared schema."""
    return spark.read.schema(schema.PAGE_BLOCKS).parquet(path)


Decoder = Callable[[bytes, str], list[dict]]
_INFO = "document_id string, decoder int, pdf_title string, pdf_author string, error_message string"


def _decoded(content: bytes, name: str, decoders: list[Decoder]) -> tuple[int, list[dict], str | None]:
    """(which decoder, its rows, None), or (-1, [], the last error's text) if all of them fail."""
    error = "no decoder"
    for i, decode in enumerate(decoders):
        try:
            return i, list(decode(content, name)), None
        except Exception as failure:
            error = str(failure)
    return -1, [], error


def _info(rows: list[dict], key: str) -> str | None:
    """What the file tells of itself: the first text for the key that is not blank."""
    return next((r[key].strip() for r in rows if isinstance(r.get(key), str) and r[key].strip()), None)


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def stream_files(spark: SparkSession, path: str, suffix: str = ".pdf", files: int = 1000) -> DataFrame:
    """A stream of the files below path as they come, `files` of them a batch at most: path, name, file_size_bytes, upload_time, content.

    Spark keeps which paths it has read, so a restart reads none twice; a file that is written over under its own path does not come again.
    """
    shape = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(shape).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", files).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").cast("string").alias("upload_time"), "content")


def read_files(spark: SparkSession, path: str, *decoders: Decoder, suffix: str = ".pdf") -> DataFrame:
    """decoded_blocks of the binary files below path."""
    return decoded_blocks(_files(spark, path, suffix), *decoders)


def decoded_blocks(files: DataFrame, *decoders: Decoder) -> DataFrame:
    """Page blocks of files (name, content) by decoders (bytes, name) -> rows of PAGE_BLOCKS without document_id.

    No PDF library is assumed: the decoders are given, and each is tried where those before it fail. A file that all of them
    fail on gives one block of type -1 with the last error's text.
    """
    columns = schema.PAGE_BLOCKS.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.name, pdf.content, strict=True):
                _, found, error = _decoded(bytes(content), name, list(decoders))
                found = [r for r in found if "text" in r] if error is None else [{"page_number": 0, "block_ix": 0, "block_type": -1, "text": error}]
                rows += [{"document_id": name} | r for r in found]
            yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns)

    return files.select("name", "content").mapInPandas(run, schema.PAGE_BLOCKS)


def read_info(spark: SparkSession, path: str, *decoders: Decoder, suffix: str = ".pdf") -> DataFrame:
    """decoded_info of the binary files below path."""
    return decoded_info(_files(spark, path, suffix), *decoders)


def decoded_info(files: DataFrame, *decoders: Decoder) -> DataFrame:
    """document_id, decoder (-1: all failed), pdf_title, pdf_author and error_message of each of the files (name, content).

    A decoder tells title and author in any of its rows (keys title and author); such a row need have no text.
    """
    columns = [c.split()[0] for c in _INFO.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.name, pdf.content, strict=True):
                which, found, error = _decoded(bytes(content), name, list(decoders))
                rows.append((name, which, _info(found, "title"), _info(found, "author"), error))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("name", "content").mapInPandas(run, _INFO)


def file_info(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """original_name, file_size_bytes and modification time of each file below path, without reading it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("original_name"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").cast("string").alias("upload_time"))


def presets(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """name and sorted files of each folder below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("name"), F.element_at(parts, -1).alias("file")).groupBy("name").agg(F.sort_array(F.collect_list("file")).alias("files"))


def accepted(names: DataFrame, column: str = "name", suffix: str = ".pdf") -> DataFrame:
    """Uploads whose name has the suffix, whatever its case."""
    return names.where(F.lower(column).endswith(suffix))


def replace_documents(facts: DataFrame, again: DataFrame) -> DataFrame:
    """facts with those of the documents in `again` (by name) replaced: the old ones go before anything is matched."""
    names = again.select("document_name").distinct()
    return facts.join(names, "document_name", "left_anti").unionByName(again.select(*facts.columns))


def delete_documents(facts: DataFrame, rels: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts and relationships without the documents in ids (document_id) and all that hangs on them."""
    left = rels
    for side in ("a_document_id", "b_document_id"):
        # The names of what is deleted go to the relationships; to shuffle these by document would put a large one into one task.
        left = left.join(F.broadcast(ids.select(F.col("document_id").alias(side))), side, "left_anti")
    return facts.join(ids, "document_id", "left_anti"), left


def truncated(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.limit(0)


def write_snapshot(facts: DataFrame, rels: DataFrame, path: str) -> None:
    """Both tables as JSON lines below path. Spark's committer makes each table appear whole."""
    schema.nest(facts).write.mode("overwrite").json(f"{path}/facts")
    rels.write.mode("overwrite").json(f"{path}/relationships")


def read_snapshot(spark: SparkSession, path: str, rels_schema: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a snapshot; lines that do not parse are dropped, and a snapshot that is not there is empty."""
    nested = schema.nest(spark.createDataFrame([], schema.FACTS)).schema
    out = []
    for name, shape in (("facts", nested), ("relationships", rels_schema)):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        out.append(spark.read.schema(shape).option("mode", "DROPMALFORMED").json(f"{path}/{name}") if there else spark.createDataFrame([], shape))
    return schema.with_defaults(schema.flatten(out[0])), out[1]


#: Columns of the CSV export, in order.
CSV_COLUMNS = ("entity", "metric", "metric_canonical", "raw_value", "normalized_numeric_value", "normalized_unit", "period", "scope", "accounting_standard", "confidence", "extraction_method", "document_name", "page_number", "exact_quote")


def csv_lines(facts: DataFrame) -> DataFrame:
    """One quoted line for each fact, quotes doubled."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in CSV_COLUMNS]
    return facts.select("fact_seq", F.concat_ws(",", *cells).alias("line"))


def write_csv(facts: DataFrame, path: str) -> None:
    """The export as CSV files with a header, every field quoted."""
    facts.select(*CSV_COLUMNS).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"normalized_numeric_value": "double", "confidence": "double", "page_number": "int"}
    shape = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in CSV_COLUMNS)
    return spark.read.schema(shape).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
