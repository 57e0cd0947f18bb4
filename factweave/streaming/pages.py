"""Files that arrive below a folder, decoded and uploaded to the engine by micro-batches.

A batch is one upload: its documents replace those of their names, and what it brings meets what is stored. A batch that is repeated after a
failure replaces what it uploaded itself, so it changes nothing. A new edition of a document comes as a file of its name in another folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.plans.engine import Engine
from factweave.sources import scratch, tables


def latest(files: DataFrame) -> DataFrame:
    """Of the files of one name the last one to come, by time and then by path."""
    last = files.groupBy("name").agg(F.max(F.struct("upload_time", "path")).alias("last")).select(F.col("last.path").alias("path"))
    return files.join(last, "path", "left_semi")


def start(engine: Engine, folder: str, checkpoint: str, *decoders: tables.Decoder, suffix: str = ".pdf", files: int = 1000, once: bool = True) -> StreamingQuery:
    """Upload the files below folder to the engine as they come; with once, those that are there, and then end."""

    def upload(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = latest(batch)
        told = tables.decoded_info(own, *decoders).select("document_id", "pdf_title", "pdf_author")
        rows = own.select(F.col("name").alias("document_id"), F.col("name").alias("original_name"), "file_size_bytes", "upload_time").join(told, "document_id", "left")
        path = scratch.path(spark, f"batch-{number}")
        for name, df in (("documents", rows), ("blocks", tables.decoded_blocks(own, *decoders))):  # decoded once, however often they are read
            df.write.parquet(f"{path}/{name}")
        documents = spark.read.schema(rows.schema).parquet(f"{path}/documents")
        if not documents.isEmpty():
            engine.upload_blocks(documents, tables.read_blocks(spark, f"{path}/blocks"))

    writer = tables.stream_files(engine.spark, folder, suffix, files).writeStream.foreachBatch(upload).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
