"""Facts that arrive in micro-batches: each batch meets what is there already, and then itself.

State is the table of facts alone, which grows by what arrives; there is no event time, and so no watermark. Facts are stored
by parts of their bucket keys, and a batch reads the parts that its own facts fall in. A batch writes its relationships and facts
under its own number with overwrite, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from factweave.operators.matching import family_key
from factweave.operators.reasoning import judge
from factweave.schema import FACTS

#: Parts of the stored facts.
PARTS = 32


def part(parts: int) -> Column:
    """The part that a fact's bucket (entity, family, unit) falls in."""
    return F.pmod(F.xxhash64("entity_canonical", family_key(), "normalized_unit"), F.lit(parts)).cast("int")


def _stored(spark: SparkSession, path: str, before: int, parts: list[int]) -> DataFrame:
    """Facts of the batches before this one, in some parts."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], FACTS)
    shape = StructType([*FACTS.fields, StructField("batch", LongType()), StructField("part", IntegerType())])
    rows = spark.read.schema(shape).parquet(path)
    return rows.where((F.col("batch") < before) & F.col("part").isin(parts)).select(*FACTS.fieldNames())


def start(facts: DataFrame, store: str, checkpoint: str, once: bool = True, ordered: bool = False) -> StreamingQuery:
    """Match a stream of facts against store/facts and keep both sides there: store/facts, store/relationships by batch.

    ordered: side a is the earlier fact of a pair, as in a full run, and not the one that the later batch brings.
    """
    spark = facts.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        own = batch.select(*FACTS.fieldNames()).withColumn("part", part(PARTS))
        own.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/facts/batch={number}")
        shape = StructType([*FACTS.fields, StructField("part", IntegerType())])
        new = spark.read.schema(shape).parquet(f"{store}/facts/batch={number}")
        parts = [r.part for r in new.select("part").distinct().collect()]  # at most PARTS numbers
        old = _stored(spark, f"{store}/facts", number, parts)
        judge(new.drop("part"), old, ordered).write.mode("overwrite").parquet(f"{store}/relationships/batch={number}")

    writer = facts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
