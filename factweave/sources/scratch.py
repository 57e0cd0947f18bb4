"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder under a local master, else the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="factweave-")
            atexit.register(shutil.rmtree, own, True)
            folder = f"file://{own}"
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_factweave"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A fresh path; it goes when the session's JVM ends."""
    own = f"{root(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return own


_kept: dict[tuple[str, str, str, str], DataFrame] = {}


def state(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of the files of a source's tables: another text once a table is written anew."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(source)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for depth in ("*", "*/*") for s in fs.globStatus(hadoop.Path(top, depth)) or []]
    return " ".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in found))


def _key(spark: SparkSession, name: str, source: str) -> tuple[str, str, str, str]:
    return spark.sparkContext.applicationId, name, source, state(spark, source)


def held(spark: SparkSession, name: str, source: str) -> DataFrame | None:
    """The table that `kept` has written for a source, if it has."""
    return _kept.get(_key(spark, name, source))


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives for a source, written once in an application and read from then on, as long as the
    source's files are the same.

    Facts and relationships are stored tables of the engine: views read them and do not derive them again.
    """
    key = _key(spark, name, source)
    if key not in _kept:
        df, own = make(), path(spark, name)
        df.write.parquet(own)
        _kept[key] = spark.read.schema(df.schema).parquet(own)
    return _kept[key]
