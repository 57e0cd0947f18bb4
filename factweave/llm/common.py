"""Shared plumbing of the training-data operators: scratch tables, row keys, column names that cannot clash."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    It is what the cluster names in spark.checkpoint.dir. Where that is unset, a local master gets a temporary
    folder of its own and any other master the warehouse, which its executors share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="factweave-")
            atexit.register(shutil.rmtree, folder, True)
            root = f"file://{folder}"
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_factweave"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; it goes when the session's JVM ends."""
    path = f"{scratch_root(spark)}/factweave/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from names that df does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str = "text") -> Column:
    """The whole text, with a null counted as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """128-bit key of (id, text), as 16 bytes; rows that repeat both share it."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text))), 16, "0") for seed in (7, 8)]
    return F.unhex(F.concat(*halves))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(folds)


def narrowed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key may be among keys: a semi-join reduction by 2^20 residues at most.

    The broadcast has a fixed bound (a million longs), whatever the number of keys; an exact join on key follows.
    """
    (residue,) = fresh(df, "residue")
    own = F.pmod(F.xxhash64(F.lit(9), F.col(key)), F.lit(1 << 20))
    some = keys.select(own.alias(residue)).distinct()
    return df.withColumn(residue, own).join(F.broadcast(some), residue, "left_semi").drop(residue)
