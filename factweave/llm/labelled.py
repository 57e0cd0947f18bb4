"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import materialize, whole_text


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents, the first by a hash of their id, written to the shared folder.

    learn: a condition on the id column. Rows without a label or id are left out; of labels that repeat an id the
    largest counts, of documents that repeat an id the smallest text. Documents are picked before their texts are read, so no more than `rows` ids are broadcast.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    own = own.where(learn).groupBy("id").agg(F.max("label").alias("label"))
    have = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    picked = own.join(have, "id", "left_semi").orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(rows)
    picked = materialize(picked, "picked")
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text).alias("text"))
    found = texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return materialize(found.select("id", "text", "label"), "labelled")
