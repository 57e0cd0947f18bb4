"""Canonical exact fingerprints of documents, in SQL functions alone.

The canonical form of a text is its compatibility composition (NFKC, by the ICU library that ships with Spark), folded in
case (lower, composed again), with every run of white space one blank and none at the ends. Its fingerprint
is a row of 64-bit xxhash values with different seeds, two to begin with. Equal buckets, of documents and of edited texts alike,
are then compared byte by byte: the smallest and the largest canonical text of a bucket (pre-aggregated, so a hot
group of copies is no hot task) must be equal; should a bucket ever mix texts, all fingerprints are widened and compared again.
The digest is exact, so two fingerprints are either equal (likeness 1) or not (0).

Defined results: a null text is an empty one; ids that are no integers follow each other as text; rows that repeat an id follow
each other by text; null ids come first; a table of one row is its own next document; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.common import materialize, narrowed, row_key, whole_text

#: Rows of a bucket in the order of ids; buckets at most, beyond which they hold more rows (they are sorted with spilling).
BUCKET, MOST = 256, 200_000


def canonical(text: Column) -> Column:
    def compose(x: Column) -> Column:
        return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    return F.trim(F.regexp_replace(compose(F.lower(compose(F.coalesce(text, F.lit(""))))), r"[\s\p{Z}]+", " "))


def digest(canon: Column, width: int, bits: int = 64) -> Column:
    """width xxhash values as hexadecimal; bits below 64 weaken each (for tests)."""
    keep = F.lit(-1 if bits == 64 else (1 << bits) - 1)
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon).bitwiseAND(keep))), 16, "0") for seed in range(width)])


def edit(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the beginning of the text that follows."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _mixed(docs: DataFrame, prints: DataFrame, width: int, bits: int) -> bool:
    """Whether a bucket of equal fingerprints holds different canonical texts.

    docs: rk, text; prints: fp, rk and, of edited texts, next_rk. Buckets of several prints are told apart from the others by
    residues of their fingerprints, so no join has a hot key; a bucket that is looked at in vain costs its texts alone.
    """
    several = materialize(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "several")
    members = materialize(narrowed(prints, "fp", several).select("rk", "next_rk").distinct(), "members")
    wanted = members.select("rk").union(members.where("next_rk is not null").select("next_rk")).distinct()
    texts = narrowed(docs, "rk", wanted).join(wanted, "rk", "left_semi").groupBy("rk").agg(F.any_value("text").alias("text"))
    texts = materialize(texts, "texts")
    plain = members.where("next_rk is null").join(texts, "rk").select("text")
    behind = texts.select(F.col("rk").alias("next_rk"), F.col("text").alias("following"))
    edited = members.where("next_rk is not null").join(texts, "rk").join(behind, "next_rk").select(edit(F.col("text"), F.col("following")).alias("text"))
    canon = plain.union(edited).select(canonical(F.col("text")).alias("canon"))
    ends = canon.groupBy(digest(F.col("canon"), width, bits).alias("fp")).agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return not ends.where("low <> high").isEmpty()


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(row_key(id_col, text).alias("rk"), whole_text(text).alias("text"))


def verified_width(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 64) -> int:
    """The least number of xxhash words (2, 4, 8, ...) under which equal fingerprints have equal canonical bytes."""
    rows, width = _keyed(docs, id_col, text), 2
    while True:
        prints = materialize(rows.select(digest(canonical(F.col("text")), width, bits).alias("fp"), "rk", F.lit(None).cast("binary").alias("next_rk")), "prints")
        if not _mixed(rows, prints, width, bits):
            return width
        width *= 2


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, rk, text) with next_rk and next_text of the row that follows by (doc_id, text); the first follows the last.

    The rows are dealt once, into buckets of neighbouring ids; each bucket also gets a copy of the first row of the
    one behind it, so the next row is always at hand.
    """
    integral = dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    kind = "bigint" if integral else "string"
    x = F.col("doc_id").cast(kind)
    ids = rows.select(x.alias("id"))
    stats = ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"), F.min("id").alias("low")).first()
    buckets = min(MOST, -(-stats.n // BUCKET))
    bounds = []
    if buckets > 1 and stats.nulls < stats.n:
        lows = ids.where("id is not null").repartitionByRange(buckets, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"))
        bounds = sorted(r.low for r in lows.collect())[1:]  # at most MOST numbers
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{kind}>")
    inner = F.from_json(F.lit(json.dumps(groups)), f"array<array<{kind}>>")
    row = F.coalesce(F.size(F.filter(heads, lambda h: h <= x)), F.lit(0))
    own = F.when(row > 0, F.get(inner, row - 1))
    place = F.when(row > 0, (row - 1) * wide + F.size(F.filter(own, lambda b: b <= x))).otherwise(0).cast("int")
    first = x.isNull() if stats.nulls else x.eqNullSafe(F.lit(stats.low))
    spots = F.array(F.struct(F.col("place").alias("bucket"), F.lit(False).alias("ahead")))
    copies = F.concat(
        spots,
        F.when(F.col("opens"), F.array(F.struct((F.col("place") - 1).alias("bucket"), F.lit(True).alias("ahead")))).otherwise(F.array().cast("array<struct<bucket:int,ahead:boolean>>")),
        F.when(first, F.array(F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("ahead")))).otherwise(F.array().cast("array<struct<bucket:int,ahead:boolean>>")),
    )
    dealt = rows.withColumn("place", place).withColumn("opens", F.coalesce(F.array_contains(own, x), F.lit(False)))
    dealt = dealt.select("doc_id", "rk", "text", F.explode(copies).alias("to")).select("doc_id", "rk", "text", "to.bucket", "to.ahead")
    order = Window.partitionBy("bucket").orderBy("ahead", F.col("doc_id").cast(kind).asc_nulls_first(), "text")
    following = F.lead(F.struct(F.col("rk").alias("next_rk"), F.col("text").alias("next_text"))).over(order)
    return dealt.withColumn("following", following).where("not ahead").select("doc_id", "rk", "text", "following.next_rk", "following.next_text")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints of an exact digest: 1 if they are equal, else 0."""
    return F.when(a == b, 1.0).otherwise(0.0)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """The contract's row for each document; the edited text has its last half replaced by the next one's beginning."""
    keyed, width = _keyed(docs, id_col, text), 2
    rows = with_next(docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text).alias("rk"), whole_text(text).alias("text")))
    edited = rows.withColumn("edited", edit(F.col("text"), F.col("next_text")))
    while True:
        prints = {c: digest(canonical(F.col(c)), width, bits) for c in ("text", "edited", "next_text")}
        shown = edited.select(
            "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            prints["text"].alias("fingerprint"), prints["edited"].alias("edited_fingerprint"), prints["next_text"].alias("next_fingerprint"), "rk", "next_rk",
        )
        shown = materialize(shown, "prints")
        own = shown.select(F.col("fingerprint").alias("fp"), "rk", F.lit(None).cast("binary").alias("next_rk"))
        if not _mixed(keyed, own.union(shown.select("edited_fingerprint", "rk", "next_rk")), width, bits):
            break
        width *= 2
    near = [likeness(F.col("fingerprint"), F.col(c)).alias(n) for c, n in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return shown.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """fingerprint, first id and number of rows of every group of equal canonical texts."""
    width = verified_width(docs, id_col, text)
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(canonical(whole_text(text)), width).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_rows"))
