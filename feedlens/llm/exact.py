"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Copies are first merged inside each task,
then per salt, then over all salts. Every merge groups by the digest and the full text, so two texts that
share a digest stay apart at every stage. A text that a third of all rows carry reaches the last merge as
one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedlens.llm.shared import ascii_lower, saved

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def winners(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct text: digest, keep_id, group_size, n_texts, and the text where n_texts > 1.

    n_texts counts the distinct texts with this digest; it is 1 unless digests collide.
    """
    local = docs.select(F.col("doc_id").alias("doc_id"), ascii_lower(F.col("text")).alias("text"))
    local = local.select("doc_id", "text", digest(F.col("text")).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    salted = local.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = (
        salted.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .withColumn("n_texts", F.count(F.lit(1)).over(W.partitionBy("digest")))
    )
    return merged.withColumn("text", F.when(F.col("n_texts") > 1, F.col("text")))


def assign(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. keep_id is the largest doc_id of the equal texts; null ids lose to any
    other, and a group that has only null ids has keep_id null. Of repeated rows with the same doc_id and
    text exactly one is kept. An empty table gives an empty result; other columns are ignored.
    """
    table = saved(winners(docs, salts, digest), "exact-winners")
    collided = not table.where("n_texts > 1").isEmpty()
    text = ascii_lower(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), digest(text).alias("digest"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), *([text.alias("full")] if collided else []))
    table = table.withColumnRenamed("text", "other")
    if collided:
        same = (rows["digest"] == table["digest"]) & ((F.col("n_texts") == 1) | (F.col("full") == F.col("other")))
    else:
        same = rows["digest"] == table["digest"]
    found = rows.join(table, same).select("doc_id", "keep_id", "group_size", "text_sha256")
    turn = F.row_number().over(W.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return found.withColumn("turn", turn).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group of equal texts.

    The join is on the digest and the kept id together, so the rows of a large group do not meet in a task.
    """
    table = saved(winners(docs, salts), "exact-winners")
    text = ascii_lower(F.col("text"))
    collided = not table.where("n_texts > 1").isEmpty()
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col("doc_id").alias("own_id"), sha256(text).alias("own_digest"), *([text.alias("own_text")] if collided else []))
    same = (rows["own_digest"] == table["digest"]) & rows["own_id"].eqNullSafe(table["keep_id"])
    if collided:
        same &= (table["n_texts"] == 1) | (rows["own_text"] == table["text"])
    stays = rows.join(table, same, "left_semi")
    keys = ["own_digest", "own_id"] + (["own_text"] if collided else [])
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(0)))
    return stays.withColumn("turn", turn).where("turn = 1").select("row.*")
