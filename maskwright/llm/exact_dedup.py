"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Three stages, each grouping by digest and full text, so that two texts that share a digest stay apart:
partial aggregation folds the copies inside each input partition; the folded rows meet in salted digest
groups; the winners of the salts, at most ``salts`` per text, are combined globally. A group that holds a
third of all rows thus reaches any later task as a handful of rows.

Defined cases: a null text counts as empty; a null id loses to any other id; an empty input gives an empty
report. Rows repeated in full (same id, same text) cannot be told apart: each is marked kept if its id
wins, and ``deduplicate`` leaves one of them. Other columns are passed through, and the new one is ``dedup`` with underscores before it
if that is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, column, free_name, materialize, packed, table

SALTS = 16
#: Groups of copies are broadcast up to this many (about 60 bytes each); beyond, the join is salted.
BROADCAST_GROUPS = 200_000


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def copy_groups(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per different text: digest, text, largest id, number of rows."""
    text = F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(column(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def label_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_digest,
    broadcast_groups: int = BROADCAST_GROUPS,
) -> DataFrame:
    """docs with one column more, a struct (``dedup``): keep_id, group_size, kept and digest."""
    full = copy_groups(docs, id_col, text_col, salts, digest)
    every = materialize(full.select("digest", "keep_id", "group_size"), "copies")
    collided = not every.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").isEmpty()
    groups = every.filter("group_size > 1")
    text = F.coalesce(column(text_col), F.lit(""))
    mine = docs.select(packed(docs.columns).alias("row"), column(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    if collided:
        joined = mine.join(full.filter("group_size > 1"), ["digest", "text"], "left")  # two texts share a digest
    else:
        joined = attach(mine.drop("text"), groups, "digest", "id", broadcast_groups)
    grouped = F.col("group_size").isNotNull()
    found = F.struct(
        F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest"),
    )
    return joined.select("row.*", found.alias(free_name(docs, "dedup")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of equal texts one row, that with the largest id."""
    names = docs.columns
    labelled = label_copies(docs.select(packed(names).alias("row"), column(id_col).alias("id"), column(text_col).alias("text")), "id", "text", **options)
    kept = labelled.filter("dedup.kept")
    tied = labelled.filter("dedup.kept and dedup.group_size > 1").groupBy("dedup.digest").agg(F.count("*").alias("n")).filter("n > 1")
    if not tied.isEmpty():
        kept = kept.withColumn("digest", F.col("dedup.digest")).dropDuplicates(["digest", "text"])
    return kept.select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return label_copies(docs).select(
        "doc_id", "dedup.keep_id", "dedup.group_size", "dedup.kept", F.lower(F.hex("dedup.digest")).alias("text_sha256")
    )


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
