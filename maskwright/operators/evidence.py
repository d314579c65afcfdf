"""Key evidence: histograms of relation keys on both sides of a rewrite, and what must not change between them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical_text
from ..plans.schema import Dataset
from .observe import stacked

PARENT, FOREIGN = "PARENT", "FOREIGN"
INVARIANTS = (
    "PARENT_UNIQUENESS_PRESERVED", "FOREIGN_MULTIPLICITY_PRESERVED", "MATCHED_ROWS_PRESERVED", "ORPHAN_COUNT_PRESERVED", "NULL_COUNTS_PRESERVED",
)
KEYS = "side string, relation_id string, role string, key string"


@dataclass(frozen=True)
class KeySource:
    """The columns of one relation's parent or foreign side in one frame."""

    side: str
    relation_id: str
    role: str
    df: DataFrame
    columns: tuple[str, ...]
    numeric: tuple[bool, ...]


def key_identity(columns: tuple[str, ...], numeric: tuple[bool, ...]) -> Column:
    """One text for a key of any arity, null if any part is null: count, then each part tagged by kind and length.

    Integers of different types and widths are the same key if they are equal.
    """
    parts = []
    for name, number in zip(columns, numeric, strict=True):
        text = canonical_text(F.col(name)) if number else F.col(name).cast("string")
        tag = F.lit("N" if number else "T")
        parts.append(F.concat(tag, F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.concat(F.lit(f"{len(columns)}#"), *parts)


def relation_keys(sources: list[KeySource], spark: SparkSession) -> DataFrame:
    """A row for each record of each source. A null key is a null tuple."""
    parts = [
        s.df.select(
            F.lit(s.side).alias("side"), F.lit(s.relation_id).alias("relation_id"), F.lit(s.role).alias("role"), key_identity(s.columns, s.numeric).alias("key")
        )
        for s in sources
    ]
    return stacked(parts, spark, KEYS)


def relation_histogram(keys: DataFrame) -> DataFrame:
    """side, relation_id, role, key, occurrences; null tuples are one row with a null key. One grouped job for all sides."""
    return keys.groupBy("side", "relation_id", "role", "key").agg(F.count("*").alias("occurrences"))


def side_facts(histogram: DataFrame) -> DataFrame:
    """Per side, relation and role: rows, null tuples, unique keys and the largest multiplicity."""
    some = F.col("key").isNotNull()
    return histogram.groupBy("side", "relation_id", "role").agg(
        F.sum("occurrences").alias("row_count"),
        F.coalesce(F.sum(F.when(~some, F.col("occurrences"))), F.lit(0)).alias("null_tuples"),
        F.sum(some.cast("long")).alias("unique_keys"),
        F.coalesce(F.max(F.when(some, F.col("occurrences"))), F.lit(0)).alias("max_multiplicity"),
    )


def profile(histogram: DataFrame) -> DataFrame:
    """The multiset of multiplicities as counts of counts, which is small whatever the keys."""
    return (
        histogram.filter("key is not null").groupBy("side", "relation_id", "role", "occurrences").agg(F.count("*").alias("keys"))
    )


def profile_digest(counts: dict[int, int]) -> str:
    """SHA-256 over the multiplicities from large to small, each followed by a comma."""
    out = hashlib.sha256(b"RELATION-PROFILE/v1")
    for occurrences in sorted(counts, reverse=True):
        piece, left = f"{occurrences},".encode(), counts[occurrences]
        while left:
            step = min(left, 100_000)
            out.update(piece * step)
            left -= step
    return out.hexdigest()


def matched_rows(histogram: DataFrame) -> DataFrame:
    """Per side and relation the foreign rows whose key a parent has: a semi join of two histograms."""
    by = ["side", "relation_id", "key"]
    parents = histogram.filter((F.col("role") == PARENT) & F.col("key").isNotNull()).select(by)
    foreign = histogram.filter((F.col("role") == FOREIGN) & F.col("key").isNotNull())
    return foreign.join(parents, by, "left_semi").groupBy("side", "relation_id").agg(F.sum("occurrences").alias("matched"))


def relation_metrics(histogram: DataFrame) -> DataFrame:
    """A row per side and relation: unique keys, rows, nulls, matched and orphan rows, multiplicities and both profiles."""
    facts = side_facts(histogram)
    pick = lambda role, names: facts.filter(F.col("role") == role).select("side", "relation_id", *(F.col(n).alias(m) for n, m in names.items()))
    parent = pick(PARENT, {"row_count": "parent_rows", "null_tuples": "parent_nulls", "unique_keys": "parent_unique", "max_multiplicity": "parent_max"})
    foreign = pick(FOREIGN, {"row_count": "foreign_rows", "null_tuples": "foreign_nulls", "unique_keys": "foreign_unique", "max_multiplicity": "foreign_max"})
    by = ["side", "relation_id"]
    shape = profile(histogram).groupBy(*by, "role").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("occurrences", "keys")), False), lambda x: F.concat(x["occurrences"].cast("string"), F.lit("x"), x["keys"].cast("string"))), ",").alias("profile")
    )
    for role, name in ((PARENT, "parent_profile"), (FOREIGN, "foreign_profile")):
        own = shape.filter(F.col("role") == role).select(*by, F.col("profile").alias(name))
        parent = parent.join(own, by, "left") if role == PARENT else parent
        foreign = foreign.join(own, by, "left") if role == FOREIGN else foreign
    out = parent.join(foreign, by, "full_outer").join(matched_rows(histogram), by, "left")
    out = out.withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumn("orphans", F.col("foreign_rows") - F.col("foreign_nulls") - F.col("matched"))


def compare_sides(metrics: DataFrame, before: str = "SOURCE", after: str = "OUTPUT") -> DataFrame:
    """A row per relation with the five invariants, and status: VERIFIED, FAILED, or INCOMPLETE where a side is missing."""
    names = [c for c in metrics.columns if c not in ("side", "relation_id")]
    side = lambda name, mark: metrics.filter(F.col("side") == name).select("relation_id", *(F.col(n).alias(f"{mark}_{n}") for n in names))
    out = side(before, "b").join(side(after, "a"), "relation_id", "full_outer")
    same = lambda *cols: F.expr(" and ".join(f"b_{c} <=> a_{c}" for c in cols))
    checks = {
        "PARENT_UNIQUENESS_PRESERVED": same("parent_unique", "parent_profile"),
        "FOREIGN_MULTIPLICITY_PRESERVED": same("foreign_unique", "foreign_profile"),
        "MATCHED_ROWS_PRESERVED": same("matched"),
        "ORPHAN_COUNT_PRESERVED": same("orphans"),
        "NULL_COUNTS_PRESERVED": same("parent_nulls", "foreign_nulls"),
    }
    whole = F.col("b_parent_rows").isNotNull() & F.col("b_foreign_rows").isNotNull() & F.col("a_parent_rows").isNotNull() & F.col("a_foreign_rows").isNotNull()
    for name, check in checks.items():
        out = out.withColumn(name, check)
    good = F.expr(" and ".join(INVARIANTS))
    return out.withColumn("status", F.when(~whole, "INCOMPLETE").when(good, "VERIFIED").otherwise("FAILED"))


def evidence_fingerprint(rows: list[dict]) -> str:
    from ..plans.policy import digest

    return digest("evd-", sorted(([r[k] for k in ("relation_id", "status", *INVARIANTS)] for r in rows), key=str))


def sources_of(dataset: Dataset, relations: list, side: str) -> list[KeySource]:
    out = []
    for relation in relations:
        for role, members in ((PARENT, relation.parent), (FOREIGN, relation.foreign)):
            table = dataset.tables.get(members[0].table)
            if table is not None:
                out.append(KeySource(side, relation.relation_id, role, table.df, tuple(m.field for m in members), tuple(m.dbf_type not in "CV" for m in members)))
    return out
