"""Capacity proofs before a run: enough tokens for every width, enough numbers for every key domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import candidate_alphabet, is_safe, token_space, token_space_at_least
from ..functions.values import member_verdict
from ..plans.schema import Dataset
from . import allocate, observe


def capacity_by_width(observed: DataFrame) -> DataFrame:
    """min_width, originals, needed (originals up to this width): widths are few, so a window over them is small."""
    from pyspark.sql import Window

    return observed.groupBy("min_width").agg(F.count("*").alias("originals")).withColumn("needed", F.sum("originals").over(Window.orderBy("min_width")))


def proven_by_metadata(dataset: Dataset, actions) -> bool:
    """Even if every cell were a text of its own, each width would have room: then nothing needs a scan."""
    cells: dict[int, int] = {}
    for table in dataset:
        widths = [f.width for f in table.facts if f.dbf_type in "CV" and actions(table, f)]
        if widths:
            n = table.df.count()
            for w in widths:
                cells[w] = cells.get(w, 0) + n
    need = 0
    for width in sorted(cells):
        need += cells[width]
        # twice: tokens that are somebody's own value are left out
        if not token_space_at_least(width, 2 * need):
            return False
    return True


def text_capacity(dataset: Dataset, spark: SparkSession, actions, mapped: DataFrame) -> str:
    """PROVEN, or INSUFFICIENT by the exact condition that allocation will meet."""
    encodings = {f.encoding for t in dataset for f in t.facts if f.dbf_type in "CV" and actions(t, f)}
    if not encodings:
        return "PROVEN"
    alphabet = candidate_alphabet(sorted(encodings))
    if len(alphabet) == 36 and mapped.isEmpty() and proven_by_metadata(dataset, actions):
        return "PROVEN"
    rest = observe.text_observations(dataset, spark, actions).join(mapped.select("value"), "value", "left_anti").persist()
    try:
        facts = allocate.width_facts(rest, mapped.select("token"), alphabet)
        if facts.fungible():
            return "PROVEN"
        own = rest.filter(is_safe(F.col("value"), alphabet) & (F.length("value") <= F.col("min_width"))).select(F.length("value"), "min_width").distinct()
        return "PROVEN" if alphabet and facts.feasible([(r[0], r[1]) for r in own.collect()]) else "INSUFFICIENT"
    finally:
        rest.unpersist()


def numeric_capacity(dataset: Dataset, spark: SparkSession, members: dict, mapped: dict[str, DataFrame]) -> list[str]:
    """Codes of what stands against the key domains."""
    codes = []
    for (path, name), _ in members.items():
        table = dataset.tables[path]
        fact = table.fields[name]
        bad = table.df.select(member_verdict(F.col(name), fact.dbf_type, fact.width).alias("v")).filter("v != 'REVERSIBLE'").groupBy("v").count().collect()
        if bad:
            codes.append("NUMERIC_KEY_RECOVERY_UNWRITABLE")
    observed = observe.numeric_observations(dataset, {k: d for k, (d, _) in members.items()}, spark)
    for domain, (low, high) in sorted(set(members.values())):
        pairs = mapped[domain]
        rest = observed.filter(F.col("domain_id") == domain).select("value").join(pairs.select("value"), "value", "left_anti")
        own = rest.join(pairs.select(F.col("token").alias("value")), "value", "left_anti").count()
        if not allocate.numeric_feasible(low, high, rest.count(), pairs.count(), own):
            codes.append("PSEUDONYM_CAPACITY_INSUFFICIENT")
    return codes


def storage_estimate(sizes: list[int], vault: bool = False) -> int:
    """Twice the source and a margin, in bytes."""
    return 2 * sum(sizes) + ((32 if vault else 16) << 20)


def space_of_width(width: int) -> int:
    return token_space(width)
