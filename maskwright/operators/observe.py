"""What pass 1 collects: distinct texts with their tightest width, integers of key domains, calendar extremes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical_text, ordinal
from ..plans.schema import Dataset


def stacked(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def text_observations(dataset: Dataset, spark: SparkSession, actions=None) -> DataFrame:
    """value, min_width: each non-empty text of any C or V field, with the least width of the fields that hold it.

    One scan for each table: its text columns are stacked by an in-row explode, and equal values fold before the
    shuffle.
    """
    parts = []
    for table in dataset:
        texts = [f for f in table.facts if f.dbf_type in "CV" and (actions is None or actions(table, f))]
        if texts:
            pairs = F.array(*(F.struct(F.col(f.name).alias("value"), F.lit(f.width).alias("width")) for f in texts))
            parts.append(table.df.select(F.explode(pairs).alias("x")).select("x.*").filter("value is not null and value != ''"))
    return stacked(parts, spark, "value string, width int").groupBy("value").agg(F.min("width").alias("min_width"))


def observed_encodings(dataset: Dataset, actions=None) -> set[str]:
    """Encodings of the chosen fields that hold a non-empty text."""
    found = set()
    for table in dataset:
        by_code: dict[str, list[str]] = {}
        for f in table.facts:
            if f.dbf_type in "CV" and (actions is None or actions(table, f)):
                by_code.setdefault(f.encoding, []).append(f.name)
        for encoding, names in by_code.items():
            some = reduce(lambda a, b: a | b, (F.coalesce(F.col(n) != "", F.lit(False)) for n in names))
            if not table.df.filter(some).limit(1).isEmpty():
                found.add(encoding)
    return found


def numeric_observations(dataset: Dataset, members: dict[tuple[str, str], str], spark: SparkSession) -> DataFrame:
    """domain_id, value (canonical text): distinct integers of declared key members."""
    parts = []
    for table in dataset:
        named = [(domain, field) for (path, field), domain in members.items() if path == table.path]
        if named:
            pairs = F.array(*(F.struct(F.lit(domain).alias("domain_id"), canonical_text(F.col(field)).alias("value")) for domain, field in named))
            parts.append(table.df.select(F.explode(pairs).alias("x")).select("x.*").filter("value is not null"))
    return stacked(parts, spark, "domain_id string, value string").distinct()


def temporal_extremes(dataset: Dataset, spark: SparkSession, actions=None) -> DataFrame:
    """One row, least_day and most_day: the extreme ordinals over all D and T fields (null: none)."""
    parts = []
    for table in dataset:
        days = [ordinal(F.col(f.name)) for f in table.facts if f.dbf_type in "DT" and (actions is None or actions(table, f))]
        if days:
            low, high = (days[0], days[0]) if len(days) == 1 else (F.least(*days), F.greatest(*days))
            parts.append(table.df.agg(F.min(low).alias("least_day"), F.max(high).alias("most_day")))
    every = stacked(parts, spark, "least_day int, most_day int")
    return every.agg(F.min("least_day").alias("least_day"), F.max("most_day").alias("most_day"))
