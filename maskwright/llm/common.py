"""What the text operators share: table access, shared storage and worker set-up."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_dir  # noqa: F401  used by every operator

ROOT = str(Path(__file__).resolve().parents[2])
#: Word separators of all contracts: space and the characters 0x09 to 0x0D.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def workers_see_package(spark: SparkSession) -> None:
    """Put this repository on the path of Python workers; on a cluster it is shipped with --py-files."""
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """The columns as one struct, so that no name of theirs clashes with one of ours."""
    return F.struct(*map(column, names))


#: A table is broadcast up to this many rows of a few numbers each; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
SALTS = 16


def attach(left: DataFrame, right: DataFrame, on: str, spread: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """left outer join of left with right, which has few columns and each value of `on` once.

    One value may hold a third of left: a right side of proven size is broadcast, a larger one is repeated for
    each salt, and left is dealt by `on` and a salt from its column `spread`.
    """
    if right.count() <= broadcast_rows:
        return left.join(F.broadcast(right), on, "left")
    salt = free_name(left, "salt")
    salted = right.withColumn(salt, F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(SALTS)))))
    return left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS))).join(salted, [on, salt], "left").drop(salt)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, and let Spark drop the shuffle files that nothing refers to any more."""
    import gc

    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()
