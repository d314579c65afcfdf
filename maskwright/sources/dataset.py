"""Datasets on disk: discovery, inventories, fingerprints, positioned scans and fresh writes."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import EngineError
from ..plans.policy import canonical_json, digest
from ..plans.schema import DELETED, INDEX, Dataset, FieldFact, Table, read_facts, with_facts
from .shared import Files

SUFFIX, DBF, MEMO = ".parquet", ".dbf", ".fpt"


def table_of_artifact(path: str) -> str | None:
    """The table that a file belongs to: the path up to its first .parquet segment, a .dbf file, or that of a .fpt file; hidden files belong to none."""
    parts = path.split("/")
    for k, part in enumerate(parts):
        if part.startswith((".", "_")):
            return None
        if part.endswith(SUFFIX):
            return "/".join(parts[: k + 1])
    low = path.casefold()
    return path if low.endswith(DBF) else f"{path[: -len(MEMO)]}{DBF}" if low.endswith(MEMO) else None


def inventory(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, size) of each artifact in scope, in order."""
    files = Files(spark)
    if not files.exists(root):
        raise EngineError("PATH_NOT_FOUND")
    return [(p, n) for p, n in ((unquote(p), n) for p, n in files.list(root)) if table_of_artifact(p)]


def discover_tables(spark: SparkSession, root: str) -> list[str]:
    found = {table_of_artifact(p) for p, _ in inventory(spark, root)}
    folded = {t.casefold() for t in found}
    if len(folded) < len(found):
        raise EngineError("PATH_INVALID", "AMBIGUOUS_TABLE_NAMES")
    return sorted(found)


def artifact_hashes(spark: SparkSession, root: str) -> DataFrame:
    """path, type, size and SHA-256 of each artifact; the hashing runs on the executors."""
    base = Files(spark).path(root)
    home = base[0].getFileStatus(base[1]).getPath().toString().rstrip("/") + "/"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.substring(F.col("path"), len(home) + 1, 1 << 20)
    own = read.select(at.alias("path"), F.upper(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("type"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return own.filter(~F.col("path").rlike(r"(^|/)[._]"))


def source_fingerprint(spark: SparkSession, root: str) -> str:
    """SHA-256 of the canonical list of artifacts. Its size is that of the list of files, not of the data."""
    rows = sorted(artifact_hashes(spark, root).collect(), key=lambda r: r["path"])
    return "src-" + hashlib.sha256(canonical_json([{"p": r["path"], "t": r["type"], "s": r["size"], "h": r["sha256"]} for r in rows])).hexdigest()


def output_fingerprint(spark: SparkSession, root: str) -> str:
    """The same over file contents, each with its length before it: a hash of hashes, so that files hash in parallel."""
    out = hashlib.sha256()
    for r in sorted(artifact_hashes(spark, root).collect(), key=lambda r: r["path"]):
        path = r["path"].encode()
        out.update(b"%d:%s%d:%s" % (len(path), path, r["size"], bytes.fromhex(r["sha256"])))
    return "out-" + out.hexdigest()


def schema_fingerprint(facts: tuple[FieldFact, ...]) -> str:
    return digest("sch-", [[f.name, f.dbf_type, f.width, f.decimals, f.dbf_type in "MGP", f.encoding] for f in facts], 32)


def positioned(df: DataFrame) -> DataFrame:
    """df, read from files, with each record's place in the table: files in order of their names, rows as they lie."""
    if INDEX in df.columns:
        return df if DELETED in df.columns else df.withColumn(DELETED, F.lit(False))
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted((r["_file"], r["n"]) for r in marked.groupBy("_file").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for file, n in sizes:
        starts.append((file, at))
        at += n
    if len(starts) < 2:
        placed = marked.withColumn(INDEX, F.col("_row"))
    else:
        offsets = df.sparkSession.createDataFrame(starts, "_file string, _start bigint")
        placed = marked.join(F.broadcast(offsets), "_file").withColumn(INDEX, F.col("_start") + F.col("_row")).drop("_start")
    placed = placed.drop("_file", "_row")
    return placed if DELETED in df.columns else placed.withColumn(DELETED, F.lit(False))


def read_table(spark: SparkSession, root: str, path: str, facts: dict[str, FieldFact] | None = None) -> Table:
    if path.casefold().endswith(DBF):
        from .dbf import register

        register(spark)
        df = spark.read.format("dbf").load(f"{root}/{path}")
    else:
        df = spark.read.parquet(f"{root}/{path}")
    found = read_facts(df.schema, facts)
    return Table(path, with_facts(positioned(df), found), found)


def read_dataset(spark: SparkSession, root: str, facts: dict[str, dict[str, FieldFact]] | None = None, tables: list[str] | None = None) -> Dataset:
    names = discover_tables(spark, root) if tables is None else tables
    return Dataset({p: read_table(spark, root, p, (facts or {}).get(p)) for p in names})


def write_table(df: DataFrame, facts: tuple[FieldFact, ...], path: str) -> None:
    """A fresh table in record order, its facts in the schema; an existing one is an error."""
    if path.casefold().endswith(DBF):
        from .dbf import write_dbf

        write_dbf(df, facts, path)
        return
    with_facts(df, facts).orderBy(INDEX).write.mode("errorifexists").parquet(path)
