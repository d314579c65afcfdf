r"""Secret scans over an incremental ledger of blobs.

Every version of every text is addressed by its SHA-256, which stands for its content. The ledger, a table that outlives a run, holds for each
pair of blob and rule version the spans that were found. A scan reduces the versions to distinct blobs, drops
the pairs that the ledger has, scans the rest once each, appends the findings to the ledger, and joins the
ledger back to all versions. A text that occurs a million times is scanned once, and never again by the same rules.

The session setting ``spark.maskwright.ledger`` names the ledger of the query and of the pipeline; each run where it is unset has one of its own. Two
scans that append at once may list a blob twice, which the join back folds.

The rules are the base ones; the ledger adds no spans of its own, so ``spans`` has what the base has.

Defined cases: a null text counts as empty and has no spans; matches are leftmost and do not overlap within a
kind, and may overlap across kinds; offsets count code points, end exclusive; repeated rows and rows without an id each get their
findings; an empty table gives no findings; other columns are passed through, and the new one is ``secrets`` with underscores before it if that is taken.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, column, free_name, materialize, packed, shared_dir, table

RULE_VERSION = "1"
LEDGER_SETTING = "spark.maskwright.ledger"
MARKER = "[SECRET]"
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEDGER = "blob binary, rules string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, place of kind, "kind:start:end") in order of start, then kind."""
    found = []
    lower = text.lower()
    if any(name in lower for name in NAMES):
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in HEX.finditer(text)]
    return sorted(found)


def scan_blobs(blobs: DataFrame, rules: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = find_secrets(text)
                spans = ",".join(s for _, _, s in found)
                kinds = [k for _, k, _ in found]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spans.encode()).hexdigest(), spans))
            n = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            names = ["blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.record_batch([batch.column(0), pa.array([rules] * len(rows), pa.string()), *n], names)

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; an empty one where there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def ledger_of(spark: SparkSession) -> str:
    return spark.conf.get(LEDGER_SETTING, None) or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def scan(versions: DataFrame, ledger: str, text_col: str = "text", rules: str = RULE_VERSION, id_col: str = "doc_id") -> DataFrame:
    """versions with one column more, a struct (``secrets``). Appends to the ledger, a path, what it had not seen."""
    spark = versions.sparkSession
    text = F.coalesce(column(text_col), F.lit(""))
    seen = read_ledger(spark, ledger).filter(F.col("rules") == rules).select("blob")
    texts = versions.select(text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    # grouping by the text as well folds copies inside each input partition before anything is shuffled
    blobs = texts.groupBy("blob", "text").agg(F.count("*").alias("n"))
    known = not seen.isEmpty()
    fresh = blobs.join(seen, "blob", "left_anti") if known else blobs
    scan_blobs(fresh, rules).write.mode("append").parquet(ledger)
    # most blobs hold no secret: only the others are joined back
    found = read_ledger(spark, ledger).filter((F.col("rules") == rules) & (F.col("spans") != "")).drop("rules").dropDuplicates(["blob"])
    found = materialize(found, "found")
    each = versions.select(packed(versions.columns).alias("row"), column(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("blob"))
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_assign", "n_access", "n_hex")]
    empty = F.coalesce("base_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("base_sha256")
    spans = F.coalesce("spans", F.lit("")).alias("spans")
    return attach(each, found, "blob", "id").select("row.*", F.struct("blob", *counts, empty, spans).alias(free_name(versions, "secrets")))


def without_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """text with each run of overlapping spans replaced by the marker."""
    out = []
    for t, listed in zip(text, spans, strict=True):
        if t is None or not listed:
            out.append(t)
            continue
        parts, at = [], 0
        for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in listed.split(",")):
            if start >= at:
                parts += [t[at:start], MARKER]
            at = max(at, end)
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every secret in their text replaced by ``[SECRET]``, and its length brought up to date."""
    found = scan(docs.select(packed(docs.columns).alias("doc"), column(id_col).alias("id"), column(text_col).alias("text")), ledger, "text", id_col="id")
    hit = F.col("secrets.spans") != ""
    # texts without secrets are not sent to Python
    replaced = F.pandas_udf(without_spans, T.StringType())
    clean = F.when(hit, replaced(F.when(hit, F.col("text")), F.col("secrets.spans"))).otherwise(F.col("doc").getField(text_col))
    marked = found.select("doc", hit.alias("hit"), clean.alias("clean"))
    change = {text_col: F.col("clean"), length_col: F.when(F.col("hit"), F.length("clean")).otherwise(F.col("doc").getField(length_col))} if length_col in docs.columns else {text_col: F.col("clean")}
    return marked.select(*(change[c].cast(docs.schema[c].dataType).alias(c) if c in change else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, ledger_of(spark))
    return found.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", "secrets.base_sha256", "secrets.spans")
