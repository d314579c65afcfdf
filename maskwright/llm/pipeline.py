"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret scans, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the docs of the next. All but the last return the columns of documents.

Defined cases: an empty table stays empty through every stage; a null text has no words, so the first stage drops it; rows
without an id pass the near-dedup, whatever they are like, and are packed as documents of their own; rows repeated in full
are copies, of which one stays; further columns are passed on by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import materialize, table, workers_see_package
from .exact_dedup import deduplicate
from .near_copies import drop_similar
from .packing import VOCABULARY, pack
from .quality import keep_good
from .secret_scan import ledger_of, redact
from .token_counts import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and lie near their language; a null or blank text goes."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of ties, rows alike but for other columns, any one."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share four fifths of their five-word shingles, directly or through others, the row with the smallest id."""
    workers_see_package(spark)
    return drop_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by ``[SECRET]``; n_chars follows, where there is such a column."""
    workers_see_package(spark)
    return redact(docs, ledger_of(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id and where the piece lies in which sequence."""
    workers_see_package(spark)
    return pack(docs.select("doc_id", "text"), tokenizer_path(VOCABULARY)).select("doc_id", "piece.*")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: Near-copy components, scans and packing are beyond SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
