"""A stream of records through an existing vault: each micro-batch reuses mappings and adds those it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import candidate_alphabet
from ..operators import allocate, observe, transform
from ..operators.transform import FieldPlan
from ..plans.relations import TEXT_DOMAIN
from ..plans.schema import PSEUDONYMIZE, Dataset, Table
from ..sources.vault import Vault


def rewrite_batch(df: DataFrame, plans: list[FieldPlan], vault: Vault, offset: int | None = None) -> DataFrame:
    """One batch, rewritten. New texts get their pseudonyms in a commit before any row uses them."""
    spark = df.sparkSession
    table = Table("stream", df, tuple(p.fact for p in plans))
    chosen = {p.fact.name for p in plans if p.action == PSEUDONYMIZE and p.fact.dbf_type in "CV"}
    seen = observe.text_observations(Dataset({"stream": table}), spark, lambda t, f: f.name in chosen)
    known = vault.read("text_mappings").select(F.col("original_value").alias("value"), F.col("pseudonym_value").alias("token"))
    fresh = seen.join(known.select("value"), "value", "left_anti")
    if not fresh.isEmpty():
        alphabet = candidate_alphabet(sorted({p.fact.encoding for p in plans if p.fact.name in chosen}))
        made = allocate.allocate_text(seen, known, alphabet).join(known.select("value"), "value", "left_anti")
        rows = made.select(F.lit(TEXT_DOMAIN).alias("domain_id"), F.col("value").alias("original_value"), F.col("token").alias("pseudonym_value"), F.octet_length("token").alias("logical_byte_length"))
        with vault.lease():
            vault.commit({"text_mappings": vault.read("text_mappings").unionByName(rows)})
    text, numbers = vault.read("text_mappings"), vault.read("numeric_key_mappings")
    return transform.rewrite(table, plans, text, numbers, offset, transform.fits_broadcast(text, numbers))


def pseudonymize_stream(stream: DataFrame, plans: list[FieldPlan], vault_path: str, output: str, checkpoint: str, offset: int | None = None) -> StreamingQuery:
    """Rewritten rows appended to `output` as Parquet, a folder per batch, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        vault = Vault(SparkSession.active(), vault_path)
        rewrite_batch(df, plans, vault, offset).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
