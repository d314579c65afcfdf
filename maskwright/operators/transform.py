"""The record transform and its inverse: one projection per table over joins with the mappings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical_text, mask, shift
from ..plans.schema import INDEX, MASKED, PSEUDONYMIZE, SHIFT, FieldFact, Table

#: Mappings are broadcast up to this many pairs; beyond, the join is by shuffle, with salts.
BROADCAST_PAIRS = 200_000
SALTS = 16


@dataclass(frozen=True)
class FieldPlan:
    table: str
    fact: FieldFact
    action: str
    domain: str | None = None

    @property
    def numeric(self) -> bool:
        return self.action == PSEUDONYMIZE and self.fact.dbf_type not in "CV"


def looked_up(df: DataFrame, column: str, mapping: DataFrame, key: str, value: str, out: str, small: bool) -> DataFrame:
    """df with `out`, the partner of `column` in a mapping. A null never meets a partner.

    A large mapping is repeated for each salt, and records are dealt by value and a salt of their place, so that one value, or none, on a third
    of all records is spread.
    """
    pairs = mapping.select(F.col(key).alias(f"{out}_key"), F.col(value).alias(out))
    if small:
        return df.join(F.broadcast(pairs), df[column] == F.col(f"{out}_key"), "left").drop(f"{out}_key")
    place = next((c for c in (INDEX, "_at") if c in df.columns), None)
    salt = F.pmod(F.xxhash64(place), F.lit(SALTS)) if place else F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(SALTS))
    pairs = pairs.withColumn(f"{out}_salt", F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(SALTS)))))
    left = df.withColumn("_salt", salt)
    # else Spark goes by the size of the files, which knows nothing of salts, and sends all of it through the driver
    pairs = pairs.hint("merge")
    return left.join(pairs, (left[column] == F.col(f"{out}_key")) & (left["_salt"] == F.col(f"{out}_salt")), "left").drop(f"{out}_key", f"{out}_salt", "_salt")


def fits_broadcast(*mappings: DataFrame) -> bool:
    return all(m.count() <= BROADCAST_PAIRS for m in mappings)


def rewrite(table: Table, plans: list[FieldPlan], text: DataFrame, numbers: DataFrame, offset: int | None, small: bool, back: bool = False) -> DataFrame:
    """Transformed records, or recovered ones where back. Positions, deletion marks, nulls and empty texts stay."""
    key, value = ("pseudonym_value", "original_value") if back else ("original_value", "pseudonym_value")
    df, columns = table.df, {}
    for n, plan in enumerate(plans):
        name, kind = plan.fact.name, dict(table.df.dtypes)[plan.fact.name]
        found = f"_found{n}"
        if plan.numeric:
            df = df.withColumn(f"_key{n}", canonical_text(F.col(name)))
            df = looked_up(df, f"_key{n}", numbers.filter(F.col("domain_id") == plan.domain), key, value, found, small)
            lost = F.raise_error(F.lit("NUMERIC_MAPPING_MISSING")).cast(kind)
            columns[name] = F.when(F.col(name).isNull(), F.col(name)).when(F.col(found).isNotNull(), F.col(found).cast(kind)).otherwise(lost)
        elif plan.action == PSEUDONYMIZE:
            df = looked_up(df, name, text, key, value, found, small)
            lost = F.raise_error(F.lit("TEXT_MAPPING_MISSING")).cast("string")
            columns[name] = F.when(F.col(name).isNull() | (F.col(name) == ""), F.col(name)).when(F.col(found).isNotNull(), F.col(found)).otherwise(lost)
        elif plan.action == MASKED and not back:
            columns[name] = mask(F.col(name), kind)
        elif plan.action == SHIFT and offset is not None:
            columns[name] = shift(F.col(name), kind, -offset if back else offset)
    return df.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in table.df.columns))


def memo_rows(table: Table, table_id: str, plans: list[FieldPlan], field_ids: dict[str, str]) -> DataFrame | None:
    """What masks will hide: a row for each non-null long field of each record."""
    masked = [p for p in plans if p.action == MASKED]
    if not masked:
        return None
    kinds = dict(table.df.dtypes)
    cells = F.array(*(
        F.struct(
            F.lit(field_ids[p.fact.name]).alias("field_id"),
            (F.encode(p.fact.name, "UTF-8") if kinds[p.fact.name] == "string" else F.col(p.fact.name)).alias("original_payload"),
            F.lit("TEXT" if kinds[p.fact.name] == "string" else "BINARY").alias("payload_kind"),
        )
        for p in masked
    ))
    rows = table.df.select(F.lit(table_id).alias("table_id"), F.col(INDEX).alias("physical_record_index"), F.explode(cells).alias("cell"))
    return rows.select("table_id", "physical_record_index", "cell.*").filter("original_payload is not null")


def with_memos(table: Table, df: DataFrame, table_id: str, plans: list[FieldPlan], field_ids: dict[str, str], memos: DataFrame) -> DataFrame:
    """df with its masked fields as they were; a masked field without a stored original fails."""
    masked = [p.fact.name for p in plans if p.action == MASKED]
    if not masked:
        return df
    own = memos.filter(F.col("table_id") == table_id)
    wide = own.groupBy(F.col("physical_record_index").alias("_at")).agg(
        *(F.max(F.when(F.col("field_id") == field_ids[n], F.col("original_payload"))).alias(f"_memo_{n}") for n in masked)
    )
    joined = df.join(wide.hint("merge"), F.col(INDEX) == F.col("_at"), "left")
    kinds, out = dict(df.dtypes), {}
    for n in masked:
        stored = F.col(f"_memo_{n}")
        found = F.decode(stored, "UTF-8") if kinds[n] == "string" else stored
        lost = F.raise_error(F.lit("MEMO_RECOVERY_ROW_MISSING")).cast(kinds[n])
        out[n] = F.when(F.col(n).isNull(), F.col(n)).when(stored.isNotNull(), found).otherwise(lost)
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in df.columns))
