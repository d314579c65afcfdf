"""Verification: source and output record by record, ledgers, inventories, and a verdict over finding codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical_text, mask, shift
from ..plans.schema import DELETED, INDEX, KEEP, MASKED, PSEUDONYMIZE, SHIFT, Table
from .observe import stacked
from .transform import FieldPlan, looked_up

#: Findings that leave a dataset usable; any other makes it fail.
PARTIAL_CODES = {"INDEX_ARTIFACT_UNVERIFIED", "STANDALONE_IDX_DEFINITION_UNAVAILABLE"}
FINDINGS = "table_path string, code string, records bigint"


def verdict(codes: set[str]) -> str:
    return "PASS" if not codes else "PARTIAL" if codes <= PARTIAL_CODES else "FAIL"


def lockstep(source: Table, output: Table) -> DataFrame:
    """Records of both sides by position, as structs b and a; a side that ends early is null."""
    side = lambda t, name: t.df.select(F.col(INDEX).alias("_at"), F.struct(*t.df.columns).alias(name))
    return side(source, "b").join(side(output, "a"), "_at", "full_outer")


def schema_findings(source: Table, output: Table) -> list[str]:
    shape = lambda t: [(f.name, f.dbf_type, f.width, f.decimals, f.encoding) for f in t.facts if not f.system]
    return [] if shape(source) == shape(output) else ["SCHEMA_MISMATCH"]


def table_findings(source: Table, output: Table, plans: list[FieldPlan], text: DataFrame, numbers: DataFrame, memos: DataFrame, offset: int | None, field_ids: dict[str, str], small: bool) -> DataFrame:
    """table_path, code, records: how many records break each rule. One pass over the joined records."""
    wrong = schema_findings(source, output)
    if wrong:
        return source.df.sparkSession.createDataFrame([(source.path, c, 1) for c in wrong], FINDINGS)
    both = lockstep(source, output)
    there = F.col("b").isNotNull() & F.col("a").isNotNull()
    checks = [F.when(~there, F.lit("RECORD_COUNT_MISMATCH")), F.when(there & (F.col(f"b.{DELETED}") != F.col(f"a.{DELETED}")), F.lit("DELETED_MARKER_MISMATCH"))]
    masked = [p for p in plans if p.action == MASKED]
    if masked:
        own = memos.filter(F.col("field_id").isin([field_ids[p.fact.name] for p in masked]))
        wide = own.groupBy(F.col("physical_record_index").alias("_memo_at")).agg(
            *(F.max(F.when(F.col("field_id") == field_ids[p.fact.name], F.col("original_payload"))).alias(f"_memo_{p.fact.name}") for p in masked)
        )
        both = both.join(wide, F.col("_at") == F.col("_memo_at"), "left")
    for n, plan in enumerate(plans):
        name, kind = plan.fact.name, dict(source.df.dtypes)[plan.fact.name]
        before, after = F.col(f"b.`{name}`"), F.col(f"a.`{name}`")
        checks.append(F.when(there & (before.isNull() != after.isNull()), F.lit("NULL_SEMANTICS_MISMATCH")))
        some = there & before.isNotNull() & after.isNotNull()
        if plan.action == PSEUDONYMIZE:
            code = "NUMERIC_MAPPING_MISMATCH" if plan.numeric else "TEXT_MAPPING_MISMATCH"
            both = both.withColumn(f"_key{n}", canonical_text(before) if plan.numeric else before)
            pairs = numbers.filter(F.col("domain_id") == plan.domain) if plan.numeric else text
            both = looked_up(both, f"_key{n}", pairs, "original_value", "pseudonym_value", f"_found{n}", small)
            became = canonical_text(after) if plan.numeric else after
            real = some if plan.numeric else some & (before != "")
            checks.append(F.when(real & ~became.eqNullSafe(F.col(f"_found{n}")), F.lit(code)))
            checks.append(F.when(real & (before == after), F.lit("ORIGINAL_VALUE_SURVIVED")))
            if not plan.numeric:
                checks.append(F.when(some & (before == "") & (after != ""), F.lit("NULL_SEMANTICS_MISMATCH")))
        elif plan.action == MASKED:
            stored = F.col(f"_memo_{name}")
            original = F.encode(before, "UTF-8") if kind == "string" else before
            checks.append(F.when(some & ~after.eqNullSafe(mask(before, kind)), F.lit("MEMO_PAYLOAD_MISMATCH")))
            checks.append(F.when(some & stored.isNull(), F.lit("MEMO_RECOVERY_ROW_MISSING")))
            checks.append(F.when(some & stored.isNotNull() & (stored != original), F.lit("MEMO_PAYLOAD_MISMATCH")))
        elif plan.action == SHIFT:
            moved = shift(before, kind, offset) if offset is not None else before
            checks.append(F.when(some & ~after.eqNullSafe(moved), F.lit("TEMPORAL_VALUE_MISMATCH")))
        elif plan.action == KEEP:
            checks.append(F.when(some & ~before.eqNullSafe(after), F.lit("IDENTITY_VALUE_MISMATCH")))
    found = both.select(F.explode(F.array_distinct(F.array_compact(F.array(*checks)))).alias("code"))
    return found.groupBy("code").agg(F.count("*").alias("records")).select(F.lit(source.path).alias("table_path"), "code", "records")


def order_findings(output: Table) -> DataFrame:
    """Positions must be 0 to n-1, each once."""
    spark = output.df.sparkSession
    seen = output.df.agg(F.count("*").alias("n"), F.countDistinct(INDEX).alias("d"), F.min(INDEX).alias("low"), F.max(INDEX).alias("high"))
    bad = (F.col("n") > 0) & ((F.col("n") != F.col("d")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1))
    return seen.filter(bad).select(F.lit(output.path).alias("table_path"), F.lit("RECORD_ORDER_MISMATCH").alias("code"), F.lit(1).cast("bigint").alias("records"))


def ledger_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of (table, field, action) that only one side has, or whose action differs: code per row."""
    a = expected.select(F.col("relative_path").alias("p"), F.col("name").alias("n"), F.col("transform_action").alias("want"))
    b = actual.select(F.col("relative_path").alias("q"), F.col("name").alias("m"), F.col("transform_action").alias("have"))
    both = a.join(b, (F.col("p") == F.col("q")) & (F.col("n") == F.col("m")), "full_outer")
    code = F.when(F.col("have").isNull(), "POLICY_BINDING_MISSING").when(~F.col("want").eqNullSafe(F.col("have")), "POLICY_BINDING_MISMATCH")
    return both.select(F.coalesce("p", "q").alias("relative_path"), F.coalesce("n", "m").alias("name"), code.alias("code")).filter("code is not null")


def inventory_difference(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """Paths that only one side has."""
    lost = expected.select(key).distinct().join(actual.select(key).distinct(), key, "left_anti").withColumn("code", F.lit("TABLE_MISSING"))
    extra = actual.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").withColumn("code", F.lit("UNEXPECTED_OUTPUT_ARTIFACT"))
    return lost.unionByName(extra)


def findings_union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    return stacked(parts, spark, FINDINGS)
