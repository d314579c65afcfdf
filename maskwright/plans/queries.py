"""One query per operator over the test tables, with the same result as SQL where SQL can say it.

The tables have no nulls, orphans, empty texts or deleted records, so queries make them by rule, the same way on both sides:
keys become null, texts empty and records deleted where an id is a multiple of a small number. Random
pseudonyms are never returned, only what must hold for any of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens, values
from ..operators import allocate, capacity, evidence, observe, ranks, transform, verify
from ..operators.transform import FieldPlan
from ..sources.dataset import artifact_hashes, positioned, table_of_artifact
from ..sources.shared import Files, materialize, shared_dir
from . import engine, schema
from .policy import resolve_policy
from .relations import TEXT_DOMAIN
from .schema import DELETED, INDEX, KEEP, MASKED, PSEUDONYMIZE, SHIFT, Dataset, FieldFact, Table, classify_field

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Declared widths of text columns; Parquet has none.
WIDTHS = {
    "customer": {"c_name": 25, "c_mktsegment": 10}, "nation": {"n_name": 25}, "region": {"r_name": 25}, "supplier": {"s_name": 25},
    "part": {"p_name": 25, "p_brand": 10, "p_type": 10}, "lineitem": {"l_returnflag": 1, "l_linestatus": 1},
    "orders": {"o_orderstatus": 1, "o_orderpriority": 15}, "events": {"event_type": 12, "props": 64},
}
KEY_LOW, KEY_HIGH = values.member_range("N", 9)


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    tables = {}
    for name, widths in WIDTHS.items():
        facts = tuple(FieldFact(c, "V" if c == "props" else "C", w) for c, w in widths.items())
        tables[name] = Table(name, read(spark, sf_dir, name).select(*widths), facts)
    return Dataset(tables)


OBSERVED = " UNION ALL ".join(f"SELECT {c} AS value, {w} AS width FROM {t}" for t, ws in WIDTHS.items() for c, w in ws.items())
OBSERVED = f"(SELECT value, min(width)::INT AS min_width FROM ({OBSERVED}) WHERE value IS NOT NULL AND value <> '' GROUP BY value)"


@query(f"SELECT * FROM {OBSERVED}")
def text_observation(spark, sf_dir):
    return observe.text_observations(text_dataset(spark, sf_dir), spark)


@query(f"""SELECT min_width, count(*) AS originals, sum(count(*)) OVER (ORDER BY min_width)::BIGINT AS needed FROM {OBSERVED} GROUP BY min_width""")
def text_capacity_by_width(spark, sf_dir):
    return capacity.capacity_by_width(observe.text_observations(text_dataset(spark, sf_dir), spark))


CLASSES = f"""
WITH obs AS {OBSERVED},
reserved AS (SELECT length(value) AS len, count(*) AS n FROM obs WHERE regexp_full_match(value, '[A-Z0-9]+') GROUP BY 1),
cap AS (SELECT l.len, (36::HUGEINT ** l.len)::HUGEINT - coalesce(r.n, 0) AS cap FROM range(1, 12) l(len) LEFT JOIN reserved r ON r.len = l.len),
lim AS (SELECT len, coalesce(sum(cap) OVER (ORDER BY len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(cap) OVER (ORDER BY len) AS hi FROM cap),
ranked AS (SELECT value, min_width, row_number() OVER (ORDER BY min_width, encode(value)) - 1 AS k FROM obs)
"""


@query(CLASSES + "SELECT len::INT AS token_length, count(*) AS n FROM ranked JOIN lim ON k >= lo AND k < hi GROUP BY len")
def text_length_class_histogram(spark, sf_dir):
    observed = observe.text_observations(text_dataset(spark, sf_dir), spark)
    nothing = spark.createDataFrame([], "value string, token string")
    mapped = materialize(allocate.allocate_text(observed, nothing), "mapping")
    return mapped.groupBy(F.length("token").alias("token_length")).agg(F.count("*").alias("n"))


@query(CLASSES + "SELECT value, min_width, k FROM ranked")
def text_dense_rank(spark, sf_dir):
    observed = observe.text_observations(text_dataset(spark, sf_dir), spark)
    return ranks.dense_index(observed, "min_width", F.encode("value", "UTF-8"))


@query(f"SELECT count(*) AS pairs, count(*) AS originals, count(*) AS tokens, true AS bijective, 0::BIGINT AS self_assigned, 0::BIGINT AS too_long FROM {OBSERVED}")
def text_mapping_bijection(spark, sf_dir):
    observed = materialize(observe.text_observations(text_dataset(spark, sf_dir), spark), "observed")
    mapped = materialize(allocate.allocate_text(observed, spark.createDataFrame([], "value string, token string")), "mapping")
    # every observed text has a token that fits, and none is its own
    whole = observed.join(mapped, "value", "left")
    odd = whole.agg(F.count_if(F.expr("value = token")).alias("self_assigned"), F.count_if(F.expr("token is null or length(token) > min_width")).alias("too_long"))
    return allocate.check_bijection(mapped).select("*", *(F.lit(v).alias(c) for c, v in odd.first().asDict().items()))


@query("SELECT c_custkey, translate(to_base(c_custkey, 36, 6), '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789') AS token, c_custkey AS back FROM customer")
def token_at_index(spark, sf_dir):
    out = read(spark, sf_dir, "customer").select("c_custkey", tokens.token_of(F.col("c_custkey"), 6).alias("token"))
    return out.withColumn("back", tokens.offset_of(F.col("token"), 6))


@query(f"SELECT value, regexp_full_match(value, '[A-Z0-9]+') AS safe FROM {OBSERVED}")
def token_safety(spark, sf_dir):
    return observe.text_observations(text_dataset(spark, sf_dir), spark).select("value", tokens.is_safe(F.col("value")).alias("safe"))


@query("SELECT DISTINCT 'num-customer' AS domain_id, CAST(k AS VARCHAR) AS value FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders)")
def numeric_domain_observed(spark, sf_dir):
    data = Dataset({n: Table(n, read(spark, sf_dir, n), ()) for n in ("customer", "orders")})
    members = {("customer", "c_custkey"): "num-customer", ("orders", "o_custkey"): "num-customer"}
    return observe.numeric_observations(data, members, spark)


VERDICT_INPUT = "CASE WHEN {k} % 11 = 0 THEN NULL WHEN {k} % 7 = 0 THEN -2147483648 WHEN {k} % 5 = 0 THEN 2147483647 WHEN {k} % 3 = 0 THEN {k} + 3000000000 ELSE -{k} END"


@query(f"""SELECT l_orderkey, l_linenumber, CAST(v AS VARCHAR) AS v, CASE WHEN v IS NULL THEN NULL WHEN v BETWEEN -2147483647 AND 2147483646 THEN 'REVERSIBLE'
WHEN v IN (-2147483648, 2147483647) THEN 'RECOVERY_UNWRITABLE' ELSE 'OUT_OF_MEMBER_RANGE' END AS verdict
FROM (SELECT l_orderkey, l_linenumber, ({VERDICT_INPUT.format(k='l_orderkey')})::BIGINT AS v FROM lineitem)""")
def numeric_member_verdict(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(VERDICT_INPUT.format(k="l_orderkey")).cast("bigint").alias("v"))
    return rows.select("l_orderkey", "l_linenumber", F.col("v").cast("string").alias("v"), values.member_verdict(F.col("v"), "I", 4).alias("verdict"))


CANONICAL_INPUT = "CASE o_orderkey % 6 WHEN 0 THEN '007' WHEN 1 THEN '-0' WHEN 2 THEN '+5' WHEN 3 THEN CAST(-o_orderkey AS {string}) WHEN 4 THEN '' ELSE CAST(o_orderkey AS {string}) END"


@query(f"SELECT o_orderkey, t, CASE WHEN regexp_full_match(t, '0|-?[1-9][0-9]*') THEN CAST(CAST(t AS BIGINT) AS VARCHAR) END AS parsed FROM (SELECT o_orderkey, {CANONICAL_INPUT.format(string='VARCHAR')} AS t FROM orders)")
def canonical_integer_parse(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(CANONICAL_INPUT.format(string="STRING")).alias("t"))
    return rows.select("*", values.parse_canonical(F.col("t")).cast("string").alias("parsed"))


@query("""SELECT d.low, d.high, o.n AS originals, (d.high - d.low + 1)::BIGINT AS free, o.own AS own_free, o.n <= d.high - d.low + 1 AND (o.own = 0 OR d.high - d.low + 1 >= 2) AS feasible
FROM (SELECT -99999999::BIGINT AS low, 999999999::BIGINT AS high UNION ALL SELECT 1, (SELECT count(*) FROM customer) UNION ALL SELECT 2, (SELECT count(*) FROM customer)) d,
LATERAL (SELECT count(*) AS n, count(*) FILTER (c_custkey BETWEEN d.low AND d.high) AS own FROM customer) o""")
def numeric_bijection_feasible(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select("c_custkey").distinct()
    n = customers.count()
    rows = []
    for low, high in ((KEY_LOW, KEY_HIGH), (1, n), (2, n)):
        own = customers.filter(F.col("c_custkey").between(low, high)).count()
        rows.append((low, high, n, high - low + 1, own, allocate.numeric_feasible(low, high, n, 0, own)))
    return spark.createDataFrame(rows, "low bigint, high bigint, originals bigint, free bigint, own_free bigint, feasible boolean")


@query("""WITH blocked AS (SELECT DISTINCT l_orderkey AS v FROM lineitem), f AS (SELECT v, v - 1 - (row_number() OVER (ORDER BY v) - 1) AS free FROM blocked),
cum AS (SELECT free, sum(count(*)) OVER (ORDER BY free) AS n FROM f GROUP BY free), w AS (SELECT c_custkey AS j FROM customer)
SELECT w.j, (1 + w.j + coalesce(c.n, 0))::BIGINT AS value FROM w ASOF LEFT JOIN cum c ON w.j >= c.free""")
def numeric_jth_free(spark, sf_dir):
    blocked = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("value"))
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("j"))
    return ranks.jth_free(wanted, blocked, 1)


@query("SELECT count(*) AS pairs, count(*) AS originals, count(*) AS tokens, true AS bijective, 0::BIGINT AS self_assigned, 0::BIGINT AS out_of_range FROM customer")
def numeric_mapping_bijection(spark, sf_dir):
    mapped = key_mapping(spark, sf_dir)
    token = F.col("token").cast("decimal(38,0)")
    odd = mapped.agg(F.count_if(F.expr("value = token")).alias("self_assigned"), F.count_if(~token.between(KEY_LOW, KEY_HIGH)).alias("out_of_range"))
    return allocate.check_bijection(mapped).select("*", *(F.lit(v).alias(c) for c, v in odd.first().asDict().items()))


TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
DAYS = " UNION ALL ".join(f"SELECT CAST({c} AS DATE) - DATE '0001-01-01' + 1 AS d FROM {t}" for t, c in TIMES.items())


def timed(spark, sf_dir) -> Dataset:
    return Dataset({t: Table(t, read(spark, sf_dir, t), (FieldFact(c, "T", 8),)) for t, c in TIMES.items()})


@query(f"SELECT min(d)::INT AS least_day, max(d)::INT AS most_day FROM ({DAYS})")
def temporal_extremes(spark, sf_dir):
    return observe.temporal_extremes(timed(spark, sf_dir), spark)


@query(f"SELECT (1 - min(d))::INT AS low, (3652059 - max(d))::INT AS high FROM ({DAYS})")
def temporal_interval(spark, sf_dir):
    found = observe.temporal_extremes(timed(spark, sf_dir), spark)
    return found.select((1 - F.col("least_day")).alias("low"), (values.LAST_DAY - F.col("most_day")).alias("high"))


@query("SELECT event_id, ts + INTERVAL 366 DAY AS moved, CAST(CAST(ts AS DATE) - 366 AS VARCHAR) AS day_back FROM events")
def temporal_shift_fixed(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select("event_id", values.shift(F.col("ts"), "timestamp_ntz", 366).alias("moved"), values.shift(F.col("ts").cast("date"), "date", -366).cast("string").alias("day_back"))


@query("""SELECT doc_id, CASE WHEN t IS NULL THEN NULL WHEN t = '[MASKED-MEMO]' THEN '[MASKED-MEMO-ALT]' ELSE '[MASKED-MEMO]' END AS masked
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[MASKED-MEMO]' WHEN 2 THEN '' ELSE text END AS t FROM documents)""")
def memo_mask(spark, sf_dir):
    text = F.expr("CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '[MASKED-MEMO]' WHEN 2 THEN '' ELSE text END")
    return read(spark, sf_dir, "documents").select("doc_id", values.mask(text).alias("masked"))


# keys with nulls and orphans, made by rule: customers whose key is a multiple of 7 lose it, so their orders are orphans
PARENT_KEY = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END"
FOREIGN_KEY = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END"
KEYED = f"(SELECT 'PARENT' AS role, {PARENT_KEY} AS k FROM customer UNION ALL SELECT 'FOREIGN', {FOREIGN_KEY} FROM orders)"
IDENTITY = "'1#N' || strlen(CAST(k AS VARCHAR)) || ':' || CAST(k AS VARCHAR)"


def keyed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    customer = positioned(read(spark, sf_dir, "customer")).withColumn("c_custkey", F.expr(PARENT_KEY))
    orders = positioned(read(spark, sf_dir, "orders")).withColumn(DELETED, F.expr("o_orderkey % 13 = 0")).withColumn("o_custkey", F.expr(FOREIGN_KEY))
    return customer, orders


def key_histogram(spark, customer: DataFrame, orders: DataFrame, side: str = "SOURCE") -> list[evidence.KeySource]:
    return [
        evidence.KeySource(side, "orders-customer", evidence.PARENT, customer, ("c_custkey",), (True,)),
        evidence.KeySource(side, "orders-customer", evidence.FOREIGN, orders, ("o_custkey",), (True,)),
    ]


@query(f"SELECT 'SOURCE' AS side, 'orders-customer' AS relation_id, role, {IDENTITY} AS key, count(*) AS occurrences FROM {KEYED} GROUP BY role, k")
def relation_histogram(spark, sf_dir):
    return evidence.relation_histogram(evidence.relation_keys(key_histogram(spark, *keyed(spark, sf_dir)), spark))


@query(f"""SELECT 'SOURCE' AS side, 'orders-customer' AS relation_id, role, sum(n)::BIGINT AS row_count, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS null_tuples,
count(k) AS unique_keys, coalesce(max(n) FILTER (k IS NOT NULL), 0) AS max_multiplicity FROM (SELECT role, k, count(*) AS n FROM {KEYED} GROUP BY role, k) GROUP BY role""")
def relation_side_facts(spark, sf_dir):
    return evidence.side_facts(relation_histogram(spark, sf_dir))


@query(f"SELECT 'SOURCE' AS side, 'orders-customer' AS relation_id, role, n AS occurrences, count(*) AS keys FROM (SELECT role, k, count(*) AS n FROM {KEYED} WHERE k IS NOT NULL GROUP BY role, k) GROUP BY role, n")
def relation_profile(spark, sf_dir):
    return evidence.profile(relation_histogram(spark, sf_dir))


@query(f"SELECT role, sha256('RELATION-PROFILE/v1' || string_agg(n || ',', '' ORDER BY n DESC)) AS digest FROM (SELECT role, k, count(*) AS n FROM {KEYED} WHERE k IS NOT NULL GROUP BY role, k) GROUP BY role")
def relation_profile_digest(spark, sf_dir):
    counts: dict[str, dict[int, int]] = {}
    for r in relation_profile(spark, sf_dir).collect():  # counts of counts: a few rows
        counts.setdefault(r["role"], {})[r["occurrences"]] = r["keys"]
    return spark.createDataFrame([(role, evidence.profile_digest(c)) for role, c in counts.items()], "role string, digest string")


MATCHED = f"""SELECT count(*) AS foreign_rows, count(*) FILTER (k IS NULL) AS foreign_nulls,
count(*) FILTER (EXISTS (SELECT 1 FROM customer WHERE {PARENT_KEY} = k)) AS matched,
count(*) FILTER (k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE {PARENT_KEY} = k)) AS orphans FROM (SELECT {FOREIGN_KEY} AS k FROM orders)"""


@query(MATCHED)
def relation_matched_orphan(spark, sf_dir):
    return evidence.relation_metrics(relation_histogram(spark, sf_dir)).select("foreign_rows", "foreign_nulls", "matched", "orphans")


COMPOSITE = "(SELECT l_orderkey AS a, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS b FROM lineitem)"


@query(f"""WITH p AS (SELECT a, b FROM {COMPOSITE} WHERE b IS NOT NULL), f AS (SELECT l_orderkey AS a, l_linenumber % 4 + 1 AS b FROM lineitem)
SELECT (SELECT count(*) FROM {COMPOSITE}) AS parent_rows, (SELECT count(*) FROM {COMPOSITE} WHERE b IS NULL) AS parent_nulls, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM p)) AS parent_unique,
count(*) AS foreign_rows, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.a = f.a AND p.b = f.b)) AS matched, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p WHERE p.a = f.a AND p.b = f.b)) AS orphans FROM f""")
def relation_composite_metrics(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    parent = lines.select("l_orderkey", F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END").alias("l_linenumber"))
    foreign = lines.select("l_orderkey", (F.col("l_linenumber") % 4 + 1).alias("l_linenumber"))
    columns, numeric = ("l_orderkey", "l_linenumber"), (True, True)
    sources = [evidence.KeySource("SOURCE", "lines", evidence.PARENT, parent, columns, numeric), evidence.KeySource("SOURCE", "lines", evidence.FOREIGN, foreign, columns, numeric)]
    metrics = evidence.relation_metrics(evidence.relation_histogram(evidence.relation_keys(sources, spark)))
    return metrics.select("parent_rows", "parent_nulls", "parent_unique", "foreign_rows", "matched", "orphans")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, '3#N' || strlen(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey || 'N' || strlen(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber || 'T' || strlen(l_returnflag) || ':' || l_returnflag AS key FROM lineitem")
def composite_identity(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    names = ("l_orderkey", "l_linenumber", "l_returnflag")
    return lines.select(*names, evidence.key_identity(names, (True, True, False)).alias("key"))


def key_mapping(spark, sf_dir) -> DataFrame:
    """A pseudonym for each customer key, written once."""
    observed = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("value")).distinct()
    return materialize(allocate.allocate_numeric(observed, spark.createDataFrame([], "value string, token string"), KEY_LOW, KEY_HIGH), "mapping")


def protected(spark, sf_dir) -> dict:
    """customer and orders, their rewritten forms, and the mappings: keys and texts replaced, dates moved, one text masked."""
    customer, orders = keyed(spark, sf_dir)
    customer = customer.withColumn("c_mktsegment", F.expr("CASE WHEN _physical_index % 5 = 0 THEN '' WHEN _physical_index % 9 = 0 THEN NULL ELSE c_mktsegment END"))
    numbers = key_mapping(spark, sf_dir).select(F.lit("num").alias("domain_id"), F.col("value").alias("original_value"), F.col("token").alias("pseudonym_value"))
    fact = lambda n, t, w: FieldFact(n, t, w)
    plans = {
        "customer": [FieldPlan("customer", fact("c_custkey", "N", 9), PSEUDONYMIZE, "num"), FieldPlan("customer", fact("c_name", "C", 25), MASKED),
                     FieldPlan("customer", fact("c_mktsegment", "C", 10), PSEUDONYMIZE, TEXT_DOMAIN), FieldPlan("customer", fact("c_acctbal", "B", 8), KEEP)],
        "orders": [FieldPlan("orders", fact("o_custkey", "N", 9), PSEUDONYMIZE, "num"), FieldPlan("orders", fact("o_orderstatus", "C", 1), PSEUDONYMIZE, TEXT_DOMAIN),
                   FieldPlan("orders", fact("o_orderdate", "T", 8), SHIFT), FieldPlan("orders", fact("o_totalprice", "B", 8), KEEP)],
    }
    tables = {n: Table(n, df, tuple(p.fact for p in plans[n])) for n, df in (("customer", customer), ("orders", orders))}
    texts = observe.text_observations(Dataset(tables), spark, lambda t, f: f.dbf_type == "C" and f.name != "c_name")
    pairs = allocate.allocate_text(texts, spark.createDataFrame([], "value string, token string"))
    text = materialize(pairs.select(F.col("value").alias("original_value"), F.col("token").alias("pseudonym_value")), "text")
    field_ids = {n: {p.fact.name: f"{n}.{p.fact.name}" for p in plans[n]} for n in plans}
    memos = materialize(transform.memo_rows(tables["customer"], "customer", plans["customer"], field_ids["customer"]), "memos")
    after = {n: t.with_df(materialize(transform.rewrite(t, plans[n], text, numbers, 366, transform.fits_broadcast(text, numbers)), n)) for n, t in tables.items()}
    return {"before": tables, "after": after, "plans": plans, "text": text, "numbers": numbers, "memos": memos, "ids": field_ids}


@query(f"""SELECT 'orders-customer' AS relation_id, 'VERIFIED' AS status, true AS parent_uniqueness, true AS foreign_multiplicity, true AS matched_rows, true AS orphan_count, true AS null_counts,
m.matched, m.orphans, m.foreign_nulls, (SELECT count(DISTINCT {PARENT_KEY}) FROM customer) AS parent_unique FROM ({MATCHED}) m""")
def relation_invariants_after(spark, sf_dir):
    """Keys are replaced on both sides; uniqueness, matches, orphans, nulls and multiplicities must be as before."""
    customer, orders = keyed(spark, sf_dir)
    numbers = key_mapping(spark, sf_dir).select(F.lit("num").alias("domain_id"), F.col("value").alias("original_value"), F.col("token").alias("pseudonym_value"))
    rewrite = lambda n, df, c: transform.rewrite(Table(n, df, ()), [FieldPlan(n, FieldFact(c, "N", 9), PSEUDONYMIZE, "num")], spark.createDataFrame([], "original_value string, pseudonym_value string"), numbers, None, False)
    after = (rewrite("customer", customer, "c_custkey"), rewrite("orders", orders, "o_custkey"))
    sources = key_histogram(spark, customer, orders) + key_histogram(spark, *after, "OUTPUT")
    metrics = materialize(evidence.relation_metrics(evidence.relation_histogram(evidence.relation_keys(sources, spark))), "metrics")
    names = dict(zip(evidence.INVARIANTS, ("parent_uniqueness", "foreign_multiplicity", "matched_rows", "orphan_count", "null_counts"), strict=True))
    return evidence.compare_sides(metrics).select(
        "relation_id", "status", *(F.col(a).alias(b) for a, b in names.items()), F.col("a_matched").alias("matched"), F.col("a_orphans").alias("orphans"),
        F.col("a_foreign_nulls").alias("foreign_nulls"), F.col("a_parent_unique").alias("parent_unique"),
    )


@query("SELECT n AS occurrences, count(*) AS keys FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus) GROUP BY n")
def pseudonymize_profile_preserved(spark, sf_dir):
    after = protected(spark, sf_dir)["after"]["orders"].df
    return after.groupBy("o_orderstatus").agg(F.count("*").alias("occurrences")).groupBy("occurrences").agg(F.count("*").alias("keys"))


@query("SELECT 0::BIGINT AS text_survived, 0::BIGINT AS keys_survived, 0::BIGINT AS memos_survived, (SELECT count(*) FROM orders) AS records")
def pseudonymize_no_survivor(spark, sf_dir):
    p = protected(spark, sf_dir)
    pair = lambda n: verify.lockstep(p["before"][n], p["after"][n])
    orders, customer = pair("orders"), pair("customer")
    a = orders.agg(F.count_if(F.expr("b.o_orderstatus = a.o_orderstatus")).alias("text_survived"), F.count_if(F.expr("b.o_custkey = a.o_custkey")).alias("keys_survived"), F.count("*").alias("records")).first()
    b = customer.agg(F.count_if(F.expr("b.c_name = a.c_name")).alias("n")).first()
    return spark.createDataFrame([(a["text_survived"], a["keys_survived"], b["n"], a["records"])], "text_survived bigint, keys_survived bigint, memos_survived bigint, records bigint")


def back(p: dict, name: str) -> DataFrame:
    df = transform.rewrite(p["after"][name], p["plans"][name], p["text"], p["numbers"], 366, transform.fits_broadcast(p["text"], p["numbers"]), back=True)
    return transform.with_memos(p["before"][name], df, name, p["plans"][name], p["ids"][name], p["memos"])


@query(f"SELECT CAST({PARENT_KEY} AS VARCHAR) AS c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def recover_roundtrip_customer(spark, sf_dir):
    return back(protected(spark, sf_dir), "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal")


@query(f"SELECT o_orderkey, CAST({FOREIGN_KEY} AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_orderkey % 13 = 0 AS deleted FROM orders")
def recover_roundtrip_orders(spark, sf_dir):
    return back(protected(spark, sf_dir), "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", F.col(DELETED).alias("deleted"))


def findings(spark, p: dict, after: dict) -> DataFrame:
    parts, small = [], transform.fits_broadcast(p["text"], p["numbers"])
    for n, t in p["before"].items():
        parts.append(verify.table_findings(t, after[n], p["plans"][n], p["text"], p["numbers"], p["memos"], 366, p["ids"][n], small))
        parts.append(verify.order_findings(after[n]))
    return verify.findings_union(parts, spark)


@query("SELECT 'PASS' AS status, 0::BIGINT AS findings")
def verify_findings_clean(spark, sf_dir):
    p = protected(spark, sf_dir)
    codes = {r["code"] for r in findings(spark, p, p["after"]).select("code").distinct().collect()}
    return spark.createDataFrame([(verify.verdict(codes), len(codes))], "status string, findings bigint")


TAMPERED = (2, 3, 5, 7, 17)


@query(f"""SELECT 'customer' AS table_path, 'MEMO_PAYLOAD_MISMATCH' AS code, count(*) AS records FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT 'orders', 'DELETED_MARKER_MISMATCH', count(*) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'orders', 'IDENTITY_VALUE_MISMATCH', count(*) FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'orders', 'NULL_SEMANTICS_MISMATCH', count({FOREIGN_KEY}) FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'orders', 'TEMPORAL_VALUE_MISMATCH', count(*) FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'orders', 'TEXT_MAPPING_MISMATCH', count(*) FROM orders WHERE o_orderkey % 17 = 0 UNION ALL SELECT 'orders', 'ORIGINAL_VALUE_SURVIVED', count(*) FROM orders WHERE o_orderkey % 17 = 0""")
def verify_findings_tampered(spark, sf_dir):
    """Every rule that these tables can break is broken in some of their records, each in others."""
    p = protected(spark, sf_dir)
    original = p["before"]["orders"].df.select(INDEX, F.col("o_orderstatus").alias("was"))
    orders = p["after"]["orders"].df.join(original, INDEX)
    change = lambda name, n, new: F.when(F.col("o_orderkey") % n == 0, new).otherwise(F.col(name)).alias(name)
    changed = {
        DELETED: change(DELETED, TAMPERED[0], ~F.col(DELETED)), "o_totalprice": change("o_totalprice", TAMPERED[1], F.col("o_totalprice") + 1),
        "o_custkey": change("o_custkey", TAMPERED[2], F.lit(None)), "o_orderdate": change("o_orderdate", TAMPERED[3], F.col("o_orderdate") + F.make_dt_interval(F.lit(1))),
        "o_orderstatus": change("o_orderstatus", TAMPERED[4], F.col("was")),
    }
    orders = orders.select(*(changed.get(c, F.col(c)) for c in p["after"]["orders"].df.columns))
    customer = p["after"]["customer"].df.withColumn("c_name", F.when(F.col("c_nationkey") % 2 == 0, "x").otherwise(F.col("c_name")))
    after = {"orders": p["after"]["orders"].with_df(orders), "customer": p["after"]["customer"].with_df(customer)}
    return findings(spark, p, after)


@query("SELECT greatest(a.n, b.n) - least(a.n, b.n) AS record_count_mismatch, greatest(a.n, b.n) AS positions FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM customer) b")
def lockstep_difference(spark, sf_dir):
    """Two tables of different lengths, position by position."""
    a, b = (Table(n, positioned(read(spark, sf_dir, n)).select(INDEX, DELETED), ()) for n in ("orders", "customer"))
    return verify.lockstep(a, b).agg(F.count_if(F.expr("a is null or b is null")).alias("record_count_mismatch"), F.count("*").alias("positions"))


EVERY = ("benchmark", "conversations", "customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
LEDGER_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS relative_path, column_name AS name, CASE WHEN column_type = 'VARCHAR' THEN 'PSEUDONYMIZE_REVERSIBLE' WHEN column_type LIKE 'TIMESTAMP%' THEN 'SHIFT_REVERSIBLE' ELSE 'KEEP' END AS transform_action FROM (DESCRIBE {t})"
    for t in EVERY
)


@query(LEDGER_SQL)
def field_actions(spark, sf_dir):
    policy = resolve_policy()
    rows = []
    for t in EVERY:
        for fact in schema.read_facts(read(spark, sf_dir, t).schema):
            rows.append((t, fact.name, classify_field(fact, policy)))
    return spark.createDataFrame(rows, "relative_path string, name string, transform_action string")


@query("SELECT 'orders' AS relative_path, 'o_custkey' AS name, 'POLICY_BINDING_MISSING' AS code UNION ALL SELECT 'region', 'r_name', 'POLICY_BINDING_MISMATCH'")
def ledger_completeness(spark, sf_dir):
    want = field_actions(spark, sf_dir)
    have = want.filter("name != 'o_custkey'").withColumn("transform_action", F.when(F.col("name") == "r_name", KEEP).otherwise(F.col("transform_action")))
    return verify.ledger_difference(want, have)


RENAMED = "replace({0}, '/en/', '/english/')"


@query(f"""WITH want AS (SELECT DISTINCT url AS path FROM pages WHERE url IS NOT NULL), have AS (SELECT DISTINCT {RENAMED.format('url')} AS path FROM pages WHERE url IS NOT NULL)
SELECT path, 'TABLE_MISSING' AS code FROM (FROM want EXCEPT FROM have) UNION ALL SELECT path, 'UNEXPECTED_OUTPUT_ARTIFACT' FROM (FROM have EXCEPT FROM want)""")
def inventory_difference(spark, sf_dir):
    """Two inventories of all pages; in one of them some paths are renamed."""
    pages = read(spark, sf_dir, "pages").select(F.col("url").alias("path")).filter("path is not null")
    return verify.inventory_difference(pages, pages.select(F.expr(RENAMED.format("path")).alias("path")))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_path, count(*) AS records, {'count(*) FILTER (o_orderkey % 13 = 0)' if t == 'orders' else '0'}::BIGINT AS deleted FROM {t}" for t in EVERY))
def record_counters(spark, sf_dir):
    parts = []
    for t in EVERY:
        df = positioned(read(spark, sf_dir, t))
        df = df.withColumn(DELETED, F.expr("o_orderkey % 13 = 0")) if t == "orders" else df
        parts.append(df.agg(F.lit(t).alias("table_path"), F.count("*").alias("records"), F.count_if(DELETED).alias("deleted")))
    return observe.stacked(parts, spark, "table_path string, records bigint, deleted bigint")


NO_PAIRS = "value string, token string"
#: A domain as tight as can be: so many letters, each the text of its own field, and each wants a token of one character.
LETTERS = "ABCDEFG"


@query("SELECT count(DISTINCT n_nationkey % 7) AS pairs, 0::BIGINT AS self_assigned, 0::BIGINT AS beyond_alphabet, 0::BIGINT AS too_long, true AS bijective FROM nation")
def text_mapping_tight(spark, sf_dir):
    """As many texts as tokens of one character in a narrowed alphabet, all of them tokens themselves: only a derangement will do."""
    observed = read(spark, sf_dir, "nation").select(F.expr(f"substring('{LETTERS}', n_nationkey % {len(LETTERS)} + 1, 1)").alias("value"), F.lit(1).alias("min_width")).distinct()
    return mapping_facts(observed, allocate.allocate_text(observed, spark.createDataFrame([], NO_PAIRS), LETTERS), LETTERS)


@query("SELECT (SELECT count(DISTINCT n_nationkey % 7) FROM nation) + (SELECT count(DISTINCT c_name) FROM customer) AS pairs, 0::BIGINT AS self_assigned, 0::BIGINT AS beyond_alphabet, 0::BIGINT AS too_long, true AS bijective")
def text_mapping_tight_and_wide(spark, sf_dir):
    """The same beside wider texts: their tokens come after the tight part and stay in the alphabet."""
    tight = read(spark, sf_dir, "nation").select(F.expr(f"substring('{LETTERS}', n_nationkey % {len(LETTERS)} + 1, 1)").alias("value"), F.lit(1).alias("min_width")).distinct()
    observed = materialize(tight.unionByName(read(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), F.lit(25).alias("min_width")).distinct()), "observed")
    return mapping_facts(observed, allocate.allocate_text(observed, spark.createDataFrame([], NO_PAIRS), LETTERS), LETTERS)


def mapping_facts(observed: DataFrame, mapped: DataFrame, alphabet: str) -> DataFrame:
    mapped = materialize(mapped, "mapping")
    whole = observed.join(mapped, "value", "left")
    odd = whole.agg(
        F.count("*").alias("pairs"), F.count_if(F.expr("value = token")).alias("self_assigned"), F.count_if(~F.col("token").rlike(f"^[{alphabet}]+$")).alias("beyond_alphabet"),
        F.count_if(F.expr("token is null or length(token) > min_width")).alias("too_long"),
    )
    return odd.withColumn("bijective", F.lit(allocate.check_bijection(mapped).first()["bijective"]))


@query("SELECT count(DISTINCT c_name) AS pairs, count(DISTINCT c_name) FILTER (c_custkey % 2 = 0) AS reused, true AS bijective FROM customer")
def text_mapping_persisted(spark, sf_dir):
    """Half of the texts have their tokens from an earlier run: these stay, the others get new ones beside them."""
    names = read(spark, sf_dir, "customer").select(F.col("c_name").alias("value"), F.lit(25).alias("min_width"), "c_custkey")
    first = materialize(allocate.allocate_text(names.filter("c_custkey % 2 = 0").select("value", "min_width").distinct(), spark.createDataFrame([], NO_PAIRS)), "first")
    second = materialize(allocate.allocate_text(names.select("value", "min_width").distinct(), first), "second")
    reused = second.join(first, ["value", "token"]).count()
    return allocate.check_bijection(second).select("pairs", F.lit(reused).cast("bigint").alias("reused"), "bijective")


@query("SELECT count(DISTINCT c_custkey) AS pairs, 0::BIGINT AS self_assigned, 0::BIGINT AS out_of_range, true AS bijective FROM customer")
def numeric_mapping_tight(spark, sf_dir):
    """A range that holds the keys and nothing else: every number is taken, none by itself."""
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("value")).distinct()
    low, high = read(spark, sf_dir, "customer").agg(F.min("c_custkey"), F.min("c_custkey") + F.countDistinct("c_custkey") - 1).first()
    mapped = materialize(allocate.allocate_numeric(keys, spark.createDataFrame([], NO_PAIRS), low, high), "mapping")
    odd = mapped.agg(F.count("*").alias("pairs"), F.count_if(F.expr("value = token")).alias("self_assigned"), F.count_if(~F.col("token").cast("bigint").between(low, high)).alias("out_of_range"))
    return odd.withColumn("bijective", F.lit(allocate.check_bijection(mapped).first()["bijective"]))


# whole runs through the public operations

#: Tables of a run; customer names are its long texts.
RUN = ("customer", "nation", "orders", "region")
RUNS: dict[tuple[str, str], dict] = {}
KEYS = [("customer-key", ("customer", "c_custkey"), ("orders", "o_custkey"))]


def key_member(at: tuple[str, str], role: str) -> dict:
    return {"table": f"{at[0]}.parquet", "field": at[1], "role": role, "ordinal": 1, "dbf_type": "N", "byte_width": 18}


def engine_run(spark: SparkSession, sf_dir: str, fresh: bool = False) -> dict:
    """Plan, preflight and run over copies of the tables, once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in RUNS and not fresh:
        return RUNS[key]
    root = f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"
    for t in RUN:
        read(spark, sf_dir, t).write.parquet(f"{root}/source/{t}.parquet")
    facts = {f"{t}.parquet": {c: FieldFact(c, "M" if c == "c_name" else "C", w) for c, w in WIDTHS[t].items()} for t in RUN}
    relations = [{"relation_id": n, "numeric_strategy": "REVERSIBLE_BIJECTIVE", "members": [key_member(p, "PRIMARY"), key_member(f, "FOREIGN")]} for n, p, f in KEYS]
    plan = engine.build_plan(spark, f"{root}/source", f"{root}/output", f"{root}/vault", None, {"metadata_schema_version": "1.0", "relations": relations}, facts)
    found = {"root": root, "plan": plan, "preflight": engine.preflight(spark, plan), "receipt": engine.pseudonymize(spark, plan)}
    if not fresh:
        RUNS[key] = found
    return found


COUNTS = " UNION ALL ".join(f"SELECT '{t}.parquet' AS table_path, count(*) AS records FROM {t}" for t in RUN)


@query(f"SELECT table_path, records, 'DECLARED_RELATIONS_VERIFIED' AS assurance, true AS ready FROM ({COUNTS})")
def engine_run_receipt(spark, sf_dir):
    """What a completed run says: records of each table, assurance, and that preflight found nothing against it."""
    run = engine_run(spark, sf_dir)
    rows = [(t, n, run["receipt"]["assurance"]["level"], run["preflight"].ready) for t, n in run["receipt"]["tables"].items()]
    return spark.createDataFrame(rows, "table_path string, records bigint, assurance string, ready boolean")


@query("SELECT 'PASS' AS status, 0::BIGINT AS codes")
def engine_verify_pass(spark, sf_dir):
    found = engine.verify_dataset(spark, engine_run(spark, sf_dir)["plan"])
    return spark.createDataFrame([(found["status"], len(found["codes"]))], "status string, codes bigint")


@query("""SELECT 'IDENTITY_VALUE_MISMATCH' AS code, count(*) AS records FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'DELETED_MARKER_MISMATCH', count(*) FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'OUTPUT_FINGERPRINT_MISMATCH', NULL""")
def engine_verify_codes(spark, sf_dir):
    """An output of which some records were changed: the codes of its verification, with how many records break each rule."""
    run = engine_run(spark, sf_dir, fresh=True)
    path = f"{run['plan'].output}/orders.parquet"
    good = spark.read.parquet(path)
    changed = good.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    changed = materialize(changed.withColumn(DELETED, F.when(F.col("o_orderkey") % 4 == 0, ~F.col(DELETED)).otherwise(F.col(DELETED))), "changed")
    Files(spark).delete(path)
    changed.orderBy(INDEX).write.parquet(path)
    found = engine.verify_dataset(spark, run["plan"])
    counted = {r["code"]: r["records"] for r in found["findings"]}
    return spark.createDataFrame([(c, counted.get(c)) for c in found["codes"]], "code string, records bigint")


@query(f"SELECT table_path, records, 0::BIGINT AS lost, 0::BIGINT AS changed FROM ({COUNTS})")
def engine_recover_roundtrip(spark, sf_dir):
    """Originals from output and vault alone: rows that are missing or differ from what went in."""
    run, back = engine_run(spark, sf_dir), f"{shared_dir(spark)}/back-{uuid.uuid4().hex}"
    engine.recover_output(spark, run["plan"].output, run["plan"].vault, back)
    rows = []
    for t in RUN:
        was = read(spark, sf_dir, t)
        now = spark.read.parquet(f"{back}/{t}.parquet").select(was.columns)
        rows.append((f"{t}.parquet", now.count(), was.exceptAll(now).count(), now.exceptAll(was).count()))
    return spark.createDataFrame(rows, "table_path string, records bigint, lost bigint, changed bigint")


@query(f"SELECT table_path, records, 0::BIGINT AS deleted, 'PASS' AS status FROM ({COUNTS})")
def engine_bundle_manifest(spark, sf_dir):
    """The manifest of a bundle, and whether the bundle agrees with it."""
    run, bundle = engine_run(spark, sf_dir), f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    manifest = engine.create_bundle(spark, run["plan"], bundle)
    status = engine.verify_bundle(spark, bundle)["status"]
    return spark.createDataFrame([(t["path"], t["records"], t["deleted"], status) for t in manifest["tables"]], "table_path string, records bigint, deleted bigint, status string")


@query(" UNION ALL ".join(f"SELECT '{t}.parquet' AS table_path, 'PARQUET' AS type, true AS hashed" for t in RUN))
def source_fingerprint_entries(spark, sf_dir):
    """What the fingerprint of a source is made of, by table."""
    found = artifact_hashes(spark, engine_run(spark, sf_dir)["plan"].source)
    rows = {(table_of_artifact(r["path"]), r["type"], len(r["sha256"]) == 64) for r in found.collect()}
    return spark.createDataFrame(sorted(rows), "table_path string, type string, hashed boolean")
