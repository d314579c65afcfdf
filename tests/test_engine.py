"""The engine: kernels, allocation against brute force, and whole runs with recovery and tampering."""

import datetime
import itertools
import random


import pytest
from pyspark.sql import functions as F

from maskwright.functions import tokens, values
from maskwright.operators import allocate, evidence, ranks, transform
from maskwright.operators.transform import FieldPlan
from maskwright.plans import engine
from maskwright.plans.errors import EngineError
from maskwright.plans.policy import resolve_policy, unique_json
from maskwright.plans.relations import assurance_level, numeric_domains, parse_document, relative_path
from maskwright.plans.schema import MASKED, PSEUDONYMIZE, FieldFact, Table, classify_field
from maskwright.sources.shared import Files, materialize
from maskwright.sources.vault import Vault


def code(f, *args, **kw):
    with pytest.raises(EngineError) as e:
        f(*args, **kw)
    return e.value.code


# kernels


def test_tokens_by_index():
    every = [tokens.token_at(i, 2, "AB") for i in range(tokens.token_space(2, 2))]
    assert every == ["A", "B", "AA", "AB", "BA", "BB"] and [tokens.token_index(t, "AB") for t in every] == list(range(6))
    assert tokens.token_space(3) == 36 + 36**2 + 36**3 and tokens.token_space_at_least(250, 10**30)
    assert not tokens.token_space_at_least(1, 37)


def test_alphabets():
    assert tokens.candidate_alphabet(["cp1250", "cp852"]) == tokens.ALPHABET
    assert tokens.candidate_alphabet(["utf-16"]) == "" and tokens.candidate_alphabet(["no-such-codec"]) == ""
    assert tokens.encoded_byte_length("ż", "cp1250") == 1 and tokens.encoded_byte_length("漢", "cp1250") is None
    assert tokens.max_encoded_byte_length("ż", ["cp1250", "utf-8"]) == 2


def test_native_tokens(spark):
    rows = spark.range(0, 36**3, 997).select("id", tokens.token_of(F.col("id"), 3).alias("t"), tokens.offset_of(tokens.token_of(F.col("id"), 3), 3).alias("b")).collect()
    assert all(r["t"] == tokens.token_at(r["id"] + 36 + 36**2, 3) and r["b"] == r["id"] for r in rows)


def test_member_ranges_and_canonical_text():
    assert values.member_range("N", 5) == (-9999, 99999) and values.member_range("I", 4) == (-(2**31) + 1, 2**31 - 2)
    assert values.intersect([(1, 5), (3, 9)]) == (3, 5) and values.intersect([(1, 2), (3, 4)]) is None
    assert values.parse_canonical_integer("-12") == -12
    for bad in ("+5", "007", "-0", "", " 1"):
        with pytest.raises(ValueError):
            values.parse_canonical_integer(bad)
    with pytest.raises(ValueError):
        values.canonical_integer(True)


def test_shift_keeps_time_and_range(spark):
    rows = spark.createDataFrame([(datetime.date(9999, 12, 30), datetime.datetime(2028, 2, 29, 23, 59, 58)), (None, None)], "d date, t timestamp_ntz")
    got = rows.select(values.shift(F.col("d"), "date", 1), values.shift(F.col("t"), "timestamp_ntz", 366)).collect()
    assert tuple(got[0]) == (datetime.date(9999, 12, 31), datetime.datetime(2029, 3, 1, 23, 59, 58)) and tuple(got[1]) == (None, None)
    with pytest.raises(Exception, match="TEMPORAL_RANGE"):
        rows.select(values.shift(F.col("d"), "date", 2)).collect()


def test_masks_keep_type(spark):
    rows = spark.createDataFrame([("x", b"x"), ("[MASKED-MEMO]", b"[MASKED-MEMO]"), ("", b""), (None, None)], "t string, b binary")
    got = rows.select(values.mask(F.col("t")), values.mask(F.col("b"), "binary")).collect()
    assert [r[0] for r in got] == ["[MASKED-MEMO]", "[MASKED-MEMO-ALT]", "[MASKED-MEMO]", None]
    assert [r[1] if r[1] is None else bytes(r[1]) for r in got] == [b"[MASKED-MEMO]", b"[MASKED-MEMO-ALT]", b"[MASKED-MEMO]", None]


def test_offsets():
    assert allocate.choose_offset(None, None) is None and allocate.choose_offset(5, 10, 7) == 7
    drawn = {allocate.choose_offset(2, values.LAST_DAY - 1) for _ in range(50)}
    assert drawn == {-1, 1}
    assert code(allocate.choose_offset, 1, values.LAST_DAY) == "MAPPING_CAPACITY_EXHAUSTED"
    assert code(allocate.choose_offset, 5, 10, -5) == "MAPPING_CONSTRAINT_INFEASIBLE"


def test_policies_and_fields():
    policy = resolve_policy({"temporal": {"date": "KEEP"}})
    kinds = [("C", {}), ("M", {}), ("G", {"binary": True}), ("D", {}), ("T", {}), ("N", {}), ("W", {}), ("C", {"binary": True}), ("M", {"nocptrans": True})]
    got = [classify_field(FieldFact("x", k, 10, **kw), policy) for k, kw in kinds]
    assert got == ["PSEUDONYMIZE_REVERSIBLE", "MASK_REVERSIBLE", "MASK_REVERSIBLE", "KEEP", "SHIFT_REVERSIBLE", "KEEP", "UNSAFE", "UNSAFE", "UNSAFE"]
    assert classify_field(FieldFact("_NULLFLAGS", "0", 1, system=True), policy) == "SYSTEM"
    assert code(resolve_policy, {"nothing": 1}) == "POLICY_INVALID" and code(resolve_policy, {"text": {"default_action": "ERASE"}}) == "POLICY_UNSUPPORTED"
    with pytest.raises(ValueError):
        unique_json('{"a": 1, "a": 2}')


def relation(rid="r", parent=("p.parquet", "ID"), child=("c.parquet", "PID"), kind="I", width=4, strategy="REVERSIBLE_BIJECTIVE", **extra):
    member = lambda at, role: {"table": at[0], "field": at[1], "role": role, "ordinal": 1, "dbf_type": kind, "byte_width": width}
    return {"relation_id": rid, "numeric_strategy": strategy, "members": [member(parent, "PRIMARY"), member(child, "FOREIGN")], **extra}


def document(*relations):
    return {"metadata_schema_version": "1.0", "relations": list(relations)}


def test_relation_documents():
    assert relative_path("a\\b/c") == "a/b/c"
    for bad in ("/a", "a/../b", "C:/x", "", None):
        assert code(relative_path, bad) == "RELATIONSHIP_INVALID"
    good = parse_document(document(relation()))
    assert list(numeric_domains(good)) == [("p.parquet", "ID"), ("c.parquet", "PID")]
    assert code(parse_document, document(relation(), relation())) == "RELATIONSHIP_INVALID"
    lone = relation()
    lone["members"] = lone["members"][:1]
    assert code(parse_document, document(lone)) == "RELATIONSHIP_INVALID"
    assert code(numeric_domains, parse_document(document(relation("a"), relation("b", child=("d.parquet", "PID"))))) == "MAPPING_CONFLICT"
    outside = parse_document(document(relation(authority="CONTRACT_AUTHORITATIVE", assurance="VERIFIED")))
    assert [assurance_level([], 0, 0)["level"], assurance_level(good, 1, 0)["level"], assurance_level(good, 0, 1)["level"], assurance_level(outside, 1, 0)["level"]] == [
        "GLOBAL_EXACT_VALUE", "DECLARED_RELATIONS_VERIFIED", "INCOMPLETE", "VFP_METADATA_VERIFIED",
    ]


# evidence


def test_evidence_counts_nulls_orphans_and_order(spark):
    parent = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, "")], "x int, y string")
    foreign = spark.createDataFrame([(1, "a"), (1, "a"), (2, ""), (9, "z"), (None, "a")], "x bigint, y string")
    make = lambda side, p, f: [evidence.KeySource(side, "r", role, df, ("x", "y"), (True, False)) for role, df in ((evidence.PARENT, p), (evidence.FOREIGN, f))]
    keys = evidence.relation_keys(make("SOURCE", parent, foreign) + make("OUTPUT", parent, foreign.filter("x != 9 or x is null")), spark)
    rows = {r["side"]: r for r in evidence.relation_metrics(evidence.relation_histogram(keys)).collect()}
    s = rows["SOURCE"]
    assert (s["parent_rows"], s["parent_nulls"], s["parent_unique"], s["foreign_nulls"], s["matched"], s["orphans"], s["foreign_max"]) == (4, 1, 3, 1, 3, 1, 2)
    compared = evidence.compare_sides(evidence.relation_metrics(evidence.relation_histogram(keys))).first()
    assert compared["status"] == "FAILED" and not compared["ORPHAN_COUNT_PRESERVED"] and compared["MATCHED_ROWS_PRESERVED"]
    half = evidence.compare_sides(evidence.relation_metrics(evidence.relation_histogram(keys.filter("side = 'SOURCE'")))).first()
    assert half["status"] == "INCOMPLETE"
    assert evidence.profile_digest({2: 1, 1: 2}) == __import__("hashlib").sha256(b"RELATION-PROFILE/v12,1,1,").hexdigest()


# allocation


def brute(originals, occupied, alphabet):
    """Whether an assignment exists, by augmenting paths."""
    universe = [t for k in range(1, 4) for t in map("".join, itertools.product(alphabet, repeat=k)) if t not in occupied]
    owner: dict = {}

    def place(i, seen):
        value, width = originals[i]
        for t in universe:
            if len(t) <= width and t != value and t not in seen:
                seen.add(t)
                if t not in owner or place(owner[t], seen):
                    owner[t] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(originals)))


def test_feasibility_is_exact():
    random.seed(12)
    verdicts = set()
    for _ in range(3000):
        alphabet = "ABC"[: random.randint(1, 3)]
        universe = [t for k in range(1, 4) for t in map("".join, itertools.product(alphabet, repeat=k))]
        occupied = set(random.sample(universe, random.randint(0, len(universe) // 2)))
        pool = [t for t in universe] + ["zz", "z1"]
        chosen = random.sample(pool, random.randint(1, min(7, len(pool))))
        originals = [(v, random.randint(1, 3)) for v in chosen]
        count = lambda xs: {k: xs.count(k) for k in set(xs)}
        safe = [v for v, _ in originals if set(v) <= set(alphabet) and v not in occupied]
        facts = allocate.WidthFacts(count([w for _, w in originals]), count([len(t) for t in occupied]), count([len(v) for v in safe]), len(alphabet))
        own = [(len(v), w) for v, w in originals if v in safe and len(v) <= w]
        want = brute(originals, occupied, alphabet)
        verdicts.add(want)
        assert facts.feasible(own) == want
        if want:
            found = allocate.tight_assignment(originals, occupied, alphabet)
            assert len(set(found.values())) == len(originals) and all(found[v] != v and len(found[v]) <= w and found[v] not in occupied for v, w in originals)
    assert verdicts == {True, False}


PAIRS = "value string, token string"


def test_text_allocation(spark):
    observed = spark.createDataFrame([(f"Customer {i}", 25) for i in range(1500)] + [("A", 1), ("Q7", 2), ("ż", 1)], "value string, min_width int")
    mapped = spark.createDataFrame([("Customer 3", "ZZ")], PAIRS)
    found = {r["value"]: r["token"] for r in allocate.allocate_text(observed, mapped).collect()}
    assert len(found) == len(set(found.values())) == 1503 and found["Customer 3"] == "ZZ" and all(v != t for v, t in found.items())
    assert len(found["A"]) == len(found["ż"]) == 1 and not {"A", "Q7"} & set(found.values())
    lengths = sorted(len(t) for t in found.values())
    assert lengths.count(1) == 35 and lengths.count(2) == 36**2 - 1
    swap = allocate.allocate_text(spark.createDataFrame([("A", 1), ("B", 1)], "value string, min_width int"), spark.createDataFrame([], PAIRS), "AB").collect()
    assert {tuple(r) for r in swap} == {("A", "B"), ("B", "A")}
    assert code(allocate.allocate_text, spark.createDataFrame([("A", 1)], "value string, min_width int"), spark.createDataFrame([], PAIRS), "A") == "MAPPING_CONSTRAINT_INFEASIBLE"
    assert code(allocate.allocate_text, spark.createDataFrame([("A", 1)], "value string, min_width int"), spark.createDataFrame([("A", "BB")], PAIRS)) == "MAPPING_CONSTRAINT_INFEASIBLE"
    assert allocate.allocate_text(observed.filter("false"), mapped).count() == 0


def numbers(spark, originals, low, high, mapped=()):
    rows = spark.createDataFrame([(str(v),) for v in originals], "value string")
    pairs = spark.createDataFrame([(str(a), str(b)) for a, b in mapped], PAIRS)
    return {int(r["value"]): int(r["token"]) for r in allocate.allocate_numeric(rows, pairs, low, high).collect()}


def test_numeric_allocation(spark):
    assert numbers(spark, [1, 2], 1, 2) == {1: 2, 2: 1}
    three = numbers(spark, [1, 2, 3], 1, 3)
    assert sorted(three.values()) == [1, 2, 3] and all(a != b for a, b in three.items())
    assert numbers(spark, [5, 6], 1, 9, [(5, 7)])[5] == 7
    many = numbers(spark, range(300), -(10**8), 10**9)
    assert len(set(many.values())) == 300 and not set(many.values()) & set(range(300))
    with pytest.raises(EngineError):
        numbers(spark, [1], 1, 1)
    with pytest.raises(EngineError):
        numbers(spark, [11], 1, 9)


def test_jth_free_and_dense_index(spark):
    blocked = sorted(random.Random(3).sample(range(10, 60), 25))
    free = [x for x in range(10, 200) if x not in blocked]
    got = ranks.jth_free(spark.range(60).select(F.col("id").alias("j")), spark.createDataFrame([(b,) for b in blocked], "value long"), 10).collect()
    assert {r["j"]: r["value"] for r in got} == dict(enumerate(free[:60]))
    placed = ranks.dense_index(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5), "v").collect()
    assert all(r["v"] == r["k"] for r in placed)


# whole runs


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('run')}"
    people = [
        (i, f"SYNTH-{i % 3}" if i % 4 else None, "" if i % 5 == 0 else "V  ", None if i % 6 == 0 else "[MASKED-MEMO]" if i % 2 else "memo", datetime.date(2020, 1, 1 + i), datetime.datetime(2021, 2, 3, 4, 5, 6), 1.5 * i)
        for i in range(12)
    ]
    spark.createDataFrame(people, "ID int, NAME string, VARVAL string, NOTE string, D date, T timestamp_ntz, AMT double").coalesce(1).write.parquet(f"{root}/src/north/people.parquet")
    spark.createDataFrame([(i % 9 + 40 * (i == 5) if i % 7 else None, i) for i in range(40)], "PERSON_ID int, AMT int").repartition(2).write.parquet(f"{root}/src/orders.parquet")
    facts = {"north/people.parquet": {"NAME": FieldFact("NAME", "C", 16), "VARVAL": FieldFact("VARVAL", "V", 16), "NOTE": FieldFact("NOTE", "M", 10)}}
    relations = document(relation("orders-people", ("north/people.parquet", "ID"), ("orders.parquet", "PERSON_ID")))
    plan = engine.build_plan(spark, f"{root}/src", f"{root}/out", f"{root}/vault", None, relations, facts)
    events = []
    receipt = engine.pseudonymize(spark, plan, progress=events.append)
    return {"root": root, "plan": plan, "receipt": receipt, "events": events}


def test_a_run_is_complete_and_repeatable(spark, run):
    assert run["receipt"]["assurance"]["level"] == "DECLARED_RELATIONS_VERIFIED"
    assert {e.phase for e in run["events"]} >= {"PASS1_SCAN", "PASS1_FINALIZE", "PASS2_WRITE", "PUBLICATION", "OPERATION"}
    assert engine.pseudonymize(spark, run["plan"]) == run["receipt"]
    out = spark.read.parquet(f"{run['root']}/out/north/people.parquet")
    assert out.filter("NAME like 'SYNTH%' or NOTE = 'memo'").count() == 0 and out.filter("VARVAL = ''").count() == 3 and out.filter("NAME is null").count() == 3
    assert engine.verify_dataset(spark, run["plan"]) == {"status": "PASS", "codes": [], "findings": []}
    assert engine.reconcile(spark, run["plan"]) == "NOTHING_TO_DO"


def test_recovery_needs_only_output_and_vault(spark, run):
    done = engine.recover(spark, run["plan"], f"{run['root']}/back")
    assert done["canonical_verified"]
    for name in ("north/people.parquet", "orders.parquet"):
        was = spark.read.parquet(f"{run['root']}/src/{name}")
        now = spark.read.parquet(f"{run['root']}/back/{name}").select(was.columns)
        assert was.exceptAll(now).isEmpty() and now.exceptAll(was).isEmpty()
    assert code(engine.recover, spark, run["plan"], f"{run['root']}/back2", enabled=False) == "RECOVERY_NOT_PERMITTED"
    assert code(engine.recover, spark, run["plan"], f"{run['root']}/back") == "DESTINATION_CONFLICT"


def test_bundles(spark, run):
    manifest = engine.create_bundle(spark, run["plan"], f"{run['root']}/bundle")
    assert {t["path"]: t["records"] for t in manifest["tables"]} == {"north/people.parquet": 12, "orders.parquet": 40}
    assert engine.verify_bundle(spark, f"{run['root']}/bundle") == {"status": "PASS", "codes": []}
    Files(spark).write(f"{run['root']}/bundle/data/extra.parquet", b"x")
    assert engine.verify_bundle(spark, f"{run['root']}/bundle")["codes"] == ["UNEXPECTED_OUTPUT_ARTIFACT"]


def test_refusals(spark, run):
    plan = run["plan"]
    assert code(engine.build_plan, spark, plan.source, plan.source + "/x", plan.vault) == "PATH_OVERLAP"
    assert code(engine.build_plan, spark, plan.source + "-none", plan.output, plan.vault) == "PATH_NOT_FOUND"
    with Vault.open(spark, plan.vault).lease() as vault:
        assert code(vault.lease().__enter__) == "VAULT_WRITER_CONFLICT"
    stop = engine.build_plan(spark, plan.source, plan.output + "2", plan.vault + "2", None, None, plan.facts)
    assert code(engine.pseudonymize, spark, stop, cancel=lambda: True) == "OPERATION_CANCELLED"
    assert not Files(spark).exists(plan.output + "2")


def test_tampering_is_found(spark, run):
    plan = run["plan"]
    path = f"{run['root']}/out/orders.parquet"
    rows = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    Files(spark).rename(path, f"{run['root']}/orders-good.parquet")
    rows.filter("_physical_index < 39").withColumn("AMT", F.col("AMT") + 1).coalesce(1).write.parquet(path)
    try:
        found = engine.verify_dataset(spark, plan)
    finally:
        Files(spark).delete(path)
        Files(spark).rename(f"{run['root']}/orders-good.parquet", path)
    assert found["status"] == "FAIL" and set(found["codes"]) >= {"OUTPUT_FINGERPRINT_MISMATCH", "RECORD_COUNT_MISMATCH", "IDENTITY_VALUE_MISMATCH", "ASSURANCE_EVIDENCE_MISMATCH"}


def test_recovery_in_a_new_process_without_source_or_plan(spark, run):
    from maskwright import cli

    Files(spark).rename(f"{run['root']}/src", f"{run['root']}/src-away")
    try:
        assert cli.main(["recover", f"{run['root']}/out", f"{run['root']}/vault", f"{run['root']}/again", "--json"], spark) == 0
        was = spark.read.parquet(f"{run['root']}/src-away/orders.parquet")
        assert was.exceptAll(spark.read.parquet(f"{run['root']}/again/orders.parquet").select(was.columns)).isEmpty()
        assert code(engine.recover_output, spark, f"{run['root']}/elsewhere", f"{run['root']}/vault", f"{run['root']}/x") == "RECOVERY_FAILED"
    finally:
        Files(spark).rename(f"{run['root']}/src-away", f"{run['root']}/src")


def test_a_crash_before_the_receipt_is_settled_by_the_next_run(spark, run):
    plan = run["plan"]
    vault = Vault.open(spark, plan.vault)
    done = vault.state["operations"][plan.operation_id]
    vault.commit(
        operations={**vault.state["operations"], plan.operation_id: {k: v for k, v in done.items() if k not in ("receipt", "completed_at")} | {"state": "STARTED"}},
        publication=[p for p in vault.state["publication"] if p["phase"] == "READY_TO_PROMOTE"],
    )
    assert engine.pseudonymize(spark, plan) == run["receipt"]


def test_a_stale_lease_is_taken_over(spark, run):
    vault = Vault.open(spark, run["plan"].vault)
    Files(spark).write(f"{vault.root}/lease.json", b'{"owner": "gone", "since": "2020-01-01T00:00:00+00:00"}')
    with vault.lease():
        assert code(vault.lease().__enter__) == "VAULT_WRITER_CONFLICT"
    assert not Files(spark).exists(f"{vault.root}/lease.json")


def test_tight_domains_keep_their_alphabet_at_any_size(spark, monkeypatch):
    random.seed(5)
    rows = [(a + b, 2) for a in "ABC" for b in "ABC"] + [(c, 1) for c in "ABC"] + [(f"name {k}", 9) for k in range(30)]
    observed = spark.createDataFrame(rows, "value string, min_width int")
    for bound in (200_000, 0):
        monkeypatch.setattr(allocate, "TIGHT", bound)
        found = {r["value"]: r["token"] for r in allocate.allocate_text(observed, spark.createDataFrame([], PAIRS), "ABC").collect()}
        assert len(found) == len(set(found.values())) == len(rows)
        assert all(set(t) <= set("ABC") and t != v and len(t) <= dict(rows)[v] for v, t in found.items())


def test_tight_domains_that_all_met_themselves(spark, monkeypatch):
    def in_order(count, length, blocked, alphabet, spark):
        used = {r["token"] for r in blocked.select("token").collect()}
        made = [t for t in map("".join, itertools.product(alphabet, repeat=length)) if t not in used]
        return spark.createDataFrame(list(enumerate(made[:count])), "j long, token string")

    monkeypatch.setattr(allocate, "TIGHT", 0)
    monkeypatch.setattr(allocate, "fresh_tokens", in_order)
    # an odd number of them, whose last one meets only pairs that were changed; and a lone one, which only a free token helps
    for rows in ([("A", 1), ("B", 1), ("C", 1)], [("A", 1), ("B", 9), ("C", 9)]):
        observed = spark.createDataFrame(rows, "value string, min_width int")
        found = {r["value"]: r["token"] for r in allocate.allocate_text(observed, spark.createDataFrame([], PAIRS), "ABC").collect()}
        assert len(found) == len(set(found.values())) == 3 and all(t != v and len(t) <= dict(rows)[v] for v, t in found.items())


def test_large_mappings_and_memos_are_not_broadcast(spark):
    facts = (FieldFact("name", "C", 9), FieldFact("note", "M", 9))
    table = Table("t", spark.createDataFrame([("a", "x", 0), ("b", None, 1)], "name string, note string, _physical_index long"), facts)
    plans = [FieldPlan("t", facts[0], PSEUDONYMIZE, "text"), FieldPlan("t", facts[1], MASKED)]
    text = materialize(spark.createDataFrame([("a", "p"), ("b", "q")], "original_value string, pseudonym_value string"), "text")
    memos = materialize(transform.memo_rows(table, "t", plans, {"note": "f"}), "memos")
    out = transform.rewrite(table, plans, text, text, None, small=False)
    back = transform.with_memos(table, transform.rewrite(table.with_df(out), plans, text, text, None, small=False, back=True), "t", plans, {"note": "f"}, memos)
    for df in (out, back):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, back.collect())) == [("a", "x", 0), ("b", None, 1)]


def test_many_fixed_points_are_passed_on(spark):
    pairs = spark.createDataFrame([(str(k), str(k)) for k in range(1500)] + [("9999", "5000")], PAIRS)
    found = {r["value"]: r["token"] for r in allocate.without_fixed_points(pairs, spark.createDataFrame([], "token string"), 0, 9999).collect()}
    assert len(found) == len(set(found.values())) == 1501 and all(v != t for v, t in found.items())
    lone = allocate.without_fixed_points(spark.createDataFrame([("3", "3")], PAIRS), spark.createDataFrame([("1",)], "token string"), 1, 3).collect()
    assert [tuple(r) for r in lone] == [("3", "2")]


def test_fractions_are_no_keys(spark):
    rows = spark.createDataFrame([(1.5,), (2.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(values.member_verdict(F.col("v"), "N", 5)).collect()] == ["OUT_OF_MEMBER_RANGE", "REVERSIBLE", None]
    with pytest.raises(Exception, match="NUMERIC_KEY_NOT_INTEGRAL"):
        rows.select(values.canonical_text(F.col("v"))).collect()


def test_a_folder_of_dbf_tables_goes_through_the_engine(spark, tmp_path):
    from maskwright.sources.dbf import write_dbf

    root = f"{tmp_path}/dbf"
    facts = (FieldFact("ID", "I", 4, 0, "none", False), FieldFact("NAME", "C", 12, 0, "cp1252"), FieldFact("NOTE", "M", 4, 0, "cp1252"))
    rows = [(i, f"name {i % 4}", f"note {i}" if i % 3 else None, i, i % 5 == 0) for i in range(30)]
    write_dbf(spark.createDataFrame(rows, "ID int, NAME string, NOTE string, _physical_index long, _deleted boolean"), facts, f"{root}/in/sub/people.dbf")
    plan = engine.build_plan(spark, f"{root}/in", f"{root}/out", f"{root}/vault")
    assert list(plan.facts) == ["sub/people.dbf"] and {f.fact.name: f.action for f in plan.fields} == {"ID": "KEEP", "NAME": "PSEUDONYMIZE_REVERSIBLE", "NOTE": "MASK_REVERSIBLE"}
    engine.pseudonymize(spark, plan)
    assert engine.verify_dataset(spark, plan)["status"] == "PASS"
    engine.recover_output(spark, f"{root}/out", f"{root}/vault", f"{root}/back")
    back = spark.read.format("dbf").load(f"{root}/back/sub/people.dbf").orderBy("_physical_index").collect()
    assert [tuple(r) for r in back] == rows
    out = spark.read.format("dbf").load(f"{root}/out/sub/people.dbf").collect()
    assert not {r["NAME"] for r in out} & {r[1] for r in rows} and {r["NOTE"] for r in out} == {None, "[MASKED-MEMO]"} and sum(r["_deleted"] for r in out) == 6
