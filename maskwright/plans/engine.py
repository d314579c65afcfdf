"""The public operations: build_plan, preflight, pseudonymize, verify_dataset, recover, and bundles.

A run reads the source twice. Pass 1 aggregates what mappings depend on and commits the mappings to the vault;
pass 2 rewrites every table through them into a staging folder, proves the relations on both sides, and publishes by
one rename. Until that rename nothing of a failed run is visible; the vault says what was completed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.tokens import candidate_alphabet
from ..operators import allocate, capacity, evidence, observe, transform, verify
from ..operators.transform import FieldPlan
from ..sources.dataset import inventory, output_fingerprint, read_dataset, schema_fingerprint, source_fingerprint, write_table
from ..sources.shared import Files
from ..sources.vault import TABLES, Vault, now
from .errors import EngineError
from .policy import canonical_json, digest, policy_fingerprint, resolve_policy, unique_json
from .progress import PHASES, Event, Progress
from .relations import TEMPORAL_DOMAIN, TEXT_DOMAIN, Relation, assurance_level, document_fingerprint, effective, numeric_domains, parse_document
from .schema import PSEUDONYMIZE, SHIFT, SYSTEM, UNSAFE, Dataset, FieldFact, classify_field

Callback = Callable[[Event], None] | None
Cancel = Callable[[], bool] | None


@dataclass(frozen=True)
class Plan:
    source: str
    output: str
    vault: str
    policy: dict
    relations: tuple[Relation, ...]
    fields: tuple[FieldPlan, ...]
    unsafe: tuple[tuple[str, str], ...]
    facts: dict[str, dict[str, FieldFact]]
    source_fingerprint: str
    numeric: dict[tuple[str, str], tuple[str, tuple[int, int]]] = field(default_factory=dict)
    identity_review: tuple[tuple[str, str], ...] = ()

    @property
    def dataset_id(self) -> str:
        return digest("ds-", self.source_fingerprint, 32)

    @property
    def destination(self) -> str:
        return digest("dst-", self.output, 32)

    @property
    def binding(self) -> str:
        return digest("opb-", [self.source_fingerprint, policy_fingerprint(self.policy), document_fingerprint(list(self.relations)), self.destination], 32)

    @property
    def operation_id(self) -> str:
        return digest("vop-", [self.dataset_id, self.binding], 32)

    def of(self, table: str) -> list[FieldPlan]:
        return [f for f in self.fields if f.table == table]

    def to_dict(self) -> dict:
        return {
            "dataset_id": self.dataset_id, "operation_id": self.operation_id, "source_fingerprint": self.source_fingerprint,
            "policy_fingerprint": policy_fingerprint(self.policy), "relationship_fingerprint": document_fingerprint(list(self.relations)),
            "fields": [[f.table, f.fact.name, f.action] for f in self.fields], "unsafe": [list(u) for u in self.unsafe],
            "identity_review": [list(x) for x in self.identity_review],
        }


@dataclass(frozen=True)
class Completed:
    """What a vault says of a completed operation: all that recovery needs, without the source."""

    output: str
    vault: str
    operation_id: str
    dataset_id: str
    destination: str
    facts: dict[str, dict[str, FieldFact]]
    fields: tuple[FieldPlan, ...]

    def of(self, table: str) -> list[FieldPlan]:
        return [f for f in self.fields if f.table == table]


def completed(spark: SparkSession, output: str, vault: str) -> Completed:
    """The operation that made output, from output and vault alone."""
    store, at = Vault.open(spark, vault), digest("dst-", output, 32)
    found = [(k, v) for k, v in store.state["operations"].items() if v["state"] == "COMPLETED" and v["destination"] == at]
    if not found:
        raise EngineError("RECOVERY_FAILED", "NO_COMPLETED_OPERATION")
    operation, entry = found[-1]
    rows = store.read("fields").join(store.read("tables"), "table_id").select("relative_path", "name", "transform_action", "mapping_domain_id").collect()
    dataset = read_dataset(spark, output, None, sorted({r["relative_path"] for r in store.read("tables").select("relative_path").collect()}))
    facts = {t.path: t.fields for t in dataset}
    order = {(t, n): k for t in facts for k, n in enumerate(facts[t])}
    if any((r["relative_path"], r["name"]) not in order for r in rows):
        raise EngineError("RECOVERY_FAILED", "OUTPUT_SCHEMA_MISMATCH")
    rows = sorted(rows, key=lambda r: (r["relative_path"], order[r["relative_path"], r["name"]]))
    fields = tuple(FieldPlan(r["relative_path"], facts[r["relative_path"]][r["name"]], r["transform_action"], r["mapping_domain_id"]) for r in rows)
    return Completed(output, vault, operation, entry["receipt"]["dataset_id"], at, facts, fields)


def apart(*paths: str) -> None:
    clean = [p.rstrip("/") + "/" for p in paths]
    for i, a in enumerate(clean):
        if any(a.startswith(b) or b.startswith(a) for b in clean[i + 1 :]):
            raise EngineError("PATH_OVERLAP")


def build_plan(
    spark: SparkSession, source: str, output: str, vault: str, policy: dict | None = None, relationships: str | dict | None = None,
    facts: dict[str, dict[str, FieldFact]] | None = None, *, progress: Callback = None, cancel: Cancel = None,
) -> Plan:
    """An immutable plan. Reads headers and hashes artifacts; no record is evaluated."""
    watch = Progress("plan", progress, cancel)
    apart(source, output, vault)
    policy = resolve_policy(policy)
    relations = tuple(parse_document(relationships))
    numeric = numeric_domains(list(relations))
    with watch.phase("DISCOVERY"):
        dataset = read_dataset(spark, source, facts)
    if not dataset.tables:
        raise EngineError("PATH_NOT_FOUND", "NO_TABLES")
    fields, unsafe = [], []
    for table in dataset:
        for fact in table.facts:
            action = classify_field(fact, policy)
            if action == SYSTEM:
                continue
            domain = None
            if action == UNSAFE:
                unsafe.append((table.path, fact.name))
                continue
            if (table.path, fact.name) in numeric:
                action, domain = PSEUDONYMIZE, numeric[table.path, fact.name][0]
            elif action == PSEUDONYMIZE:
                domain = TEXT_DOMAIN
            elif action == SHIFT:
                domain = TEMPORAL_DOMAIN
            fields.append(FieldPlan(table.path, fact, action, domain))
    for relation in relations:
        for m in relation.members:
            found = dataset.tables.get(m.table)
            if found is None or m.field not in found.fields:
                raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_MEMBER_UNKNOWN")
            fact = found.fields[m.field]
            if fact.dbf_type != m.dbf_type or fact.width != m.byte_width:
                raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_MEMBER_SCHEMA")
    keys = {(m.table, m.field) for r in relations for m in r.members if m.dbf_type in "IN"}
    review = tuple(sorted(k for k in keys if k not in numeric))[:1024]
    with watch.phase("FINGERPRINT"):
        mark = source_fingerprint(spark, source)
    known = {t.path: t.fields for t in dataset}
    return Plan(source, output, vault, policy, relations, tuple(fields), tuple(unsafe), known, mark, numeric, review)


def load(spark: SparkSession, plan: Plan) -> Dataset:
    return read_dataset(spark, plan.source, plan.facts, sorted(plan.facts))


def acts(plan: Plan, *actions: str):
    chosen = {(f.table, f.fact.name) for f in plan.fields if f.action in actions}
    return lambda table, fact: (table.path, fact.name) in chosen


@dataclass(frozen=True)
class Preflight:
    errors: tuple[str, ...]
    warnings: tuple[str, ...]
    checks: tuple[str, ...]

    @property
    def ready(self) -> bool:
        return not self.errors


def preflight(spark: SparkSession, plan: Plan, *, progress: Callback = None, cancel: Cancel = None) -> Preflight:
    """Everything that can refuse a run before it starts, in a fixed order; read-only."""
    watch, errors, warnings = Progress("preflight", progress, cancel), [], []
    try:
        apart(plan.source, plan.output, plan.vault)
    except EngineError:
        errors.append("PATH_OVERLAP")
    if plan.unsafe:
        errors.append("UNSAFE_FIELD")
    if plan.policy["indexes"]["profile"] != "DATA_ONLY":
        errors.append("OUTPUT_PROFILE_UNSUPPORTED")
    files = Files(spark)
    vault = Vault(spark, plan.vault)
    done = vault.state["operations"].get(plan.operation_id, {}).get("state") == "COMPLETED"
    if files.exists(plan.output) and not done:
        errors.append("DESTINATION_CONFLICT")
    bound = vault.state["dataset"]
    if bound and bound["source_fingerprint"] != plan.source_fingerprint:
        errors.append("VAULT_REUSE_INCOMPATIBLE")
    with watch.phase("SOURCE_VERIFICATION"):
        try:
            if source_fingerprint(spark, plan.source) != plan.source_fingerprint:
                errors.append("SOURCE_FINGERPRINT_MISMATCH")
        except EngineError:
            errors.append("SOURCE_UNAVAILABLE")
    if not {"SOURCE_UNAVAILABLE", "SOURCE_FINGERPRINT_MISMATCH"} & set(errors) and not done:
        dataset = load(spark, plan)
        with watch.phase("CAPACITY_SCAN"):
            result = capacity.text_capacity(dataset, spark, acts(plan, PSEUDONYMIZE), text_pairs(vault))
            if result == "INSUFFICIENT":
                errors.append("PSEUDONYM_CAPACITY_INSUFFICIENT")
            for code in capacity.numeric_capacity(dataset, spark, plan.numeric, {d: pairs(vault, d) for d in {x[0] for x in plan.numeric.values()}}):
                errors.append(code)
        needed = capacity.storage_estimate([n for _, n in inventory(spark, plan.source)], vault=True)
        free = files.free(plan.output)
        if free is not None and free < needed:
            errors.append("STORAGE_SPACE_INSUFFICIENT")
        elif free is None:
            warnings.append("STORAGE_ESTIMATE_UNAVAILABLE")
    if plan.identity_review:
        warnings.append("IDENTITY_REVIEW_RECOMMENDED")
    checks = ["PREFLIGHT_EVALUATED"] + (["DATA_ONLY_STANDALONE"] if plan.policy["indexes"]["profile"] == "DATA_ONLY" else [])
    return Preflight(tuple(dict.fromkeys(errors)), tuple(warnings), tuple(checks))


def text_pairs(vault: Vault) -> DataFrame:
    return vault.read("text_mappings").select(F.col("original_value").alias("value"), F.col("pseudonym_value").alias("token"))


def pairs(vault: Vault, domain: str) -> DataFrame:
    own = vault.read("numeric_key_mappings").filter(F.col("domain_id") == domain)
    return own.select(F.col("original_value").alias("value"), F.col("pseudonym_value").alias("token"))


def ids_of(plan: Plan | Completed) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    tables = {t: digest("tbl-", [plan.dataset_id, t], 32) for t in plan.facts}
    return tables, {t: {n: digest("fld-", [tables[t], n], 32) for n in plan.facts[t]} for t in plan.facts}


def pass_one(spark: SparkSession, plan: Plan, dataset: Dataset, vault: Vault, watch: Progress) -> None:
    """Observations of all tables -> mappings, offset, stored long fields and the ledger, committed together."""
    tables, fields = ids_of(plan)
    with watch.phase("PASS1_SCAN"):
        texts = observe.text_observations(dataset, spark, acts(plan, PSEUDONYMIZE))
        numbers = observe.numeric_observations(dataset, {k: d for k, (d, _) in plan.numeric.items()}, spark)
        least, most = observe.temporal_extremes(dataset, spark, acts(plan, SHIFT)).first()
        memos = [m for t in dataset if (m := transform.memo_rows(t, tables[t.path], plan.of(t.path), fields[t.path])) is not None]
    with watch.phase("PASS1_FINALIZE"):
        encodings = observe.observed_encodings(dataset, acts(plan, PSEUDONYMIZE))
        mapped = allocate.allocate_text(texts, text_pairs(vault), candidate_alphabet(sorted(encodings)) if encodings else "")
        old = text_pairs(vault).join(mapped.select("value"), "value", "left_anti")
        text = mapped.unionByName(old).select(
            F.lit(TEXT_DOMAIN).alias("domain_id"), F.col("value").alias("original_value"), F.col("token").alias("pseudonym_value"), F.octet_length("token").alias("logical_byte_length")
        )
        parts = [vault.read("numeric_key_mappings")]
        for domain, (low, high) in sorted(set(plan.numeric.values())):
            own = numbers.filter(F.col("domain_id") == domain).select("value")
            made = allocate.allocate_numeric(own, pairs(vault, domain), low, high).join(pairs(vault, domain).select("value"), "value", "left_anti")
            parts.append(made.select(F.lit(domain).alias("domain_id"), F.col("value").alias("original_value"), F.col("token").alias("pseudonym_value")))
        persisted = vault.read("temporal_parameters").filter(F.col("domain_id") == TEMPORAL_DOMAIN).first()
        offset = allocate.choose_offset(least, most, persisted["offset_days"] if persisted else None)
        domains = [(TEXT_DOMAIN, "TEXT", "NONE", None), (TEMPORAL_DOMAIN, "TEMPORAL", None, None)]
        domains += [(d, "NUMERIC_KEY", "CANONICAL_INTEGER", "KEY") for d in sorted({d for d, _ in plan.numeric.values()})]
        ledger = [
            (fields[f.table][f.fact.name], tables[f.table], f.fact.name, f.fact.dbf_type, f.fact.encoding, f.fact.width, f.action, f.domain) for f in plan.fields
        ]
        make = lambda rows, name: spark.createDataFrame(rows, TABLES[name])
        new = {
            "mapping_domains": make(domains, "mapping_domains"),
            "tables": make([(tables[t.path], t.path, schema_fingerprint(t.facts), plan.source_fingerprint) for t in dataset], "tables"),
            "fields": make(ledger, "fields"),
            "text_mappings": text,
            "numeric_key_mappings": reduce(DataFrame.unionByName, parts),
            "temporal_parameters": make([(TEMPORAL_DOMAIN, offset)] if offset is not None else [], "temporal_parameters"),
            "memo_recovery": observe.stacked(memos, spark, "table_id string, physical_record_index bigint, field_id string, original_payload binary, payload_kind string"),
        }
        operation = {"state": "STARTED", "binding": plan.binding, "destination": plan.destination, "started_at": now()}
        vault.commit(
            new, operations={**vault.state["operations"], plan.operation_id: operation},
            dataset={"source_fingerprint": plan.source_fingerprint, "policy_fingerprint": policy_fingerprint(plan.policy), "relationship_fingerprint": document_fingerprint(list(plan.relations))},
        )


def pseudonymize(spark: SparkSession, plan: Plan, *, progress: Callback = None, cancel: Cancel = None, index_backend=None) -> dict:
    """Run a plan; the receipt of a completed run is returned again without work."""
    watch = Progress(plan.operation_id, progress, cancel, spark)
    files, vault = Files(spark), Vault(spark, plan.vault)
    done = vault.state["operations"].get(plan.operation_id)
    if done and done["state"] == "STARTED" and reconcile(spark, plan) == "COMPLETED":
        # a run that crashed between rename and receipt
        vault = Vault(spark, plan.vault)
        done = vault.state["operations"][plan.operation_id]
    if done and done["state"] == "COMPLETED" and files.exists(plan.output):
        if output_fingerprint(spark, plan.output) == done["receipt"]["output_fingerprint"]:
            return done["receipt"]
        raise EngineError("PUBLICATION_INCOMPLETE", "OUTPUT_CHANGED")
    found = preflight(spark, plan, progress=progress, cancel=cancel)
    if not found.ready:
        code = "MAPPING_CAPACITY_EXHAUSTED" if "PSEUDONYM_CAPACITY_INSUFFICIENT" in found.errors else "PUBLICATION_FAILED"
        raise EngineError(code, ",".join(found.errors))
    watch.send("OPERATION", "STARTED")
    staging = f"{plan.output.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    with vault.lease():
        dataset = load(spark, plan)
        pass_one(spark, plan, dataset, vault, watch)
        try:
            relations = effective(list(plan.relations))
            with watch.phase("PASS2_WRITE", len(dataset.tables)) as step:
                write_all(spark, plan, dataset, vault, staging, step)
            result = read_dataset(spark, staging, None, sorted(plan.facts))
            rows = compare_relations(spark, dataset, result, relations)
            failed = [r for r in rows if r["status"] != "VERIFIED"]
            if failed:
                raise EngineError("RELATIONSHIP_VERIFICATION_FAILED", f"{len(failed)} relations")
            backend = run_backend(index_backend, staging, sorted(plan.facts))
            with watch.phase("PUBLICATION"):
                mark = output_fingerprint(spark, staging)
                receipt = {
                    "operation_id": plan.operation_id, "dataset_id": plan.dataset_id, "source_fingerprint": plan.source_fingerprint, "output_fingerprint": mark,
                    "vault_fingerprint": vault.fingerprint(), "binding": plan.binding, "package_version": __version__, "index": backend,
                    "tables": {t.path: t.df.count() for t in result}, "assurance": assurance_level(list(plan.relations), len(rows), 0) | {"evidence_fingerprint": evidence.evidence_fingerprint(rows)},
                }
                publish(files, vault, plan, staging, receipt)
        except Exception:
            if not vault.state["operations"].get(plan.operation_id, {}).get("state") == "COMPLETED" and files.exists(staging):
                files.delete(staging)
            raise
    watch.send("OPERATION", "COMPLETED")
    return receipt


def write_all(spark: SparkSession, plan: Plan, dataset: Dataset, vault: Vault, staging: str, step=None) -> None:
    text, numbers = vault.read("text_mappings"), vault.read("numeric_key_mappings")
    offset = vault.read("temporal_parameters").first()
    small = transform.fits_broadcast(text, numbers)
    for k, table in enumerate(dataset):
        df = transform.rewrite(table, plan.of(table.path), text, numbers, offset["offset_days"] if offset else None, small)
        write_table(df, table.facts, f"{staging}/{table.path}")
        if step:
            step(k + 1)


def compare_relations(spark: SparkSession, before: Dataset, after: Dataset, relations: list[Relation]) -> list[dict]:
    """A row per relation. Four sides of all relations go through one grouped job."""
    if not relations:
        return []
    sources = evidence.sources_of(before, relations, "SOURCE") + evidence.sources_of(after, relations, "OUTPUT")
    histogram = evidence.relation_histogram(evidence.relation_keys(sources, spark)).persist()
    try:
        return [r.asDict() for r in evidence.compare_sides(evidence.relation_metrics(histogram)).select("relation_id", "status", *evidence.INVARIANTS).collect()]
    finally:
        histogram.unpersist()


def run_backend(backend, staging: str, tables: list[str]) -> list[dict]:
    """An index backend is any object with capabilities(), rebuild_index(path) and verify_index(path); it acts on staged tables."""
    if backend is None:
        return []
    out = []
    for table in tables:
        if backend.rebuild_index(f"{staging}/{table}") != "REBUILT" or backend.verify_index(f"{staging}/{table}") != "VERIFIED":
            raise EngineError("INDEX_BACKEND_FAILED")
        out.append({"table": table, "status": "REBUILT_VERIFIED"})
    return out


def publish(files: Files, vault: Vault, plan: Plan, staging: str, receipt: dict) -> None:
    """Staged, then renamed, then completed. A crash in between is settled by reconcile()."""
    log = [*vault.state["publication"], {"operation_id": plan.operation_id, "phase": "READY_TO_PROMOTE", "output_fingerprint": receipt["output_fingerprint"], "receipt": receipt}]
    vault.commit(publication=log)
    files.rename(staging, plan.output)
    complete(vault, plan, receipt)


def complete(vault: Vault, plan: Plan, receipt: dict) -> None:
    operation = {**vault.state["operations"][plan.operation_id], "state": "COMPLETED", "completed_at": now(), "receipt": receipt}
    vault.commit(operations={**vault.state["operations"], plan.operation_id: operation}, publication=[*vault.state["publication"], {"operation_id": plan.operation_id, "phase": "PUBLISHED"}])


def reconcile(spark: SparkSession, plan: Plan) -> str:
    """After a crash between rename and receipt: complete the operation if the output is what was staged."""
    vault, files = Vault.open(spark, plan.vault), Files(spark)
    last = [p for p in vault.state["publication"] if p["operation_id"] == plan.operation_id]
    if not last or last[-1]["phase"] != "READY_TO_PROMOTE" or not files.exists(plan.output):
        return "NOTHING_TO_DO"
    if output_fingerprint(spark, plan.output) != last[-1]["output_fingerprint"]:
        raise EngineError("PUBLICATION_INCOMPLETE")
    complete(vault, plan, last[-1]["receipt"])
    return "COMPLETED"


def verify_dataset(spark: SparkSession, plan: Plan, *, progress: Callback = None, cancel: Cancel = None) -> dict:
    """Source, output and vault against each other. Returns status, sorted codes, and findings by table; read-only."""
    watch, codes = Progress("verify", progress, cancel, spark), set()
    vault, parts = Vault.open(spark, plan.vault), []
    done = vault.state["operations"].get(plan.operation_id)
    if not done or done["state"] != "COMPLETED":
        codes.add("OPERATION_NOT_COMPLETED")
    elif done["binding"] != plan.binding or done["receipt"]["operation_id"] != plan.operation_id:
        codes.add("RECEIPT_IDENTITY_MISMATCH")
    if vault.state["dataset"]["source_fingerprint"] != plan.source_fingerprint:
        codes.add("VAULT_IDENTITY_MISMATCH")
    with watch.phase("SOURCE_VERIFICATION"):
        if source_fingerprint(spark, plan.source) != plan.source_fingerprint:
            codes.add("SOURCE_FINGERPRINT_MISMATCH")
    with watch.phase("OUTPUT_VERIFICATION"):
        mark = output_fingerprint(spark, plan.output)
        if done and done.get("receipt"):
            if mark != done["receipt"]["output_fingerprint"]:
                codes.add("OUTPUT_FINGERPRINT_MISMATCH")
    with watch.phase("VAULT_VERIFICATION"):
        if done and done.get("receipt") and vault.fingerprint() != done["receipt"]["vault_fingerprint"]:
            codes.add("RECEIPT_FINGERPRINT_MISMATCH")
        for name in ("text_mappings", "numeric_key_mappings"):
            own = vault.read(name).select("domain_id", F.col("original_value").alias("value"), F.col("pseudonym_value").alias("token"))
            if not allocate.check_bijection(own, ["domain_id"]).filter(~F.col("bijective")).isEmpty() or not own.filter("value = token").isEmpty():
                codes.add("VAULT_MAPPING_INVALID")
    from ..sources.dataset import discover_tables

    make = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    there = discover_tables(spark, plan.output)
    codes |= {r["code"] for r in verify.inventory_difference(make(sorted(plan.facts)), make(there)).collect()}
    tables, fields = ids_of(plan)
    want = spark.createDataFrame([(f.table, f.fact.name, f.action) for f in plan.fields], "relative_path string, name string, transform_action string")
    have = vault.read("fields").join(vault.read("tables"), "table_id").select("relative_path", "name", "transform_action")
    codes |= {r["code"] for r in verify.ledger_difference(want, have).collect()}
    offset = vault.read("temporal_parameters").first()
    text, numbers, memos = (vault.read(n) for n in ("text_mappings", "numeric_key_mappings", "memo_recovery"))
    small = transform.fits_broadcast(text, numbers)
    source = load(spark, plan)
    with watch.phase("VERIFICATION"):
        output = read_dataset(spark, plan.output, None, [p for p in there if p in plan.facts])
        for table in source:
            if table.path in output.tables:
                other = output.tables[table.path]
                parts.append(verify.table_findings(table, other, plan.of(table.path), text, numbers, memos, offset["offset_days"] if offset else None, fields[table.path], small))
                parts.append(verify.order_findings(other))
        found = [r.asDict() for r in verify.findings_union(parts, spark).collect()]
        codes |= {r["code"] for r in found}
        relations = effective(list(plan.relations))
        if all(t in output.tables for r in relations for t in (m.table for m in r.members)):
            rows = compare_relations(spark, source, output, relations)
            if done and done.get("receipt") and evidence.evidence_fingerprint(rows) != done["receipt"]["assurance"]["evidence_fingerprint"]:
                codes.add("ASSURANCE_EVIDENCE_MISMATCH")
    return {"status": verify.verdict(codes), "codes": sorted(codes), "findings": found}


def recover_output(spark: SparkSession, output: str, vault: str, target: str, *, enabled: bool = True, progress: Callback = None, cancel: Cancel = None) -> dict:
    """The originals in a new process, with no plan and no source at hand."""
    if not enabled:
        raise EngineError("RECOVERY_NOT_PERMITTED")
    return recover(spark, completed(spark, output, vault), target, progress=progress, cancel=cancel)


def recover(spark: SparkSession, plan: Plan | Completed, target: str, *, enabled: bool = True, progress: Callback = None, cancel: Cancel = None) -> dict:
    """The originals from output and vault, without the source. Staged, checked against the inverse, then renamed."""
    if not enabled:
        raise EngineError("RECOVERY_NOT_PERMITTED")
    watch, files = Progress("recover", progress, cancel, spark), Files(spark)
    apart(plan.output, target, plan.vault)
    vault = Vault.open(spark, plan.vault)
    done = vault.state["operations"].get(plan.operation_id)
    if not done or done["state"] != "COMPLETED" or done["destination"] != plan.destination:
        raise EngineError("RECOVERY_FAILED", "NO_COMPLETED_OPERATION")
    if output_fingerprint(spark, plan.output) != done["receipt"]["output_fingerprint"]:
        raise EngineError("RECOVERY_FAILED", "OUTPUT_FINGERPRINT_MISMATCH")
    if files.exists(target):
        raise EngineError("DESTINATION_CONFLICT")
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    dataset = read_dataset(spark, plan.output, None, sorted(plan.facts))
    try:
        with watch.phase("RECOVERY_SCAN", len(dataset.tables)):
            for path, df in recovered(plan, dataset, vault).items():
                write_table(df, dataset.tables[path].facts, f"{staging}/{path}")
        with watch.phase("VERIFICATION"):
            # what was written, put through the mappings again, must be the protected data
            back = read_dataset(spark, staging, None, sorted(plan.facts))
            again = rewritten(plan, back, vault)
            for path, df in again.items():
                want = dataset.tables[path].df
                if df.count() != want.count() or not df.select(want.columns).exceptAll(want).isEmpty():
                    raise EngineError("RECOVERY_FAILED", "STAGED_VERIFICATION")
        with watch.phase("PUBLICATION"):
            files.rename(staging, target)
    except Exception:
        if files.exists(staging):
            files.delete(staging)
        raise
    return {"operation_id": plan.operation_id, "canonical_verified": True, "raw_byte_equivalence": "NOT_EVALUATED", "tables": sorted(plan.facts)}


def rewritten(plan: Plan | Completed, dataset: Dataset, vault: Vault) -> dict[str, DataFrame]:
    offset = vault.read("temporal_parameters").first()
    text, numbers = vault.read("text_mappings"), vault.read("numeric_key_mappings")
    small = transform.fits_broadcast(text, numbers)
    return {t.path: transform.rewrite(t, plan.of(t.path), text, numbers, offset["offset_days"] if offset else None, small) for t in dataset}


def recovered(plan: Plan | Completed, dataset: Dataset, vault: Vault) -> dict[str, DataFrame]:
    tables, fields = ids_of(plan)
    offset = vault.read("temporal_parameters").first()
    text, numbers, memos = (vault.read(n) for n in ("text_mappings", "numeric_key_mappings", "memo_recovery"))
    small = transform.fits_broadcast(text, numbers)
    out = {}
    for t in dataset:
        df = transform.rewrite(t, plan.of(t.path), text, numbers, offset["offset_days"] if offset else None, small, back=True)
        out[t.path] = transform.with_memos(t, df, tables[t.path], plan.of(t.path), fields[t.path], memos)
    return out


def create_bundle(spark: SparkSession, plan: Plan, bundle: str) -> dict:
    """A copy of a verified output with a manifest of hashes, sizes and counts; nothing of the vault goes into it."""
    apart(plan.output, bundle, plan.vault)
    found = verify_dataset(spark, plan)
    if found["status"] != "PASS" and found["codes"] != ["INDEX_ARTIFACT_UNVERIFIED"]:
        raise EngineError("TRANSFER_FAILED", found["status"])
    if plan.policy["indexes"]["profile"] != "DATA_ONLY":
        raise EngineError("TRANSFER_FAILED", "OUTPUT_PROFILE_UNSUPPORTED")
    files = Files(spark)
    if files.exists(bundle):
        raise EngineError("DESTINATION_CONFLICT")
    staging = f"{bundle.rstrip('/')}.staging-{uuid.uuid4().hex[:8]}"
    names = [p for p, _ in inventory(spark, plan.output)]
    folded = [p.casefold() for p in names]
    if len(set(folded)) < len(folded) or any(forbidden(p) for p in names):
        raise EngineError("TRANSFER_FAILED", "ARTIFACT_NOT_ALLOWED")
    fs, _ = files.path(staging)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in names:
        source, target = hadoop.Path(f"{plan.output}/{name}"), hadoop.Path(f"{staging}/data/{name}")
        fs.mkdirs(target.getParent())
        hadoop.FileUtil.copy(source.getFileSystem(files.conf), source, fs, target, False, files.conf)
    manifest = manifest_of(spark, plan, f"{staging}/data")
    files.write(f"{staging}/manifest.json", canonical_json(manifest))
    if verify_bundle(spark, staging)["status"] != "PASS":
        files.delete(staging)
        raise EngineError("TRANSFER_FAILED", "STAGED_VERIFICATION")
    files.rename(staging, bundle)
    return manifest


def forbidden(path: str) -> bool:
    """Names that smell of vaults, locks, logs or databases never enter a bundle."""
    low = path.casefold()
    return low.endswith((".db", ".sqlite", ".sqlite3", ".json", ".log", ".lock", ".key", "-wal", "-shm", "-journal")) or "vault" in low or ".." in low.split("/") or low.startswith("/")


def manifest_of(spark: SparkSession, plan: Plan, root: str) -> dict:
    from ..sources.dataset import artifact_hashes

    rows = sorted(artifact_hashes(spark, root).collect(), key=lambda r: r["path"])
    data = read_dataset(spark, root)
    return {
        "manifest_version": "1.0", "operation_id": plan.operation_id, "output_fingerprint": output_fingerprint(spark, root),
        "artifacts": [{"path": r["path"], "size": r["size"], "sha256": r["sha256"]} for r in rows],
        "tables": [{"path": t.path, "records": t.df.count(), "deleted": t.df.filter("_deleted").count(), "schema": schema_fingerprint(t.facts)} for t in data],
    }


MANIFEST_KEYS = {"manifest_version", "operation_id", "output_fingerprint", "artifacts", "tables"}


def verify_bundle(spark: SparkSession, bundle: str) -> dict:
    """A bundle by itself: its manifest is closed and well formed, and says exactly what is there."""
    from ..sources.dataset import artifact_hashes

    files, codes = Files(spark), set()
    try:
        manifest = unique_json(files.read(f"{bundle}/manifest.json"))
    except Exception as e:
        raise EngineError("TRANSFER_FAILED", "MANIFEST_UNREADABLE") from e
    if set(manifest) != MANIFEST_KEYS or manifest["manifest_version"] != "1.0":
        return {"status": "FAIL", "codes": ["MANIFEST_SCHEMA"]}
    top = {p.split("/")[0] for p, _ in files.list(bundle) if not p.split("/")[-1].startswith(".")}
    if top - {"data", "manifest.json"}:
        codes.add("UNEXPECTED_OUTPUT_ARTIFACT")
    there = {r["path"]: (r["size"], r["sha256"]) for r in artifact_hashes(spark, f"{bundle}/data").collect()}
    said = {a["path"]: (a["size"], a["sha256"]) for a in manifest["artifacts"]}
    if set(there) - set(said):
        codes.add("UNEXPECTED_OUTPUT_ARTIFACT")
    if set(said) - set(there):
        codes.add("TABLE_MISSING")
    if any(said[p] != there[p] for p in set(said) & set(there)):
        codes.add("OUTPUT_FINGERPRINT_MISMATCH")
    if not codes:
        for t in read_dataset(spark, f"{bundle}/data"):
            entry = next((x for x in manifest["tables"] if x["path"] == t.path), None)
            if not entry or entry["records"] != t.df.count() or entry["schema"] != schema_fingerprint(t.facts):
                codes.add("RECORD_COUNT_MISMATCH")
    return {"status": "PASS" if not codes else "FAIL", "codes": sorted(codes)}


def capabilities(recovery_enabled: bool = True) -> dict:
    return {"package_version": __version__, "direct_read": True, "direct_write": True, "recovery": recovery_enabled, "transfer_bundle": True, "vfp_index_backend": False, "phases": len(PHASES)}
