"""The vault: mapping and recovery tables as immutable versions, under a log of commits.

A commit is a numbered JSON file that is created only if absent, so that of two writers one fails; stores without an atomic create need a
file system layer that has one. It names the version of every table, so a reader sees one commit whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import EngineError
from ..plans.policy import canonical_json, digest
from .shared import Files

VERSION = "1.1"
TABLES = {
    "mapping_domains": "domain_id string, domain_kind string, normalization string, relational_role string",
    "tables": "table_id string, relative_path string, schema_fingerprint string, source_fingerprint string",
    "fields": "field_id string, table_id string, name string, dbf_type string, encoding string, width int, transform_action string, mapping_domain_id string",
    "text_mappings": "domain_id string, original_value string, pseudonym_value string, logical_byte_length int",
    "numeric_key_mappings": "domain_id string, original_value string, pseudonym_value string",
    "memo_recovery": "table_id string, physical_record_index bigint, field_id string, original_payload binary, payload_kind string",
    "temporal_parameters": "domain_id string, offset_days int",
}
UNIQUE = {
    "mapping_domains": [["domain_id"]], "tables": [["table_id"], ["relative_path"]], "fields": [["field_id"], ["table_id", "name"]],
    "text_mappings": [["domain_id", "original_value"], ["domain_id", "pseudonym_value"]],
    "numeric_key_mappings": [["domain_id", "original_value"], ["domain_id", "pseudonym_value"]],
    "memo_recovery": [["table_id", "physical_record_index", "field_id"]], "temporal_parameters": [["domain_id"]],
}


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Vault:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.state = self._last()

    def _last(self) -> dict:
        names = sorted(p for p, _ in self.files.list(f"{self.root}/commits") if p.endswith(".json"))
        if not names:
            return {"number": 0, "schema_version": VERSION, "vault_id": None, "dataset": None, "operations": {}, "publication": [], "tables": {}}
        try:
            state = json.loads(self.files.read(f"{self.root}/commits/{names[-1]}"))
        except ValueError as e:
            raise EngineError("VAULT_CORRUPT") from e
        if state.get("schema_version") != VERSION:
            raise EngineError("VAULT_SCHEMA_UNSUPPORTED")
        return state

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Vault:
        """An existing vault, to be read."""
        vault = cls(spark, root)
        if not vault.state["number"]:
            raise EngineError("VAULT_UNAVAILABLE")
        return vault

    def read(self, name: str) -> DataFrame:
        paths = self.state["tables"].get(name)
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{paths}")

    def commit(self, tables: dict[str, DataFrame] | None = None, **changes) -> None:
        """Write new versions of whole tables, check their unique keys, then publish them with changes to the state."""
        state = {**self.state, **changes, "number": self.state["number"] + 1, "committed_at": now()}
        state["vault_id"] = state["vault_id"] or f"vid-{uuid.uuid4().hex}"
        state["tables"] = dict(state["tables"])
        for name, df in (tables or {}).items():
            at = f"versions/{state['number']:08d}-{uuid.uuid4().hex[:8]}/{name}"
            df.select(*(c.split(" ")[0] for c in TABLES[name].split(", "))).write.mode("errorifexists").parquet(f"{self.root}/{at}")
            written = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{at}")
            for key in UNIQUE[name]:
                if not written.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
                    raise EngineError("MAPPING_CONFLICT", f"{name} {'+'.join(key)}")
            state["tables"][name] = at
        try:
            self.files.write(f"{self.root}/commits/{state['number']:08d}.json", canonical_json(state))
        except Exception as e:
            raise self.failure(f"{self.root}/commits/{state['number']:08d}.json") from e
        self.state = state

    def failure(self, path: str) -> EngineError:
        """Why a file could not be created: it is there, so another writer came first, or the store refused."""
        try:
            return EngineError("VAULT_WRITER_CONFLICT") if self.files.exists(path) else EngineError("VAULT_ACCESS_DENIED")
        except Exception:
            return EngineError("VAULT_UNAVAILABLE")

    def fingerprint(self) -> str:
        """Of what mappings say, whatever files they lie in."""
        parts = []
        for name in sorted(TABLES):
            df = self.read(name)
            total = df.select(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
            parts.append([name, str(total["s"] or 0), total["n"]])
        return digest("vlt-", [self.state["vault_id"], parts])

    def lease(self) -> Lease:
        return Lease(self)


class Lease:
    """One writer at a time: a file that is created only if absent. One older than HOURS was left by a crash and is taken over."""

    HOURS = 24

    def __init__(self, vault: Vault):
        self.vault, self.path, self.owner = vault, f"{vault.root}/lease.json", uuid.uuid4().hex

    def __enter__(self) -> Vault:
        mine = canonical_json({"owner": self.owner, "since": now()})
        try:
            self.vault.files.write(self.path, mine)
        except Exception as e:
            if not self.expired():
                raise self.vault.failure(self.path) from e
            self.vault.files.write(self.path, mine, overwrite=True)
            if self.holder() != self.owner:  # another one took it over in between
                raise EngineError("VAULT_WRITER_CONFLICT") from e
        self.vault.state = self.vault._last()
        return self.vault

    def read(self) -> dict:
        try:
            return json.loads(self.vault.files.read(self.path))
        except Exception:
            return {}

    def holder(self) -> str | None:
        return self.read().get("owner")

    def expired(self) -> bool:
        since = self.read().get("since")
        return since is not None and datetime.now(timezone.utc) - datetime.fromisoformat(since) > timedelta(hours=self.HOURS)

    def __exit__(self, *_) -> None:
        if self.holder() == self.owner:
            self.vault.files.delete(self.path)
