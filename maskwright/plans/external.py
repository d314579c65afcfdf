"""Metadata from outside: an envelope of relation and index claims, each with its own authority and assurance."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import EngineError
from .policy import digest, unique_json
from .relations import Relation, parse_document, relative_path

VERSION, MOST_CLAIMS = "1.0", 256
#: The keys and words of the interchange format.
AUTHORITIES, ASSURANCES = {"CONTRACT_AUTHORITATIVE", "INFERRED"}, {"VERIFIED", "UNVERIFIED"}
OUTSIDE = "EXTERNAL_VFP_METADATA"
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:+-]{0,127}")
ENVELOPE = {"metadata_schema_version", "external_metadata_schema_version", "producer", "authority", "relations", "index_claims"}
CLAIM = {"claim_id", "table", "index_file", "index_kind", "tags", "verification_state", "assurance", "provenance", "authority"}


@dataclass(frozen=True)
class IndexClaim:
    claim_id: str
    table: str
    index_file: str
    index_kind: str
    tags: tuple[tuple[str, str], ...]
    verification_state: str
    assurance: str
    provenance: str
    authority: str

    @property
    def guarantees(self) -> bool:
        """Only a claim that is authoritative, verified twice over and from outside says that an index is valid."""
        return self.authority == "CONTRACT_AUTHORITATIVE" and self.verification_state == self.assurance == "VERIFIED" and self.provenance == OUTSIDE


@dataclass(frozen=True)
class Envelope:
    producer: tuple[str, str]
    authority: str
    relations: tuple[Relation, ...]
    index_claims: tuple[IndexClaim, ...]

    @property
    def fingerprint(self) -> str:
        return digest("ext-", [self.producer, self.authority, [repr(r) for r in self.relations], [repr(c) for c in self.index_claims]])


def refuse(why: str) -> EngineError:
    return EngineError("RELATIONSHIP_INVALID", f"EXTERNAL_METADATA_{why}")


def token(value: object, why: str) -> str:
    if not isinstance(value, str) or not TOKEN.fullmatch(value):
        raise refuse(why)
    return value


def claim_rules(authority: object, assurance: object, provenance: object) -> None:
    """An unverified claim can't be authoritative, nor can one that a policy file makes."""
    if authority not in AUTHORITIES or assurance not in ASSURANCES:
        raise refuse("AUTHORITY_INVALID")
    if authority == "CONTRACT_AUTHORITATIVE" and (assurance != "VERIFIED" or provenance == "POLICY_FILE"):
        raise refuse("AUTHORITY_ASSURANCE")


def parse_index_claim(found: dict) -> IndexClaim:
    if not isinstance(found, dict) or set(found) != CLAIM or found["index_kind"] not in ("STRUCTURAL_CDX", "STANDALONE_IDX"):
        raise refuse("INDEX_CLAIM_SHAPE")
    tags = found["tags"]
    if not isinstance(tags, list) or not 0 < len(tags) <= MOST_CLAIMS or any(t.get("sort_order") not in ("ASCENDING", "DESCENDING") for t in tags):
        raise refuse("INDEX_TAGS")
    claim_rules(found["authority"], found["assurance"], found["provenance"])
    named = tuple((token(t.get("name"), "INDEX_TAG_NAME"), t["sort_order"]) for t in tags)
    return IndexClaim(
        token(found["claim_id"], "CLAIM_ID"), relative_path(found["table"]), relative_path(found["index_file"]), found["index_kind"], named,
        found["verification_state"], found["assurance"], token(found["provenance"], "PROVENANCE"), found["authority"],
    )


def parse_envelope(text: str | bytes | dict) -> Envelope:
    try:
        found = text if isinstance(text, dict) else unique_json(text)
    except ValueError as e:
        raise refuse("JSON") from e
    if set(found) - ENVELOPE or ENVELOPE - {"index_claims"} - set(found) or found["external_metadata_schema_version"] != VERSION:
        raise refuse("SCHEMA")
    producer = found["producer"]
    if not isinstance(producer, dict) or set(producer) != {"producer_id", "producer_version"}:
        raise refuse("PRODUCER_INVALID")
    if found["authority"] not in AUTHORITIES or len(found.get("index_claims", [])) > MOST_CLAIMS:
        raise refuse("AUTHORITY_INVALID")
    for entry in found["relations"]:
        claim_rules(entry.get("authority"), entry.get("assurance"), entry.get("provenance"))
    relations = parse_document({"metadata_schema_version": found["metadata_schema_version"], "relations": found["relations"]})
    claims = tuple(parse_index_claim(c) for c in found.get("index_claims", []))
    return Envelope((token(producer["producer_id"], "PRODUCER_ID"), token(producer["producer_version"], "PRODUCER_VERSION")), found["authority"], tuple(relations), claims)
