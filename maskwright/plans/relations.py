"""Relation documents: declared keys, their checks, their domains and the level of assurance they give."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.values import intersect, member_range
from .errors import EngineError
from .policy import digest, unique_json

VERSION = "1.0"
TEXT_DOMAIN = "text:global"
TEMPORAL_DOMAIN = "temporal:global"
REVERSIBLE, PRESERVE = "REVERSIBLE_BIJECTIVE", "PRESERVE"


def relative_path(value: object) -> str:
    """A table path as segments joined by slashes; absolute paths, drives and steps upward are refused."""
    if not isinstance(value, str) or not value.strip():
        raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_TABLE_PATH_INVALID")
    parts = re.split(r"[\\/]+", value.strip())
    if not parts[0] or any(":" in p for p in parts):
        raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_TABLE_PATH_ABSOLUTE")
    parts = [p for p in parts if p]
    if any(p in (".", "..") for p in parts):
        raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_TABLE_PATH_TRAVERSAL")
    return "/".join(parts)


@dataclass(frozen=True)
class Member:
    table: str
    field: str
    role: str
    ordinal: int
    dbf_type: str
    byte_width: int
    encoding: str = "none"
    nullable: bool = False


@dataclass(frozen=True)
class Relation:
    relation_id: str
    members: tuple[Member, ...]
    provenance: str = "POLICY_FILE"
    comparison: str = "EXACT_VALUE"
    numeric_strategy: str | None = None
    source_digest: str | None = None
    authority: str | None = None
    assurance: str | None = None

    def side(self, *roles: str) -> list[Member]:
        return sorted((m for m in self.members if m.role in roles), key=lambda m: m.ordinal)

    @property
    def parent(self) -> list[Member]:
        return self.side("PRIMARY", "CANDIDATE")

    @property
    def foreign(self) -> list[Member]:
        return self.side("FOREIGN")

    def check(self) -> None:
        fail = lambda why: EngineError("RELATIONSHIP_INVALID", why)
        if {m.role for m in self.members} not in ({"PRIMARY", "FOREIGN"}, {"CANDIDATE", "FOREIGN"}):
            raise fail("RELATIONSHIP_PARENT_FAMILY")
        if self.comparison != "EXACT_VALUE" or self.numeric_strategy not in (None, REVERSIBLE, PRESERVE):
            raise fail("RELATIONSHIP_STRATEGY")
        for side in (self.parent, self.foreign):
            if [m.ordinal for m in side] != list(range(1, len(side) + 1)):
                raise fail("RELATIONSHIP_ORDINALS")
            if len({m.table for m in side}) != 1:
                raise fail("RELATIONSHIP_TABLES")
        if len(self.parent) != len(self.foreign):
            raise fail("RELATIONSHIP_ARITY")
        for a, b in zip(self.parent, self.foreign, strict=True):
            if (a.dbf_type in "CV") != (b.dbf_type in "CV"):
                raise fail("RELATIONSHIP_TYPES")
            if a.dbf_type not in "CVIN" or b.dbf_type not in "CVIN":
                raise fail("RELATIONSHIP_TYPES")

    @property
    def counts(self) -> bool:
        """Declared relations count; claims from outside only if authoritative and verified."""
        return self.authority is None or (self.authority == "CONTRACT_AUTHORITATIVE" and self.assurance == "VERIFIED")


def parse_document(text: str | bytes | dict | None) -> list[Relation]:
    if text is None:
        return []
    try:
        found = text if isinstance(text, dict) else unique_json(text)
    except ValueError as e:
        raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_JSON") from e
    if found.get("metadata_schema_version") != VERSION or not isinstance(found.get("relations"), list):
        raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_SCHEMA_VERSION")
    out = []
    for entry in found["relations"]:
        try:
            members = tuple(Member(**{**m, "table": relative_path(m["table"])}) for m in entry["members"])
            relation = Relation(members=members, **{k: v for k, v in entry.items() if k != "members"})
        except (KeyError, TypeError) as e:
            raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_SHAPE") from e
        relation.check()
        out.append(relation)
    if len({r.relation_id for r in out}) < len(out):
        raise EngineError("RELATIONSHIP_INVALID", "RELATIONSHIP_DUPLICATE_ID")
    return out


def document_of(relations: list[Relation]) -> dict:
    """The canonical form: relations by id, members by role and place."""
    def member(m: Member) -> dict:
        return dict(m.__dict__)

    return {
        "metadata_schema_version": VERSION,
        "relations": [
            {**{k: v for k, v in r.__dict__.items() if k != "members" and v is not None}, "members": [member(m) for m in sorted(r.members, key=lambda m: (m.role, m.ordinal))]}
            for r in sorted(relations, key=lambda r: r.relation_id)
        ],
    }


def document_fingerprint(relations: list[Relation]) -> str:
    return digest("rel-", document_of(relations))


def effective(relations: list[Relation]) -> list[Relation]:
    return [r for r in relations if r.counts]


def numeric_domains(relations: list[Relation]) -> dict[tuple[str, str], tuple[str, tuple[int, int]]]:
    """(table, field) -> (domain id, shared range) for members of reversible numeric keys; a member of two domains is a conflict."""
    out: dict[tuple[str, str], tuple[str, tuple[int, int]]] = {}
    mark = document_fingerprint(relations)
    strategies: dict[tuple[str, str], set[str]] = {}
    for relation in effective(relations):
        for m in relation.members:
            if m.dbf_type in "IN":
                strategies.setdefault((m.table, m.field), set()).add(relation.numeric_strategy or PRESERVE)
        if relation.numeric_strategy != REVERSIBLE:
            continue
        for a, b in zip(relation.parent, relation.foreign, strict=True):
            if a.dbf_type in "CV":
                continue
            shared = intersect([member_range(m.dbf_type, m.byte_width) for m in (a, b)])
            if shared is None:
                raise EngineError("MAPPING_CONSTRAINT_INFEASIBLE", "NUMERIC_RANGES_DISJOINT")
            domain = digest("num-", [mark, relation.relation_id, a.ordinal], 32)
            for m in (a, b):
                if out.setdefault((m.table, m.field), (domain, shared))[0] != domain:
                    raise EngineError("MAPPING_CONFLICT", "NUMERIC_MEMBER_IN_TWO_DOMAINS")
    if any(len(s) > 1 for s in strategies.values()):
        raise EngineError("MAPPING_CONFLICT", "NUMERIC_STRATEGY_CONFLICT")
    return out


def assurance_level(relations: list[Relation], verified: int, failed: int) -> dict:
    """The level that the counts of verified and failed relations allow."""
    total = len(relations)
    authoritative = total > 0 and all(r.authority == "CONTRACT_AUTHORITATIVE" and r.assurance == "VERIFIED" for r in relations)
    if not total:
        level = "GLOBAL_EXACT_VALUE"
    elif verified == total and not failed:
        level = "VFP_METADATA_VERIFIED" if authoritative else "DECLARED_RELATIONS_VERIFIED"
    else:
        level = "INCOMPLETE"
    return {"level": level, "declared": total, "verified": verified, "failed": failed, "incomplete": total - verified - failed}
