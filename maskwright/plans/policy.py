"""Policies: versioned JSON, merged over defaults, identified by a fingerprint."""

from __future__ import annotations

import copy
import hashlib
import json

from .errors import EngineError
from .schema import KEEP, MASKED, PSEUDONYMIZE, SHIFT

#: Sections, settings and defaults of the policy format.
DEFAULT_POLICY = {
    "schema_version": 1,
    "profile": "SAFE_TRANSFER",
    "text": {"default_action": PSEUDONYMIZE, "domain": "GLOBAL_TEXT"},
    "memo": {"text": MASKED, "binary": MASKED},
    "temporal": {"date": SHIFT, "datetime": SHIFT},
    "numeric": {"default_action": KEEP},
    "relationships": {"metadata_file": None},
    "indexes": {"profile": "DATA_ONLY"},
}
#: Values that a setting may take; None: any.
ALLOWED = {
    ("schema_version",): {1}, ("profile",): {"SAFE_TRANSFER"}, ("text", "default_action"): {PSEUDONYMIZE, KEEP}, ("text", "domain"): {"GLOBAL_TEXT"},
    ("memo", "text"): {MASKED, KEEP}, ("memo", "binary"): {MASKED, KEEP}, ("temporal", "date"): {SHIFT, KEEP}, ("temporal", "datetime"): {SHIFT, KEEP},
    ("numeric", "default_action"): {KEEP}, ("relationships", "metadata_file"): None, ("indexes", "profile"): {"DATA_ONLY", "VFP_INDEXED"},
}


def canonical_json(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def digest(prefix: str, value: object, size: int = 64) -> str:
    """prefix and the start of the SHA-256 of value's canonical JSON."""
    return f"{prefix}{hashlib.sha256(canonical_json(value)).hexdigest()[:size]}"


def resolve_policy(given: dict | None = None) -> dict:
    policy = copy.deepcopy(DEFAULT_POLICY)
    for section, value in (given or {}).items():
        if section not in policy:
            raise EngineError("POLICY_INVALID", "unknown section")
        if isinstance(policy[section], dict):
            if not isinstance(value, dict) or set(value) - set(policy[section]):
                raise EngineError("POLICY_INVALID", f"section {section}")
            policy[section].update(value)
        else:
            policy[section] = value
    for path, values in ALLOWED.items():
        found = policy
        for name in path:
            found = found[name]
        if values is not None and found not in values:
            raise EngineError("POLICY_UNSUPPORTED", ".".join(path))
    return policy


def policy_fingerprint(policy: dict) -> str:
    return digest("pol-", policy)


def unique_json(text: str | bytes) -> dict:
    """Strict JSON: a name that occurs twice in an object is refused."""

    def pairs(found: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in found}) < len(found):
            raise ValueError("duplicate name")
        return dict(found)

    return json.loads(text, object_pairs_hook=pairs)
