"""Typed failures. Messages carry codes and bounded facts only, never values of the data."""

from __future__ import annotations

#: Category of each machine code.
CATEGORY_OF = {
    "PATH_INVALID": "path", "PATH_NOT_FOUND": "path", "PATH_OVERLAP": "path", "DESTINATION_CONFLICT": "path",
    "POLICY_INVALID": "policy", "POLICY_UNSUPPORTED": "policy", "DBFBRIDGE_FAILURE": "dbfbridge",
    "VAULT_UNAVAILABLE": "vault", "VAULT_CORRUPT": "vault", "VAULT_ACCESS_DENIED": "vault", "VAULT_SCHEMA_UNSUPPORTED": "vault",
    "VAULT_IDENTITY_MISMATCH": "vault", "VAULT_STATE_INVALID": "vault", "VAULT_WRITER_CONFLICT": "vault",
    "MAPPING_CAPACITY_EXHAUSTED": "mapping", "MAPPING_CONSTRAINT_INFEASIBLE": "mapping", "MAPPING_CONFLICT": "mapping",
    "RELATIONSHIP_INVALID": "relationship", "RELATIONSHIP_VERIFICATION_FAILED": "relationship",
    "PUBLICATION_FAILED": "publication", "PUBLICATION_INCOMPLETE": "publication", "VERIFICATION_FAILED": "verification",
    "RECOVERY_FAILED": "recovery", "RECOVERY_NOT_PERMITTED": "recovery", "TRANSFER_FAILED": "transfer",
    "INDEX_BACKEND_FAILED": "index_backend", "OPERATION_CANCELLED": "cancellation",
    "PROGRESS_CALLBACK_FAILED": "callback", "CANCEL_CALLBACK_FAILED": "callback",
}


class EngineError(Exception):
    def __init__(self, code: str, detail: str = ""):
        if code not in CATEGORY_OF:
            raise ValueError(f"unknown code {code}")
        self.code, self.category, self.detail = code, CATEGORY_OF[code], detail
        super().__init__(f"{code}: {detail}" if detail else code)

    def to_dict(self) -> dict[str, str]:
        return {"code": self.code, "category": self.category, "detail": self.detail}
