"""Progress events and cancellation: one operation, its phases, monotone counts and one terminal event."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from .errors import EngineError

PHASES = (
    "OPERATION", "DISCOVERY", "FINGERPRINT", "TABLE_EVALUATION", "SOURCE_VERIFICATION", "SOURCE_REVALIDATION", "CAPACITY_SCAN", "SCAN", "WRITE",
    "VERIFICATION", "VAULT_VERIFICATION", "OUTPUT_VERIFICATION", "RECOVERY_SCAN", "TRANSFER_SCAN", "PUBLICATION", "PASS1_SCAN", "PASS1_FINALIZE",
    "PASS2_WRITE", "INDEX_REBUILD",
)
STARTED, PROGRESS, COMPLETED = "STARTED", "PROGRESS", "COMPLETED"


@dataclass(frozen=True)
class Event:
    operation: str
    phase: str
    code: str
    done: int = 0
    total: int | None = None


class Progress:
    """Sends events to a callback and asks another whether to stop. Spark jobs run under the operation's group, which a stop cancels."""

    def __init__(self, operation: str, callback: Callable[[Event], None] | None = None, cancelled: Callable[[], bool] | None = None, spark=None):
        self.operation, self.callback, self.cancelled, self.spark = operation, callback, cancelled, spark
        if spark is not None:
            spark.sparkContext.setJobGroup(operation, operation, True)

    def send(self, phase: str, code: str, done: int = 0, total: int | None = None) -> None:
        self.check()
        if self.callback:
            try:
                self.callback(Event(self.operation, phase, code, done, total))
            except Exception as e:
                raise EngineError("PROGRESS_CALLBACK_FAILED") from e

    def check(self) -> None:
        if not self.cancelled:
            return
        try:
            stop = self.cancelled()
        except Exception as e:
            raise EngineError("CANCEL_CALLBACK_FAILED") from e
        if stop:
            if self.spark is not None:
                self.spark.sparkContext.cancelJobGroup(self.operation)
            raise EngineError("OPERATION_CANCELLED")

    @contextmanager
    def phase(self, name: str, total: int | None = None):
        self.send(name, STARTED, 0, total)
        yield lambda done: self.send(name, PROGRESS, done, total)
        self.send(name, COMPLETED, total or 0, total)
