"""The corpus pipeline by the name under which it is registered; its stages are in maskwright.llm.pipeline."""

from maskwright.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
