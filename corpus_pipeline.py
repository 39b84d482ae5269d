"""The corpus pipeline: its stages are in ``quillstone.llm.pipeline``."""

from quillstone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
