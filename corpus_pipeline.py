"""The pipeline of ``harrow.llm.pipeline``: its stages, its run and its SQL."""

from harrow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
