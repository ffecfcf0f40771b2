"""The corpus pipeline, whose stages and run() are those of palimpsest.llm.pipeline."""

from palimpsest.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
