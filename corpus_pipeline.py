"""The corpus pipeline of the training-data operators; its stages are in lakeloom.llm.pipeline."""

from lakeloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
