"""The training-data pipeline, under the name that runs it; its stages are in the library."""

from paperloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
