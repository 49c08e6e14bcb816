"""The corpus pipeline, whose stages are in lexigrid.llm.pipeline."""

from lexigrid.llm.pipeline import ORACLE_SQL, STAGES, exact, language, near, pack, redact, run

__all__ = ["ORACLE_SQL", "STAGES", "exact", "language", "near", "pack", "redact", "run"]
