"""Corpus preparation in stages; ``strandlog.llm.pipeline`` has them."""

from strandlog.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
