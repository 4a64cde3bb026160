"""A training corpus from raw documents; the stages are in the subpackage of the operators that they call."""

from corpusforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
