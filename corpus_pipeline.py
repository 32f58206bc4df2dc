"""The pipeline of five stages over documents; its stages are in tideline/llm/pipeline.py."""

from tideline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
