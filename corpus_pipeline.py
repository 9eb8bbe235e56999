"""The corpus pipeline, whose stages are in ``siltstone.llm.pipeline``."""

from siltstone.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
