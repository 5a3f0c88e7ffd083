"""All registered queries."""

from . import data_prep, decisions, declared_sources, files_and_streams, ratio_and_bayes, tests_of_effect, unit_rollup  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
