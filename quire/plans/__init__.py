"""All queries of the engine and the SQL of each."""

from . import library, texts, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
