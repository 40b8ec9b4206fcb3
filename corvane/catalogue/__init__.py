"""Registered queries over the library's own operators and their SQL twins."""

from corvane.catalogue import evaluation, graphs, ingestion, models, retrieval, storage, texts, usage  # noqa: F401
from corvane.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
