"""Importing this module registers every query."""

from citeloom.queries import control, evaluation, ingestion, judgement, looping, packaging, retrieval, service  # noqa: F401
from citeloom.queries.base import REGISTRY

__all__ = ["REGISTRY"]
