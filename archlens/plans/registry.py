"""Queries by key, and for each that SQL can express the same query for DuckDB."""

from __future__ import annotations

from archlens.plans.base import ORACLES, QUERIES  # noqa: F401
from archlens.plans import answers, checks, evaluation, extraction, graphs, library, model, outcomes, packets, scoring, text  # noqa: F401
