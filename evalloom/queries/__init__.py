"""Registered queries over the given tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from . import contracts, evaluation, features, jobs, labels, linkage, ordering, profiles, splits, wide  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
