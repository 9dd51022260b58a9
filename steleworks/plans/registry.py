"""Every query by name, and its SQL."""

from __future__ import annotations

from . import catalog, corpus, extract, images, jobs, profile, scores, sequences
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "corpus", "extract", "images", "jobs", "profile", "scores", "sequences"]
