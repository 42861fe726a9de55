"""All queries of the library."""

from harborlens.plans import forms, gates, network, pages, readers, relational, reports, scans, shapes, state, stories, texts, week, workflow  # noqa: F401  its queries register themselves
from harborlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
