"""Named queries over the test tables, each with its SQL where SQL can express it."""

from spindrift.plans import cleaning, models, relational, retrieve, sinks, texts  # noqa: F401
from spindrift.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
