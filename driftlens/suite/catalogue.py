"""Imports every query module so that the registry is filled."""

from driftlens.suite import files, graph, ledger, live, quality, revenue, scalars  # noqa: F401
from driftlens.suite.registry import ORACLES, QUERIES  # noqa: F401
