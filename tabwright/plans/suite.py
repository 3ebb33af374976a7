"""All registered queries; importing a family module registers it."""

from tabwright.plans import catalog, cleaning, features, logs, modelling, profiling, sources, streams  # noqa: F401
from tabwright.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
