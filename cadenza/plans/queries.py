"""The time-series queries and their DuckDB counterparts."""

from cadenza.plans import modelling, pieces, reporting, statistics, windows  # noqa: F401
from cadenza.plans.registry import ORACLES, QUERIES  # noqa: F401
