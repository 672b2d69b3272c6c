"""The registered queries: each one binds an operator to the given tables."""

from refracta.plans import (  # noqa: F401 - importing registers
    collecting,
    costs,
    experiments,
    inference,
    leaderboards,
    metrics,
    replies,
    rows,
    statistics,
    streams,
)
from refracta.plans.registry import ORACLES, QUERIES  # noqa: F401
