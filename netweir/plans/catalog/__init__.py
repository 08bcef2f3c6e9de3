"""Every operator as a query over the test tables, with its SQL equal where SQL can say it."""

from netweir.plans.catalog import (  # noqa: F401
    alarms, drift, evaluation, explanations, models, packets, profiling, streams, training_sets,
)
from netweir.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
