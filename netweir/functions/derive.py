"""Features that follow from other features, as column expressions.

Each rule names its inputs, the share of flows on which it is known to be exact, and the
expression; the result is null when an input is null or the rule's guard fails.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from netweir.functions.numbers import is_finite, ratio

FWD, BWD = "Total Fwd Packets", "Total Backward Packets"
FWD_BYTES, BWD_BYTES = "Total Length of Fwd Packets", "Total Length of Bwd Packets"
DURATION = "Flow Duration"


@dataclass(frozen=True)
class Rule:
    inputs: tuple[str, ...]
    exact_rate: float
    expression: Callable[..., Column]


def _same(value: Column) -> Column:
    return value


def _per_second(*parts: Column) -> Column:
    *counts, micros = parts
    return ratio(sum(counts[1:], counts[0]), micros / 1000000.0)


RULES: dict[str, Rule] = {
    "Avg Fwd Segment Size": Rule(("Fwd Packet Length Mean",), 1.0, _same),
    "Avg Bwd Segment Size": Rule(("Bwd Packet Length Mean",), 1.0, _same),
    "Subflow Fwd Packets": Rule((FWD,), 1.0, _same),
    "Subflow Bwd Packets": Rule((BWD,), 1.0, _same),
    "Subflow Fwd Bytes": Rule((FWD_BYTES,), 1.0, _same),
    "Subflow Bwd Bytes": Rule((BWD_BYTES,), 1.0, _same),
    "Down/Up Ratio": Rule((BWD, FWD), 1.0, lambda b, f: F.floor(ratio(b, f)).cast("double")),
    "Max Packet Length": Rule(("Fwd Packet Length Max", "Bwd Packet Length Max"), 1.0, F.greatest),
    # the backward minimum is stored as 0 when nothing came back and must not count
    "Min Packet Length": Rule(
        ("Fwd Packet Length Min", "Bwd Packet Length Min", BWD), 1.0,
        lambda f, b, n: F.when(n == 0, f).otherwise(F.least(f, b))),
    "Flow Packets/s": Rule((FWD, BWD, DURATION), 1.0, _per_second),
    "Fwd Packets/s": Rule((FWD, DURATION), 0.9999, _per_second),
    "Bwd Packets/s": Rule((BWD, DURATION), 0.9999, _per_second),
    "Packet Length Variance": Rule(("Packet Length Std",), 0.9932, lambda s: s * s),
    "Flow Bytes/s": Rule((FWD_BYTES, BWD_BYTES, DURATION), 0.9919, _per_second),
    "Flow IAT Mean": Rule((DURATION, FWD, BWD), 0.9852, lambda d, f, b: F.when(
        f + b > 1, ratio(d, f + b - 1))),
}


def derived(feature: str, value_of: Callable[[str], Column]) -> Column:
    """Value of a derivable feature, given how to read an input; null when not derivable."""
    rule = RULES[feature]
    inputs = [value_of(name) for name in rule.inputs]
    known = inputs[0].isNotNull()
    for value in inputs[1:]:
        known = known & value.isNotNull()
    result = F.when(known, rule.expression(*inputs))
    return F.when(is_finite(result), result)
