"""Times the headline queries and batch scoring; prints one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from netweir.operators import anomaly, models
from netweir.plans.catalog import QUERIES
from netweir.session import build_session
from netweir.sources import adapters

HEADLINE = [
    "incident_top_groups", "alarm_stats", "alarm_groups", "window_sweep", "gap_statistics", "per_class_metrics",
    "temporal_variants", "roc_auc_and_average_precision", "operating_points", "drop_nonfinite", "validate_strict",
    "feature_reference", "compatibility_profile", "stratified_split", "temporal_split", "duplicate_straddle",
    "undersample", "ks_vs_reference", "ks_two_sample", "feature_shift", "groundedness", "explanation_rates",
    "assembled_flows", "paired_predictions", "record_feedback",
]


def timed(frame) -> float:
    start = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def scoring(spark, sf_dir: str) -> dict[str, float]:
    """Seconds to score every row with a forest and with the isolation forest, models ready."""
    rows = adapters.features(spark, sf_dir)
    fitted = models.train_forest(models.assemble(rows, adapters.FEATURE_COLUMNS), trees=20, depth=6)
    trees = anomaly.fit_isolation_forest(rows.where("label = 'BENIGN'"), adapters.FEATURE_COLUMNS, "row_id", 42).cache()
    trees.count()
    spread = models.assemble(rows, adapters.FEATURE_COLUMNS).repartition(
        spark.sparkContext.defaultParallelism).select("row_id", "vector", *adapters.FEATURE_COLUMNS).cache()
    n = spread.count()
    forest = timed(models.score(spread, fitted).select("predicted_label", "confidence"))
    isolation = timed(anomaly.isolation_score(spread, trees, adapters.FEATURE_COLUMNS, ["row_id"]))
    return {"score_forest": forest, "score_isolation": isolation, "forest_flows_per_sec": n / forest,
            "isolation_flows_per_sec": n / isolation}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    timed(QUERIES["class_counts"](spark, sf_dir))  # starts the executors
    seconds = {}
    for name in names:
        seconds[name] = round(timed(QUERIES[name](spark, sf_dir)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    extra = {}
    if not sys.argv[1:]:
        found = scoring(spark, sf_dir)
        seconds |= {k: round(found[k], 3) for k in ("score_forest", "score_isolation")}
        extra = {k: round(v) for k, v in found.items() if k.endswith("per_sec")}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else sf_dir, **extra}))


if __name__ == "__main__":
    main()
