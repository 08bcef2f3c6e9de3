"""Lab runs: labels by manifest, counts, acceptance, paired comparison of two models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.numbers import count_if, harmonic, ratio, ratio_or_zero, wilson
from netweir.operators.evaluate import attribution, binary_diagnostic, support_warning
from netweir.operators.ranking_metrics import ranking_quality

LABELS = ["BENIGN", "ATTACK"]


def label_by_manifest(flows: DataFrame, manifests: DataFrame) -> DataFrame:
    """Expected binary label of every flow from its run's manifest.

    A run is labelled as a whole or flow by flow; in the latter case a flow matching every
    given selector field is ATTACK and the rest follow the unmatched policy. The manifest
    table has one row per run; Spark decides by its size whether to broadcast it.
    """
    source, target = F.col("selector.source_ip"), F.col("selector.destination_ip")
    ports, protocols = F.col("selector.destination_ports"), F.col("selector.protocols")

    def unset(text):
        return text.isNull() | (text == "")

    def empty(values):
        return values.isNull() | (F.size(values) == 0)

    port = F.col("destination_port").try_cast("double").try_cast("int")
    matches = [
        unset(source) | (F.col("source_ip") == source),
        unset(target) | (F.col("destination_ip") == target),
        empty(ports) | F.array_contains(ports, port),
        empty(protocols) | F.array_contains(protocols, F.col("protocol").cast("string"))]
    any_field = ~(unset(source) & unset(target) & empty(ports) & empty(protocols))
    hit = F.coalesce(reduce(lambda a, b: a & b, matches) & any_field, F.lit(False))
    label = (F.when(F.col("mode") == "run_level_uniform", F.col("manifest_label"))
             .when(hit, "ATTACK")
             .when(F.col("unmatched_policy") == "BENIGN", "BENIGN").otherwise("UNLABELLED"))
    return flows.join(manifests.withColumnRenamed("expected_binary_label", "manifest_label"), "run_id") \
        .withColumn("expected_binary_label", label) \
        .drop("manifest_label", "mode", "unmatched_policy", "selector")


def evaluable(flows: DataFrame) -> DataFrame:
    return flows.where((F.col("validation_status") == "VALID")
                       & F.col("expected_binary_label").isin(LABELS))


def run_confusion(flows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, y_true, y_pred, n) of the evaluable flows."""
    return evaluable(flows).groupBy(
        *groups, F.col("expected_binary_label").alias("y_true"),
        F.col("predicted_label").alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def run_flow_counts(flows: DataFrame) -> DataFrame:
    valid = F.col("validation_status") == "VALID"
    labelled = F.col("expected_binary_label").isin(LABELS)
    return flows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("flow_count"), count_if(valid).alias("valid_flow_count"),
        count_if(~valid).alias("invalid_flow_count"),
        count_if(F.col("expected_binary_label") == "UNLABELLED").alias("unlabelled_flow_count"),
        count_if(valid & labelled).alias("evaluable_flow_count"))


def run_status_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("run_id", F.coalesce(
        "validation_status", F.lit("INGEST_ERROR")).alias("validation_status")).agg(
        F.count(F.lit(1)).alias("n"))


def benign_baseline(flows: DataFrame) -> DataFrame:
    """False positives on the benign flows of each run."""
    conf = run_confusion(flows, ["run_id"]).where(F.col("y_true") == "BENIGN")
    attack = F.coalesce(F.sum(F.when(F.col("y_pred") != "BENIGN", F.col("n"))), F.lit(0))
    return conf.groupBy("run_id").agg(
        F.sum("n").alias("valid_benign_flows"), (F.sum("n") - attack).alias("predicted_benign"),
        attack.alias("predicted_attack"), ratio(attack, F.sum("n")).alias("benign_false_positive_rate"),
        support_warning(F.lit(0), F.sum("n")).alias("rate_support_warning"))


def false_positive_labels(flows: DataFrame) -> DataFrame:
    return run_confusion(flows, ["run_id"]).where(
        (F.col("y_true") == "BENIGN") & (F.col("y_pred") != "BENIGN")).select(
        "run_id", F.col("y_pred").alias("label"), "n")


def run_inventory(flows: DataFrame, floors: dict[str, int] = contract.SUPPORT_FLOORS) -> DataFrame:
    """Counts per run and whether its support reaches the floor of its scenario."""
    valid = F.col("validation_status") == "VALID"
    label = F.col("expected_binary_label")
    counts = flows.groupBy("run_id", "scenario").agg(
        F.count(F.lit(1)).alias("total_flows"), count_if(valid).alias("valid_flows"),
        count_if(valid & label.isin(LABELS)).alias("evaluable_flows"),
        count_if(valid & (label == "ATTACK")).alias("attack_flows"),
        count_if(valid & (label == "BENIGN")).alias("benign_flows"),
        count_if(~label.isin(LABELS)).alias("unlabelled_flows"))
    floor = F.try_element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]),
                             F.col("scenario"))
    support = F.when(F.col("scenario") == "benign", F.col("benign_flows")).otherwise(
        F.col("attack_flows"))
    return counts.withColumn("support", support).withColumn(
        "acceptance", F.when(F.col("support") >= floor, "ACCEPTED").otherwise("INVALID_LOW_SUPPORT"))


def scenario_support(inventory: DataFrame) -> DataFrame:
    """Support of the accepted runs of each scenario. One row per run goes in."""
    return inventory.where(F.col("acceptance") == "ACCEPTED").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("run_count"), F.sum("total_flows").alias("total_flows"),
        F.sum("evaluable_flows").alias("evaluable_flows"),
        F.min("support").alias("min_support"), F.max("support").alias("max_support"),
        F.bround(F.avg("support"), 1).alias("mean_support"),
        F.median("support").alias("median_support"))


def class_distribution(inventory: DataFrame) -> DataFrame:
    """Raw benign and attack flows of the accepted runs, attack also by family."""
    accepted = inventory.where(F.col("acceptance") == "ACCEPTED")
    family = F.when(F.col("scenario") == "portscan", "PortScan").when(
        F.col("scenario") == "ssh", "Brute Force")
    return accepted.select(F.explode(F.filter(F.array(
        F.struct(F.lit("binary").alias("dimension"), F.lit("BENIGN").alias("value"),
                 F.col("benign_flows").alias("n")),
        F.struct(F.lit("binary").alias("dimension"), F.lit("ATTACK").alias("value"),
                 F.col("attack_flows").alias("n")),
        F.struct(F.lit("family").alias("dimension"), family.alias("value"),
                 F.col("attack_flows").alias("n"))),
        lambda s: s["value"].isNotNull())).alias("c")).groupBy("c.dimension", "c.value").agg(
        F.sum("c.n").alias("n"))


def aggregate_runs(flows: DataFrame) -> DataFrame:
    """One row per run that counts: evaluable flows, rates, dominant label."""
    kept = flows.where(~F.col("excluded"))
    conf = run_confusion(kept, ["run_id", "scenario"])
    binary = binary_diagnostic(conf, ["run_id", "scenario"]).select(
        "run_id", "scenario", (F.col("attack_rows") + F.col("benign_rows")).alias("evaluable_flows"),
        F.col("recall").alias("attack_detection_rate"),
        F.col("attack_rows").alias("attack_denominator"), "benign_false_positive_rate",
        F.col("benign_rows").alias("benign_denominator"),
        support_warning(F.col("attack_rows"), F.col("benign_rows")).alias("rate_support_warning"))
    labels = attribution(conf.where(F.col("y_true") == "ATTACK"), ["run_id"]).select(
        "run_id", "dominant_label")
    return binary.join(labels, "run_id", "left")


def model_outcomes(flows: DataFrame, groups: list[str], models: dict[str, Column]) -> DataFrame:
    """Positives of each model per group with their interval.

    On benign scenarios the rate is a false-positive rate, elsewhere a detection rate.
    """
    counts = evaluable(flows).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), *[count_if(c).alias(m) for m, c in models.items()])
    return counts.unpivot([*groups, "n"], list(models), "model", "positives").withColumn(
        "w", wilson(F.col("positives"), F.col("n"))).select(
        *groups, "model", "positives", "n",
        F.when(F.col("scenario") == "benign", "benign_false_positive_rate")
        .otherwise("attack_detection_rate").alias("quantity"),
        F.col("w.point").alias("rate"), F.col("w.low").alias("wilson_low"),
        F.col("w.high").alias("wilson_high"))


def paired_predictions(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Rows scored by both models, side by side."""
    return a.join(b, row_id)


def paired_counts(df: DataFrame, attack: Column, a: Column, b: Column) -> DataFrame:
    """Agreement of two models on attack rows and on benign rows."""
    return df.groupBy(F.when(attack, "attack").otherwise("benign").alias("truth")).agg(
        count_if(a & b).alias("both"), count_if(a & ~b).alias("a_only"),
        count_if(~a & b).alias("b_only"), count_if(~a & ~b).alias("neither"),
        F.count(F.lit(1)).alias("n"))


def _stirling_tail(x: Column) -> Column:
    """lnGamma(x+1) - (x ln x - x + ln(2 pi x) / 2), for x >= 20."""
    return 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)


def _log_half_binomial(n: Column, k: Column) -> Column:
    """ln of C(n, k) / 2**n without overflow or cancellation."""
    ln2 = 0.6931471805599453
    few = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(k, F.lit(19)).cast("int"))),
                      -n * ln2, lambda s, i: s + F.log((n - i + 1) / i))
    d = (n - 2 * k) / n
    many = (-(k * F.log1p(-d) + (n - k) * F.log1p(d))
            - F.log(2 * 3.141592653589793 * k * ((n - k) / n)) / 2
            + _stirling_tail(n) - _stirling_tail(k) - _stirling_tail(n - k))
    return F.when(k == 0, -n * ln2).when(k < 20, few).otherwise(many)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p-value of discordant pairs, null without any.

    Terms fall off faster than geometrically below the smaller count, so beyond ten
    standard deviations they vanish in a double and the sum stops there.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    reach = F.ceil(F.sqrt(n) * 10) + 50
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.least(b, c), reach.cast("long")))
    total = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda s, j: F.struct((s["sum"] + s["term"]).alias("sum"),
                              (s["term"] * (k - j) / (n - k + j + 1)).alias("term")),
        lambda s: s["sum"])
    return F.when(b + c > 0, F.least(
        F.lit(1.0), 2 * F.exp(_log_half_binomial(n, k)) * total))


def pooled_binary(df: DataFrame, attack: Column, flagged: Column, score: str | None = None) -> DataFrame:
    """Binary confusion of a whole pool and the metrics of it, with score intervals of recall and false alarms.

    With a score column also ROC AUC and average precision, null where the pool has one class.
    """
    c = df.agg(count_if(attack & flagged).alias("tp"), count_if(~attack & flagged).alias("fp"),
               count_if(attack & ~flagged).alias("fn"), count_if(~attack & ~flagged).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1_attack = harmonic(ratio(tp, tp + fp), ratio(tp, tp + fn))
    f1_benign = harmonic(ratio(tn, tn + fn), ratio(tn, tn + fp))
    recalls = F.array_compact(F.array(ratio(tp, tp + fn), ratio(tn, tn + fp)))
    recall, alarms = wilson(tp, tp + fn), wilson(fp, fp + tn)
    metrics = c.withColumns({
        "macro_f1": (f1_attack + f1_benign) / 2,
        "balanced_accuracy": F.aggregate(recalls, F.lit(0.0), lambda s, x: s + x) / F.size(recalls),
        "attack_recall": ratio_or_zero(tp, tp + fn),
        "attack_precision": ratio_or_zero(tp, tp + fp), "benign_fpr": ratio(fp, fp + tn),
        "recall_low": recall["low"], "recall_high": recall["high"], "fpr_low": alarms["low"], "fpr_high": alarms["high"]})
    if score is None:
        return metrics
    ranked = ranking_quality(df.select(F.lit(1).alias("_g"), F.col(score).alias("_score"), attack.alias("_attack")), ["_g"],
                             "_score", F.col("_attack"))
    quality = ranked.agg(F.max("roc_auc").alias("roc_auc"), F.max("average_precision").alias("pr_auc"))
    return metrics.join(F.broadcast(quality))


def run_level_partition(runs: DataFrame) -> DataFrame:
    """train or validation by whole run: the last run of each scenario validates.

    One row per run goes in.
    """
    last = Window.partitionBy("scenario").orderBy(F.desc("run_id"))
    return runs.select("scenario", "run_id", F.when(
        F.row_number().over(last) == 1, "validation").otherwise("train").alias("partition"))
