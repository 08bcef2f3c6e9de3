"""Evaluation of predictions. Everything follows from one confusion table.

The only pass over the predictions is a count per (y_true, y_pred); what comes after
works on at most classes x classes rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweir.functions import contract
from netweir.functions.numbers import count_if, harmonic, ratio, ratio_or_zero
from netweir.functions.ordered import exact_quantiles

BENIGN = contract.BENIGN


def family_of(label: Column) -> Column:
    """Family of an attack label, BENIGN for BENIGN, null for labels outside the taxonomy."""
    pairs = [F.lit(x) for item in contract.LABEL_FAMILY.items() for x in item]
    return F.when(label == BENIGN, BENIGN).otherwise(
        F.try_element_at(F.create_map(*pairs), label))


def with_family(df: DataFrame, label: str, column: str = "family") -> DataFrame:
    return df.withColumn(column, family_of(F.col(label)))


def unmapped_labels(df: DataFrame, label: str) -> DataFrame:
    """Labels of the data that the taxonomy does not know; empty when it is complete."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(
        F.col(label).isNotNull() & family_of(F.col(label)).isNull())


def confusion(df: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(y_true, y_pred, n) with zero cells over the class list.

    Without a list the classes are those seen; with one, any other label is an error.
    """
    counts = df.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        # one row holds all counts, so the rows are read once
        all_counts = counts.agg(
            F.array_sort(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred"))).alias("names"),
            F.map_from_entries(F.collect_list(F.struct(F.struct("y_true", "y_pred"), "n"))).alias("seen"))
        grid = all_counts.select(F.explode("names").alias("y_true"), "names", "seen").select(
            "y_true", F.explode("names").alias("y_pred"), "seen")
        return grid.select("y_true", "y_pred", F.coalesce(F.try_element_at("seen", F.struct("y_true", "y_pred")), F.lit(0)).alias("n"))
    listed = F.col("y_true").isin(classes) & F.col("y_pred").isin(classes)
    checked = counts.withColumn("n", F.when(listed, F.col("n")).otherwise(
        F.raise_error(F.lit("label outside the class list")).cast("long")))
    names = F.array(*[F.lit(c) for c in classes])
    one = df.sparkSession.range(1)
    grid = one.select(F.explode(names).alias("y_true")).select(
        "y_true", F.explode(names).alias("y_pred"))
    return grid.join(checked, ["y_true", "y_pred"], "full").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(conf: DataFrame, classes: list[str]) -> DataFrame:
    """The matrix as a wide table, one row per true label."""
    return conf.groupBy(F.col("y_true").alias("true\\predicted")).pivot(
        "y_pred", classes).agg(F.sum("n")).na.fill(0, classes)


def per_class(conf: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Counts and rates of every class, of each group's matrix where groups are named."""
    keys = groups or []
    parts = conf.select(*keys, F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))).alias("p"))
    sums = parts.groupBy(*keys, "p.label").agg(
        F.sum("p.support").alias("support"), F.sum("p.predicted").alias("predicted"),
        F.sum("p.tp").alias("tp"))
    sums = sums.withColumns({
        "fn": F.col("support") - F.col("tp"), "fp": F.col("predicted") - F.col("tp"),
        "tn": F.sum("support").over(Window.partitionBy(*keys)) - F.col("support") - F.col("predicted") + F.col("tp")})
    rates = sums.withColumns({
        "precision": ratio(F.col("tp"), F.col("predicted")),
        "recall": ratio(F.col("tp"), F.col("support")),
        "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
        "fnr": ratio(F.col("fn"), F.col("support"))})
    return rates.withColumns({
        "f1": harmonic(F.col("precision"), F.col("recall")),
        "sufficient": F.col("support") >= contract.MIN_CLAIM_SUPPORT})


def _macro(prefix: str = "macro_") -> list[Column]:
    zero = F.lit(0.0)
    return [F.avg(F.coalesce("precision", zero)).alias(f"{prefix}precision"),
            F.avg(F.coalesce("recall", zero)).alias(f"{prefix}recall"),
            F.avg("f1").alias(f"{prefix}f1")]


def overall(classes: DataFrame) -> DataFrame:
    """Accuracy and macro and weighted averages; undefined rates count as 0."""
    n, zero = F.sum("support"), F.lit(0.0)

    def weighted(c):
        return ratio_or_zero(F.sum(F.coalesce(c, zero) * F.col("support")), n)

    return classes.agg(
        n.alias("rows"), ratio(F.sum("tp"), n).alias("accuracy"), *_macro(),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"))


def macro_f1_at_support(classes: DataFrame, floor: int = contract.MIN_CLAIM_SUPPORT) -> DataFrame:
    """Macro F1 over classes with enough support, and the classes left out or absent."""

    def names(condition):
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("label")))), ",")

    support = F.col("support")
    return classes.agg(
        F.avg(F.when(support >= floor, F.col("f1"))).alias("macro_f1_min_support"),
        names(support >= floor).alias("sufficient_classes"),
        names((support > 0) & (support < floor)).alias("insufficient_classes"),
        names(support == 0).alias("absent_classes"))


def binary_view(conf: DataFrame) -> DataFrame:
    """Attack recall (attack rows not called benign) and benign false-positive rate."""
    attack, called = F.col("y_true") != BENIGN, F.col("y_pred") != BENIGN

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return conf.agg(
        total(attack).alias("attack_rows"), total(~attack).alias("benign_rows"),
        ratio(total(attack & called), total(attack)).alias("attack_recall"),
        ratio(total(~attack & called), total(~attack)).alias("benign_false_positive_rate"))


def binary_diagnostic(conf: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Binary counts and rates of a confusion table; null where the denominator is 0."""
    attack, called = F.col("y_true") != BENIGN, F.col("y_pred") != BENIGN

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    cells = conf.groupBy(*(groups or [])).agg(
        total(attack & called).alias("tp"), total(~attack & called).alias("fp"),
        total(attack & ~called).alias("fn"), total(~attack & ~called).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.withColumns({
        "attack_rows": tp + fn, "benign_rows": tn + fp,
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": harmonic(ratio(tp, tp + fp), ratio(tp, tp + fn)),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "benign_false_positive_rate": ratio(fp, fp + tn),
        "attack_miss_rate": ratio(fn, tp + fn)})


def class_sets(train_labels: DataFrame, test_labels: DataFrame) -> DataFrame:
    """Every label of either side with ``in_train`` and ``in_test``."""
    train = train_labels.select("label").distinct().withColumn("in_train", F.lit(True))
    test = test_labels.select("label").distinct().withColumn("in_test", F.lit(True))
    return train.join(test, "label", "full").select(
        "label", F.coalesce("in_train", F.lit(False)).alias("in_train"),
        F.coalesce("in_test", F.lit(False)).alias("in_test"))


def _with_train(classes: DataFrame, train_labels: DataFrame) -> DataFrame:
    train = train_labels.select("label").distinct().withColumn("in_train", F.lit(True))
    return classes.join(train, "label", "full").withColumns({
        "in_train": F.coalesce("in_train", F.lit(False)),
        "support": F.coalesce("support", F.lit(0)), "tp": F.coalesce("tp", F.lit(0)),
        "f1": F.coalesce("f1", F.lit(0.0))})


def temporal_variants(classes: DataFrame, train_labels: DataFrame,
                      floor: int = contract.MIN_CLAIM_SUPPORT) -> DataFrame:
    """Macro metrics and restricted accuracy over four class sets of a temporal test."""
    in_test = F.col("support") > 0
    members = F.array(
        F.struct(F.lit("test").alias("name"), in_test.alias("member")),
        F.struct(F.lit("seen").alias("name"), (in_test & F.col("in_train")).alias("member")),
        F.struct(F.lit("union").alias("name"), (in_test | F.col("in_train")).alias("member")),
        F.struct(F.lit("supported").alias("name"), (F.col("support") >= floor).alias("member")))
    exploded = _with_train(classes, train_labels).withColumn("s", F.explode(members))
    keep = F.col("s.member")

    def mean(column):
        return F.avg(F.when(keep, F.coalesce(column, F.lit(0.0))))

    return exploded.groupBy(F.col("s.name").alias("class_set")).agg(
        count_if(keep).alias("n_classes"),
        mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"),
        mean("f1").alias("macro_f1"),
        ratio(F.sum(F.when(keep, F.col("tp"))), F.sum(F.when(keep, F.col("support"))))
        .alias("restricted_accuracy"))


def unseen_report(classes: DataFrame, train_labels: DataFrame) -> DataFrame:
    """Test classes without a training row, their rows and share."""
    flagged = _with_train(classes, train_labels)
    unseen = (F.col("support") > 0) & ~F.col("in_train")
    rows = F.coalesce(F.sum(F.when(unseen, F.col("support"))), F.lit(0))
    return flagged.agg(
        F.array_join(F.array_sort(F.collect_list(F.when(unseen, F.col("label")))), ",")
        .alias("unseen_classes"), count_if(unseen).alias("n_unseen"),
        rows.alias("unseen_rows"),
        ratio_or_zero(rows, F.sum("support")).alias("unseen_fraction"))


def detection_report(conf: DataFrame, groups: list[str]) -> DataFrame:
    """Held-out attack rows: how many were flagged as any attack."""
    called = F.coalesce(F.sum(F.when(F.col("y_pred") != BENIGN, F.col("n"))), F.lit(0))
    support = F.sum("n")
    return conf.groupBy(*groups).agg(support.alias("support"), called.alias("detected")).where(
        F.col("support") > 0).withColumns({
            "detection_rate": ratio(F.col("detected"), F.col("support")),
            "miss_rate": ratio(F.col("support") - F.col("detected"), F.col("support"))})


def attribution(conf: DataFrame, groups: list[str], expected_label: str | None = None,
                expected_family: str | None = None) -> DataFrame:
    """Labels and families given to flagged rows: the dominant ones and their share.

    A tie between labels goes to the first in alphabetical order, a tie between families
    to the family of the earliest such label. The optional columns name what would have
    been right.
    """
    flagged = conf.where(F.col("y_pred") != BENIGN).groupBy(*groups, "y_pred").agg(
        F.sum("n").alias("n")).where(F.col("n") > 0)
    family = F.coalesce(family_of(F.col("y_pred")), F.lit("unmapped"))
    flagged = flagged.withColumn("_family", family)
    whole = Window.partitionBy(*groups)
    by_family = Window.partitionBy(*groups, "_family")
    ranked = flagged.withColumns({
        "_total": F.sum("n").over(whole), "_family_n": F.sum("n").over(by_family),
        "_family_first": F.min("y_pred").over(by_family)})
    top_label = F.min_by("y_pred", F.struct(-F.col("n"), F.col("y_pred")))
    top_family = F.min_by("_family", F.struct(-F.col("_family_n"), F.col("_family_first")))
    report = ranked.groupBy(*groups).agg(
        F.first("_total").alias("attack_predictions"),
        top_label.alias("dominant_label"), ratio(F.max("n"), F.first("_total")).alias("dominant_label_share"),
        top_family.alias("dominant_family"),
        ratio(F.max("_family_n"), F.first("_total")).alias("dominant_family_share"),
        *([ratio(F.coalesce(F.sum(F.when(F.col("y_pred") == expected_label, F.col("n"))), F.lit(0)),
                 F.first("_total")).alias("label_attribution_rate")] if expected_label else []),
        *([ratio(F.coalesce(F.sum(F.when(F.col("_family") == expected_family, F.col("n"))), F.lit(0)),
                 F.first("_total")).alias("family_attribution_rate")] if expected_family else []))
    return report


def known_class_metrics(classes: DataFrame, known: DataFrame) -> DataFrame:
    """Macro metrics over the classes still in training."""
    kept = classes.join(known.select("label").distinct(), "label", "left_semi")
    return kept.agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum("support").alias("rows"), *_macro(),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy_over_known_rows"))


def fold_report(conf: DataFrame, train_labels: DataFrame) -> DataFrame:
    """One row per learner and held-out family of leave-one-family-out folds.

    conf: (learner, held_out, y_true, y_pred, n), the confusion table of the whole test side in each fold;
    rows with an empty held_out are those of the model that saw every family. train_labels: (label) of the
    training side before any family is removed.

    Detection and attribution are over the held-out rows, the binary counts over all test rows, the known-class
    metrics over the classes still in training; ``base_*`` are those of the full model over the same classes.
    Labels outside the taxonomy belong to no family.
    """
    keys = ["learner", "held_out"]
    folds = conf.where("held_out <> ''")
    held = folds.where(family_of(F.col("y_true")) == F.col("held_out"))
    report = folds.select(*keys).distinct().join(detection_report(held, keys), keys, "left").join(
        attribution(held, keys).select(*keys, "dominant_label", "dominant_label_share", "dominant_family"), keys, "left")
    binary = binary_diagnostic(folds, keys)
    report = report.join(binary.select(*keys, "benign_rows", "attack_rows", F.col("recall").alias("attack_recall"),
                                       F.col("precision").alias("attack_precision"), "benign_false_positive_rate"), keys)
    family = family_of(F.col("label"))
    known = folds.select(*keys).distinct().join(F.broadcast(train_labels.select("label").distinct())).where(
        family.isNull() | (family != F.col("held_out")))

    def over_known(classes, on, prefix):
        zero = F.lit(0.0)
        return known.join(classes, on, "left").groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{prefix}classes"), F.coalesce(F.sum("support"), F.lit(0)).alias(f"{prefix}rows"),
            F.avg(F.coalesce("precision", zero)).alias(f"{prefix}macro_precision"),
            F.avg(F.coalesce("recall", zero)).alias(f"{prefix}macro_recall"), F.avg(F.coalesce("f1", zero)).alias(f"{prefix}macro_f1"),
            ratio(F.sum("tp"), F.sum("support")).alias(f"{prefix}accuracy"))

    full = conf.where("held_out = ''")
    base = over_known(per_class(full, ["learner"]), ["learner", "label"], "base_").drop("base_classes", "base_rows")
    base_fpr = binary_diagnostic(full, ["learner"]).select("learner", F.col("benign_false_positive_rate").alias("base_benign_false_positive_rate"))
    report = report.join(over_known(per_class(folds, keys), [*keys, "label"], "known_"), keys, "left").join(base, keys, "left").join(
        base_fpr, "learner", "left")
    return report.withColumn("tier", support_tier(F.coalesce("support", F.lit(0))))


def matched_baseline(conf: DataFrame, known: DataFrame) -> DataFrame:
    """Metrics of an older matrix restricted to the surviving classes, with its benign rate."""
    return known_class_metrics(per_class(conf), known).join(
        binary_view(conf).select("benign_false_positive_rate"))


def support_tier(support: Column) -> Column:
    return F.when(support >= 1000, "high").when(support >= 100, "moderate").otherwise("low_exploratory")


def support_by_family(df: DataFrame, label: str, split: str) -> DataFrame:
    """Rows per attack family, train and held-out, with the support tier of the latter."""
    counts = df.groupBy(family_of(F.col(label)).alias("family")).agg(
        F.count(F.lit(1)).alias("total_support"),
        count_if(F.col(split) == "train").alias("train_support"),
        count_if(F.col(split) == "test").alias("test_support"))
    return counts.where(F.col("family").isNotNull() & (F.col("family") != BENIGN)).withColumn(
        "tier", support_tier(F.col("test_support")))


def family_summary(folds: DataFrame) -> DataFrame:
    """Over models: mean, median and range of detection, most common dominant label.

    ``folds`` has family, model_order, detection_rate, dominant_label; a tie of labels
    goes to the model that comes first. One row per family and model: a small table.
    """
    rates = folds.groupBy("family").agg(
        F.count(F.lit(1)).alias("models"), F.avg("detection_rate").alias("mean_detection"),
        F.median("detection_rate").alias("median_detection"),
        F.min("detection_rate").alias("min_detection"),
        F.max("detection_rate").alias("max_detection"))
    labels = folds.where(F.col("dominant_label").isNotNull()).groupBy(
        "family", "dominant_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("model_order").alias("first_model"))
    top = labels.groupBy("family").agg(
        F.min_by("dominant_label", F.struct(-F.col("n"), F.col("first_model"))).alias("dominant_label"),
        F.max("n").alias("dominant_models"))
    return rates.join(top, "family", "left")


def support_warning(attack: Column, benign: Column, floor: int = contract.MIN_RATE_SUPPORT) -> Column:
    """Text when a denominator is small but not 0, else null."""
    thin = F.concat_ws(
        "; ",
        F.when((attack > 0) & (attack < floor), F.concat(
            F.lit("attack denominator is "), attack.cast("string"))),
        F.when((benign > 0) & (benign < floor), F.concat(
            F.lit("benign denominator is "), benign.cast("string"))))
    return F.when(thin != "", F.concat(
        thin, F.lit(f" (below {floor}); report raw counts rather than rates alone")))


def prediction_summary(df: DataFrame, label: str, confidence: str) -> DataFrame:
    """Rows, benign and attack predictions, range and median of the confidence."""
    median = exact_quantiles(df.select(F.lit(1).alias("_g"), confidence), ["_g"], confidence, [0.5])
    summary = df.agg(
        F.count(F.lit(1)).alias("support"),
        count_if(F.col(label) == BENIGN).alias("predicted_benign"),
        count_if(F.col(label) != BENIGN).alias("predicted_attack"),
        ratio(count_if(F.col(label) != BENIGN), F.count(F.lit(1))).alias("detection_rate"),
        F.min(confidence).alias("confidence_min"), F.max(confidence).alias("confidence_max"))
    middle = median.agg(F.max(F.element_at("quantiles", 1)).alias("confidence_median"))  # one row, null without confidences
    return summary.join(F.broadcast(middle))


def prediction_distribution(df: DataFrame, label: str) -> DataFrame:
    """(dimension, value, n): rows per predicted label and per attack family."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.lit("label").alias("dimension"), F.col(label).alias("value"), "n")
    families = counts.where(F.col(label) != BENIGN).groupBy(
        F.coalesce(family_of(F.col(label)), F.lit("unmapped")).alias("value")).agg(
        F.sum("n").alias("n")).select(F.lit("family").alias("dimension"), "value", "n")
    return labels.unionByName(families)


def report_violations(classes: DataFrame, summary: DataFrame, claimed_macro_f1: Column | None = None,
                      tolerance: float = 1e-6) -> DataFrame:
    """Broken constraints of a report: bounds, support sum, macro F1 against the matrix.

    ``summary`` is one row like that of ``overall``, possibly from elsewhere.
    """
    bounded = ["accuracy", "macro_precision", "macro_recall", "macro_f1",
               "weighted_precision", "weighted_recall", "weighted_f1"]
    facts = classes.agg(F.sum("support").alias("_support"), F.avg("f1").alias("_macro_f1"))
    claim = F.col("macro_f1") if claimed_macro_f1 is None else claimed_macro_f1
    checks = [F.when((F.col(c) < 0) | (F.col(c) > 1), F.concat(F.lit(c), F.lit(" outside [0,1]")))
              for c in bounded]
    checks.append(F.when(F.col("_support") != F.col("rows"), "support does not add up to rows"))
    checks.append(F.when(F.abs(claim - F.col("_macro_f1")) > tolerance,
                         "macro_f1 differs from the matrix"))
    return summary.join(facts).select(F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def compare_models(base: DataFrame, other: DataFrame, metrics: list[str]) -> DataFrame:
    """Metric by metric: both values, difference and relative change, per model."""

    def long(df, name):
        return df.unpivot(["model"], metrics, "metric", name)

    return long(base, "base").join(long(other, "other"), ["model", "metric"]).withColumns({
        "difference": F.col("other") - F.col("base"),
        "relative_pct": ratio(F.col("other") - F.col("base"), F.col("base")) * 100})


def compare_classes(base: DataFrame, other: DataFrame, train_labels: DataFrame) -> DataFrame:
    """Per class: F1 of both runs and how it held up in the second."""
    train = train_labels.select("label").distinct().withColumn("_trained", F.lit(True))
    joined = other.where(F.col("support") > 0).select(
        "label", "support", F.col("f1").alias("other_f1")).join(
        base.select("label", F.col("f1").alias("base_f1")), "label", "left").join(
        train, "label", "left")
    delta = F.col("other_f1") - F.col("base_f1")
    return joined.select(
        "label", "support", "other_f1", "base_f1", delta.alias("delta_f1"),
        F.when(F.col("_trained").isNull(), "unseen")
        .when(F.col("support") < contract.MIN_CLAIM_SUPPORT, "low support")
        .when(delta < -0.30, "collapse").when(delta < -0.05, "moderate degradation")
        .otherwise("stable").alias("status"))


def stored_vs_recomputed(stored: DataFrame, recomputed: DataFrame, fields: list[str],
                         not_comparable: tuple[str, ...] = ("avg_latency_ms",)) -> DataFrame:
    """Difference per field of registered and recomputed results, both keyed by model."""
    left = stored.unpivot(["model"], fields, "field", "stored")
    right = recomputed.unpivot(["model"], fields, "field", "recomputed")
    return left.join(right, ["model", "field"]).where(
        F.col("stored").isNotNull() & F.col("recomputed").isNotNull()).withColumns({
            "difference": F.col("recomputed") - F.col("stored"),
            "comparable": ~F.col("field").isin(*not_comparable)})
