"""Explanation tables: checks per text, rates, summaries and the joined export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.functions import text as T
from netweir.functions.numbers import computed_once, count_if, ratio


def check_explanations(df: DataFrame) -> DataFrame:
    """Adds the findings and the technical checks of every explanation.

    Expects text, decision, confidence and evidence (feature, value, contribution). Where the table has
    them, anomaly_evidence (feature, value, baseline, contribution), anomaly_score and extra_terms (array of
    texts) are evidence too.
    """
    anomaly = F.col("anomaly_evidence") if "anomaly_evidence" in df.columns else None
    score = F.col("anomaly_score") if "anomaly_score" in df.columns else None
    nothing = F.array().cast("array<string>")
    extra = F.coalesce("extra_terms", nothing) if "extra_terms" in df.columns else nothing
    lowered = F.lower(F.coalesce("text", F.lit("")))
    names = F.transform("evidence", lambda e: e["feature"])
    if anomaly is not None:
        names = F.concat(names, F.coalesce(F.transform(anomaly, lambda e: e["feature"]), nothing))
    prepared = computed_once(
        df, _low=lowered, _names=names,
        _numbers=T.evidence_numbers(F.col("evidence"), F.col("confidence"), anomaly, score),
        _evidence_text=F.lower(F.concat_ws(" ", names, extra, F.col("decision"))))
    low, decision = F.col("_low"), F.col("decision")
    own = F.when(decision == "ATTACK", T.mentions_any(low, T.DECISION_TERMS["ATTACK"])).when(
        decision == "BENIGN", T.mentions_any(low, T.DECISION_TERMS["BENIGN"])).otherwise(False)
    other = F.when(decision == "ATTACK", T.mentions_any(low, T.DECISION_TERMS["BENIGN"])).otherwise(
        T.mentions_any(low, T.DECISION_TERMS["ATTACK"]))
    checked = computed_once(
        prepared,
        findings=T.findings(F.col("text"), F.col("_evidence_text"), F.col("_numbers")),
        decision_mentioned=own, opposite_mentioned=other,
        has_evidence_reference=T.mentions_any(low, T.EVIDENCE_TERMS),
        has_caution=T.mentions_any(low, T.CAUTION_TERMS),
        referenced_features=F.filter("_names", lambda n: F.contains(low, F.lower(n))),
        _uncited=T.uncited_numbers(F.coalesce("text", F.lit("")), F.col("_numbers")),
        claims=T.direction_claims(low, F.col("evidence")))
    made = F.filter("claims", lambda c: c["claim"].isNotNull())
    return checked.withColumns({
        "grounded": F.size("findings") == 0, "finding_count": F.size("findings"),
        "high_severity_count": F.size(F.filter("findings", lambda f: f["severity"] == "high")),
        "structure_complete": (F.col("decision_mentioned") | F.contains(low, F.lit("modeli")))
        & F.col("has_evidence_reference") & F.col("has_caution"),
        "numbers_not_in_evidence": F.slice("_uncited", 1, 10),
        "numbers_not_in_evidence_count": F.size("_uncited"),
        "checked_claims": F.size(made),
        "consistent_claims": F.size(F.filter(made, lambda c: c["claim"] == c["expected"])),
        "coverage": ratio(F.size("referenced_features"), F.size("_names")),
    }).drop("_low", "_names", "_numbers", "_evidence_text", "_uncited")


def explanation_rates(checked: DataFrame, groups: list[str]) -> DataFrame:
    """Rates of the checks per group."""
    n = F.count(F.lit(1))
    return checked.groupBy(*groups).agg(
        n.alias("n"), ratio(count_if(F.col("decision_mentioned")), n).alias("consistency_rate"),
        ratio(count_if(F.col("structure_complete")), n).alias("structure_rate"),
        ratio(count_if(F.col("grounded")), n).alias("clean_rate"),
        F.sum("checked_claims").alias("direction_claims"),
        ratio(F.sum("consistent_claims"), F.sum("checked_claims")).alias("direction_rate"),
        F.avg("coverage").alias("mean_coverage"))


def explanation_rows(alarms: DataFrame, flows: DataFrame, explanations: DataFrame) -> DataFrame:
    """Explanations with their alarm and, where it is known, its flow."""
    return explanations.join(alarms.select("alarm_id", "flow_id", "severity"), "alarm_id").join(
        flows.select("flow_id", "predicted_label", "attack_type", "model_name",
                     F.col("confidence").alias("flow_confidence")), "flow_id", "left").withColumn(
        "provider", T.provider_of(F.col("text_model")))


def explanation_summary(rows: DataFrame) -> DataFrame:
    """(dimension, value, explanations, rated, flagged, mean_latency_ms).

    One pass counts per provider, version and rating; a missing latency counts as 0 in the
    mean, which is over all rows.
    """
    latency = F.coalesce("latency_ms", F.lit(0.0))
    cells = rows.groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider"),
                         F.coalesce("prompt_version", F.lit("unknown")).alias("prompt_version"), "rating").agg(
        F.count(F.lit(1)).alias("n"), count_if(~F.col("grounded")).alias("flagged"), F.sum(latency).alias("latency"))
    dims = F.array_compact(F.array(
        F.struct(F.lit("provider").alias("dimension"), F.col("provider").alias("value")),
        F.struct(F.lit("prompt_version").alias("dimension"), F.col("prompt_version").alias("value")),
        F.when(F.col("rating").isNotNull(), F.struct(F.lit("rating").alias("dimension"), F.col("rating").alias("value")))))
    return cells.select(F.explode(dims).alias("d"), "rating", "n", "flagged", "latency").groupBy(
        "d.dimension", "d.value").agg(
        F.sum("n").alias("explanations"),
        F.coalesce(F.sum(F.when(F.col("rating").isNotNull(), F.col("n"))), F.lit(0)).alias("rated"),
        F.sum("flagged").alias("flagged"), (F.sum("latency") / F.sum("n")).alias("mean_latency_ms"))


def latest_rating(events: DataFrame) -> DataFrame:
    """Current rating of every explanation: the last one given."""
    return events.groupBy("explanation_id").agg(F.max_by("rating", F.struct("rated_at", "rating")).alias("rating"))
