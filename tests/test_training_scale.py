"""How often training and calibration read their rows, and that they give what plainer forms give."""

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from netweir.functions import draws
from netweir.operators import balance, drift, models
from netweir.plans import training

LABELS = ["BENIGN", "DoS Hulk", "PortScan", "DDoS", "Bot"]


def counted(spark, df):
    passed = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            passed.add(len(batch))
            yield batch

    return df.mapInPandas(run, df.schema), passed


def labelled(spark, n):
    pick = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % len(LABELS))
    return spark.range(n).select(
        F.col("id").cast("string").alias("row_id"), F.array(*[F.lit(x) for x in LABELS])[pick].alias("label"),
        (F.col("id") % 2 * 10 + F.col("id") % len(LABELS)).cast("double").alias("f0"), (F.col("id") % 11).cast("double").alias("f1"))


def test_calibration_reads_its_rows_a_few_times_and_draws_the_same(spark):
    rows = labelled(spark, 6000)
    some, passed = counted(spark, rows)
    reference = spark.createDataFrame([(f, [m * i / 100 for i in range(101)]) for f, m in (("f0", 14.0), ("f1", 10.0))],
                                      "feature string, quantiles array<double>")
    got = drift.calibrate_thresholds(some, reference, ["f0", "f1"], "row_id", 42, [50, 100], 5).collect()
    assert len(got) == 4 and passed.value <= 4 * 6000
    drawn = drift.calibration_draws(rows, "row_id", [50, 5000], 5, 42).select("window_size", "draw_no", "row_id")
    sizes = {tuple(r)[:2]: r["n"] for r in drawn.groupBy("window_size", "draw_no").agg(F.count_distinct("row_id").alias("n")).collect()}
    assert sizes == {(w, d): w for w in (50, 5000) for d in range(5)}
    key = draws.draw_key(F.concat_ws("|", F.col("draw_no").cast("string"), F.col("row_id")), 42)
    offer = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), F.lit("50"), "row_id")), 1, 8), 16, 10).cast("long") % 5).cast("int")
    plain = rows.withColumn("draw_no", offer).where("draw_no = 3").orderBy(key).limit(50)
    assert {r.row_id for r in plain.collect()} == {r.row_id for r in drawn.where("window_size = 50 AND draw_no = 3").collect()}


def test_boosting_reads_its_rows_as_often_whatever_the_rounds_and_classes(spark):
    for several in (False, True):
        rows = models.assemble(labelled(spark, 2000), ["f0", "f1"])
        if not several:
            rows = rows.withColumn("label", F.when(F.col("label") == "BENIGN", "BENIGN").otherwise("ATTACK"))
        for rounds in (1, 4):
            some, passed = counted(spark, rows)
            fitted = models.train_boosted(some, rounds=rounds, depth=3)
            assert passed.value <= 4 * 2000
        scored = models.score(rows, fitted)
        assert scored.columns == [*rows.columns, "predicted_label", "confidence"]
        assert scored.where("label <> predicted_label").count() == 0


def test_boosting_on_cells_gives_the_trees_of_all_rows(spark):
    noisy = F.when(F.col("id") % 13 < 3, F.col("id") % 2).otherwise((F.col("id") % 7 > 3).cast("long"))
    rows = spark.range(3000).select(
        F.when(noisy == 1, "ATTACK").otherwise("BENIGN").alias("label"),
        F.array((F.col("id") % 7).cast("double"), (F.col("id") % 10 / 4).cast("double")).alias("vector"),
        (F.col("id") % 3 + 1.0).alias("weight"))
    for weight in (None, "weight"):
        fitted = models.train_boosted(rows, rounds=3, depth=3, weight=weight)
        plain = GBTClassifier(featuresCol="ml_vector", labelCol="label_index", maxIter=3, maxDepth=3, seed=42)
        prepared = fitted["labels"].transform(models._with_vector(rows))
        raw = (plain.setWeightCol(weight) if weight else plain).fit(prepared).transform(prepared)
        both = models.score(raw.select("label", "vector", "prediction", F.col("probability").alias("p")).withColumnRenamed("prediction", "raw"), fitted)
        names = fitted["labels"].labels
        assert both.where(F.col("predicted_label") != F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("raw") + 1).cast("int"))).count() == 0
        for r in both.select("vector", "p", "confidence").distinct().collect():
            assert math.isclose(r["p"].toArray().max(), r["confidence"], abs_tol=1e-9)


def test_bins_tell_few_values_apart_and_bound_many(spark):
    rows = spark.range(5000).select(F.array((F.col("id") % 3).cast("double"), F.lit(2.0), F.col("id").cast("double")).alias("vector"))
    bounds = models.bin_features(rows).getSplitsArray()
    assert bounds[0][1:-1] == [1.0, 2.0] and len(bounds[1]) == 3 and len(bounds[2]) == models.BINS + 1


def test_training_reads_its_rows_a_few_times(spark):
    some, passed = counted(spark, labelled(spark, 2000))
    _, conf = training.train_evaluate(some, training.TrainingConfig(["f0", "f1"], benign_cap=100, learner_options={"trees": 2, "depth": 3}))
    assert sum(r["n"] for r in conf.collect()) == 400
    assert passed.value <= 8 * 2000


def test_folds_read_their_rows_as_often_whatever_the_families_and_learners(spark):
    seen = []
    for families, learners in ((["DoS"], ["forest"]), (["DoS", "PortScan", "Bot"], ["forest", "boosted"])):
        some, passed = counted(spark, labelled(spark, 2000))
        options = {"forest": {"trees": 2, "depth": 3}, "boosted": {"rounds": 1, "depth": 2}}
        conf = training.fold_confusions(some, families, [
            training.TrainingConfig(["f0", "f1"], x, benign_cap=100, learner_options=options[x]) for x in learners]).collect()
        assert {(r.learner, r.held_out) for r in conf} == {(x, f) for x in learners for f in ["", *families]}
        assert all(r.rows_left == 0 for r in conf) and sum(r.n for r in conf) == 400 * len(learners) * (1 + len(families))
        removed = [r for r in conf if r.held_out == "DoS"]
        assert any(r.y_true == "DoS Hulk" for r in removed) and all(r.y_pred != "DoS Hulk" for r in removed)
        seen.append(passed.value)
    assert seen[0] == seen[1]


def test_a_draw_leaves_uncapped_classes_whole(spark):
    rows = labelled(spark, 1000)
    kept = balance.undersample(rows, balance.balance_plan(rows, "label", 120), "label", "row_id", 1, keep=training.written)
    counts = {r.label: r["count"] for r in kept.groupBy("label").count().collect()}
    assert counts.pop("BENIGN") == 120 and kept.columns == rows.columns
    assert counts == {r.label: r["count"] for r in rows.where("label <> 'BENIGN'").groupBy("label").count().collect()}


def test_the_calibration_query_takes_its_whole_grid(spark, monkeypatch):
    from netweir.plans.catalog import QUERIES
    asked = {}
    draw = drift.calibration_draws
    monkeypatch.setattr(drift, "calibration_draws", lambda df, row_id, windows, draws, seed: asked.update(
        windows=windows, draws=draws) or draw(df, row_id, windows, 2, seed))
    found = QUERIES["calibrate_thresholds"](spark, "/root/testdata/sf0.001")
    assert asked == {"windows": [200, 500, 1000, 2000], "draws": 200}
    assert {r.window_size for r in found.select("window_size").distinct().collect()} == set(asked["windows"])
