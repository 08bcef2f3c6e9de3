"""Growing files are read once by byte; detection follows the active model version."""

import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweir.operators import anomaly, models
from netweir.streaming import detect, growing

COLUMNS = ["src", "dst", "bytes"]


def drain(spark, path, number, **options):
    """One run of the query over what is there; its checkpoint is kept for the next."""
    good, _ = growing.follow_capture(growing.growing_lines(spark, str(path / "in"), **options), COLUMNS)
    good.writeStream.option("checkpointLocation", str(path / "cp")).foreachBatch(
        lambda d, n: d.write.mode("overwrite").parquet(str(path / f"out/b={n}"))).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(path / "out")).select(*COLUMNS).collect())


@pytest.mark.parametrize("piece", ["7", "67108864"])
def test_appended_lines_come_once_also_after_a_restart(spark, tmp_path, piece):
    (tmp_path / "in").mkdir()
    file, other = tmp_path / "in/a.csv", tmp_path / "in/b.csv"
    file.write_bytes(b"src,dst,bytes\r\nh1,h2,10\r\nh1,h3,2")
    assert drain(spark, tmp_path, 0, pieceBytes=piece) == [("h1", "h2", "10")]
    with open(file, "ab") as f:
        f.write("0\nshort,line\n\nhé,h2,7\n".encode())
    other.write_bytes(b"src,dst,bytes\nx,y,1\n")
    expected = sorted([("h1", "h2", "10"), ("h1", "h3", "20"), ("hé", "h2", "7"), ("x", "y", "1")])
    assert drain(spark, tmp_path, 1, pieceBytes=piece) == expected
    assert drain(spark, tmp_path, 2, pieceBytes=piece) == expected
    with open(other, "ab") as f:
        f.write(b"x,y,2\nx,y")
    assert drain(spark, tmp_path, 3, pieceBytes=piece) == sorted([*expected, ("x", "y", "2")])


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(b"ab\n\r"[x % 4] for x in b)), st.lists(st.integers(0, 60), max_size=5))
def test_pieces_give_each_ended_line_once(data, cuts):
    edges = sorted({0, len(data), *[min(c, len(data)) for c in cuts]})
    got = [x for a, b in zip(edges, edges[1:]) for x in growing.ended_lines(io.BytesIO(data), a, b)]
    whole, at = data.split(b"\n")[:-1], 0
    for place, line in got:
        assert data[place:place + len(line) + 1] == line + b"\n" and place == at
        at += len(line) + 1
    assert [line for _, line in got] == whole


def make_version(spark, path, name, label):
    rows = spark.range(400).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 40).cast("double").alias("a"),
                                   F.when(F.col("id") % 100 == 99, 90.0).otherwise((F.col("id") % 7).cast("double")).alias("b"))
    table = models.assemble(rows, ["a"]).withColumn("label", F.when(F.col("a") > 30, label).otherwise("BENIGN"))
    trees = anomaly.fit_isolation_forest(rows, ["b"], "row_id", 1, trees=10, sample=64)
    trees.write.parquet(f"{path}/{name}-trees")
    trees = spark.read.parquet(f"{path}/{name}-trees")
    calibration = anomaly.calibrate_anomaly(anomaly.isolation_score(rows, trees, ["b"], ["row_id"], 64), "raw_score").first()
    detect.save_version(f"{path}/models", name, models.train_forest(table, trees=3, depth=3), trees, ["a"], ["b"],
                        calibration["thresholds"][-1]["threshold"], calibration["calibration_quantiles"], 64)


def test_a_new_version_is_taken_up_between_batches(spark, tmp_path):
    path = str(tmp_path)
    make_version(spark, path, "v1", "PortScan")
    make_version(spark, path, "v2", "Bot")
    activations = "model string, activated_at long"
    spark.createDataFrame([("v1", 1)], activations).write.parquet(f"{path}/registry")
    rows = [(i, {"a": a, "b": b} if b is not None else {"a": a}) for i, (a, b) in enumerate(
        [("35", "3"), ("2", "500"), ("2", None), ("2", "inf"), ("x", "3"), ("2", "3")])]
    schema = "id int, features map<string,string>"
    table = spark.createDataFrame(rows, schema)
    table.write.parquet(f"{path}/in/b=0")
    stream = spark.readStream.schema(schema).parquet(f"{path}/in/*")

    def run():
        detect.detect_stream(stream, f"{path}/models", lambda s: detect.newest_version(s, f"{path}/registry"), ["id"], path, f"{path}/cp").awaitTermination()
        return spark.read.parquet(f"{path}/detections").drop("batch"), spark.read.parquet(f"{path}/dead_letters")

    found, dead = run()
    got = {r.id: r for r in found.collect()}
    assert set(got) == {0, 1, 2, 3, 5} and [r.id for r in dead.collect()] == [4]
    assert got[0].prediction == "PortScan" and got[0].model_version == "v1"
    assert got[1].anomaly_available and got[1].prediction == "UNKNOWN" and got[1].anomaly_score == 1.0
    for i in (2, 3):
        assert not got[i].anomaly_available and got[i].raw_score is None and got[i].anomaly_score is None and got[i].prediction == "BENIGN"
    twin, _ = detect.detect(table, detect.load_version(spark, f"{path}/models", "v1"), ["id"])
    assert sorted(map(str, twin.collect())) == sorted(map(str, found.select(twin.columns).collect()))
    spark.createDataFrame([("v2", 2)], activations).write.mode("append").parquet(f"{path}/registry")
    table.withColumn("id", F.col("id") + 10).write.parquet(f"{path}/in/b=1")
    found, _ = run()
    assert {(r.model_version, r.prediction) for r in found.where("id = 10 OR id = 0").collect()} == {("v1", "PortScan"), ("v2", "Bot")}


def test_a_version_is_calibrated_from_scores_made_once(spark, tmp_path, monkeypatch):
    from netweir.plans.catalog import streams
    passed = spark.sparkContext.accumulator(0)
    score = anomaly.isolation_score

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(anomaly, "isolation_score", lambda df, *rest: score(df.mapInArrow(counted, df.schema), *rest))
    sf = "/root/testdata/sf0.001"
    streams.store_models(spark, sf, str(tmp_path))
    benign = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'N'").count()
    assert passed.value == benign == spark.read.parquet(str(tmp_path / "fitted-scores")).count()


def test_scores_walk_each_tree_to_its_leaf():
    stump = {k: np.array(v) for k, v in dict(feature=[-1], threshold=[0.0], left=[-1], right=[-1], length=[3.0]).items()}
    tree = {k: np.array(v) for k, v in dict(feature=[1, -1, 0, -1, -1], threshold=[2.0, 0.0, 5.0, 0.0, 0.0], left=[1, -1, 3, -1, -1],
                                            right=[2, -1, 4, -1, -1], length=[0.0, 1.0, 0.0, 2.0, 4.0]).items()}
    points = np.array([[9.0, 2.0], [5.0, 3.0], [6.0, np.inf], [np.nan, np.nan]])
    lengths = (np.array([1.0, 2.0, 4.0, 4.0]) + 3.0) / 2
    assert anomaly._walk(tree)[3] == 2 and anomaly._walk(stump)[3] == 0
    assert anomaly._scores(points, [tree, stump], 256).tolist() == (-np.power(2.0, -lengths / float(anomaly.expected_path(256)))).tolist()
