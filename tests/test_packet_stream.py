"""The packet stream: flows end by event time, whatever the batches, and leave no state."""

import random

from pyspark.sql import functions as F

from netweir.operators.packets import assign_flows
from netweir.streaming.packets import packet_flow_stream
from tests.test_io_and_streams import ROCKSDB

SCHEMA = "packet_id long, time_us long, src_ip string, src_port int, dst_ip string, dst_port int, protocol int, length long"
COLUMNS = ["flow_key", "source", "start_us", "end_us", "packets", "bytes", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"]


def packets(n):
    r = random.Random(3)
    rows = []
    for i in range(n):
        pair = ("a", 1000, "b", 80) if r.random() < 0.6 else r.choice([("c", 2000, "b", 80), ("d", 5, "d", 5)])
        if r.random() < 0.4:
            pair = (*pair[2:], *pair[:2])
        at = int(r.choice([0, 700, 1500, 4000]) * 1e6 + r.random() * 400e6)
        rows.append((i, at, *pair, 6 if r.random() < 0.95 else 1, r.randint(40, 1500)))
    return rows


def test_flows_equal_the_batch_form(spark, tmp_path):
    rows = sorted(packets(600), key=lambda p: p[1] // 100_000_000)  # out of order by up to 100 s
    last = [(9999, 9_000_000_000, "z", 1, "y", 2, 17, 50)]
    for i, part in enumerate([rows[:5], rows[5:300], rows[300:301], rows[301:], last, last]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    packet_flow_stream(stream, "110 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(
        lambda d, n: d.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*COLUMNS).collect())
    side = F.col("forward")
    batch = assign_flows(spark.createDataFrame(rows, SCHEMA)).groupBy("flow_id", "flow_key").agg(
        F.min_by(F.concat_ws(":", "src_ip", F.col("src_port").cast("string")), F.struct("time_us", "packet_id")).alias("source"),
        F.min("time_us").alias("start_us"), F.max("time_us").alias("end_us"), F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"),
        F.count_if(side).alias("fwd_packets"), F.count_if(~side).alias("bwd_packets"),
        F.coalesce(F.sum(F.when(side, F.col("length"))), F.lit(0)).alias("fwd_bytes"),
        F.coalesce(F.sum(F.when(~side, F.col("length"))), F.lit(0)).alias("bwd_bytes"))
    assert got == sorted(tuple(r) for r in batch.select(*COLUMNS).collect()) and len(got) > 8
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "cells").load()
    assert state.count() == 1  # the last packet's own
