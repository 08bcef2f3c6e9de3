"""Flows of a packet stream: conversations without a silence over the idle timeout.

A flow is written once, when the watermark has passed its last packet by the timeout and no packet in time
can belong to it. Until then a conversation keeps one row of sums per time cell of the timeout's length:
packets of one cell are of one flow, so tasks combine them before the keyed state, and late packets find
their cell. The first packet of a flow gives its forward direction, which is known when the flow ends; sums
are kept by end point until then. The state of a silent conversation goes with its last flow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netweir.operators.packets import IDLE_SECONDS, MICROS, TRANSPORTS, flow_key

SUMS = ["packets_a", "packets_b", "bytes_a", "bytes_b"]
CELL = f"first_us long, first_id long, first_end string, last_us long, {', '.join(f'{s} long' for s in SUMS)}"
FIELDS = [f.split()[0] for f in CELL.split(", ")]
FLOW = ("flow_key string, source string, start_us long, end_us long, packets long, bytes long, fwd_packets long, "
        "bwd_packets long, fwd_bytes long, bwd_bytes long")


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per conversation and cell of what a task's batch holds."""
    keys = ["flow_key", "cell"]
    for batch in batches:
        batch = batch.sort_values(["time_us", "packet_id"])
        batch["packets_a"] = (batch["end"] == batch["end_a"]).astype("int64")
        batch["packets_b"] = 1 - batch["packets_a"]
        batch["bytes_a"], batch["bytes_b"] = batch["packets_a"] * batch["length"], batch["packets_b"] * batch["length"]
        cells = batch.groupby(keys, as_index=False).agg(
            first_us=("time_us", "first"), first_id=("packet_id", "first"), first_end=("end", "first"), last_us=("time_us", "last"),
            end_a=("end_a", "first"), **{s: (s, "sum") for s in SUMS})
        yield cells.assign(at=pd.to_datetime(cells["last_us"], unit="us"))


class FlowProcessor(StatefulProcessor):
    """State of a conversation: its cells by number."""

    def __init__(self, idle_seconds: int):
        self.idle_us = idle_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell long", CELL)
        self.end_a = handle.getValueState("end_a", "end_a string")

    def _wake(self, last_us: int) -> None:
        self.handle.registerTimer(-(-(int(last_us) + self.idle_us) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for row in part.itertuples():
                new = {f: getattr(row, f) for f in FIELDS}
                if not self.end_a.exists():
                    self.end_a.update((row.end_a,))
                if self.cells.containsKey((int(row.cell),)):
                    old = dict(zip(FIELDS, self.cells.getValue((int(row.cell),))))
                    first = min((old["first_us"], old["first_id"], old["first_end"]), (new["first_us"], new["first_id"], new["first_end"]))
                    new |= dict(zip(FIELDS, first)) | {s: old[s] + new[s] for s in SUMS}
                    new["last_us"] = max(old["last_us"], new["last_us"])
                self.cells.updateValue((int(row.cell),), tuple(v if isinstance(v, str) else int(v) for v in (new[f] for f in FIELDS)))
                self._wake(new["last_us"])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        found = sorted((no[0], dict(zip(FIELDS, cell))) for no, cell in self.cells.iterator())
        flows: list[list] = []
        for no, cell in found:
            if not flows or cell["first_us"] - flows[-1][-1][1]["last_us"] > self.idle_us:
                flows.append([])
            flows[-1].append((no, cell))
        ended = [f for f in flows if f[-1][1]["last_us"] + self.idle_us <= now]
        out = [self._flow(key[0], [cell for _, cell in f]) for f in ended]
        for no, _ in (c for f in ended for c in f):
            self.cells.removeKey((no,))
        if len(ended) == len(flows):
            self.end_a.clear()
        if out:
            yield pd.DataFrame(out)

    def _flow(self, key: str, cells: list[dict]) -> dict:
        source = cells[0]["first_end"]
        total = {s: sum(c[s] for c in cells) for s in SUMS}
        fwd, bwd = ("a", "b") if source == self.end_a.get()[0] else ("b", "a")
        return {"flow_key": key, "source": source, "start_us": cells[0]["first_us"], "end_us": cells[-1]["last_us"],
                "packets": total["packets_a"] + total["packets_b"], "bytes": total["bytes_a"] + total["bytes_b"],
                "fwd_packets": total[f"packets_{fwd}"], "bwd_packets": total[f"packets_{bwd}"],
                "fwd_bytes": total[f"bytes_{fwd}"], "bwd_bytes": total[f"bytes_{bwd}"]}

    def close(self) -> None:
        pass


def packet_flow_stream(packets: DataFrame, lateness: str, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Ended flows of a packet stream (append mode), each once.

    ``lateness`` is how far the watermark lies behind the newest packet; packets behind it are dropped by
    Spark and counted in the query's progress. What is open when the stream ends is not written. Needs the
    RocksDB state store provider.
    """
    end = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    other = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    kept = packets.where(F.col("protocol").isin(TRANSPORTS)).select(
        flow_key().alias("flow_key"), F.floor(F.col("time_us") / F.lit(idle_seconds * MICROS)).cast("long").alias("cell"),
        "time_us", "packet_id", "length", end.alias("end"), F.least(end, other).alias("end_a"))
    cells = kept.mapInPandas(combine, f"flow_key string, cell long, {CELL}, end_a string, at timestamp")
    return cells.withWatermark("at", lateness).groupBy("flow_key").transformWithStateInPandas(
        statefulProcessor=FlowProcessor(idle_seconds), outputStructType=FLOW, outputMode="Append", timeMode="EventTime")
