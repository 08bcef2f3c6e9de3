"""Incidents of an alarm stream, kept per correlation key.

An alarm joins the latest open incident of its key last seen no earlier than one window
before it, however late it comes; otherwise it opens a new one. Status events close
incidents. Within one batch the rows of a key are taken in event-time order.

A key may hold much of the stream, so alarms are first combined per task into one row per
key and time cell of the window: such alarms always belong to one incident. Where status
events are given, an incident may be closed between two alarms of a cell; then only alarms
of one instant are combined, and a status event of that instant comes before them.

State ends by event time. A call of the processor costs far more than an alarm, so keys are
dealt to a fixed number of buckets. A bucket has one entry for each key, with its incidents
that are not yet past the retention, and a batch reads and writes the entries of its keys.
When the watermark has passed an incident by the retention, a timer of the bucket removes it,
a sixteenth of the retention later at most; an open one goes like a closed one, and a status
event that comes later is passed on by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netweir.functions import contract
from netweir.operators.alarms import rank_of
from netweir.operators.incidents import correlation_key, time_cell

PARTIAL = ("correlation_key string, cell long, first_us long, last_us long, n long, worst int, "
           "destinations array<string>, overflow boolean, incident_no long, status string, at timestamp")
FACTS = ("first_us long, last_us long, n long, worst int, destinations array<string>, truncated boolean, "
         "status string, status_us long, version long")
FIELDS = [f.split()[0] for f in FACTS.split(", ")]
STATE = f"opened long, seen_us long, incidents array<struct<incident_no: long, {FACTS.replace(' ', ': ').replace(',:', ',')}>>"
BUCKETS = 2048  # fixed, as state is found again by it
OUTPUT = f"correlation_key string, incident_no long, {FACTS}"


def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key and cell of what a task holds; status events pass through.

    Of the destinations only the first listed ones and whether there were more can
    matter to an incident.
    """
    limit = contract.TRACKED_DESTINATIONS
    for batch in batches:
        events = batch[batch["status"].notna()]
        if len(events):
            yield pd.DataFrame({
                "correlation_key": events["correlation_key"], "cell": -1, "first_us": events["us"],
                "last_us": events["us"], "n": 0, "worst": 0, "destinations": [[] for _ in range(len(events))],
                "overflow": False, "incident_no": events["incident_no"], "status": events["status"],
                "at": pd.to_datetime(events["us"], unit="us")})
        alarms = batch[batch["status"].isna()].dropna(subset=["correlation_key", "cell"])
        if not len(alarms):
            continue
        keys, named = pd.factorize(alarms["correlation_key"])
        targets, names = pd.factorize(alarms["destination_ip"], sort=True)
        cells, us = alarms["cell"].to_numpy(), alarms["us"].to_numpy()
        order = np.lexsort((targets, us, cells, keys))
        keys, cells, us, targets = keys[order], cells[order], us[order], targets[order]
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1])]))
        ends = np.append(starts[1:], len(keys))
        found = [list(dict.fromkeys(targets[i:j][targets[i:j] >= 0].tolist())) for i, j in zip(starts, ends)]
        yield pd.DataFrame({
            "correlation_key": named[keys[starts]], "cell": cells[starts], "first_us": us[starts], "last_us": us[ends - 1],
            "n": ends - starts, "worst": np.maximum.reduceat(alarms["worst"].to_numpy()[order], starts),
            "destinations": [[names[t] for t in d[:limit]] for d in found], "overflow": [len(d) > limit for d in found],
            "incident_no": None, "status": None, "at": pd.to_datetime(us[ends - 1], unit="us")})


class Latest:
    """The incident last seen, ties by the higher number, among those that pass `usable`.

    A heap of (time, number); entries that are no longer true are dropped when they come up, so an alarm does
    not look at every incident of its key.
    """

    def __init__(self, known: dict[int, dict], usable=lambda facts: True):
        self.known, self.usable = known, usable
        self.heap = [(-facts["last_us"], -no) for no, facts in known.items() if usable(facts)]
        heapify(self.heap)

    def put(self, no: int) -> None:
        if self.usable(self.known[no]):
            heappush(self.heap, (-self.known[no]["last_us"], -no))

    def get(self) -> int | None:
        while self.heap:
            us, no = self.heap[0]
            facts = self.known[-no]
            if facts["last_us"] == -us and self.usable(facts):
                return -no
            heappop(self.heap)
        return None


class Key:
    """What a batch knows of a correlation key."""

    def __init__(self, opened: int, seen: int, incidents: list):
        self.opened, self.seen = opened, seen
        self.known = {facts[0]: dict(zip(FIELDS, facts[1:])) for facts in incidents}
        self.latest = Latest(self.known)
        self.joinable = Latest(self.known, lambda facts: facts["status"] not in contract.CLOSED_STATUSES)
        self.touched, self.unknown = set(), []

    def entry(self) -> tuple:
        return self.opened, self.seen, [(no, *[facts[f] for f in FIELDS]) for no, facts in self.known.items()]


class IncidentProcessor(StatefulProcessor):
    """State of a bucket: of each key the last number, the newest time seen and the incidents."""

    def __init__(self, window_seconds: int, retain_seconds: int, forget_seconds: int | None):
        self.window_us = window_seconds * 1000000
        self.retain_us = retain_seconds * 1000000
        self.forget_us = None if forget_seconds is None else forget_seconds * 1000000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incidents = handle.getMapState("incidents", "correlation_key string", STATE)

    def _wake(self, ends: list[int]) -> None:
        """A timer for the first of the event times, rounded up to a sixteenth of the retention."""
        if ends:
            tick = max(1000, self.retain_us // 16000)
            self.handle.registerTimer(-(-int(min(ends)) // (1000 * tick)) * tick)

    def _ends(self, seen: int, last_us: list[int]) -> list[int]:
        return [us + self.retain_us for us in last_us] + ([] if self.forget_us is None else [seen + self.forget_us])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["first_us", "n"], kind="stable")
        before, keys = self.incidents.exists(), {}
        for name in dict.fromkeys(arrived["correlation_key"]):
            keys[name] = Key(*self.incidents.getValue((name,))) if before and self.incidents.containsKey((name,)) else Key(0, 0, [])
        columns = ["correlation_key", "first_us", "last_us", "n", "worst", "destinations", "overflow", "incident_no", "status"]
        for name, *row in zip(*[arrived[c].tolist() for c in columns]):
            self._take(keys[name], *row)
        ends, out = [], {c: [] for c in ("correlation_key", "incident_no", *FIELDS)}
        for name, found in keys.items():
            self.incidents.updateValue((name,), found.entry())
            ends += self._ends(found.seen, [found.known[no]["last_us"] for no in found.touched])
            changed = [(no, found.known[no]) for no in sorted(found.touched)]
            for no, facts in changed + [(no, {"status": status, "status_us": us}) for no, status, us in found.unknown]:
                out["correlation_key"].append(name)
                out["incident_no"].append(no)
                for f in FIELDS:
                    out[f].append(facts.get(f))
        self._wake(ends)
        if out["incident_no"]:
            yield pd.DataFrame(out).astype({c: "Int64" for c in ("first_us", "last_us", "n", "worst", "version")})

    def _take(self, key: Key, first_us, last_us, n, worst, destinations, overflow, no, status) -> None:
        known = key.known
        key.seen = max(key.seen, last_us)
        if status is not None and status == status:
            no = key.latest.get() if no is None or no != no else int(no)
            if no in known:
                self._set_status(known[no], status, first_us)
                key.joinable.put(no)
                key.touched.add(no)
            elif no is not None and no <= key.opened:
                key.unknown.append((no, status, first_us))
            return
        no = key.joinable.get()
        if no is None or known[no]["last_us"] < first_us - self.window_us:
            key.opened = no = key.opened + 1
            known[no] = {"first_us": first_us, "last_us": last_us, "n": 0, "worst": worst, "destinations": [],
                         "truncated": False, "status": "NEW", "status_us": 0, "version": 0}
        self._join(known[no], first_us, last_us, n, worst, destinations, overflow)
        key.latest.put(no)
        key.joinable.put(no)
        key.touched.add(no)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Removes what is past the retention; a timer is always due for the first of what stays."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last = 1 + FIELDS.index("last_us")
        ends = []
        for name, (opened, seen, incidents) in list(self.incidents.iterator()):
            kept = [tuple(facts) for facts in incidents if facts[last] + self.retain_us > now]
            if not kept and self.forget_us is not None and seen + self.forget_us <= now:
                self.incidents.removeKey(tuple(name))
                continue
            if len(kept) < len(incidents):
                self.incidents.updateValue(tuple(name), (opened, seen, kept))
            ends += [end for end in self._ends(seen, [facts[last] for facts in kept]) if end > now]
        self._wake(ends)
        return iter([])

    @staticmethod
    def _set_status(facts: dict, status: str, us: int) -> None:
        if us >= facts["status_us"]:
            facts["status"], facts["status_us"] = status, us
        facts["version"] += 1

    @staticmethod
    def _join(facts: dict, first_us, last_us, n, worst, destinations, overflow) -> None:
        facts["first_us"] = min(facts["first_us"], first_us)
        facts["last_us"] = max(facts["last_us"], last_us)
        facts["n"] += n
        facts["version"] += 1
        facts["worst"] = max(facts["worst"], worst)
        known = list(facts["destinations"])
        new = [d for d in destinations if d not in known]
        room = contract.TRACKED_DESTINATIONS - len(known)
        facts["destinations"] = known + new[:room]
        facts["truncated"] = bool(facts["truncated"] or len(new) > room or overflow)

    def close(self) -> None:
        pass


def correlate_stream(alarms: DataFrame, lateness: str, retain_seconds: int, window_seconds: int = contract.CORRELATION_WINDOW_SECONDS,
                     status_events: DataFrame | None = None, forget_seconds: int | None = None) -> DataFrame:
    """Changed incidents of every batch (update mode): key, number, extent, counts, status, version.

    ``status_events`` has correlation_key, incident_no, status, changed_at; a null number means the incident
    of the key that was last seen. ``lateness`` is how far the watermark lies behind the newest row; older rows
    are dropped by Spark and counted as such in the query's progress. An incident leaves the state when the
    watermark is ``retain_seconds`` past its last alarm, which must be the window at least: no alarm in time
    can join it then. A later status event comes out with its status only, see ``latest_incidents``. What
    stays of a quiet key is its last number; with ``forget_seconds`` that goes too, and numbers start again.
    Needs the RocksDB state store provider.
    """
    if retain_seconds < window_seconds or (forget_seconds is not None and forget_seconds < retain_seconds):
        raise ValueError("retention must be the window at least, and forgetting no earlier than retention")
    rows = alarms.select(
        correlation_key(F.col("source_ip"), F.col("attack_type")).alias("correlation_key"),
        (time_cell(F.col("created_at"), window_seconds) if status_events is None else F.unix_micros("created_at")).cast(
            "long").alias("cell"), F.unix_micros("created_at").alias("us"),
        rank_of(F.col("severity"), contract.SEVERITIES).cast("int").alias("worst"), "destination_ip",
        F.lit(None).cast("long").alias("incident_no"), F.lit(None).cast("string").alias("status"))
    if status_events is not None:
        rows = rows.unionByName(status_events.select(
            "correlation_key", F.lit(-1).cast("long").alias("cell"), F.unix_micros("changed_at").alias("us"),
            F.lit(0).alias("worst"), F.lit(None).cast("string").alias("destination_ip"), "incident_no", "status"))
    return rows.mapInPandas(combine, PARTIAL).withWatermark("at", lateness).withColumn(
        "bucket", F.pmod(F.xxhash64("correlation_key"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=IncidentProcessor(window_seconds, retain_seconds, forget_seconds), outputStructType=OUTPUT,
        outputMode="Update", timeMode="EventTime")


def latest_incidents(updates: DataFrame) -> DataFrame:
    """Current incidents from the update rows of a stream: the latest version of each, with its last status.

    A status that came after an incident had left the state has no version; it counts by its time.
    """
    facts = [f for f in FIELDS if f not in ("status", "status_us")]
    return updates.groupBy("correlation_key", "incident_no").agg(
        F.max_by(F.struct(*facts), "version").alias("r"),
        F.max_by(F.struct("status", "status_us"), F.struct("status_us", F.coalesce("version", F.lit(1 << 62)))).alias("s")).select(
        "correlation_key", "incident_no", "r.*", "s.*")
