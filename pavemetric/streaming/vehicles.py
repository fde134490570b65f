"""State of tiles and vehicles in a stream: the gate by vehicles of a tile, event-time order, samples, eviction."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.matching import MAX_GAP_MS, MAX_SPEED, MIN_VEHICLES
from .lines import line_store

#: Stateful processors need this store, which spills to disk.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: a vehicle is forgotten after so long without a fix (ms).
IDLE_MS = 300_000
EVENTS = "vehicle_id long, segment_id long, time_ms long, speed double, from_node long, to_node long, from_ms long"
OPENED = "vehicle_id long, event_time timestamp, event_ms long, x int, y int, until_ms long"
#: Until when a tile is open that doesn't close again, and what stands there in a fix.
ALWAYS, NO_WORD = 1 << 62, -1


class Gate(StatefulProcessor):
    """By tile: which vehicles have been there within idle_ms, and from min_vehicles on, word to them that it is open.

    In come visits, a row for a vehicle's first fix in a tile in a while; so a tile's rows grow with its vehicles, not with their
    fixes. Word says until when the tile stays open if nobody else comes. It goes to each vehicle at its own visit, and to all that
    are there when the tile opens, or when the time has moved on by half of idle_ms since they all heard of it.
    """

    def __init__(self, min_vehicles: int, idle_ms: int | None):
        self.min_vehicles, self.idle_ms = min_vehicles, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "vehicle_id long", "last_ms long")
        self.told = handle.getValueState("told", "until_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        visits: list[tuple[int, int]] = []
        for batch in rows:
            visits += zip(batch["event_ms"].tolist(), batch["vehicle_id"].tolist(), strict=True)
        visits.sort()
        seen = {k[0]: v[0] for k, v in self.seen.iterator()}
        # the vehicles that came last, as many as are needed, the latest first
        latest = heapq.nlargest(self.min_vehicles, ((last, v) for v, last in seen.items()))
        told = self.told.get()[0] if self.told.exists() else -1
        out: dict[int, tuple[int, int]] = {}
        for t, vehicle in visits:
            if seen.get(vehicle, -1) < t:
                seen[vehicle] = t
                self.seen.updateValue((vehicle,), (t,))
                latest = heapq.nlargest(self.min_vehicles, [(t, vehicle), *(x for x in latest if x[1] != vehicle)])
            until = -1 if len(latest) < self.min_vehicles else ALWAYS if self.idle_ms is None else latest[-1][0] + self.idle_ms
            if until <= t:
                continue
            out[vehicle] = (t, until)
            if told <= t or until - told > (self.idle_ms or 0) // 2:
                out |= {v: (t, until) for v, last in seen.items() if self.idle_ms is None or last + self.idle_ms >= t}
                told = until
        if told >= 0:
            self.told.update((told,))
        if self.idle_ms is not None and visits:
            self.handle.registerTimer(visits[-1][0] + self.idle_ms + 1)
        yield self._word(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Forgets the vehicles that have been away too long."""
        now = timerValues.getCurrentWatermarkInMs()
        for k, v in list(self.seen.iterator()):
            if v[0] + self.idle_ms < now:
                self.seen.removeKey(k)
        yield self._word(key, {})

    def _word(self, key, out: dict[int, tuple[int, int]]) -> pd.DataFrame:  # noqa: ANN001
        n, longs = len(out), (lambda values: pd.Series(list(values), dtype="int64"))
        at = longs(t for t, _ in out.values())
        return pd.DataFrame({"vehicle_id": longs(out), "event_time": pd.to_datetime(at, unit="ms", utc=True), "event_ms": at, "x": pd.Series([key[0]] * n, dtype="int32"), "y": pd.Series([key[1]] * n, dtype="int32"), "until_ms": longs(u for _, u in out.values())})

    def close(self) -> None:
        pass


class Vehicle(StatefulProcessor):
    """By vehicle: its fixes in the order of event time, and the samples that its ways over trip lines give.

    Fixes wait until the watermark has passed them, so those that come within the delay are put in order. One in a tile that isn't
    known to be open waits hold_ms longer for word of it; then it counts as one in a tile with too few vehicles, and no way from or
    to it counts. State, each part typed and by itself: waiting fixes, the last one taken, pending first lines, where and when the
    last sample's segment ended, tiles known to be open. All of it goes idle_ms after the last fix, if given.
    """

    def __init__(self, lines: str, mode: str, gate: bool, hold_ms: int, idle_ms: int | None):
        self.lines, self.limit, self.gate, self.hold_ms, self.idle_ms = lines, MAX_GAP_MS[mode], gate, hold_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "event_ms long, seq long, time_ms long, lon double, lat double, x int, y int")
        self.last = handle.getValueState("last", "event_ms long, time_ms long, lon double, lat double, busy boolean")
        self.waiting = handle.getMapState("waiting", "segment_id long", "time_ms long, dist double, start_node_id long, end_node_id long")
        self.ended = handle.getValueState("ended", "node_id long, time_ms long")
        self.open = handle.getMapState("open", "x int, y int", "until_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = []
        for batch in rows:
            word = batch["until_ms"] != NO_WORD
            for x, y, until in batch.loc[word, ["x", "y", "until_ms"]].itertuples(index=False, name=None):
                if not self.open.containsKey((x, y)) or self.open.getValue((x, y))[0] < until:
                    self.open.updateValue((x, y), (until,))
            new += batch.loc[~word, ["event_ms", "seq", "time_ms", "lon", "lat", "x", "y"]].itertuples(index=False, name=None)
        if new:
            self.queue.appendList(new)
        yield self._take(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield self._take(key, timerValues)

    def _take(self, key, timerValues) -> pd.DataFrame:  # noqa: ANN001, N803
        """Takes the waiting fixes whose time has come, and asks to be called for the next one."""
        now = timerValues.getCurrentWatermarkInMs()
        queue = sorted(map(tuple, self.queue.get())) if self.queue.exists() else []
        known = {tuple(k): v[0] for k, v in self.open.iterator()} if self.gate and queue else {}
        out, taken = [], 0
        last = self.last.get() if self.last.exists() else None
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()} if queue else {}
        before = dict(waiting)
        end = tuple(self.ended.get()) if self.ended.exists() else (None, None)
        ended = end
        for e, _, t, lon, lat, x, y in queue:
            busy = not self.gate or known.get((x, y), -1) > e
            if e > now or (not busy and e + self.hold_ms > now):
                break
            if last is not None and last[4] and busy and 0 <= t - last[1] <= self.limit and (lon, lat) != (last[2], last[3]):
                for when, _, _, _, line in line_store(self.lines).crossings((last[1], last[2], last[3]), (t, lon, lat)):
                    segment = int(line.segment_id)
                    if line.tripline_index == 2 and segment in waiting:
                        start_ms, dist, start_node, segment_end = waiting[segment]
                        waiting = {}
                        seconds = int((when - start_ms) / 1000)
                        speed = abs(float(line.dist) - dist) / seconds if seconds > 0 else math.inf
                        if speed <= MAX_SPEED:
                            jump = end[1] is not None and end[0] != start_node
                            out.append((key[0], segment, start_ms, speed, *((end[0], start_node, end[1]) if jump else (None, None, None))))
                            end = (segment_end, start_ms)
                    elif line.tripline_index == 1:
                        waiting[segment] = (int(when), float(line.dist), int(line.start_node_id), int(line.end_node_id))
            last = (e, t, lon, lat, busy)
            taken += 1
        if taken:
            self.queue.put(queue[taken:]) if queue[taken:] else self.queue.clear()
            self.last.update(last)
            for k in before.keys() - waiting.keys():
                self.waiting.removeKey((k,))
            for k, v in waiting.items():
                if before.get(k) != v:
                    self.waiting.updateValue((k,), v)
            if end != ended:
                self.ended.update(end)
        self._call_again(queue[taken:], known, last, now)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")], dtype=object)
        return frame.astype({c: "Int64" for c in ("vehicle_id", "segment_id", "time_ms", "from_node", "to_node", "from_ms")} | {"speed": "float64"})

    def _call_again(self, queue: list, known: dict, last: tuple | None, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if queue:
            e, _, _, _, _, x, y = queue[0]
            open_ = not self.gate or known.get((x, y), -1) > e
            self.handle.registerTimer(e if e > now or open_ else e + self.hold_ms)
        elif self.idle_ms is not None and last is not None:
            if last[0] + self.idle_ms >= now:
                self.handle.registerTimer(last[0] + self.idle_ms + 1)
            else:
                for state in (self.queue, self.last, self.waiting, self.ended, self.open):
                    state.clear()

    def close(self) -> None:
        pass


def visits(placed: DataFrame, idle_ms: int | None) -> DataFrame:
    """vehicle_id, x, y, event_time: of each vehicle's fixes in a tile the first in each third of idle_ms, or the first of all."""
    keys = ["vehicle_id", "x", "y"]
    slot = F.lit(0) if idle_ms is None else F.floor(F.col("event_ms") / max(idle_ms // 3, 1))
    slotted = placed.select(*keys, "event_time", "event_ms", slot.alias("slot"))
    return slotted.dropDuplicates([*keys, "slot"]) if idle_ms is None else slotted.dropDuplicatesWithinWatermark([*keys, "slot"])


def sample_events(fixes: DataFrame, lines: str, mode: str = "fixed", min_vehicles: int | None = MIN_VEHICLES, delay: str = "1 minute", hold_ms: int = IDLE_MS, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Stream of main samples, each with the nodes and time of the sample before it if they don't follow each other.

    fixes (vehicle_id, seq, event_time, time_ms, lon, lat, x, y): event_time orders them, time_ms is what durations are taken from,
    x and y are the area tile. A fix that comes later than `delay` after a later one of any vehicle is dropped and counted (see
    late_rows). min_vehicles None: no gate.
    """
    spark = fixes.sparkSession
    if not spark.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    timed = fixes.select("vehicle_id", "event_time", F.unix_millis("event_time").alias("event_ms"), "x", "y", "seq", "time_ms", "lon", "lat").withWatermark("event_time", delay)
    rows = timed.withColumn("until_ms", F.lit(NO_WORD).cast("long"))
    if min_vehicles is not None:
        opened = visits(timed, idle_ms).groupBy("x", "y").transformWithStateInPandas(Gate(min_vehicles, idle_ms), OPENED, "append", "EventTime", eventTimeColumnName="event_time")
        # whole numbers, as nulls would make them floats
        none = {"seq": F.lit(0).cast("long"), "time_ms": F.lit(0).cast("long"), "lon": F.lit(0.0), "lat": F.lit(0.0)}
        rows = rows.unionByName(opened.withColumns(none))
    gate = min_vehicles is not None
    return rows.groupBy("vehicle_id").transformWithStateInPandas(Vehicle(lines, mode, gate, hold_ms if gate else 0, idle_ms), EVENTS, "append", "EventTime")


def late_rows(query) -> int:  # noqa: ANN001
    """Rows that a query's stateful operators have dropped because they came after the delay, over the batches that it still knows.

    A late fix counts once as a fix, and once more as a visit if there is a gate.
    """
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
