"""A live flow table: open flows in Spark's state store, the display beside it.

One stateful operator keeps the flows. Its groups are a capture and a shard of its flow
keys, so a busy capture is many groups, and every shard knows the clock of its capture.
In arrival order, tasks first note on each packet what the clock showed within its block of
positions; all shards are told one clock a block. In event time they are told the latest
clocks. So captures have clocks of their own, a silent flow ends when its capture's
clock says so, and the cost of a batch follows the keys that it touches and the flows that
end in it: open flows wait in the store under the second at which they may be over. A shard
holds the packets of a batch in compact form and works on a bounded slice of them at a time.

Finished flows and frames that came too late are rows of one file stream, each written
once. Open flows, totals and latest packets are read from the store, by anybody, at any
time: :func:`start_display` does it on its own clock, also while no frame comes.
"""

import sys
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.features import flow_features
from ..operators.flows import ELIGIBLE, IDLE_SECONDS, flow_columns, with_flow_key
from ..operators.views import describe_open, packet_details
from ..schema import FLOW_KEY
from ..ship import ship_package

# The process that plans a stateful operator does not get what was shipped to the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Dashboard refresh interval (fixed value).
REFRESH_SECONDS = 0.2
#: How often new packets are taken in by default.
INGEST = "1 second"
#: Groups that the flows of a capture are dealt to.
SHARDS = 16
#: Parts of the idle time by which flows wait; within the last one they wait by the second.
WAITS = 64
#: Blocks of ``1 << BLOCK_BITS`` positions of a capture are put in order by one task each.
BLOCK_BITS = 16
#: Packets of a shard that are worked on at a time.
SLICE = 1 << 15
#: Before any clock.
NEVER = -(1 << 62)

KEY = "ip_version int, src_ip long, dst_ip long, src_ip6 string, dst_ip6 string, src_port int, dst_port int, protocol int"
MEASURES = ("packets", "bytes", "first_seq", "last_seq", "first_us", "last_us", "last_len", "entered", "last_sec")
FLOW = ", ".join(f"{name} long" for name in MEASURES)
FINISHED = f"capture_id string, key string, kind string, {FLOW}"
CAPTURE = "clock long, frames long, latest_seq long, latest string, waits array<long>, timer long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _notes(clocks: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each capture in a batch: the last packet of a flow with the frames' number, and with ``clocks`` the latest frame."""

    def notes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select(["capture_id", "seq", "sec", "eligible"]).to_pandas()
            frame["at"] = np.arange(len(frame))
            places, kinds, frames = [], [], []
            for _, own in frame.groupby("capture_id", dropna=False, sort=False):
                own = own.sort_values("seq", kind="stable")
                latest = [own["at"].loc[own["sec"].idxmax()]] if clocks and own["sec"].notna().any() else []
                flows = own["at"][own["eligible"].to_numpy()]
                places += [*latest, flows.iloc[-1] if len(flows) else own["at"].iloc[-1]]
                kinds += [1] * len(latest) + [2]
                frames += [0] * len(latest) + [len(own)]
            rest = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(kinds, pa.int32()), pa.array(frames, pa.int64())],
                names=[*rest.schema.names, "kind", "frames"],
            )

    return notes


def _read_in_block(frames: pa.Table) -> pa.Table:
    """Of a block of a capture: packets of flows (kind 0) with the block's clock before them, and its clock at the end (1)."""
    frames = frames.sort_by("seq").combine_chunks()
    seq = frames["seq"].to_numpy()
    clock = np.maximum.accumulate(frames["sec"].fill_null(NEVER).to_numpy())
    before = np.searchsorted(seq, seq, "left") - 1
    kind, read = np.zeros(len(seq), np.int32), np.where(before >= 0, clock[before], NEVER)
    told = frames.drop_columns(["block"]).append_column("kind", pa.array(kind)).append_column("read", pa.array(read))
    told = told.filter(frames["key"].is_valid())
    if clock[-1] == NEVER:
        return told
    block = frames["block"][0].as_py()
    end = {"capture_id": frames["capture_id"][0].as_py(), "sec": int(clock[-1]), "kind": 1}
    end["seq"] = None if block is None else ((block + 1) << BLOCK_BITS) - 1
    return pa.concat_tables([told, pa.Table.from_pylist([end], told.schema)])


def _events(packets: DataFrame, shards: int, arrival: bool) -> DataFrame:
    """What the operator is fed: packets of flows (kind 0), clocks (1) and notes on captures (2)."""
    ship_package(packets.sparkSession)
    key = F.to_json(
        F.struct(
            *(F.hex(c).alias(c) if c.endswith("6") else F.col(c) for c in FLOW_KEY if c != "capture_id")
        )
    )
    frames = with_flow_key(packets).select(
        "capture_id", "seq", F.unix_micros("ts").alias("us"), "len", F.unix_seconds("ts").alias("sec"), F.when(F.expr(ELIGIBLE), key).alias("key")
    )
    if arrival:
        layout = "capture_id string, seq long, us long, len long, sec long, key string, kind int, read long"
        blocks = frames.withColumn("block", F.shiftright("seq", BLOCK_BITS)).groupBy("capture_id", "block")
        told = blocks.applyInArrow(_read_in_block, layout)
    else:
        told = frames.where("key IS NOT NULL").selectExpr("*", "0 AS kind", f"{NEVER}L AS read")
    of_key = F.array(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    all_shards = F.sequence(F.lit(0), F.lit(shards - 1))
    told = told.select(
        "capture_id",
        F.explode(F.when(F.col("kind") == 0, of_key).otherwise(all_shards)).alias("shard"),
        "kind",
        "seq",
        "us",
        "len",
        "sec",
        "read",
        "key",
        F.lit(0).cast("long").alias("frames"),
        F.lit(None).cast("string").alias("latest"),
    )
    timed = packets.selectExpr("*", "unix_seconds(ts) AS sec", f"coalesce({ELIGIBLE}, false) AS eligible")
    schema = T.StructType([*timed.schema.fields, *T.StructType.fromDDL("kind int, frames long").fields])
    notes = packet_details(timed.mapInArrow(_notes(not arrival), schema), "kind", "frames", "sec", "eligible")
    details = [c for c in notes.columns if c not in ("kind", "frames", "sec", "eligible")]
    notes = notes.select(
        "capture_id",
        F.explode(F.when(F.col("kind") == 2, F.array(F.lit(-1))).otherwise(all_shards)).alias("shard"),
        "kind",
        "seq",
        F.lit(None).cast("long").alias("us"),
        F.lit(None).cast("long").alias("len"),
        "sec",
        F.lit(None).cast("long").alias("read"),
        F.lit(None).cast("string").alias("key"),
        "frames",
        F.when((F.col("kind") == 2) & F.col("eligible"), F.to_json(F.struct(*details))).alias("latest"),
    )
    return told.unionByName(notes)


#: A packet of a flow as a shard holds it.
PACKET = pa.schema([*((name, pa.int64()) for name in ("seq", "us", "len", "sec", "read")), ("key", pa.large_string())])


def _sorted_out(rows: Iterable[pd.DataFrame]) -> tuple[pa.Table, pd.DataFrame]:
    """Packets among the rows of a group, in compact form, and the other rows."""
    packets, others = [], []
    for part in rows:
        own = part[(part["kind"] == 0) & part["sec"].notna()]
        arrays = [pa.array(own[f.name] if f.name == "key" else own[f.name].astype("int64"), f.type) for f in PACKET]
        packets.append(pa.RecordBatch.from_arrays(arrays, schema=PACKET))
        others.append(part[part["kind"] > 0])
    return pa.Table.from_batches(packets, PACKET).combine_chunks(), pd.concat(others, ignore_index=True)


def _joined(a: list[int], b: list[int], eager: bool) -> list[int]:
    """Two parts of one flow as one."""
    first, last = a if a[2] <= b[2] else b, a if a[3] >= b[3] else b
    sec = max(a[8], b[8]) if eager else last[8]
    return [a[0] + b[0], a[1] + b[1], first[2], last[3], first[4], last[5], last[6], min(a[7], b[7]), sec]


class FlowTable(StatefulProcessor):
    """The open flows of a shard of a capture; of shard -1, what is known of the capture itself.

    A key has one open flow, or, in event time, several; they lie under (key, lane). Every
    flow waits under a second at which it may be over (``due``). When the clock gets there
    it is looked up: it ends, or goes on to wait for its new second.
    """

    def __init__(self, eager: bool, idle: int, delay: int, end_after: float | None):
        self.eager, self.idle, self.delay, self.end_after = eager, idle, delay, end_after
        self.coarse = max(1, idle // WAITS)

    def init(self, handle) -> None:
        self.handle = handle
        self.flows = handle.getMapState("flows", "key string, lane int", f"{FLOW}, lanes int")
        self.due = handle.getMapState("due", "second long", "keys array<string>")
        self.capture = handle.getValueState("capture", CAPTURE)

    def handleInputRows(self, key, rows, timerValues):
        packets, rows = _sorted_out(rows)
        known = self.capture.get() if self.capture.exists() else (None, 0, None, None, [], None)
        clock, frames, latest_seq, latest, waits, timer = known
        if self.end_after is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.end_after)
            self.handle.registerTimer(timer)
        steps = rows[rows["sec"].notna()].sort_values("seq")
        if key[1] < 0:
            frames += int(rows["frames"].sum())
            told = rows[rows["latest"].notna()]
            if len(told) and (latest_seq is None or told["seq"].max() > latest_seq):
                last = told.loc[told["seq"].idxmax()]
                latest_seq, latest = int(last["seq"]), last["latest"]
            clock = max([c for c in (clock, *steps["sec"].astype("int64")) if c is not None], default=None)
        else:
            sweep = _Sweep(self, clock, waits or [])
            places = [packets[c].to_numpy() for c in (("seq", "sec") if self.eager else ("seq",))]
            order = pa.array(np.lexsort(places))
            for start in range(0, max(len(order), 1), SLICE):
                part = packets.take(order[start : start + SLICE]).to_pandas()
                sweep.take(part, steps, start + SLICE >= len(order))
                sweep.end()
                if sweep.done:
                    yield _finished(key[0], sweep.done)
                    sweep.done = []
            clock, waits = sweep.clock, sorted(sweep.waits)
        self.capture.update((clock, frames, latest_seq, latest, list(waits or []), timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """The capture is over: its open flows end, and nothing is kept of it."""
        done = [(k[0], "closed", list(v[:9])) for k, v in self.flows.iterator()]
        for state in (self.flows, self.due, self.capture):
            state.clear()
        if done:
            yield _finished(key[0], done)

    def close(self) -> None:
        pass


class _Sweep:
    """The work of one batch on one shard."""

    def __init__(self, table: FlowTable, clock: int | None, waits: list[int]):
        self.table, self.before, self.clock, self.last = table, clock, clock, clock
        self.waits, self.fresh, self.done = set(waits), {}, []

    def load(self, key: str) -> list[list[int]]:
        """Open flows of a key; the tenth number is the second they wait under."""
        first = self.table.flows.getValue((key, 0))
        if not first:
            return []
        rest = [self.table.flows.getValue((key, lane)) for lane in range(1, first[-1])]
        return [list(flow[:-1]) for flow in (first, *rest)]

    def store(self, key: str, flows: list[list[int]], before: int) -> None:
        for lane, flow in enumerate(flows):
            self.table.flows.updateValue((key, lane), (*flow[:9], len(flows)))
        for lane in range(len(flows), before):
            self.table.flows.removeKey((key, lane))
        for flow in flows:
            self.wait(key, flow[8] + self.table.idle + self.table.delay)

    def wait(self, key: str, due: int) -> None:
        """Look the key up at ``due``: until its part of the idle time has come, at the beginning of that."""
        early = due - due % self.table.coarse
        self.fresh.setdefault(early if self.clock is None or early > self.clock else due, set()).add(key)

    def take(self, packets: pd.DataFrame, steps: pd.DataFrame, whole: bool = True) -> None:
        """Packets, in the order of their mode over all calls; ``steps`` are the clocks of the batch.

        Unless this makes the batch ``whole``, the clock goes as far only as no later packet can be behind it.
        """
        table = self.table
        at, sec = steps["seq"].to_numpy(), np.maximum.accumulate(steps["sec"].to_numpy(np.int64)) if len(steps) else np.zeros(0, np.int64)
        if len(sec):
            self.last = int(sec[-1]) if self.before is None else max(self.before, int(sec[-1]))
        packets = packets[packets["sec"].notna()].sort_values(["sec", "seq"] if table.eager else "seq")
        place = np.searchsorted(at, packets["seq"].to_numpy(), "left") - 1
        least = NEVER if self.before is None else self.before
        # What the clock showed when a packet came.
        entered = np.where(place >= 0, np.maximum(sec[np.maximum(place, 0)], least) if len(sec) else least, least)
        if "read" in packets:
            entered = np.maximum(entered, packets["read"].to_numpy())
        if whole:
            self.clock = self.last
        elif table.eager:
            self.clock = max(least, min(self.last, int(packets["sec"].iloc[-1]) + table.delay))
        elif entered[-1] > NEVER:
            self.clock = int(entered[-1])
        by_key: dict[str, list[list[int]]] = {}
        numbers = (packets[c].astype("int64").tolist() for c in ("seq", "us", "len", "sec"))
        for key, *packet in zip(packets["key"], *numbers, entered.tolist()):
            by_key.setdefault(key, []).append(packet)
        for key, own in by_key.items():
            old = self.load(key)
            flows = [flow[:9] for flow in old]
            for seq, us, length, second, read in own:
                new = [1, length, seq, seq, us, us, length, second if table.eager else read, second]
                flows = self._event(key, flows, new) if table.eager else self._arrival(key, flows, new, read)
            self.store(key, flows, len(old))

    def _arrival(self, key: str, flows: list[list[int]], new: list[int], read: int) -> list[list[int]]:
        if flows and read - flows[0][8] >= self.table.idle:
            self.done.append((key, "closed", flows[0]))
            flows = []
        return [_joined(flows[0], new, False)] if flows else [new]

    def _event(self, key: str, flows: list[list[int]], new: list[int]) -> list[list[int]]:
        if self.before is not None and new[8] < self.before - self.table.delay:
            self.done.append((key, "late", new))
            return flows
        # Packets of a batch come in the order of their seconds: none to come joins what is over by now.
        now = NEVER if self.last is None else min(new[8], self.last - self.table.delay)
        apart = []
        for flow in flows:
            near = new[7] - flow[8] < self.table.idle and flow[7] - new[8] < self.table.idle
            if near:
                new = _joined(flow, new, True)
            elif now - flow[8] >= self.table.idle:
                self.done.append((key, "closed", flow))
            else:
                apart.append(flow)
        return [*apart, new]

    def end(self) -> None:
        """End the flows that the clock is past, and write down what the others wait for."""
        table = self.table
        while self.clock is not None and (now := [s for s in (*self.waits, *self.fresh) if s <= self.clock]):
            for second in set(now):
                keys = self.fresh.pop(second, set())
                if second in self.waits:
                    self.waits.remove(second)
                    keys = keys | set(table.due.getValue((second,))[0])
                    table.due.removeKey((second,))
                for key in keys:
                    flows = self.load(key)
                    over = [f[:9] for f in flows if self.clock - table.delay - f[8] >= table.idle]
                    self.done.extend((key, "closed", f) for f in over)
                    if over:
                        self.store(key, [f[:9] for f in flows if f[:9] not in over], len(flows))
                    else:
                        for f in flows:
                            self.wait(key, f[8] + table.idle + table.delay)
        for second, keys in self.fresh.items():
            if second in self.waits:
                keys = keys | set(table.due.getValue((second,))[0])
            table.due.updateValue((second,), (sorted(keys),))
            self.waits.add(second)
        self.fresh = {}


def _finished(capture, done: list[tuple]) -> pd.DataFrame:
    columns = {"capture_id": [capture] * len(done), "key": [k for k, _, _ in done], "kind": [kind for _, kind, _ in done]}
    columns |= {name: [flow[i] for _, _, flow in done] for i, name in enumerate(MEASURES)}
    return pd.DataFrame(columns)


def start_flow_table(
    packets: DataFrame,
    location: str,
    mode: str = "arrival",
    idle_seconds: int = IDLE_SECONDS,
    delay_seconds: int = 0,
    trigger: dict | None = None,
    end_after_seconds: float | None = None,
    shards: int = SHARDS,
) -> StreamingQuery:
    """Keep the flow table of a packet stream; every capture has its own clock.

    ``mode`` is that of :func:`~flowtide.operators.flows.build_flows`. The batches of a
    stream must follow the arrival order of each capture. In event time (``eager``) a frame
    may come up to ``delay_seconds`` behind its capture's clock as the batch found it; flows
    end that much later, and a frame that is later still makes no flow but a late row.

    ``end_after_seconds`` of wall time without a frame of a capture end it: its open flows
    are finished and its state goes. By default captures never end. ``location`` must be
    shared by all executors; read it with :func:`read_finished_flows`,
    :func:`read_late_frames`, :func:`read_active_flows` and :func:`read_captures_seen`.
    """
    if mode not in ("eager", "arrival"):
        raise ValueError(f"unknown mode {mode!r}: use 'eager' or 'arrival'")
    if mode == "arrival" and delay_seconds:
        raise ValueError("in arrival order no frame is late")
    if end_after_seconds is not None and "availableNow" in (trigger or {}):
        raise ValueError("captures end by the wall clock: use a processing-time trigger")
    table = FlowTable(mode == "eager", idle_seconds, delay_seconds, end_after_seconds)
    finished = (
        _events(packets, shards, mode == "arrival")
        .groupBy("capture_id", "shard")
        .transformWithStateInPandas(table, FINISHED, "Append", "None" if end_after_seconds is None else "ProcessingTime")
    )
    with _store(packets.sparkSession):
        return (
            finished.writeStream.format("parquet")
            .option("path", f"{location}/flows")
            .option("checkpointLocation", f"{location}/checkpoint")
            .trigger(**(trigger or {"processingTime": INGEST}))
            .start()
        )


class _store:
    """The state store that keeps maps, for queries started within."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self):
        self.old = self.spark.conf.get(self.name, None)
        self.spark.conf.set(self.name, STORE)

    def __exit__(self, *_):
        if self.old is None:
            self.spark.conf.unset(self.name)
        else:
            self.spark.conf.set(self.name, self.old)


def _as_flows(rows: DataFrame, closed: bool) -> DataFrame:
    """Rows with ``capture_id``, ``key`` and :data:`MEASURES` as flows."""
    key = F.from_json("key", KEY)
    return flow_columns(
        rows.withColumn("k", key).select(
            "capture_id",
            *(F.unhex(f"k.{c}").alias(c) if c.endswith("6") else F.col(f"k.{c}").alias(c) for c in FLOW_KEY if c != "capture_id"),
            "packets",
            "bytes",
            "first_seq",
            "last_seq",
            "last_len",
            F.timestamp_micros("first_us").alias("first_seen"),
            F.timestamp_micros("last_us").alias("last_seen"),
            F.lit(closed).alias("is_closed"),
        )
    )


def read_finished_flows(spark: SparkSession, location: str) -> DataFrame:
    """Flows that have ended, each once."""
    return _as_flows(spark.read.schema(FINISHED).parquet(f"{location}/flows").where("kind = 'closed'"), True)


def read_features(spark: SparkSession, location: str) -> DataFrame:
    return flow_features(read_finished_flows(spark, location))


def read_late_frames(spark: SparkSession, location: str) -> DataFrame:
    """Packets that came too late for their flow, as flows of one packet."""
    return _as_flows(spark.read.schema(FINISHED).parquet(f"{location}/flows").where("kind = 'late'"), True)


def _state(spark: SparkSession, location: str, variable: str, batch_id: int | None) -> DataFrame:
    reader = spark.read.format("statestore").option("path", f"{location}/checkpoint").option("stateVarName", variable)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    with _store(spark):
        return reader.load()


def read_active_flows(spark: SparkSession, location: str, batch_id: int | None = None) -> DataFrame:
    """Open flows as of a batch that the store still holds, by default the newest."""
    held = _state(spark, location, "flows", batch_id)
    rows = held.select("key.capture_id", "user_map_key.key", "user_map_value.*")
    return describe_open(_as_flows(rows, False))


def read_captures_seen(spark: SparkSession, location: str, batch_id: int | None = None) -> DataFrame:
    """``capture_id``, ``frames`` and the details of the latest packet (``latest``, JSON) of each capture."""
    held = _state(spark, location, "capture", batch_id)
    return held.where("key.shard = -1").select("key.capture_id", "value.frames", "value.latest")


def read_latest_packets(spark: SparkSession, location: str, batch_id: int | None = None) -> DataFrame:
    """Details of the last flow packet of each capture, however long ago it came."""
    seen = read_captures_seen(spark, location, batch_id).where("latest IS NOT NULL")
    return seen.select(F.from_json("latest", DETAILS).alias("p")).select("p.*")


#: Columns of :func:`~flowtide.operators.views.packet_details`.
DETAILS = (
    "capture_id string, seq long, len long, src_mac_text string, dst_mac_text string, ether_type_text string, family string,"
    " src_addr string, dst_addr string, protocol int, ttl int, src_port int, dst_port int, icmp_type int, icmp_code int"
)


@dataclass(frozen=True)
class Tick:
    """What one refresh of the dashboard shows."""

    active: DataFrame
    totals: DataFrame
    latest: DataFrame


class Display(threading.Thread):
    """Shows the table on its own clock until it is stopped; ``failed`` keeps the error that ended it."""

    def __init__(self, spark: SparkSession, location: str, publish: Callable[[Tick], None], refresh_seconds: float):
        super().__init__(daemon=True)
        self.spark, self.location, self.publish, self.refresh_seconds = spark, location, publish, refresh_seconds
        self.over, self.failed = threading.Event(), None

    def run(self) -> None:
        while not self.over.is_set():
            began = time.monotonic()
            try:
                seen = read_captures_seen(self.spark, self.location)
                tick = Tick(read_active_flows(self.spark, self.location), seen.select("capture_id", "frames"), read_latest_packets(self.spark, self.location))
            except Exception as error:  # nothing has been stored so far
                if "batch" not in str(error).lower() and "state" not in str(error).lower():
                    self.failed = error
                    return
                tick = None
            try:
                if tick is not None:
                    self.publish(tick)
            except Exception as error:
                self.failed = error
                return
            self.over.wait(max(0.0, self.refresh_seconds - (time.monotonic() - began)))

    def stop(self) -> None:
        self.over.set()
        self.join()


def start_display(
    spark: SparkSession, location: str, publish: Callable[[Tick], None], refresh_seconds: float = REFRESH_SECONDS
) -> Display:
    """Call ``publish`` with the table below ``location`` every ``refresh_seconds`` at most, frames or not."""
    display = Display(spark, location, publish, refresh_seconds)
    display.start()
    return display
