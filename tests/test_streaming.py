import time

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import model
from flowtide import build_flows, flow_features
from flowtide.schema import FEATURES
from flowtide.streaming import flow_table
from flowtide.sources.csv_export import LineWriter, read_csv_export, start_csv_export
from flowtide.streaming.export import start_export, stream_flow_features, stream_flows
from flowtide.streaming.flow_table import (
    FlowTable,
    _events,
    _Sweep,
    read_active_flows,
    read_captures_seen,
    read_features,
    read_finished_flows,
    read_late_frames,
    read_latest_packets,
    start_display,
    start_flow_table,
)
from model import packet
from test_flows import traffic


class Feed:
    """A folder of packet files, streamed one file per batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.count = spark, folder, 0
        self.schema = model.packets_df(spark, [packet(0, 0)]).schema

    def add(self, packets):
        target = self.folder / f"{self.count:04d}.parquet"
        pq.write_table(model.packets_df(self.spark, packets).coalesce(1).toArrow(), target)
        self.count += 1

    def stream(self):
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(str(self.folder))


@pytest.fixture
def feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return Feed(spark, tmp_path / "in")


@pytest.fixture
def live(spark, request):
    """Run a stream into memory; give batches one at a time."""
    started = []

    def start(df):
        name = f"t{abs(hash(request.node.name))}"
        query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        started.append(query)

        def drain():
            query.processAllAvailable()
            return spark.table(name)

        return query, drain

    yield start
    for query in started:
        query.stop()


def run(feed, live, batches, **options):
    query, drain = live(stream_flows(feed.stream(), options.pop("delay", "0 seconds"), **options))
    seen = []
    for batch in batches:
        feed.add(batch)
        seen.append(sorted((r["src_port"] - 1000, r["packets"]) for r in drain().collect()))
    return query, seen


def test_a_flow_is_emitted_once_when_it_ends(feed, live):
    _, seen = run(feed, live, [[packet(0, 0)], [packet(1, 29, key=2)], [packet(2, 29.5)], [packet(3, 59, key=3)]])
    assert seen == [[], [], [], [(1, 2), (2, 1)]]


def test_gap_of_exactly_the_idle_time_ends_it(feed, live):
    _, seen = run(feed, live, [[packet(0, 0)], [packet(1, 30, key=2)]])
    assert seen == [[], [(1, 1)]]


def test_frames_without_a_flow_move_the_clock(feed, live):
    _, seen = run(feed, live, [[packet(0, 0)], [packet(1, 100, key=None)]])
    assert seen == [[], [(1, 1)]]


def test_late_packets_are_counted_as_dropped(feed, live):
    query, seen = run(feed, live, [[packet(0, 100)], [packet(1, 200, key=None)], [packet(2, 5, key=4)]])
    assert seen[-1] == [(1, 1)]
    dropped = [o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators]
    assert sum(dropped) == 1


def test_a_longer_delay_waits_for_late_packets(feed, live):
    batches = [[packet(0, 100)], [packet(1, 150, key=None)], [packet(2, 105)], [packet(3, 300, key=None)]]
    _, seen = run(feed, live, batches, delay="60 seconds")
    assert seen == [[], [], [], [(1, 2)]]


def features(df):
    return sorted(tuple(r) for r in df.collect())


def test_export_equals_batch(spark, feed, tmp_path):
    packets = [p | dict(capture="a") for p in traffic(21, 300, 900, 0)]
    for i in range(0, 300, 75):
        feed.add(packets[i : i + 75])
    target = str(tmp_path / "out")
    start_export(
        stream_flow_features(feed.stream(), "0 seconds"), target, str(tmp_path / "cp"), trigger={"availableNow": True}
    ).awaitTermination()
    batch = flow_features(build_flows(model.packets_df(spark, packets), "eager"))
    assert features(spark.read.parquet(target)) == features(batch)


def test_csv_export_is_one_file_with_one_header(spark, feed, tmp_path):
    packets = [p | dict(capture="a") for p in traffic(21, 300, 900, 0)]
    target, checkpoint = tmp_path / "csv", str(tmp_path / "cp")

    def export():
        stream = stream_flow_features(feed.stream(), "0 seconds")
        query = start_csv_export(stream, str(target), checkpoint, trigger={"availableNow": True})
        query.awaitTermination()
        assert query.exception() is None

    def whole():
        return [line for part in sorted(target.glob("*.csv")) for line in part.read_text().splitlines()]

    for i in range(0, 300, 150):
        feed.add(packets[i : i + 150])
        export()
    expected = features(flow_features(build_flows(model.packets_df(spark, packets), "eager")))
    assert features(read_csv_export(spark, str(target))) == expected
    lines = whole()
    assert lines[0] == ",".join(FEATURES.names) and len(set(lines) & {lines[0]}) == 1
    assert lines.count(lines[0]) == 1 and len(lines) == len(expected) + 1

    # As after a crash between the sink's commit and Spark's own: the last batch runs again.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    export()
    assert sorted(whole()) == sorted(lines)
    assert not list((target / "_staged").iterdir())


def test_csv_commit_replaces_an_attempt_cut_short(tmp_path):
    writer, other = (LineWriter(str(tmp_path), "a,b", name) for name in ("w", "v"))
    text = lambda *lines: iter([pa.RecordBatch.from_pydict({"line": list(lines)})])
    whole = lambda: "".join(f.read_text() for f in sorted(tmp_path.glob("*.csv")))
    first = [writer.write(text("1,2")), writer.write(text("3,4")), writer.write(iter([])), None]
    other.commit([other.write(text("9,9"))], 0)
    writer.commit(first[:1], 0)  # cut short
    (tmp_path / "header.csv").write_text("")
    writer.commit([writer.write(text("1,2", "3,4"))], 0)
    assert sorted(whole().splitlines()) == ["1,2", "3,4", "9,9", "a,b"] and whole().startswith("a,b\n")
    writer.abort([writer.write(text("5,6")), None], 1)
    writer.commit([], 1)
    assert len(whole().splitlines()) == 4 and not list((tmp_path / "_staged").iterdir())


def table(feed, place, mode="arrival", **options):
    """Run the flow table over all that was fed, with few stores: each costs a worker a batch."""
    conf, name = feed.spark.conf, "spark.sql.shuffle.partitions"
    old = conf.get(name)
    conf.set(name, "2")
    try:
        query = start_flow_table(feed.stream(), place, mode, trigger={"availableNow": True}, shards=3, **options)
    finally:
        conf.set(name, old)
    query.awaitTermination()
    assert query.exception() is None
    return query


@pytest.mark.parametrize("mode, disorder", [("arrival", 60), ("eager", 0)])
def test_flow_table_equals_batch(spark, feed, tmp_path, mode, disorder):
    """Many small batches give what one run over all packets gives; after each of them the open flows are right."""
    packets = traffic(31, 240, 600, disorder)
    for i in range(0, 240, 60):
        feed.add(packets[i : i + 60])
    place = str(tmp_path / "table")
    table(feed, place, mode)
    flows = build_flows(model.packets_df(spark, packets), mode)
    assert features(read_features(spark, place)) == features(flow_features(flows))
    still_open = flows.filter("NOT is_closed").selectExpr("capture_id", "src_port", "packets", "bytes")
    active = read_active_flows(spark, place)
    assert features(active.select("capture_id", "src_port", "packets", "bytes")) == features(still_open)
    for batch_id in range(4):
        _, expected = (model.arrival if mode == "arrival" else model.eager)(packets[: 60 * (batch_id + 1)], 30)
        assert read_active_flows(spark, place, batch_id).count() == len(expected)
    seen = {r.capture_id: r.frames for r in read_captures_seen(spark, place).collect()}
    assert seen == {c: sum(p["capture"] == c for p in packets) for c in {p["capture"] for p in packets}}


def test_captures_have_clocks_of_their_own(spark, feed, tmp_path):
    """Eight captures of different speed in one stream, the fast ones days ahead of the slow."""
    packets = []
    for c in range(8):
        for i in range(40):
            at = i * 3.5 * (1 + c * c) + c * 5000
            packets.append(packet(1000 * c + i, at, key=None if i % 9 == 0 else 1 + i % 3, capture=f"c{c}"))
    for part in range(4):
        feed.add([p for p in packets if p["seq"] % 1000 // 10 == part])
    for mode in ("eager", "arrival"):
        place = str(tmp_path / mode)
        table(feed, place, mode)
        flows = build_flows(model.packets_df(spark, packets), mode)
        assert features(read_features(spark, place)) == features(flow_features(flows))
        assert read_active_flows(spark, place).count() == flows.filter("NOT is_closed").count()


@pytest.mark.parametrize("delay", [60])
def test_flows_and_late_frames_are_all_packets(spark, feed, tmp_path, delay):
    """In event time, a frame further behind the clock than the delay is told as late, not lost."""
    packets = traffic(33, 200, 900, 0)
    moved = packets[:50] + packets[100:150] + packets[50:100] + packets[150:]
    for i in range(0, 200, 50):
        feed.add(moved[i : i + 50])
    place = str(tmp_path / "table")
    table(feed, place, "eager", delay_seconds=delay)
    late = read_late_frames(spark, place).collect()
    told = [r.packets for r in read_finished_flows(spark, place).collect()] + [r.packets for r in read_active_flows(spark, place).collect()]
    assert sum(told) + len(late) == sum(p["key"] is not None for p in packets)
    clocks, expected = {}, []
    for i in range(0, 200, 50):
        before = dict(clocks)
        for p in moved[i : i + 50]:
            second = p["us"] // 10**6
            if p["key"] is not None and second < before.get(p["capture"], -(10**9)) - delay:
                expected.append(p["seq"])
            clocks[p["capture"]] = max(clocks.get(p["capture"], -(10**9)), second)
    assert sorted(r.first_seq for r in late) == sorted(expected) and len(expected) > 5


def test_a_delay_long_enough_gives_the_batch_result(spark, feed, tmp_path):
    packets = traffic(35, 160, 700, 0)
    moved = packets[40:80] + packets[:40] + packets[80:]
    for i in range(0, 160, 40):
        feed.add(moved[i : i + 40])
    feed.add([packet(9000, 10_000, key=None, capture=c) for c in {p["capture"] for p in packets}])
    place = str(tmp_path / "table")
    table(feed, place, "eager", delay_seconds=800)
    assert read_late_frames(spark, place).count() == 0
    flows = build_flows(model.packets_df(spark, packets), "eager")
    assert features(read_features(spark, place)) == features(flow_features(flows, include_open=True))


def test_late_packets_inside_an_open_flow(spark, feed, tmp_path):
    """In event time they join it, however many pieces they form."""
    long = [packet(i, i * 20) for i in range(40)]
    late = [packet(100 + i, 100 + i * 200) for i in range(3)] + [packet(110, 781)]
    feed.add(long)
    feed.add(late)
    place = str(tmp_path / "table")
    table(feed, place, "eager", delay_seconds=1000)
    assert [r["packets"] for r in read_active_flows(spark, place).collect()] == [44]


def test_restart_goes_on_where_it_stopped(spark, feed, tmp_path):
    packets = traffic(41, 160, 500, 0)
    place = str(tmp_path / "table")
    for i in (0, 80):
        feed.add(packets[i : i + 80])
        table(feed, place)
    flows = build_flows(model.packets_df(spark, packets), "arrival")
    assert features(read_features(spark, place)) == features(flow_features(flows))


def test_latest_packet_of_a_silent_capture_stays(spark, feed, tmp_path):
    feed.add([packet(0, 0, capture="old"), packet(1, 1, key=None, capture="old")])
    for i in range(4):
        feed.add([packet(i, i, capture="new")])
    place = str(tmp_path / "table")
    table(feed, place)
    latest = {r.capture_id: (r.seq, r.src_port) for r in read_latest_packets(spark, place).collect()}
    assert latest == {"old": (0, 1001), "new": (3, 1001)}


def test_display_goes_on_while_no_frame_comes(spark, feed, tmp_path):
    """It has a clock of its own, asks no more often than it should, and stops when told."""
    feed.add([packet(0, 0), packet(1, 5, key=2)])
    place, ticks = str(tmp_path / "table"), []
    table(feed, place)
    display = start_display(spark, place, lambda t: ticks.append((time.monotonic(), t.active.count())), refresh_seconds=2.0)
    until = time.monotonic() + 40
    while len(ticks) < 3 and time.monotonic() < until:
        time.sleep(0.1)
    display.stop()
    assert display.failed is None and [n for _, n in ticks[:3]] == [2, 2, 2]
    assert all(b - a >= 1.5 for (a, _), (b, _) in zip(ticks, ticks[1:]))


def test_a_failing_display_keeps_its_error_and_the_table(spark, feed, tmp_path):
    feed.add([packet(0, 0)])
    place = str(tmp_path / "table")
    table(feed, place)

    def fail(tick):
        raise RuntimeError("no display")

    display = start_display(spark, place, fail)
    display.join(30)
    assert "no display" in str(display.failed) and read_active_flows(spark, place).count() == 1


def test_captures_that_are_over_are_finished_and_dropped(spark, feed, tmp_path):
    feed.add([packet(0, 0, capture="old"), packet(0, 0, key=2, capture="new")])
    place = str(tmp_path / "table")
    with pytest.raises(ValueError, match="wall clock"):
        start_flow_table(feed.stream(), place, end_after_seconds=3, trigger={"availableNow": True})
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = start_flow_table(feed.stream(), place, end_after_seconds=3, trigger={"processingTime": "1 second"}, shards=2)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and (not query.lastProgress or read_finished_flows(spark, place).count() < 2):
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted((r["capture_id"], r["packets"]) for r in read_finished_flows(spark, place).collect()) == [("new", 1), ("old", 1)]
    assert read_active_flows(spark, place).count() == 0


class Store:
    """State in memory that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.held.pop(key, None)


def test_a_batch_costs_what_it_touches():
    """With thousands of open flows, a batch of one packet asks the store for a few values."""
    state = FlowTable(False, 30, 0, None)
    state.flows, state.due = Store(), Store()

    def batch(clock, waits, rows):
        frame = pd.DataFrame(rows, columns=["key", "seq", "us", "len", "sec"])
        sweep = _Sweep(state, clock, waits)
        sweep.take(frame, frame[["seq", "sec"]].iloc[-1:])
        sweep.end()
        return sweep

    first = batch(None, [], [(f"k{i}", i, i, 60, 1000 + i // 500) for i in range(5000)])
    assert len(state.flows.held) == 5000 and not first.done
    state.flows.calls = state.due.calls = 0
    second = batch(first.clock, first.waits, [("k7", 6000, 0, 60, 1010)])
    assert state.flows.calls + state.due.calls <= 6 and not second.done
    # Flows end when the clock gets there, and only those that end are looked at.
    state.flows.calls = state.due.calls = 0
    third = batch(second.clock, second.waits, [("k8", 6001, 0, 60, 1031)])
    assert sorted(int(k[1:]) // 500 for k, _, _ in third.done) == [0] * 498 + [1] * 500
    assert state.flows.calls + state.due.calls < 4 * 1000


class Value:
    """A value state in memory."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


ROW = ["kind", "seq", "us", "len", "sec", "read", "key", "frames", "latest"]


@pytest.mark.parametrize("mode", ["arrival", "eager"])
def test_a_large_batch_is_worked_on_in_slices(monkeypatch, mode):
    """What ends in a slice is told before the next is looked at, in a few rows at a time."""
    monkeypatch.setattr(flow_table, "SLICE", 50, raising=False)
    state = FlowTable(mode == "eager", 30, 0, None)
    state.flows, state.due, state.capture = Store(), Store(), Value()
    rows = [(0, i, i * 40 * 10**6, 60, i * 40, (i - 1) * 40, f"k{i % 300}", 0, None) for i in range(2000)]
    rows.append((1, 10**6, None, None, 2000 * 40, None, None, 0, None))
    parts = (pd.DataFrame(rows[i : i + 100], columns=ROW) for i in range(0, len(rows), 100))
    largest, told = 0, []
    for done in state.handleInputRows(("c", 0), parts, None):
        largest = max(largest, len(done), len(state.flows.held))
        told += zip(done["key"], done["packets"], done["first_seq"])
    assert sorted(told) == sorted((f"k{i % 300}", 1, i) for i in range(2000))
    assert largest <= 60 and not state.flows.held


def test_an_event_time_batch_keeps_few_flows_of_a_key(monkeypatch):
    """Flows of one key that are over do not pile up before its next ones."""
    monkeypatch.setattr(flow_table, "_joined", lambda *_: pytest.fail("no two packets are near"))
    state = FlowTable(True, 30, 0, None)
    state.flows, state.due = Store(), Store()
    sweep = _Sweep(state, None, [])
    frame = pd.DataFrame([("k", i, 0, 60, 40 * i) for i in range(3000)], columns=["key", "seq", "us", "len", "sec"])
    sweep.take(frame, frame[["seq", "sec"]])
    assert len(state.flows.held) <= 2
    sweep.end()
    assert len(sweep.done) == 2999


@pytest.mark.parametrize("mode", ["arrival", "eager"])
def test_clocks_sent_to_the_shards_are_few(spark, mode):
    """Although each frame moves the clock."""
    packets = model.packets_df(spark, [packet(i, i * 2, key=1 + i % 5) for i in range(1000)]).coalesce(1)
    events = _events(packets, 16, mode == "arrival").toPandas()
    assert (events["kind"] == 0).sum() == 1000 and (events["kind"] == 1).sum() == 16
    if mode == "arrival":
        own = events[events["kind"] == 0].sort_values("seq")
        assert (own["read"].to_numpy()[1:] == own["sec"].to_numpy()[:-1]).all()


@pytest.mark.parametrize("mode, disorder", [("arrival", 200), ("eager", 200)])
def test_one_batch_of_many_slices_and_blocks_equals_batch(spark, feed, tmp_path, monkeypatch, mode, disorder):
    monkeypatch.setattr(flow_table, "SLICE", 7)
    monkeypatch.setattr(flow_table, "BLOCK_BITS", 4)
    packets = traffic(37, 400, 1500, disorder)
    feed.add(packets[::-1])
    place = str(tmp_path / "table")
    table(feed, place, mode)
    flows = build_flows(model.packets_df(spark, packets), mode)
    assert features(read_features(spark, place)) == features(flow_features(flows))
    assert read_active_flows(spark, place).count() == flows.filter("NOT is_closed").count()


@pytest.mark.parametrize("capture", [None, "a"])
def test_null_capture_in_stream_and_batch(spark, feed, live, capture):
    packets = [packet(0, 0, capture=capture), packet(1, 100, key=2, capture=capture)]
    _, seen = run(feed, live, [packets[:1], packets[1:]])
    assert seen[-1] == [(1, 1)]
    for mode in ("eager", "arrival"):
        flows = build_flows(model.packets_df(spark, packets), mode)
        assert sorted((r["src_port"], r["is_closed"]) for r in flows.collect()) == [(1001, True), (1002, False)]
