import random
import statistics

import pytest
from pyspark.sql import functions as F

import model
from flowtide import active_flows, build_flows, closed_flows, flow_features, frame_count, latest_packet
from flowtide.operators.flows import DIRECTION_MEASURES, SIZE_MEASURES, packet_sizes, session_gap, two_way
from model import packet


def check(spark, packets, idle, mode, **sizes):
    flows = build_flows(model.packets_df(spark, packets), mode, idle, **sizes)
    got = model.flow_rows(flows, "is_closed")
    closed, still_open = (model.arrival if mode == "arrival" else model.eager)(packets, idle)
    assert [r[:-1] for r in got if r[-1]] == model.rows(closed)
    assert [r[:-1] for r in got if not r[-1]] == model.rows(still_open)


def traffic(seed, size, span, disorder, keys=5, captures=2, hot=0.5):
    """Packets with a hot key, frames without a flow, and late arrivals."""
    rng = random.Random(seed)
    out, now = [], 0.0
    for seq in range(size):
        now += rng.expovariate(size / span)
        late = rng.uniform(0, disorder) if disorder and rng.random() < 0.3 else 0
        key = None if rng.random() < 0.15 else 0 if rng.random() < hot else rng.randrange(keys)
        capture = "a" if rng.random() < 0.7 else rng.choice("bc"[:captures])
        out.append(packet(seq, max(now - late, 0), key, capture, rng.randrange(60, 1500)))
    return out


@pytest.mark.parametrize("disorder", [0, 3, 80])
@pytest.mark.parametrize("mode", ["eager", "arrival"])
def test_against_one_packet_at_a_time(spark, mode, disorder):
    packets = []
    for seed, span in [(1, 300), (2, 4000), (3, 60)]:
        for p in traffic(seed, 400, span, disorder):
            packets.append(p | dict(capture=f"{p['capture']}{seed}"))
    check(spark, packets, 15, mode, slice_seconds=37, block_packets=16)
    check(spark, packets, 15, mode)


@pytest.mark.parametrize("first", [2047 << 42, 2048 << 42, 4097 << 42, (4097 << 42) + 12, -(4097 << 42) - 5])
def test_far_positions(spark, first):
    """Blocks are whole-number runs, beyond what a double can hold and below zero."""
    packets = [p | dict(seq=p["seq"] + first) for p in traffic(7, 200, 900, 20)]
    check(spark, packets, 15, "arrival", block_packets=16)
    # The last positions of a block, a clock at 100 and a packet after it.
    end = first - first % 16 + 16
    tail = [packet(end - 4, 0), packet(end - 3, 100, key=None), packet(end - 2, 101), packet(end, 102)]
    check(spark, tail, 30, "arrival", block_packets=16)


def test_thinly_spread_positions(spark):
    """Positions like time stamps: a block for each packet, many runs of blocks."""
    packets = [p | dict(seq=p["seq"] * 987_654_321_987) for p in traffic(8, 200, 900, 20)]
    check(spark, packets, 15, "arrival")


@pytest.mark.parametrize("mode", ["eager", "arrival"])
def test_null_capture(spark, mode):
    packets = [p | dict(capture=None if p["capture"] == "b" else "a") for p in traffic(9, 200, 900, 20)]
    flows = build_flows(model.packets_df(spark, packets), mode, 15)
    closed, still_open = (model.arrival if mode == "arrival" else model.eager)(packets, 15)
    assert flows.count() == len(closed) + len(still_open)
    assert flows.filter("is_closed AND capture_id IS NULL").count() == sum(f["capture"] is None for f in closed)


def test_latest_packet_sorts_no_packets(spark):
    plan = latest_packet(model.packets_df(spark, [packet(0, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


@pytest.mark.parametrize("mode", ["eager", "arrival"])
def test_flow_over_many_units(spark, mode):
    """One key in every unit, with and without ends inside them."""
    steady = [packet(i, i * 0.9) for i in range(300)]
    bursts = [packet(i, i // 7 * 50 + i % 7) for i in range(300)]
    for packets in (steady, bursts):
        check(spark, packets, 30, mode, slice_seconds=10, block_packets=8)


@pytest.mark.parametrize(
    "second, eager, arrival",
    [(29.99, 1, 1), (30.0, 2, 1), (30.000001, 2, 1), (29.999999, 1, 1)],
)
def test_gap_on_a_silent_link(spark, second, eager, arrival):
    """Only other traffic ends a flow before its next packet joins it."""
    df = model.packets_df(spark, [packet(0, 0), packet(1, second)])
    assert build_flows(df, "eager").count() == eager
    assert build_flows(df, "arrival").count() == arrival


def test_whole_seconds_decide(spark):
    df = model.packets_df(spark, [packet(0, 10.999999), packet(1, 40.0), packet(2, 69.99)])
    assert build_flows(df, "eager").count() == 2  # 10 -> 40 splits, 40 -> 69 does not


@pytest.mark.parametrize("other", [None, 9])
def test_any_other_frame_sweeps_the_table(spark, other):
    df = model.packets_df(spark, [packet(0, 0), packet(1, 30.5, key=other), packet(2, 31, key=1)])
    flows = build_flows(df, "arrival").filter("src_port = 1001")
    assert sorted(r["is_closed"] for r in flows.collect()) == [False, True]


def test_frames_of_other_captures_do_not(spark):
    df = model.packets_df(spark, [packet(0, 0), packet(1, 90, key=None, capture="b")])
    assert build_flows(df, "arrival").filter("is_closed").count() == 0


def test_directions_and_versions_are_separate_flows(spark):
    df = model.packets_df(spark, [packet(0, 0)])
    back = df.selectExpr("* EXCEPT (src_port, dst_port, seq)", "443 AS src_port", "src_port AS dst_port", "1L AS seq")
    assert build_flows(df.unionByName(back), "eager").count() == 2


@pytest.mark.parametrize("idle", [1, 2, 30, 100000])
def test_totals_are_kept_for_any_idle_time(spark, idle):
    packets = traffic(11, 300, 500, 10)
    eligible = [p for p in packets if p["key"] is not None]
    for mode in ("eager", "arrival"):
        total = build_flows(model.packets_df(spark, packets), mode, idle).agg(F.sum("packets"), F.sum("bytes")).first()
        assert tuple(total) == (len(eligible), sum(p["len"] for p in eligible))


def test_as_of_is_a_prefix(spark):
    packets = traffic(5, 300, 600, 0)
    until = packets[170]["us"]
    _, still_open = model.arrival([p for p in packets if p["us"] <= until], 30)
    bound = F.timestamp_micros(F.lit(until))
    got = active_flows(model.packets_df(spark, packets), bound, "arrival", 30)
    assert sorted((r["capture_id"], r["src_port"] - 1000, r["packets"]) for r in got.collect()) == sorted(
        (f["capture"], f["key"], f["n"]) for f in still_open
    )


def test_time_running_backwards_gives_zero_rates(spark):
    df = model.packets_df(spark, [packet(0, 20.5), packet(1, 10)])
    row = flow_features(build_flows(df, "arrival", 30), include_open=True).first()
    assert row["duration"] == -10.5 and row["packetsPerSecond"] == row["bytesPerSecond"] == 0.0


def test_closed_only_unless_asked(spark):
    flows = build_flows(model.packets_df(spark, [packet(0, 0), packet(1, 40, key=2)]), "eager")
    assert flow_features(flows).count() == closed_flows(flows).count() == 1
    assert flow_features(flows, include_open=True).count() == 2


def test_counters_and_latest(spark):
    df = model.packets_df(spark, [packet(0, 0), packet(1, 1, key=2), packet(2, 2, key=None), packet(3, 3, None, "b")])
    assert {r["capture_id"]: r["frames"] for r in frame_count(df).collect()} == {"a": 3, "b": 1}
    newest = latest_packet(df).collect()
    assert [(r["capture_id"], r["seq"], r["family"], r["src_port"]) for r in newest] == [("a", 1, "IPv4", 1002)]


def test_no_window_spans_a_key_or_a_capture(spark):
    """Every window over packets is bounded by a slice or a block."""
    df = model.packets_df(spark, [packet(0, 0)])
    for mode in ("eager", "arrival"):
        plan = build_flows(df, mode)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("mode", ["eager", "arrival"])
def test_packet_sizes_over_many_units(spark, mode):
    packets = [packet(i, i * 0.9, key=1, length=60 + i * 37 % 1400) for i in range(120)]
    sizes = [p["len"] for p in packets]
    flows = build_flows(
        model.packets_df(spark, packets), mode, 30, slice_seconds=10, block_packets=8, more=SIZE_MEASURES
    )
    row = packet_sizes(flows).collect()
    assert len(row) == 1
    assert (row[0]["len_min"], row[0]["len_max"]) == (min(sizes), max(sizes))
    assert row[0]["len_mean"] == statistics.fmean(sizes)
    assert row[0]["len_deviation"] == pytest.approx(statistics.pstdev(sizes), rel=1e-12)


def test_two_directions_make_one_flow(spark):
    there = model.packets_df(spark, [packet(0, 0), packet(2, 2)])
    back = there.selectExpr(
        "* EXCEPT (src_ip, dst_ip, src_port, dst_port, seq)", "dst_ip AS src_ip", "src_ip AS dst_ip",
        "dst_port AS src_port", "src_port AS dst_port", "seq + 1 AS seq",
    ).limit(1)
    flows = build_flows(two_way(there.unionByName(back)), "eager", more=DIRECTION_MEASURES).collect()
    assert [r["packets"] for r in flows] == [3]
    assert sorted((flows[0]["forward_packets"], 3 - flows[0]["forward_packets"])) == [1, 2]


def test_bad_arguments(spark):
    df = model.packets_df(spark, [packet(0, 0)])
    with pytest.raises(ValueError):
        build_flows(df, "sometimes")
    with pytest.raises(ValueError):
        session_gap(0)
