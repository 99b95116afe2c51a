"""Gaps, size quantiles and the plan of arrival sessions."""

import math
import random

import pytest

import model
from flowtide import build_flows
from flowtide.operators.flows import GAP_MEASURES, SKETCH_MEASURES, packet_gaps, size_quantiles
from model import packet
from test_flows import traffic


@pytest.mark.parametrize("block", [1 << 18, 7, 1])
def test_gaps_however_a_flow_is_cut(spark, block):
    """Late arrivals give negative gaps; blocks of any size give the same."""
    packets = traffic(51, 400, 900, 40)
    flows = build_flows(model.packets_df(spark, packets), "arrival", 30, block_packets=block, more=GAP_MEASURES)
    got = {(r.capture_id, r.first_seq): r for r in packet_gaps(flows).collect()}
    by_seq = {(p["capture"], p["seq"]): p for p in packets}
    assert any(r.gap_min is not None and r.gap_min < 0 for r in got.values())
    closed, still_open = model.arrival(packets, 30)
    assert len(got) == len(closed) + len(still_open)
    for flow in closed + still_open:
        members = [p for p in packets if p["capture"] == flow["capture"] and p["key"] == flow["key"] and flow["first_seq"] <= p["seq"] <= flow["last_seq"]]
        times = [by_seq[p["capture"], p["seq"]]["us"] for p in sorted(members, key=lambda p: p["seq"])]
        gaps = [b - a for a, b in zip(times, times[1:])]
        r = got[flow["capture"], flow["first_seq"]]
        if not gaps:
            assert (r.gap_min, r.gap_max, r.gap_mean, r.gap_deviation) == (None,) * 4
            continue
        mean = sum(gaps) / len(gaps)
        assert (r.gap_min, r.gap_max) == (min(gaps), max(gaps)) and r.gap_mean == pytest.approx(mean)
        assert r.gap_deviation == pytest.approx(math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)), rel=1e-9, abs=1e-3)


def test_gaps_need_arrival_order(spark):
    with pytest.raises(ValueError, match="arrival"):
        build_flows(model.packets_df(spark, [packet(0, 0)]), "eager", more=GAP_MEASURES)


def test_quantiles_of_a_large_flow_within_the_bound(spark):
    """Merged from many parts, ranks are off by less than the stated 1.7 hundredths."""
    random.seed(6)
    packets = [packet(i, i / 50, length=random.choice([60, 100, 700, 1400]) + 7 * random.randint(0, 40)) for i in range(6000)]
    flows = build_flows(model.packets_df(spark, packets), "arrival", 30, block_packets=500, more=SKETCH_MEASURES)
    (row,) = size_quantiles(flows).collect()
    sizes = sorted(p["len"] for p in packets)
    for name, rank in (("len_p50", 0.5), ("len_p90", 0.9), ("len_p99", 0.99)):
        low = sum(s < row[name] for s in sizes) / len(sizes)
        high = sum(s <= row[name] for s in sizes) / len(sizes)
        assert low - 0.017 <= rank <= high + 0.017


def test_the_clock_costs_one_more_scan_and_no_join(spark, tmp_path):
    model.packets_df(spark, traffic(52, 200, 900, 0)).write.parquet(f"{tmp_path}/packets")
    packets = spark.read.parquet(f"{tmp_path}/packets")
    for block in (1 << 18, 16):
        plan = build_flows(packets, "arrival", block_packets=block)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        assert plan.count("FileScan") == 2
        assert plan.count("Exchange hashpartitioning") <= 6
