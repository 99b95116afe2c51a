"""Packets to flows: keying, idle-timeout sessions, open and closed flows.

A flow is a run of packets with one :data:`~flowtide.schema.FLOW_KEY` that ends
once the key has been silent for ``idle_seconds`` *whole* seconds. Two ways to
decide "silent" are offered:

``eager``
    Event time. Consecutive packets of a key, ordered by time, are split when
    their whole seconds differ by ``idle_seconds`` or more. The order of
    arrival does not matter.
``arrival``
    The table is swept after every captured frame, and a packet joins its flow
    before the sweep. So a flow is cut between two of its packets exactly when
    some frame that arrived strictly before the second one - any frame, flow
    packet or not - was ``idle_seconds`` or more past the last packet of the
    flow. On an otherwise silent link the flow goes on after the gap.

Both are computed in two steps that never put all packets of one key, or of
one capture, in one task:

1. *Pieces.* Within one key and one bounded unit (a slice of event time, or a
   block of arrival positions) packets are reduced to partial flows. A unit
   holds a bounded number of rows whatever the size of the key.
2. *Stitching.* Only the first and last piece of a unit can continue in a
   neighbouring unit; all others are finished flows. The stitching window sees
   at most two rows per key and unit, and finished pieces are spread by unit.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import duration_seconds
from ..schema import FLOW_KEY

IDLE_SECONDS = 30
#: Event-time slice of ``eager`` pieces, in seconds.
SLICE_SECONDS = 3600
#: Arrival positions per ``arrival`` block; ``seq`` is unique in a capture, so
#: this bounds the rows of a block.
BLOCK_PACKETS = 1 << 18
#: Blocks whose clock readings are strung together at a time.
RUN_BLOCKS = 1 << 12

#: Measures of a (partial) flow. ``entered`` is the clock reading the previous
#: piece is compared with, ``last_sec`` the second the idle time counts from.
PIECE_MEASURES = (
    "packets",
    "bytes",
    "first_seq",
    "last_seq",
    "first_seen",
    "last_seen",
    "last_len",
    "entered",
    "last_sec",
)


#: Only TCP and UDP over IP make flows.
ELIGIBLE = "(has_ipv4 OR has_ipv6) AND has_transport"


def eligible(packets: DataFrame) -> DataFrame:
    return packets.filter(ELIGIBLE)


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add ``ip_version``, the one key column a packet does not carry itself."""
    return packets.selectExpr("*", "CASE WHEN has_ipv6 THEN 6 WHEN has_ipv4 THEN 4 END AS ip_version")


def flow_key(packets: DataFrame) -> DataFrame:
    """The key of every eligible packet, next to its arrival position."""
    return with_flow_key(eligible(packets)).select("seq", *FLOW_KEY)


def frame_count(frames: DataFrame) -> DataFrame:
    """Frames per capture, eligible or not."""
    return frames.groupBy("capture_id").agg(F.count(F.lit(1)).alias("frames"))


def capture_clock(frames: DataFrame) -> DataFrame:
    """Latest whole second seen by each capture; every frame advances it."""
    return frames.groupBy("capture_id").agg(F.max(F.unix_seconds("ts")).alias("clock"))


def session_gap(idle_seconds: int) -> str:
    """Gap for ``session_window`` over whole seconds.

    ``session_window`` keeps events exactly one gap apart together, so the gap
    is one microsecond short of the idle time: whole seconds that differ by
    ``idle_seconds`` split, smaller differences do not.
    """
    if idle_seconds < 1:
        raise ValueError("idle_seconds must be at least 1")
    return f"{idle_seconds * 1_000_000 - 1} microseconds"


@dataclass(frozen=True)
class Measure:
    """One more number of a flow: ``agg`` (such as ``sum``, ``min`` or ``max``) of an SQL
    expression over packet columns. Partial flows merge by ``merge``, by default the same.

    With ``gaps`` the expression is over ``gap``, the microseconds from a packet to the
    one of its flow that arrived before; the first has none. Stitching adds the gap between
    neighbouring parts, so the measure is exact however a flow was cut.
    """

    name: str
    packet: str
    agg: str
    merge: str | None = None
    gaps: bool = False

    def total(self) -> Column:
        return F.expr(f"{self.agg}({self.name}) AS {self.name}")

    def merged(self) -> Column:
        return F.expr(f"{self.merge or self.agg}({self.name}) AS {self.name}")

    def with_gap(self) -> Column:
        """The measure of a part, and of the gap before it."""
        own, more = F.col(self.name), F.expr(self.packet)
        if self.agg == "sum":
            return F.when(own.isNull(), more).otherwise(own + F.coalesce(more, F.lit(0)))
        return (F.least if self.agg == "min" else F.greatest)(own, more)


#: The last clock reading of the capture, carried by the parts of a flow.
CLOCK = Measure("clock", "clock", "max")


def packet_totals(more: Sequence[Measure] = ()) -> list[Column]:
    """Aggregates over the packets of one flow; all fixed width, so they stay
    in a hash aggregate with a map-side partial step."""
    return [m.total() for m in more] + [
        F.expr(total)
        for total in (
            "count(1) AS packets",
            "sum(len) AS bytes",
            "min(seq) AS first_seq",
            "max(seq) AS last_seq",
            "min_by(ts, seq) AS first_seen",
            "max_by(ts, seq) AS last_seen",
            "max_by(len, seq) AS last_len",
        )
    ]


def _piece_totals(more: Sequence[Measure] = ()) -> list[Column]:
    return [m.merged() for m in more] + [
        F.expr(total)
        for total in (
            "sum(packets) AS packets",
            "sum(bytes) AS bytes",
            "min(first_seq) AS first_seq",
            "max(last_seq) AS last_seq",
            "min_by(first_seen, first_seq) AS first_seen",
            "max_by(last_seen, last_seq) AS last_seen",
            "max_by(last_len, last_seq) AS last_len",
            "min(entered) AS entered",
        )
    ]


def eager_pieces(
    packets: DataFrame,
    idle_seconds: int = IDLE_SECONDS,
    slice_seconds: int = SLICE_SECONDS,
    more: Sequence[Measure] = (),
) -> DataFrame:
    """Partial flows per key and slice of event time.

    The partial aggregate keeps one row per key and second, so a hot key
    reaches the shuffle already reduced, and is spread over its slices there.
    """
    if any(m.gaps for m in more):
        raise ValueError("gaps between packets need mode='arrival'")
    return (
        with_flow_key(eligible(packets))
        .selectExpr(
            *FLOW_KEY,
            "seq",
            "ts",
            "len",
            "unix_seconds(ts) AS sec",
            "timestamp_seconds(unix_seconds(ts)) AS second",
            f"{_unit('unix_seconds(ts)', slice_seconds)} AS unit",
            *(f"{m.packet} AS {m.name}" for m in more),
        )
        .groupBy(*FLOW_KEY, "unit", F.session_window("second", session_gap(idle_seconds)))
        .agg(*packet_totals(more), F.expr("min(sec) AS entered"), F.expr("max(sec) AS last_sec"))
        .select(*FLOW_KEY, "unit", *PIECE_MEASURES, *(m.name for m in more))
    )


def _unit(position: str, size: int) -> str:
    """Which run of ``size`` positions a position is in; whole numbers throughout,
    so it is right for every bigint, negative ones included."""
    return f"({position} - pmod({position}, {size}L)) DIV {size}L"


def _block(block_packets: int) -> str:
    return _unit("seq", block_packets)


def block_peaks(frames: DataFrame, block_packets: int = BLOCK_PACKETS) -> DataFrame:
    """Latest whole second in each block of arrival positions."""
    return (
        frames.selectExpr("capture_id", f"{_block(block_packets)} AS unit", "unix_seconds(ts) AS sec")
        .groupBy("capture_id", "unit")
        .agg(F.expr("max(sec) AS sec"))
    )


def block_clocks(peaks: DataFrame) -> DataFrame:
    """``capture_id, unit, sec, clock``: the latest second before each block, and the last of its capture.

    Blocks are taken ``RUN_BLOCKS`` at a time, as one row with their maxima: one window runs
    over the runs of a capture, one over the blocks of a run, without another shuffle.
    """
    runs = (
        peaks.withColumn("run", F.expr(_unit("unit", RUN_BLOCKS)))
        .groupBy("capture_id", "run")
        .agg(F.max("sec").alias("top"), F.collect_list(F.struct("unit", "sec")).alias("blocks"))
    )
    capture = Window.partitionBy("capture_id")
    earlier = capture.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # The windows first: in one step with them, the rows would be exploded before.
    runs = runs.withColumns({"before": F.max("top").over(earlier), "clock": F.max("top").over(capture)})
    blocks = runs.select("capture_id", "run", "before", "clock", F.explode("blocks").alias("b"))
    in_run = Window.partitionBy("capture_id", "run").orderBy("b.unit").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        "capture_id", F.col("b.unit").alias("unit"), F.greatest(F.max("b.sec").over(in_run), "before").alias("sec"), "clock"
    )


def arrival_pieces(
    packets: DataFrame,
    idle_seconds: int = IDLE_SECONDS,
    block_packets: int = BLOCK_PACKETS,
    peaks: DataFrame | None = None,
    more: Sequence[Measure] = (),
) -> DataFrame:
    """Partial flows per key and block of arrival positions, with the capture's last ``clock``.

    The clock a packet meets is the running maximum of the seconds of all
    frames before it in its capture. It is built from block maxima: each block
    gets one seed row carrying the maximum of all earlier blocks, so no window
    spans a capture. Rows are shuffled once, by block; clock, split and partial
    aggregate all use that partitioning. The seed row brings the capture's last
    reading too, so that no join is needed to tell whether a flow is over.
    """
    in_key = [c for c in FLOW_KEY if c != "capture_id"]
    rows = with_flow_key(packets).selectExpr(
        "capture_id",
        "seq",
        "ts",
        "len",
        "unix_seconds(ts) AS sec",
        f"{_block(block_packets)} AS unit",
        f"coalesce({ELIGIBLE}, false) AS eligible",
        *in_key,
        *(f"{m.packet} AS {m.name}" for m in more if not m.gaps),
    )
    peaks = block_peaks(packets, block_packets) if peaks is None else peaks
    seeds = block_clocks(peaks).select(
        "capture_id", "unit", F.expr(f"unit * {block_packets}L - 1").alias("seq"), "sec", "clock", F.lit(False).alias("eligible")
    )
    so_far = (
        Window.partitionBy("capture_id", "unit")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_key = Window.partitionBy("capture_id", "unit", *in_key).orderBy("seq")
    previous = F.lag("sec").over(per_key)
    opens = previous.isNull() | (F.col("entered") - previous >= idle_seconds)
    gaps = [m for m in more if m.gaps]
    split = (
        rows.unionByName(seeds, allowMissingColumns=True)
        .withColumns({"entered": F.max("sec").over(so_far), "clock": F.max("clock").over(so_far)})
        .filter("eligible")
        .withColumn("opens", opens.cast("int"))
    )
    if gaps:
        since = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(per_key)
        split = split.withColumn("gap", F.when(F.col("opens") == 0, since)).withColumns({m.name: F.expr(m.packet) for m in gaps})
    more = (*more, CLOCK)
    return (
        split
        .withColumn("piece", F.sum("opens").over(per_key.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("capture_id", "unit", *in_key, "piece")
        .agg(*packet_totals(more), F.expr("min(entered) AS entered"), F.expr("max_by(sec, seq) AS last_sec"))
        .select(*FLOW_KEY, "unit", *PIECE_MEASURES, *(m.name for m in more))
    )


def stitch(
    pieces: DataFrame, idle_seconds: int, mode: str, overlapping: bool = False, more: Sequence[Measure] = ()
) -> DataFrame:
    """Join pieces of one flow across units. One shuffle, of pieces only.

    Returns the piece columns without ``unit``, one row per flow.

    ``overlapping`` says that, in event time, pieces of one unit may lie within
    a piece of another (late packets of a flow carried over from earlier). No
    piece is certain to be finished then, and all of a key meet in one lane; a
    key still has at most one piece per idle time.
    """
    position = "entered" if mode == "eager" else "first_seq"
    in_unit = Window.partitionBy(*FLOW_KEY, "unit").orderBy(position)
    inner = (
        F.lit(not overlapping)
        & F.lag(position).over(in_unit).isNotNull()
        & F.lead(position).over(in_unit).isNotNull()
    )
    # Inner pieces are finished: keep them in their unit, away from the lane
    # (NULL) in which the outer pieces of a key meet.
    laned = pieces.withColumn("lane", F.when(inner, F.col("unit")))
    in_lane = Window.partitionBy(*FLOW_KEY, "lane").orderBy(position)
    earlier = in_lane.rowsBetween(Window.unboundedPreceding, -1)
    # Event time may put a piece inside an earlier one; arrival order cannot.
    silent_since = F.max("last_sec").over(earlier) if mode == "eager" else F.lag("last_sec").over(in_lane)
    opens = (
        F.col("lane").isNotNull()
        | silent_since.isNull()
        | (F.col("entered") - silent_since >= idle_seconds)
    )
    gaps = [m for m in more if m.gaps]
    if gaps:
        since = F.unix_micros("first_seen") - F.lag(F.unix_micros("last_seen")).over(in_lane)
        laned = laned.withColumn("gap", F.when(~opens, since)).withColumns({m.name: m.with_gap() for m in gaps})
    last_sec = F.max("last_sec") if mode == "eager" else F.max_by("last_sec", "last_seq")
    return (
        laned.withColumn("opens", opens.cast("int"))
        .withColumn("flow", F.sum("opens").over(in_lane.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*FLOW_KEY, "lane", "flow")
        .agg(*_piece_totals(more), last_sec.alias("last_sec"))
        .select(*FLOW_KEY, *PIECE_MEASURES, *(m.name for m in more))
    )


def mark_closed(
    flows: DataFrame, clock: DataFrame, idle_seconds: int, more: Sequence[Measure] = ()
) -> DataFrame:
    """Add ``is_closed``: did the capture's clock run past the idle time?

    Flows of the NULL capture meet its clock like all others. ``clock`` has one row per capture. It is joined without a hint: adaptive
    execution broadcasts it when its measured size allows, and otherwise splits
    a capture that holds most of the flows.
    """
    clock = clock.select(F.col("capture_id").alias("clock_of"), "clock")
    return flows.join(clock, F.col("capture_id").eqNullSafe(F.col("clock_of"))).selectExpr(
        *FLOW_KEY,
        *PIECE_MEASURES,
        *(m.name for m in more),
        f"clock - last_sec >= {idle_seconds} AS is_closed",
    )


def build_flows(
    packets: DataFrame,
    mode: str = "eager",
    idle_seconds: int = IDLE_SECONDS,
    slice_seconds: int = SLICE_SECONDS,
    block_packets: int = BLOCK_PACKETS,
    ticks: DataFrame | None = None,
    more: Sequence[Measure] = (),
) -> DataFrame:
    """All flows of ``packets``, closed and open.

    ``packets`` must hold every captured frame, not only the eligible ones:
    each of them moves the clock. ``ticks`` may give the clock a lighter reading
    of the same frames (``capture_id, seq, ts``), where scanning ``packets`` twice
    is dear: for capture files, ``read_captures(..., headers_only=True)``. ``more``
    adds measures to the flow row, such as :data:`SIZE_MEASURES`.
    """
    ticks = packets if ticks is None else ticks
    if mode == "eager":
        pieces = eager_pieces(packets, idle_seconds, slice_seconds, more)
        clock = capture_clock(ticks)
    elif mode == "arrival":
        pieces = arrival_pieces(packets, idle_seconds, block_packets, block_peaks(ticks, block_packets), more)
        flows = stitch(pieces, idle_seconds, mode, more=(*more, CLOCK))
        return flow_columns(flows.withColumn("is_closed", F.expr(f"clock - last_sec >= {idle_seconds}")), more)
    else:
        raise ValueError(f"unknown mode {mode!r}: use 'eager' or 'arrival'")
    flows = stitch(pieces, idle_seconds, mode, more=more)
    return flow_columns(mark_closed(flows, clock, idle_seconds, more), more)


def flow_columns(flows: DataFrame, more: Sequence[Measure] = ()) -> DataFrame:
    """The flow row users see."""
    return flows.select(
        *FLOW_KEY,
        "packets",
        "bytes",
        "last_len",
        "first_seq",
        "last_seq",
        "first_seen",
        "last_seen",
        duration_seconds(F.col("first_seen"), F.col("last_seen")).alias("duration"),
        "is_closed",
        *(m.name for m in more),
    )


#: What the distribution of packet sizes in a flow needs, exactly and mergeably.
SIZE_MEASURES = (
    Measure("len_min", "len", "min"),
    Measure("len_max", "len", "max"),
    Measure("len_squares", "CAST(len AS DECIMAL(38, 0)) * len", "sum"),
)
#: Of two-way flows, the share of the direction the key names.
DIRECTION_MEASURES = (
    Measure("forward_packets", "IF(forward, 1L, 0L)", "sum"),
    Measure("forward_bytes", "IF(forward, len, 0L)", "sum"),
)


#: Microseconds between the packets of a flow, in the order they arrived.
GAP_MEASURES = (
    Measure("gap_sum", "gap", "sum", gaps=True),
    Measure("gap_min", "gap", "min", gaps=True),
    Measure("gap_max", "gap", "max", gaps=True),
    Measure("gap_squares", "CAST(gap AS DECIMAL(38, 0)) * gap", "sum", gaps=True),
)
#: A sketch of the packet sizes: ranks of its quantiles are right to 1.7 hundredths, exact up to 200 packets.
SKETCH_MEASURES = (Measure("len_sketch", "len", "kll_sketch_agg_bigint", "kll_merge_agg_bigint"),)
#: Packets of a TCP flow by the flags of their header (fixed values: the bits), 0 for UDP.
FLAG_MEASURES = tuple(
    Measure(f"{flag}_packets", f"IF(tcp_flags & {bit} > 0, 1L, 0L)", "sum")
    for flag, bit in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))
)


def packet_gaps(flows: DataFrame) -> DataFrame:
    """Flows built with :data:`GAP_MEASURES`, with ``gap_mean`` and ``gap_deviation`` in
    place of the sums; all NULL in a flow of one packet."""
    n = F.col("packets") - 1
    total = F.col("gap_sum").cast("decimal(38,0)")
    spread = (n.cast("decimal(20,0)") * F.col("gap_squares") - total * total).cast("double")
    mean = F.when(n > 0, F.col("gap_sum") / n)
    return flows.withColumns({"gap_mean": mean, "gap_deviation": F.when(n > 0, F.sqrt(spread) / n)}).drop("gap_sum", "gap_squares")


def size_quantiles(flows: DataFrame, ranks: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Flows built with :data:`SKETCH_MEASURES`, with ``len_p50``, ... in place of the sketch."""
    found = {f"len_p{round(100 * r)}": F.expr(f"kll_sketch_get_quantile_bigint(len_sketch, {r}D)") for r in ranks}
    return flows.withColumns(found).drop("len_sketch")


def packet_sizes(flows: DataFrame) -> DataFrame:
    """Flows built with :data:`SIZE_MEASURES`, with ``len_mean`` and ``len_deviation``
    (of the whole flow, not a sample) in place of the sum of squares."""
    n, total = F.col("packets"), F.col("bytes").cast("decimal(38,0)")
    # n * squares - total**2 in whole numbers: nothing cancels.
    spread = n.cast("decimal(20,0)") * F.col("len_squares") - total * total
    return flows.withColumns(
        {
            "len_mean": F.col("bytes") / n,
            "len_deviation": F.sqrt(spread.cast("double")) / n,
        }
    ).drop("len_squares")


def two_way(packets: DataFrame) -> DataFrame:
    """Packets whose key names the lesser end first, and ``forward``: was it the sender?

    Ends are compared by address, then port; both directions of a conversation
    get one key. Feed the result to :func:`build_flows` with
    :data:`DIRECTION_MEASURES`.
    """
    ends = "struct({0}_ip, {0}_ip6, {0}_port)"
    turned = packets.withColumn("forward", F.expr(f"{ends.format('src')} <= {ends.format('dst')}"))
    swapped = {}
    for part in ("ip", "ip6", "port"):
        src, dst = F.col(f"src_{part}"), F.col(f"dst_{part}")
        swapped[f"src_{part}"] = F.when(F.col("forward"), src).otherwise(dst)
        swapped[f"dst_{part}"] = F.when(F.col("forward"), dst).otherwise(src)
    return turned.withColumns(swapped)


def closed_flows(flows: DataFrame) -> DataFrame:
    return flows.filter("is_closed")
