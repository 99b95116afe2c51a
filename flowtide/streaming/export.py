"""Continuous feature export on Spark's own session windows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import flow_features
from ..operators.flows import (
    ELIGIBLE,
    IDLE_SECONDS,
    flow_columns,
    packet_totals,
    session_gap,
    with_flow_key,
)
from ..schema import FLOW_KEY


def stream_flows(
    packets: DataFrame, delay: str, idle_seconds: int = IDLE_SECONDS
) -> DataFrame:
    """Closed flows of a packet stream, each emitted once, in append mode.

    Event-time (``eager``) sessions. The watermark is the clock: it follows the
    whole seconds of *every* frame, so a flow is emitted once any frame is
    ``idle_seconds`` past it. ``delay`` is how long to wait for frames that arrive
    out of order: ``"0 seconds"`` is right for ordered input only. A frame later than
    that is dropped by the watermark and counted in the query progress.

    The watermark is one clock for the whole query. Run one query per capture
    when the captures' clocks differ.
    """
    clocked = with_flow_key(packets).withColumn(
        "second", F.timestamp_seconds(F.unix_seconds("ts"))
    ).withWatermark("second", delay)
    # The optimizer moves filters that do not mention the event time below the
    # watermark, where frames without a flow would no longer advance the clock.
    flow_packets = clocked.filter(f"CASE WHEN second IS NULL THEN false ELSE {ELIGIBLE} END")
    return flow_columns(
        flow_packets.groupBy(*FLOW_KEY, F.session_window("second", session_gap(idle_seconds)))
        .agg(*packet_totals())
        .withColumn("is_closed", F.lit(True))
    )


def stream_flow_features(
    packets: DataFrame, delay: str, idle_seconds: int = IDLE_SECONDS
) -> DataFrame:
    return flow_features(stream_flows(packets, delay, idle_seconds))


def start_export(
    features: DataFrame,
    path: str,
    checkpoint: str,
    format: str = "parquet",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append finished flows' features to a file data set, exactly once."""
    writer = features.writeStream.outputMode("append").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    return (
        writer.option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
