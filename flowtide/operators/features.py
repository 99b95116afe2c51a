"""Model-ready features of a flow."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import average_packet_size, per_second


def flow_features(flows: DataFrame, include_open: bool = False) -> DataFrame:
    """Nine features per flow, in export order.

    Only closed flows are exported; ``include_open`` also flushes those that
    were still running when the capture stopped.
    """
    packets, total, duration = F.col("packets"), F.col("bytes"), F.col("duration")
    ended = flows if include_open else flows.filter("is_closed")
    return ended.select(
        duration,
        packets,
        total,
        per_second(packets, duration).alias("packetsPerSecond"),
        per_second(total, duration).alias("bytesPerSecond"),
        average_packet_size(total, packets).alias("averagePacketSize"),
        F.col("src_port").alias("srcPort"),
        F.col("dst_port").alias("dstPort"),
        "protocol",
    )
