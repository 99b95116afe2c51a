"""Dashboard views: open flows, latest packet, readable packet details."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import average_packet_size
from ..functions.text import ethertype_text, ipv4_text, ipv6_text, mac_text, time_text
from .flows import IDLE_SECONDS, build_flows, eligible


def captured_until(packets: DataFrame, as_of: dt.datetime | str | Column | None) -> DataFrame:
    """Packets captured up to and including ``as_of`` (all when None)."""
    if as_of is None:
        return packets
    bound = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return packets.filter(F.col("ts") <= bound)


def throughput(flows: DataFrame) -> DataFrame:
    """Add ``bps, pps`` for a flow with a duration, else ``burst_bytes``."""
    lasting = F.col("duration") > 0
    return flows.withColumns(
        {
            "bps": F.when(lasting, F.col("bytes") / F.col("duration")),
            "pps": F.when(lasting, F.col("packets") / F.col("duration")),
            "burst_bytes": F.when(~lasting, F.col("bytes")),
        }
    )


def address_text(version: Column, address: Column, address6: Column) -> Column:
    return F.when(version == 6, ipv6_text(address6)).otherwise(ipv4_text(address))


def describe_open(flows: DataFrame) -> DataFrame:
    """The display columns of flows that have not ended."""
    version = F.col("ip_version")
    return throughput(flows.filter("NOT is_closed")).select(
        "capture_id",
        "ip_version",
        address_text(version, F.col("src_ip"), F.col("src_ip6")).alias("src_addr"),
        "src_port",
        address_text(version, F.col("dst_ip"), F.col("dst_ip6")).alias("dst_addr"),
        "dst_port",
        "protocol",
        "packets",
        "bytes",
        time_text(F.col("first_seen")).alias("first_seen_text"),
        time_text(F.col("last_seen")).alias("last_seen_text"),
        "duration",
        average_packet_size(F.col("bytes"), F.col("packets")).alias("average_packet_size"),
        "bps",
        "pps",
        "burst_bytes",
    )


def active_flows(
    packets: DataFrame,
    as_of: dt.datetime | str | Column | None = None,
    mode: str = "arrival",
    idle_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """Flows still open after the last frame captured up to ``as_of``."""
    return describe_open(build_flows(captured_until(packets, as_of), mode, idle_seconds))


def active_flow_count(active: DataFrame) -> DataFrame:
    """Number of tracked flows per capture."""
    return active.groupBy("capture_id").agg(F.count(F.lit(1)).alias("active_flows"))


def packet_details(packets: DataFrame, *more: str) -> DataFrame:
    """Readable packet: link text, then IPv6 or else IPv4 with its transport.

    IPv6 wins over IPv4; a packet with neither keeps only the link columns. ``more``
    columns are kept as they are.
    """
    family = F.when(F.col("has_ipv6"), F.lit("IPv6")).when(F.col("has_ipv4"), F.lit("IPv4"))
    any_ip = F.col("has_ipv6") | F.col("has_ipv4")
    message = (F.col("has_ipv6") & F.col("has_icmpv6")) | (
        ~F.col("has_ipv6") & F.col("has_ipv4") & F.col("has_icmp")
    )

    def address(side: str) -> Column:
        return F.when(F.col("has_ipv6"), ipv6_text(F.col(f"{side}_ip6"))).when(
            F.col("has_ipv4"), ipv4_text(F.col(f"{side}_ip"))
        )

    return packets.select(
        "capture_id",
        "seq",
        "len",
        mac_text(F.col("src_mac")).alias("src_mac_text"),
        mac_text(F.col("dst_mac")).alias("dst_mac_text"),
        ethertype_text(F.col("ether_type")).alias("ether_type_text"),
        family.alias("family"),
        address("src").alias("src_addr"),
        address("dst").alias("dst_addr"),
        F.when(any_ip, F.col("protocol")).alias("protocol"),
        F.when(any_ip, F.col("ttl")).alias("ttl"),
        F.when(any_ip & F.col("has_transport"), F.col("src_port")).alias("src_port"),
        F.when(any_ip & F.col("has_transport"), F.col("dst_port")).alias("dst_port"),
        F.when(message, F.col("icmp_type")).alias("icmp_type"),
        F.when(message, F.col("icmp_code")).alias("icmp_code"),
        *more,
    )


def latest_packet(packets: DataFrame) -> DataFrame:
    """Details of the last flow packet of each capture.

    The last position of each capture comes from a hash aggregate over two
    columns; the packets that stand there are then looked up.
    """
    last = eligible(packets).groupBy("capture_id").agg(F.max("seq").alias("last"))
    last = last.withColumnRenamed("capture_id", "of")
    there = F.col("capture_id").eqNullSafe(F.col("of")) & (F.col("seq") == F.col("last"))
    return packet_details(packets.join(last, there, "left_semi"))
