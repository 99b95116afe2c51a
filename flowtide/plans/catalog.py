"""The registered queries: every operator over whole tables.

Keys are shared with :mod:`flowtide.plans.oracle`, which states the same
results as plain SQL.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ethertype_text, ipv4_text, ipv6_text, mac_text, six_digit_text, six_digits, time_text
from ..operators import (
    active_flow_count,
    active_flows,
    build_flows,
    decode_packets,
    eligible,
    flow_features,
    flow_key,
    frame_count,
    latest_packet,
    packet_details,
    throughput,
    with_flow_key,
)
from ..operators.flows import (
    DIRECTION_MEASURES,
    ELIGIBLE,
    FLAG_MEASURES,
    GAP_MEASURES,
    SIZE_MEASURES,
    SKETCH_MEASURES,
    packet_gaps,
    packet_sizes,
    size_quantiles,
    two_way,
)
from ..schema import FLOW_KEY
from ..sources.capture_stream import stream_captures
from ..sources.captures import read_captures
from ..sources.csv_export import read_csv_export, start_csv_export
from ..sources.frames import stream_frames, with_snaplen
from ..sources.scratch import shared_folder
from ..sources.sinks import read_features_csv, write_features_csv, write_features_parquet
from ..streaming.export import start_export, stream_flow_features
from ..streaming.flow_table import (
    read_active_flows,
    read_features,
    read_latest_packets,
    start_flow_table,
)
from .traffic import (
    address_patterns,
    event_frames,
    event_packets,
    stored_frames,
    table,
    text_frames,
    write_capture_files,
)

Query = Callable[[SparkSession, str], DataFrame]

#: Idle times that fit the pace of ``events`` (a user acts every few hours).
DAY = 86_400
HALF_HOUR = 1_800
#: Arrival positions beyond the whole numbers of a double.
FAR = 4097 << 42
#: Moment of the snapshot queries.
AS_OF = "2024-01-15 12:00:00+00:00"


def portable(df: DataFrame) -> DataFrame:
    """Binary as hex and instants as microseconds, for comparison elsewhere."""
    shown = []
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind == "binary":
            shown.append(F.hex(field.name).alias(field.name))
        elif kind == "timestamp":
            shown.append(F.unix_micros(field.name).alias(field.name))
        else:
            shown.append(F.col(field.name))
    return df.select(*shown)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(table(spark, sf_dir, "events"))


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_packets(table(spark, sf_dir, "events"))


def _one_capture(df: DataFrame) -> DataFrame:
    return df.withColumn("capture_id", F.lit("all"))


# Decoding -----------------------------------------------------------------


def decode_ethernet(spark, sf_dir):
    packets = decode_packets(_frames(spark, sf_dir))
    return portable(packets.select("capture_id", "seq", "caplen", "len", "src_mac", "dst_mac", "ether_type"))


def decode_ipv4(spark, sf_dir):
    packets = decode_packets(_frames(spark, sf_dir))
    v4 = F.col("has_ipv4")
    return packets.select(
        "seq",
        "has_ipv4",
        "src_ip",
        "dst_ip",
        F.when(v4, F.col("protocol")).alias("protocol"),
        F.when(v4, F.col("ttl")).alias("ttl"),
    )


def decode_ipv6(spark, sf_dir):
    packets = decode_packets(_frames(spark, sf_dir))
    v6 = F.col("has_ipv6")
    return portable(
        packets.select(
            "seq",
            "has_ipv6",
            "src_ip6",
            "dst_ip6",
            F.when(v6, F.col("protocol")).alias("next_header"),
            F.when(v6, F.col("ttl")).alias("hop_limit"),
        )
    )


def decode_transport(spark, sf_dir):
    packets = decode_packets(_frames(spark, sf_dir))
    return packets.select("seq", "protocol", "has_transport", "src_port", "dst_port")


def decode_icmp(spark, sf_dir):
    packets = decode_packets(_frames(spark, sf_dir))
    return packets.select("seq", "has_icmp", "has_icmpv6", "icmp_type", "icmp_code")


def truncated_frames(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    cut = (F.col("seq") % 80).cast("int")
    short = frames.withColumn("frame", F.substring(F.col("frame"), F.lit(1), cut))
    short = short.withColumn("caplen", F.length("frame"))
    return decode_packets(short).select(
        "seq",
        "caplen",
        "ether_type",
        "has_ipv4",
        "has_ipv6",
        "protocol",
        "ttl",
        "has_transport",
        "src_port",
        "dst_port",
        "has_icmp",
        "has_icmpv6",
    )


def snaplen(spark, sf_dir):
    kept = with_snaplen(text_frames(table(spark, sf_dir, "documents")))
    return kept.select("seq", "caplen", "len", F.md5(F.hex("frame")).alias("digest"))


def capture_files(spark, sf_dir):
    folder = shared_folder(spark, "captures")
    write_capture_files(spark.read.parquet(stored_frames(spark, sf_dir)), folder)
    return _digests(read_captures(spark, folder, capture_by="directory", split_bytes=1 << 16))


def _digests(frames: DataFrame, *more: str) -> DataFrame:
    return frames.select(
        F.substring_index("capture_id", "/", -1).alias("capture"),
        F.unix_micros("ts").alias("us"),
        "caplen",
        "len",
        F.md5(F.hex("frame")).alias("digest"),
        *more,
    )


def stream_capture_files(spark, sf_dir):
    folder = shared_folder(spark, "stream-captures")
    write_capture_files(spark.read.parquet(stored_frames(spark, sf_dir)), f"{folder}/in")
    stream_captures(spark, f"{folder}/in", capture_by="directory").writeStream.format("parquet").option(
        "path", f"{folder}/frames"
    ).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    frames = spark.read.parquet(f"{folder}/frames")
    return _digests(frames, "seq")


# Text ---------------------------------------------------------------------


def packet_text(spark, sf_dir):
    return packet_details(decode_packets(_frames(spark, sf_dir)))


def mac_ip_text(spark, sf_dir):
    packets = _packets(spark, sf_dir)
    return packets.select(
        "seq",
        mac_text(F.col("src_mac")).alias("src_mac_text"),
        ethertype_text(F.col("ether_type")).alias("ether_type_text"),
        ipv4_text(F.col("src_ip")).alias("src_ip_text"),
        ipv6_text(F.col("src_ip6")).alias("src_ip6_text"),
    )


def ipv6_zero_runs(spark, sf_dir):
    addresses = address_patterns(table(spark, sf_dir, "events"))
    return addresses.select("event_id", ipv6_text(F.col("address")).alias("address_text"))


def time_of_day_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", time_text(F.col("ts")).alias("ts_text"))


def six_digit_format(spark, sf_dir):
    price = F.col("l_extendedprice").cast("double")
    x = price / (F.col("l_quantity").cast("double") + F.col("l_linenumber"))
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", x.alias("x"))
        .select(
            "l_orderkey",
            "l_linenumber",
            six_digits(F.col("x")).alias("rounded"),
            six_digit_text(F.col("x")).alias("text"),
            six_digit_text(F.col("x") / 1e9).alias("small_text"),
            six_digit_text(F.col("x") * 1e4).alias("large_text"),
        )
    )


# Flows --------------------------------------------------------------------


def frames_per_capture(spark, sf_dir):
    return frame_count(_packets(spark, sf_dir))


def flow_eligibility(spark, sf_dir):
    return (
        _packets(spark, sf_dir)
        .groupBy("capture_id", F.expr(ELIGIBLE).alias("eligible"), "protocol")
        .agg(F.count(F.lit(1)).alias("frames"))
    )


def packet_flow_keys(spark, sf_dir):
    return portable(flow_key(_packets(spark, sf_dir)))


def flow_key_totals(spark, sf_dir):
    keyed = with_flow_key(eligible(_packets(spark, sf_dir)))
    return portable(
        keyed.groupBy(*FLOW_KEY).agg(F.count(F.lit(1)).alias("packets"), F.sum("len").alias("bytes"))
    )


def flows_eager(spark, sf_dir):
    return portable(build_flows(_packets(spark, sf_dir), "eager", DAY))


def flows_eager_half_hour(spark, sf_dir):
    return portable(build_flows(_packets(spark, sf_dir), "eager", HALF_HOUR))


def flows_arrival(spark, sf_dir):
    return portable(build_flows(_packets(spark, sf_dir), "arrival", DAY))


def flows_arrival_half_hour(spark, sf_dir):
    return portable(build_flows(_packets(spark, sf_dir), "arrival", HALF_HOUR))


def flows_one_capture(spark, sf_dir):
    packets = _one_capture(_packets(spark, sf_dir))
    return portable(build_flows(packets, "arrival", HALF_HOUR, block_packets=1 << 12))


def flows_far_positions(spark, sf_dir):
    packets = _packets(spark, sf_dir).withColumn("seq", F.col("seq") + F.lit(FAR))
    return portable(build_flows(packets, "arrival", HALF_HOUR))


def _some_null(packets: DataFrame) -> DataFrame:
    return packets.withColumn("capture_id", F.nullif("capture_id", F.lit("3")))


def flows_null_captures(spark, sf_dir):
    return portable(build_flows(_some_null(_packets(spark, sf_dir)), "arrival", HALF_HOUR))


def flows_null_captures_eager(spark, sf_dir):
    return portable(build_flows(_some_null(_packets(spark, sf_dir)), "eager", HALF_HOUR))


def flow_packet_sizes(spark, sf_dir):
    return portable(packet_sizes(build_flows(_packets(spark, sf_dir), "arrival", HALF_HOUR, more=SIZE_MEASURES)))


def flow_packet_gaps(spark, sf_dir):
    flows = build_flows(_packets(spark, sf_dir), "arrival", DAY, block_packets=1 << 10, more=GAP_MEASURES)
    return portable(packet_gaps(flows))


def flow_size_quantiles(spark, sf_dir):
    return portable(size_quantiles(build_flows(_packets(spark, sf_dir), "arrival", DAY, more=SKETCH_MEASURES)))


def flow_tcp_flags(spark, sf_dir):
    packets = decode_packets(spark.read.parquet(stored_frames(spark, sf_dir)))
    return portable(build_flows(packets, "eager", DAY, more=FLAG_MEASURES))


def two_way_flows(spark, sf_dir):
    """Every second packet is turned around, so that conversations have two directions."""
    packets = _packets(spark, sf_dir)
    back = F.col("seq") % 2 == 1
    turned = {}
    for part in ("ip", "ip6", "port"):
        src, dst = F.col(f"src_{part}"), F.col(f"dst_{part}")
        turned[f"src_{part}"] = F.when(back, dst).otherwise(src)
        turned[f"dst_{part}"] = F.when(back, src).otherwise(dst)
    flows = build_flows(two_way(packets.withColumns(turned)), "eager", HALF_HOUR, more=DIRECTION_MEASURES)
    return portable(flows)


def flow_features_closed(spark, sf_dir):
    return flow_features(build_flows(_packets(spark, sf_dir), "eager", DAY))


def flow_features_all(spark, sf_dir):
    return flow_features(build_flows(_packets(spark, sf_dir), "arrival", DAY), include_open=True)


def frames_to_features(spark, sf_dir):
    frames = spark.read.parquet(stored_frames(spark, sf_dir))
    return flow_features(build_flows(decode_packets(frames), "arrival", DAY))


def throughput_label(spark, sf_dir):
    flows = throughput(build_flows(_packets(spark, sf_dir), "eager", DAY))
    return flows.select("capture_id", "first_seq", "duration", "bps", "pps", "burst_bytes")


# Dashboard ----------------------------------------------------------------


def active_flows_now(spark, sf_dir):
    return active_flows(_packets(spark, sf_dir), None, "arrival", DAY)


def active_flows_as_of(spark, sf_dir):
    return active_flows(_packets(spark, sf_dir), AS_OF, "arrival", DAY)


def active_flows_as_of_eager(spark, sf_dir):
    return active_flows(_packets(spark, sf_dir), AS_OF, "eager", DAY)


def active_flow_counts(spark, sf_dir):
    return active_flow_count(active_flows(_packets(spark, sf_dir), AS_OF, "arrival", DAY))


def latest_packets(spark, sf_dir):
    return latest_packet(_packets(spark, sf_dir))


# Sinks --------------------------------------------------------------------


def csv_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "features-csv")
    write_features_csv(flow_features_closed(spark, sf_dir), folder)
    return read_features_csv(spark, folder)


def csv_compat_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "features-compat")
    write_features_csv(flow_features_closed(spark, sf_dir), folder, compat_format=True)
    return spark.read.option("header", True).csv(folder)


def parquet_roundtrip(spark, sf_dir):
    folder = shared_folder(spark, "features-parquet")
    write_features_parquet(flow_features_closed(spark, sf_dir), folder)
    return spark.read.parquet(folder)


# Streams ------------------------------------------------------------------


def _packet_stream(spark, sf_dir):
    return decode_packets(stream_frames(spark, stored_frames(spark, sf_dir)))


def stream_features(spark, sf_dir):
    folder = shared_folder(spark, "stream-features")
    features = stream_flow_features(_one_capture(_packet_stream(spark, sf_dir)), "0 seconds", DAY)
    start_export(
        features, f"{folder}/data", f"{folder}/checkpoint", trigger={"availableNow": True}
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/data")


def stream_csv_export(spark, sf_dir):
    folder = shared_folder(spark, "stream-csv")
    features = stream_flow_features(_one_capture(_packet_stream(spark, sf_dir)), "0 seconds", DAY)
    start_csv_export(
        features, f"{folder}/data", f"{folder}/checkpoint", trigger={"availableNow": True}
    ).awaitTermination()
    return read_csv_export(spark, f"{folder}/data")


def _run_flow_table(spark, sf_dir, mode, packets=None, idle=DAY):
    folder = shared_folder(spark, "flow-table")
    packets = _packet_stream(spark, sf_dir) if packets is None else packets
    start_flow_table(packets, folder, mode, idle, trigger={"availableNow": True}).awaitTermination()
    return folder


def stream_table_features(spark, sf_dir):
    return read_features(spark, _run_flow_table(spark, sf_dir, "eager"))


def stream_arrival_features(spark, sf_dir):
    return read_features(spark, _run_flow_table(spark, sf_dir, "arrival", idle=HALF_HOUR))


def stream_active_flows(spark, sf_dir):
    return read_active_flows(spark, _run_flow_table(spark, sf_dir, "arrival"))


def stream_latest_packets(spark, sf_dir):
    return read_latest_packets(spark, _run_flow_table(spark, sf_dir, "arrival"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        decode_ethernet,
        decode_ipv4,
        decode_ipv6,
        decode_transport,
        decode_icmp,
        truncated_frames,
        snaplen,
        capture_files,
        packet_text,
        mac_ip_text,
        ipv6_zero_runs,
        time_of_day_text,
        six_digit_format,
        frames_per_capture,
        flow_eligibility,
        packet_flow_keys,
        flow_key_totals,
        flows_eager,
        flows_eager_half_hour,
        flows_arrival,
        flows_arrival_half_hour,
        flows_one_capture,
        flows_far_positions,
        flows_null_captures,
        flows_null_captures_eager,
        flow_packet_sizes,
        flow_packet_gaps,
        flow_size_quantiles,
        flow_tcp_flags,
        two_way_flows,
        flow_features_closed,
        flow_features_all,
        frames_to_features,
        throughput_label,
        active_flows_now,
        active_flows_as_of,
        active_flows_as_of_eager,
        active_flow_counts,
        latest_packets,
        csv_roundtrip,
        csv_compat_roundtrip,
        parquet_roundtrip,
        stream_capture_files,
        stream_features,
        stream_csv_export,
        stream_table_features,
        stream_arrival_features,
        stream_active_flows,
        stream_latest_packets,
    )
}
