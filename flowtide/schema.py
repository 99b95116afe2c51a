"""Row layouts shared by every stage: frames, packets, flows and features."""

from pyspark.sql import types as T

#: A captured frame. ``seq`` is the arrival order and is unique within a
#: ``capture_id`` (one capture = one listening interface).
FRAMES = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("caplen", T.IntegerType()),
        T.StructField("len", T.LongType()),
        T.StructField("frame", T.BinaryType()),
    ]
)

#: What :func:`flowtide.operators.decode.decode_packets` adds to a frame.
PACKET_FIELDS = T.StructType(
    [
        T.StructField("src_mac", T.BinaryType()),
        T.StructField("dst_mac", T.BinaryType()),
        T.StructField("ether_type", T.IntegerType()),
        T.StructField("has_ipv4", T.BooleanType()),
        T.StructField("src_ip", T.LongType()),
        T.StructField("dst_ip", T.LongType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("has_transport", T.BooleanType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("has_icmp", T.BooleanType()),
        T.StructField("has_icmpv6", T.BooleanType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        T.StructField("has_ipv6", T.BooleanType()),
        T.StructField("src_ip6", T.BinaryType()),
        T.StructField("dst_ip6", T.BinaryType()),
    ]
)

#: Two packets belong to the same conversation direction when all of these
#: agree. An IPv4 packet has NULL ``*_ip6`` and an IPv6 one NULL ``*_ip``;
#: Spark groups NULLs together, so no sentinel is needed.
FLOW_KEY = (
    "capture_id",
    "ip_version",
    "src_ip",
    "dst_ip",
    "src_ip6",
    "dst_ip6",
    "src_port",
    "dst_port",
    "protocol",
)

#: The exported data set: fixed names in fixed order (fixed values).
FEATURES = T.StructType(
    [
        T.StructField("duration", T.DoubleType()),
        T.StructField("packets", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("packetsPerSecond", T.DoubleType()),
        T.StructField("bytesPerSecond", T.DoubleType()),
        T.StructField("averagePacketSize", T.DoubleType()),
        T.StructField("srcPort", T.IntegerType()),
        T.StructField("dstPort", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
    ]
)
