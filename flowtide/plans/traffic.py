"""Network traffic derived from the ``events`` table.

Every event becomes one captured frame, encoded byte by byte in SQL, so that
the decoders and flow operators run over the whole table and a plain SQL query
over ``events`` can tell the expected result.

* capture ``user_id % 8``, arrival position ``event_id``, time ``ts``;
* users whose id divides by 3 speak IPv6, the others IPv4 with 0, 1 or 2 words
  of header options (``event_id % 3``);
* even users speak TCP to port 443 with flags ``event_id % 64``, odd users UDP to port 53;
* ``error`` events are traffic that makes no flow. By ``event_id % 4``: an ICMP
  message, an ARP frame, a VLAN-tagged frame, or a protocol without ports.
"""

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_package
from ..sources.files import locate
from ..sources.scratch import named_here, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A zone-less time read as UTC, whatever the session time zone.
_SINCE = "(ts - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
_MINUTES = f"((extract(DAY FROM {_SINCE}) * 24L + extract(HOUR FROM {_SINCE})) * 60 + extract(MINUTE FROM {_SINCE}))"
_INSTANT = (
    f"timestamp_micros({_MINUTES} * 60000000 + CAST(extract(SECOND FROM {_SINCE}) * 1000000 AS BIGINT))"
)


def _hex(value: str, digits: int) -> str:
    return f"lpad(hex({value}), {digits}, '0')"


# What each event looks like on the wire; used by both forms below.
_SHAPE = (
    "*",
    "event_type = 'error' AS flowless",
    "event_id % 4 AS variant",
    "user_id % 3 = 0 AS v6",
    "user_id % 2 = 0 AS even",
    "32 + event_id % 200 AS hop",
    "167772160 + user_id AS ip",
    "1024 + user_id % 50000 AS port",
    "event_id % 256 AS message_type",
    "event_id % 16 AS message_code",
    f"concat('20010DB80000000000000000', {_hex('user_id', 8)}) AS src6",
    f"concat('FE8000000000', {_hex('1 + user_id % 65535', 4)}, '000000000000', {_hex('user_id % 7', 4)}) AS dst6",
    f"concat('0200', {_hex('user_id', 8)}) AS src_hw",
    f"concat('0201', {_hex('event_id', 8)}) AS dst_hw",
)
_NUMBERS = (
    "*",
    "flowless AND variant IN (1, 2) AS no_ip",
    """CASE WHEN NOT flowless THEN IF(even, 6, 17) WHEN variant = 0 THEN IF(v6, 58, 1)
            ELSE IF(v6, 0, 47) END AS number""",
    """CASE WHEN flowless AND variant = 1 THEN 2054 WHEN flowless AND variant = 2 THEN 33024
            WHEN v6 THEN 34525 ELSE 2048 END AS kind""",
    "CAST(IF(v6, 0, event_id % 3) AS INT) AS option_words",
    "IF(even, 443, 53) AS service",
)
_ARRIVAL = (
    "CAST(user_id % 8 AS STRING) AS capture_id",
    "event_id AS seq",
    f"{_INSTANT} AS ts",
    "74 + event_id % 1447 AS len",
)


def _shaped(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_SHAPE).selectExpr(*_NUMBERS)


def event_frames(events: DataFrame) -> DataFrame:
    """``events`` as frames in the :data:`flowtide.schema.FRAMES` layout."""
    ip4 = f"""concat('4', hex(5 + option_words), '00000000000000', {_hex('hop', 2)}, {_hex('number', 2)},
        '0000', {_hex('ip', 8)}, '0A010000', repeat('01010101', option_words))"""
    ip6 = f"concat('600000000000', {_hex('number', 2)}, {_hex('hop', 2)}, src6, dst6)"
    message = f"concat({_hex('message_type', 2)}, {_hex('message_code', 2)}, '000000000000')"
    tcp = f"concat(repeat('0', 16), '50', {_hex('event_id % 64', 2)}, repeat('0', 12))"
    ports = f"concat({_hex('port', 4)}, {_hex('service', 4)}, IF(even, {tcp}, '00000000'))"
    return (
        _shaped(events)
        .selectExpr(
            *_ARRIVAL,
            f"""unhex(concat(dst_hw, src_hw, {_hex('kind', 4)}, IF(v6, {ip6}, {ip4}),
                             IF(flowless, {message}, {ports}))) AS frame""",
        )
        .selectExpr("capture_id", "seq", "ts", "length(frame) AS caplen", "len", "frame")
    )


def event_packets(events: DataFrame) -> DataFrame:
    """``events`` as decoded packets, by arithmetic, without the byte form.

    Equal to ``decode_packets(event_frames(events))`` but for ``caplen``; the
    flow queries start here so that their plans show flow work only.
    """
    return _shaped(events).selectExpr(
        *_ARRIVAL,
        "unhex(src_hw) AS src_mac",
        "unhex(dst_hw) AS dst_mac",
        "kind AS ether_type",
        "NOT no_ip AND NOT v6 AS has_ipv4",
        "IF(no_ip OR v6, NULL, ip) AS src_ip",
        "IF(no_ip OR v6, NULL, 167837696L) AS dst_ip",
        "IF(no_ip, 0, number) AS protocol",
        "CAST(IF(no_ip, 0, hop) AS INT) AS ttl",
        "NOT flowless AS has_transport",
        "CAST(IF(flowless, NULL, port) AS INT) AS src_port",
        "IF(flowless, NULL, service) AS dst_port",
        "CAST(IF(flowless OR NOT even, NULL, event_id % 64) AS INT) AS tcp_flags",
        "flowless AND variant = 0 AND NOT v6 AS has_icmp",
        "flowless AND variant = 0 AND v6 AS has_icmpv6",
        "CAST(IF(flowless AND variant = 0, message_type, NULL) AS INT) AS icmp_type",
        "CAST(IF(flowless AND variant = 0, message_code, NULL) AS INT) AS icmp_code",
        "NOT no_ip AND v6 AS has_ipv6",
        "IF(NOT no_ip AND v6, unhex(src6), NULL) AS src_ip6",
        "IF(NOT no_ip AND v6, unhex(dst6), NULL) AS dst_ip6",
    )


def text_frames(documents: DataFrame) -> DataFrame:
    """Each document as one frame whose payload is its whole text."""
    header = F.unhex(F.lit("02000000000102000000000288B5"))
    frame = F.concat(header, F.encode("text", "UTF-8"))
    return documents.select(
        F.col("source").alias("capture_id"),
        F.col("doc_id").alias("seq"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.length(frame).alias("caplen"),
        F.length(frame).cast("bigint").alias("len"),
        frame.alias("frame"),
    )


def address_patterns(events: DataFrame) -> DataFrame:
    """One 16-byte address per event: bit ``i`` of ``event_id`` zeroes group
    ``i``, so that every pattern of zero groups occurs; every 97th address is an
    IPv4 one in IPv6 form."""
    groups = ", ".join(
        f"IF(shiftright(event_id, {i}) & 1 = 1, '0000', {_hex(f'1 + (event_id * 31 + {i * 7}) % 65535', 4)})"
        for i in range(8)
    )
    mapped = f"concat(repeat('0', 20), 'FFFF', {_hex('event_id * 7919', 8)})"
    return events.selectExpr("event_id", f"unhex(IF(event_id % 97 = 0, {mapped}, concat({groups}))) AS address")


_stored: dict[tuple, str] = {}


def stored_frames(spark: SparkSession, sf_dir: str) -> str:
    """Folder of Parquet frame files made from ``events``, written once per
    application. Byte frames normally come from storage; this is that storage."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if not named_here(spark, _stored.get(known)):
        folder = shared_folder(spark, "frames")
        frames = event_frames(table(spark, sf_dir, "events"))
        tasks = spark.sparkContext.defaultParallelism
        frames.repartitionByRange(tasks, "seq").write.parquet(folder)
        _stored[known] = folder
    return _stored[known]


def _write_captures(folder: str):
    """Task body: one capture file per run of rows with the same capture."""

    def write(batches):
        target = None
        system, root = locate(folder)
        current = name = None
        written, held = 0, bytearray()
        for batch in batches:
            for row in batch.to_pylist():
                if row["capture_id"] != current:
                    if target is not None:
                        target.write(bytes(held))
                        held.clear()
                        target.close()
                    current = row["capture_id"]
                    system.create_dir(f"{root}/{current}", recursive=True)
                    name = f"{root}/{current}/{row['seq']:020d}.pcap"
                    target = system.open_output_stream(name)
                    held += struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)
                seconds, micros = divmod(row["us"], 1_000_000)
                held += struct.pack("<IIII", seconds, micros, len(row["frame"]), row["len"])
                held += row["frame"]
                written += 1
            if target is not None:
                target.write(bytes(held))
                held.clear()
        if target is not None:
            target.close()
        yield pa.RecordBatch.from_pydict({"frames": pa.array([written], pa.int64())})

    return write


def write_capture_files(frames: DataFrame, folder: str) -> int:
    """Write frames as capture files, a sub-folder per capture and files that
    continue each other in name order. Returns the number of frames."""
    ship_package(frames.sparkSession)
    ordered = frames.select(
        "capture_id", "seq", F.unix_micros("ts").alias("us"), "len", "frame"
    )
    return (
        ordered.repartitionByRange("capture_id", "seq")
        .sortWithinPartitions("capture_id", "seq")
        .mapInArrow(_write_captures(folder), "frames bigint")
        .agg(F.sum("frames"))
        .first()[0]
    )
