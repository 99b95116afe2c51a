"""Headers, their guards, and frames cut at every length."""

import struct

import pytest

from flowtide import decode_packets
from flowtide.schema import FRAMES, PACKET_FIELDS

ETHER = bytes.fromhex("AABBCCDDEEFF112233445566")


def ipv4(number, payload, words=0, src=0x0A000001, dst=0xC0A80102, ttl=64):
    head = bytes([0x45 + words]) + bytes(7) + bytes([ttl, number]) + bytes(2)
    return ETHER + b"\x08\x00" + head + struct.pack(">II", src, dst) + b"\x01" * 4 * words + payload


def ipv6(number, payload, hop=255):
    src, dst = bytes(range(16)), bytes(range(16, 32))
    return ETHER + b"\x86\xdd" + b"\x60" + bytes(5) + bytes([number, hop]) + src + dst + payload


TCP = struct.pack(">HH", 51000, 443) + bytes(16)
UDP = struct.pack(">HH", 65535, 53) + bytes(4)
ECHO = bytes([8, 3]) + bytes(6)

SAMPLES = {
    "tcp4": ipv4(6, TCP),
    "tcp4_options": ipv4(6, TCP, words=2),
    "udp4": ipv4(17, UDP, src=0xFFFFFFFF, dst=0x80000000),
    "icmp4": ipv4(1, ECHO),
    "gre4": ipv4(47, bytes(30)),
    "tcp6": ipv6(6, TCP),
    "udp6": ipv6(17, UDP),
    "icmp6": ipv6(58, ECHO),
    "icmp4_in_6": ipv6(1, ECHO),
    "icmp6_in_4": ipv4(58, ECHO),
    "hop_by_hop": ipv6(0, bytes(8) + TCP),
    "arp": ETHER + b"\x08\x06" + bytes(28),
    "vlan": ETHER + b"\x81\x00\x00\x01\x08\x00" + ipv4(6, TCP)[14:],
    # The header length field is trusted: 0 words put "ports" at its own start.
    "short_ihl": ETHER + b"\x08\x00" + b"\x40" + ipv4(6, TCP)[15:],
    "ihl_15": ipv4(6, TCP, words=10),
}


def expected(frame: bytes) -> dict:
    """The rules, byte by byte."""
    out = dict.fromkeys(
        "src_mac dst_mac src_ip dst_ip src_port dst_port tcp_flags icmp_type icmp_code src_ip6 dst_ip6".split()
    )
    out |= dict(ether_type=0, protocol=0, ttl=0)
    out |= dict.fromkeys("has_ipv4 has_ipv6 has_transport has_icmp has_icmpv6".split(), False)
    if len(frame) < 14:
        return out
    out |= dict(dst_mac=frame[:6], src_mac=frame[6:12], ether_type=int.from_bytes(frame[12:14], "big"))
    body = frame[14:]
    if out["ether_type"] == 0x0800:
        if len(body) < 20 or len(body) < (body[0] & 15) * 4:
            return out
        src, dst = struct.unpack(">II", body[12:20])
        out |= dict(has_ipv4=True, src_ip=src, dst_ip=dst, protocol=body[9], ttl=body[8])
        upper, icmp = body[(body[0] & 15) * 4 :], (1, "has_icmp")
    elif out["ether_type"] == 0x86DD:
        if len(body) < 40:
            return out
        out |= dict(has_ipv6=True, src_ip6=body[8:24], dst_ip6=body[24:40], protocol=body[6], ttl=body[7])
        upper, icmp = body[40:], (58, "has_icmpv6")
    else:
        return out
    if len(upper) >= {6: 20, 17: 8}.get(out["protocol"], 1 << 30):
        ports = struct.unpack(">HH", upper[:4])
        out |= dict(has_transport=True, src_port=ports[0], dst_port=ports[1])
        if out["protocol"] == 6:
            out["tcp_flags"] = upper[13]
    if out["protocol"] == icmp[0] and len(upper) >= 8:
        out |= {icmp[1]: True, "icmp_type": upper[0], "icmp_code": upper[1]}
    return out


def decode(spark, frames):
    rows = [(i, bytearray(f)) for i, f in enumerate(frames)]
    out = decode_packets(spark.createDataFrame(rows, "seq bigint, frame binary")).collect()
    return {
        r["seq"]: {k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items() if k != "seq"}
        for r in out
    }


def test_every_sample_at_every_length(spark):
    frames = [f[:n] for f in SAMPLES.values() for n in range(len(f) + 1)]
    got = decode(spark, frames)
    for i, frame in enumerate(frames):
        assert got[i] == expected(frame), frame.hex()


@pytest.mark.parametrize(
    "name, fields",
    [
        ("tcp4", dict(src_ip=0x0A000001, src_port=51000, dst_port=443, ttl=64, protocol=6)),
        ("tcp4_options", dict(has_transport=True, src_port=51000)),
        ("udp4", dict(src_ip=0xFFFFFFFF, dst_ip=0x80000000, src_port=65535)),
        ("icmp6", dict(has_icmpv6=True, has_icmp=False, icmp_type=8, icmp_code=3, ttl=255)),
        ("icmp6_in_4", dict(has_icmpv6=False, has_icmp=False, protocol=58)),
        ("hop_by_hop", dict(has_ipv6=True, has_transport=False, protocol=0)),
        ("vlan", dict(ether_type=0x8100, has_ipv4=False, protocol=0)),
        ("short_ihl", dict(has_transport=True, src_port=0x4000)),
    ],
)
def test_known_fields(spark, name, fields):
    got = decode(spark, [SAMPLES[name]])[0]
    assert {k: got[k] for k in fields} == fields


def test_missing_frame_is_kept(spark):
    got = decode_packets(spark.createDataFrame([(1, None)], "seq bigint, frame binary")).collect()
    assert len(got) == 1 and got[0]["ether_type"] == 0 and not got[0]["has_ipv4"]


def test_filter_keeps_the_scan_compiled(spark, tmp_path):
    """Hot methods above 8000 bytes of bytecode are not compiled by the JVM."""
    import contextlib
    import io
    import re

    from flowtide.operators.flows import build_flows

    frames = spark.createDataFrame(
        [("a", 1, None, 1, 1, None)],
        "capture_id string, seq bigint, ts timestamp, caplen int, len bigint, frame binary",
    )
    frames.write.parquet(str(tmp_path / "f"))
    packets = decode_packets(spark.read.parquet(str(tmp_path / "f")))
    text = io.StringIO()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(text):
            build_flows(packets).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000


def test_columns_of_packets(spark):
    packets = decode_packets(spark.createDataFrame([], FRAMES))
    added = [(f.name, f.dataType) for f in packets.schema if f.name not in FRAMES.names]
    assert added == [(f.name, f.dataType) for f in PACKET_FIELDS]
