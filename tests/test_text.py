import ipaddress
import random
import socket

from pyspark.sql import functions as F

from flowtide.functions.text import (
    ethertype_text,
    ipv4_text,
    ipv6_text,
    mac_text,
    six_digit_text,
    six_digits,
    time_text,
)


def column(spark, values, kind, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", expression(F.col("v")).alias("o"))
    return [r["o"] for r in sorted(df.collect())]


def test_ipv6_text_matches_the_system(spark):
    rng = random.Random(7)
    addresses = [bytes(16), bytes(15) + b"\x01", bytes(12) + b"\x00\x01\x00\x02", bytes(12) + b"\x01\x02\x03\x04"]
    addresses += [bytes(10) + b"\xff\xff\x0a\x00\x00\x01", bytes(10) + b"\xff\xff" + bytes(4)]
    for pattern in range(256):
        for _ in range(3):
            groups = [
                b"\0\0" if pattern >> i & 1 else rng.choice([rng.randbytes(2), b"\0\x0a", b"\xff\xff", b"\x0a\0"])
                for i in range(8)
            ]
            addresses.append(b"".join(groups))
    got = column(spark, [bytearray(a) for a in addresses], "binary", ipv6_text)
    assert got == [socket.inet_ntop(socket.AF_INET6, a) for a in addresses]


def test_ipv4_mac_ethertype(spark):
    values = [0, 1, 0xFFFFFFFF, 0x80000000, 0x0A0B0C0D]
    assert column(spark, values, "bigint", ipv4_text) == [str(ipaddress.IPv4Address(v)) for v in values]
    assert column(spark, [bytearray.fromhex("00ff0a0b0c0d")], "binary", mac_text) == ["00:ff:0a:0b:0c:0d"]
    assert column(spark, [0, 0x800, 0x86DD], "int", ethertype_text) == ["0x0000", "0x0800", "0x86dd"]


def test_missing_values_stay_missing(spark):
    assert column(spark, [None], "binary", ipv6_text) == [None]
    assert column(spark, [None], "binary", mac_text) == [None]
    assert column(spark, [None], "bigint", ipv4_text) == [None]


def test_time_text(spark):
    got = spark.sql("SELECT TIMESTAMP'2024-02-29 23:59:59.999999' AS t").select(time_text(F.col("t"))).first()[0]
    assert got == "2024-02-29 23:59:59"


def values():
    rng = random.Random(3)
    fixed = [0.0, 74.0, 0.584995, 283.667, 1e6, 999999.5, 123456.5, 123455.5, 1234565.0, 1234575.0, 1e-5]
    fixed += [5124 / 42, 2.675, 1.0000005, 0.0001234565, 4.6187750e-06, -0.5, -1234.565, 1e300, 1e21, 3e-300]
    ties = [rng.randrange(10**6, 10**7) // 10 * 10 + 5 for _ in range(400)]
    ties = [n / 10 ** rng.randrange(0, 14) for n in ties]
    large = [float(rng.randrange(10**6, 10**7) // 10 * 10 + 5) * 10**k for k in range(1, 9)]
    rates = [rng.randrange(40, 10**6) / rng.randrange(1, 10**7) * 1e6 for _ in range(400)]
    return fixed + ties + large + rates


def test_six_digits_round_like_a_stream(spark):
    x = values()
    assert column(spark, x, "double", six_digits) == [float("%.5e" % v) for v in x]


def test_six_digit_text_is_default_stream_text(spark):
    x = values() + [float("inf"), float("-inf"), float("nan")]
    assert column(spark, x, "double", six_digit_text) == ["%g" % v for v in x]
