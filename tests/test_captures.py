import random
import struct

import pytest
from pyspark.sql import functions as F

from flowtide.sources.capture_stream import stream_captures
from flowtide.sources.captures import MOST_TASKS, _Capture, _walk, natural_order, plan_splits, read_captures
from flowtide.sources.frames import with_snaplen

HEADS = {  # byte order, magic, fraction units per second
    "little_micro": ("<", 0xA1B2C3D4, 10**6),
    "big_micro": (">", 0xA1B2C3D4, 10**6),
    "little_nano": ("<", 0xA1B23C4D, 10**9),
    "big_nano": (">", 0xA1B23C4D, 10**9),
}


def pcap(records, kind="little_micro", cut=0):
    order, magic, unit = HEADS[kind]
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for us, wire, body in records:
        out += struct.pack(order + "IIII", us // 10**6, us % 10**6 * (unit // 10**6), len(body), wire) + body
    return out[: len(out) - cut]


def make(count, seed=0, size=400):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        body = rng.randbytes(rng.randrange(14, size))
        out.append((1_700_000_000_000_000 + i * 1234567, len(body) + rng.randrange(0, 50), body))
    return out


def rows(df):
    got = df.select("capture_id", "seq", F.unix_micros("ts").alias("us"), "caplen", "len", "frame").collect()
    return sorted((r["capture_id"].rsplit("/", 1)[-1], r["seq"], r["us"], r["len"], bytes(r["frame"])) for r in got)


def want(name, records, first=0):
    return [(name, first + i, us, wire, body) for i, (us, wire, body) in enumerate(records)]


@pytest.mark.parametrize("kind", HEADS)
def test_byte_orders_and_clock_units(spark, tmp_path, kind):
    records = make(20)
    (tmp_path / "x y%20#.pcap").write_bytes(pcap(records, kind))
    assert rows(read_captures(spark, str(tmp_path))) == want("x y%20#.pcap", records)


def test_files_without_packets_and_cut_records(spark, tmp_path):
    records = make(9)
    (tmp_path / "a.pcap").write_bytes(pcap([]))
    (tmp_path / "b.pcap").write_bytes(pcap(records, cut=1))
    (tmp_path / "c.pcap").write_bytes(pcap(records, cut=len(records[-1][2]) + 3))
    expected = want("b.pcap", records[:-1]) + want("c.pcap", records[:-1])
    assert rows(read_captures(spark, str(tmp_path))) == expected


def test_one_task_per_file(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(pcap(make(3)))
    assert read_captures(spark, str(tmp_path)).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("split_bytes", [150, 700, 5000])
def test_splits_give_the_same_frames(spark, tmp_path, split_bytes):
    """Also splits that lie within one record."""
    records = make(30, seed=split_bytes)
    (tmp_path / "x.pcap").write_bytes(pcap(records))
    assert rows(read_captures(spark, str(tmp_path), split_bytes=split_bytes)) == want("x.pcap", records)


def test_payload_that_looks_like_records_is_not_believed(spark, tmp_path):
    """A capture of capture files: guesses land inside payloads and are mended."""
    inner = pcap(make(40, seed=5, size=60))
    records = [(1_700_000_000_000_000 + i, len(inner), inner) for i in range(12)]
    (tmp_path / "x.pcap").write_bytes(pcap(records))
    got = rows(read_captures(spark, str(tmp_path), snaplen=1 << 20, split_bytes=3000))
    assert got == want("x.pcap", records)


def test_rotated_files_of_a_folder(spark, tmp_path):
    first, second, other = make(30, 1), make(25, 2), make(5, 3)
    for name, records in (("eth0/1.pcap", first), ("eth0/2.pcap", second), ("eth1/1.pcap", other)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(pcap(records))
    got = rows(read_captures(spark, str(tmp_path), capture_by="directory", split_bytes=2000))
    room = (len(pcap(first)) - 24) // 16 + 1
    assert got == want("eth0", first) + want("eth0", second, room) + want("eth1", other)


def test_snap_length(spark, tmp_path):
    body = bytes(range(256)) * 12
    (tmp_path / "x.pcap").write_bytes(pcap([(0, 5000, body)]))
    for df in (
        read_captures(spark, str(tmp_path)),
        with_snaplen(read_captures(spark, str(tmp_path), snaplen=4000)),
    ):
        row = df.first()
        assert (row["caplen"], row["len"], bytes(row["frame"])) == (2048, 5000, body[:2048])


@pytest.mark.parametrize(
    "content, message",
    [
        (b"\x0a\x0d\x0d\x0a" + bytes(60), "pcapng"),
        (b"not a capture file at all", "not a pcap"),
        (b"\xd4\xc3\xb2\xa1", "shorter"),
        (pcap([]) + struct.pack("<IIII", 1, 1, 1 << 30, 1 << 30), "claims"),
    ],
)
def test_foreign_files_are_refused(spark, tmp_path, content, message):
    (tmp_path / "x").write_bytes(content)
    with pytest.raises(Exception, match=message):
        read_captures(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("split_bytes", [500, 1000, 2000, 5000])
def test_plausible_records_before_noise_are_not_believed(spark, tmp_path, split_bytes):
    """A guess may land on twenty good records that end in noise; the read goes on."""
    inner = pcap(make(20, seed=6, size=60))[24:]
    records = [(1_700_000_000_000_000 + i, 4000, inner + b"\xff" * (4000 - len(inner))) for i in range(10)]
    (tmp_path / "x.pcap").write_bytes(pcap(records))
    (tmp_path / "y.pcap").write_bytes(pcap(make(9)))
    got = rows(read_captures(spark, str(tmp_path), snaplen=None, split_bytes=split_bytes))
    assert got == want("x.pcap", records) + want("y.pcap", make(9))


@pytest.mark.parametrize("split_bytes", [1000, 1 << 20])
def test_damage_is_named(spark, tmp_path, split_bytes):
    good = pcap(make(30))
    (tmp_path / "bad.pcap").write_bytes(good + struct.pack("<IIII", 1, 1, 1 << 30, 1 << 30) + bytes(3000))
    with pytest.raises(Exception, match=rf"bad.pcap: record at {len(good)} claims"):
        read_captures(spark, str(tmp_path), split_bytes=split_bytes).collect()


def test_natural_order_of_rotated_files(spark, tmp_path):
    parts = {f"trace.pcap{i}": make(2, i) for i in range(1, 12)}
    for name, records in parts.items():
        (tmp_path / name).write_bytes(pcap(records))
    got = rows(read_captures(spark, str(tmp_path), capture_by="directory"))
    assert [r[4] for r in got] == [body for records in parts.values() for _, _, body in records]
    names = spark.createDataFrame([("a.9",), ("a.10",), ("b1",), ("a.9.5",)], "path string").orderBy(natural_order())
    assert [r.path for r in names.collect()] == ["a.9", "a.9.5", "a.10", "b1"]


def test_a_million_splits_are_planned_into_bounded_positions(spark):
    files = spark.range(4000).selectExpr("concat('/f/x.', id) AS path", f"{(32 << 30) - 5}L AS length")
    got = plan_splits(files, "directory", 128 << 20).agg(
        F.count(F.lit(1)).alias("n"), F.max("base").alias("last"), F.countDistinct("base").alias("files")
    ).first()
    assert got["n"] == 4000 * 256 > MOST_TASKS and got["files"] == 4000 and got["last"] < 1 << 53


def test_headers_only_give_the_same_flows(spark, tmp_path):
    from flowtide import build_flows, decode_packets

    body = bytes(12) + b"\x08\x00\x45" + bytes(8) + b"\x11" + bytes(10) + bytes(20)
    records = [(1_700_000_000_000_000 + i * 7_000_000 * (1 + 5 * (i % 9 == 0)), 60, body) for i in range(60)]
    (tmp_path / "x.pcap").write_bytes(pcap(records))
    packets = decode_packets(read_captures(spark, str(tmp_path)))
    ticks = read_captures(spark, str(tmp_path), headers_only=True)
    assert ticks.where("frame IS NOT NULL").count() == 0
    for mode in ("eager", "arrival"):
        whole, light = build_flows(packets, mode), build_flows(packets, mode, ticks=ticks)
        assert sorted(map(str, whole.collect())) == sorted(map(str, light.collect())) and whole.count() > 1


def take_in(spark, source, place, **options):
    """All that is there, as a stream that goes on from the last time."""
    stream_captures(spark, str(source), **options).writeStream.format("parquet").option("path", f"{place}/out").option(
        "checkpointLocation", f"{place}/cp"
    ).trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.parquet(f"{place}/out"))


def test_stream_of_rotated_files_is_one_capture(spark, tmp_path):
    """Positions are dense and in natural order, though all files have one time."""
    import os

    source = tmp_path / "in"
    source.mkdir()
    parts = [make(4, 1), make(5, 2), make(3, 3)]
    for name, records in zip(("x.2", "x.9", "x.10"), parts):
        (source / name).write_bytes(pcap(records))
        os.utime(source / name, (1_700_000_000, 1_700_000_000))
    got = take_in(spark, source, tmp_path, capture_by="directory", split_bytes=500)
    assert got == want("in", parts[0] + parts[1] + parts[2])
    batch = rows(read_captures(spark, str(source), capture_by="directory"))
    assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in batch]


def test_stream_of_growing_files_and_late_names(spark, tmp_path):
    """A record that is cut waits for its rest; files that grow and names that come late go on at the next position."""
    source = tmp_path / "in"
    source.mkdir()
    a, b, late = make(6, 1), make(4, 2), make(3, 3)
    (source / "x.5").write_bytes(pcap(a[:3], cut=7))
    assert take_in(spark, source, tmp_path, capture_by="directory") == want("in", a[:2])
    (source / "x.5").write_bytes(pcap(a))
    (source / "x.6").write_bytes(pcap(b[:1]))
    assert take_in(spark, source, tmp_path, capture_by="directory") == want("in", a + b[:1])
    (source / "x.1").write_bytes(pcap(late))
    (source / "x.6").write_bytes(pcap(b))
    (source / "x.7").write_bytes(b"short")
    assert take_in(spark, source, tmp_path, capture_by="directory") == want("in", a + b[:1] + late + b[1:])


def test_capture_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    records = {"a.pcap": make(4, 1), "b.pcap": make(6, 2)}
    for name, r in records.items():
        (source / name).write_bytes(pcap(r))
    query = (
        stream_captures(spark, str(source), max_files_per_trigger=1)
        .writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        .option("path", str(tmp_path / "out"))
        .format("parquet")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want("a.pcap", records["a.pcap"]) + want(
        "b.pcap", records["b.pcap"]
    )


def test_small_splits_read_little_more_than_themselves(tmp_path):
    """To guess and walk the splits of a file reads it about twice, not once more per split."""
    (tmp_path / "a.pcap").write_bytes(pcap(make(8000)))
    length, split, asked = (tmp_path / "a.pcap").stat().st_size, 1 << 16, []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, size, start):
            chunk = self.file.read_at(size, start)
            asked.append(len(chunk))
            return chunk

    expected = 24
    with _Capture(str(tmp_path / "a.pcap")) as capture:
        whole, capture.file = capture.file, Counted(capture.file)
        for start in range(0, length, split):
            found = capture.guess(start) if start else expected
            assert found == expected
            expected, _ = _walk(capture, found, min(start + split, length))
        capture.file = whole
    assert expected == length and length > 20 * split and sum(asked) < 3 * length


def test_small_splits_share_tasks(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(make(4000)))
    assert read_captures(spark, str(tmp_path), split_bytes=1000).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
