"""Capture files in the published pcap format as a frame table.

Records of a capture file are chained by their lengths, so a file cannot be cut
at arbitrary offsets. Files up to ``split_bytes`` are read by one task each.
Larger ones are cut all the same:

1. every split but the first *guesses* its first record, by looking for a chain
   of plausible record headers, and walks from there to its end;
2. a split is right when its first record is where the split before it stopped.
   The first split of a file starts at a known place, so if all agree, all are
   right. A guessed chain that breaks proves nothing and is dropped;
3. a file with a split that does not agree is gone through once more, in order,
   by one task: splits that fit are skipped, the others walked from their true
   start. So there are two rounds at most.

The walk also counts records, which gives every record its exact position in
the file. The result does not depend on the guesses; only the time does. A chain
that breaks after a known start is damage, and fails with file and offset.
"""

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import FRAMES
from ..ship import ship_package
from .files import locate
from .frames import SNAPLEN
from .scratch import shared_folder

SPLIT_BYTES = 128 << 20
#: Tasks that a read is dealt to at most; a task reads several splits if need be.
MOST_TASKS = 1 << 14
#: Small splits share a task up to so many bytes, as far as that leaves work for all cores.
TASK_BYTES = 8 << 20

_CHUNK = 4 << 20
#: What is read behind a split for its last record, and at first to guess a record.
_BEHIND = 4096
_GLANCE = 1 << 16
_BATCH_BYTES = 8 << 20
_BATCH_RECORDS = 10_000
_CHAIN = 16

# Fixed values of the published format: sizes, magic numbers (as read big
# endian), and the fraction-of-second unit each stands for.
FILE_HEADER = 24
RECORD_HEADER = 16
MAGIC = {
    0xA1B2C3D4: (">", 1_000_000),
    0xD4C3B2A1: ("<", 1_000_000),
    0xA1B23C4D: (">", 1_000_000_000),
    0x4D3CB2A1: ("<", 1_000_000_000),
}
PCAPNG_MAGIC = 0x0A0D0D0A
MAX_RECORD = 262_144


class _Capture:
    """One open capture file."""

    def __init__(self, path: str):
        self.path = path
        system, name = locate(path)
        self.file = system.open_input_file(name)
        head = self.file.read_at(FILE_HEADER, 0)
        if len(head) < FILE_HEADER:
            raise ValueError(f"{path}: shorter than a capture file header")
        magic = struct.unpack(">I", head[:4])[0]
        if magic == PCAPNG_MAGIC:
            raise ValueError(f"{path}: pcapng is not supported, convert it to pcap")
        if magic not in MAGIC:
            raise ValueError(f"{path}: not a pcap file (magic {magic:#010x})")
        order, self.unit = MAGIC[magic]
        self.header = struct.Struct(order + "IIII")
        self.limit = max(struct.unpack(order + "I", head[16:20])[0], MAX_RECORD)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def records(self, start: int, stop: int) -> Iterator[tuple]:
        """``(next, sec, fraction, caplen, len, bytes)`` of each whole record
        that begins in ``[start, stop)``; ends at a record cut by end of file."""
        size = 0
        while start < stop:
            size = size or min(_CHUNK, stop - start + _BEHIND)
            chunk = self.file.read_at(size, start)
            at = 0
            while start + at < stop and at + RECORD_HEADER <= len(chunk):
                sec, fraction, caplen, wire = self.header.unpack_from(chunk, at)
                if caplen > self.limit:
                    raise ValueError(f"{self.path}: record at {start + at} claims {caplen} bytes")
                body = at + RECORD_HEADER
                if body + caplen > len(chunk):
                    break
                at = body + caplen
                yield start + at, sec, fraction, caplen, wire, chunk[body:at]
            if at:
                start, size = start + at, 0
            elif len(chunk) < size:
                return
            else:
                size *= 2

    def guess(self, start: int) -> int | None:
        """Offset of a likely first record at or after ``start``."""
        for size in (_GLANCE, _CHUNK):
            chunk = self.file.read_at(size, start)
            ended = len(chunk) < size
            for candidate in range(len(chunk) - RECORD_HEADER + 1):
                at, links = candidate, 0
                while links < _CHAIN and at + RECORD_HEADER <= len(chunk):
                    _, fraction, caplen, wire = self.header.unpack_from(chunk, at)
                    if fraction >= self.unit or not caplen <= min(wire, self.limit) or wire == 0:
                        break
                    at, links = at + RECORD_HEADER + caplen, links + 1
                else:
                    if links == _CHAIN or (at == len(chunk) if ended else size == _CHUNK):
                        return start + candidate
                    if not ended:
                        break  # the chain goes on behind the glance
            if ended:
                return None
        return None


def _walk(capture: _Capture, start: int, stop: int) -> tuple[int, int]:
    """Where the records of ``[start, stop)`` end, and how many there are."""
    end, records = start, 0
    for record in capture.records(start, stop):
        end, records = record[0], records + 1
    return end, records


def _guess_splits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fill ``start, next, records``; -1 where a guess leads nowhere."""
    for batch in batches:
        rows = batch.to_dict("records")
        for row in rows:
            with _Capture(row["path"]) as capture:
                known = row["split"] == 0
                found = FILE_HEADER if known else capture.guess(int(row["split_start"]))
                row["start"], row["next"], row["records"] = -1, -1, 0
                if found is None:
                    continue
                try:
                    row["next"], row["records"] = _walk(capture, found, int(row["split_stop"]))
                    row["start"] = found
                except ValueError:
                    if known:
                        raise
        yield pd.DataFrame(rows, columns=batch.columns)


def _mend_file(splits: pd.DataFrame) -> pd.DataFrame:
    """All splits of one file, those that do not follow on walked again."""
    rows = splits.sort_values("split").to_dict("records")
    expected = FILE_HEADER
    with _Capture(rows[0]["path"]) as capture:
        for row in rows:
            if row["start"] != expected:
                row["start"] = expected
                row["next"], row["records"] = _walk(capture, expected, int(row["split_stop"]))
            expected = row["next"]
    return pd.DataFrame(rows, columns=splits.columns)


def _read_splits(snaplen: int | None, headers_only: bool = False):
    schema = pa.schema(
        [
            ("capture_id", pa.string()),
            ("seq", pa.int64()),
            ("ts", pa.timestamp("us", tz="UTC")),
            ("caplen", pa.int32()),
            ("len", pa.int64()),
            ("frame", pa.binary()),
        ]
    )

    def emit(name: str, first: int, rows: list[tuple]) -> pa.RecordBatch:
        micros, wires, frames = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * len(rows), pa.string()),
                pa.array(range(first, first + len(rows)), pa.int64()),
                pa.array(micros, pa.int64()).cast(schema.field("ts").type),
                pa.array([None if f is None else len(f) for f in frames], pa.int32()),
                pa.array(wires, pa.int64()),
                pa.array(frames, pa.binary()),
            ],
            schema=schema,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                with _Capture(split["path"]) as capture:
                    per_micro = capture.unit // 1_000_000
                    seq, rows, held = split["seq"], [], 0
                    for _, sec, fraction, _, wire, body in capture.records(
                        split["start"], split["split_stop"]
                    ):
                        body = None if headers_only else bytes(body[:snaplen])
                        rows.append((sec * 1_000_000 + fraction // per_micro, wire, body))
                        held += len(body or b"")
                        if len(rows) == _BATCH_RECORDS or held >= _BATCH_BYTES:
                            yield emit(split["capture_id"], seq, rows)
                            seq, rows, held = seq + len(rows), [], 0
                    if rows:
                        yield emit(split["capture_id"], seq, rows)

    return read


def _index(spark: SparkSession, splits: DataFrame, tasks: int) -> DataFrame:
    """Verified ``start`` and record count of each split, as a stored table."""
    in_file = Window.partitionBy("path").orderBy("split")
    layout = "path string, split bigint, split_start bigint, split_stop bigint, start bigint, next bigint, records bigint"
    fresh = splits.selectExpr(
        "path", "split", "split_start", "split_stop", "-1L AS start", "-1L AS next", "0L AS records"
    )

    def kept(index: DataFrame) -> DataFrame:
        table = shared_folder(spark, "capture-index")
        index.write.parquet(table)
        return spark.read.schema(layout).parquet(table)

    guessed = kept(fresh.repartition(tasks).mapInPandas(_guess_splits, layout))
    follows = F.col("start") == F.coalesce(F.lag("next").over(in_file), F.lit(FILE_HEADER))
    wrong = guessed.withColumn("follows", follows & (F.col("start") >= 0)).where("NOT follows").select("path").distinct()
    if wrong.isEmpty():
        return guessed
    mended = guessed.join(wrong, "path", "left_semi").groupBy("path").applyInPandas(_mend_file, layout)
    return kept(guessed.join(wrong, "path", "left_anti").unionByName(mended))


def natural_order(path: str = "path") -> Column:
    """A text that sorts names by the numbers in them: ``x.2`` before ``x.10``."""
    return F.expr(
        f"""array_join(transform(regexp_extract_all({path}, '([0-9]+|[^0-9]+)', 1),
        part -> IF(part RLIKE '^[0-9]' AND length(part) < 24, lpad(part, 24, '0'), part)), '')"""
    )


def capture_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of the files below ``path``, without their content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )


def plan_splits(files: DataFrame, capture_by: str, split_bytes: int) -> DataFrame:
    """The splits of ``files`` (``path, length``), with the position their file starts at.

    Files of a folder that is one capture are strung together in natural order. A
    file gets as many positions as it can hold records, by its length, so positions
    never meet and stay below a sixteenth of the bytes.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    if capture_by == "directory":
        room = F.expr(f"greatest(length - {FILE_HEADER}, 0) DIV {RECORD_HEADER} + 1")
        before = Window.partitionBy(folder).orderBy(natural_order(), "path").rowsBetween(Window.unboundedPreceding, -1)
        files = files.withColumn("base", F.coalesce(F.sum(room).over(before), F.lit(0).cast("bigint")))
    else:
        files = files.withColumn("base", F.lit(0).cast("bigint"))
    last = F.expr(f"(greatest(length, 1) - 1) DIV {split_bytes}")
    return (
        files.withColumn("capture_id", folder if capture_by == "directory" else F.col("path"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("split"))
        .withColumns(
            {
                "split_start": F.col("split") * F.lit(split_bytes),
                "split_stop": F.least("length", (F.col("split") + 1) * F.lit(split_bytes)),
            }
        )
    )


def read_captures(
    spark: SparkSession,
    path: str,
    snaplen: int | None = SNAPLEN,
    capture_by: str = "file",
    split_bytes: int = SPLIT_BYTES,
    headers_only: bool = False,
    most_tasks: int = MOST_TASKS,
) -> DataFrame:
    """Frames of all capture files below ``path``.

    Both byte orders, microsecond and nanosecond files. A last record cut short
    by the end of its file is left out. At most ``snaplen`` bytes of a frame are
    kept, 2048 by default; ``None`` keeps them all.

    ``capture_by="file"`` makes each file one capture; ``"directory"`` reads the
    files of a folder, in the natural order of their names, as one capture in
    rotated files.

    ``headers_only`` leaves ``caplen`` and ``frame`` NULL: enough for the clock of
    :func:`~flowtide.operators.flows.build_flows`, without moving frames.
    """
    if capture_by not in ("file", "directory"):
        raise ValueError(f"unknown capture_by {capture_by!r}: use 'file' or 'directory'")
    ship_package(spark)
    splits = plan_splits(capture_files(spark, path), capture_by, split_bytes)
    length = F.sum(F.col("split_stop") - F.col("split_start")).alias("bytes")
    sizes = splits.agg(F.count(F.lit(1)).alias("splits"), F.max("split").alias("last"), length).first()
    useful = max((sizes["bytes"] or 0) // TASK_BYTES, 4 * spark.sparkContext.defaultParallelism)
    tasks = min(max(sizes["splits"], 1), useful, most_tasks)
    if sizes["last"]:
        before = (
            Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        )
        index = _index(spark, splits.select("path", "split", "split_start", "split_stop"), tasks)
        located = index.select(
            "path", "split", "start", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("skipped")
        )
        splits = splits.join(located, ["path", "split"])
        seq = F.col("base") + F.col("skipped")
    else:
        splits = splits.withColumn("start", F.lit(FILE_HEADER).cast("bigint"))
        seq = F.col("base")
    # The explicit number of tasks keeps adaptive execution from merging these
    # tiny rows, each of which stands for a lot of reading.
    work = splits.select("path", "capture_id", "start", "split_stop", seq.alias("seq"))
    return work.repartition(tasks).mapInArrow(_read_splits(snaplen, headers_only), FRAMES)
