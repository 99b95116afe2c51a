"""Capture files that appear and grow, as a stream: a Python data source.

An offset says for every file up to which byte it has been taken in and how many records
that is. Each micro-batch lists the folder and walks the record headers behind those
bytes, up to the last whole record; what is new of a file is one partition, or several of
about ``split_bytes``, which tasks read. So positions (``seq``) are dense and unique in a
capture, over rotated files of equal times, files that grow and names that come late: files
of one micro-batch follow each other in natural order, micro-batches as they came.

The walk is done where the stream is planned, once for each byte (again after a restart): some
two million records a second. For a back-fill use :func:`~flowtide.sources.captures.read_captures`.
"""

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schema import FRAMES
from ..ship import ship_package
from .captures import FILE_HEADER, SPLIT_BYTES, _Capture, _read_splits
from .files import locate
from .frames import SNAPLEN

# The process that plans a stream does not get what was shipped to the tasks.
for _name in (__name__, _Capture.__module__, locate.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])


@dataclass
class Piece(InputPartition):
    """Records of a file that begin in ``[start, stop)``; the first is at ``seq``."""

    path: str
    capture_id: str
    start: int
    stop: int
    seq: int


def natural(path: str) -> list:
    """A sort key by the numbers in a name: ``x.2`` before ``x.10``."""
    return [(0, int(part), "") if part.isdigit() else (1, 0, part) for part in re.findall(r"[0-9]+|[^0-9]+", path)]


class CaptureStream(DataSourceStreamReader):
    def __init__(self, path: str, snaplen: int | None, by_directory: bool, most_files: int | None, split_bytes: int):
        self.path, self.snaplen, self.by_directory = path, snaplen, by_directory
        self.most_files, self.split_bytes = most_files, split_bytes
        #: Bytes and records taken in of each file; unknown after a restart, when all is walked again.
        self.known: dict[str, list[int]] | None = None
        #: Places between records (byte, records before it) of what was walked last.
        self.marks: dict[str, list[tuple[int, int]]] = {}

    def initialOffset(self) -> dict:
        self.known = {}
        return {}

    def _files(self) -> list[str]:
        system, root = locate(self.path)
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else "file:"
        if system.get_file_info(root).type == fs.FileType.File:
            return [prefix + root]
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = (f for f in found if f.type == fs.FileType.File and f.size >= FILE_HEADER)
        return sorted((prefix + f.path for f in names if not f.base_name.startswith((".", "_"))), key=natural)

    def latestOffset(self) -> dict:
        known = self.known or {}
        end, begun = {path: list(at) for path, at in known.items()}, 0
        for path in self._files():
            if path not in known:
                if self.known is not None and self.most_files and begun >= self.most_files:
                    continue
                begun += 1
            start, records = known.get(path, (FILE_HEADER, 0))
            marks, last = [(start, records)], start
            with _Capture(path) as capture:
                for record in capture.records(start, 1 << 62):
                    start, records = record[0], records + 1
                    if start - last >= self.split_bytes:
                        marks.append((start, records))
                        last = start
            end[path], self.marks[path] = [start, records], marks
        self.known = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        following: dict[str, int] = {}
        for path, (_, records) in start.items():
            capture = self._capture_of(path)
            following[capture] = following.get(capture, 0) + records
        out = []
        for path in sorted(end, key=natural):
            begin, before = start.get(path, (FILE_HEADER, 0))
            stop, records = end[path]
            if records == before:
                continue
            capture = self._capture_of(path)
            base = following.get(capture, 0) - before
            following[capture] = base + records
            inner = [(a, n) for a, n in self.marks.get(path, ()) if begin < a < stop and before < n < records]
            cuts = [(begin, before), *inner, (stop, records)]
            out += [Piece(path, capture, a, b, base + n) for (a, n), (b, _) in zip(cuts, cuts[1:])]
        return out

    def _capture_of(self, path: str) -> str:
        return path.rsplit("/", 1)[0] if self.by_directory else path

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        split = {"path": partition.path, "capture_id": partition.capture_id, "start": partition.start, "split_stop": partition.stop, "seq": partition.seq}
        return _read_splits(self.snaplen)(iter([pa.RecordBatch.from_pylist([split])]))

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """``spark.readStream.format("pcap")`` with ``path``, ``snaplen``, ``captureBy``, ``maxFilesPerTrigger``, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return FRAMES

    def streamReader(self, schema) -> CaptureStream:
        option = self.options.get
        snaplen = option("snaplen", str(SNAPLEN))
        return CaptureStream(
            option("path"),
            None if snaplen == "none" else int(snaplen),
            option("captureBy", "file") == "directory",
            int(option("maxFilesPerTrigger", "0")) or None,
            int(option("splitBytes", str(SPLIT_BYTES))),
        )


def stream_captures(
    spark: SparkSession,
    path: str,
    snaplen: int | None = SNAPLEN,
    max_files_per_trigger: int | None = None,
    capture_by: str = "file",
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Frames of capture files as they appear in ``path`` and grow.

    Arguments are as in :func:`~flowtide.sources.captures.read_captures`;
    ``max_files_per_trigger`` bounds the files that a micro-batch begins.
    """
    if capture_by not in ("file", "directory"):
        raise ValueError(f"unknown capture_by {capture_by!r}: use 'file' or 'directory'")
    ship_package(spark)
    spark.dataSource.register(CaptureSource)
    reader = spark.readStream.format("pcap").option("captureBy", capture_by).option("splitBytes", split_bytes)
    reader = reader.option("snaplen", "none" if snaplen is None else snaplen)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)
