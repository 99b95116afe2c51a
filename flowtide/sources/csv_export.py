"""A folder that read in the order of names is one CSV with one header: a Python data sink.

Tasks write lines to ``_staged``, which readers do not see. When all of a micro-batch are
there, its files get names of the batch in place of any that an earlier attempt at this batch
left; so a batch that is run twice, or whose commit was cut short, leaves one copy. The
header is a file of its own that sorts first: ``cat folder/*.csv`` is the CSV.

Files only change names where the stream is planned; lines never pass there. A store without
renaming copies them on its side. While a commit runs, a reader may see a part of its batch.
"""

import sys
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..schema import FEATURES
from ..ship import ship_package
from .files import locate
from .sinks import compat_text

# The process that commits does not get what was shipped to the tasks.
for _name in (__name__, locate.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])

HEADER_NAME = "header.csv"
RENAMES_AT_ONCE = 16


@dataclass
class Staged(WriterCommitMessage):
    """File that a task wrote; none if it had no rows."""

    name: str | None


class LineWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, header: str, writer: str):
        self.path, self.header, self.writer = path, header, writer

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = locate(self.path)
        folder, name, out = f"{root}/_staged/{self.writer}", uuid.uuid4().hex, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}")
                out.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        finally:
            if out is not None:
                out.close()
        return Staged(None if out is None else name)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        system, root = locate(self.path)
        staged = sorted(m.name for m in messages if m is not None and m.name)
        system.create_dir(root, recursive=True)
        header = f"{root}/{HEADER_NAME}"
        # Written anew unless whole: a crash may have left an empty one.
        if system.get_file_info(header).size != len(self.header.encode()) + 1:
            with system.open_output_stream(header) as out:
                out.write(f"{self.header}\n".encode())
        prefix = f"part-{batchId:012d}-{self.writer}-"
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith(prefix):
                system.delete_file(info.path)
        folder = f"{root}/_staged/{self.writer}"
        with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
            moves = [(f"{folder}/{name}", f"{root}/{prefix}{i:06d}.csv") for i, name in enumerate(staged)]
            list(pool.map(lambda move: system.move(*move), moves))
        self._clear(system, folder)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        system, root = locate(self.path)
        self._clear(system, f"{root}/_staged/{self.writer}")

    def _clear(self, system: fs.FileSystem, folder: str) -> None:
        """Drop what attempts that do not count have left; the next batch has not begun."""
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class LineSink(DataSource):
    """``writeStream.format("csv_lines")`` with ``path``, ``header`` and ``writer``, one text column."""

    @classmethod
    def name(cls) -> str:
        return "csv_lines"

    def streamWriter(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], self.options["header"], self.options["writer"])


def feature_lines(features: DataFrame, compat_format: bool = False) -> DataFrame:
    """The text of each row; a missing value is an empty field."""
    rows = compat_text(features) if compat_format else features
    fields = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in FEATURES.names]
    return rows.select(F.concat_ws(",", *fields).alias("line"))


def start_csv_export(
    features: DataFrame,
    path: str,
    checkpoint: str,
    compat_format: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append finished flows' features to one CSV with one header, exactly once.

    Several queries may share ``path`` if their checkpoints differ. Without rows there is
    the header only. The values are those of :func:`~flowtide.sources.sinks.write_features_csv`.
    """
    spark = features.sparkSession
    ship_package(spark)
    spark.dataSource.register(LineSink)
    return (
        feature_lines(features, compat_format)
        .writeStream.outputMode("append")
        .format("csv_lines")
        .option("path", path)
        .option("header", ",".join(FEATURES.names))
        .option("writer", f"{zlib.crc32(checkpoint.rstrip('/').encode()):08x}")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`start_csv_export` wrote, with the schema of features."""
    return spark.read.schema(FEATURES).option("header", False).option("pathGlobFilter", "part-*").csv(path)
