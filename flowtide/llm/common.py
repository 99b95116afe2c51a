"""Shared helpers: tables, stored intermediate results, batches of texts."""

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship_package
from ..sources.scratch import shared_folder

#: The separators of words, as a Java and DuckDB regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python task handles at a time; a longer text is alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``rid``: the number of the row in the scan; then ``columns``."""
    return docs.select(F.monotonically_increasing_id().alias("rid"), *columns)


def packed(docs: DataFrame) -> DataFrame:
    """``rid``, ``text`` and all columns as the struct ``doc``, safe from clashing names."""
    return numbered(docs, F.coalesce("text", F.lit("")).alias("text"), F.struct("*").alias("doc"))


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is files, filtered and projected row by row."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def placed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``rid``: a number that stays with a row in all jobs; then ``columns``.

    The splits of a scan follow the cores that are there at the time, so a number given
    in a scan is another one in the next. A row of a file keeps its file and its place in
    it: the number is a hash of the file's name, tried until no two files share it, and
    the place. Nothing but a row for each file is stored. Other frames (joined, grouped,
    local) are stored with their numbers.
    """
    if _rows_of_files(docs):
        try:
            path, place = (docs.metadataColumn("_metadata").getField(f) for f in ("file_path", "row_index"))
            files = stored(docs.groupBy(path.alias("path")).agg(F.max(place).alias("last")), "files")
        except AnalysisException:  # files of a kind without places
            return stored(numbered(docs, *columns), "numbered")
        size = files.agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last")).first()
        shift = max(1, (size["last"] or 0).bit_length())
        for seed in range(64):

            def number(name: Column) -> Column:
                return F.shiftrightunsigned(F.xxhash64(F.lit(seed), name), shift + 1)  # noqa: B023

            if size["n"] < 2 or files.select(number(F.col("path"))).distinct().count() == size["n"]:
                return docs.select(F.shiftleft(number(path), shift).bitwiseOR(place).alias("rid"), *columns)
    return stored(numbered(docs, *columns), "numbered")


def with_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a struct ``doc`` with its ``text`` as a column too, without a copy."""
    for batch in batches:
        text = batch.column("doc").field("text")
        yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])


def doc_and(rows: DataFrame, more: str) -> T.StructType:
    """Schema of the ``doc`` struct of ``rows`` and more columns (DDL)."""
    return T.StructType([rows.schema["doc"], *T.StructType.fromDDL(more).fields])


def python_tasks(spark: SparkSession) -> None:
    """Make this package importable in the Python workers."""
    ship_package(spark)


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of ``text``."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def word_count(text: str | Column) -> Column:
    """Words of a text (null: 0), without Python."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_text(doc_id: str = "doc_id") -> Column:
    """``doc_id`` as text; null as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
