"""Frame tables and streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAMES

#: Bytes kept per frame by default (fixed value).
SNAPLEN = 2048


def with_snaplen(frames: DataFrame, snaplen: int = SNAPLEN) -> DataFrame:
    """Keep at most ``snaplen`` bytes of each frame; ``len`` is untouched."""
    return frames.withColumns(
        {
            "frame": F.substring("frame", 1, snaplen),
            "caplen": F.least(F.col("caplen"), F.lit(snaplen)),
        }
    )


def stream_frames(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Follow a folder of Parquet frame files in the :data:`FRAMES` layout."""
    reader = spark.readStream.schema(FRAMES)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
