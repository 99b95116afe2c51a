"""Feature data sets as CSV or Parquet."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import six_digit_text
from ..schema import FEATURES


def compat_text(features: DataFrame) -> DataFrame:
    """Doubles as the six-digit text a C++ stream would have written."""
    return features.select(
        *[
            six_digit_text(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else f.name
            for f in FEATURES
        ]
    )


def write_features_csv(features: DataFrame, path: str, compat_format: bool = False) -> None:
    """Append to a CSV data set: a header per file, one file per task.

    Values keep full precision unless ``compat_format`` asks for the six
    significant digits of the original tool's files.
    """
    rows = compat_text(features) if compat_format else features.select(*FEATURES.names)
    rows.write.mode("append").option("header", True).csv(path)


def write_features_parquet(features: DataFrame, path: str) -> None:
    features.select(*FEATURES.names).write.mode("append").parquet(path)


def read_features_csv(spark, path: str) -> DataFrame:
    """A feature CSV with its fixed schema, ``inf`` rates included."""
    return (
        spark.read.schema(FEATURES)
        .option("header", True)
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
        .csv(path)
    )
