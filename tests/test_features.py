"""Feature arithmetic against rows the original tool exported, and the sinks."""

import math

from pyspark.sql import functions as F

from flowtide import flow_features
from flowtide.functions.rates import average_packet_size, per_second
from flowtide.functions.text import six_digits
from flowtide.schema import FEATURES
from flowtide.sources.sinks import read_features_csv, write_features_csv, write_features_parquet

# Fixed values of the file format. Exported rows: single packets by an older release (infinite rates) and by the
# current one (zero rates), and flows that lasted.
OLD = "0,1,74,inf,inf,74,38254,80,6"
BURST = "0,1,74,0,0,74,38254,80,6"
LASTING = "0.584995,9,2553,15.3847,4364.14,283.667,443,33164,6"
HEADER = "duration,packets,bytes,packetsPerSecond,bytesPerSecond,averagePacketSize,srcPort,dstPort,protocol"


def flows(spark, *rows):
    return spark.createDataFrame(
        rows,
        "duration double, packets bigint, bytes bigint, src_port int, dst_port int, protocol int, is_closed boolean",
    )


SAMPLE = [
    (0.0, 1, 74, 38254, 80, 6, True),
    (0.584995, 9, 2553, 443, 33164, 6, True),
    (-1.5, 2, 120, 5353, 5353, 17, True),
    (3.0, 3, 300, 1, 2, 6, False),
]


def test_features_of_exported_rows(spark):
    got = [tuple(r) for r in flow_features(flows(spark, *SAMPLE)).orderBy("bytes").collect()]
    assert got[0] == (0.0, 1, 74, 0.0, 0.0, 74.0, 38254, 80, 6)
    assert got[1] == (-1.5, 2, 120, 0.0, 0.0, 60.0, 5353, 5353, 17)
    assert got[2][3:6] == (9 / 0.584995, 2553 / 0.584995, 2553 / 9)


def test_schema_is_the_export_order(spark):
    df = flow_features(flows(spark, *SAMPLE))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in FEATURES]
    assert ",".join(df.columns) == HEADER


def test_recomputed_from_an_exported_file(spark, tmp_path):
    (tmp_path / "old.csv").write_text("\n".join([HEADER, OLD, BURST, LASTING]) + "\n")
    df = read_features_csv(spark, str(tmp_path / "old.csv"))
    assert [math.isinf(r["packetsPerSecond"]) for r in df.collect()] == [True, False, False]
    again = df.filter("packetsPerSecond < double('inf')").select(
        "*",
        six_digits(average_packet_size(F.col("bytes"), F.col("packets"))).alias("average"),
        six_digits(per_second(F.col("packets"), F.col("duration"))).alias("pps"),
        six_digits(per_second(F.col("bytes"), F.col("duration"))).alias("bps"),
    )
    for r in again.collect():
        assert (r["average"], r["pps"], r["bps"]) == (
            r["averagePacketSize"],
            r["packetsPerSecond"],
            r["bytesPerSecond"],
        )


def lines(folder):
    return [p.read_text().splitlines() for p in sorted(folder.glob("*.csv"))]


def test_csv_appends_with_a_header_per_file(spark, tmp_path):
    target = tmp_path / "new" / "data"
    df = flow_features(flows(spark, *SAMPLE)).coalesce(1)
    write_features_csv(df, str(target))
    write_features_csv(df, str(target))
    assert [f[0] for f in lines(target)] == [HEADER, HEADER]
    assert read_features_csv(spark, str(target)).count() == 6


def test_compat_text_is_what_the_original_wrote(spark, tmp_path):
    df = flow_features(flows(spark, *SAMPLE[:2])).coalesce(1)
    write_features_csv(df, str(tmp_path / "c"), compat_format=True)
    assert lines(tmp_path / "c")[0] == [HEADER, BURST, LASTING]


def test_parquet_keeps_values(spark, tmp_path):
    df = flow_features(flows(spark, *SAMPLE))
    write_features_parquet(df, str(tmp_path / "p"))
    assert sorted(spark.read.parquet(str(tmp_path / "p")).collect()) == sorted(df.collect())
