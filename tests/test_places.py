import pytest

from flowtide.sources import scratch
from flowtide.sources.files import locate


class Session:
    """Stands in for a session with other settings than the tests' own."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_the_cluster_folder_is_used():
    session = Session("spark://host:7077", "s3a://bucket/shared/")
    assert scratch.shared_root(session) == "s3a://bucket/shared"
    assert scratch.shared_folder(session, "x").startswith("s3a://bucket/shared/x-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session("yarn"))


def test_only_a_local_session_gets_its_own():
    assert scratch.shared_root(Session("local[8]")) == scratch.shared_root(Session("local[8]"))


@pytest.mark.parametrize("path", ["/tmp/a b%#.pcap", "file:/tmp/a b%#.pcap", "file:///tmp/a b%#.pcap"])
def test_local_paths(path):
    assert locate(path)[1] == "/tmp/a b%#.pcap"


def test_scratch_is_cleared_for_this_application_only(spark, tmp_path):
    other = Session("spark://h:1", str(tmp_path))
    theirs = scratch.shared_folder(other, "x")
    mine = scratch.shared_folder(spark, "x")
    spark.range(3).write.parquet(mine)
    assert scratch.named_here(spark, mine) and scratch.clear_scratch(spark) >= 1
    assert not scratch.named_here(spark, mine) and scratch.named_here(other, theirs)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(mine)
