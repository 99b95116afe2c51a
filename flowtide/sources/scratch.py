"""Where jobs put intermediate tables: a folder every executor can reach."""

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder
    of its own; on a cluster a machine-local folder would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="flowtide-")
    return _own[context.applicationId]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused folder name below :func:`shared_root`."""
    folder = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def named_here(spark: SparkSession, folder: str | None) -> bool:
    """Whether ``folder`` is one of this application's that has not been cleared."""
    return folder in _made.get(spark.sparkContext.applicationId, [])


def made_folders(spark: SparkSession) -> list[str]:
    """The folders that :func:`shared_folder` named for this application, in that order."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, folders: Iterable[str] | None = None) -> int:
    """Delete ``folders`` (by default all) that :func:`shared_folder` named for this application.

    Call it when the results that read them have been written; returns how many
    were there. Other applications' folders stay.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = made_folders(spark)
    going = set(made if folders is None else folders)
    _made[spark.sparkContext.applicationId] = [f for f in made if f not in going]
    gone = 0
    for folder in (f for f in made if f in going):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
