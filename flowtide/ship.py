"""Send this package to the Python workers."""

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let tasks import ``flowtide``, as ``--py-files`` would.

    Spark serves the archive from the driver to every executor. Sources with
    Python tasks call this; once per application is enough.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="flowtide-"), "flowtide")
    archive = shutil.make_archive(
        target, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
