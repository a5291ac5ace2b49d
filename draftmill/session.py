"""What a session needs before Python workers can run this package's functions."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to a Python worker, if the session leaves Spark's own value, which needs four times as much.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, SPARKS_OWN = 16 << 20, 64 << 20
#: Spark 4.1 takes a union of parts that lie by key for lying by key itself, and then may put the parts one after another all
#: the same, as adaptive plans read fewer partitions: a key's rows are in two tasks. (Seen on `merge_counts`.)
UNION = "spark.sql.unionOutputPartitioning"
#: Rows that lie by sheet are joined by sheet and token where they lie. Spark's own value shuffles both sides once more by both
#: keys; sheets are small, so that there is nothing to win by it.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application, and bounds the batches they get;
    unions are never taken for lying by key."""
    sc = spark.sparkContext
    spark.conf.set(UNION, "false")
    spark.conf.set(ALL_KEYS, "false")
    if spark.conf.get(BATCH).rstrip("b") == str(SPARKS_OWN):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="draftmill-")  # the driver serves the file from here
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "draftmill.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark
