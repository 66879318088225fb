"""Where intermediate tables go: the folder every executor can reach."""

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; on a cluster the
    setting is required, since executors do not share their local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="sitelens-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets go of shuffles behind tables that are written.

    Spark deletes a shuffle's files when the driver has collected the plan that made it,
    which without a full disk or heap may be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
