"""Session helpers: building a local session for tests / bench, and the shared
scratch folder used to materialise intermediate tables.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names (a
shared, reliable file system).  Only when that setting is missing *and* the
master is local do we create one under the machine's temp folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "concord") -> SparkSession:
    """The running session, or a new one set up the way the library expects.

    What the caller's environment has set already (an active session,
    spark-submit's master and configuration) is left alone; only unset values
    get a default.  No scratch folder is made here."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    conf = SparkConf()
    cpus = os.environ.get("BENCH_CPUS", "8")
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ        # spark-submit started this process
    wanted = {
        "spark.app.name": app,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.scheduler.mode": "FAIR",
    }
    if not submitted:
        wanted |= {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
                   "spark.driver.memory": os.environ.get("CONCORD_DRIVER_MEMORY", "16g")}
    wanted = {k: v for k, v in wanted.items() if not conf.contains(k)}
    if master:
        wanted["spark.master"] = master
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = SparkSession.builder.config(map=wanted).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Reads ``spark.checkpoint.dir`` from the session.  If it is unset we only
    make one ourselves in local mode (tests); on a cluster a machine-local
    folder would not survive the loss of an executor, so we refuse.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a shared folder for "
                "intermediate tables (a machine-local folder is not safe on a cluster)")
        configured = tempfile.mkdtemp(prefix="concord-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_made: list[str] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared scratch folder."""
    path = os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete every scratch table this process has written, on whatever file
    system the folder is; returns how many.  Call it when the results that read
    them have been used or written: they cannot be read afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as parquet under the shared scratch folder and read it back.

    Cuts the lineage (later stages do not recompute the plan, and a lost
    executor only costs re-reading files) while keeping column pruning and
    filter push-down for the readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
