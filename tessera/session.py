"""Session factory and the few run-time settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a session needs for the documented results; the cluster decides about sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", app: str = "tessera", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Where it is unset, a session on this machine (master local) gets a temporary folder; on a cluster it is an error,
    since a folder of the driver's machine could not be read by the executors.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            path = existing.get()
        elif spark.sparkContext.master.startswith("local"):
            path = tempfile.mkdtemp(prefix="tessera-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
