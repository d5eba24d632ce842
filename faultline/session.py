"""Session settings that the operators count on, and joins with a side of checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
#: A side of a join is broadcast up to so many rows; beyond, the join shuffles and skew is split at run time.
SMALL = 500_000
#: Nor is it counted where the optimizer's own estimate from file and row sizes is so many bytes at most.
PLAINLY = 1 << 18


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode,
    whose executors are the driver; on a cluster that is an error, as executors don't see each other's disks."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small(frame: DataFrame, most: int = SMALL) -> DataFrame:
    """frame with a broadcast hint if it has `most` rows at most, which the estimate of its size or a limited count checks."""
    if int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= PLAINLY:
        return F.broadcast(frame)
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame
