"""Cutting lineage in a place that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame


def scratch(spark) -> str:
    """A folder of the application that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one
    if Spark runs in one process (tests), else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint()


def dropped(df: DataFrame) -> None:
    """Deletes the files of a checkpointed df that nothing reads any more, and the shuffles that only it could have asked for."""
    sc = df.sparkSession.sparkContext
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # Python lets go of its plans, then the cleaner of the driver finds their shuffles
    sc._jvm.System.gc()
