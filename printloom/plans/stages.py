"""Where a plan is cut: intermediates are written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="printloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: later plans start from files."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
