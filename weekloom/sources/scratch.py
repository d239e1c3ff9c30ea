"""Intermediate tables, written once and read back: later plans start from a file, and a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that all executors share (``spark.checkpoint.dir``); only a local master runs without the setting, in a
    folder of its own. The application's tables go when its driver ends."""
    spark = df.sparkSession
    context = spark.sparkContext
    app, shared = context.applicationId, context.getConf().get("spark.checkpoint.dir")
    if app not in _own:
        if not shared and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='weekloom-')).rstrip('/')}/tables-{app}"
        at = context._jvm.org.apache.hadoop.fs.Path(_own[app])
        at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    path = f"{_own[app]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
