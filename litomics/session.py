"""Session settings that the engine's semantics need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "litomics", **extra: str) -> SparkSession:
    """A session with the engine's settings; `extra` adds or replaces."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | extra).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_own_dirs: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which the driver and all executors share; one of our own only where none is set and all runs on this machine, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: written tables need a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own_dirs.setdefault(app, "") or tempfile.mkdtemp(prefix="litomics-")
        _own_dirs[app] = root
    return f"{root.rstrip('/')}/litomics/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A frame written to a scratch path and read back, for one that several others are made of."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
