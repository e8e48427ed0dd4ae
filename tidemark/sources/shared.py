"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's folder under spark.checkpoint.dir; a temporary folder only on one machine without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-shared"
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: its lineage ends there, and a lost task rereads it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that sessions have written under a name, by the session's folder and the name.
_NAMED: dict[tuple, str] = {}


def named(spark: SparkSession, name: tuple, write) -> str:
    """The folder that ``write(folder)`` has filled under this name in this session; written if it isn't there."""
    key = (shared_dir(spark), *name)
    if key not in _NAMED:
        folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        write(folder)
        _NAMED[key] = folder
    return _NAMED[key]


def clear(spark: SparkSession) -> None:
    """Delete all that this session has stored, and forget its names; call it when no result is read any more."""
    for key in [k for k in _NAMED if k[0] == shared_dir(spark)]:
        del _NAMED[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
