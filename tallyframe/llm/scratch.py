"""Where intermediate tables go: always a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode (tests).

    A machine's own folder is none that executors share, so a cluster without the setting is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir: needed on a cluster ({master}), a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
    return _local[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tallyframe/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files survive the loss of any executor, unlike a cache or a local checkpoint.
    """
    return stored(df, label, codec)[0]


def stored(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``materialise``, and the path for ``remove``."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of ``df``, whatever these are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
