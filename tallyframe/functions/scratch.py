"""Tables between steps, in a folder that driver and executors share, and names for columns of our own."""

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


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: steps after it don't compute it again, nor do they when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/tallyframe/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside those of ``df``, whatever these are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
