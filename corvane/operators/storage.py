"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own_folder: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; only on a local master that names none, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/corvane-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``df`` as written to the shared folder, read with its own or another schema: what several parts of a query read is worked out once."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def finished(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the tables ``<prefix><n>`` in a folder that Spark has committed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(p.getName().removeprefix(prefix)) for p in names if p.getName().startswith(prefix) and fs.exists(hadoop.Path(p, "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table's folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
