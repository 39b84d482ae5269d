"""Cutting lineage with tables in the folder that all executors share.

A lost executor then costs a re-read of Parquet, never a re-run of what came before.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset: the warehouse on a cluster, if it is no folder of one machine; a temporary
    folder in a local session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(warehouse)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return f"{warehouse}/quillstone"
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder; all later reads come from there.  ``codec``: another than the session's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillstone-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables this session has written, and say how many; results read from them end with them."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)
