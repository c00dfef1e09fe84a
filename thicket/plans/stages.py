"""Stage tables: intermediate results written to the cluster's shared folder.

A stage cuts lineage like ``checkpoint()`` but is columnar and compressed, keeps
its size for the planner, and survives the loss of any executor.  The folder is
inside the one the session names in ``spark.checkpoint.dir``; only where that is
unset (tests, notebooks) a temporary local folder is made.  Stages that no later
plan reads are dropped by their makers, the others with the application.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import warnings

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """This application's own folder; it is removed when the program ends, or by ``drop_stages``."""
    key = spark.sparkContext.applicationId
    if key not in _ROOTS:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                warnings.warn("spark.checkpoint.dir is unset: stages go to a folder of this machine, which a cluster's executors don't share", stacklevel=2)
            local = tempfile.mkdtemp(prefix="thicket-stages-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            named = "file://" + local
        _ROOTS[key] = f"{named.rstrip('/')}/thicket-{key}"
        atexit.register(_at_exit, key)
    return _ROOTS[key]


def _at_exit(key: str) -> None:
    """Remove the folder at the program's end, after the session has stopped as well: the JVM is still there."""
    root, jvm = _ROOTS.pop(key, None), SparkContext._jvm
    if root and jvm is not None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before us
            pass


def drop_stages(spark: SparkSession) -> None:
    """Delete all stages of this application; results that still read them are void."""
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        delete_path(spark, root)


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return it read back; the caller may ``drop_stage`` it later."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._thicket_stage = path
    return out


def drop_stage(df: DataFrame | None) -> None:
    """Delete a stage that no later plan reads."""
    path = getattr(df, "_thicket_stage", None)
    if path:
        delete_path(df.sparkSession, path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Full names of what lies in a folder; nothing if there is none."""
    fs, p = _file_system(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
