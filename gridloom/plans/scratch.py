"""Tables in the folder that the cluster shares, to fix a physical layout and to cut lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of tables that were written and not deleted yet.
TABLES: dict[str, None] = {}


@functools.cache
def _own_folder() -> str:
    """For local sessions only: a folder that goes with the process."""
    path = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that `spark.checkpoint.dir` names.

    Where that is unset a local session uses a temporary folder; on a cluster it is an error, since executors
    don't see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The table written to shared scratch space and read back: cuts lineage and survives lost executors.

    The write runs in a copy of the session, whose settings have shuffle files given back when it ends. The
    caller's settings don't change. The table stays until `dropped`, `released` or the end of the program.
    """
    spark = df.sparkSession
    path, schema = scratch(spark), df.schema
    own = spark._jsparkSession.cloneSession()
    own.conf().set(CLEANUP, "true")
    TABLES[path] = None
    spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, df._jdf.logicalPlan()).write().option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(context: SparkContext, path: str) -> None:
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    TABLES.pop(path, None)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession.sparkContext, df._scratch_path)


def released(spark: SparkSession, since: frozenset[str] = frozenset(), keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete all tables of `stored` but those of `since` and `keep`; for when results that read them are used up."""
    held = {df._scratch_path for df in keep} | since
    for path in [p for p in TABLES if p not in held]:
        _delete(spark.sparkContext, path)


@atexit.register
def _at_end() -> None:
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for path in list(TABLES):
            _delete(context, path)
