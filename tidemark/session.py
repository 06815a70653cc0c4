"""Session settings the library relies on, and cluster-shared scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # every timestamp in the data model is UTC
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # modal values, small sets and sketches per user: keep hashing instead of sorting
    # the input after the default of 128 keys per task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # the JVM never compiles a method of over 8000 bytes of bytecode: one generated method for a model's thirty features would be
    # interpreted for every row; beyond the limit Spark evaluates the same expressions in small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_LOCAL: dict[str, str] = {}  # application -> temporary folder of a local session
_USED: dict[str, str] = {}  # application -> its folder for intermediates


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing stays with the caller."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a session whose executors are threads of the driver may do without one (tests, a laptop) and gets a
    temporary folder; on a cluster every executor would write to a disk of its own, so that is refused.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the application's own one in the shared folder."""
    app = spark.sparkContext.applicationId
    _USED[app] = f"{shared_dir(spark)}/tidemark-{app}"
    return f"{_USED[app]}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediates, once nothing reads results built on them any more."""
    from tidemark.sources.files import delete

    path = _USED.pop(spark.sparkContext.applicationId, None)
    if path:
        delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage of an
    intermediate that several later jobs read, and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
