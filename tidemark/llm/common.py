"""Helpers shared by the operators: tables, shared storage, Arrow batches and expression idioms."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

#: Rows of text handed to Python at once: bounds a worker's memory when texts are long.
ROWS_PER_BATCH = 256

#: White space of the word rules, for regular expressions of Spark and of DuckDB.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the library to the executors once per application, so that their Python finds it wherever it runs."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="tidemark-code-")  # on the driver alone; Spark hands the file out
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/tidemark.zip", "w") as out:
            for path in sorted((root / "tidemark").rglob("*.py")):
                out.write(path, path.relative_to(root))
        spark.sparkContext.addPyFile(f"{folder}/tidemark.zip")
        _SHIPPED.add(app)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Later jobs read the files, so a lost executor costs no recomputation, and the planner knows the size."""
    return materialize(df, name)


def small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Hint a broadcast for a side counted as at most ``limit`` narrow rows; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return df.mapInArrow(fn, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def dealt(df: DataFrame, *order: str, name: str = "dealt") -> DataFrame:
    """``df`` in ranges of the unique key ``order`` (nulls first), sorted inside and stored, with the number of its range in
    ``_range`` and the row's place in there in ``_at``: an order over all rows without a task that sees them all."""
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return store(at.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), name)


def runs(ranged: DataFrame, *by: str) -> DataFrame:
    """The groups of a dealt table, whose order starts with ``by``: a row per group and range, with ``_first``, the least ``_at``,
    ``_before``, the group's rows in earlier ranges, and ``_total``, all its rows."""
    parts = ranged.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*by)
    before = F.sum("_rows").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_rows").over(group)}).drop("_rows")


def match(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join where all ``keys`` are equal, null to null; the keys of ``left`` stay."""
    own = [f"_match_{k}" for k in keys]
    other = right.withColumnsRenamed(dict(zip(keys, own, strict=True)))
    on = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(o))
    return left.join(other, on, how).drop(*own)


def placed(ranged: DataFrame, *by: str) -> DataFrame:
    """A dealt table with ``pos``, every row's place (from 0) in its group, and ``n``, the group's rows. A group of any size is
    spread over its ranges; only a row per group and range is gathered by group."""
    joined = match(ranged, runs(ranged, *by), *by, "_range")
    return joined.withColumns({"pos": F.col("_before") + F.col("_at") - F.col("_first"), "n": F.col("_total")}).drop("_range", "_at", "_first", "_before", "_total")


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets
