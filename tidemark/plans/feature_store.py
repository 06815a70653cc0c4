"""Dated feature tables kept for the joins that read them: one row per user, bucketed by user.

Tables of a day are written once, those that do not need each other at the same time, and every one is hashed by user into the same
number of sorted buckets. Joins among them on the user then need no shuffle: task i joins bucket i of all tables, however
many tables the star has. A day is written again by replacing its tables; other days stay.

The files are the store. Table definitions live in the session's catalogue and are made again from the files' own description by
a session that does not know them (``read``), so a store outlives the job that wrote it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources import files, io


@dataclass(frozen=True)
class FeatureStore:
    """``root``: folder of the store. ``prefix`` keeps its tables apart from others in the catalogue. ``buckets``: choose about a
    million users each; all tables of one store have as many."""

    root: str
    prefix: str = "features"
    buckets: int = 64
    key: str = "user_id"

    def _name(self, table: str, day: date) -> str:
        return f"{self.prefix}_{table}_{day:%Y%m%d}"

    def _path(self, table: str, day: date) -> str:
        return f"{self.root}/{table}/{day:%Y%m%d}"

    def write(self, table: str, day: date, rows: DataFrame) -> DataFrame:
        """Store one table of a day. Its description is written last: without it the table does not count as there."""
        spark, path = rows.sparkSession, self._path(table, day)
        files.delete(spark, f"{path}.json")
        stored = io.save_table(rows, self._name(table, day), (self.key,), self.buckets, path)
        files.write_new(spark, f"{path}.json", json.dumps({"schema": stored.schema.json(), "buckets": self.buckets, "key": self.key}))
        return stored

    def write_day(self, spark: SparkSession, day: date, steps: Sequence[Mapping[str, Callable[[], DataFrame]]], at_once: int = 4) -> None:
        """Store all tables of a day. The tables of one step are written ``at_once`` at a time, so that small jobs share the cluster; a later
        step may read what earlier ones have stored."""
        for step in steps:
            with ThreadPoolExecutor(at_once) as pool:
                for job in [pool.submit(lambda t, rows: self.write(t, day, rows()), table, rows) for table, rows in step.items()]:
                    job.result()

    def has(self, spark: SparkSession, table: str, day: date) -> bool:
        return files.exists(spark, f"{self._path(table, day)}.json")

    def days(self, spark: SparkSession, table: str) -> list[date]:
        """The days a table is stored for, in order."""
        found = [n.removesuffix(".json") for n in files.names(spark, f"{self.root}/{table}") if n.endswith(".json")]
        return sorted(date(int(n[:4]), int(n[4:6]), int(n[6:])) for n in found)

    def read(self, spark: SparkSession, table: str, day: date | None = None) -> DataFrame:
        """A stored table, of the latest day by default."""
        if day is None:
            day = max(self.days(spark, table), default=None)
        if day is None or not self.has(spark, table, day):
            raise FileNotFoundError(f"{table} is not stored for {day}")
        name, path = self._name(table, day), self._path(table, day)
        if not spark.catalog.tableExists(name):
            told = json.loads(files.read_text(spark, f"{path}.json"))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(told["schema"])))
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{told['key']}`) SORTED BY (`{told['key']}`) INTO {told['buckets']} BUCKETS LOCATION '{path}'")
        return spark.table(name)

    def forget(self, spark: SparkSession, table: str, day: date) -> None:
        """Delete a table of a day, its description first."""
        files.delete(spark, f"{self._path(table, day)}.json")
        spark.sql(f"DROP TABLE IF EXISTS {self._name(table, day)}")
        files.delete(spark, self._path(table, day))
