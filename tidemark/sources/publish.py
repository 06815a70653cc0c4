"""Partitioned Parquet tables that change by versions: written first, then published all at once.

A table is a folder. Partitions are written to folders of their own below ``data`` and never changed; a version is one small file
below ``versions`` that names the folder of every partition. A refresh stages any number of partitions, in any number of jobs, and
commits them as the next version; readers take the newest version there is when they start, so none sees half a refresh, and
one that has started keeps reading its version until its folders are vacuumed. Of two writers that commit the same version one fails
(``Conflict``); what it staged is still there, so it can commit again on top of the newer version.

The commit rests on a file system that renames at once and refuses a taken name, as HDFS and local disks do; an object store needs a
committer of its own.

A version also carries ``notes``, such as the last batch of each stream merged into it: rows and notes change together or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import files

NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has published the version meanwhile."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    by: str = ""
    schema: str = ""  # of the rows, without the partition column
    parts: Mapping[str, str] = field(default_factory=dict)  # partition value as text -> folder below the table
    notes: Mapping[str, object] = field(default_factory=dict)


def _name(number: int) -> str:
    return f"{number:012d}.json"


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest version, from one listing; None for a folder that is no published table."""
    names = [n for n in files.names(spark, f"{path}/versions") if n.endswith(".json")]
    return at(spark, path, int(max(names).removesuffix(".json"))) if names else None


def at(spark: SparkSession, path: str, number: int) -> Version:
    return Version(**json.loads(files.read_text(spark, f"{path}/versions/{_name(number)}")))


def stage(df: DataFrame, path: str, by: str, sort_by: Collection[str] = (), options: Mapping[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """Write the partitions of ``df`` where no reader looks yet: ``(schema, value -> folder)``.

    Rows are rebalanced by the partition column, a very large partition over several files."""
    token = f"data/t={uuid.uuid4().hex[:16]}x"
    rows = df.hint("rebalance", by)
    if sort_by:
        rows = rows.sortWithinPartitions(by, *sort_by)
    rows.write.options(**(options or {})).partitionBy(by).parquet(f"{path}/{token}")
    found = files.partition_folders(df.sparkSession, f"{path}/{token}", by)
    return schema_of(df, by), {value: f"{token}/{folder.rstrip('/').rsplit('/', 1)[1]}" for value, folder in found.items()}


def schema_of(df: DataFrame, by: str) -> str:
    return T.StructType([f for f in df.schema.fields if f.name != by] + [df.schema[by]]).json()


def commit(
    spark: SparkSession, path: str, based_on: Version | None, by: str, schema: str, put: Mapping[str, str],
    drop: Collection[str] = (), notes: Mapping[str, object] | None = None,
) -> Version:
    """Publish the version after ``based_on``: its partitions with ``put`` in place, without those in ``drop``."""
    base = based_on or Version()
    if base.by not in ("", by):
        raise ValueError(f"the table is partitioned by {base.by}, not by {by}")
    parts = {**{v: p for v, p in base.parts.items() if v not in drop}, **put}
    version = Version(base.number + 1, by, schema or base.schema, parts, {**base.notes, **(notes or {})})
    if not files.write_new(spark, f"{path}/versions/{_name(version.number)}", json.dumps(version.__dict__)):
        raise Conflict(f"version {version.number} of {path} exists already")
    return version


def read(spark: SparkSession, path: str, version: Version | None = None, values: Collection | None = None) -> DataFrame:
    """Rows of a version, the newest by default; with ``values`` of those partitions only, whose folders alone are listed."""
    version = version or current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    schema = T.StructType.fromJson(json.loads(version.schema))
    wanted = None if values is None else {NULL_FOLDER if v is None else str(v) for v in values}
    folders = [f"{path}/{p}" for v, p in version.parts.items() if wanted is None or v in wanted]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the folders that none of the last ``keep`` versions names, and older versions; returns the folders deleted.

    Run it when no refresh is being staged and no reader holds an older version."""
    numbers = sorted(int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/versions") if n.endswith(".json"))
    used = {p for n in numbers[-keep:] for p in at(spark, path, n).parts.values()}
    tokens, gone = {p.rsplit("/", 1)[0] for p in used}, 0
    for token in files.names(spark, f"{path}/data"):
        held = [f"data/{token}/{p}" for p in files.names(spark, f"{path}/data/{token}") if "=" in p]
        dead = [p for p in held if p not in used]
        gone += len(dead)
        for folder in [f"data/{token}"] if f"data/{token}" not in tokens else dead:
            files.delete(spark, f"{path}/{folder}")
    for n in numbers[:-keep]:
        files.delete(spark, f"{path}/versions/{_name(n)}")
    return gone


# --- rows by key ---------------------------------------------------------------------------------------------
def bucket_of(key, buckets: int):
    """The bucket of a key column or literal: folded to a constant for a literal, so that it prunes folders."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
