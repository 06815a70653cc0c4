"""Event tables laid out by a key, for reading one or a few of its values without a scan.

Three things are skipped, each at its own level. Folders: rows lie in folders by hash of the key, so a reader with the key in hand lists
and opens one folder's files. Row groups: inside a file rows are sorted by key and time, row groups are small, and their least and
greatest keys leave nearly all of them out. Row groups again, for columns the rows are not sorted by (visitor ids): Parquet bloom
filters. All of it is Parquet's own and is used through plain filters, which Spark pushes to the scan.

A key with very many rows fills several files of its folder; rows with a null key lie in a folder of their own hash and are read with all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.publish import bucket_of

BUCKET = "key_bucket"


def write_clustered(
    df: DataFrame, path: str, key: str, then: Sequence[str] = (), buckets: int = 64, bloom: Sequence[str] = (),
    distinct: int = 100_000, group_bytes: int = 8 << 20, file_rows: int | None = None,
) -> None:
    """Write ``df`` by ``key``. ``bloom`` columns get filters sized for ``distinct`` values a row group; ``group_bytes`` bounds a row
    group; ``buckets`` should leave files of 100 MB or more."""
    rows = df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).hint("rebalance", BUCKET)
    options = {"parquet.block.size": str(group_bytes)}
    for c in bloom:
        options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(distinct)}
    if file_rows:
        options["maxRecordsPerFile"] = str(file_rows)
    (rows.sortWithinPartitions(BUCKET, key, *then).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .options(**options).partitionBy(BUCKET).parquet(path))



def read_keys(spark: SparkSession, path: str, key: str, values: Sequence, buckets: int = 64) -> DataFrame:
    """Rows of a few values: only their folders are listed as input, and filters on the key reach the row groups.

    ``values`` are literals of the key's own type (whole numbers are taken as its type)."""
    rows = spark.read.parquet(path)
    kind = rows.schema[key].dataType
    typed = [F.lit(v).cast(kind) for v in values]
    folders = F.col(BUCKET).isin(*[bucket_of(v, buckets) for v in typed])
    return rows.where(folders & F.col(key).isin(*typed)).drop(BUCKET)


def read_members(spark: SparkSession, path: str, key: str, ids: DataFrame, buckets: int = 64) -> DataFrame:
    """Rows of the keys in ``ids`` (a frame with column ``key``): a semi join by folder and key, so that Spark prunes folders at run time
    where the list is small, and joins by size where it is not."""
    wanted = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn(BUCKET, bucket_of(F.col(key), buckets))
    return spark.read.parquet(path).join(wanted, [BUCKET, key], "left_semi").drop(BUCKET)
