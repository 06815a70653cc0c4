"""Keyed state that streams change in place: rows are replaced and leave again, in a published table.

The table holds one row per key, in folders by hash of the key. A micro-batch is reduced to the newest row per key, the folders
it touches are rewritten with it, and one commit publishes them together with the batch's number: a batch that is
repeated after a restart is recognised by that number and changes nothing. Readers see whole batches.

A key whose newest row says that it is gone leaves the table for its readers at once. Its row stays as a tombstone, so that older rows
arriving late cannot bring the key back; once it is older than ``keep_days`` before the newest row seen, the next rewrite of its folder
drops it. Rows later than that would be taken for new, which is the bound on lateness.

Cost: a batch rewrites the folders it touches. Choose buckets of about 100 MB and triggers that bring a good part of a bucket's rows;
for many small batches the parts form (``rollups.append_parts``) writes less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import publish

C = F.col
DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class Merged:
    """``key``, the row's ``version`` (a number, larger is newer), its time in microseconds ``at``, and ``gone``, true where the key leaves."""

    path: str
    key: str = "user_id"
    buckets: int = 64
    keep_days: int = 30

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per key. Numbers are aggregated with the version that outranks all others, and hashing stays possible."""
        kept = [c for c in rows.columns if c not in (self.key, "version", "_bucket")]
        return rows.groupBy("_bucket", self.key).agg(F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in kept])

    def merge(self, batch: DataFrame, stream: str, batch_id: int) -> bool:
        """Merge one micro-batch; False if that has been done before."""
        spark = batch.sparkSession
        before = publish.current(spark, self.path)
        if before is not None and before.notes.get(f"batch-{stream}", -1) >= batch_id:
            return False
        notes = {f"batch-{stream}": batch_id}
        fresh = self.newest(batch.withColumn("_bucket", publish.bucket_of(C(self.key), self.buckets)))
        fresh = fresh.persist()  # a row per key of one micro-batch; recomputed if an executor goes
        try:
            touched = [str(r["_bucket"]) for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets``
            if not touched:
                publish.commit(spark, self.path, before, "_bucket", publish.schema_of(fresh, "_bucket"), {}, notes=notes)
                return True
            seen = max(fresh.agg(F.max("at")).first()[0], before.notes.get("newest", 0) if before else 0)
            rows = fresh
            if before is not None:
                rows = self.newest(publish.read(spark, self.path, before, touched).unionByName(fresh))
            kept = rows.where(~C("gone") | (C("at") >= seen - self.keep_days * DAY_MICROS))
            schema, put = publish.stage(kept, self.path, "_bucket", [self.key])
            publish.commit(spark, self.path, before, "_bucket", schema, put, drop=touched, notes=notes | {"newest": seen})
        finally:
            fresh.unpersist()
        return True

    def start(self, stream: DataFrame, rows: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
        """Keep the table from a stream; ``rows`` turns a micro-batch into rows of the table. Restarts go on where they stopped."""
        name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

        def write(batch: DataFrame, batch_id: int) -> None:
            self.merge(rows(batch), name, batch_id)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def stored(self, spark: SparkSession) -> DataFrame:
        """Rows as they are kept, tombstones with them."""
        return publish.read(spark, self.path).drop("_bucket")

    def read(self, spark: SparkSession) -> DataFrame:
        """Keys that are there."""
        return self.stored(spark).where(~C("gone")).drop("gone")

    def lookup(self, spark: SparkSession, *keys: int) -> DataFrame:
        """Rows of a few keys: only their folders are read."""
        version = publish.current(spark, self.path)
        wanted = spark.createDataFrame([(k,) for k in keys], f"{self.key} long")
        buckets = {r[0] for r in wanted.select(publish.bucket_of(C(self.key), self.buckets)).collect()}
        return publish.read(spark, self.path, version, buckets).where(~C("gone") & C(self.key).isin(*keys)).drop("_bucket", "gone")
