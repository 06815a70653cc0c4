"""Exploratory tables over the lifetime-value panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import EMERGING_COUNTRIES, Config
from tidemark.functions.scalar import right_closed_bins, value_tier
from tidemark.functions.stats import group_summary, spearman, spearman_all

C = F.col
TARGET = "label_rev_365"


def target_shape(panel: DataFrame) -> DataFrame:
    y = C(TARGET)
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"),
        F.min("index_date").alias("first_index"), F.max("index_date").alias("last_index"),
        F.avg((y > 0).cast("double")).alias("pay_rate"), F.avg(y).alias("mean"),
        F.avg(F.when(y > 0, y)).alias("mean_positive"), F.max(y).alias("max"))


def by_tier(panel: DataFrame, cfg: Config) -> DataFrame:
    return group_summary(panel.withColumn("tier", value_tier("monetary_sum", cfg.tiers)), "tier", TARGET)


def by_emerging(panel: DataFrame) -> DataFrame:
    return group_summary(
        panel.withColumn("emerging", C("country").isin(*EMERGING_COUNTRIES).cast("int")), "emerging", TARGET)


def top_countries(panel: DataFrame, min_rows: int = 2000, top: int = 10) -> DataFrame:
    return group_summary(panel, "country", TARGET, min_rows).orderBy(F.desc("total"), "country").limit(top)


def by_cycle(panel: DataFrame) -> DataFrame:
    return group_summary(panel, "is_annual", TARGET)


def by_provider(panel: DataFrame, min_rows: int = 500) -> DataFrame:
    return group_summary(panel, "provider", TARGET, min_rows).orderBy(F.desc("total"), "provider")


def retention_curve(panel: DataFrame) -> DataFrame:
    bucket = right_closed_bins("recency_days", [0, 30, 60, 90, 180, 365, 730],
                               ["0-30", "31-60", "61-90", "91-180", "181-365", "366-730"])
    return group_summary(panel.withColumn("recency", bucket).dropna(subset=["recency"]), "recency", TARGET)


def frequency_curve(panel: DataFrame) -> DataFrame:
    bucket = right_closed_bins("frequency", [0, 1, 2, 5, 10, 20, 10000],
                               ["1", "2", "3-5", "6-10", "11-20", "20+"])
    return group_summary(panel.withColumn("freq", bucket).dropna(subset=["freq"]), "freq", TARGET)


def persistence(panel: DataFrame) -> DataFrame:
    """How well last year's revenue ranks next year's, and how many payers stay."""
    stays = (C("rev_365") > 0) & (C(TARGET) > 0)
    kept = panel.agg((F.count_if(stays) / F.nullif(F.count_if(C("rev_365") > 0), F.lit(0))).alias("retained"))
    return spearman(panel, "rev_365", TARGET).join(F.broadcast(kept))  # one row each


def correlations(panel: DataFrame, k: int = 12) -> DataFrame:
    numeric = [f.name for f in panel.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name not in ("user_id", TARGET)]
    return spearman_all(panel, numeric, TARGET, k)


def churn_rate_by(panel: DataFrame, col: str, label: str = "label_churn_30", min_rows: int = 30) -> DataFrame:
    """Label rate per value on the latest snapshot of each user."""
    latest = panel.groupBy("user_id").agg(
        F.max_by(F.struct(C(col).alias("value"), C(label).alias("y")), "snapshot_date").alias("r"))
    return (
        latest.select(C("r.value").alias(col), C("r.y").alias("y")).dropna(subset=[col]).groupBy(col)
        .agg(F.count(F.lit(1)).alias("users"), F.avg("y").alias("churn_rate"))
        .filter(C("users") >= min_rows)
    )


def storage_bucket(pct: str = "storage_used_pct"):
    return right_closed_bins(pct, [0, 50, 80, 100, 1e9], ["<50%", "50-80%", "80-100%", "100%+"])
