"""K-means groups and isotonic calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models import isotonic
from tidemark.models.isotonic import Isotonic

C = F.col


def winback_features(master: DataFrame) -> DataFrame:
    """Ten numbers per churned user, heavy tails on a log scale."""
    def log(c: str):
        return F.log1p(F.greatest(C(c).cast("double"), F.lit(0.0)))

    return master.select(
        "user_id", log("ltv_usd").alias("ltv"), log("customer_lifespan_days").alias("tenure"),
        C("days_since_churn").cast("double").alias("recency_churn"), log("days_since_last_web").alias("recency_web"),
        log("total_downloads").alias("downloads"), log("streams_120").alias("streams"),
        C("prior_reactivations").cast("double").alias("reacts"), C("email_open_rate").alias("open_rate"),
        C("recent_payment_failed").cast("double").alias("pay_fail"), C("is_annual").cast("double").alias("annual"))


def fit_kmeans(df: DataFrame, cols: Sequence[str], k: int = 5, starts: int = 10, seed: int = 42) -> PipelineModel:
    """Best of several seeded starts by training cost, on standardised columns."""
    prep = Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
    ]).fit(df)
    rows = prep.transform(df).select("features").cache()  # read by every start
    try:
        models = [KMeans(k=k, seed=seed + i).fit(rows) for i in range(starts)]
        best = min(models, key=lambda x: x.summary.trainingCost)
    finally:
        rows.unpersist()
    return PipelineModel(stages=[*prep.stages, best])


def cluster_summary(master: DataFrame, clustered: DataFrame) -> DataFrame:
    joined = master.join(clustered.select("user_id", C("prediction").alias("kmeans_cluster")), "user_id")
    return joined.groupBy("kmeans_cluster").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ltv_usd"), 1).alias("ltv"),
        F.round(F.avg("days_since_churn"), 1).alias("dchurn"))


def fit_isotonic(df: DataFrame, score: str, label: str, weight: str | None = None) -> Isotonic:
    """Monotone calibration of a score column, fitted exactly over all its distinct values."""
    return isotonic.fit(df, score, label, weight)


def calibrate(model: Isotonic, df: DataFrame, score: str, out: str) -> DataFrame:
    """Calibrated score, clipped to [0, 1]; scores outside the fitted range take its ends, missing ones have none."""
    found = model.values(df, score).select(C(score).alias("_score"), F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)).alias(out))
    return df.join(found, C(score).cast("double") == C("_score"), "left").drop("_score")
