"""Quasi-uplift estimates from the panel with treatment and control rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.supervised import Features, TreeParams, fit_gbt, predict

C = F.col


def by_segment(df: DataFrame, flags: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, flag that is set)."""
    return (
        df.select(*keep, *flags).unpivot(list(keep), list(flags), "segment", "_on")
        .filter(C("_on") == 1).drop("_on")
    )


def naive_uplift(panel: DataFrame, flags: Sequence[str], label: str, min_arm: int = 50,
                 weight: str = "sample_weight") -> DataFrame:
    """Weighted label rate of treated minus control rows per segment (confounded)."""
    rows = by_segment(panel, flags, ["treatment", label, weight])
    treated, w = C("treatment") == 1, C(weight)

    def rate(cond):
        return F.sum(F.when(cond, w * C(label))) / F.nullif(F.sum(F.when(cond, w)), F.lit(0.0))

    return (
        rows.groupBy("segment")
        .agg(F.count_if(treated).alias("treated"), F.count_if(~treated).alias("controls"),
             rate(treated).alias("rate_treated"), rate(~treated).alias("rate_control"))
        .withColumn("naive_uplift", C("rate_treated") - C("rate_control"))
        .filter((C("treated") >= min_arm) & (C("controls") >= min_arm))
    )


def segment_effect(scored: DataFrame, flags: Sequence[str], effect: str, min_rows: int = 100,
                   weight: str = "sample_weight") -> DataFrame:
    """Weighted mean effect per segment, and over all rows as segment 'all'."""
    # 'all' is a flag that every row has: beside a union the scores would be computed once more
    rows = by_segment(scored.withColumn("all", F.lit(1)), [*flags, "all"], [effect, weight])
    return (
        rows.groupBy("segment")
        .agg(F.count(F.lit(1)).alias("rows"), (F.sum(C(effect) * C(weight)) / F.sum(weight)).alias(effect))
        .filter((C("rows") >= min_rows) | (C("segment") == "all"))
    )


def s_learner(panel: DataFrame, feats: Features, label: str, params: TreeParams, weight: str = "sample_weight") -> DataFrame:
    """One model with treatment as a feature; effect = P(1 | treated) - P(1 | not)."""
    with_t = feats.plus(["treatment"])
    model = fit_gbt(panel, with_t, label, weight, params)
    both = panel.withColumnRenamed("treatment", "_arm")
    p1 = predict(model, both.withColumn("treatment", F.lit(1)), with_t, "p1").drop("treatment")
    p0 = predict(model, p1.withColumn("treatment", F.lit(0)), with_t, "p0").drop("treatment")
    return p0.withColumnRenamed("_arm", "treatment").withColumn("tau", C("p1") - C("p0"))


def t_learner(panel: DataFrame, feats: Features, label: str, params: TreeParams, weight: str = "sample_weight") -> DataFrame:
    """A model per arm; effect = difference of the two on every row."""
    arms = [fit_gbt(panel.filter(C("treatment") == a), feats, label, weight, params) for a in (1, 0)]
    scored = predict(arms[0], panel, feats, "p1")
    return predict(arms[1], scored, feats, "p0").withColumn("tau", C("p1") - C("p0"))
