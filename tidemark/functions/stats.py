"""Distribution statistics of a column, each a one-row (or few-row) frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize
from tidemark.functions.ranking import average_ranks, running_totals, value_counts


def upper_median(sorted_values: Column, zeros: Column | None = None) -> Column:
    """``sorted[n // 2]`` of an ascending array, optionally with ``zeros`` more
    leading zero values that are only counted; NULL when there is no value."""
    zeros = F.lit(0) if zeros is None else zeros
    size = F.size(sorted_values) + zeros
    place = F.floor(size / 2)
    return (
        F.when(size <= 0, None)
        .when(place < zeros, F.lit(0))
        .otherwise(F.get(sorted_values, (place - zeros).cast("int")))
    )


def quantile_lower(df: DataFrame, col: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile that is always an existing value (lower neighbour), one row per group."""
    placed = running_totals(value_counts(df, col, by), col, {"n": "n"}, by)
    target = F.floor(F.lit(float(q)) * (F.col("n_total") - 1))
    hit = (F.col("n_before") <= target) & (target < F.col("n_before") + F.col("n"))
    return placed.filter(hit).select(*by, F.col(col).alias("cutoff"))


def percentiles(df: DataFrame, col: str, points: Sequence[float]) -> DataFrame:
    """Linearly interpolated percentiles (``points`` in percent), one row per point.

    Both neighbours are read off the running counts of the distinct values.
    """
    counts = value_counts(df.select(F.col(col).cast("double").alias("v")), "v")
    placed = running_totals(counts, "v", {"n": "n"})
    wanted = F.array(*[F.lit(float(p)) for p in points])
    spots = placed.withColumn("pct", F.explode(wanted)).withColumn(
        "pos", F.col("pct") / 100 * (F.col("n_total") - 1)
    )

    def holds(place: Column) -> Column:
        return (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))

    low, high = F.floor("pos"), F.ceil("pos")
    both = (
        spots.filter(holds(low) | holds(high))
        .groupBy("pct")
        .agg(
            F.max("pos").alias("pos"),
            F.max(F.when(holds(low), F.col("v"))).alias("lo"),
            F.max(F.when(holds(high), F.col("v"))).alias("hi"),
        )
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    return both.select("pct", value.alias("value"))


def gini(df: DataFrame, col: str) -> DataFrame:
    """Gini coefficient, 0 for an empty or all-zero column."""
    placed = running_totals(value_counts(df, col), col, {"n": "n"})
    v, n = F.col(col).cast("double"), F.col("n")
    places = n * F.col("n_before") + n * (n + 1) / 2  # sum of the 1-based places of the ties
    weighted = F.sum(v * (2 * places - (F.col("n_total") + 1) * n))
    total = F.sum(v * n)
    return placed.agg(
        F.coalesce(weighted / F.nullif(F.max("n_total") * total, F.lit(0.0)), F.lit(0.0)).alias("gini")
    )


def top_share(df: DataFrame, col: str, parts: int = 10) -> DataFrame:
    """Share of the total held by the largest ``rows div parts`` rows."""
    placed = running_totals(value_counts(df, col), col, {"n": "n"}, descending=True)
    v = F.col(col).cast("double")
    room = F.floor(F.col("n_total") / parts) - F.col("n_before")
    taken = F.least(F.greatest(room, F.lit(0)), F.col("n"))
    return placed.agg(
        (F.sum(v * taken) / F.nullif(F.sum(v * F.col("n")), F.lit(0.0))).alias("top_share")
    )


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation with average ranks for ties, per group.

    Works on the joint counts of (x, y), combined before anything is shuffled. The join that attaches the
    ranks of y has only a combining sum above it, so Spark splits a value that many pairs share (zeros of a
    heavy-tailed column). Ranks of x meet sums per value of x and are not joined to the pairs.
    """
    by = list(by)
    data = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    joint = materialize(data.dropna(subset=["_x", "_y"]).groupBy(*by, "_x", "_y").agg(
        F.count(F.lit(1)).alias("_n")
    ), "joint")
    values = joint.groupBy(*by, "_y").agg(F.sum("_n").alias("n"))
    ranked = joint.join(_centred(values, "_y", by).select(*by, "_y", "_ry"), [*by, "_y"])
    n, ry = F.col("_n"), F.col("_ry")
    return _rank_correlation(
        ranked.groupBy(*by, "_x").agg(F.sum(n).alias("n"), F.sum(n * ry).alias("_sy"), F.sum(n * ry * ry).alias("_syy")), by)


def _centred(values: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Average rank of every value less the mean rank, as ``_r`` and the column's name without its underscore."""
    return average_ranks(values, col, by).withColumn(f"_r{col.lstrip('_')}", F.col("avg_rank") - (F.col("rows_total") + 1) / 2)


def _rank_correlation(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """``cells``: a row per group and value ``_x`` with its rows ``n`` and the sums ``_sy`` and ``_syy`` of the centred ranks of y and their squares."""
    n, rx = F.col("n"), F.col("_rx")
    value = F.sum(rx * F.col("_sy")) / F.nullif(F.sqrt(F.sum(n * rx * rx) * F.sum("_syy")), F.lit(0.0))
    return _centred(cells, "_x", by).groupBy(*by).agg(value.alias("spearman"))


def spearman_all(df: DataFrame, features: Sequence[str], target: str, k: int = 12) -> DataFrame:
    """Features with the largest absolute Spearman correlation to the target.

    Among features without a missing value the target has the same ranks: they are joined to the rows once, before
    the features are set under each other. Features with missing values rank the target among their own rows.
    """
    numbers = materialize(df.select(
        F.col(target).cast("double").alias("_target"),
        *[F.col(c).cast("double").alias(c) for c in features],
    ).dropna(subset=["_target"]), "correlated")
    missing = numbers.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in features]).first()
    full, part = ([c for c in features if bool(missing[c]) == gaps] for gaps in (False, True))
    found = []
    if full:
        ranked = numbers.join(_centred(value_counts(numbers, "_target"), "_target", []).select("_target", F.col("_rtarget").alias("_ry")), "_target")
        ry = F.col("_ry")
        cells = ranked.unpivot(["_ry"], full, "feature", "_x").groupBy("feature", "_x").agg(
            F.count(F.lit(1)).alias("n"), F.sum(ry).alias("_sy"), F.sum(ry * ry).alias("_syy"))
        found.append(_rank_correlation(cells, ["feature"]))
    if part:
        found.append(spearman(numbers.unpivot(["_target"], part, "feature", "value"), "value", "_target", ["feature"]))
    corr = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return (
        corr.select("feature", F.abs("spearman").alias("abs_spearman"))
        .orderBy(F.desc_nulls_last("abs_spearman"), "feature")
        .limit(k)
    )


def drop_constant(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Leave out columns with at most one distinct value (NULL is a value)."""
    cols = [c for c in df.columns if c not in keep]
    spread = df.agg(
        *[
            (
                (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
                | F.coalesce(F.min(c) != F.max(c), F.lit(False))
            ).alias(c)
            for c in cols
        ]
    ).first()  # one row of flags
    return df.drop(*[c for c in cols if not spread[c]])


def collapse_rare(df: DataFrame, col: str, top: int, other: str = "other", out: str | None = None) -> DataFrame:
    """Keep the ``top`` most frequent values, everything else becomes ``other``."""
    best = (
        df.filter(F.col(col).isNotNull())
        .groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), col).limit(top)  # at most ``top`` rows: safe to broadcast
        .select(F.col(col).alias("_kept"))
    )
    joined = df.join(F.broadcast(best), F.col(col) == F.col("_kept"), "left")
    return joined.withColumn(out or col, F.coalesce("_kept", F.lit(other))).drop("_kept")


def group_summary(
    df: DataFrame, by: str, value: str, min_rows: int = 0, positive: bool = True
) -> DataFrame:
    """Rows, mean, sum and share of the total per group, and P(value > 0)."""
    v = F.col(value).cast("double")
    grouped = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(v).alias("total"), F.avg(v).alias("mean"),
        *([F.avg((v > 0).cast("double")).alias("pay_rate")] if positive else []),
    )
    overall = df.agg(F.sum(v).alias("_all"))  # one row
    share = F.col("total") / F.nullif(F.col("_all"), F.lit(0.0)) * 100
    return (
        grouped.join(F.broadcast(overall))
        .withColumn("share_pct", F.round(share, 1))
        .drop("_all")
        .filter(F.col("rows") >= min_rows)
    )
