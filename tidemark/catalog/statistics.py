"""Distribution statistics and model metrics with their check SQL.

The scored table is the lifetime-value panel with last year's revenue as score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.panels import DATES_SQL, ltv_sql
from tidemark.catalog.registry import query
from tidemark.functions import metrics as m
from tidemark.functions import scalar as sc
from tidemark.functions import stats as st
from tidemark.functions.ranking import global_rows, quantile_bin, top_fraction
from tidemark.plans import ltv_eda as eda
from tidemark.plans import ltv_panel as ltv
from tidemark.sources.fixtures import LTV_DATES, TEST_CONFIG as CFG
from tidemark.sources.tables import Tables

C = F.col
PANEL = f"lp AS (WITH {ltv_sql(DATES_SQL, 2, True)})"


def panel(t: Tables) -> DataFrame:
    return ltv.build_ltv_panel(t.revenue, LTV_DATES, CFG)


def scored(t: Tables) -> DataFrame:
    """id, y (paid later), value (how much), score, p in [0, 1), w."""
    return panel(t).select(
        (C("user_id").cast("decimal(20,0)") * 100000 + F.unix_date("index_date")).cast("bigint").alias("id"),
        (C("label_rev_365") > 0).cast("int").alias("y"), C("label_rev_365").alias("value"),
        C("rev_365").alias("score"), (C("rev_365") / (C("rev_365") + 100000.0)).alias("p"),
        F.when(C("user_id") % 3 == 0, 4.0).otherwise(1.0).alias("w"))


S = f"""{PANEL}, s AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(index_date AS DATE)) AS id,
  CAST(label_rev_365 > 0 AS INTEGER) AS y, label_rev_365 AS value, rev_365 AS score,
  rev_365 / (rev_365 + 100000.0::DOUBLE) AS p, CASE WHEN user_id % 3 = 0 THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM lp)"""

# --- rank and distribution ---------------------------------------------------------
query("stat_quantile_lower", "A-17 M-3 M-6", f"""{PANEL},
r AS (SELECT date_diff('day', DATE '1970-01-01', CAST(index_date AS DATE)) AS d,
  row_number() OVER (ORDER BY index_date) - 1 AS i, COUNT(*) OVER () AS n FROM lp)
SELECT CAST(d AS INTEGER) AS cutoff FROM r WHERE i = CAST(floor(0.8::DOUBLE * (n - 1)) AS BIGINT)""")(
    lambda t: st.quantile_lower(panel(t).select(F.unix_date("index_date").alias("d")), "d", 0.8))
query("stat_percentiles", "A-16", f"""{PANEL}
SELECT CAST(unnest([50, 75, 90, 95, 99]) AS DOUBLE) AS pct,
  unnest([quantile_cont(label_rev_365, 0.5), quantile_cont(label_rev_365, 0.75), quantile_cont(label_rev_365, 0.9),
          quantile_cont(label_rev_365, 0.95), quantile_cont(label_rev_365, 0.99)]) AS value FROM lp""")(
    lambda t: st.percentiles(panel(t), "label_rev_365", (50, 75, 90, 95, 99)))
query("stat_gini", "A-18", f"""{PANEL}, r AS (SELECT label_rev_365 AS x,
  row_number() OVER (ORDER BY label_rev_365) AS i, COUNT(*) OVER () AS n FROM lp)
SELECT SUM((2 * i - n - 1) * x) / (MAX(n) * SUM(x)) AS gini FROM r""")(lambda t: st.gini(panel(t), "label_rev_365"))
query("stat_top_share", "A-19", f"""{PANEL}, r AS (SELECT label_rev_365 AS x,
  row_number() OVER (ORDER BY label_rev_365 DESC) AS i, COUNT(*) OVER () AS n FROM lp)
SELECT SUM(x) FILTER (i <= n // 10) / SUM(x) AS top_share FROM r""")(
    lambda t: st.top_share(panel(t), "label_rev_365"))


def ranks(col: str, out: str) -> str:
    return f"(rank() OVER (ORDER BY {col}) + (COUNT(*) OVER (PARTITION BY {col}) - 1) / 2.0)::DOUBLE AS {out}"


query("stat_spearman", "A-20 W-9", f"""{PANEL}, r AS (SELECT {ranks('rev_365', 'a')}, {ranks('label_rev_365', 'b')} FROM lp)
SELECT ROUND(corr(a, b), 9) AS spearman FROM r""")(
    lambda t: st.spearman(panel(t), "rev_365", "label_rev_365").select(F.round("spearman", 9).alias("spearman")))
NUMERIC = tuple(c for c in ltv.FEATURES_V2 if c not in ("last_plan_id", "provider", "country"))
CORRS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(abs(SUM((a - m) * (b - o)) / nullif(sqrt(SUM((a - m) ** 2) * SUM((b - o) ** 2)), 0)), 9) AS abs_spearman FROM "
    f"(SELECT a, b, AVG(a) OVER () AS m, AVG(b) OVER () AS o FROM (SELECT {ranks(c, 'a')}, {ranks('label_rev_365', 'b')} FROM lp WHERE {c} IS NOT NULL))"
    for c in NUMERIC)
query("stat_spearman_all", "A-20 T-5", f"{PANEL}, c AS ({CORRS}) SELECT * FROM c ORDER BY abs_spearman DESC NULLS LAST, feature LIMIT 12")(
    lambda t: eda.correlations(panel(t)).select("feature", F.round("abs_spearman", 9).alias("abs_spearman")))
query("stat_quantile_bins", "W-10", f"""{S}, r AS (SELECT id, row_number() OVER (ORDER BY score, id) AS i,
  COUNT(*) OVER () AS n FROM s)
SELECT id, CAST(greatest(1, ((i - 1) * 10 + n - 2) // (n - 1)) AS INTEGER) AS bin FROM r""")(
    lambda t: quantile_bin(scored(t).select("id", "score"), "score", "id").select("id", "bin"))
query("stat_running_weight", "W-11 W-12 T-3", f"""{S}
SELECT id, row_number() OVER (ORDER BY score DESC, id) AS row_no,
  SUM(w) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS w_upto, w / SUM(w) OVER () AS w_share FROM s""")(
    lambda t: global_rows(scored(t), "score", "id", sums={"w": "w"}, descending=True)
    .select("id", "row_no", "w_upto", (C("w") / C("w_total")).alias("w_share")))
query("stat_top_percent", "T-3", f"""{S}, r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS i,
  COUNT(*) OVER () AS n FROM s) SELECT id, score FROM r WHERE i <= greatest(CAST(floor(n * 0.05::DOUBLE) AS BIGINT), 1)""")(
    lambda t: top_fraction(scored(t).select("id", "score"), "score", "id", 5))
query("stat_weekly_trend", "W-14", """
SELECT user_id, COUNT(*) FILTER (created_at >= TIMESTAMP '2024-01-24 00:00:00') AS this_week,
  COUNT(*) FILTER (created_at < TIMESTAMP '2024-01-24 00:00:00') AS last_week FROM fx_events
WHERE created_at >= TIMESTAMP '2024-01-17 00:00:00' AND user_id IS NOT NULL GROUP BY user_id""")(
    lambda t: weekly_trend(t))


def weekly_trend(t: Tables) -> DataFrame:
    from tidemark.sources.fixtures import AS_OF

    recent = sc.since("created_at", AS_OF, 7)
    return (
        t.events.filter(sc.since("created_at", AS_OF, 14) & C("user_id").isNotNull()).groupBy("user_id")
        .agg(sc.count_if(recent).alias("this_week"), sc.count_if(~recent).alias("last_week")))


query("stat_rare_countries", "F-18", """
top AS (SELECT provider FROM fx_revenue GROUP BY provider ORDER BY COUNT(*) DESC, provider LIMIT 3)
SELECT txn_id, CASE WHEN provider IN (SELECT provider FROM top) THEN provider ELSE 'other' END AS provider FROM fx_revenue""")(
    lambda t: st.collapse_rare(t.revenue.select("txn_id", "provider"), "provider", 3))
query("stat_constant_columns", "F-17 M-1", """
SELECT txn_id, user_id, CAST(amount_usd AS DOUBLE) AS amount_usd, status, transaction_date, provider,
  billing_plan_id, country FROM fx_revenue""")(lambda t: st.drop_constant(t.revenue))
query("stat_sentinels", "F-19 X-5", f"""{PANEL}
SELECT user_id, index_date, CASE WHEN gap_median >= 0 THEN gap_median END AS gap_median,
  CAST(gap_median < 0 AS INTEGER) AS gap_median_missing, ROUND(sign(rev_trend) * ln(1 + abs(rev_trend)), 9) AS log_trend
FROM lp""")(
    lambda t: sc.sentinel_to_null(panel(t).select("user_id", "index_date", "gap_median", "rev_trend"), ["gap_median"])
    .withColumn("log_trend", F.round(sc.signed_log1p("rev_trend"), 9)).drop("rev_trend"))

# --- model metrics -------------------------------------------------------------------
query("metric_roc_auc", "M-19", f"""{S}, r AS (SELECT y, w, score, SUM(w * (1 - y)) OVER (ORDER BY score) AS upto,
  SUM(w * (1 - y)) OVER (PARTITION BY score) AS here FROM s)
SELECT ROUND(SUM(w * y * (upto - here / 2)) / (SUM(w * y) * SUM(w * (1 - y))), 9) AS roc_auc FROM r""")(
    lambda t: m.roc_auc(scored(t), "y", "score", "w").select(F.round("roc_auc", 9).alias("roc_auc")))
query("metric_avg_precision", "M-20", f"""{S}, g AS (SELECT score, SUM(w * y) AS wp, SUM(w) AS ww FROM s GROUP BY score),
r AS (SELECT *, SUM(wp) OVER (ORDER BY score DESC) AS tp, SUM(ww) OVER (ORDER BY score DESC) AS seen,
  SUM(wp) OVER () AS pos FROM g)
SELECT ROUND(SUM(wp / pos * tp / seen), 9) AS avg_precision FROM r""")(
    lambda t: m.avg_precision(scored(t), "y", "score", "w").select(F.round("avg_precision", 9).alias("avg_precision")))
query("metric_lift", "M-21 W-11", f"""{S}, r AS (SELECT y, w, SUM(w) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS upto,
  SUM(w) OVER () AS total, row_number() OVER (ORDER BY score DESC, id) AS i FROM s)
SELECT ROUND((SUM(w * y) FILTER (upto < total * 0.1::DOUBLE OR i = 1) / SUM(w) FILTER (upto < total * 0.1::DOUBLE OR i = 1))
  / (SUM(w * y) / SUM(w)), 9) AS lift FROM r""")(
    lambda t: m.lift_at(scored(t), "y", "score", "id", 10, "w").select(F.round("lift", 9).alias("lift")))
query("metric_top_decile", "M-21 T-3", f"""{S}, r AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS i,
  COUNT(*) OVER () AS n FROM s), k AS (SELECT *, i <= greatest(n // 10, 1) AS top FROM r)
SELECT ROUND(AVG(y) FILTER (top), 9) AS precision, ROUND(CAST(SUM(y) FILTER (top) AS DOUBLE) / SUM(y), 9) AS recall,
  ROUND(AVG(y) FILTER (top) / AVG(y), 9) AS lift FROM k""")(
    lambda t: m.prec_recall_at(scored(t), "y", "score", "id").select(
        *[F.round(c, 9).alias(c) for c in ("precision", "recall", "lift")]))
query("metric_ece", "M-22", f"""{S}, b AS (SELECT least(CAST(floor(p * 10) AS INTEGER), 9) AS bin, SUM(w) AS ww,
  SUM(w * y) / SUM(w) AS my, SUM(w * p) / SUM(w) AS mp FROM s GROUP BY 1)
SELECT ROUND(SUM(ww * abs(my - mp)) / SUM(ww), 9) AS ece FROM b""")(
    lambda t: m.ece(scored(t), "y", "p", 10, "w").select(F.round("ece", 9).alias("ece")))
query("metric_brier", "M-22", f"{S} SELECT ROUND(SUM(w * (p - y) * (p - y)) / SUM(w), 9) AS brier FROM s")(
    lambda t: m.brier(scored(t), "y", "p", "w").select(F.round("brier", 9).alias("brier")))
query("metric_mae_rmse", "M-23", f"""{S} SELECT ROUND(AVG(abs(score - value)), 4) AS mae,
  ROUND(sqrt(AVG((score - value) * (score - value))), 4) AS rmse FROM s""")(
    lambda t: m.mae_rmse(scored(t), "value", "score").select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse")))
query("metric_capture", "M-23 T-3", f"""{S}, r AS (SELECT value, row_number() OVER (ORDER BY score DESC, id) AS i,
  COUNT(*) OVER () AS n FROM s)
SELECT ROUND(SUM(value) FILTER (i <= greatest(n // 5, 1)) / SUM(value), 9) AS capture FROM r""")(
    lambda t: m.capture(scored(t), "value", "score", "id", 20).select(F.round("capture", 9).alias("capture")))
query("metric_decile_table", "M-24 W-10 W-12", f"""{S}, r AS (SELECT *, row_number() OVER (ORDER BY score, id) AS i,
  COUNT(*) OVER () AS n FROM s),
d AS (SELECT CAST(greatest(1, ((i - 1) * 10 + n - 2) // (n - 1)) AS INTEGER) AS decile, COUNT(*) AS n,
  ROUND(AVG(score), 3) AS pred_mean, ROUND(AVG(value), 3) AS actual_mean, ROUND(SUM(value), 2) AS actual_sum FROM r GROUP BY 1)
SELECT *, ROUND(actual_sum / SUM(actual_sum) OVER () * 100, 1) AS rev_share_pct FROM d""")(
    lambda t: m.decile_table(scored(t), "value", "score", "id").select(
        "decile", "n", F.round("pred_mean", 3).alias("pred_mean"), F.round("actual_mean", 3).alias("actual_mean"),
        F.round("actual_sum", 2).alias("actual_sum"), "rev_share_pct"))
query("metric_total_calibration", "M-24", f"""{S} SELECT ROUND(SUM(value), 2) AS actual_total,
  ROUND(SUM(score), 2) AS score_total FROM s""")(
    lambda t: m.total_calibration(scored(t), "value", ["score"]).select(
        F.round("actual_total", 2).alias("actual_total"), F.round("score_total", 2).alias("score_total")))
query("metric_weighted_mean", "A-13", f"{S} SELECT ROUND(SUM(y * w) / SUM(w), 9) AS weighted_mean FROM s")(
    lambda t: m.weighted_mean(scored(t), "y", "w").select(F.round("weighted_mean", 9).alias("weighted_mean")))


# --- exploratory tables ------------------------------------------------------------
def summary_sql(key: str, name: str, having: str = "") -> str:
    return f"""{PANEL}, g AS (SELECT {key} AS {name}, label_rev_365 AS y FROM lp)
SELECT {name}, COUNT(*) AS rows, ROUND(SUM(y), 2) AS total, ROUND(AVG(y), 4) AS mean,
  ROUND(AVG(CAST(y > 0 AS INTEGER)), 9) AS pay_rate,
  ROUND(SUM(y) / (SELECT SUM(y) FROM g) * 100, 1) AS share_pct FROM g WHERE {name} IS NOT NULL GROUP BY 1 {having}"""


def tidy(df: DataFrame, name: str) -> DataFrame:
    return df.select(name, "rows", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"),
                     F.round("pay_rate", 9).alias("pay_rate"), "share_pct")


TIER = "CASE WHEN monetary_sum >= 3000000 THEN 'Platinum' WHEN monetary_sum >= 1500000 THEN 'Gold' " \
       "WHEN monetary_sum >= 500000 THEN 'Silver' WHEN monetary_sum > 0 THEN 'Bronze' ELSE 'Prospect' END"
query("eda_tiers", "K-21 A-21", summary_sql(TIER, "tier"))(lambda t: tidy(eda.by_tier(panel(t), CFG), "tier"))
query("eda_emerging", "K-21 A-21", summary_sql("CAST(country IN ('in', 'id') AS INTEGER)", "emerging"))(
    lambda t: tidy(eda.by_emerging(panel(t)), "emerging"))
query("eda_countries", "K-21 T-5", summary_sql("country", "country", "HAVING COUNT(*) >= 2000 ORDER BY SUM(y) DESC, country LIMIT 10"))(
    lambda t: tidy(eda.top_countries(panel(t)), "country"))
query("eda_cycle", "K-21", summary_sql("is_annual", "is_annual"))(lambda t: tidy(eda.by_cycle(panel(t)), "is_annual"))
query("eda_providers", "K-21", summary_sql("provider", "provider", "HAVING COUNT(*) >= 500"))(
    lambda t: tidy(eda.by_provider(panel(t)), "provider"))
query("eda_retention_curve", "K-21 X-14", summary_sql(
    "CASE WHEN recency_days <= 0 THEN NULL WHEN recency_days <= 30 THEN '0-30' WHEN recency_days <= 60 THEN '31-60' "
    "WHEN recency_days <= 90 THEN '61-90' WHEN recency_days <= 180 THEN '91-180' WHEN recency_days <= 365 THEN '181-365' "
    "ELSE '366-730' END", "recency"))(lambda t: tidy(eda.retention_curve(panel(t)), "recency"))
query("eda_frequency_curve", "K-21 X-14", summary_sql(
    "CASE WHEN frequency <= 1 THEN '1' WHEN frequency <= 2 THEN '2' WHEN frequency <= 5 THEN '3-5' "
    "WHEN frequency <= 10 THEN '6-10' WHEN frequency <= 20 THEN '11-20' ELSE '20+' END", "freq"))(
    lambda t: tidy(eda.frequency_curve(panel(t)), "freq"))
query("eda_target_shape", "K-21 A-3", f"""{PANEL} SELECT COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users,
  MIN(index_date) AS first_index, MAX(index_date) AS last_index, ROUND(AVG(CAST(label_rev_365 > 0 AS INTEGER)), 9) AS pay_rate,
  ROUND(AVG(label_rev_365), 4) AS mean, ROUND(AVG(label_rev_365) FILTER (label_rev_365 > 0), 4) AS mean_positive,
  MAX(label_rev_365) AS max FROM lp""")(
    lambda t: eda.target_shape(panel(t)).withColumns(
        {"pay_rate": F.round("pay_rate", 9), "mean": F.round("mean", 4), "mean_positive": F.round("mean_positive", 4)}))
query("eda_persistence", "K-21 M-12", f"""{PANEL}, r AS (SELECT {ranks('rev_365', 'a')}, {ranks('label_rev_365', 'b')},
  rev_365, label_rev_365 FROM lp)
SELECT ROUND(corr(a, b), 9) AS spearman, ROUND(CAST(COUNT(*) FILTER (rev_365 > 0 AND label_rev_365 > 0) AS DOUBLE)
  / COUNT(*) FILTER (rev_365 > 0), 9) AS retained FROM r""")(
    lambda t: eda.persistence(panel(t)).select(
        F.round("spearman", 9).alias("spearman"), F.round("retained", 9).alias("retained")))
