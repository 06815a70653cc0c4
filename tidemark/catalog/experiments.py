"""Holdouts and uplift with their check SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import sqlparts as p
from tidemark.catalog.profiles import PROFILE, profile_table
from tidemark.catalog.registry import query
from tidemark.functions.metrics import qini
from tidemark.plans import conversion_panel as conv
from tidemark.plans import experiments as ex
from tidemark.sources.fixtures import AS_OF, TEST_CONFIG as CFG
from tidemark.sources.tables import Tables

C = F.col
CAMPAIGN = "monitor"


def arm_sql(expr: str) -> str:
    return f"CASE WHEN {p.bucket(expr, 100)} < 10 THEN 'holdout' ELSE 'treatment' END"


query("holdout_assignment", "K-18 X-11", f"""{PROFILE}
SELECT user_id, '{CAMPAIGN}' AS campaign, {arm_sql(f"concat(CAST(user_id AS VARCHAR), ':{CAMPAIGN}')")} AS arm,
  '2024-01-31' AS assigned_date FROM c360 WHERE next_best_action = '{CAMPAIGN}'""")(
    lambda t: ex.assign_holdout(profile_table(t), CAMPAIGN, AS_OF.date(), CFG))

# an older assignment whose window is complete: all payers
SENT = date(2023, 6, 1)


def past_holdout(t: Tables) -> DataFrame:
    payers = t.revenue.select("user_id").distinct().withColumn("next_best_action", F.lit("hd_upsell"))
    return ex.assign_holdout(payers, "hd_upsell", SENT, CFG)


HOLDOUT = f"""hold AS (SELECT DISTINCT user_id, {arm_sql("concat(CAST(user_id AS VARCHAR), ':hd_upsell')")} AS arm,
  DATE '2023-06-01' AS assigned_date FROM fx_revenue),
conv AS (SELECT h.arm, h.user_id, MAX(CASE WHEN r.transaction_date > h.assigned_date
    AND r.transaction_date <= h.assigned_date + INTERVAL 120 DAY THEN 1 ELSE 0 END) AS converted,
  CAST(COALESCE(SUM(r.amount_usd) FILTER (r.transaction_date > h.assigned_date
    AND r.transaction_date <= h.assigned_date + INTERVAL 120 DAY), 0) AS DOUBLE) AS revenue
  FROM hold h LEFT JOIN (SELECT * FROM fx_revenue WHERE status = 'completed') r ON r.user_id = h.user_id GROUP BY 1, 2)"""
query("holdout_conversions", "J-7 Q-17", f"{HOLDOUT} SELECT * FROM conv")(
    lambda t: ex.conversions(past_holdout(t), t.revenue, "hd_upsell", 120))
query("holdout_uplift", "K-19 A-26 X-6 J-7", f"""{HOLDOUT},
a AS (SELECT CAST(COUNT(*) FILTER (arm = 'treatment') AS DOUBLE) AS nt, CAST(SUM(converted) FILTER (arm = 'treatment') AS DOUBLE) AS ct,
  ROUND(SUM(revenue) FILTER (arm = 'treatment'), 2) AS rev_t, CAST(COUNT(*) FILTER (arm = 'holdout') AS DOUBLE) AS nh,
  CAST(SUM(converted) FILTER (arm = 'holdout') AS DOUBLE) AS ch, ROUND(SUM(revenue) FILTER (arm = 'holdout'), 2) AS rev_h FROM conv),
z AS (SELECT *, (ct / nt - ch / nh) / sqrt(((ct + ch) / (nt + nh)) * (1 - (ct + ch) / (nt + nh)) * (1 / nt + 1 / nh)) AS z FROM a)
SELECT 'hd_upsell' AS campaign, CAST(nt AS BIGINT) AS treat_users, CAST(ct AS BIGINT) AS treat_conv,
  ROUND(ct / nt, 5) AS conv_treatment, rev_t AS treat_revenue_usd, ROUND(rev_t / nt, 4) AS arpu_treatment,
  CAST(nh AS BIGINT) AS hold_users, CAST(ch AS BIGINT) AS hold_conv, ROUND(ch / nh, 5) AS conv_holdout,
  rev_h AS hold_revenue_usd, ROUND(rev_h / nh, 4) AS arpu_holdout, ROUND(ct / nt - ch / nh, 5) AS absolute_uplift,
  ROUND((ct / nt - ch / nh) / NULLIF(ch / nh, 0) * 100, 1) AS relative_uplift_pct, ROUND(z, 2) AS z_score,
  CASE WHEN abs(z) > 1.96 THEN 'significant_95' ELSE 'not_significant' END AS verdict FROM z""")(
    lambda t: ex.measure_uplift(past_holdout(t), t.revenue, "hd_upsell", 120, CFG))


def naive_sql() -> str:
    from tidemark.catalog import panels as pn

    per_flag = " UNION ALL ".join(
        f"SELECT '{c}' AS segment, treatment, label_conv_14d AS y, sample_weight AS w FROM s WHERE {c} = 1"
        for c in conv.SEGMENT_FLAGS)
    return f"""{pn.INDEX}, {pn.BOTH}, {pn.CANDIDATES}, s AS ({pn.SAMPLED.format(drop='')}), u AS ({per_flag}),
a AS (SELECT segment, COUNT(*) FILTER (treatment = 1) AS treated, COUNT(*) FILTER (treatment = 0) AS controls,
  SUM(w * y) FILTER (treatment = 1) / SUM(w) FILTER (treatment = 1) AS rate_treated,
  SUM(w * y) FILTER (treatment = 0) / SUM(w) FILTER (treatment = 0) AS rate_control FROM u GROUP BY 1)
SELECT *, rate_treated - rate_control AS naive_uplift FROM a WHERE treated >= 1 AND controls >= 1"""


def naive_uplift(t: Tables) -> DataFrame:
    from tidemark.models.uplift import naive_uplift as op

    panel = conv.build_conversion_panel(t, AS_OF, CFG, uplift=True)
    return op(panel, conv.SEGMENT_FLAGS, "label_conv_14d", min_arm=1)


query("uplift_naive_by_segment", "M-16 A-13", naive_sql())(naive_uplift)


def qini_sql() -> str:
    from tidemark.catalog import panels as pn

    return f"""{pn.INDEX}, {pn.BOTH}, {pn.CANDIDATES}, s AS ({pn.SAMPLED.format(drop='')}),
e AS (SELECT treatment, label_conv_14d AS y, sample_weight AS w, {" + ".join(conv.SEGMENT_FLAGS)} + (user_id % 5) / 10::DOUBLE AS effect FROM s),
g AS (SELECT effect, SUM(w * treatment) AS nt, SUM(w * (1 - treatment)) AS nc, SUM(w * y * treatment) AS yt, SUM(w * y * (1 - treatment)) AS yc FROM e GROUP BY effect),
c AS (SELECT effect, SUM(nt) OVER o AS nt, SUM(nc) OVER o AS nc, SUM(yt) OVER o AS yt, SUM(yc) OVER o AS yc FROM g WINDOW o AS (ORDER BY effect DESC)),
p AS (SELECT effect, (nt + nc) / MAX(nt + nc) OVER () AS x, yt - CASE WHEN nc > 0 THEN yc * nt / nc ELSE 0 END AS q,
  (CASE WHEN nt > 0 THEN yt / nt ELSE 0 END - CASE WHEN nc > 0 THEN yc / nc ELSE 0 END) * (nt + nc) AS u FROM c),
l AS (SELECT *, LAG(x, 1, 0) OVER o AS x0, LAG(q, 1, 0) OVER o AS q0, LAG(u, 1, 0) OVER o AS u0 FROM p WINDOW o AS (ORDER BY effect DESC))
SELECT ROUND(SUM((x - x0) * (q + q0) / 2) - arg_min(q, effect) / 2, 9) AS qini, ROUND(SUM((x - x0) * (u + u0) / 2) - arg_min(u, effect) / 2, 9) AS auuc,
  ROUND(arg_min(q, effect), 9) AS qini_all FROM l"""


@query("uplift_qini", "M-16", qini_sql())
def uplift_qini(t: Tables) -> DataFrame:
    """Do rows that carry more segment flags respond more to a send? Areas of the cumulative curves over the uplift panel."""
    panel = conv.build_conversion_panel(t, AS_OF, CFG, uplift=True)
    effect = sum((C(c) for c in conv.SEGMENT_FLAGS), F.lit(0)) + (C("user_id") % 5) / 10
    found = qini(panel.withColumn("effect", effect), "effect", "label_conv_14d", "treatment", "sample_weight")
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])
