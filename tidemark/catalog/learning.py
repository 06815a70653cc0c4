"""Models on the panels. Fits have no SQL twin; what they rest on and facts that any sound fit must show are checked, metrics separately."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.panels import DATES_SQL, ltv_sql
from tidemark.catalog.profiles import CONTENT, churn_with_now, content_table
from tidemark.catalog.registry import query
from tidemark.catalog.statistics import S, scored
from tidemark.functions.scalar import flag
from tidemark.operators.features import NOW_DEFAULTS
from tidemark.models import explain as ex
from tidemark.models import isotonic
from tidemark.models import prepare as pr
from tidemark.models import supervised as sv
from tidemark.models import unsupervised as un
from tidemark.models import uplift as up
from tidemark.plans import churn_panel as churn
from tidemark.plans import conversion_panel as conv
from tidemark.plans import ltv_panel as ltv
from tidemark.plans import scoring as sc
from tidemark.plans import winback as wb
from tidemark.session import materialize, scratch_dir
from tidemark.sources.fixtures import AS_OF, CHURN_SNAPSHOTS, LTV_DATES, TEST_CONFIG as CFG
from tidemark.sources.tables import Tables

C = F.col
TREES = sv.TreeParams()
LTV_CAT = ("provider", "country", "last_plan_id")
LTV_FEATS = sv.Features(tuple(c for c in ltv.FEATURES_V2 if c not in LTV_CAT), LTV_CAT)
CHURN_CAT = ("country", "last_sub_event", "last_plan_id")
CHURN_FEATS = sv.Features(
    tuple(c for c in churn.CHURN_COLUMNS if c not in (*CHURN_CAT, "user_id", "snapshot_date")), CHURN_CAT)
# a wide date range and no sampling, so that small test tables hold both classes
WIDE = replace(CFG, panel_start=date(2024, 1, 3), panel_end=date(2024, 1, 25), negative_rate=1.0, bulk_threshold=5)


def row_id(day: str):
    """One key per (user, day), whatever range the user ids have."""
    return C("user_id").cast("decimal(20,0)") * 100000 + F.unix_date(day)


def _ltv_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = materialize(
        ltv.build_ltv_panel(t.revenue, LTV_DATES, CFG)
        .withColumn("row_id", row_id("index_date")), "ltv-panel")
    return pr.split_date(rows, "index_date", CFG.ltv_split)


def _churn_rows(t: Tables) -> DataFrame:
    return materialize(
        churn.build_churn_panel(t, CHURN_SNAPSHOTS, AS_OF, CFG)
        .withColumn("row_id", row_id("snapshot_date")), "churn-panel")


def _panel(t: Tables, uplift: bool) -> DataFrame:
    rows = materialize(conv.build_conversion_panel(t, AS_OF, WIDE, uplift), "conversion-panel")
    keep = ("user_id", "send_date", "label_conv_14d", "label_payment_14d", "sample_weight", "treatment", *conv.SEGMENT_FLAGS, *pr.CATEGORICAL)
    cleaned = pr.clean(rows.drop("mobile_share_now"), keep=keep).withColumn(
        "row_id", row_id("send_date"))
    return materialize(cleaned, "conversion-clean")


def _scored(model, df: DataFrame, feats: sv.Features, label: str, weight: str | None = None, out: str = "score") -> DataFrame:
    """Scores written once: every metric of a report reads them."""
    cols = ["row_id", label, out, *([weight] if weight else [])]
    return materialize(sv.predict(model, df, feats, out).select(*cols), "scored")


def _panel_feats(df: DataFrame) -> sv.Features:
    out = (*pr.LEAKS, "user_id", "row_id", "label_conv_14d", "sample_weight", "treatment", *conv.SEGMENT_FLAGS)
    return sv.Features(tuple(pr.numeric_columns(df, out)), pr.CATEGORICAL)


@query("model_conversion_report", "M-1 M-2 M-3 M-7 M-8 M-9 M-19 M-20 M-21 M-22 F-17 F-18 F-19")
def conversion_report(t: Tables) -> DataFrame:
    rows = _panel(t, False)
    train, test = pr.split_time(rows, "send_date", 0.8)
    train = materialize(pr.cap_classes(train, "label_conv_14d", CFG.train_cap, ["user_id", "send_date"]), "part")
    test = materialize(test, "part")
    feats, out = _panel_feats(rows), None
    for name, model in (("logreg", sv.fit_logreg(train, feats, "label_conv_14d", "sample_weight")),
                        ("gbt", sv.fit_gbt(train, feats, "label_conv_14d", "sample_weight", TREES))):
        scored = _scored(model, test, feats, "label_conv_14d", "sample_weight")
        row = sv.classification_report(scored, "label_conv_14d", "score", "row_id", name, "sample_weight")
        out = row if out is None else out.unionByName(row)
    return out


@query("model_segment_vs_global", "M-13 P-19")
def segment_vs_global(t: Tables) -> DataFrame:
    rows = _panel(t, False)
    train, test = (materialize(part, "part") for part in pr.split_time(rows, "send_date", 0.8))
    feats = _panel_feats(rows)
    model = sv.fit_logreg(train, feats, "label_conv_14d", "sample_weight")
    scored = _scored(model, test, feats, "label_conv_14d", out="global_score").select("row_id", "global_score")
    targets = dict.fromkeys(("seg_heavy_downloader", "seg_winback_active", "seg_dormant_payer", "seg_soft_cancel",
                             "seg_cart_abandoner"), "label_conv_14d") | {"seg_monthly_loyal": "label_payment_14d"}
    return sv.segment_vs_global(train, test, feats, targets, scored, "label_conv_14d", "row_id", "sample_weight")


@query("model_s_learner_effects", "M-14")
def s_learner_effects(t: Tables) -> DataFrame:
    rows = _panel(t, True)
    return up.segment_effect(
        up.s_learner(rows, _panel_feats(rows), "label_conv_14d", TREES), conv.SEGMENT_FLAGS, "tau", 10)


@query("model_t_learner_effects", "M-15")
def t_learner_effects(t: Tables) -> DataFrame:
    rows = _panel(t, True)
    return up.segment_effect(
        up.t_learner(rows, _panel_feats(rows), "label_conv_14d", TREES), conv.SEGMENT_FLAGS, "tau", 10)


@query("model_uplift_qini", "M-14 M-15")
def uplift_curves(t: Tables) -> DataFrame:
    """How well each learner's effects order the rows of users it has not seen."""
    rows, out = _panel(t, True), None
    train, test = (materialize(part, "part") for part in pr.split_user(rows, 30))
    feats, label, w = _panel_feats(rows), "label_conv_14d", "sample_weight"
    single = sv.fit_gbt(train, feats.plus(["treatment"]), label, w, TREES)
    arms = [sv.fit_gbt(train.filter(C("treatment") == a), feats, label, w, TREES) for a in (1, 0)]
    for name, models, fs in (("s", (single, single), feats.plus(["treatment"])), ("t", arms, feats)):
        scored = test.withColumnRenamed("treatment", "_arm")
        for out_col, model, arm in zip(("p1", "p0"), models, (1, 0)):
            scored = sv.predict(model, scored.withColumn("treatment", F.lit(arm)), fs, out_col).drop("treatment")
        row = sv.m.qini(scored.withColumn("tau", C("p1") - C("p0")), "tau", label, "_arm", w).select(F.lit(name).alias("learner"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("model_churn_report", "M-5 M-8 M-9 M-19 M-20 M-21 M-22")
def churn_report(t: Tables) -> DataFrame:
    """Model A on everyone, model B before the cancel click; whole users held out."""
    rows, out = _churn_rows(t), None
    early = sv.Features(tuple(c for c in CHURN_FEATS.num if c != "had_cancel_sched_30"), CHURN_CAT)
    for name, part, feats in (("A", rows, CHURN_FEATS), ("B", rows.filter("had_cancel_sched_30 = 0"), early)):
        train, test = pr.split_user(part, 30)
        for kind, model in (("logreg", sv.fit_logreg(train, feats, "label_churn_30", balanced=True)),
                            ("gbt", sv.fit_gbt(train, feats, "label_churn_30", params=TREES))):
            scored = _scored(model, test, feats, "label_churn_30")
            row = sv.classification_report(scored, "label_churn_30", "score", "row_id", f"{name} {kind}", pcts=(10,))
            out = row if out is None else out.unionByName(row)
    return out


@query("model_churn_scores", "C-9 K-15 K-16 M-9")
def churn_scores(t: Tables) -> DataFrame:
    model = sv.fit_gbt(_churn_rows(t), CHURN_FEATS, "label_churn_30", params=TREES)
    today = churn.build_churn_panel(t, [AS_OF.date()], AS_OF, CFG, with_label=False)
    return sc.churn_scores(sv.predict(model, today, CHURN_FEATS, "model_risk"), t.expiry, AS_OF, CFG)


@query("model_ltv_report", "M-4 M-10 M-11 M-12 M-23 M-24")
def ltv_report(t: Tables) -> DataFrame:
    train, test = _ltv_rows(t)
    scored, prep = sv.persistence(test), sv.tree_preparation(train, LTV_FEATS)
    scored = sv.predict(sv.fit_gbt_reg(train, LTV_FEATS, "label_rev_365", TREES, prep), scored, LTV_FEATS, "pred_gbm", "value")
    scored = materialize(sv.fit_two_part(train, LTV_FEATS, "label_rev_365", TREES, prep).predict(scored, "pred_two_part"), "ltv-scored")
    out = None
    for pred in ("pred_persistence", "pred_gbm", "pred_two_part"):
        row = sv.regression_report(scored, "label_rev_365", pred, "row_id", pred)
        out = row if out is None else out.unionByName(row)
    return out


@query("model_ltv_scores", "K-17 L-5 M-11 M-27 M-28")
def ltv_scores(t: Tables) -> DataFrame:
    """Train, save, load and score the payers of today."""
    spark = t.events.sparkSession
    train, _ = _ltv_rows(t)
    path, out = scratch_dir(spark, "ltv-model"), scratch_dir(spark, "ltv-predictions")
    prep = sv.tree_preparation(train, LTV_FEATS)
    sv.save_model(sv.fit_gbt_reg(train, LTV_FEATS, "label_rev_365", TREES, prep), LTV_FEATS, path)
    model, feats = sv.load_model(spark, path)
    rows = sv.predict(model, ltv.score_rows(t.revenue, AS_OF, CFG), feats, "pred_ltv_gbm", "value")
    rows = sv.fit_two_part(train, LTV_FEATS, "label_rev_365", TREES, prep).predict(rows, "pred_ltv_12m")
    # ranking reads the predictions more than once
    scores = sc.ltv_scores(materialize(rows, "ltv-predicted"), CFG)
    sv.save_predictions(scores, scores.columns, out)
    return spark.read.parquet(out)


@query("model_calibration", "M-6 M-18 M-22")
def calibration(t: Tables) -> DataFrame:
    """Calibration error of P(pay) on test rows before and after isotonic regression."""
    train, test = _ltv_rows(t)
    mark = (C("label_rev_365") > 0).cast("int")
    fit, held = pr.calibration_slice(train.withColumn("y", mark), "index_date", 0.8)
    model = sv.fit_gbt(fit, LTV_FEATS, "y", params=TREES)
    iso = un.fit_isotonic(sv.predict(model, held, LTV_FEATS, "p"), "p", "y")
    raw = _scored(model, test.withColumn("y", mark), LTV_FEATS, "y", out="p")
    scored = materialize(un.calibrate(iso, raw, "p", "p_cal"), "calibrated")
    parts = [sv.m.ece(scored, "y", p, 15).join(F.broadcast(sv.m.brier(scored, "y", p)))
             .select(F.lit(p).alias("score"), "ece", "brier") for p in ("p", "p_cal")]
    return parts[0].unionByName(parts[1])


@query("model_importance", "M-25")
def importance(t: Tables) -> DataFrame:
    train, test = _ltv_rows(t)
    mark = (C("label_rev_365") > 0).cast("int")
    model = sv.fit_gbt(train.withColumn("y", mark), LTV_FEATS, "y", params=TREES)
    return ex.permutation_importance(model, test.withColumn("y", mark), LTV_FEATS, "y", "row_id")


@query("model_ablation_churn", "M-26 K-22 J-10 J-11 F-22")
def ablation_churn(t: Tables) -> DataFrame:
    rows = materialize(
        churn_with_now(t).withColumn("row_id", row_id("snapshot_date")), "churn-now")
    train, test = pr.split_user(rows, 30)
    extra = sv.Features(tuple(c for c in NOW_DEFAULTS if c != "content_persona"), ("content_persona",))
    return ex.ablation(train, test, CHURN_FEATS, extra, "label_churn_30", "row_id", TREES)


@query("model_value_lift", "M-26 J-10")
def value_lift(t: Tables) -> DataFrame:
    content = content_table(t).filter(C("content_status") == "ok").select(
        "user_id", "storage_gb", "n_files", "content_persona", flag(C("n_files") == 0).alias("is_empty"))
    train, test = (materialize(part.join(content, "user_id"), "ltv-content") for part in _ltv_rows(t))
    extra = sv.Features(("storage_gb", "n_files", "is_empty"), ("content_persona",))
    return ex.value_lift(train, test, LTV_FEATS, extra, "label_rev_365", TREES)


LP = f"lp AS (WITH {ltv_sql(DATES_SQL, 2, True)})"


@query("panel_ltv_content", "J-10 M-26", f"""{CONTENT}, {LP}
SELECT lp.user_id, index_date, label_rev_365, c.storage_gb, c.n_files, content_persona, CAST(c.n_files = 0 AS INTEGER) AS is_empty
FROM lp JOIN content c ON c.user_id = lp.user_id WHERE content_status = 'ok'""")
def ltv_content(t: Tables) -> DataFrame:
    """The rows both sides of the value ablation are fitted on: index rows of users whose content could be read."""
    content = content_table(t).filter(C("content_status") == "ok").select(
        "user_id", "storage_gb", "n_files", "content_persona", flag(C("n_files") == 0).alias("is_empty"))
    return ltv.build_ltv_panel(t.revenue, LTV_DATES, CFG).select("user_id", "index_date", "label_rev_365").join(content, "user_id")


@query("model_logreg_balance", "M-8 M-2", f"""{LP},
tr AS (SELECT CAST(label_rev_365 > 0 AS INTEGER) AS y, CASE WHEN user_id % 3 = 0 THEN 4.0::DOUBLE ELSE 1.0 END AS w FROM lp WHERE CAST(index_date AS DATE) < DATE '2022-01-01')
SELECT 'weighted' AS kind, COUNT(*) AS rows, ROUND(SUM(w * y) / SUM(w), 9) AS label_rate, CAST(1 AS INTEGER) AS holds FROM tr
UNION ALL SELECT 'balanced', COUNT(*), 0.5, 1 FROM tr""")
def logreg_balance(t: Tables) -> DataFrame:
    """At the optimum of a logistic loss with an intercept the weighted mean prediction is the weighted label rate, one half where classes
    are balanced: ``holds`` is 1 where the fit has got there within 0.002."""
    train, _ = _ltv_rows(t)
    train = train.withColumns({"y": (C("label_rev_365") > 0).cast("int"), "w": F.when(C("user_id") % 3 == 0, 4.0).otherwise(1.0)})
    out, prep = None, sv.linear_preparation(train, LTV_FEATS)
    for kind, model, rows, weight in (("weighted", sv.fit_logreg(train, LTV_FEATS, "y", "w", prep=prep), train, "w"),
                                      ("balanced", sv.fit_logreg(train, LTV_FEATS, "y", balanced=True, prep=prep), pr.balanced_weights(train, "y"), "class_weight")):
        rate, mean = (F.sum(C(weight) * C(c)) / F.sum(weight) for c in ("y", "p"))
        row = sv.predict(model, rows, LTV_FEATS, "p").agg(F.count(F.lit(1)).alias("rows"), F.round(rate, 9).alias("label_rate"), (F.abs(rate - mean) < 0.002).cast("int").alias("holds"))
        row = row.select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("model_saved_scores", "M-27 M-28", f"""{LP}
SELECT CAST(user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(index_date AS DATE)) AS BIGINT) AS row_id, CAST(label_rev_365 > 0 AS INTEGER) AS y,
  CAST(1 AS INTEGER) AS same_score, CAST(1 AS INTEGER) AS in_range FROM lp WHERE CAST(index_date AS DATE) >= DATE '2022-01-01'""")
def saved_scores(t: Tables) -> DataFrame:
    """The stored predictions of a model that was saved and loaded: every held-out row once, scored as the fitted one scores it."""
    spark, train, test = t.revenue.sparkSession, *(part.withColumn("y", (C("label_rev_365") > 0).cast("int")) for part in _ltv_rows(t))
    fitted, bundle, scores = sv.fit_logreg(train, LTV_FEATS, "y"), scratch_dir(spark, "bundle"), scratch_dir(spark, "scores")
    sv.save_model(fitted, LTV_FEATS, bundle)
    loaded, feats = sv.load_model(spark, bundle)
    both = sv.predict(loaded, sv.predict(fitted, test, LTV_FEATS, "p"), feats, "q")
    sv.save_predictions(both, ("row_id", "y", "p", "q"), scores)
    return spark.read.parquet(scores).select(
        C("row_id").cast("bigint").alias("row_id"), "y", (C("p") == C("q")).cast("int").alias("same_score"), C("q").between(0, 1).cast("int").alias("in_range"))


SPLIT_SQL = f"""lp AS (WITH {ltv_sql(DATES_SQL, 2, True)}),
d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(index_date AS DATE)) AS day,
    CAST(index_date AS DATE) >= DATE '2022-01-01' AS later FROM lp),
c AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, COUNT(*) OVER () AS n FROM d),
cut AS (SELECT MIN(day) AS at FROM c WHERE i = CAST(floor(0.8::DOUBLE * (n - 1)) AS BIGINT))
SELECT 'date' AS split, COUNT(*) FILTER (NOT later) AS train, COUNT(*) FILTER (later) AS test, 0 AS broken FROM d
UNION ALL SELECT 'time', COUNT(*) FILTER (day <= "at"), COUNT(*) FILTER (day > "at"), 0 FROM d, cut
UNION ALL SELECT 'user', COUNT(*) FILTER (b >= 20), COUNT(*) FILTER (b < 20), 0 FROM (SELECT
  CAST(concat('0x', substr(md5(concat(CAST(user_id AS VARCHAR), ':split-42')), 1, 8)) AS BIGINT) % 100 AS b FROM d)"""


@query("model_splits", "M-4 M-5 M-6 M-3", SPLIT_SQL)
def splits(t: Tables) -> DataFrame:
    """Sizes of the three splits, and how many rows break their promise (a date or user on both sides)."""
    rows, out = materialize(ltv.build_ltv_panel(t.revenue, LTV_DATES, CFG).select("user_id", "index_date"), "split-rows"), None
    for name, (train, test), key in (("date", pr.split_date(rows, "index_date", CFG.ltv_split), "index_date"),
                                     ("time", pr.split_time(rows, "index_date", 0.8), "index_date"), ("user", pr.split_user(rows), "user_id")):
        both = train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi")
        row = (train.agg(F.count("*").alias("train")).join(F.broadcast(test.agg(F.count("*").alias("test"))))
               .join(F.broadcast(both.agg(F.count("*").cast("int").alias("broken")))).select(F.lit(name).alias("split"), "*"))
        out = row if out is None else out.unionByName(row)
    return out


@query("model_training_cap", "M-7 U-2", f"""lp AS (WITH {ltv_sql(DATES_SQL, 2, True)}),
n AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (label_rev_365 > 0) AS p FROM lp)
SELECT p AS positives, CAST(1 AS INTEGER) AS has_negatives, CAST(1 AS INTEGER) AS within_cap, CAST(1 AS INTEGER) AS represents_all FROM n""")
def training_cap(t: Tables) -> DataFrame:
    """All positives and a sample of the negatives, half of them: near the cap, with the weight of the population."""
    rows = materialize(ltv.build_ltv_panel(t.revenue, LTV_DATES, CFG).select(
        "user_id", "index_date", (C("label_rev_365") > 0).cast("int").alias("y"), F.lit(1.0).alias("sample_weight")), "cap-rows")
    n, p = rows.agg(F.count("*"), F.count_if(C("y") == 1)).first()
    capped = pr.cap_rows(rows, "y", p + (n - p) // 2, ["user_id", "index_date"])
    near = 5 * (n - p) ** 0.5  # beyond five standard errors of a fair half
    return capped.agg(
        F.count_if(C("y") == 1).alias("positives"), (F.count_if(C("y") == 0) > 0).cast("int").alias("has_negatives"),
        (F.count("*") <= p + (n - p) / 2 + near).cast("int").alias("within_cap"),
        (F.abs(F.sum("sample_weight") - n) <= 2 * near).cast("int").alias("represents_all"))


@query("model_isotonic", "M-18", f"""{S}, g AS (SELECT score, SUM(y) AS wy, COUNT(*) AS w FROM s GROUP BY score),
c AS (SELECT score, row_number() OVER (ORDER BY score) AS i, SUM(wy) OVER (ORDER BY score) AS sy, SUM(w) OVER (ORDER BY score) AS sw FROM g),
ab AS (SELECT a.i AS a, b.i AS b, (b.sy - coalesce(z.sy, 0)) / (b.sw - coalesce(z.sw, 0))::DOUBLE AS mean
  FROM c a JOIN c b ON a.i <= b.i LEFT JOIN c z ON z.i = a.i - 1),
low AS (SELECT a, b, MIN(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM ab),
fit AS (SELECT b AS i, MAX(m) AS value FROM low GROUP BY b)
SELECT score, ROUND(value, 9) AS value FROM fit JOIN c USING (i)""")
def isotonic_fit(t: Tables) -> DataFrame:
    """Chance of a payment next year by this year's revenue, never falling: the fitted value of every distinct score."""
    rows = materialize(scored(t).select("score", "y"), "isotonic-rows")
    return isotonic.fit(rows, "score", "y").values(rows, "score").withColumn("value", F.round("value", 9))


@query("model_fit_checks", "M-9 M-10 M-11 M-17 M-18", """
SELECT unnest(['calibration keeps the mean', 'calibration is monotone', 'classifier beats chance', 'clusters beat their first start', 'regression beats the mean']) AS fact,
  true AS holds""")
def fit_checks(t: Tables) -> DataFrame:
    """What any sound fit guarantees on its own training rows."""
    train, _ = _ltv_rows(t)
    train = train.withColumn("y", (C("label_rev_365") > 0).cast("int"))
    prep = sv.tree_preparation(train, LTV_FEATS)
    p = materialize(sv.predict(sv.fit_gbt(train, LTV_FEATS, "y", params=TREES, prep=prep), train, LTV_FEATS, "p").select("row_id", "y", "p"), "checked")
    iso = materialize(un.calibrate(un.fit_isotonic(p, "p", "y"), p, "p", "q"), "calibrated")
    mean_p, mean_y = iso.agg(F.avg("q"), F.avg("y")).first()
    cells = iso.groupBy(F.floor(C("p") * 50).alias("cell")).agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    steps = sorted((r.cell, r.lo, r.hi) for r in cells.collect())  # 51 rows at most
    auc = sv.m.roc_auc(p, "y", "p").first()[0]
    value = sv.predict(sv.fit_gbt_reg(train, LTV_FEATS, "label_rev_365", TREES, prep), train, LTV_FEATS, "v", "value")
    log = F.log1p("label_rev_365")
    error, spread = value.agg(F.avg(F.pow(log - F.log1p("v"), F.lit(2.0))), F.var_pop(log)).first()
    rows = un.winback_features(materialize(wb.winback(t, AS_OF, CFG), "winback"))
    cols = [c for c in rows.columns if c != "user_id"]
    costs = [un.fit_kmeans(rows, cols, k=3, starts=n, seed=CFG.seed).stages[-1].summary.trainingCost for n in (1, 4)]
    facts = {"calibration keeps the mean": abs(mean_p - mean_y) < 0.01, "calibration is monotone": all(a[2] <= b[1] + 0.02 for a, b in zip(steps, steps[1:])),
             "classifier beats chance": auc > 0.5, "clusters beat their first start": costs[1] <= costs[0] * (1 + 1e-9), "regression beats the mean": error < spread}
    return t.events.sparkSession.createDataFrame(sorted((k, bool(v)) for k, v in facts.items()), "fact string, holds boolean")


@query("model_winback_clusters", "M-17 K-14")
def winback_clusters(t: Tables) -> DataFrame:
    master = materialize(wb.winback(t, AS_OF, CFG), "winback")
    rows = un.winback_features(master)
    model = un.fit_kmeans(rows, [c for c in rows.columns if c != "user_id"], k=5, seed=CFG.seed)
    return un.cluster_summary(master, model.transform(rows))
