from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.functions import ranking as rk
from tidemark.functions import stats as s


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        score = 0.0 if rng.random() < 0.4 else round(rng.lognormvariate(0, 3), rng.choice([0, 3]))
        score = -score if rng.random() < 0.05 else score
        y = int(rng.random() < (0.7 if score > 2 else 0.3))
        rows.append((i, score, y, rng.choice([1.0, 4.0]), float(round(max(score, 0) * rng.random(), 2)), i % 3))
    df = spark.createDataFrame(rows, "id long, score double, y int, w double, value double, g int").cache()
    return df, pd.DataFrame(rows, columns=["id", "score", "y", "w", "value", "g"])


def test_global_rows_match_a_sort(data):
    df, pdf = data
    got = rk.global_rows(df, "score", "id", sums={"w": "w"}, descending=True).toPandas().set_index("id")
    want = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
    want["row_no"] = want.index + 1
    want["upto"] = want.w.cumsum()
    want = want.set_index("id")
    joined = got.join(want[["row_no", "upto"]], rsuffix="_want")
    assert (joined.row_no == joined.row_no_want).all()
    assert np.allclose(joined.w_upto, joined.upto)
    assert set(got.rows_total) == {len(pdf)} and np.allclose(got.w_total, pdf.w.sum())


def test_global_rows_by_group(data):
    df, pdf = data
    got = rk.global_rows(df, "score", "id", by=["g"]).toPandas()
    want = pdf.sort_values(["score", "id"]).groupby("g").cumcount() + 1
    assert (got.set_index("id").row_no.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("n", [2, 9, 10, 57, 400])
def test_quantile_bins_match_pandas(spark, n):
    rng = random.Random(n)
    pdf = pd.DataFrame({"id": range(n), "v": [round(rng.random(), 1) for _ in range(n)]})
    got = rk.quantile_bin(spark.createDataFrame(pdf), "v", "id").toPandas().set_index("id").bin.sort_index()
    want = pd.qcut(pdf.v.rank(method="first"), 10, labels=False) + 1
    assert (got.to_numpy() == want.to_numpy()).all()


def test_average_ranks(data):
    df, pdf = data
    got = rk.average_ranks(rk.value_counts(df, "score"), "score").toPandas().set_index("score").avg_rank
    want = pdf.assign(r=pdf.score.rank()).groupby("score").r.first()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_spearman_and_all(data):
    df, pdf = data
    got = s.spearman(df, "score", "value").first()[0]
    want = pdf[["score", "value"]].corr(method="spearman").iloc[0, 1]
    assert got == pytest.approx(want, abs=1e-9)
    top = [r.feature for r in s.spearman_all(df, ["score", "w", "id"], "value", 2).collect()]
    want = pdf[["score", "w", "id", "value"]].corr(method="spearman").value.drop("value").abs().sort_values(ascending=False)
    assert top == list(want.index[:2])


def test_distribution_statistics(data):
    df, pdf = data
    y = np.sort(pdf.value.to_numpy())
    n = len(y)
    assert s.gini(df, "value").first()[0] == pytest.approx((2 * np.arange(1, n + 1) - n - 1).dot(y) / (n * y.sum()))
    assert s.top_share(df, "value").first()[0] == pytest.approx(y[::-1][: n // 10].sum() / y.sum())
    got = {r.pct: r.value for r in s.percentiles(df, "value", [0, 37, 50, 99.5, 100]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(y, p))
    assert s.quantile_lower(df, "id", 0.8).first()[0] == pdf.id.quantile(0.8, interpolation="lower")


def test_gini_of_nothing(spark):
    assert s.gini(spark.createDataFrame([(0.0,), (0.0,)], "v double"), "v").first()[0] == 0.0


def _auc(y, score, w):
    pos, neg = [(s_, w_) for s_, w_, l in zip(score, w, y) if l], [(s_, w_) for s_, w_, l in zip(score, w, y) if not l]
    won = sum(wp * wn * ((sp > sn) + 0.5 * (sp == sn)) for sp, wp in pos for sn, wn in neg)
    return won / (sum(p[1] for p in pos) * sum(n[1] for n in neg))


def test_curve_metrics_by_definition(spark, data):
    _, pdf = data
    part = pdf.head(300)
    df = spark.createDataFrame(part)
    want = _auc(part.y, part.score, part.w)
    order = np.argsort(-part.score.to_numpy(), kind="stable")
    ap, tp, seen, pos = 0.0, 0.0, 0.0, (part.y * part.w).sum()
    grouped = part.iloc[order].groupby("score", sort=False)
    for _, g in grouped:
        gained = (g.y * g.w).sum()
        tp, seen = tp + gained, seen + g.w.sum()
        ap += gained / pos * tp / seen
    assert m.roc_auc(df, "y", "score", "w").first()[0] == pytest.approx(want)
    assert m.avg_precision(df, "y", "score", "w").first()[0] == pytest.approx(ap)
    both = m.curve_metrics(df, "y", "score", "w").first()
    assert (both.roc_auc, both.avg_precision) == (pytest.approx(want), pytest.approx(ap))


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.4)], "id long, y int, p double")
    assert m.roc_auc(df, "y", "p").first()[0] is None


def test_top_metrics_by_definition(spark, data):
    df, pdf = data
    ranked = pdf.sort_values(["score", "id"], ascending=[False, True])
    w, y = ranked.w.to_numpy(), ranked.y.to_numpy()
    cum = np.cumsum(w)
    k = max(np.searchsorted(cum, cum[-1] * 5 / 100.0), 1)
    lift = np.average(y[:k], weights=w[:k]) / np.average(y, weights=w)
    top = max(int(len(y) * 0.1), 1)
    got = m.top_metrics(df, "y", "score", "id", (5,), "w").first()
    assert got.lift_5 == pytest.approx(lift)
    assert got.precision == pytest.approx(y[:top].mean()) and got.recall == pytest.approx(y[:top].sum() / y.sum())
    assert m.lift_at(df, "y", "score", "id", 5, "w").first()[0] == pytest.approx(lift)
    want = ranked.value.to_numpy()[:top].sum() / pdf.value.sum()
    assert m.capture(df, "value", "score", "id", 10).first()[0] == pytest.approx(want)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.95), (0, 0.1)], "y int, p double")
    bins = {r.bin: (r.mean_y, r.mean_p) for r in m.calibration_bins(df, "y", "p", 10).collect()}
    assert set(bins) == {0, 1, 9} and bins[9] == (1.0, pytest.approx(0.975))
    assert m.ece(df, "y", "p", 10).first()[0] == pytest.approx((2 * 0.025 + 0 + 0.1) / 4)
    assert m.brier(df, "y", "p").first()[0] == pytest.approx((0.0025 + 0.01) / 4)


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k long, x long")
    right = spark.createDataFrame([(i, i * 10) for i in range(0, 300, 3)], "k long, z long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, rk.salted_join(left, right, ["k"], ["x"]).collect())) == want
    with pytest.raises(ValueError):
        rk.salted_join(left, right, ["k"], ["x"], salts=12)


def test_no_plan_sorts_rows_in_one_partition(data):
    """Only totals of ranges may meet in one partition, never the rows themselves; the stored ranges are read."""
    df, _ = data
    ranked = rk.global_rows(df, "score", "id")
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    for block in plan.split("Exchange SinglePartition")[1:]:
        assert "_t_rows" in block[:600]
    assert "InMemoryTableScan" not in plan  # the cached input is not read again


def test_odd_scores_keep_their_rows(spark):
    nan, inf = float("nan"), float("inf")
    scores = [None, 1.0, nan, -inf, inf, None, 0.5, nan]
    df = spark.createDataFrame([(i, v, "a" if i % 2 else None, 1.0) for i, v in enumerate(scores)], "id long, score double, g string, w double")
    got = {r.id: r for r in rk.global_rows(df, "score", "id", sums={"w": "w"}).collect()}
    assert [got[i].row_no for i in range(8)] == [None, 3, 5, 1, 4, None, 2, 6]
    assert got[0].rows_total is None and got[1].rows_total == 6 and got[7].w_upto == 6.0 and got[5].w_upto is None
    bins = {r.id: r.bin for r in rk.quantile_bin(df, "score", "id", 2).collect()}
    assert bins == {0: None, 1: 1, 2: 2, 3: 1, 4: 2, 5: None, 6: 1, 7: 2}
    grouped = {r.id: r.row_no for r in rk.global_rows(df, "score", "id", by=["g"], descending=True).collect()}
    assert grouped == {0: None, 2: 1, 4: 2, 6: 3, 1: 2, 3: 3, 5: None, 7: 1}
    assert {r.id for r in rk.top_fraction(df, "score", "id", 34).collect()} == {2, 7}


def test_narrow_and_tied_scores_are_dealt_evenly(spark):
    """Neither a band of close values nor one value of a third of all rows fills one range."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, 0.4711).otherwise(0.47 + F.col("id") * 1e-7).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        ranges = rk._ranges(df.repartition(4), "score", [], ["id"], False)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in ranges.groupBy("_range").count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes) and len(sizes) > 1
    last = rk.global_rows(df, "score", "id").orderBy(F.desc("row_no")).first()
    assert last.row_no == last.rows_total == 40_000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=0, max_size=12))
def test_upper_median(spark, gaps):
    positive = sorted(g for g in gaps if g > 0)
    df = spark.createDataFrame([(positive, len(gaps) - len(positive))], "a array<int>, z int")
    got = df.select(s.upper_median(F.col("a"), F.col("z"))).first()[0]
    assert got == (sorted(gaps)[len(gaps) // 2] if gaps else None)


def test_drop_constant_and_collapse(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (2, "a", None, None), (3, "b", None, 5)], "x int, c string, n int, h int")
    assert s.drop_constant(df, keep=["n"]).columns == ["x", "c", "n", "h"]
    assert s.drop_constant(df).columns == ["x", "c", "h"]
    assert sorted(r.c for r in s.collapse_rare(df, "c", 1).collect()) == ["a", "a", "other"]
