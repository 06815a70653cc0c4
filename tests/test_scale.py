"""Work that must not grow faster than the input: what is stored, dealt and scored, beside brute-force results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.functions import stats as st
from tidemark.models import explain as ex
from tidemark.models import supervised as sv

FEATS = sv.Features(("x", "noise"), ("c",))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(600):
        gap = [None, float("nan"), -0.0, 0.0, rng.random()][i % 5]
        out.append((i, rng.randrange(4) * 1.0, rng.random(), gap, [None, float("nan"), 0.0][i % 90] if i % 90 < 3 else round(rng.random(), 1), 7.0, "ab"[i % 2], int(rng.random() < 0.5)))
    return out


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, "row_id long, x double, noise double, gap double, t double, same double, c string, y int")


def ranks(values):
    return [sum(b < a for b in values) + (sum(b == a for b in values) + 1) / 2 for a in values]


def correlation(pairs):
    a, b = (ranks(v) for v in zip(*pairs))
    mid = (len(a) + 1) / 2
    own = [sum((p - mid) ** 2 for p in v) for v in (a, b)]
    return sum((p - mid) * (q - mid) for p, q in zip(a, b)) / (own[0] * own[1]) ** 0.5 if own[0] * own[1] else None


def known(rows, *at):
    return [tuple(r[k] for k in at) for r in rows if all(r[k] is not None and r[k] == r[k] for k in at)]


def test_rank_correlations_join_the_target_once(data, rows, monkeypatch):
    stored, write = [], st.materialize
    monkeypatch.setattr(st, "materialize", lambda df, name: stored.append(name) or write(df, name))
    got = {r.feature: r.abs_spearman for r in st.spearman_all(data, ["x", "noise", "same"], "t").collect()}
    assert "joint" not in stored  # pairs of every feature with the target
    want = {n: correlation(known(rows, k, 4)) for n, k in (("x", 1), ("noise", 2), ("same", 5), ("gap", 3))}
    assert got["same"] is want["same"] is None and all(got[n] == pytest.approx(abs(want[n])) for n in ("x", "noise"))
    got = {r.feature: r.abs_spearman for r in st.spearman_all(data, ["x", "gap"], "t").collect()}
    assert all(got[n] == pytest.approx(abs(want[n])) for n in ("x", "gap"))


def test_rank_correlation_by_group(data, rows):
    got = {r.c: r.spearman for r in st.spearman(data, "gap", "t", ["c"]).collect()}
    assert got == {c: pytest.approx(correlation(known([r for r in rows if r[6] == c], 3, 4))) for c in "ab"}


def test_captures_order_the_rows_once(data, monkeypatch):
    calls, order = [], m.global_rows
    monkeypatch.setattr(m, "global_rows", lambda *a, **b: calls.append(1) or order(*a, **b))
    scored = data.withColumn("t", F.nanvl("t", F.lit(None).cast("double")))
    got = sv.regression_report(scored, "t", "noise", "row_id", "m").first()
    assert len(calls) == 1
    monkeypatch.undo()
    assert [got[f"capture_{p}"] for p in (5, 10, 20)] == pytest.approx([m.capture(scored, "t", "noise", "row_id", p).first()[0] for p in (5, 10, 20)])


def test_permuted_rows_are_dealt_by_the_rows_they_become(data, monkeypatch):
    monkeypatch.setattr(ex, "SCORED_ROWS", 300, raising=False)
    got = ex.permuted(data.select("row_id", "x", "noise", "c"), ["x", "noise", "c"], "row_id", 3)
    assert got.count() == 1800 and got.select(F.spark_partition_id()).distinct().count() > 12  # of 18


def test_ablation_scores_once(data):
    out = ex.ablation(data, data, sv.Features(("noise",)), sv.Features(("x",)), "y", "row_id", sv.TreeParams(iterations=1, depth=2))
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 2


def test_only_the_feature_tables_that_are_read_are_written(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark.catalog import profiles as pf

    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    for name in ("ltv_table", "churn_table", "content_table"):
        monkeypatch.setattr(pf, name, lambda t: users)
    for name in ("user_billing_health", "user_edge", "user_tasks", "user_storage_quota"):
        monkeypatch.setattr(pf.f, name, lambda *a: users)
    t, day = SimpleNamespace(events=users, billing=users, requests=users, plan_storage=users, location="only-here"), pf.AS_OF.date()
    seen = []
    monkeypatch.setattr(pf.f, "now_features", lambda *parts: seen.append([p.count() for p in parts]) or users)
    pf.now_table(t)
    store = pf._STORES[spark.sparkContext.applicationId, "only-here"]
    assert seen == [[2] * 4] and {n for n in pf.FEATURE_TABLES if store.has(spark, n, day)} == {"ltv", "content", "quota", "edge", "tasks"}
    assert pf.feature_store(t) is store and all(store.has(spark, n, day) for n in pf.FEATURE_TABLES)
