from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as m
from tidemark.models import explain as ex
from tidemark.models import prepare as pr
from tidemark.models import supervised as sv
from tidemark.models import unsupervised as un
from tidemark.models import uplift as up

FEATS = sv.Features(("x", "noise"), ("c",))
TINY = sv.TreeParams(iterations=5, depth=3, min_rows=5)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        x, c, t = rng.gauss(0, 1), rng.choice(["a", "b"]), i % 2
        y = int(x + (0.8 if c == "a" else -0.8) + 0.5 * t + rng.gauss(0, 0.5) > 0)
        rows.append((i, i % 150, date(2024, 1, 1) + timedelta(days=i % 60), x if i % 11 else None, rng.random(), c, t, y,
                     float(max(x, 0) * 100) if y else 0.0, 1.0, 1))
    return spark.createDataFrame(
        rows, "row_id long, user_id long, day date, x double, noise double, c string, treatment int, y int, value double, "
              "sample_weight double, seg_all int").cache()


def test_splits(data):
    train, test = pr.split_user(data, 20)
    assert train.count() + test.count() == data.count() and test.count() > 0
    assert train.select("user_id").intersect(test.select("user_id")).count() == 0
    early, late = pr.split_time(data, "day", 0.8)
    assert early.agg(F.max("day")).first()[0] < late.agg(F.min("day")).first()[0]
    want = data.toPandas().day.sort_values().iloc[int(0.8 * (data.count() - 1))]
    assert early.agg(F.max("day")).first()[0] == want
    a, b = pr.split_date(data, "day", date(2024, 2, 1))
    assert a.count() + b.count() == data.count()


def test_cap_keeps_positives_and_population(data):
    capped = pr.cap_rows(data, "y", 900, ["row_id"])
    positives = data.filter("y = 1").count()
    assert capped.filter("y = 1").count() == positives and capped.count() < 1000
    assert capped.agg(F.sum("sample_weight")).first()[0] == pytest.approx(1200, rel=0.06)
    assert pr.cap_rows(data, "y", 5000, ["row_id"]).count() == 1200
    with pytest.raises(ValueError):
        pr.cap_rows(data, "y", positives, ["row_id"])
    none = data.withColumn("y", F.lit(1))
    assert pr.cap_rows(none, "y", 10, ["row_id"]).count() == 1200


def test_balanced_weights(data):
    got = pr.balanced_weights(data, "y").groupBy("y").agg(F.sum("class_weight").alias("w")).collect()
    assert [r.w for r in got] == [pytest.approx(600), pytest.approx(600)]


def test_clean(spark):
    df = spark.createDataFrame([(1, -1, "", "", 7), (2, 4, "us", None, 7), (3, 2, "us", "created", 7)],
                               "user_id long, tenure_days int, country string, last_sub_event string, same int")
    got = pr.clean(df, top_countries=1)
    assert "same" not in got.columns
    assert sorted((r.user_id, r.tenure_days, r.tenure_days_missing, r.country, r.last_sub_event) for r in got.collect()) == [
        (1, None, 1, "other", "none"), (2, 4, 0, "us", "none"), (3, 2, 0, "us", "created")]


def test_models_rank_and_unseen_categories_pass(data, spark):
    train, test = pr.split_user(data, 25)
    test = test.withColumn("c", F.when(F.col("row_id") % 50 == 0, "new").otherwise(F.col("c")))
    for model in (sv.fit_logreg(train, FEATS, "y", "sample_weight"), sv.fit_gbt(train, FEATS, "y", params=TINY)):
        scored = sv.predict(model, test, FEATS, "p")
        assert scored.columns == [*test.columns, "p"] and scored.count() == test.count()
        r = sv.classification_report(scored, "y", "p", "row_id", "m", "sample_weight").first()
        assert r.roc_auc > 0.85 and r.lift_1 >= 1 and 0 <= r.ece < 0.3


def test_two_part_and_persistence(data):
    train, test = pr.split_user(data, 25)
    scored = sv.fit_two_part(train, FEATS, "value", TINY).predict(sv.persistence(test, "noise"), "pred")
    both = [sv.regression_report(scored, "value", p, "row_id", p).first() for p in ("pred", "pred_persistence")]
    assert both[0].spearman > 0.6 > abs(both[1].spearman) and scored.filter("pred < 0").count() == 0


def test_saved_model_scores_the_same(data, tmp_path, spark):
    model = sv.fit_gbt_reg(data, FEATS, "value", TINY)
    sv.save_model(model, FEATS, str(tmp_path / "m"))
    again, feats = sv.load_model(spark, str(tmp_path / "m"))
    assert feats == FEATS
    a = sv.predict(model, data, FEATS, "p", "value").select("row_id", "p").collect()
    b = sv.predict(again, data, feats, "p", "value").select("row_id", "p").collect()
    assert sorted(a) == sorted(b)


def test_permutation_is_a_permutation(data):
    got = ex.permuted(data.select("row_id", "noise"), ["noise"], "row_id", repeats=2).toPandas()
    for _, g in got.groupby("repeat"):
        assert len(g) == 1200 and sorted(g._p_noise) == sorted(g.noise) and (g._p_noise != g.noise).mean() > 0.9


def test_importance_finds_the_signal(data):
    model = sv.fit_gbt(data, FEATS, "y", params=TINY)
    got = {r.feature: r.importance for r in ex.permutation_importance(model, data, FEATS, "y", "row_id", 2).collect()}
    assert min(got["x"], got["c"]) > 0.1 and abs(got["noise"]) < 0.03


def test_ablation_shows_the_missing_feature(data):
    train, test = pr.split_user(data, 25)
    got = {r.model: r.roc_auc for r in ex.ablation(train, test, sv.Features(("noise",), ("c",)), sv.Features(("x",)), "y", "row_id", TINY).collect()}
    assert got["base+extra"] > got["base"] + 0.05


def test_learners_see_the_treatment(data):
    feats = sv.Features(("x",), ("c",))
    for learner in (up.s_learner, up.t_learner):
        effect = up.segment_effect(learner(data, feats, "y", TINY), ["seg_all"], "tau", 1)
        got = {r.segment: r.tau for r in effect.collect()}
        assert 0.05 < got["all"] < 0.4 and got["seg_all"] == pytest.approx(got["all"])
    naive = up.naive_uplift(data, ["seg_all"], "y").first()
    assert naive.treated == naive.controls == 600 and 0.05 < naive.naive_uplift < 0.4


def test_isotonic_calibration(data):
    scored = data.withColumn("p", F.least(F.greatest(F.col("noise") * 0.1 + F.col("y") * 0.2, F.lit(0.0)), F.lit(1.0)))
    model = un.fit_isotonic(scored, "p", "y", "sample_weight")
    cal = un.calibrate(model, scored, "p", "q")
    from tidemark.functions.metrics import brier

    assert brier(cal, "y", "q").first()[0] < brier(cal, "y", "p").first()[0]
    out = un.calibrate(model, scored.limit(1).withColumn("p", F.lit(9.0)), "p", "q").first()
    assert out.q == 1.0


def test_kmeans_takes_the_best_start(data):
    df = data.fillna(0.0, ["x"])
    model = un.fit_kmeans(df, ["x", "noise"], k=3, starts=3)
    assert model.transform(df).select("prediction").distinct().count() == 3


def test_segment_against_global(data):
    train, test = pr.split_user(data, 25)
    scored = sv.predict(sv.fit_logreg(train, FEATS, "y", "sample_weight"), test, FEATS, "global_score").select("row_id", "global_score")
    two = [d.withColumn("seg_none", F.lit(0)) for d in (train, test)]
    got = {r.segment: r for r in sv.segment_vs_global(two[0], two[1], FEATS, {"seg_all": "y", "seg_none": "y"}, scored, "y", "row_id", "sample_weight").collect()}
    assert got["seg_all"].winner in ("segment", "global") and got["seg_none"].winner is None
    assert got["seg_none"].test_positives == 0


def test_hundreds_of_categories(spark):
    """More category values than tree bins: rare and new ones are one category."""
    rows = [(i, f"c{i % 300}" if i % 2 else "it's \\ a 'name'", float(i % 7), int(i % 3 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, cat string, x double, y int")
    feats = sv.Features(("x",), ("cat",))
    new = df.withColumn("cat", F.when(F.col("row_id") % 5 == 0, "never seen").otherwise(F.col("cat")))
    for model, kind in ((sv.fit_gbt(df, feats, "y", params=sv.TreeParams(iterations=2, depth=2)), "class"), (sv.fit_logreg(df, feats, "y"), "class"),
                        (sv.fit_gbt_reg(df, feats, "x", sv.TreeParams(iterations=2, depth=2)), "value")):
        assert sv.predict(model, new, feats, "p", kind).filter("p is not null").count() == 3000
    kept = pr.kept_categories(df, ["cat"], 10)["cat"]
    assert len(kept) == 10 and kept[0] == "it's \\ a 'name'"


def test_cap_with_positives_beyond_the_cap(spark):
    data = spark.range(6000).select(F.col("id").alias("row_id"), (F.col("id") % 3 > 0).cast("int").alias("y"), F.lit(1.0).alias("sample_weight"))
    capped = pr.cap_classes(data, "y", 1000, ["row_id"])  # 4,000 positives
    got = {r.y: r for r in capped.groupBy("y").agg(F.count("*").alias("n"), F.sum("sample_weight").alias("w")).collect()}
    assert all(420 < got[y].n < 580 for y in (0, 1))
    assert abs(got[1].w - 4000) < 600 and abs(got[0].w - 2000) < 300
    assert 900 < pr.cap_classes(data.filter("y = 1"), "y", 1000, ["row_id"]).count() < 1100
    few = pr.cap_classes(data.filter("y = 1 or row_id < 300"), "y", 1000, ["row_id"]).groupBy("y").count().collect()  # 100 negatives: all kept
    assert {r.y: r["count"] for r in few}[0] == 100
    assert pr.cap_classes(data, "y", 6000, ["row_id"]).count() == 6000


def test_registered_models_use_production_trees():
    from tidemark.catalog import learning

    assert learning.TREES == sv.TreeParams() and learning.TREES.iterations >= 40


def test_every_column_has_a_permutation_of_its_own(data, spark):
    rows = data.select("row_id", "x", "noise", "c")
    got = ex.permuted(rows, ["noise", "c", "row_id"], "row_id", repeats=3).toPandas()
    for _, g in got.groupby("repeat"):
        assert sorted(g._p_row_id) == sorted(g.row_id) == list(range(1200)) and (g._p_row_id != g.row_id).mean() > 0.9
    by = {r: g.set_index("row_id")._p_row_id for r, g in got.groupby("repeat")}
    assert (by[1] != by[2]).mean() > 0.9
    source = data.toPandas().set_index("row_id").noise
    first = got[got.repeat == 1].set_index("row_id")
    assert (source.loc[first._p_row_id].to_numpy() != first._p_noise.to_numpy()).mean() > 0.9
    assert ex.permuted(rows.limit(1), ["noise"], "row_id", 2).count() == 2 and ex.permuted(rows.limit(0), ["noise"], "row_id", 2).count() == 0


def _qini(rows):
    """(effect, y, treated, weight): areas by definition, over distinct effects."""
    total = sum(w for *_, w in rows)
    nt = nc = yt = yc = 0.0
    points = [(0.0, 0.0, 0.0)]
    for effect in sorted({r[0] for r in rows}, reverse=True):
        for _, y, t, w in (r for r in rows if r[0] == effect):
            nt, nc, yt, yc = nt + w * t, nc + w * (1 - t), yt + w * y * t, yc + w * y * (1 - t)
        points.append(((nt + nc) / total, yt - (yc / nc * nt if nc else 0.0), ((yt / nt if nt else 0.0) - (yc / nc if nc else 0.0)) * (nt + nc)))
    return [sum((b[0] - a[0]) * (a[k] + b[k]) / 2 for a, b in zip(points, points[1:])) - points[-1][k] / 2 for k in (1, 2)]


def test_qini_by_definition(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), t := rng.randrange(2), rng.choice([1.0, 4.0])) for _ in range(400)]
    rows = [(e, int(rng.random() < 0.2 + 0.6 * e * t), t, w) for e, t, w in rows]
    df = spark.createDataFrame([*rows, (None, 1, 1, 1.0)], "effect double, y int, t int, w double")
    got = m.qini(df, "effect", "y", "t", "w").first()
    assert [got.qini, got.auuc] == [pytest.approx(v) for v in _qini(rows)] and got.qini > 0
    turned = m.qini(df.withColumn("effect", -F.col("effect")), "effect", "y", "t", "w").first()
    assert turned.qini < 0 and turned.qini_all == pytest.approx(got.qini_all)
    treated = m.qini(df.filter("t = 1"), "effect", "y", "t", "w").first()
    assert treated.qini_all == pytest.approx(sum(w * y for _, y, t, w in rows if t))


def test_columns_without_a_value_are_left_out(data):
    empty = data.withColumn("nothing", F.lit(None).cast("double"))
    feats = sv.Features(("x", "nothing"), ("c",))
    for model in (sv.fit_gbt(empty, feats, "y", params=TINY), sv.fit_logreg(empty, feats, "y")):
        assert sv.predict(model, empty, feats, "p").filter("p is not null").count() == 1200


def test_methods_that_the_jvm_would_interpret_are_split(spark):
    """The stages before a linear model over thirty columns make one generated method that no JVM compiles; Spark is told to split it."""
    import contextlib
    import io
    import re

    from tidemark.session import prepare

    names = [f"x{i}" for i in range(30)]
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("c"), *[F.when(F.col("id") % 5 > 0, F.col("id") * i % 7).alias(c) for i, c in enumerate(names)])
    df = spark.createDataFrame(rows.collect(), rows.schema)
    feats = sv.Features(tuple(names), ("c",))
    prepare(spark)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        sv.linear_preparation(df, feats).transform(feats.prepared(df)).explain("codegen")
    largest = max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())))
    assert largest > 8000 >= int(spark.conf.get("spark.sql.codegen.hugeMethodLimit"))


def test_shared_preparation_changes_no_score(data, monkeypatch):
    linear, trees = sv.linear_preparation(data, FEATS), sv.tree_preparation(data, FEATS)
    fits = [lambda p: sv.fit_logreg(data, FEATS, "y", balanced=True, prep=p and linear),
            lambda p: sv.fit_gbt(data, FEATS, "y", params=TINY, prep=p and trees)]
    for fit in fits:
        own, shared = ([r[0] for r in sv.predict(fit(p), data, FEATS, "p").orderBy("row_id").select("p").collect()] for p in (False, True))
        assert own == shared
    own = sv.fit_two_part(data, FEATS, "value", TINY).predict(data, "v").orderBy("row_id").select("v").collect()
    medians = []
    with monkeypatch.context() as patch:
        patch.setattr(sv, "tree_preparation", lambda rows, feats, f=sv.tree_preparation: medians.append(1) or f(rows, feats))
        shared = sv.fit_two_part(data, FEATS, "value", TINY, trees).predict(data, "v").orderBy("row_id").select("v").collect()
    assert own == shared and len(medians) == 1  # the amounts have rows of their own


def test_effects_read_the_scores_once(data):
    """The union with the rows of 'all' scored every row a second time."""
    flags = data.withColumn("tau", F.rand(1)).withColumn("seg_odd", (F.col("row_id") % 2).cast("int"))
    seen = data.sparkSession.sparkContext.accumulator(0)
    counted = flags.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(flags.schema)
    got = {r.segment: r.rows for r in up.segment_effect(counted, ["seg_all", "seg_odd"], "tau").collect()}
    assert got == {"all": 1200, "seg_all": 1200, "seg_odd": 600}
    assert seen.value == 1200
