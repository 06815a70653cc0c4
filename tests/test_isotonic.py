"""Isotonic regression in chunks against one pass over all cells."""

from __future__ import annotations

import random

import pytest

from tidemark.models import isotonic


def pav(cells):
    """(score, weight, weighted label) in order -> score -> fitted value."""
    out = []
    for s, w, wy in cells:
        now = [[s], w, wy]
        while out and out[-1][2] * now[1] >= now[2] * out[-1][1]:
            last = out.pop()
            now = [last[0] + now[0], last[1] + now[1], last[2] + now[2]]
        out.append(now)
    return {s: wy / w for ss, w, wy in out for s in ss}


def fitted(spark, rows, chunk):
    df = spark.createDataFrame(rows, "s double, y double, w double")
    model = isotonic.fit(df, "s", "y", "w", chunk)
    got = {r.s: r.value for r in model.values(df, "s").collect()}
    cells = {}
    for s, y, w in rows:
        if s is not None and s == s and y is not None and w is not None and w > 0:
            a = cells.setdefault(s + 0.0, [0.0, 0.0])
            a[0] += w
            a[1] += w * y
    return model, got, pav([(s, *cells[s]) for s in sorted(cells)])


def noisy(n, seed):
    rng = random.Random(seed)
    return [(round(rng.random(), 4), float(rng.random() < 0.3 + 0.4 * i / n), rng.choice([1.0, 4.0])) for i in range(n)]


RAMP = [(float(i), float(i), 1.0) for i in range(300)]


@pytest.mark.parametrize("rows", [
    noisy(4000, 1), [(s, -s, 1.0) for s, _, _ in RAMP], RAMP, RAMP + [(300.0, -5.0, 400.0)], [(0.0, 1e6, 5.0), *RAMP],
    [(1.0, 2.0, 1.0)] * 5, [(s, 1.0, w) for s, _, w in RAMP]])
def test_chunks_give_the_exact_fit(spark, rows):
    _, got, want = fitted(spark, rows, 128)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_many_distinct_scores(spark):
    rng = random.Random(5)
    rows = [(i / 20_000, float(rng.random() < i / 20_000), 1.0) for i in range(20_000)]
    model, got, want = fitted(spark, rows, 2048)
    assert len(got) == 20_000 and max(abs(got[s] - want[s]) for s in want) < 1e-9
    assert model.blocks.count() == len(set(want.values()))


def test_missing_values_and_new_scores(spark):
    nan = float("nan")
    rows = [(0.0, 0.0, 1.0), (-0.0, 1.0, 1.0), (1.0, 1.0, 1.0), (3.0, 3.0, 2.0), (None, 9.0, 1.0), (nan, 9.0, 1.0), (2.0, None, 1.0), (2.0, 9.0, 0.0), (2.0, 9.0, None), (2.5, 9.0, -1.0)]
    model, _, _ = fitted(spark, rows, 2)
    new = spark.createDataFrame([(x,) for x in (-7.0, 0.0, 0.5, 1.0, 2.0, 3.0, 99.0, nan, None)], "s double")
    assert {r.s: r.value for r in model.values(new, "s").collect() if r.s in (-7.0, 0.0, 0.5, 1.0, 2.0, 3.0, 99.0)} == {
        -7.0: 0.5, 0.0: 0.5, 0.5: 0.75, 1.0: 1.0, 2.0: 2.0, 3.0: 3.0, 99.0: 3.0}
    assert isotonic.fit(new.limit(0).selectExpr("s", "s AS y"), "s", "y").values(new, "s").where("value IS NOT NULL").count() == 0


def test_values_are_placed_by_running_frames(spark):
    """A frame from a row to the end of its range is read again for every row: quadratic in the distinct scores."""
    df = spark.createDataFrame(noisy(3000, 7), "s double, y double, w double")
    model = isotonic.fit(df, "s", "y", "w", 128)
    plan = model.values(df, "s")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    knots = sorted((r._score, r.value) for r in model.knots().collect())
    new = spark.createDataFrame([(i / 700 - 0.2,) for i in range(1000)], "s double")
    import numpy as np
    assert all(r.value == pytest.approx(np.interp(r.s, *zip(*knots)), abs=1e-9) for r in model.values(new, "s").collect())
