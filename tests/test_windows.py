"""Point-in-time windows, panels and their edge rules on hand-built frames."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions.scalar import to_epoch_day
from tidemark.operators import pit
from tidemark.plans import churn_panel as churn
from tidemark.plans import conversion_panel as conv
from tidemark.plans import ltv_panel as ltv
from tidemark.sources import schemas
from tidemark.sources.tables import Tables

D0 = date(2024, 6, 1)
DAY = to_epoch_day(D0)
AS_OF = datetime(2024, 9, 1)


def event(i, user, day, kind, surface="email", hour=12, **kw):
    at = datetime.combine(D0 + timedelta(days=day), datetime.min.time()) + timedelta(hours=hour)
    return (i, f"k{i}", kw.get("vid", f"v{user}"), user, at, kind, surface, kw.get("goal"), kw.get("category", ""),
            kw.get("action", ""), kw.get("url", "/"), kw.get("ua", "Desktop"), kw.get("country", "us"),
            '{"src":"%s","email_id":"%s"}' % (kw.get("src", "mautic"), kw.get("email", "e1")))


def payment(i, user, day, amount, plan=1, hour=12, status="completed"):
    at = datetime.combine(D0 + timedelta(days=day), datetime.min.time()) + timedelta(hours=hour)
    from decimal import Decimal

    return (i, user, Decimal(str(amount)), status, at, "paypal", plan, "usd", "us")


def tables(spark, events=(), revenue=()):
    e = spark.createDataFrame(list(events), schemas.EVENTS)
    r = spark.createDataFrame(list(revenue), schemas.REVENUE)
    none = spark.createDataFrame([], "user_id long")
    return Tables(events=e, revenue=r, requests=none, subscription_state=none, vid_user_map=none, bw_user_day=none,
                  files=none, accounts=none, billing=none, expiry=none, plan_storage=none)


CFG = replace(DEFAULT, panel_start=D0, panel_end=D0 + timedelta(days=40), era_cutover=date(2025, 1, 1),
              negative_rate=1.0, tasks_since=D0 - timedelta(days=30), subs_since=D0)


def test_frame_borders(spark):
    offsets = [0, 1, 7, 8, 30, 31, 90, 91]
    facts = spark.createDataFrame([(1, DAY - o, 1 << i) for i, o in enumerate(offsets)], "user_id long, day int, x int")
    index = spark.createDataFrame([(1, DAY)], "user_id long, day int")
    frames = {f"b{n}": pit.back(F.sum("x"), n) for n in (7, 30, 90)}
    frames["all"] = pit.history(F.sum("x"))
    frames["last"] = pit.back(F.max("day"), 90)
    got = pit.pit_windows(facts, index, frames).first()
    assert got.b7 == 0b110 and got.b30 == 0b11110 and got.b90 == 0b1111110 and got.all == 0b11111110
    assert got.last == DAY - 1


def test_cross_index_only_makes_eligible_rows(spark):
    spans = spark.createDataFrame([(1, DAY, DAY + 10), (2, DAY + 50, None)], "user_id long, first_day int, last int")
    dates = [D0, D0 + timedelta(days=1), D0 + timedelta(days=60)]
    got = pit.cross_index(spans, dates)
    assert sorted((r.user_id, r.day - DAY) for r in got.collect()) == [(1, 1), (1, 60), (2, 60)]
    got = pit.cross_index(spans.filter("user_id = 1"), dates, until="last")
    assert [(r.user_id, r.day - DAY) for r in got.collect()] == [(1, 1)]


def panel_row(spark, events, revenue=(), day=20, uplift=False, cfg=CFG):
    t = tables(spark, events, revenue)
    out = conv.build_conversion_panel(t, AS_OF, cfg, uplift)
    return out.filter(F.unix_date("send_date") == DAY + day).first()


def test_conversion_features_and_labels(spark):
    events = [
        event(1, 1, 20, "email.sent"), event(2, 1, 13, "email.sent"), event(3, 1, 12, "email.sent"),
        event(4, 1, 13, "email.opened"), event(5, 1, 20, "email.opened"),
        event(6, 1, 19, "pageview", "web", url="/x/PRICING"), event(7, 1, 20, "pageview", "web"),
        event(8, 1, 19, "event", "landing", category="File", action="Download"),
        event(9, 1, 18, "subscription.canceled", "subscription"),
        event(10, 1, 18, "subscription.cancellation_scheduled", "subscription", hour=13),
        event(11, 1, 20, "subscription.created", "subscription"),
        event(12, 1, 34, "subscription.reactivated", "subscription"),
    ]
    revenue = [payment(1, 1, -20, 6.95), payment(2, 1, 20, 50), payment(3, 1, 34, 9.95), payment(4, 1, 33, 7, status="pending")]
    r = panel_row(spark, events, revenue)
    assert (r.em_sent_7, r.em_sent_30, r.days_since_last_send, r.days_since_last_open) == (1, 2, 7, 7)
    assert r.em_open_rate_90 == 0.5 and r.sends_today == 1 and r.era == "mautic"
    assert (r.web_active_days_7, r.pageviews_7, r.pricing_views_30, r.file_dl_30) == (1, 1, 1, 1)
    assert (r.last_sub_event, r.days_since_sub_event) == ("cancellation_scheduled", 2)
    # the payment on the index day is neither history nor label
    assert (r.txns_before, float(r.ltv_before_usd), r.days_since_last_txn) == (1, 6.95, 40)
    assert (r.label_payment_14d, r.days_to_payment, float(r.first_payment_usd)) == (1, 14, 9.95)
    assert r.premium_at_send == 0 and r.label_conv_14d == 1 and r.label_sub_started_14d == 1
    assert r.seg_soft_cancel == 1 and r.send_dow == (D0 + timedelta(days=20)).isoweekday() % 7
    assert len(r) == 69 and tuple(r.asDict()) == conv.PANEL_COLUMNS


def test_label_window_is_closed_after_horizon(spark):
    r = panel_row(spark, [event(1, 1, 20, "email.sent")], [payment(1, 1, 35, 9.95)])
    assert (r.label_payment_14d, r.days_to_payment, r.sample_weight) == (0, -1, 1.0)
    assert (r.days_since_last_txn, r.days_since_web_activity, r.tenure_days) == (-1, -1, 0)


def test_future_facts_never_change_features(spark):
    past = [event(1, 1, 20, "email.sent"), event(2, 1, 10, "pageview", "web"), event(3, 1, 5, "email.opened")]
    later = [event(9, 1, 21, "pageview", "web"), event(10, 1, 22, "email.opened"),
             event(11, 1, 25, "subscription.created", "subscription")]
    pay = [payment(1, 1, -40, 70)]
    before = panel_row(spark, past, pay).asDict()
    after = panel_row(spark, past + later, pay + [payment(2, 1, 22, 5)]).asDict()
    changed = {k for k in before if before[k] != after[k]}
    assert changed <= {"label_payment_14d", "label_conv_14d", "label_sub_started_14d", "days_to_payment",
                       "first_payment_usd", "mobile_share_now"}


def test_annual_payment_keeps_premium(spark):
    sent = [event(1, 1, 20, "email.sent")]
    for amount, ago, premium in ((60, 370, 1), (60, 371, 0), (59.99, 36, 0), (1, 35, 1)):
        assert panel_row(spark, sent, [payment(1, 1, 20 - ago, amount)]).premium_at_send == premium


def test_transactional_day_is_no_sample_but_bulk_day_is(spark):
    cfg = replace(CFG, era_cutover=D0, bulk_threshold=2)
    one = [event(1, 1, 20, "email.sent", src="internal_events", email="a")]
    assert panel_row(spark, one, cfg=cfg) is None
    bulk = one + [event(2, 2, 20, "email.sent", src="internal_events", email="a")]
    r = panel_row(spark, bulk, cfg=cfg)
    assert (r.era, r.sends_today) == ("internal", 1)


def test_control_days_keep_distance_from_sends(spark):
    events = [event(1, 1, 0, "email.sent")]
    events += [event(10 + d, 1, d, "pageview", "web") for d in (13, 14, 15, 16, 17, 18)]
    events += [event(50, 2, 20, "pageview", "web")]  # never e-mailed: no control row
    out = conv.build_conversion_panel(tables(spark, events), AS_OF, CFG, uplift=True).filter("treatment = 0").collect()
    days = {(r.user_id, to_epoch_day(r.send_date) - DAY) for r in out}
    assert len(days) == 3 and days <= {(1, d) for d in (15, 16, 17, 18)}
    assert all(r.era == "control" and r.sends_today == 0 for r in out)


def test_negative_sampling_is_stable_and_weighted(spark):
    df = spark.range(20000).select(F.col("id").alias("user_id"), F.lit(5).alias("day"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    kept = conv.downsample_negatives(df, "y", 0.25, ("user_id", "day"))
    again = conv.downsample_negatives(df.repartition(3), "y", 0.25, ("user_id", "day"))
    assert {r.user_id for r in kept.collect()} == {r.user_id for r in again.collect()}
    assert kept.filter("y = 1").count() == 400
    assert abs(kept.agg(F.sum("sample_weight")).first()[0] - 20000) < 700


# --- churn ------------------------------------------------------------------------------
def churn_rows(spark, events, revenue=(), snaps=(20,), **kw):
    t = tables(spark, events, revenue)
    cfg = replace(CFG, churn_horizon=30)
    return churn.build_churn_panel(t, [D0 + timedelta(days=s) for s in snaps], AS_OF, cfg, **kw).collect()


def test_status_is_what_was_known_before_the_snapshot(spark):
    sub = "subscription"
    events = [
        event(1, 1, 0, "subscription.created", sub), event(2, 1, 20, "subscription.canceled", sub),  # on the day itself
        event(3, 2, 0, "subscription.created", sub), event(4, 2, 10, "subscription.canceled", sub),  # gone
        event(5, 3, 0, "subscription.billing_plan_change", sub),  # never started
        event(6, 4, 0, "subscription.created", sub), event(7, 4, 5, "subscription.canceled", sub),
        event(8, 4, 9, "subscription.reactivated", sub), event(9, 4, 50, "subscription.expired", sub),
        event(10, 5, 0, "subscription.created", sub), event(11, 5, 51, "subscription.expired", sub),
        event(12, 6, 19, "subscription.canceled", sub, hour=9), event(13, 6, 19, "subscription.created", sub, hour=10),
    ]
    got = {r.user_id: r for r in churn_rows(spark, events)}
    assert set(got) == {1, 4, 5, 6}
    assert got[1].label_churn_30 == 0  # the snapshot day is in no window
    assert got[4].label_churn_30 == 1 and got[5].label_churn_30 == 0
    assert (got[4].prior_cancels, got[4].prior_reactivations, got[4].sub_tenure_days) == (1, 1, 20)
    assert got[6].last_sub_event == "created" and got[6].days_since_sub_event == 1
    assert got[1].last_plan_id == "0" and got[1].days_to_renewal == -999 and got[1].cycle_position == -1.0
    before = churn.active_at(tables(spark, events), D0 + timedelta(days=20))
    assert {r.user_id for r in before.collect()} == {1, 4, 5, 6}


def test_cancel_request_window(spark):
    sub = "subscription"
    base = [event(1, u, -50, "subscription.created", sub) for u in (1, 2)]
    base = [event(i, e[3], -50, "subscription.created", sub) for i, e in enumerate(base)]
    events = base + [event(10, 1, -10, "subscription.cancellation_scheduled", sub),
                     event(11, 2, -11, "subscription.cancellation_scheduled", sub)]
    got = {r.user_id: r.had_cancel_sched_30 for r in churn_rows(spark, events)}
    assert got == {1: 1, 2: 0}


@pytest.mark.parametrize("days,median", [((0, 30), 30), ((0, 30, 90), 60), ((0, 0, 30), 30), ((0, 0, 0, 30), 0), ((5,), -1)])
def test_upper_median_gap(spark, days, median):
    events = [event(1, 1, 0, "subscription.created", "subscription")]
    revenue = [payment(i, 1, d - 100, 5, hour=i) for i, d in enumerate(days)]
    r = churn_rows(spark, events, revenue)[0]
    assert r.prior_txn_gap_median == median
    since = 120 - max(days)
    assert r.days_to_renewal == (median - since if median > 0 else -999)


# --- lifetime value ----------------------------------------------------------------------
def brute_force(txns, day, window=730):
    """Plain restatement of the feature definitions for one user."""
    prior = sorted(t for t in txns if t[0] < day)
    if not prior or day - prior[-1][0] > window:
        return None
    amounts, days = [t[2] for t in prior], [t[0] for t in prior]
    gaps = sorted(b - a for a, b in zip(days, days[1:]))
    mean = sum(amounts) / len(amounts)

    def total(lo, hi):
        return sum(a for d, a in zip(days, amounts) if lo <= day - d <= hi)

    prev, year = total(366, 730), total(1, 365)
    return {
        "recency_days": day - days[-1], "frequency": len(prior), "monetary_sum": sum(amounts),
        "monetary_std": (sum((a - mean) ** 2 for a in amounts) / len(amounts)) ** 0.5,
        "min_amount": min(amounts), "max_amount": max(amounts), "first_amount": amounts[0], "last_amount": amounts[-1],
        "gap_median": gaps[len(gaps) // 2] if gaps else -1, "gap_min": gaps[0] if gaps else -1,
        "gap_max": gaps[-1] if gaps else -1, "rev_90": total(1, 90), "rev_180": total(1, 180), "rev_365": year,
        "rev_prev_365": prev, "rev_trend": year / prev if prev > 0 else -1.0,
        "n_plans": len({t[3] for t in prior}), "refund_count": sum(a < 0 for a in amounts),
        "refund_amount": sum(a for a in amounts if a < 0),
        "label_rev_365": max(sum(t[2] for t in txns if day < t[0] <= day + 365), 0.0),
    }


def test_ltv_panel_against_brute_force(spark):
    rng = random.Random(3)
    revenue, by_user, i = [], {}, 0
    for user in range(1, 25):
        for _ in range(rng.choice([1, 2, 3, 8, 20])):
            day, amount, plan = rng.choice([-731, -730, -366, -365, -90, 0, rng.randint(-1500, 400)]), rng.choice([6.95, 9.95, 69.5, -6.95]), rng.randint(1, 3)
            i += 1
            revenue.append(payment(i, user, day, amount, plan, hour=i % 24))
            by_user.setdefault(user, []).append((day, (i % 24, i), amount, plan))
    dates = [D0, D0 + timedelta(days=1), D0 - timedelta(days=400)]
    got = ltv.build_ltv_panel(tables(spark, revenue=revenue).revenue, dates, DEFAULT).collect()
    want = {(u, d): brute_force([(t[0] + 0, t[1], t[2], t[3]) for t in ts], (d - D0).days)
            for u, ts in by_user.items() for d in dates}
    want = {k: v for k, v in want.items() if v is not None}
    assert {(r.user_id, r.index_date) for r in got} == set(want)
    for r in got:
        for name, value in want[(r.user_id, r.index_date)].items():
            assert float(r[name]) == pytest.approx(value, abs=0.0051), (r.user_id, r.index_date, name)


def test_first_version_keeps_old_payers_and_negative_labels(spark):
    revenue = [payment(1, 1, -900, 10), payment(2, 1, 5, -3)]
    t = tables(spark, revenue=revenue)
    one = ltv.build_ltv_panel(t.revenue, [D0], DEFAULT, version=1).first()
    assert (one.recency_days, one.label_rev_365) == (900, -3.0)
    assert ltv.build_ltv_panel(t.revenue, [D0], DEFAULT).count() == 0
    two = ltv.build_ltv_panel(tables(spark, revenue=[payment(1, 1, -9, 10), payment(2, 1, 5, -3)]).revenue, [D0], DEFAULT)
    assert two.first().label_rev_365 == 0.0


def test_index_date_lists():
    assert ltv.index_dates(date(2023, 11, 15), datetime(2025, 2, 1), 365, 1) == [
        date(2023, 11, 1), date(2023, 12, 1), date(2024, 1, 1), date(2024, 2, 1)]
    got = churn.snapshot_dates(replace(DEFAULT, churn_start=date(2026, 2, 1)), datetime(2026, 6, 17))
    assert got[0] == date(2026, 2, 1) and got[-1] <= date(2026, 5, 17) and (got[1] - got[0]).days == 7


def test_history_knows_only_earlier_snapshots(spark):
    history = spark.createDataFrame([(1, 10, 5.0), (1, 20, 7.0), (2, 20, 1.0), (3, 5, None)], "user_id long, snapshot_day int, v double")
    rows = spark.createDataFrame([(1, d) for d in (9, 10, 11, 20, 21, 80)] + [(2, 20), (2, 21), (3, 6), (4, 30)], "user_id long, day int")
    got = {(r.user_id, r.day): (r.v, r.snapshot_age) for r in pit.with_history(rows, history, ["v"], max_age=40).collect()}
    assert got == {(1, 9): (None, None), (1, 10): (None, None), (1, 11): (5.0, 1), (1, 20): (5.0, 10), (1, 21): (7.0, 1), (1, 80): (None, None),
                   (2, 20): (None, None), (2, 21): (1.0, 1), (3, 6): (None, 1), (4, 30): (None, None)}
    later = history.union(spark.createDataFrame([(1, 21, 99.0), (4, 30, 99.0)], history.schema))  # no leak: the day itself and later do not count
    assert {(r.user_id, r.day): (r.v, r.snapshot_age) for r in pit.with_history(rows, later, ["v"], max_age=40).collect()} == got | {(1, 80): (None, None)}


def test_campaign_rates_hold_earlier_days_only(spark):
    from tidemark.operators import features as f

    days = spark.createDataFrame([("a", 1, 100, 50, 10), ("b", 1, 100, 10, 0), ("a", 2, 100, 0, 0), ("c", 3, 10, 10, 10), ("a", 9, 5, 5, 5)],
                                 "email_id string, day int, sent long, opened long, clicked long")
    got = {(r.email_id, r.day): r for r in f.campaign_history(days, strength=100).collect()}
    assert got["a", 1].open_rate_before is None and got["b", 1].sent_before == 0
    assert got["a", 2].open_rate_before == pytest.approx((50 + 100 * 60 / 200) / 200)
    assert got["c", 3].open_rate_before == pytest.approx(60 / 300)  # new: the rate of all
    assert got["a", 9].click_rate_before == pytest.approx((10 + 100 * 20 / 310) / 300)
    changed = days.withColumn("opened", F.when(F.col("day") >= 3, 0).otherwise(F.col("opened")))
    again = {(r.email_id, r.day): r for r in f.campaign_history(changed, strength=100).collect()}
    assert all(again[k] == got[k] for k in got if k[1] <= 3)
    sends = spark.createDataFrame([(7, "a", 2, 1), (8, "z", 2, 1)], "user_id long, email_id string, day int, c long")
    out = {r.user_id: r.sent_before for r in f.with_campaign_history(sends, f.campaign_history(days), 4).collect()}
    assert out == {7: 100, 8: None}
