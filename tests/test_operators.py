from __future__ import annotations

import hashlib
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions import scalar as sc
from tidemark.operators import joins
from tidemark.operators import segments as seg
from tidemark.operators.features import user_content, user_storage_quota
from tidemark.plans import customer_profile as cp
from tidemark.plans import experiments as ex
from tidemark.plans import scoring
from tidemark.sources import filetree as tree
from tidemark.sources.seeds import PLAN_STORAGE, plan_storage
from tidemark.sources.tables import Retention, apply_retention, latest_version

T0 = datetime(2024, 1, 1)
AS_OF = datetime(2024, 1, 31)


# --- scalar functions -------------------------------------------------------------------
@pytest.mark.parametrize("path,ext", [
    ("a.MKV", "mkv"), ("dir.x/a", ""), (".bashrc", ""), ("a/.hid.JPG", "jpg"), ("x.tar.gz", "gz"), ("a..b", "b"),
    ("noext", ""), ("a.verylongsuffix", "verylong"), ("end.", ""), ("", "")])
def test_file_extension(spark, path, ext):
    assert spark.createDataFrame([(path,)], "p string").select(sc.file_extension("p")).first()[0] == ext


def test_hash_bucket_is_md5(spark):
    df = spark.range(50).select("id", sc.hash_bucket([F.col("id"), F.lit("hd")], 100).alias("b"))
    for r in df.collect():
        assert r.b == int(hashlib.md5(f"{r.id}:hd".encode()).hexdigest()[:8], 16) % 100


def test_right_closed_bins_and_tiers(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (30.0,), (30.1,), (60.0,), (61.0,)], "v double")
    got = [r[0] for r in df.select(sc.right_closed_bins("v", [0, 30, 60], ["a", "b"])).collect()]
    assert got == [None, "a", "a", "b", "b", None]
    tiers = [r[0] for r in spark.createDataFrame([(200.0,), (75.0,), (25.0,), (0.01,), (0.0,), (-1.0,)], "v double")
             .select(sc.value_tier("v", DEFAULT.tiers)).collect()]
    assert tiers == ["Platinum", "Gold", "Silver", "Bronze", "Prospect", "Prospect"]


def test_numbers_and_text(spark):
    df = spark.createDataFrame([("12", -3.0), ("x", 0.0), (None, 4.0)], "s string, v double")
    got = df.select(sc.to_number("s"), sc.to_id("s"), sc.signed_log1p("v"), sc.expm1_clipped("v")).collect()
    assert [r[0] for r in got] == [12.0, None, None] and [r[1] for r in got] == [12, 0, 0]
    assert got[0][2] == pytest.approx(-1.3862943611) and got[0][3] == 0.0
    assert sc.unique_columns(["a", "b", "a"]) == ["a", "b"]
    flagged = sc.sentinel_to_null(df, ["v"]).collect()
    assert [(r.v, r.v_missing) for r in flagged] == [(None, 1), (0.0, 0), (4.0, 0)]


def test_weekday_and_ratio(spark):
    df = spark.createDataFrame([(0, 1, 0), (3, 1, 4)], "d int, a int, b int")
    got = df.select(sc.weekday0(F.col("d")), sc.ratio(F.col("a"), F.col("b"), 2)).collect()
    assert [tuple(r) for r in got] == [(4, 0.0), (0, 0.25)]  # 1970-01-01 was a Thursday


# --- joins ---------------------------------------------------------------------------------
def test_match_tolerance_against_all_pairs(spark):
    rng = random.Random(5)
    a = [(i, rng.randint(1, 3), T0 + timedelta(seconds=rng.randint(0, 6000))) for i in range(150)]
    b = [(i, rng.randint(1, 3), T0 + timedelta(seconds=rng.randint(0, 6000))) for i in range(120)]
    want = {}
    for ia, ua, ta in a:
        near = [(abs((tb - ta).total_seconds()), tb > ta, ib) for ib, ub, tb in b
                if ua == ub and abs((tb - ta).total_seconds()) <= 60]
        if near:
            d, _, ib = min(near)
            want[ia] = (ib, d)
    fa = spark.createDataFrame(a, "aid long, u long, ts timestamp_ntz")
    fb = spark.createDataFrame(b, "bid long, u long, ts timestamp_ntz")
    got = joins.match_tolerance(fa, fb, "u", "ts", "ts", "aid", "bid", 60)
    assert {r.aid: (r.bid, r.gap_seconds) for r in got.collect()} == want


def test_sessions_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(rng.randint(1, 4), T0 + timedelta(minutes=rng.choice([0, 1, 29, 30, 31]) + 60 * rng.randint(0, 200)))
            for _ in range(400)]
    want = {}
    for u in {r[0] for r in rows}:
        times, found = sorted(t for k, t in rows if k == u), []
        for t in times:
            if found and t - found[-1][1] <= timedelta(minutes=30):
                found[-1][1], found[-1][2] = t, found[-1][2] + 1
            else:
                found.append([t, t, 1])
        want[u] = [tuple(x) for x in found]
    df = spark.createDataFrame(rows, "u long, ts timestamp_ntz")
    got = {}
    for r in joins.sessionize(df, "u", "ts").orderBy("u", "session_no").collect():
        got.setdefault(r.u, []).append((r.started_at, r.ended_at, r.events))
    assert got == want


def test_keep_members_and_text_ids(spark):
    df = spark.range(10)
    ids = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    assert sorted(r.id for r in joins.keep_members(df, ids, "id").collect()) == [1, 3]
    left = spark.createDataFrame([("1",), ("x",), ("3",), (None,)], "s string")
    assert sorted(r.id for r in joins.join_text_id(left, "s", df, "id").collect()) == [1, 3]


def test_latest_version_and_retention(spark):
    df = spark.createDataFrame([("a", 1, T0), ("a", 2, T0), ("b", 1, T0 - timedelta(days=40))], "k string, v int, ts timestamp_ntz")
    got = latest_version(df, ["k"], [F.desc("v")])
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 2), ("b", 1)]
    rules = (Retention("ts", 10, "k = 'b'"), Retention("ts", 100))
    assert {r.k for r in apply_retention(df, rules, T0).collect()} == {"a"}


def test_unknown_segment_is_an_error():
    assert [s.name for s in seg.select_segments(["dormant", "soft-cancel"])] == ["dormant", "soft-cancel"]
    assert len(seg.select_segments()) == len(seg.SEGMENTS)
    with pytest.raises(KeyError, match="nope"):
        seg.select_segments(["nope"])


# --- profile ----------------------------------------------------------------------------------
LTV = "user_id long, value_tier string, pred_ltv_12m double, ltv_decile int, country string, is_annual int, recency_days int, last_plan_id string"


def profile(spark, pred=10.0, **parts):
    ltv = spark.createDataFrame([(1, "Gold", pred, 5, "us", 0, 3, "5")], LTV)

    def part(name, schema):
        rows = [(1, *parts[name])] if name in parts else []
        return spark.createDataFrame(rows, "user_id long, " + schema)

    return cp.customer_360(
        ltv,
        part("churn", "churn_risk_30d double, has_payment_method int, days_to_expires int, had_cancel_sched int"),
        part("billing", "in_grace_period int, reconciliation_critical int"),
        part("content", "content_persona string, storage_gb double, files_added_30d long, n_lost_files long, saw_walkthrough long"),
        part("edge", "n_rate_limited_7d long, n_stall_7d long, media_requests_7d long, stream_gb_7d double"),
        part("tasks", "downloads_30d long, task_failure_rate double"),
        part("quota", "storage_used_pct double, plan_name string"), DEFAULT).first()


def test_absent_user_gets_defaults_not_fix_payment(spark):
    r = profile(spark)
    assert r.next_best_action == "monitor" and r.lifecycle_stage == "lapsed_or_free"
    assert (r.churn_risk_30d, r.has_payment_method, r.days_to_expires, r.plan_name, r.content_persona) == (
        -1.0, -1, -999, "unknown", "unknown")


@pytest.mark.parametrize("action,pred,parts", [
    ("fix_payment", 1.0, {"billing": (1, 0)}),
    ("fix_payment", 1.0, {"churn": (0.1, 0, -7, 0)}),
    ("fix_payment", 1.0, {"churn": (0.1, 0, 30, 0)}),
    ("monitor", 1.0, {"churn": (0.1, 0, 31, 0)}),
    ("monitor", 1.0, {"churn": (0.1, 0, -8, 0)}),
    ("urgent_save", 50.0, {"churn": (0.5, 1, 5, 0)}),
    ("monitor", 49.9, {"churn": (0.5, 1, 5, 0)}),
    ("hd_upsell", 80.0, {"content": ("video_streamer", 1.0, 0, 0, 1), "edge": (1, 0, 0, 0.0)}),
    ("hd_upsell", 1.0, {"content": ("video_streamer", 1.0, 0, 0, 1), "edge": (0, 6, 0, 0.0)}),
    ("monitor", 1.0, {"content": ("video_streamer", 1.0, 0, 0, 1), "edge": (0, 5, 0, 0.0)}),
    ("storage_upsell", 1.0, {"quota": (80.0, "Pro")}),
    ("monitor", 1.0, {"quota": (79.9, "Pro")}),
    ("monitor", 1.0, {"quota": (95.0, "Master")}),
    ("monitor", 1.0, {"quota": (95.0, "unmapped")}),
    ("reactivate_empty", 100.0, {"content": ("empty", 0.0, 0, 0, 0)}),
    ("vip_nurture", 75.0, {}),
])
def test_next_best_action(spark, action, pred, parts):
    assert profile(spark, pred, **parts).next_best_action == action


def test_billing_rule_order(spark):
    day = sc.to_epoch_day(AS_OF)
    cases = {1: (-7, 0, 0, 0.95), 2: (30, 1, 1, 0.90), 3: (15, 1, 0, 0.50), 4: (16, 1, 0, 0.2), 5: (-8, 0, 1, 0.2), 6: (31, 0, 0, 0.2)}
    expiry = [(u * 10, u, T0, day + c[0], c[1]) for u, c in cases.items()]
    expiry.append((1, 1, T0 - timedelta(days=1), day + 20, 1))  # an older event must not count
    e = spark.createDataFrame(expiry, "event_id long, user_id long, created_at timestamp_ntz, expires_day int, has_pm int")
    s = spark.createDataFrame([(u, 0.2, c[2]) for u, c in cases.items()] + [(7, 0.2, 0)], "user_id long, model_risk double, had_cancel_sched int")
    got = {r.user_id: r for r in scoring.billing_override(s, e, AS_OF, DEFAULT).collect()}
    assert {u: got[u].churn_risk_30d for u in cases} == {u: c[3] for u, c in cases.items()}
    assert got[1].risk_source == "billing_rule" and got[4].risk_source == "model"
    assert (got[7].days_to_expires, got[7].has_payment_method) == (-999, -1)


def test_retention_quadrants(spark):
    ltv = spark.createDataFrame([(u, "Gold", v) for u, v in ((1, 30.0), (2, 30.0), (3, 5.0), (4, 5.0), (5, 30.0), (6, 9.0))],
                                "user_id long, value_tier string, pred_ltv_12m double")
    risk = spark.createDataFrame([(1, 0.4, 0, 1, 99), (2, 0.1, 0, 1, 99), (3, 0.1, 1, 1, 99), (4, 0.1, 0, 1, 99), (5, 0.9, 1, 0, 3)],
                                 "user_id long, churn_risk_30d double, had_cancel_sched int, has_payment_method int, days_to_expires int")
    got = {r.user_id: r.priority for r in cp.retention_priority(ltv, risk, DEFAULT).collect()}
    assert got == {1: "P1_urgent_save", 2: "P2_high_value_nurture", 3: "P3_at_risk_lowvalue", 4: "P4_monitor", 5: "P0_fix_payment"}


def test_storage_quota(spark):
    ltv = spark.createDataFrame([(1, "1"), (2, "9"), (3, None), (4, "0")], "user_id long, last_plan_id string")
    content = spark.createDataFrame([(1, 24.0), (2, 5.0)], "user_id long, storage_gb double")
    got = {r.user_id: (r.plan_name, r.plan_gb, r.storage_used_pct) for r in user_storage_quota(ltv, plan_storage(spark), content).collect()}
    assert got == {1: ("Basic", 30, 80.0), 2: ("unmapped", 0, -1.0), 3: ("unmapped", 0, -1.0), 4: ("Free", 2, -1.0)}
    assert len(PLAN_STORAGE) == 7


# --- experiments --------------------------------------------------------------------------------
def test_uplift_window_borders(spark):
    day = date(2024, 1, 10)
    hold = spark.createDataFrame([(u, "c", "treatment", day) for u in range(1, 7)] + [(9, "c", "holdout", day), (10, "other", "holdout", day)],
                                 "user_id long, campaign string, arm string, assigned_date date")
    at = datetime(2024, 1, 10)
    paid = {1: at, 2: at + timedelta(seconds=1), 3: at + timedelta(days=14), 4: at + timedelta(days=14, seconds=1), 5: at - timedelta(seconds=1), 10: at + timedelta(days=2)}
    rev = spark.createDataFrame([(u, Decimal("5.00"), "completed", t) for u, t in paid.items()] + [(6, Decimal("9.00"), "pending", at + timedelta(days=1))],
                                "user_id long, amount_usd decimal(18,2), status string, transaction_date timestamp_ntz")
    got = {r.user_id: (r.converted, r.revenue) for r in ex.conversions(hold, rev, "c", 14).collect()}
    assert got == {1: (0, 0.0), 2: (1, 5.0), 3: (1, 5.0), 4: (0, 0.0), 5: (0, 0.0), 6: (0, 0.0), 9: (0, 0.0)}
    r = ex.measure_uplift(hold, rev, "c", 14, DEFAULT).first()
    assert (r.treat_users, r.treat_conv, r.hold_users, r.hold_conv) == (6, 2, 1, 0)
    assert r.conv_treatment == 0.33333 and r.absolute_uplift == 0.33333 and r.relative_uplift_pct is None
    assert r.arpu_treatment == pytest.approx(10 / 6, abs=1e-4) and r.verdict == "not_significant"


def test_uplift_without_any_conversion_or_arm(spark):
    hold = spark.createDataFrame([(1, "c", "treatment", date(2024, 1, 1))], "user_id long, campaign string, arm string, assigned_date date")
    rev = spark.createDataFrame([], "user_id long, amount_usd decimal(18,2), status string, transaction_date timestamp_ntz")
    r = ex.measure_uplift(hold, rev, "c", 14, DEFAULT).first()
    assert (r.treat_users, r.hold_users, r.z_score, r.verdict) == (1, 0, None, "not_significant")


def test_random_arms_show_no_uplift(spark):
    users = spark.range(20000).select(F.col("id").alias("user_id"), F.lit("c").alias("next_best_action"))
    hold = ex.assign_holdout(users, "c", date(2024, 1, 1), DEFAULT)
    share = hold.filter("arm = 'holdout'").count() / 20000
    assert abs(share - 0.10) < 0.01
    rev = users.filter("user_id % 7 = 0").select("user_id", F.lit(Decimal("1.00")).cast("decimal(18,2)").alias("amount_usd"),
                                                F.lit("completed").alias("status"), F.lit("2024-01-03").cast("timestamp_ntz").alias("transaction_date"))
    r = ex.measure_uplift(hold, rev, "c", 14, DEFAULT).first()
    assert abs(r.absolute_uplift) < 0.03 and r.verdict == "not_significant"


# --- file trees -------------------------------------------------------------------------------------
def test_file_tree_forms(spark):
    node = '{"size": 3000000000, "relative_path": "a.MKV", "last_update": "2024-01-20 10:00:00", "folder_id": 4, "is_lost": 1, "title": "secret"}'
    docs = [
        (1, "ok", '{"fs": {"x": %s, "y": 5, "z": {"title": "t.srt", "size": null, "folder_id": 4}}, "root": {"size": 6000000000}, "user": {"org_id": 3, "saw_walkthrough": 1, "sign_up_stamp": 86400}}' % node),
        (2, "ok", '{"fs": [%s, 7, {"relative_path": "b.flac", "size": 3000000000, "last_update": "never"}], "user": null}' % node),
        (3, "ok", '{"fs": {}}'), (4, "ok", '{"user": {}}'), (5, "ok", '{"fs": {"a": '), (6, "timeout", None), (7, "ok", "[1]"),
    ]
    trees = spark.createDataFrame(docs, "user_id long, fetch_status string, raw string")
    got = {r.user_id: r for r in user_content(tree.parse_nodes(trees), tree.parse_accounts(trees), AS_OF).collect()}
    assert {u: r.content_status for u, r in got.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "ok", 5: "error", 6: "timeout", 7: "error"}
    one = got[1]
    assert (one.n_files, one.n_video, one.n_other, one.n_folders, one.n_lost_files) == (2, 1, 1, 1, 1)
    assert (one.share_video, one.primary_category, one.content_persona, one.days_since_last_add) == (0.5, "video", "video_streamer", 11)
    assert (one.is_business, one.saw_walkthrough, one.account_age_days) == (1, 1, sc.to_epoch_day(AS_OF) - 1)
    two = got[2]  # equal sizes: first category by name
    assert (two.n_files, two.primary_category, two.storage_gb, two.share_audio) == (2, "audio", 0.0, 0.0)
    assert got[3].content_persona == "empty" and got[3].days_since_last_add == -1
    assert got[5].n_files == 0 and got[5].content_persona is None
    assert "title" not in tree.parse_nodes(trees).columns and len(one) == 42


def test_resume_keeps_good_rows(spark):
    prev = spark.createDataFrame([(1, "ok"), (2, "timeout")], "user_id long, content_status string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    assert sorted(r.user_id for r in tree.todo(ids, prev).collect()) == [2, 3]
    fresh = spark.createDataFrame([(1, "error"), (2, "ok"), (3, "ok")], "user_id long, content_status string")
    assert sorted(map(tuple, tree.resume(prev, fresh).collect())) == [(1, "ok"), (2, "ok"), (3, "ok")]
    assert [r.user_id for r in tree.sample_users(ids, 2).collect()] == [r.user_id for r in tree.sample_users(ids.repartition(3), 2).collect()]
