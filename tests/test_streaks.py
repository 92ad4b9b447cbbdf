"""Streaks, rollups, settings and streams on small tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitlake.operators import presentation, rollups, settings, streaks
from sitlake.sources.tables import POINT, side_source

T0 = dt.datetime(2024, 1, 1, 10, 0)
SCORES = {"good": 90, "fair": 50, "poor": 10}
CHECK = "user_id long, seq long, ts timestamp, score int, status string"


def checks(spark, *statuses, user=1, every=60):
    return spark.createDataFrame([(user, i, T0 + dt.timedelta(seconds=every * i), SCORES[s], s) for i, s in enumerate(statuses)], CHECK)


def scored(spark, *values):
    status = [("good" if v >= 75 else "fair" if v >= 40 else "poor") for v in values]
    return spark.createDataFrame([(1, i, T0 + dt.timedelta(seconds=i), v, s) for i, (v, s) in enumerate(zip(values, status, strict=True))], CHECK)


def fold(statuses, needed=2):
    """The state after each check, one after the other."""
    poor, kind, since, out = 0, None, None, []
    for i, s in enumerate(statuses):
        before, bad = poor, s == "poor"
        poor = poor + 1 if bad else 0
        if kind is None or (kind == "poor") != bad:
            since = i
        kind = s
        out.append((poor, since, bad and poor >= needed, before >= needed and s == "good"))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_the_fold(spark, seed):
    rng = random.Random(seed)
    statuses = [rng.choice(["good", "fair", "poor", "poor"]) for _ in range(120)]
    rows = streaks.with_streaks(checks(spark, *statuses)).orderBy("seq").collect()
    got = [(r["consecutive_poor"], int((r["streak_started_at"] - T0).total_seconds() // 60), r["alert"], r["recovery"]) for r in rows]
    assert got == fold(statuses)


@pytest.mark.parametrize("statuses, alerts, praises", [("poor poor poor", [1, 2], []), ("poor poor good", [1], [2]), ("poor poor fair good", [1], []), ("poor good", [], [])])
def test_alerts_and_recoveries(spark, statuses, alerts, praises):
    rows = streaks.with_streaks(checks(spark, *statuses.split()))
    assert sorted(r["seq"] for r in streaks.alerts(rows).collect()) == alerts
    assert sorted(r["seq"] for r in streaks.recoveries(rows).collect()) == praises


def test_good_and_fair_share_a_streak(spark):
    got = streaks.current_streak(streaks.with_streaks(checks(spark, "good", "fair", "good")), "2024-01-01 10:59:00").first()
    assert (got["streak_type"], got["streak_started_at"], got["shown"]) == ("good", T0, "59m")


def test_hour_of_a_streak(spark):
    got = streaks.current_streak(streaks.with_streaks(checks(spark, "good")), "2024-01-01 11:00:00").first()
    assert (got["minutes"], got["shown"]) == (60, "1h0m")


def test_one_exchange_serves_all_states(spark):
    plan = streaks.alerts(streaks.with_streaks(checks(spark, "poor", "poor")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_overlay(spark):
    rows = streaks.with_streaks(checks(spark, "poor", "poor", "fair", "poor"))
    assert [r["overlay_active"] for r in streaks.overlay_state(rows).orderBy("seq").collect()] == [False, True, False, False]
    assert [r["overlay_active"] for r in streaks.overlay_state(rows, auto_remove=False).orderBy("seq").collect()] == [False, True, True, True]


def test_sessions_split_streaks(spark):
    rows = checks(spark, "poor", "poor", "poor")
    stops = spark.createDataFrame([(1, 99, T0 + dt.timedelta(seconds=90))], "user_id long, seq long, ts timestamp")
    got = streaks.with_streaks(streaks.monitoring_sessions(rows, stops), ("user_id", "session_id")).orderBy("seq").collect()
    assert [(r["session_id"], r["consecutive_poor"]) for r in got] == [(0, 1), (0, 2), (1, 1)]


def test_snooze(spark):
    rows = checks(spark, "poor", "poor", "poor", every=150)
    snoozes = spark.createDataFrame([(1, 99, T0)], "user_id long, seq long, ts timestamp")
    assert [r["seq"] for r in streaks.without_snoozed(rows, snoozes, 300).collect()] == [2]


@pytest.mark.parametrize("values, total, clean, compat", [((0, 0, 5, 7), 12, 4, 2), ((0, 0), 0, 2, 1), ((3, 0, 0), 3, 3, 3)])
def test_hour_buckets(spark, values, total, clean, compat):
    rows = scored(spark, *values)
    a, b = rollups.hourly_summary(rows).first(), rollups.hourly_summary_compat(rows).first()
    assert (a["score_sum"], a["n"], b["score_sum"], b["n"]) == (total, clean, total, compat)


def test_hour_in_a_zone(spark):
    assert rollups.hourly_summary(checks(spark, "good"), "America/New_York").first()["hour"] == 5


def test_daily_counts_add_up(spark):
    day = rollups.daily_summary(checks(spark, "good", "fair", "poor", "poor")).first()
    assert day["good_checks"] + day["fair_checks"] + day["poor_checks"] == day["total_checks"] == 4
    assert day["average_score"] == 40


def test_retention_keeps_the_cutoff(spark):
    days = spark.createDataFrame([(1, dt.date(2024, 1, 16)), (1, dt.date(2024, 1, 15))], "user_id long, day date")
    assert [r["day"] for r in rollups.retained_days(days, "2024-04-15").collect()] == [dt.date(2024, 1, 16)]


def test_recent_checks(spark):
    assert {r["seq"] for r in rollups.recent_checks(checks(spark, *["good"] * 30), 20).collect()} == set(range(10, 30))


def test_settings_last_write_wins_and_defaults_fill(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    rows = [(1, 1, T0, "alert_mode", "blur"), (1, 2, T0, "alert_mode", "bananas"), (1, 3, T0, "other", "x")]
    got = {r["user_id"]: r for r in settings.effective_settings(users, spark.createDataFrame(rows, "user_id long, seq long, ts timestamp, key string, value string")).collect()}
    assert (got[1]["alert_mode"], got[2]["alert_mode"], got[1]["check_interval_seconds"], got[1]["front_camera_id"]) == ("bananas", "notification", "60", None)


def test_period_has_a_floor(spark):
    got = spark.createDataFrame([("10",), ("60",)], "s string").select(settings.check_period(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in got] == [30, 60]


def test_camera_labels(spark):
    rows = [("abcdefghij", "", "videoinput"), ("x1", "Desk", "videoinput"), ("y", "Mic", "audioinput")]
    got = settings.camera_labels(spark.createDataFrame(rows, "device_id string, label string, kind string")).collect()
    assert [tuple(r) for r in got] == [("abcdefghij", "Camera abcdefgh"), ("x1", "Desk")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], CHECK)
    assert streaks.with_streaks(none).isEmpty() and rollups.daily_summary(none).isEmpty() and rollups.recent_checks(none).isEmpty()


def test_removals_turn_the_overlay_off(spark):
    rows = streaks.with_streaks(checks(spark, "poor", "poor", "poor"))
    off = spark.createDataFrame([(1, 50, T0 + dt.timedelta(seconds=120))], "user_id long, seq long, ts timestamp")
    got = streaks.overlay_state(rows, auto_remove=False, removals=off).orderBy("seq").collect()
    assert [r["overlay_active"] for r in got] == [False, True, True]
    quiet = streaks.with_streaks(checks(spark, "poor", "poor", "fair"))
    got = streaks.overlay_state(quiet, auto_remove=False, removals=off).orderBy("seq").collect()
    assert [r["overlay_active"] for r in got] == [False, True, False]


def test_delivery_target(spark):
    rows = [(1, 1, "about:blank"), (1, 2, "https://a/"), (2, 3, "file:///x"), (3, 4, "chrome://x"), (3, 5, None)]
    pages = spark.createDataFrame(rows, "w long, page_id long, url string")
    got = {r["w"]: r["url"] for r in presentation.delivery_target(pages, "w").collect()}
    assert got == {1: "https://a/", 2: "file:///x", 3: None}


def test_recheck_comes_before_the_period(spark):
    users = spark.createDataFrame([(1, "60")], "user_id long, check_interval_seconds string")
    fixed = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=20))], "user_id long, ts timestamp")
    assert presentation.schedule(checks(spark, "poor"), users, fixed).first()["due_at"] == T0 + dt.timedelta(seconds=30)
    assert presentation.schedule(checks(spark, "poor"), users, fixed.filter("false")).first()["due_at"] == T0 + dt.timedelta(seconds=60)


def test_side_source_prefers_the_local_camera(spark):
    def frames(*ids):
        return spark.createDataFrame([(1, i, [(float(i), 0.0, 1.0)]) for i in ids], f"user_id long, frame_id long, keypoints array<{POINT}>")

    got = {r["frame_id"]: r["source"] for r in side_source(frames(1, 2), frames(2, 3)).collect()}
    assert got == {1: "local", 2: "local", 3: "phone"}
