"""Each user's own settings against a fold over checks and controls, in batch and in streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitlake.functions.constants import OVERLAYS
from sitlake.operators import presentation, settings, streaks
from sitlake.plans import catalogue
from sitlake.scratch import scratch_dir
from sitlake.streaming import session

from .conftest import DATA
from .oracle import rows_of

T0 = dt.datetime(2024, 1, 1, 10, 0)
SCORES = {"good": 90, "fair": 50, "poor": 10}
CHECK = "user_id long, seq long, ts timestamp, score int, status string"
TYPED = "user_id long, needed int, notify_poor boolean, notify_recovery boolean, mode string, auto_remove boolean"
USERS = [(1, 1, True, True, "blur", True), (2, 3, True, False, "bananas", False), (3, 2, False, True, "blur", True), (4, 4, True, True, "notification", True)]


def events(seed, n=150):
    """(user, seq, ts, kind, status): checks and controls in order, some at the same instant."""
    rng, out, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.choice([0, 0, 30, 90])
        kind = rng.choice(["check"] * 9 + ["start", "stop", "dismiss", "fixed", "snooze"])
        out.append((rng.randrange(1, 6), i, T0 + dt.timedelta(seconds=at), kind, rng.choice(["good", "fair", "poor", "poor", "poor"]) if kind == "check" else None))
    return out


def fold(rows):
    """One step after the other, as a session's object is read and written."""
    known, out = {u[0]: u[1:] for u in USERS}, {}
    state = {}
    for user, seq, ts, kind, status in sorted(rows, key=lambda r: (r[2], r[3] == "check", r[1])):
        needed, notify, praise, mode, clear = known.get(user, (2, True, True, "notification", True))
        s = state.setdefault(user, {"poor": 0, "kind": None, "since": None, "started": None, "on": False, "by": None})
        if kind == "stop":
            state[user] = {"poor": 0, "kind": None, "since": None, "started": None, "on": False, "by": None}
        elif kind == "start":
            s["started"] = ts
        elif kind != "check":
            s["on"] = False
        else:
            before, bad = s["poor"], status == "poor"
            s["poor"] = before + 1 if bad else 0
            if s["kind"] is None or (s["kind"] == "poor") != bad:
                s["since"] = ts
            s["kind"] = status
            alert, recovery = bad and s["poor"] >= needed and notify, before >= needed and status == "good" and praise
            if alert and mode in OVERLAYS:
                s["on"], s["by"] = True, seq
            elif not bad and clear:
                s["on"] = False
            out[seq] = (s["poor"], s["since"], alert, recovery, s["on"], s["by"] if s["on"] else None, s["started"])
    return out


def frames(spark, rows):
    checks = spark.createDataFrame([(u, i, ts, SCORES[s], s) for u, i, ts, k, s in rows if k == "check"], CHECK)
    controls = spark.createDataFrame([(u, i, ts, k) for u, i, ts, k, s in rows if k != "check"], "user_id long, seq long, ts timestamp, kind string")
    return checks, controls, spark.createDataFrame(USERS, TYPED)


def test_alerts_recoveries_and_overlays_follow_the_user(spark):
    rows = [r for r in events(1) if r[3] == "check"]
    want = fold(rows)
    checks, _, typed = frames(spark, rows)
    own = streaks.user_streaks(checks, typed)
    assert {r["seq"]: (r["consecutive_poor"], r["streak_started_at"], r["alert"], r["recovery"]) for r in own.collect()} == {k: v[:4] for k, v in want.items()}
    shown = streaks.overlay_state(own, F.col("mode"), F.col("auto_remove"))
    assert {r["seq"]: r["overlay_active"] for r in shown.collect()} == {k: v[4] for k, v in want.items()}


def test_an_overlay_needs_a_page_that_took_it(spark):
    rows = [(1, i, T0 + dt.timedelta(seconds=i), "check", "poor") for i in range(3)]
    checks, _, typed = frames(spark, rows)
    shown = streaks.overlay_state(streaks.user_streaks(checks, typed), F.col("mode"), F.col("auto_remove"), delivered=F.col("seq") == 2)
    assert [r["overlay_active"] for r in shown.orderBy("seq").collect()] == [False, False, True]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cuts", [1, 5, 40])
def test_session_step_equals_the_fold(seed, cuts):
    import pandas as pd

    names = [f.split()[0] for f in session.SESSION.split(", ")]
    known = {u[0]: u[1:] for u in USERS}
    rows = sorted(events(seed), key=lambda r: (r[2], r[3] == "check", r[1]))
    want, got = fold(rows), {}
    for user in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == user]
        needed, notify, praise, mode, clear = known.get(user, (2, True, True, "notification", True))
        state, size = dict.fromkeys(names), -(-len(own) // cuts)
        for k in range(0, len(own), size):
            part = pd.DataFrame([(*r[:4], SCORES.get(r[4], 0), r[4]) for r in own[k : k + size]], columns=["user_id", "seq", "ts", "kind", "score", "status"])
            part = part.assign(needed=needed, notify_poor=notify, notify_recovery=praise, mode=mode, auto_remove=clear)
            out, state = session.session_step(part, state)
            for r in out.itertuples():
                got[r.seq] = (r.consecutive_poor, r.streak_started_at, r.alert, r.recovery, r.overlay_active, None if pd.isna(r.overlay_seq) else r.overlay_seq, None if pd.isna(r.started_at) else r.started_at)
                assert r.last_score == SCORES[r.status] and r.last_check_at == r.ts
    assert got == want


def test_titles_and_messages_follow_the_mode(spark):
    rows = [(u, 10 * u + i, T0 + dt.timedelta(seconds=i), "check", "poor") for u in (1, 2) for i in range(3)]
    checks, _, typed = frames(spark, rows)
    got = {r["seq"]: r for r in streaks.alerts(streaks.user_streaks(checks, typed), F.col("mode")).collect()}
    assert sorted(got) == [10, 11, 12, 22]
    assert got[10]["title"] == "Posture score 10/100" and got[22]["title"] != got[10]["title"] and "10/100" in got[22]["message"]
    assert len({got[k]["message"] for k in (10, 11, 12)}) == 3


def test_pre_checks_take_any_role_and_any_camera(spark):
    users = spark.createDataFrame([(i,) for i in range(5)], "user_id long")
    cams = spark.createDataFrame([(0, "a", None), (1, None, "b"), (2, "", ""), (3, None, None), (4, "a", "b")], "user_id long, front_camera_id string, side_camera_id string")
    calibrated = users.filter("user_id < 4")
    assert sorted(r["user_id"] for r in settings.eligible(users, calibrated, settings.with_camera(cams)).collect()) == [0, 1]


def test_schedule_knows_snoozes_rechecks_and_manual_requests(spark):
    def at(*seconds):
        return spark.createDataFrame([(1, T0 + dt.timedelta(seconds=s)) for s in seconds], "user_id long, ts timestamp")

    users = spark.createDataFrame([(1, "60")], "user_id long, check_interval_seconds string")
    none, checks = at().limit(0), at(0, 100)

    def due(fixed=none, snoozes=none, manual=none):
        r = presentation.schedule(checks, users, fixed, snoozes, manual).first()
        return [(r[c] - T0).total_seconds() for c in ("regular_at", "due_at")] + [r["trigger"]]

    assert due() == [160, 160, "regular"]
    assert due(snoozes=at(50)) == [160, 160, "regular"] and due(snoozes=at(120)) == [420, 420, "regular"]
    assert due(fixed=at(130)) == [160, 140, "recheck"] and due(fixed=at(130), snoozes=at(120), manual=at(131)) == [420, 131, "manual"]


def part_files(spark, folder, parts=4):
    """Events in files by their time, the newest first."""
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    cuts = rows.selectExpr(f"ntile({parts}) OVER (ORDER BY ts DESC) AS part", "*")
    for k in range(1, parts + 1):
        cuts.filter(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_late_checks_stay_and_batches_add_up(spark, tmp_path):
    folder = part_files(spark, f"file://{tmp_path}/events")
    daily, want = session.run_daily(spark, folder, files=1), catalogue.queries()["daily_summary"](spark, DATA)
    names = sorted(want.columns)
    assert rows_of(names, [tuple(r) for r in daily.select(names).collect()]) == rows_of(names, [tuple(r) for r in want.select(names).collect()])
    hourly, want = session.run_hourly(spark, folder, files=1), catalogue.queries()["hourly_summary"](spark, DATA)
    names = sorted(want.columns)
    assert rows_of(names, [tuple(r) for r in hourly.select(names).collect()]) == rows_of(names, [tuple(r) for r in want.select(names).collect()])


def test_a_bound_on_lateness_drops_what_is_later(spark, tmp_path):
    folder = part_files(spark, f"file://{tmp_path}/events", 6)
    out = scratch_dir(spark, "late")
    session.rollup_stream(session.check_stream(spark, folder, 1), out, scratch_dir(spark, "late-at"), late="1 hour").awaitTermination()
    got = session.newest(spark, out, "day").agg(F.sum("total_checks")).first()[0]
    assert 0 < got < spark.read.parquet(folder).count()


def test_a_replayed_batch_counts_once(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    batch = spark.createDataFrame([(1, dt.date(2024, 1, 1), 3, 1, 1, 1, 150)], "user_id long, day date, total_checks long, good_checks long, fair_checks long, poor_checks long, total_score long")
    for number in (0, 1, 1):
        session.upsert(out)(batch, number)
    assert [tuple(r) for r in session.newest(spark, out, "day").collect()] == [tuple(batch.first())]


def test_a_restarted_stream_adds_nothing(spark, tmp_path):
    folder, out, at = part_files(spark, f"file://{tmp_path}/events", 2), f"file://{tmp_path}/out", f"file://{tmp_path}/at"
    counts = []
    for _ in range(2):
        rows = session.session_stream(session.session_rows(session.event_stream(spark, folder, 1)))
        session.session_query(rows, out, at).awaitTermination()
        counts.append(spark.read.parquet(out).count())
    assert counts[0] == counts[1] > 0


def test_a_processing_time_tick(spark, tmp_path):
    folder = part_files(spark, f"file://{tmp_path}/events", 2)
    out = f"file://{tmp_path}/out"
    query = session.rollup_stream(session.check_stream(spark, folder, 1), out, f"file://{tmp_path}/at", every="1 second")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert session.newest(spark, out, "day").agg(F.sum("total_checks")).first()[0] == spark.read.parquet(folder).count()


def test_scores_come_from_one_scan_without_a_shuffle_of_frames(spark):
    plan = catalogue.queries()["posture_score"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("embeddings.parquet") == 1 and "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_days_do_not_follow_the_session_zone(spark):
    from sitlake.operators import rollups

    rows = spark.createDataFrame([(1, 1, 90)], "user_id long, seq long, score int").withColumn("ts", F.timestamp_micros(F.lit(1704153600_000_000 - 1_800_000_000))).withColumn("status", F.lit("good"))
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            days = [rollups.daily_summary(rows, z).select(F.col("day").cast("string")).first()[0] for z in ("UTC", "Asia/Tokyo")]
            hour = rollups.hourly_summary(rows, "Asia/Tokyo").first()["hour"]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert days == ["2024-01-01", "2024-01-02"] and hour == 8


def test_result_lines_maps_and_links(spark):
    scored = spark.createDataFrame([(1, 1, None, "no_data"), (1, 2, 50, "fair")], "user_id long, frame_id long, score int, status string")
    assert [r["line"] for r in presentation.result_line(scored).collect()] == ['{"score":null,"status":"no_data"}']
    stored = spark.createDataFrame([(1, {"alert_mode": "blur", "own": "x"}), (2, None)], "user_id long, stored map<string,string>")
    got = {r["user_id"]: r["stored"] for r in settings.merged_settings(stored).collect()}
    assert got[1]["alert_mode"] == "blur" and got[1]["own"] == "x" and got[2]["alert_mode"] == "notification"
    assert spark.range(1).select(presentation.encoded(F.lit("a b/é!'()*~+&"))).first()[0] == "a%20b%2F%C3%A9!'()*~%2B%26"
