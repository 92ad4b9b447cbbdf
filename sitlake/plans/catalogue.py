"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import KEPT_CHECKS, SNOOZE
from ..functions.scores import PART_NAMES
from ..operators import baseline, metrics, presentation, rollups, scoring, settings, streaks
from ..scratch import checked_broadcast, stored
from ..sources import tables
from ..streaming import session
from . import sql

#: Days on which dashboards are read, and late enough for retention to bite.
ASOF, LATE = "2024-01-30", "2024-04-15"
DAY_COLUMNS = ["user_id", "day", "total_checks", "good_checks", "fair_checks", "poor_checks", "total_score", "average_score"]


def _users(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select("user_id").distinct()


def _streaks(spark: SparkSession, d: str) -> DataFrame:
    return streaks.with_streaks(tables.checks(spark, d))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return rollups.daily_summary(tables.checks(spark, d))


def _stored_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings that users changed, made from click events."""
    n = F.col("event_id")
    step = F.floor(n / 10)
    mode = F.when(n % 3 == 0, "blur").when(n % 3 == 1, "bananas").otherwise("notification")
    on = F.when(step % 3 == 0, "false").otherwise("true")
    camera = F.when(step % 4 == 0, "").otherwise(F.concat(F.lit("camera-"), (step % 3).cast("string")))
    values = [
        ("check_interval_seconds", (10 + n % 290).cast("string")), ("alert_mode", mode), ("blur_intensity", (step % 10).cast("string")), ("notify_on_poor", on),
        ("consecutive_poor_before_alert", (1 + step % 4).cast("string")), ("notify_on_recovery", on), ("blur_auto_remove", on), ("front_camera_id", camera),
        ("side_camera_id", camera), ("monitoring_enabled", on),
    ]
    key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, own) in enumerate(values):
        key, value = F.when(n % 10 == k, name).otherwise(key), F.when(n % 10 == k, own).otherwise(value)
    return tables.events(spark, d).filter("event_type = 'click'").select("user_id", n.alias("seq"), "ts", key.alias("key"), value.alias("value"))


def _settings(spark: SparkSession, d: str) -> DataFrame:
    return settings.effective_settings(_users(spark, d), _stored_settings(spark, d))


def _calibrations(spark: SparkSession, d: str) -> DataFrame:
    """Calibrations that users took, made from view events."""
    role = F.when(F.col("event_id") % 2 == 0, "front").otherwise("side")
    rows = tables.events(spark, d).filter("event_type = 'view' AND value IS NOT NULL")
    return rows.select("user_id", role.alias("role"), F.col("ts").alias("calibrated_at"), F.col("event_id").alias("seq"), F.round("value", 6).alias("mean"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return settings.typed(_settings(spark, d))


def _own_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Streaks, alerts and recoveries by each user's settings."""
    return streaks.user_streaks(tables.checks(spark, d), _typed(spark, d))


def _kinds(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return tables.controls(spark, d).filter(F.col("kind").isin(*kinds)).drop("kind")


def _calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Users with a baseline of any role, where some cameras were covered."""
    each = [baseline.wide_baseline(tables.covered_frames(spark, d, role), role).select("user_id") for role in ("front", "side")]
    return each[0].unionByName(each[1]).distinct()


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of both roles from one scan of frames; stored baselines are broadcast if they are few."""
    base = {role: checked_broadcast(stored(baseline.wide_baseline(tables.frames(spark, d, role), role), "baseline"), row_bytes=256) for role in ("front", "side")}
    return scoring.scored_pairs(tables.paired_frames(spark, d), base)


def _schedule(spark: SparkSession, d: str, manual: DataFrame | None = None) -> DataFrame:
    return presentation.schedule(tables.checks(spark, d), _settings(spark, d), _kinds(spark, d, "fixed"), _kinds(spark, d, "snooze"), manual)


def _evaluated(spark: SparkSession, d: str, *roles: str) -> DataFrame:
    each = {}
    for role in roles:
        frames = tables.frames(spark, d, role)
        each[role] = scoring.measured(frames, frames, role)
    return scoring.evaluated(each.get("front"), each.get("side"))


def frames_scan(spark: SparkSession, d: str) -> DataFrame:
    both = tables.frames(spark, d, "front").unionByName(tables.frames(spark, d, "side"))
    return both.select("user_id", "frame_id", "role", "width", "height")


def pose_frames(spark: SparkSession, d: str) -> DataFrame:
    poses = metrics.pose_frames(tables.frames(spark, d, "front"), tables.frames(spark, d, "side"))
    nose = [F.round(F.col(role)[0]["x"], 6).alias(f"{role}_nose_x") for role in ("front", "side")]
    return poses.select("user_id", "frame_id", *nose)


def confident_keypoints(spark: SparkSession, d: str) -> DataFrame:
    both = tables.frames(spark, d, "front").unionByName(tables.frames(spark, d, "side"))
    rows = metrics.confident_keypoints(both)
    return rows.select("user_id", "frame_id", "role", "landmark", *[F.round(c, 6).alias(c) for c in ("x", "y", "score")])


def _long_baselines(spark: SparkSession, d: str) -> DataFrame:
    return baseline.long_baseline(tables.frames(spark, d, "front"), "front").unionByName(baseline.long_baseline(tables.frames(spark, d, "side"), "side"))


def calibration_failures(spark: SparkSession, d: str) -> DataFrame:
    each = [baseline.failed_calibrations(tables.covered_frames(spark, d, role), role) for role in ("front", "side")]
    return each[0].unionByName(each[1])


def front_side_combined(spark: SparkSession, d: str) -> DataFrame:
    """How many components each role gives to a check; the roles are joined on the check."""
    rows = _evaluated(spark, d, "front", "side")

    def count(role: str):
        return F.size(F.filter("parts", lambda p: p["metric"].isin(*PART_NAMES[role])))

    return rows.select("user_id", "frame_id", count("front").alias("front_parts"), count("side").alias("side_parts"))


def posture_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores that reach the state and the rollups: those of checks with at least one component."""
    return _scored(spark, d).filter("score IS NOT NULL").select("user_id", "frame_id", "score", "status")


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return streaks.alerts(_own_streaks(spark, d), F.col("mode"))


def streaks_by_session(spark: SparkSession, d: str) -> DataFrame:
    stops = _kinds(spark, d, "stop")
    return streaks.with_streaks(streaks.monitoring_sessions(tables.checks(spark, d), stops), ("user_id", "session_id"))


def snooze_filter(spark: SparkSession, d: str) -> DataFrame:
    return streaks.without_snoozed(tables.checks(spark, d), _kinds(spark, d, "snooze"), SNOOZE)


def status_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return settings.status_snapshot(_settings(spark, d), streaks.latest_status(tables.checks(spark, d)), _calibrated(spark, d), _schedule(spark, d))


def overlay_state(spark: SparkSession, d: str) -> DataFrame:
    """Overlays by each user's settings; on every seventh check no page takes one."""
    return streaks.overlay_state(_own_streaks(spark, d), F.col("mode"), F.col("auto_remove"), delivered=F.col("seq") % 7 != 0)


def overlay_with_controls(spark: SparkSession, d: str) -> DataFrame:
    return streaks.overlay_state(_own_streaks(spark, d), F.col("mode"), F.col("auto_remove"), removals=_kinds(spark, d, *session.OFF))


def side_source(spark: SparkSession, d: str) -> DataFrame:
    """All side frames; the local camera misses every third check, the phone every second."""
    frames = tables.frames(spark, d, "side")
    local, phone = (frames.withColumn("keypoints", F.when(there, F.col("keypoints"))) for there in (F.col("frame_id") % 3 != 0, F.col("frame_id") % 2 == 0))
    rows = tables.side_source(local, phone)
    return rows.select("user_id", "frame_id", "source", F.round(F.col("keypoints")[0]["x"], 6).alias("nose_x"))


def check_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When each user is due and why; views of a low value stand for "check now"."""
    manual = tables.events(spark, d).select("user_id", "ts", "event_type", "value").filter("event_type = 'view' AND value < 30")
    return _schedule(spark, d, manual)


def camera_labels(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for devices: every third has no label, every fifth is no camera."""
    n = F.col("s_suppkey")
    kind = F.when(n % 5 == 0, "audioinput").otherwise("videoinput")
    devices = tables.table(spark, d, "supplier").select(F.concat(F.lit("device-"), n.cast("string")).alias("device_id"), F.when(n % 3 == 0, "").otherwise(F.col("s_name")).alias("label"), kind.alias("kind"))
    return settings.camera_labels(devices)


def delivery_targets(spark: SparkSession, d: str) -> DataFrame:
    """Pages in windows of ten; every fourth page is a closed one."""
    pages = tables.table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, "about:blank").otherwise(F.col("url")).alias("url"), F.floor(F.col("page_id") / 10).alias("screen"))
    return presentation.delivery_target(pages, "screen")


def next_check(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(ASOF).cast("timestamp")
    return status_snapshot(spark, d).select("user_id", presentation.countdown(F.col("next_check_at"), now).alias("seconds"))


def settings_merged(spark: SparkSession, d: str) -> DataFrame:
    """Each user's stored settings as a map, filled from the defaults."""
    last = F.max_by("value", F.struct("ts", "seq")).alias("value")
    own = _stored_settings(spark, d).groupBy("user_id", "key").agg(last).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("stored"))
    rows = settings.merged_settings(_users(spark, d).join(own, "user_id", "left"))
    return rows.select("user_id", F.explode("stored").alias("key", "value"))


def pairing_links(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for phones that wait to be paired."""
    peers = tables.table(spark, d, "supplier").select(F.concat(F.lit("peer "), F.col("s_suppkey").cast("string")).alias("peer_id"))
    return presentation.pairing_link(peers, sql.PAIR_PAGE, sql.PAIR_CODE)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posture_score(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def days(rows: DataFrame) -> DataFrame:
        return rows.select(*DAY_COLUMNS)

    return {
        "frames_scan": frames_scan,
        "pose_frames": pose_frames,
        "confident_keypoints": confident_keypoints,
        "front_metrics": lambda s, d: metrics.wide_metrics(tables.frames(s, d, "front"), "front"),
        "side_metrics": lambda s, d: metrics.wide_metrics(tables.frames(s, d, "side"), "side"),
        "baseline": lambda s, d: _long_baselines(s, d).drop("stddev"),
        "baseline_stddev": lambda s, d: _long_baselines(s, d).drop("mean"),
        "calibration_latest": lambda s, d: baseline.latest_calibration(_calibrations(s, d)),
        "calibration_failures": calibration_failures,
        "eligible_users": lambda s, d: settings.eligible(_users(s, d), _calibrated(s, d), settings.with_camera(_settings(s, d))),
        "uncalibrated_users": lambda s, d: settings.uncalibrated(_users(s, d), _calibrated(s, d)),
        "front_scores": lambda s, d: _evaluated(s, d, "front").drop("parts"),
        "side_scores": lambda s, d: _evaluated(s, d, "side").drop("parts"),
        "front_side_combined": front_side_combined,
        "score_breakdown": lambda s, d: scoring.exploded(_scored(s, d)),
        "posture_score": posture_score,
        "score_status_all": lambda s, d: _scored(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "checks": tables.checks,
        "status_distribution": lambda s, d: rollups.status_distribution(tables.checks(s, d)),
        "streaks": _streaks,
        "streaks_by_session": streaks_by_session,
        "alerts": alerts,
        "latest_alert": lambda s, d: streaks.latest_alert(_own_streaks(s, d)),
        "recoveries": lambda s, d: streaks.recoveries(_own_streaks(s, d)),
        "overlay_state": overlay_state,
        "overlay_with_controls": overlay_with_controls,
        "side_source": side_source,
        "check_schedule": check_schedule,
        "camera_labels": camera_labels,
        "delivery_targets": delivery_targets,
        "next_check": next_check,
        "score_ring": lambda s, d: presentation.score_ring(tables.checks(s, d)),
        "current_streak": lambda s, d: streaks.current_streak(_streaks(s, d), ASOF),
        "latest_status": lambda s, d: streaks.latest_status(tables.checks(s, d)),
        "snooze_filter": snooze_filter,
        "daily_summary": lambda s, d: days(_days(s, d)),
        "hourly_summary": lambda s, d: rollups.hourly_summary(tables.checks(s, d)),
        "hourly_summary_compat": lambda s, d: rollups.hourly_summary_compat(tables.checks(s, d)),
        "recent_checks": lambda s, d: rollups.recent_checks(tables.checks(s, d), KEPT_CHECKS),
        "recent_checks_short": lambda s, d: rollups.recent_checks(tables.checks(s, d), 20),
        "retained_days": lambda s, d: days(rollups.retained_days(_days(s, d), LATE)),
        "today_stats": lambda s, d: rollups.today_stats(_days(s, d), ASOF),
        "seven_day_chart": lambda s, d: rollups.seven_day_chart(_users(s, d), _days(s, d), ASOF),
        "settings_effective": _settings,
        "settings_map": lambda s, d: settings.settings_map(_settings(s, d)),
        "settings_merged": settings_merged,
        "status_snapshot": status_snapshot,
        "result_log": lambda s, d: presentation.result_line(_scored(s, d)),
        "pairing_links": pairing_links,
        "stream_session": lambda s, d: session.run_sessions(s, f"{d}/events.parquet", _typed(s, d)),
        "stream_daily": lambda s, d: days(session.run_daily(s, f"{d}/events.parquet")),
        "stream_hourly": lambda s, d: session.run_hourly(s, f"{d}/events.parquet"),
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle(ASOF, LATE)
