"""Settings, as long rows (user_id, key, value, ts, seq), and the status snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DEFAULTS, MIN_PERIOD


def effective_settings(users: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per user: the last value stored for each key, else its default."""
    last = [F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.struct("ts", "seq"))).alias(k) for k in DEFAULTS]
    found = stored.filter(F.col("key").isin(*DEFAULTS)).groupBy("user_id").agg(*last)
    rows = users.join(found, "user_id", "left")
    return rows.select("user_id", *[F.coalesce(F.col(k), F.lit(v).cast("string")).alias(k) for k, v in DEFAULTS.items()])


def check_period(seconds: Column) -> Column:
    """Seconds between checks: the setting, but not below the shortest period."""
    return F.greatest(seconds.cast("int"), F.lit(MIN_PERIOD))


def typed(settings: DataFrame) -> DataFrame:
    """The settings that checks are judged by, per user: needed, notify_poor, notify_recovery, mode, auto_remove."""
    flags = {"notify_poor": "notify_on_poor", "notify_recovery": "notify_on_recovery", "auto_remove": "blur_auto_remove"}
    return settings.select(
        "user_id", F.col("consecutive_poor_before_alert").cast("int").alias("needed"), F.col("alert_mode").alias("mode"), *[(F.col(c) == "true").alias(n) for n, c in flags.items()]
    )


def settings_map(settings: DataFrame) -> DataFrame:
    """(user_id, key, value) of the settings that have a value, from a map of them; keys that start with an underscore stay hidden."""
    names = [c for c in settings.columns if c != "user_id"]
    kept = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])), lambda k, v: v.isNotNull() & ~k.startswith("_"))
    return settings.select("user_id", F.explode(F.map_entries(kept)).alias("e")).select("user_id", "e.key", "e.value")


def merged_settings(stored: DataFrame, name: str = "stored") -> DataFrame:
    """stored with a map column of settings filled from the defaults: what is stored wins, other keys stay."""
    known = {k: v for k, v in DEFAULTS.items() if v is not None}
    defaults = F.map_from_arrays(F.array(*[F.lit(k) for k in known]), F.array(*[F.lit(v) for v in known.values()]))
    own = F.coalesce(F.col(name), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    return stored.withColumn(name, F.map_zip_with(defaults, own, lambda _, default, value: F.coalesce(value, default)))


def status_snapshot(settings: DataFrame, latest: DataFrame, calibrated: DataFrame, schedule: DataFrame) -> DataFrame:
    """What a status read gives: settings, last check, whether any role is calibrated, the schedule's next check.

    A user who does not monitor has no schedule, so no next check.
    """
    known = calibrated.select("user_id", F.lit(True).alias("is_calibrated")).distinct()
    rows = settings.join(latest, "user_id", "left").join(known, "user_id", "left").join(schedule.select("user_id", "regular_at"), "user_id", "left")
    period = check_period(F.col("check_interval_seconds"))
    on = F.col("monitoring_enabled") == "true"
    return rows.select(
        "user_id", "alert_mode", period.alias("period_seconds"), "last_score", "status", F.coalesce("is_calibrated", F.lit(False)).alias("is_calibrated"),
        on.alias("is_scheduled"), F.when(on, F.col("regular_at")).alias("next_check_at"),
    )


def with_camera(settings: DataFrame) -> DataFrame:
    """Users with a camera of either role; an empty id is none."""
    some = F.greatest(F.length(F.coalesce("front_camera_id", F.lit(""))), F.length(F.coalesce("side_camera_id", F.lit("")))) > 0
    return settings.filter(some).select("user_id")


def eligible(users: DataFrame, calibrated: DataFrame, cameras: DataFrame) -> DataFrame:
    """Users whose checks run: with a calibration of any role and a camera of any role."""
    return users.join(calibrated, "user_id", "left_semi").join(cameras, "user_id", "left_semi")


def uncalibrated(users: DataFrame, calibrated: DataFrame) -> DataFrame:
    return users.join(calibrated, "user_id", "left_anti")


def camera_labels(devices: DataFrame) -> DataFrame:
    """Video devices with a label, by default the first eight characters of the id."""
    shown = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("Camera "), F.substring("device_id", 1, 8)))
    return devices.filter(F.col("kind") == "videoinput").select("device_id", shown.alias("label"))
