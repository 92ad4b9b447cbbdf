"""Calibration: a user's baseline from the first frames of each role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CALIBRATION_FRAMES, METRICS
from .metrics import with_metrics


def calibration_frames(frames: DataFrame, count: int = CALIBRATION_FRAMES) -> DataFrame:
    """The first frames of each user; Spark limits each group before the shuffle."""
    order = Window.partitionBy("user_id").orderBy("frame_id")
    return frames.withColumn("frame_no", F.row_number().over(order)).filter(F.col("frame_no") <= count)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean_in_order(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def deviation(values: Column, mean: Column) -> Column:
    """Population deviation of two values or more."""
    return F.when(F.size(values) > 1, F.sqrt(total(F.transform(values, lambda v: (v - mean) * (v - mean))) / F.size(values)))


def wide_baseline(frames: DataFrame, role: str) -> DataFrame:
    """(user_id, b): b has each metric's mean, and b_sd its population deviation.

    Frames that cannot be measured are dropped.  Sums run in order of the frames, at most a calibration's few,
    so reruns agree to the last bit.  Only metrics of the first frame that can be measured
    enter; the mean skips frames that lack one; a deviation needs two values.
    """
    rows = with_metrics(calibration_frames(frames), role).filter("m IS NOT NULL")
    names = METRICS[role]
    seen = F.min_by("m", "frame_id")
    stats = rows.groupBy("user_id").agg(
        seen.alias("first"),
        F.sort_array(F.collect_list(F.struct("frame_id", "m"))).alias("all"),
    )

    def values(name: str) -> Column:
        return F.filter(F.transform("all", lambda x: x["m"][name]), lambda v: v.isNotNull())

    stats = stats.select("user_id", "first", *[values(n).alias(n) for n in names])
    stats = stats.select("user_id", "first", *[F.struct(F.col(n).alias("all"), mean_in_order(F.col(n)).alias("mean")).alias(f"{n}_of") for n in names])
    stats = stats.select("user_id", "first", *[F.col(f"{n}_of.mean").alias(n) for n in names], *[deviation(F.col(f"{n}_of.all"), F.col(f"{n}_of.mean")).alias(f"{n}_sd") for n in names])

    def known(suffix: str):
        return F.struct(*[F.when(F.col("first")[n].isNotNull(), F.col(n + suffix)).alias(n) for n in names])

    return stats.select("user_id", known("").alias("b"), known("_sd").alias("b_sd"))


def long_baseline(frames: DataFrame, role: str, digits: int = 6) -> DataFrame:
    """One row per metric of a baseline: (user_id, role, metric, mean, stddev)."""
    wide = wide_baseline(frames, role)
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col("b")[n], digits).alias("mean"), F.round(F.col("b_sd")[n], digits).alias("stddev")) for n in METRICS[role]])
    return wide.select("user_id", F.lit(role).alias("role"), F.explode(each).alias("x")).select("user_id", "role", "x.*").filter("mean IS NOT NULL")


def failed_calibrations(frames: DataFrame, role: str) -> DataFrame:
    """Users whose calibration frames gave no baseline."""
    users = calibration_frames(frames).select("user_id").distinct()
    return users.join(wide_baseline(frames, role), "user_id", "left_anti").select("user_id", F.lit(role).alias("role"))


def latest_calibration(calibrations: DataFrame) -> DataFrame:
    """The newest calibration of each user and role: a new one replaces its role and leaves the other."""
    newest = F.max(F.struct("calibrated_at", "seq", "mean")).alias("x")
    return calibrations.groupBy("user_id", "role").agg(newest).select("user_id", "role", "x.calibrated_at", "x.mean", F.lit(1).alias("version"))
