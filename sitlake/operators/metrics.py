"""Frames to metrics: row-wise, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LANDMARKS, METRICS
from ..functions.geometry import confident, metrics_of


def confident_keypoints(frames: DataFrame) -> DataFrame:
    """One row per landmark that is sure enough: (user_id, frame_id, role, landmark, x, y, score)."""
    seen = F.array(*[F.struct(F.lit(i).alias("landmark"), confident(F.col("keypoints"), n).alias("k")) for i, n in enumerate(LANDMARKS)])
    rows = frames.select("user_id", "frame_id", "role", F.explode(F.filter(seen, lambda s: s["k"].isNotNull())).alias("s"))
    return rows.select("user_id", "frame_id", "role", "s.landmark", "s.k.x", "s.k.y", "s.k.score")


def pose_frames(front: DataFrame, side: DataFrame) -> DataFrame:
    """Poses per check: the keypoints of each role, null where a role gave none."""
    f = front.select("user_id", "frame_id", F.col("keypoints").alias("front"))
    s = side.select("user_id", "frame_id", F.col("keypoints").alias("side"))
    return f.join(s, ["user_id", "frame_id"], "full")


def with_metrics(frames: DataFrame, role: str) -> DataFrame:
    """(user_id, frame_id, m): m is null where the frame cannot be measured."""
    return frames.select("user_id", "frame_id", metrics_of(role, F.col("keypoints")).alias("m"))


def wide_metrics(frames: DataFrame, role: str, digits: int = 6) -> DataFrame:
    """One column per metric for frames that can be measured."""
    rows = with_metrics(frames, role).filter("m IS NOT NULL")
    return rows.select("user_id", "frame_id", *[F.round(F.col("m")[n], digits).alias(n) for n in METRICS[role]])
