"""Frames and baselines to scores: one join per role on the user, all else row-wise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import metrics_of
from ..functions.scores import front_parts, side_parts, status_of, weighted
from .baseline import wide_baseline
from .metrics import with_metrics

PARTS = {"front": front_parts, "side": side_parts}


def measured(frames: DataFrame, calibration: DataFrame, role: str) -> DataFrame:
    """(user_id, frame_id, <role>): a role's metrics with its baseline, null where missing."""
    joined = with_metrics(frames, role).join(wide_baseline(calibration, role).select("user_id", "b"), "user_id", "left")
    return joined.select("user_id", "frame_id", F.struct("m", "b").alias(role))


def evaluated(front: DataFrame | None, side: DataFrame | None) -> DataFrame:
    """(user_id, frame_id, parts, score, status) of each check; either role may be absent.

    parts lists the components that are there, front first.  Without any baseline of the user the
    status is not_calibrated; with one but no component it is no_data; both have a null score.
    """
    each = [(role, df) for role, df in (("front", front), ("side", side)) if df is not None]
    rows = each[0][1] if len(each) == 1 else each[0][1].join(each[1][1], ["user_id", "frame_id"], "full")
    return _combined(rows, [role for role, _ in each])


def _combined(rows: DataFrame, roles: list[str]) -> DataFrame:
    """Components, score and status from (user_id, frame_id, <role> struct<m, b> ...)."""
    parts = [p for role in roles for p in PARTS[role](F.col(f"{role}.m"), F.col(f"{role}.b"))]
    calibrated = F.lit(False)
    for role in roles:
        calibrated = calibrated | F.coalesce(F.col(f"{role}.b").isNotNull(), F.lit(False))
    # the list is built once; score and status read it, so no component is expanded again
    rows = rows.select("user_id", "frame_id", calibrated.alias("_cal"), F.filter(F.array(*parts), lambda p: p.isNotNull()).alias("parts"))
    rows = rows.withColumn("score", weighted(F.col("parts")))
    status = F.when(~F.col("_cal"), "not_calibrated").when(F.col("score").isNull(), "no_data").otherwise(status_of(F.col("score")))
    return rows.select("user_id", "frame_id", "parts", "score", status.alias("status"))


def scored_pairs(pairs: DataFrame, baselines: dict[str, DataFrame]) -> DataFrame:
    """As evaluated(), from frames that hold both roles' keypoints (user_id, frame_id, front, side).

    One scan and no shuffle of frames: baselines (user_id, b) by role are small tables, joined on the user.
    """
    rows = pairs.select("user_id", "frame_id", *[F.struct(metrics_of(role, F.col(role)).alias("m")).alias(role) for role in baselines])
    for role, base in baselines.items():
        rows = rows.join(base.select("user_id", F.col("b").alias(f"{role}_b")), "user_id", "left")
    rows = rows.select("user_id", "frame_id", *[F.struct(F.col(f"{role}.m").alias("m"), F.col(f"{role}_b").alias("b")).alias(role) for role in baselines])
    return _combined(rows, list(baselines))


def exploded(scored: DataFrame, digits: int = 6) -> DataFrame:
    """One row per component: (user_id, frame_id, metric, part_score, weight, deviation)."""
    rows = scored.select("user_id", "frame_id", F.explode("parts").alias("p"))
    return rows.select("user_id", "frame_id", "p.metric", F.round("p.score", digits).alias("part_score"), "p.weight", F.round("p.deviation", digits).alias("deviation"))
