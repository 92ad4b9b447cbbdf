"""Adapters from stored tables to the model's inputs.

``events`` stands for a log of checks and controls, ``embeddings`` for a feed of keypoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import LANDMARKS
from ..functions.scores import status_of

# Where each landmark rests in a frame of the adapter, by role.
TEMPLATE = {
    "front": {
        "nose": (320, 120), "l_eye": (300, 105), "r_eye": (340, 105), "l_ear": (280, 115), "r_ear": (360, 115),
        "l_shoulder": (240, 240), "r_shoulder": (400, 240), "l_hip": (265, 430), "r_hip": (375, 430),
    },
    "side": {
        "nose": (360, 125), "l_ear": (330, 120), "r_ear": (335, 120), "l_shoulder": (310, 240), "r_shoulder": (315, 240),
        "l_hip": (320, 430), "r_hip": (325, 430),
    },
}
REACH = 120.0
POINT = "struct<x:double,y:double,score:double>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with instants: stored times without a zone are UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def as_checks(rows: DataFrame) -> DataFrame:
    """Checks from events: the value, clamped and rounded, is the score.  Rows without a value are no checks."""
    score = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value")))).cast("int")
    return rows.filter(F.col("value").isNotNull()).select("user_id", F.col("event_id").alias("seq"), "ts", score.alias("score"), status_of(score).alias("status"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_checks(events(spark, sf_dir))


def control_kind() -> Column:
    """The control that an event stands for: a signup stops monitoring, a click starts it, a purchase snoozes, an error dismisses or is fixed."""
    kind = F.col("event_type")
    return (
        F.when(kind == "signup", "stop").when(kind == "click", "start").when(kind == "purchase", "snooze")
        .when((kind == "error") & (F.col("event_id") % 2 == 0), "dismiss").when(kind == "error", "fixed")
    )


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control events (user_id, seq, ts, kind)."""
    return events(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "ts", control_kind().alias("kind")).filter("kind IS NOT NULL")


def _point(role: str, name: str) -> Column:
    place = TEMPLATE[role].get(name)
    if place is None:
        return F.lit(None).cast(POINT)
    i, e = TEMPLATE_ORDER[role].index(name), F.col("embedding")
    value = [F.get(e, F.lit(3 * i + k)).cast("double") for k in range(3)]
    return F.struct((place[0] + REACH * value[0]).alias("x"), (place[1] + REACH * value[1]).alias("y"), (0.5 + value[2]).alias("score"))


TEMPLATE_ORDER = {role: LANDMARKS for role in TEMPLATE}


def frames(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Frames (user_id, frame_id, role, width, height, keypoints) of one role."""
    keypoints = F.array(*[_point(role, n) for n in LANDMARKS])
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("frame_id"), F.lit(role).alias("role"), F.lit(640).alias("width"), F.lit(480).alias("height"), keypoints.alias("keypoints")
    )


def paired_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both roles' keypoints of each check, from one scan: (user_id, frame_id, front, side)."""
    both = {role: F.array(*[_point(role, n) for n in LANDMARKS]) for role in TEMPLATE}
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("frame_id"), *[k.alias(role) for role, k in both.items()])


def covered_frames(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """Frames as frames() gives them, but some users' cameras are covered: no landmark of theirs is sure."""
    hidden = F.col("user_id") % 4 == 3 if role == "front" else F.col("user_id") % 3 == 1
    dark = F.transform("keypoints", lambda k: F.when(k.isNotNull(), k.withField("score", F.when(hidden, F.lit(0.0)).otherwise(k["score"]))))
    return frames(spark, sf_dir, role).withColumn("keypoints", dark)


def side_source(local: DataFrame, phone: DataFrame) -> DataFrame:
    """Side frames: the local camera's, else the phone's of the same check, else none; null keypoints are no frame."""
    keys = ["user_id", "frame_id"]
    a = local.select(*keys, F.col("keypoints").alias("_local"))
    b = phone.select(*keys, F.col("keypoints").alias("_phone"))
    used = F.when(F.col("_local").isNotNull(), "local").when(F.col("_phone").isNotNull(), "phone")
    return a.join(b, keys, "full").select(*keys, used.alias("source"), F.coalesce("_local", "_phone").alias("keypoints"))
