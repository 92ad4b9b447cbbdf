"""Geometry of keypoints as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LANDMARKS, MIN_CONFIDENCE, MIN_SHOULDERS, MIN_TORSO


def confident(keypoints: Column, name: str) -> Column:
    """A landmark's struct, null below the least confidence."""
    k = keypoints[LANDMARKS.index(name)]
    return F.when(k["score"] >= MIN_CONFIDENCE, k)


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def middle(a: Column, b: Column) -> Column:
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def line_angle(dy: Column, dx: Column) -> Column:
    return F.degrees(F.atan2(dy, dx))


def corner_angle(a: Column, b: Column, c: Column) -> Column:
    """Signed angle at b between the rays to a and c, in degrees."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    return line_angle(ux * vy - uy * vx, ux * vx + uy * vy)


def both(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull()


def front_metrics(keypoints: Column) -> Column:
    """Struct of the front metrics, each null where its landmarks are not seen; null as a whole without two shoulders apart."""
    nose, l_eye, r_eye, l_ear, r_ear, l_sh, r_sh, l_hip, r_hip = (confident(keypoints, n) for n in LANDMARKS[:7] + ("l_hip", "r_hip"))
    span, mid, hips = distance(l_sh, r_sh), middle(l_sh, r_sh), middle(l_hip, r_hip)
    torso = line_angle(mid["x"] - hips["x"], hips["y"] - mid["y"])
    metrics = F.struct(
        line_angle(r_sh["y"] - l_sh["y"], r_sh["x"] - l_sh["x"]).alias("shoulder_slope_deg"),
        ((mid["y"] - nose["y"]) / span).alias("nose_shoulder_vertical_ratio"),
        ((nose["x"] - mid["x"]) / span).alias("nose_horizontal_offset"),
        line_angle(r_eye["y"] - l_eye["y"], r_eye["x"] - l_eye["x"]).alias("head_tilt_deg"),
        ((l_sh["y"] - l_ear["y"]) / span).alias("left_ear_shoulder_vertical"),
        ((r_sh["y"] - r_ear["y"]) / span).alias("right_ear_shoulder_vertical"),
        torso.alias("torso_inclination_deg"),
        span.alias("shoulder_width"),
    )
    return F.when(both(l_sh, r_sh) & (span >= MIN_SHOULDERS), metrics)


def side_metrics(keypoints: Column) -> Column:
    """Struct of the side metrics; ear, shoulder and hip are each the left one if seen, else the right."""
    ear, shoulder, hip = (F.coalesce(confident(keypoints, f"l_{n}"), confident(keypoints, f"r_{n}")) for n in ("ear", "shoulder", "hip"))
    nose, torso = confident(keypoints, "nose"), distance(shoulder, hip)
    metrics = F.struct(
        line_angle(F.abs(ear["x"] - shoulder["x"]), shoulder["y"] - ear["y"]).alias("neck_inclination_deg"),
        line_angle(F.abs(shoulder["x"] - hip["x"]), hip["y"] - shoulder["y"]).alias("torso_inclination_deg"),
        corner_angle(ear, shoulder, hip).alias("ear_shoulder_hip_angle"),
        F.when(torso > MIN_TORSO, (nose["x"] - shoulder["x"]) / torso).alias("head_forward_offset"),
    )
    return F.when(shoulder.isNotNull(), metrics)


def metrics_of(role: str, keypoints: Column) -> Column:
    return front_metrics(keypoints) if role == "front" else side_metrics(keypoints)
