"""Components of the score and how they combine, as column expressions.

A component is null unless both the current and the baseline value are there; the guard comes before
any clamping, as greatest() and least() skip nulls.  A baseline of 0 never divides: the ratio is then
without bound, so its component is 100 or 0 by sign, and null for 0 over 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FAIR, GOOD

PART_NAMES = {
    "front": ("shoulderSlope", "verticalSlouch", "headCentering", "headTilt", "earShoulderAlignment"),
    "side": ("neckInclination", "torsoInclination", "headForwardOffset"),
}
PART = "struct<metric:string,score:double,weight:double,deviation:double>"


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def part(name: str, weight: float, there: Column, score: Column, deviation: Column) -> Column:
    return F.when(there, F.struct(F.lit(name).alias("metric"), score.alias("score"), F.lit(weight).alias("weight"), deviation.alias("deviation"))).cast(PART)


def drift(name: str, weight: float, now: Column, base: Column, span: float, sided: str = "both") -> Column:
    """Falls by distance from the baseline: "both" ways, "above" it only, or "signed" (both ways, deviation keeps its sign)."""
    gap = now - base
    cost = F.greatest(F.lit(0.0), gap) if sided == "above" else F.abs(gap)
    shown = F.abs(gap) if sided == "both" else gap
    return part(name, weight, now.isNotNull() & base.isNotNull(), F.greatest(F.lit(0.0), 100 - cost / span * 100), shown)


def share(now: Column, base: Column) -> Column:
    """Ratio of current to baseline; infinite where the baseline is 0, null for 0 over 0."""
    unbounded = F.when(now > 0, F.lit(float("inf"))).when(now < 0, F.lit(float("-inf")))
    return F.when(base == 0, unbounded).otherwise(now / base)


def kept_share(name: str, weight: float, ratio: Column) -> Column:
    """100 from the baseline's ratio up, 0 from 0.7 of it down."""
    return part(name, weight, ratio.isNotNull() & ~F.isnan(ratio), clamp((ratio - 0.7) / 0.3 * 100), 1 - ratio)


def front_parts(m: Column, b: Column) -> list[Column]:
    """Components of a front frame, in the order in which they are summed."""
    left, right = (share(m[f"{s}_ear_shoulder_vertical"], b[f"{s}_ear_shoulder_vertical"]) for s in ("left", "right"))
    ears = F.when(left.isNotNull() & right.isNotNull(), (left + right) / 2).otherwise(F.coalesce(left, right))
    return [
        drift("shoulderSlope", 1.0, m["shoulder_slope_deg"], b["shoulder_slope_deg"], 15),
        kept_share("verticalSlouch", 2.5, share(m["nose_shoulder_vertical_ratio"], b["nose_shoulder_vertical_ratio"])),
        drift("headCentering", 0.8, m["nose_horizontal_offset"], b["nose_horizontal_offset"], 0.3),
        drift("headTilt", 0.8, m["head_tilt_deg"], b["head_tilt_deg"], 20),
        kept_share("earShoulderAlignment", 1.5, ears),
    ]


def side_parts(m: Column, b: Column) -> list[Column]:
    return [
        drift("neckInclination", 3.0, m["neck_inclination_deg"], b["neck_inclination_deg"], 20, "above"),
        drift("torsoInclination", 2.0, m["torso_inclination_deg"], b["torso_inclination_deg"], 25, "signed"),
        drift("headForwardOffset", 2.5, m["head_forward_offset"], b["head_forward_offset"], 0.25, "above"),
    ]


def weighted(parts: Column) -> Column:
    """Weighted mean of an array of components, in its order, rounded half up; null if it is empty."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc["s"] + p["score"] * p["weight"]).alias("s"), (acc["w"] + p["weight"]).alias("w"))

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["w"] > 0, F.round(clamp(acc["s"] / acc["w"])).cast("int")))


def status_of(score: Column) -> Column:
    """good, fair or poor from the rounded score."""
    return F.when(score >= GOOD, "good").when(score >= FAIR, "fair").when(score.isNotNull(), "poor")
