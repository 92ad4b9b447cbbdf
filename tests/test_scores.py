"""Components, combination and gates with hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from sitlake.functions import geometry, scores
from sitlake.functions.constants import LANDMARKS, METRICS
from sitlake.operators import baseline, metrics, scoring

POINT = "array<struct<x:double,y:double,score:double>>"
FRAME = f"user_id long, frame_id long, role string, keypoints {POINT}"
FRONT = {"nose": (320, 120), "l_eye": (300, 105), "r_eye": (340, 105), "l_ear": (280, 115), "r_ear": (360, 115), "l_shoulder": (240, 240), "r_shoulder": (400, 240), "l_hip": (265, 430), "r_hip": (375, 430)}


def pose(points, sure=0.9, **confidence):
    return [(float(points[n][0]), float(points[n][1]), float(confidence.get(n, sure))) if n in points else (0.0, 0.0, 0.0) for n in LANDMARKS]


def frames(spark, *poses, user=1, role="front", start=0):
    return spark.createDataFrame([(user, start + i, role, p) for i, p in enumerate(poses)], FRAME)


def one(spark, column, **values):
    types = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("sure, seen", [(0.3, True), (0.2999, False)])
def test_confidence(spark, sure, seen):
    got = metrics.wide_metrics(frames(spark, pose(FRONT, nose=sure)), "front").first()
    assert (got["nose_shoulder_vertical_ratio"] is not None) == seen


@pytest.mark.parametrize("gap, there", [(1.0, True), (0.99, False)])
def test_shoulders_apart(spark, gap, there):
    p = FRONT | {"l_shoulder": (240, 240), "r_shoulder": (240 + gap, 240)}
    assert metrics.wide_metrics(frames(spark, pose(p)), "front").isEmpty() != there


@pytest.mark.parametrize("length, there", [(1.0, False), (1.01, True)])
def test_torso_length(spark, length, there):
    p = {"nose": (360, 125), "l_shoulder": (310, 240), "l_hip": (310, 240 + length)}
    got = metrics.wide_metrics(frames(spark, pose(p), role="side"), "side").first()
    assert (got["head_forward_offset"] is not None) == there


def test_side_picks_each_landmark_by_itself(spark):
    p = {"l_ear": (330, 120), "r_ear": (335, 100), "l_shoulder": (310, 240), "l_hip": (320, 430)}
    got = metrics.wide_metrics(frames(spark, pose(p, l_ear=0.1), role="side"), "side").first()
    assert got["neck_inclination_deg"] == pytest.approx(math.degrees(math.atan2(25, 140)), abs=1e-6)


@pytest.mark.parametrize("ratio, score", [(0.7, 0), (0.85, 50), (1.2, 100), (0.2, 0)])
def test_kept_share(spark, ratio, score):
    assert one(spark, scores.kept_share("m", 1.0, F.col("r"))["score"], r=ratio) == pytest.approx(score)


@pytest.mark.parametrize("now, base, score", [(1.0, 0.0, 100), (-1.0, 0.0, 0), (0.0, 0.0, None)])
def test_zero_baseline(spark, now, base, score):
    got = one(spark, scores.kept_share("m", 1.0, scores.share(F.col("n"), F.col("b"))), n=now, b=base)
    assert (got and got["score"]) == score


@pytest.mark.parametrize("gap, sided, score", [(15.0, "both", 0), (7.5, "both", 50), (-7.5, "both", 50), (-7.5, "above", 100), (7.5, "above", 50), (-7.5, "signed", 50)])
def test_drift(spark, gap, sided, score):
    got = one(spark, scores.drift("m", 1.0, F.col("n"), F.col("b"), 15, sided), n=gap, b=0.0)
    assert got["score"] == pytest.approx(score)
    assert got["deviation"] == (abs(gap) if sided == "both" else gap)


def test_angles_do_not_wrap(spark):
    assert one(spark, scores.drift("m", 1.0, F.col("n"), F.col("b"), 15)["deviation"], n=-179.0, b=179.0) == 358


@pytest.mark.parametrize("value, status", [(74.5, "good"), (74.49, "fair"), (39.5, "fair"), (39.49, "poor")])
def test_status_of_rounded_score(spark, value, status):
    parts = F.array(F.struct(F.col("v").alias("score"), F.lit(1.0).alias("weight")))
    assert one(spark, scores.status_of(scores.weighted(parts)), v=value) == status


def test_same_frame_scores_100(spark):
    df = frames(spark, pose(FRONT))
    got = scoring.evaluated(scoring.measured(df, df, "front"), None).first()
    assert (got["score"], got["status"], {p["score"] for p in got["parts"]}) == (100, "good", {100.0})
    assert len(got["parts"]) == len(scores.PART_NAMES["front"])


def test_gates(spark):
    blind = pose({"nose": (1, 1)})
    cal = frames(spark, pose(FRONT))
    seen = frames(spark, blind).unionAll(frames(spark, pose(FRONT), user=2, start=5))
    rows = scoring.evaluated(scoring.measured(seen, cal, "front"), None).collect()
    assert {(r["user_id"], r["status"], r["score"]) for r in rows} == {(1, "no_data", None), (2, "not_calibrated", None)}


def test_baseline_takes_metrics_of_the_first_measured_frame(spark):
    first = pose({k: v for k, v in FRONT.items() if k != "nose"})
    df = frames(spark, pose({}), first, pose(FRONT), pose(FRONT))
    rows = {r["metric"]: r for r in baseline.long_baseline(df, "front").collect()}
    assert "nose_shoulder_vertical_ratio" not in rows and "shoulder_width" in rows
    assert rows["shoulder_width"]["stddev"] == 0.0


def test_baseline_of_one_frame_has_no_deviation(spark):
    rows = baseline.long_baseline(frames(spark, pose(FRONT)), "front").collect()
    assert len(rows) == len(METRICS["front"]) and all(r["stddev"] is None for r in rows)


def test_failed_calibration(spark):
    df = frames(spark, pose({})).unionAll(frames(spark, pose(FRONT), user=2))
    assert [r["user_id"] for r in baseline.failed_calibrations(df, "front").collect()] == [1]


def test_corner_angle(spark):
    def at(x, y):
        return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))

    got = spark.range(1).select(geometry.corner_angle(at(1, 0), at(0, 0), at(0, 1)).alias("x")).first()["x"]
    assert got == pytest.approx(90)
