"""Fixed values of the model: landmarks, thresholds, weights and spans, and default settings."""

from __future__ import annotations

#: Landmark ids of a pose, by name; the array of keypoints is in this order.
LANDMARKS = (
    "nose", "l_eye", "r_eye", "l_ear", "r_ear", "l_shoulder", "r_shoulder", "l_elbow", "r_elbow",
    "l_wrist", "r_wrist", "l_hip", "r_hip", "l_knee", "r_knee", "l_ankle", "r_ankle",
)
#: Least confidence of a landmark that counts.
MIN_CONFIDENCE = 0.3
#: Least distance of the shoulders in a front frame, and what a side frame's torso must exceed, in pixels.
MIN_SHOULDERS, MIN_TORSO = 1.0, 1.0

FRONT_METRICS = (
    "shoulder_slope_deg", "nose_shoulder_vertical_ratio", "nose_horizontal_offset", "head_tilt_deg",
    "left_ear_shoulder_vertical", "right_ear_shoulder_vertical", "torso_inclination_deg", "shoulder_width",
)
SIDE_METRICS = ("neck_inclination_deg", "torso_inclination_deg", "ear_shoulder_hip_angle", "head_forward_offset")
METRICS = {"front": FRONT_METRICS, "side": SIDE_METRICS}

#: Frames of a calibration.
CALIBRATION_FRAMES = 5
#: Score from which a posture is good, and from which it is fair.
GOOD, FAIR = 75, 40
#: Poor checks in a row before an alert.
POOR_BEFORE_ALERT = 2
#: Checks that are kept, and days that summaries are kept.
KEPT_CHECKS, KEPT_DAYS = 200, 90
#: Shortest period between checks and length of a snooze, in seconds.
MIN_PERIOD, SNOOZE = 30, 300

#: Settings that a user has not stored.
DEFAULTS: dict[str, str | None] = {
    "monitoring_enabled": "false", "check_interval_seconds": "60", "keep_stream_open": "true", "alert_mode": "notification",
    "notify_on_poor": "true", "notify_on_recovery": "true", "poor_threshold": "40", "good_threshold": "75",
    "consecutive_poor_before_alert": "2", "blur_intensity": "5", "blur_auto_remove": "true", "front_camera_id": None,
    "side_camera_id": None, "capture_width": "640", "capture_height": "480",
}

#: Modes that lay something over a page.
OVERLAYS = ("blur", "bananas")
#: Texts of alerts and praises.
WILD_TITLE, WILD_MESSAGE = "Posture alarm", "Sit up straight!"
POOR_MESSAGES = ("Sit up, shoulders back.", "Chin in, chest up.", "Time to reset your posture.", "Your back asks for a stretch.", "You lean forward: straighten up.")
GOOD_MESSAGES = ("Well done, keep it up.", "You sit tall again.", "Your back thanks you.")
