"""Posture analytics on Spark: keypoints to metrics, scores, streaks, rollups and dashboards."""
