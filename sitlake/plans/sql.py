"""DuckDB SQL that gives the same rows as the queries of the catalogue."""

from __future__ import annotations

from ..functions.constants import (
    CALIBRATION_FRAMES, DEFAULTS, GOOD_MESSAGES, KEPT_CHECKS, LANDMARKS, METRICS, MIN_PERIOD, POOR_MESSAGES, SNOOZE, WILD_MESSAGE, WILD_TITLE,
)
from ..sources.tables import REACH, TEMPLATE

#: Where phones are paired in the links of pairing_links.
PAIR_PAGE, PAIR_CODE = "https://example.org/pair", "https://example.org/code?size=200x200&data="
CHECKS = """checks AS (
  SELECT user_id, event_id AS seq, ts, s AS score, CASE WHEN s >= 75 THEN 'good' WHEN s >= 40 THEN 'fair' ELSE 'poor' END AS status
  FROM (SELECT *, CAST(round(least(100.0, greatest(0.0, value))) AS INTEGER) AS s FROM events WHERE value IS NOT NULL))"""
STREAKS = (
    CHECKS
    + """, t0 AS (
  SELECT *, status = 'poor' AS poor, row_number() OVER w AS no, coalesce((lag(status) OVER w = 'poor') <> (status = 'poor'), true) AS turn
  FROM {source} {on} WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq)),
t1 AS (SELECT *, max(CASE WHEN turn THEN no END) OVER w AS start_no, max(CASE WHEN turn THEN ts END) OVER w AS streak_started_at
  FROM t0 WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
t2 AS (SELECT *, CASE WHEN poor THEN no - start_no + 1 ELSE 0 END AS consecutive_poor FROM t1),
streaks AS (SELECT *, poor AND consecutive_poor >= {needed} AND {poor_ok} AS alert,
  coalesce(lag(consecutive_poor) OVER (PARTITION BY {keys} ORDER BY ts, seq), 0) >= {needed} AND status = 'good' AND {good_ok} AS recovery FROM t2)"""
)
PLAIN = {"on": "", "needed": "2", "poor_ok": "true", "good_ok": "true", "source": "checks"}
OWN = {"on": "JOIN judged USING (user_id)", "needed": "needed", "poor_ok": "notify_poor", "good_ok": "notify_recovery", "source": "checks"}
JUDGED = """judged AS (SELECT user_id, consecutive_poor_before_alert::INTEGER AS needed, notify_on_poor = 'true' AS notify_poor, notify_on_recovery = 'true' AS notify_recovery,
  alert_mode AS mode, blur_auto_remove = 'true' AS auto_remove FROM settings)"""
CONTROLS = """controls AS (SELECT * FROM (SELECT user_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'stop' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'snooze'
  WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'dismiss' ELSE 'fixed' END END AS kind FROM events) WHERE kind IS NOT NULL)"""
OFF = "('stop', 'dismiss', 'fixed', 'snooze')"
BY_USER = STREAKS.format(keys="user_id", **PLAIN)
DAILY = (
    CHECKS
    + """, days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS total_checks, count(*) FILTER (status = 'good') AS good_checks,
    count(*) FILTER (status = 'fair') AS fair_checks, count(*) FILTER (status = 'poor') AS poor_checks, CAST(sum(score) AS BIGINT) AS total_score,
    CAST(round(sum(score) / count(*)) AS INTEGER) AS average_score FROM checks GROUP BY ALL)"""
)
DAY_COLUMNS = "user_id, day, total_checks, good_checks, fair_checks, poor_checks, total_score, average_score"
STREAK_COLUMNS = "user_id, seq, ts, score, status, consecutive_poor, status AS streak_type, streak_started_at, alert, recovery"


def points(role: str, covered: bool = False) -> str:
    """Columns x, y and confidence of each landmark, null below the least confidence; some users' cameras may be covered."""
    out = []
    for i, name in enumerate(LANDMARKS):
        if name in TEMPLATE[role]:
            x, y = TEMPLATE[role][name]
            e = [f"CAST(embedding[{3 * i + k + 1}] AS DOUBLE)" for k in range(3)]
            sure = f"0.5 + {e[2]} >= 0.3" + (f" AND NOT ({HIDDEN[role]})" if covered else "")
            out += [f"CASE WHEN {sure} THEN {x} + {REACH} * {e[0]} END AS {name}_x", f"CASE WHEN {sure} THEN {y} + {REACH} * {e[1]} END AS {name}_y"]
    return f"{role}_points AS (SELECT CAST(label AS BIGINT) AS user_id, vec_id AS frame_id, {', '.join(out)} FROM embeddings)"


HIDDEN = {"front": "label % 4 = 3", "side": "label % 3 = 1"}


def metrics(role: str, covered: bool = False) -> str:
    """Frames that can be measured, with their metrics."""
    if role == "front":
        span = "sqrt((l_shoulder_x - r_shoulder_x) * (l_shoulder_x - r_shoulder_x) + (l_shoulder_y - r_shoulder_y) * (l_shoulder_y - r_shoulder_y))"
        body = f"""front_m AS (SELECT user_id, frame_id,
  degrees(atan2(r_shoulder_y - l_shoulder_y, r_shoulder_x - l_shoulder_x)) AS shoulder_slope_deg,
  ((l_shoulder_y + r_shoulder_y) / 2 - nose_y) / span AS nose_shoulder_vertical_ratio, (nose_x - (l_shoulder_x + r_shoulder_x) / 2) / span AS nose_horizontal_offset,
  degrees(atan2(r_eye_y - l_eye_y, r_eye_x - l_eye_x)) AS head_tilt_deg,
  (l_shoulder_y - l_ear_y) / span AS left_ear_shoulder_vertical, (r_shoulder_y - r_ear_y) / span AS right_ear_shoulder_vertical,
  degrees(atan2((l_shoulder_x + r_shoulder_x) / 2 - (l_hip_x + r_hip_x) / 2, (l_hip_y + r_hip_y) / 2 - (l_shoulder_y + r_shoulder_y) / 2)) AS torso_inclination_deg,
  span AS shoulder_width
  FROM (SELECT *, {span} AS span FROM front_points) WHERE span >= 1)"""
    else:
        pick = ", ".join(f"coalesce(l_{n}_{c}, r_{n}_{c}) AS {n}_{c}" for n in ("ear", "shoulder", "hip") for c in "xy")
        torso = "sqrt((sh_x - hip_x) * (sh_x - hip_x) + (sh_y - hip_y) * (sh_y - hip_y))"
        body = f"""side_m AS (SELECT user_id, frame_id, degrees(atan2(abs(ear_x - sh_x), sh_y - ear_y)) AS neck_inclination_deg,
  degrees(atan2(abs(sh_x - hip_x), hip_y - sh_y)) AS torso_inclination_deg,
  degrees(atan2((ear_x - sh_x) * (hip_y - sh_y) - (ear_y - sh_y) * (hip_x - sh_x), (ear_x - sh_x) * (hip_x - sh_x) + (ear_y - sh_y) * (hip_y - sh_y))) AS ear_shoulder_hip_angle,
  CASE WHEN {torso} > 1 THEN (nose_x - sh_x) / {torso} END AS head_forward_offset
  FROM (SELECT user_id, frame_id, nose_x, nose_y, {pick.replace(" AS shoulder_", " AS sh_")} FROM side_points) WHERE sh_x IS NOT NULL)"""
    return f"{points(role, covered)}, {body}"


def baseline(role: str) -> str:
    """One row per user: means of the metrics of the first measured frame, and deviations."""
    names = METRICS[role]
    own = ", ".join(
        f"CASE WHEN arg_min({{'v': {n}}}, frame_id).v IS NOT NULL THEN list_reduce(list({n} ORDER BY frame_id) FILTER ({n} IS NOT NULL), lambda a, b: a + b) / count({n}) END AS {n}, "
        f"CASE WHEN arg_min({{'v': {n}}}, frame_id).v IS NOT NULL AND count({n}) > 1 THEN stddev_pop({n}) END AS {n}_sd"
        for n in names
    )
    return f"""{role}_cal AS (SELECT user_id, frame_id FROM (SELECT user_id, frame_id, row_number() OVER (PARTITION BY user_id ORDER BY frame_id) AS no FROM {role}_points) WHERE no <= {CALIBRATION_FRAMES}),
{role}_b AS (SELECT user_id, {own} FROM {role}_m JOIN {role}_cal USING (user_id, frame_id) GROUP BY user_id)"""


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


def _kept(ratio: str) -> tuple[str, str]:
    return _clamp(f"({ratio} - 0.7) / 0.3 * 100"), f"1 - {ratio}"


def parts(role: str) -> list[tuple[str, float, str, str, str]]:
    """(metric, weight, condition, score, deviation) of a role's components, in order; m and b are the sides of the join."""

    def there(n: str) -> str:
        return f"m.{n} IS NOT NULL AND b.{n} IS NOT NULL"

    def gap(name: str, weight: float, n: str, span: float, cost: str = "abs({})", shown: str = "{}"):
        d = f"(m.{n} - b.{n})"
        return name, weight, there(n), f"greatest(0.0, 100 - {cost.format(d)} / {span} * 100)", shown.format(d)

    if role == "side":
        above = "greatest(0.0, {})"
        return [gap("neckInclination", 3.0, "neck_inclination_deg", 20, above), gap("torsoInclination", 2.0, "torso_inclination_deg", 25), gap("headForwardOffset", 2.5, "head_forward_offset", 0.25, above)]
    left, right = (f"(m.{s}_ear_shoulder_vertical / b.{s}_ear_shoulder_vertical)" for s in ("left", "right"))
    ears = f"(CASE WHEN {left} IS NOT NULL AND {right} IS NOT NULL THEN ({left} + {right}) / 2 ELSE coalesce({left}, {right}) END)"
    nose = "(m.nose_shoulder_vertical_ratio / b.nose_shoulder_vertical_ratio)"
    return [
        gap("shoulderSlope", 1.0, "shoulder_slope_deg", 15, shown="abs({})"),
        ("verticalSlouch", 2.5, f"{nose} IS NOT NULL", *_kept(nose)),
        gap("headCentering", 0.8, "nose_horizontal_offset", 0.3, shown="abs({})"),
        gap("headTilt", 0.8, "head_tilt_deg", 20, shown="abs({})"),
        ("earShoulderAlignment", 1.5, f"{ears} IS NOT NULL", *_kept(ears)),
    ]


def scored(role: str) -> str:
    """Weighted sums and weights per frame, and each component's columns."""
    own = parts(role)
    cols = ", ".join(f"CASE WHEN {c} THEN {s} END AS {n}_score, CASE WHEN {c} THEN {d} END AS {n}_dev" for n, _, c, s, d in own)
    return f"""{role}_s AS (SELECT f.user_id, f.frame_id, b.user_id IS NOT NULL AS calibrated, {cols}
  FROM {role}_points f LEFT JOIN {role}_m m USING (user_id, frame_id) LEFT JOIN {role}_b b ON b.user_id = f.user_id)"""


def result(roles: list[str]) -> str:
    """score and status from the components of some roles, joined on the frame as s."""
    own = [(n, w) for r in roles for n, w, *_ in parts(r)]
    total = " + ".join(["0.0", *(f"coalesce({n}_score * {w}::DOUBLE, 0.0)" for n, w in own)])
    weight = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {n}_score IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for n, w in own)])
    joined = f"{roles[0]}_s" if len(roles) == 1 else "front_s FULL JOIN side_s USING (user_id, frame_id)"
    calibrated = " OR ".join(f"coalesce({r}_s.calibrated, false)" for r in roles)
    return f"""scored AS (SELECT *, CASE WHEN NOT cal THEN 'not_calibrated' WHEN score IS NULL THEN 'no_data' WHEN score >= 75 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS status
  FROM (SELECT *, CASE WHEN weight > 0 THEN CAST(round({_clamp("total / weight")}) AS INTEGER) END AS score
    FROM (SELECT * EXCLUDE (calibrated), {calibrated} AS cal, {total} AS total, {weight} AS weight FROM {joined})))""".replace("* EXCLUDE (calibrated)", "*" if len(roles) == 1 else "*")


def pipeline(*roles: str) -> str:
    return ", ".join(x for r in roles for x in (metrics(r), baseline(r), scored(r)))


def breakdown(roles: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT user_id, frame_id, '{n}' AS metric, round({n}_score, 6) AS part_score, {w}::DOUBLE AS weight, round({n}_dev, 6) AS deviation FROM {r}_s WHERE {n}_score IS NOT NULL"
        for r in roles
        for n, w, *_ in parts(r)
    )


def long_baseline(role: str) -> str:
    return " UNION ALL ".join(f"SELECT user_id, '{role}' AS role, '{n}' AS metric, round({n}, 6) AS mean, round({n}_sd, 6) AS stddev FROM {role}_b WHERE {n} IS NOT NULL" for n in METRICS[role])


def keypoints(role: str) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(label AS BIGINT) AS user_id, vec_id AS frame_id, '{role}' AS role, {i} AS landmark, {x} + {REACH} * embedding[{3 * i + 1}]::DOUBLE AS x, {y} + {REACH} * embedding[{3 * i + 2}]::DOUBLE AS y, 0.5 + embedding[{3 * i + 3}]::DOUBLE AS score "
        f"FROM embeddings WHERE 0.5 + embedding[{3 * i + 3}]::DOUBLE >= 0.3"
        for i, n in enumerate(LANDMARKS)
        if n in TEMPLATE[role]
        for x, y in [TEMPLATE[role][n]]
    )


def rounded(role: str) -> str:
    return ", ".join(["user_id", "frame_id", *(f"round({n}, 6) AS {n}" for n in METRICS[role])])


STORED_SETTINGS = """stored AS (SELECT user_id, event_id AS seq, ts,
  ['check_interval_seconds', 'alert_mode', 'blur_intensity', 'notify_on_poor', 'consecutive_poor_before_alert', 'notify_on_recovery', 'blur_auto_remove', 'front_camera_id',
   'side_camera_id', 'monitoring_enabled'][event_id % 10 + 1] AS key,
  CASE event_id % 10 WHEN 0 THEN CAST(10 + event_id % 290 AS VARCHAR) WHEN 1 THEN CASE event_id % 3 WHEN 0 THEN 'blur' WHEN 1 THEN 'bananas' ELSE 'notification' END
    WHEN 2 THEN CAST(event_id // 10 % 10 AS VARCHAR) WHEN 4 THEN CAST(1 + event_id // 10 % 4 AS VARCHAR)
    WHEN 7 THEN CASE WHEN event_id // 10 % 4 = 0 THEN '' ELSE 'camera-' || (event_id // 10 % 3) END WHEN 8 THEN CASE WHEN event_id // 10 % 4 = 0 THEN '' ELSE 'camera-' || (event_id // 10 % 3) END
    ELSE CASE WHEN event_id // 10 % 3 = 0 THEN 'false' ELSE 'true' END END AS value
  FROM events WHERE event_type = 'click')"""


def settings() -> str:
    last = ", ".join(f"arg_max(value, {{'ts': ts, 'seq': seq}}) FILTER (key = '{k}') AS {k}" for k in DEFAULTS)
    shown = ", ".join(f"coalesce(f.{k}, {'NULL' if v is None else repr(v)}) AS {k}" for k, v in DEFAULTS.items())
    return f"{STORED_SETTINGS}, users AS (SELECT DISTINCT user_id FROM events), found AS (SELECT user_id, {last} FROM stored GROUP BY user_id), settings AS (SELECT users.user_id, {shown} FROM users LEFT JOIN found f USING (user_id))"


def oracle(asof: str, late: str) -> dict[str, str]:
    colour = "CASE status WHEN 'good' THEN '#4CAF50' WHEN 'fair' THEN '#FF9800' ELSE '#F44336' END"
    latest = f"latest AS (SELECT user_id, ts AS last_check_at, score AS last_score, status, {colour} AS colour FROM checks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) = 1)"
    compat = "SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(sum(score) AS BIGINT) AS score_sum, greatest(count(*) FILTER (run > 0), 1) AS n FROM (SELECT *, sum(score) OVER (PARTITION BY user_id, CAST(ts AS DATE), hour(ts) ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM checks) GROUP BY ALL"
    calibrations = "calibrations AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'front' ELSE 'side' END AS role, ts AS calibrated_at, event_id AS seq, round(value, 6) AS mean FROM events WHERE event_type = 'view' AND value IS NOT NULL)"
    session_checks = """sessions AS (SELECT * FROM (SELECT *, sum(stop) OVER (PARTITION BY user_id ORDER BY ts, stop DESC, seq ROWS UNBOUNDED PRECEDING) AS session_id FROM (
  SELECT user_id, seq, ts, score, status, 0 AS stop FROM checks UNION ALL SELECT user_id, event_id, ts, NULL, NULL, 1 FROM events WHERE event_type = 'signup')) WHERE stop = 0)"""
    def in_sessions(kind: dict[str, str]) -> str:
        return STREAKS.format(keys="user_id, session_id", **kind | {"source": "sessions"}).replace(", t0 AS (", f", {session_checks}, t0 AS (", 1)

    by_session, own = in_sessions(PLAIN), f"{settings()}, {JUDGED}, {STREAKS.format(keys='user_id', **OWN)}"
    turn = "CASE WHEN alert AND mode IN ('blur', 'bananas'){} THEN true WHEN status <> 'poor' AND auto_remove THEN false END"
    covered = ", ".join(x for r in ("front", "side") for x in (metrics(r, True), baseline(r)))
    any_role = "calibrated AS (SELECT user_id FROM front_b UNION SELECT user_id FROM side_b)"
    camera = "coalesce(front_camera_id, '') <> '' OR coalesce(side_camera_id, '') <> ''"

    def texts(values: tuple[str, ...]) -> str:
        return f"[{', '.join(repr(v) for v in values)}][seq % {len(values)} + 1]"

    period = f"greatest(check_interval_seconds::INTEGER, {MIN_PERIOD})"
    schedule = f"""l AS (SELECT user_id, max(ts) AS last FROM checks GROUP BY user_id),
  c AS (SELECT user_id, max(ts) FILTER (kind = 'fixed') AS fixed, max(ts) FILTER (kind = 'snooze') AS snoozed FROM controls GROUP BY user_id),
  m AS (SELECT user_id, max(ts) AS manual FROM events WHERE event_type = 'view' AND value < 30 GROUP BY user_id),
  s0 AS (SELECT user_id, {period} AS period_seconds, CASE WHEN coalesce(snoozed >= last, snoozed IS NOT NULL) THEN snoozed + to_seconds({SNOOZE}) ELSE last + to_seconds({period}) END AS regular_at,
    CASE WHEN coalesce(fixed >= last, fixed IS NOT NULL) THEN fixed + to_seconds(10) END AS re, CASE WHEN coalesce(manual >= last, manual IS NOT NULL) THEN manual END AS now_
    FROM settings LEFT JOIN l USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN m USING (user_id))"""
    # overlays and starts in sessions: the last mark of a session's checks and controls
    stream = f"""{settings()}, {JUDGED}, {in_sessions(OWN)}, {CONTROLS},
marks AS (SELECT user_id, seq, ts, 1 AS chk, {turn.format("")} AS turn, NULL AS began FROM streaks UNION ALL
  SELECT user_id, seq, ts, 0, CASE WHEN kind IN {OFF} THEN false END, CASE kind WHEN 'start' THEN {{'at': ts}} WHEN 'stop' THEN {{'at': NULL::TIMESTAMP}} END FROM controls),
shown AS (SELECT *, last_value(CASE WHEN turn IS NOT NULL THEN {{'on': turn, 'seq': seq}} END IGNORE NULLS) OVER w AS o, last_value(began IGNORE NULLS) OVER w AS b FROM marks
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, chk, seq ROWS UNBOUNDED PRECEDING))
SELECT {STREAK_COLUMNS}, b.at AS started_at, score AS last_score, ts AS last_check_at, coalesce(o.on, false) AS overlay_active, CASE WHEN o.on THEN o.seq END AS overlay_seq
FROM streaks JOIN (SELECT user_id, seq, o, b FROM shown WHERE chk = 1) USING (user_id, seq)"""
    front, side, both = pipeline("front"), pipeline("side"), pipeline("front", "side")
    frames = "SELECT CAST(label AS BIGINT) AS user_id, vec_id AS frame_id"
    out = {
        "frames_scan": f"{frames}, 'front' AS role, 640 AS width, 480 AS height FROM embeddings UNION ALL {frames}, 'side', 640, 480 FROM embeddings",
        "pose_frames": f"WITH {points('front')}, {points('side')} {frames}, round(320 + 120.0 * embedding[1]::DOUBLE, 6) AS front_nose_x, round(360 + 120.0 * embedding[1]::DOUBLE, 6) AS side_nose_x FROM embeddings",
        "confident_keypoints": f"SELECT user_id, frame_id, role, landmark, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score FROM ({keypoints('front')} UNION ALL {keypoints('side')})",
        "front_metrics": f"WITH {metrics('front')} SELECT {rounded('front')} FROM front_m",
        "side_metrics": f"WITH {metrics('side')} SELECT {rounded('side')} FROM side_m",
        "baseline": f"WITH {both} SELECT user_id, role, metric, mean FROM ({long_baseline('front')} UNION ALL {long_baseline('side')})",
        "baseline_stddev": f"WITH {both} SELECT user_id, role, metric, stddev FROM ({long_baseline('front')} UNION ALL {long_baseline('side')})",
        "calibration_latest": f"WITH {calibrations} SELECT user_id, role, calibrated_at, mean, 1 AS version FROM calibrations QUALIFY row_number() OVER (PARTITION BY user_id, role ORDER BY calibrated_at DESC, seq DESC) = 1",
        "calibration_failures": f"WITH {covered} SELECT DISTINCT user_id, 'front' AS role FROM front_cal WHERE user_id NOT IN (SELECT user_id FROM front_b) UNION ALL SELECT DISTINCT user_id, 'side' FROM side_cal WHERE user_id NOT IN (SELECT user_id FROM side_b)",
        "eligible_users": f"WITH {settings()}, {covered}, {any_role} SELECT user_id FROM settings WHERE user_id IN (SELECT user_id FROM calibrated) AND ({camera})",
        "uncalibrated_users": f"WITH {covered}, {any_role} SELECT user_id FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM calibrated)",
        "front_scores": f"WITH {front}, {result(['front'])} SELECT user_id, frame_id, score, status FROM scored",
        "side_scores": f"WITH {side}, {result(['side'])} SELECT user_id, frame_id, score, status FROM scored",
        "front_side_combined": f"WITH {both} SELECT user_id, frame_id, CAST(({' + '.join(f'({n}_score IS NOT NULL)::INTEGER' for n, *_ in parts('front'))}) AS INTEGER) AS front_parts, CAST(({' + '.join(f'({n}_score IS NOT NULL)::INTEGER' for n, *_ in parts('side'))}) AS INTEGER) AS side_parts FROM front_s FULL JOIN side_s USING (user_id, frame_id)",
        "score_breakdown": f"WITH {both} {breakdown(['front', 'side'])}",
        "posture_score": f"WITH {both}, {result(['front', 'side'])} SELECT user_id, frame_id, score, status FROM scored WHERE score IS NOT NULL",
        "score_status_all": f"WITH {both}, {result(['front', 'side'])} SELECT status, count(*) AS n FROM scored GROUP BY status",
        "checks": f"WITH {CHECKS} SELECT * FROM checks",
        "status_distribution": f"WITH {CHECKS} SELECT status, count(*) AS n, round(avg(score), 6) AS mean_score FROM checks GROUP BY status",
        "streaks": f"WITH {BY_USER} SELECT {STREAK_COLUMNS} FROM streaks",
        "stream_session": f"WITH {stream}",
        "streaks_by_session": f"WITH {by_session} SELECT session_id, {STREAK_COLUMNS} FROM streaks",
        "alerts": f"WITH {own} SELECT user_id, seq, ts, 'alert' AS kind, mode, score, CASE mode WHEN 'bananas' THEN '{WILD_TITLE}' ELSE 'Posture score ' || score || '/100' END AS title, CASE mode WHEN 'bananas' THEN 'Score: ' || score || '/100. {WILD_MESSAGE}' ELSE {texts(POOR_MESSAGES)} END AS message FROM streaks WHERE alert",
        "latest_alert": f"WITH {own} SELECT user_id, seq, ts, score FROM streaks WHERE alert QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) = 1",
        "recoveries": f"WITH {own} SELECT user_id, seq, ts, 'praise' AS kind, score, {texts(GOOD_MESSAGES)} AS message FROM streaks WHERE recovery",
        "overlay_state": f"WITH {own} SELECT user_id, seq, ts, coalesce(last_value({turn.format(' AND seq % 7 <> 0')} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), false) AS overlay_active FROM streaks",
        "overlay_with_controls": f"WITH {own}, {CONTROLS}, turns AS (SELECT user_id, seq, ts, {turn.format('')} AS turn, 1 AS chk FROM streaks UNION ALL SELECT user_id, seq, ts, false, 0 FROM controls WHERE kind IN {OFF}) SELECT user_id, seq, ts, overlay_active FROM (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, chk, seq ROWS UNBOUNDED PRECEDING), false) AS overlay_active FROM turns) WHERE chk = 1",
        "side_source": f"{frames}, CASE WHEN vec_id % 3 <> 0 THEN 'local' WHEN vec_id % 2 = 0 THEN 'phone' END AS source, CASE WHEN vec_id % 3 <> 0 OR vec_id % 2 = 0 THEN round(360 + 120.0 * embedding[1]::DOUBLE, 6) END AS nose_x FROM embeddings",
        "check_schedule": f"WITH {settings()}, {CHECKS}, {CONTROLS}, {schedule} SELECT user_id, period_seconds, regular_at, least(regular_at, re, now_) AS due_at, CASE least(regular_at, re, now_) WHEN now_ THEN 'manual' WHEN re THEN 'recheck' WHEN regular_at THEN 'regular' END AS trigger FROM s0",
        "camera_labels": "SELECT 'device-' || s_suppkey AS device_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Camera ' || substr('device-' || s_suppkey, 1, 8) ELSE s_name END AS label FROM supplier WHERE s_suppkey % 5 <> 0",
        "delivery_targets": "WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'about:blank' ELSE url END AS url, CAST(floor(page_id / 10) AS BIGINT) AS screen FROM pages), g AS (SELECT screen, arg_min(url, page_id) AS f, arg_min(url, page_id) FILTER (regexp_matches(url, '^https?://')) AS w FROM p GROUP BY screen) SELECT screen, CASE WHEN NOT regexp_matches(f, '^(chrome|chrome-extension|edge|about|devtools):') THEN f ELSE w END AS url FROM g",
        "next_check": f"WITH {settings()}, {CHECKS}, {CONTROLS}, {schedule} SELECT user_id, CASE WHEN monitoring_enabled = 'true' AND regular_at IS NOT NULL THEN greatest(0, CAST(round((epoch_us(regular_at) - epoch_us(TIMESTAMP '{asof} 00:00:00')) / 1e6) AS INTEGER)) END AS seconds FROM settings JOIN s0 USING (user_id)",
        "score_ring": f"WITH {CHECKS} SELECT user_id, seq, CASE status WHEN 'good' THEN 'Good' WHEN 'fair' THEN 'Fair' ELSE 'Poor' END AS label, {colour} AS colour, round(2 * pi() * 52 - score / 100 * (2 * pi() * 52), 6) AS dash_offset FROM checks",
        "current_streak": f"WITH {BY_USER} SELECT user_id, streak_type, streak_started_at, minutes, CASE WHEN minutes < 60 THEN minutes || 'm' ELSE (minutes // 60) || 'h' || (minutes % 60) || 'm' END AS shown FROM (SELECT user_id, status AS streak_type, streak_started_at, CAST(round((epoch_us(TIMESTAMP '{asof} 00:00:00') - epoch_us(streak_started_at)) / 60e6) AS BIGINT) AS minutes FROM streaks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) = 1)",
        "latest_status": f"WITH {CHECKS}, {latest} SELECT * FROM latest",
        "snooze_filter": f"WITH {CHECKS} SELECT user_id, seq, ts, score, status FROM checks c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = c.user_id AND e.ts <= c.ts AND epoch_us(c.ts) - epoch_us(e.ts) < {SNOOZE * 1_000_000})",
        "daily_summary": f"WITH {DAILY} SELECT {DAY_COLUMNS} FROM days",
        "stream_daily": f"WITH {DAILY} SELECT {DAY_COLUMNS} FROM days",
        "hourly_summary": f"WITH {CHECKS} SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(sum(score) AS BIGINT) AS score_sum, count(*) AS n FROM checks GROUP BY ALL",
        "hourly_summary_compat": f"WITH {CHECKS} {compat}",
        "recent_checks": f"WITH {CHECKS} SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS INTEGER) AS rank FROM checks QUALIFY rank <= {KEPT_CHECKS}",
        "recent_checks_short": f"WITH {CHECKS} SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, seq DESC) AS INTEGER) AS rank FROM checks QUALIFY rank <= 20",
        "retained_days": f"WITH {DAILY} SELECT {DAY_COLUMNS} FROM days WHERE day >= DATE '{late}' - 90",
        "today_stats": f"WITH {DAILY} SELECT user_id, day, total_checks, CAST(round(good_checks / total_checks * 100) AS INTEGER) AS good_percent, average_score FROM days WHERE day = DATE '{asof}'",
        "seven_day_chart": f"WITH {DAILY}, spine AS (SELECT user_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(DATE '{asof}' - 6, DATE '{asof}', INTERVAL 1 DAY)) AS d)) SELECT user_id, day, strftime(day, '%m-%d') AS label, average_score, CASE WHEN average_score >= 75 THEN 'good' WHEN average_score >= 40 THEN 'fair' WHEN average_score IS NOT NULL THEN 'poor' END AS band FROM spine LEFT JOIN days USING (user_id, day)",
        "settings_effective": f"WITH {settings()} SELECT * FROM settings",
        "settings_map": f"WITH {settings()} SELECT user_id, key, value FROM settings UNPIVOT (value FOR key IN ({', '.join(DEFAULTS)}))",
        "settings_merged": f"WITH {settings()} SELECT user_id, key, value FROM settings UNPIVOT (value FOR key IN ({', '.join(DEFAULTS)}))",
        "status_snapshot": f"WITH {settings()}, {CHECKS}, {latest}, {CONTROLS}, {schedule}, {covered}, {any_role} SELECT user_id, alert_mode, period_seconds, last_score, status, user_id IN (SELECT user_id FROM calibrated) AS is_calibrated, monitoring_enabled = 'true' AS is_scheduled, CASE WHEN monitoring_enabled = 'true' THEN regular_at END AS next_check_at FROM settings LEFT JOIN latest USING (user_id) JOIN s0 USING (user_id)",
        "result_log": f"WITH {both}, {result(['front', 'side'])} SELECT user_id, frame_id, '{{\"score\":null,\"status\":\"' || status || '\"}}' AS line FROM scored WHERE score IS NULL",
        "pairing_links": f"SELECT 'peer ' || s_suppkey AS peer_id, '{PAIR_PAGE}/#peer=peer ' || s_suppkey AS link, '{PAIR_CODE}' || url_encode('{PAIR_PAGE}/#peer=peer ' || s_suppkey) AS code_url FROM supplier",
        "stream_hourly": f"WITH {CHECKS} SELECT user_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(sum(score) AS BIGINT) AS score_sum, count(*) AS n FROM checks GROUP BY ALL",
    }
    return out

