"""Streaks, alerts and recoveries over a user's checks in order of arrival (ts, seq).

All of a user's state comes from windows over the same keys, so one exchange and one sort serve them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import DEFAULTS, GOOD_MESSAGES, OVERLAYS, POOR_BEFORE_ALERT, POOR_MESSAGES, WILD_MESSAGE, WILD_TITLE


def judged(checks: DataFrame, typed: DataFrame) -> DataFrame:
    """checks with their user's settings (needed, notify_poor, notify_recovery, mode, auto_remove); users without any have the defaults.

    Joined on the key that the windows over checks need anyway.
    """
    base = {"needed": POOR_BEFORE_ALERT, "notify_poor": True, "notify_recovery": True, "mode": DEFAULTS["alert_mode"], "auto_remove": True}
    rows = checks.join(typed, "user_id", "left")
    return rows.select(*checks.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in base.items()])


def with_streaks(
    checks: DataFrame, keys: tuple[str, ...] = ("user_id",), needed: int | Column = POOR_BEFORE_ALERT, notify_poor: bool | Column = True, notify_recovery: bool | Column = True
) -> DataFrame:
    """checks with consecutive_poor, streak_type, streak_started_at, alert and recovery.

    Poor checks in a row count up, any other sets the count to 0.  Good and fair share one streak.  Every
    poor check from the ``needed``-th on alerts if notify_poor; a good check right after so many recovers if
    notify_recovery.  The three may be columns of checks, as judged() gives.
    """
    needed, notify_poor, notify_recovery = (x if isinstance(x, Column) else F.lit(x) for x in (needed, notify_poor, notify_recovery))
    order = Window.partitionBy(*keys).orderBy("ts", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    poor = F.col("status") == "poor"
    turned = F.coalesce(F.lag(poor).over(order) != poor, F.lit(True))
    rows = checks.withColumn("_poor", poor).withColumn("_no", F.row_number().over(order)).withColumn("_turn", turned)
    rows = rows.withColumn("_from", F.max(F.when(F.col("_turn"), F.col("_no"))).over(so_far))
    rows = rows.withColumn("streak_started_at", F.last(F.when(F.col("_turn"), F.col("ts")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("consecutive_poor", F.when(F.col("_poor"), F.col("_no") - F.col("_from") + 1).otherwise(F.lit(0)))
    rows = rows.withColumn("_before", F.coalesce(F.lag("consecutive_poor").over(order), F.lit(0)))
    return rows.select(
        *checks.columns, "consecutive_poor", F.col("status").alias("streak_type"), "streak_started_at",
        (F.col("_poor") & (F.col("consecutive_poor") >= needed) & notify_poor).alias("alert"),
        ((F.col("_before") >= needed) & (F.col("status") == "good") & notify_recovery).alias("recovery"),
    )


def user_streaks(checks: DataFrame, typed: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Streaks, alerts and recoveries by each user's own settings."""
    return with_streaks(judged(checks, typed), keys, F.col("needed"), F.col("notify_poor"), F.col("notify_recovery"))


def picked(texts: tuple[str, ...], by: Column) -> Column:
    """One of some texts: the same for the same number in every run."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.pmod(by, F.lit(len(texts))) + 1).cast("int"))


def alerts(streaks: DataFrame, mode: Column | None = None) -> DataFrame:
    """Alert rows with title and message by mode; a user's newest replaces the one before, as latest_alert gives."""
    shown = F.lit("notification") if mode is None else mode
    score = F.concat(F.col("score").cast("string"), F.lit("/100"))
    wild = shown == "bananas"
    title = F.when(wild, F.lit(WILD_TITLE)).otherwise(F.concat(F.lit("Posture score "), score))
    message = F.when(wild, F.concat(F.lit("Score: "), score, F.lit(f". {WILD_MESSAGE}"))).otherwise(picked(POOR_MESSAGES, F.col("seq")))
    return streaks.filter("alert").select("user_id", "seq", "ts", F.lit("alert").alias("kind"), shown.alias("mode"), "score", title.alias("title"), message.alias("message"))


def recoveries(streaks: DataFrame) -> DataFrame:
    """Praise rows; each stands by itself."""
    return streaks.filter("recovery").select("user_id", "seq", "ts", F.lit("praise").alias("kind"), "score", picked(GOOD_MESSAGES, F.col("seq")).alias("message"))


def latest_alert(streaks: DataFrame) -> DataFrame:
    """The one alert that stands per user: alerts share an id, praises do not."""
    one = F.max_by(F.struct("seq", "ts", "score"), F.struct("ts", "seq")).alias("x")
    return streaks.filter("alert").groupBy("user_id").agg(one).select("user_id", "x.*")


def overlay_state(
    streaks: DataFrame, mode: str | Column = "blur", auto_remove: bool | Column = True, removals: DataFrame | None = None, delivered: bool | Column = True
) -> DataFrame:
    """Whether an overlay shows after each check.

    An alert that a page took (delivered) turns it on in the modes with an overlay; another check turns it off
    if auto_remove, and so does any row of ``removals`` (user_id, seq, ts): dismissals, buttons and stops, which
    come before checks of the same instant.  Mode, auto_remove and delivered may be columns.
    """
    mode, auto_remove, delivered = (x if isinstance(x, Column) else F.lit(x) for x in (mode, auto_remove, delivered))
    turn = F.when(F.col("alert") & mode.isin(*OVERLAYS) & delivered, True).when((F.col("status") != "poor") & auto_remove, False)
    rows = streaks.select("user_id", "seq", "ts", turn.alias("_turn"), F.lit(1).alias("_check"))
    if removals is not None:
        rows = rows.unionByName(removals.select("user_id", "seq", "ts", F.lit(False).alias("_turn"), F.lit(0).alias("_check")))
    so_far = Window.partitionBy("user_id").orderBy("ts", "_check", "seq").rowsBetween(Window.unboundedPreceding, 0)
    shown = F.coalesce(F.last("_turn", ignorenulls=True).over(so_far), F.lit(False))
    return rows.withColumn("overlay_active", shown).filter("_check = 1").drop("_turn", "_check")


def current_streak(streaks: DataFrame, asof: str) -> DataFrame:
    """Each user's running streak: type, start, minutes until ``asof`` and how it is shown."""
    last = F.max_by(F.struct("streak_type", "streak_started_at"), F.struct("ts", "seq")).alias("x")
    minutes = F.round((F.unix_micros(F.lit(asof).cast("timestamp")) - F.unix_micros("streak_started_at")) / 60e6).cast("long")
    shown = F.when(F.col("minutes") < 60, F.format_string("%dm", "minutes")).otherwise(F.format_string("%dh%dm", F.floor(F.col("minutes") / 60), F.col("minutes") % 60))
    rows = streaks.groupBy("user_id").agg(last).select("user_id", "x.*").withColumn("minutes", minutes)
    return rows.withColumn("shown", shown)


def latest_status(checks: DataFrame) -> DataFrame:
    """A user's last check: score, status and the colour of its badge."""
    one = F.max_by(F.struct("ts", "score", "status"), F.struct("ts", "seq")).alias("x")
    colour = F.when(F.col("status") == "good", "#4CAF50").when(F.col("status") == "fair", "#FF9800").otherwise("#F44336")
    return checks.groupBy("user_id").agg(one).select("user_id", F.col("x.ts").alias("last_check_at"), F.col("x.score").alias("last_score"), "x.status").withColumn("colour", colour)


def monitoring_sessions(checks: DataFrame, stops: DataFrame) -> DataFrame:
    """checks with session_id: the number of stops of the user until then, the check's own instant included."""
    marks = stops.select("user_id", "seq", "ts", F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("status"), F.lit(1).alias("_stop"))
    both = checks.select("user_id", "seq", "ts", "score", "status", F.lit(0).alias("_stop")).unionByName(marks)
    so_far = Window.partitionBy("user_id").orderBy("ts", F.col("_stop").desc(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("session_id", F.sum("_stop").over(so_far)).filter("_stop = 0").drop("_stop")


def without_snoozed(checks: DataFrame, snoozes: DataFrame, seconds: int) -> DataFrame:
    """checks that are not within ``seconds`` from a snooze: the last one before each check decides, so rows join no rows."""
    marks = snoozes.select("user_id", "seq", "ts", F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("status"), F.lit(1).alias("_snooze"))
    both = checks.select("user_id", "seq", "ts", "score", "status", F.lit(0).alias("_snooze")).unionByName(marks)
    so_far = Window.partitionBy("user_id").orderBy("ts", F.col("_snooze").desc(), "seq").rowsBetween(Window.unboundedPreceding, 0)
    since = F.unix_micros("ts") - F.unix_micros(F.last(F.when(F.col("_snooze") == 1, F.col("ts")), ignorenulls=True).over(so_far))
    return both.withColumn("_since", since).filter((F.col("_snooze") == 0) & (F.col("_since").isNull() | (F.col("_since") >= seconds * 1_000_000))).drop("_snooze", "_since")
