"""Daily and hourly rollups, retention and what dashboards read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import KEPT_CHECKS, KEPT_DAYS
from ..functions.scores import status_of


def local_micros(zone: str, ts: str = "ts") -> Column:
    """Microseconds of a zone's wall clock, whatever the session's zone."""
    return F.unix_micros(F.col(ts) if zone == "UTC" else F.from_utc_timestamp(ts, zone))


def local_day(zone: str = "UTC", ts: str = "ts") -> Column:
    """The day of an instant on a zone's wall clock."""
    return F.date_from_unix_date(F.floor(local_micros(zone, ts) / F.lit(86_400_000_000)).cast("int"))


def local_hour(zone: str = "UTC", ts: str = "ts") -> Column:
    """The hour of an instant on a zone's wall clock."""
    return F.pmod(F.floor(local_micros(zone, ts) / F.lit(3_600_000_000)), F.lit(24)).cast("int")


def daily_summary(checks: DataFrame, zone: str = "UTC") -> DataFrame:
    """Counts, sum and rounded average per user and day of a zone; partial sums precede the shuffle."""
    rows = checks.withColumn("day", local_day(zone))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_checks") for s in ("good", "fair", "poor")]
    days = rows.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("total_checks"), *counts, F.sum("score").alias("total_score"))
    return days.withColumn("average_score", F.round(F.col("total_score") / F.col("total_checks")).cast("int"))


def hourly_summary(checks: DataFrame, zone: str = "UTC") -> DataFrame:
    """Sums and counts per user, UTC day and hour of a zone's clock: the day and the hour are different clocks."""
    rows = checks.select("user_id", local_day().alias("day"), local_hour(zone).alias("hour"), "score")
    return rows.groupBy("user_id", "day", "hour").agg(F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n"))


def hourly_summary_compat(checks: DataFrame, zone: str = "UTC") -> DataFrame:
    """As the running bucket counts: it starts anew while its sum is 0, so n counts from the first score above 0 (1 if none is)."""
    rows = checks.select("user_id", "seq", "ts", local_day().alias("day"), local_hour(zone).alias("hour"), "score")
    so_far = Window.partitionBy("user_id", "day", "hour").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("score").over(so_far))
    n = F.greatest(F.count_if(F.col("_sum") > 0), F.lit(1))
    return rows.groupBy("user_id", "day", "hour").agg(F.sum("score").alias("score_sum"), n.alias("n"))


def recent_checks(checks: DataFrame, keep: int = KEPT_CHECKS) -> DataFrame:
    """The newest checks of each user; Spark limits each group before the shuffle."""
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("seq").desc())
    return checks.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= keep)


def retained_days(days: DataFrame, asof: str, keep: int = KEPT_DAYS) -> DataFrame:
    """Days from the cutoff on; the cutoff itself stays."""
    return days.filter(F.col("day") >= F.date_sub(F.lit(asof).cast("date"), keep))


def today_stats(days: DataFrame, asof: str) -> DataFrame:
    today = days.filter(F.col("day") == F.lit(asof).cast("date"))
    good = F.when(F.col("total_checks") > 0, F.round(F.col("good_checks") / F.col("total_checks") * 100).cast("int")).otherwise(F.lit(0))
    return today.select("user_id", "day", "total_checks", good.alias("good_percent"), "average_score")


def seven_day_chart(users: DataFrame, days: DataFrame, asof: str, length: int = 7) -> DataFrame:
    """A row per user and day of the last week, with null where a day has no checks, and the colour band."""
    last = F.lit(asof).cast("date")
    spine = users.select("user_id", F.explode(F.sequence(F.date_sub(last, length - 1), last)).alias("day"))
    found = days.filter(F.col("day").between(F.date_sub(last, length - 1), last)).select("user_id", "day", "average_score")
    rows = spine.join(found, ["user_id", "day"], "left")
    return rows.select("user_id", "day", F.date_format("day", "MM-dd").alias("label"), "average_score", status_of(F.col("average_score")).alias("band"))


def status_distribution(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
