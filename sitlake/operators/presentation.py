"""Rows that displays and delivery need: colours, labels, arcs, countdowns, targets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SNOOZE
from ..functions.scores import status_of
from .settings import check_period

# Pages that take no overlay, pages that do, and the radius of the score's ring.
CLOSED_PAGES = "^(chrome|chrome-extension|edge|about|devtools):"
WEB_PAGES = "^https?://"
RADIUS = 52


def score_ring(checks: DataFrame, digits: int = 6) -> DataFrame:
    """Label, colour and dash offset of each score's ring."""
    around = 2 * math.pi * RADIUS
    status = status_of(F.col("score"))
    colour = F.when(status == "good", "#4CAF50").when(status == "fair", "#FF9800").otherwise("#F44336")
    offset = F.round(around - F.col("score") / 100 * around, digits)
    return checks.select("user_id", "seq", F.initcap(status).alias("label"), colour.alias("colour"), offset.alias("dash_offset"))


def countdown(due: Column, now: Column) -> Column:
    """Whole seconds until the next check, never below 0; null without one."""
    return F.when(due.isNotNull(), F.greatest(F.lit(0), F.round((F.unix_micros(due) - F.unix_micros(now)) / 1e6).cast("int")))


def delivery_target(pages: DataFrame, group: str) -> DataFrame:
    """The page per group that gets an alert: the first if it is open to overlays, else the first web page, else none."""
    first = F.min_by("url", "page_id")
    web = F.min_by(F.when(F.col("url").rlike(WEB_PAGES), F.col("url")), F.when(F.col("url").rlike(WEB_PAGES), F.col("page_id")))
    rows = pages.groupBy(group).agg(first.alias("_first"), web.alias("_web"))
    return rows.select(group, F.when(~F.coalesce(F.col("_first"), F.lit("")).rlike(CLOSED_PAGES), F.col("_first")).otherwise(F.col("_web")).alias("url"))


def schedule(
    checks: DataFrame, settings: DataFrame, fixed: DataFrame, snoozes: DataFrame | None = None, manual: DataFrame | None = None, recheck_seconds: int = 10, snooze_seconds: int = SNOOZE
) -> DataFrame:
    """When each user is checked next: (user_id, period_seconds, regular_at, due_at, trigger).

    The regular check comes a period after the last one, or when a snooze ends that no check has followed.  A
    recheck comes shortly after a "fixed" control, and a manual request at once, whether or not the user
    monitors, where no check has followed.  due_at is the first of them and trigger its kind.
    """
    rows = settings.select("user_id", check_period(F.col("check_interval_seconds")).alias("period_seconds"))
    last = checks.groupBy("user_id").agg(F.max("ts").alias("_last"))
    rows = rows.join(last, "user_id", "left")
    for name, marks in (("_fixed", fixed), ("_snooze", snoozes), ("_manual", manual)):
        if marks is None:
            rows = rows.withColumn(name, F.lit(None).cast("timestamp"))
        else:
            rows = rows.join(marks.groupBy("user_id").agg(F.max("ts").alias(name)), "user_id", "left")

    def after(start: Column, seconds: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(start) + seconds.cast("long") * 1_000_000)

    def open_(name: str) -> Column:
        return F.coalesce(F.col(name) >= F.col("_last"), F.col(name).isNotNull())

    regular = F.when(open_("_snooze"), after(F.col("_snooze"), F.lit(snooze_seconds))).otherwise(after(F.col("_last"), F.col("period_seconds")))
    recheck = F.when(open_("_fixed"), after(F.col("_fixed"), F.lit(recheck_seconds)))
    rows = rows.select("user_id", "period_seconds", regular.alias("regular_at"), recheck.alias("_re"), F.when(open_("_manual"), F.col("_manual")).alias("_now"))
    due = F.least("regular_at", "_re", "_now")
    trigger = F.when(F.col("_now") == due, "manual").when(F.col("_re") == due, "recheck").when(due.isNotNull(), "regular")
    return rows.select("user_id", "period_seconds", "regular_at", due.alias("due_at"), trigger.alias("trigger"))


def result_line(scored: DataFrame) -> DataFrame:
    """(user_id, frame_id, line): the JSON that a log shows of results without a score."""
    return scored.filter("score IS NULL").select("user_id", "frame_id", F.to_json(F.struct("score", "status"), {"ignoreNullFields": "false"}).alias("line"))


def encoded(text: Column) -> Column:
    """A text as a component of a URL."""
    out = F.url_encode(text)
    for form, component in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(component))
    return out


def pairing_link(peers: DataFrame, page: str, code: str) -> DataFrame:
    """(peer_id, link, code_url): the page that pairs a phone, and the address of a code that shows it."""
    link = F.concat(F.lit(f"{page}/#peer="), F.col("peer_id"))
    return peers.select("peer_id", link.alias("link"), F.concat(F.lit(code), encoded(link)).alias("code_url"))
