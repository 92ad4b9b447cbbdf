"""Per-user sessions and rollups by day and hour as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..functions.constants import DEFAULTS, OVERLAYS, POOR_BEFORE_ALERT
from ..operators.rollups import local_day, local_micros
from ..scratch import scratch_dir
from ..sources.tables import as_checks, control_kind

#: What is known of a session after each of its checks.
SESSION = (
    "started_at timestamp, consecutive_poor int, streak_type string, streak_started_at timestamp, last_score int, last_check_at timestamp, overlay_active boolean, overlay_seq long"
)
OUT = f"user_id long, seq long, ts timestamp, score int, status string, alert boolean, recovery boolean, {SESSION}"
COUNTS = ("total_checks", "good_checks", "fair_checks", "poor_checks", "total_score")
#: Controls that take an overlay away.
OFF = ("stop", "dismiss", "fixed", "snooze")


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of events from a folder or file, at most so many files a batch; a folder's files are those that a batch reads."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    if files is not None:
        rows = rows.option("maxFilesPerTrigger", files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = rows.parquet(path)
    else:
        folder, _, name = path.rstrip("/").rpartition("/")
        rows = rows.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def check_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of checks."""
    return as_checks(event_stream(spark, path, files))


def session_rows(events: DataFrame) -> DataFrame:
    """Checks and controls of events as rows (user_id, seq, ts, kind, score, status), a check's kind being check."""
    score = as_checks(events)
    control = events.select("user_id", F.col("event_id").alias("seq"), "ts", control_kind().alias("kind"), F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("status"))
    return control.filter("kind IS NOT NULL").unionByName(score.withColumn("kind", F.lit("check")))


def _last(np, marks, n: int):
    """At each row, the last marked row until then, -1 for none."""
    return np.maximum.accumulate(np.where(marks, np.arange(n), -1))


def session_step(rows, old: dict):
    """(rows of checks with the session after each, the session after all) from a user's sorted rows and the session before.

    All by cumulative sums and running maxima; a stop resets the session.
    """
    import numpy as np
    import pandas as pd

    n = len(rows)
    kind, status, ts, seq = (rows[c].to_numpy() for c in ("kind", "status", "ts", "seq"))
    needed, notify, praise, clear = (rows[c].to_numpy() for c in ("needed", "notify_poor", "notify_recovery", "auto_remove"))
    check, stop, start = kind == "check", kind == "stop", kind == "start"
    poor = check & (status == "poor")
    calm = check & ~poor
    last_stop = _last(np, stop, n)
    reset, run = _last(np, stop | calm, n), np.cumsum(poor)
    count = run - np.where(reset >= 0, run[reset], -(old["consecutive_poor"] or 0))
    before = np.concatenate([[-1], _last(np, check, n)[:-1]])  # the check before each row
    known = (before >= 0) & (before > last_stop)
    carried = (before < 0) & (last_stop < 0)
    count_before = np.where(known, count[before], np.where(carried, old["consecutive_poor"] or 0, 0))
    was_poor = np.where(known, poor[before], carried & (old["streak_type"] == "poor"))
    turn = check & (~(known | (carried & (old["streak_type"] is not None))) | (was_poor != poor))
    turned = _last(np, turn, n)
    since = pd.Series(ts[turned]).where(turned >= 0, pd.Timestamp(old["streak_started_at"]) if old["streak_started_at"] is not None else pd.NaT)
    alert = poor & (count >= needed) & notify
    recovery = check & (status == "good") & (count_before >= needed) & praise
    on = alert & np.isin(rows["mode"].to_numpy(), OVERLAYS)
    off = (calm & clear) | np.isin(kind, OFF)
    mark = _last(np, on | off, n)
    active = np.where(mark >= 0, on[mark], bool(old["overlay_active"])).astype(bool)
    page = pd.Series(np.where(mark >= 0, seq[mark], -1 if old["overlay_seq"] is None else old["overlay_seq"])).where(active).astype("Int64")
    begin = _last(np, start | stop, n)
    begun = pd.Series(ts[begin]).where(start[begin], pd.NaT).where(begin >= 0, pd.Timestamp(old["started_at"]) if old["started_at"] is not None else pd.NaT)
    out = pd.DataFrame({
        "user_id": rows["user_id"].to_numpy(), "seq": seq, "ts": ts, "score": rows["score"].to_numpy(), "status": status, "alert": alert, "recovery": recovery,
        "started_at": begun.to_numpy(), "consecutive_poor": count, "streak_type": status, "streak_started_at": since.to_numpy(), "last_score": rows["score"].to_numpy(),
        "last_check_at": ts, "overlay_active": active, "overlay_seq": page.array,
    })
    last = _last(np, check, n)[-1]
    new = {"consecutive_poor": int(count[-1]), "overlay_active": bool(active[-1]), "overlay_seq": int(page.iloc[-1]) if active[-1] else None}
    new["started_at"] = None if pd.isna(begun.iloc[-1]) else begun.iloc[-1]
    if last > last_stop[-1]:
        new |= {"streak_type": status[last], "streak_started_at": since.iloc[last], "last_score": int(rows["score"].iloc[last]), "last_check_at": pd.Timestamp(ts[last])}
    else:
        ended = last_stop[-1] >= 0
        new |= {c: None if ended else old[c] for c in ("streak_type", "streak_started_at", "last_score", "last_check_at")}
    out = out[check]
    return out.assign(score=out["score"].astype("int32"), last_score=out["last_score"].astype("int32")), new


def session_stream(rows: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """Checks with the session after each, from a stream of session_rows(): one writer per user.

    Rows of a batch are taken in order of (ts, controls first, seq).  ``typed`` holds users' settings; users
    without any have the defaults.  A stop resets the session.
    """
    base = {"needed": POOR_BEFORE_ALERT, "notify_poor": True, "notify_recovery": True, "mode": DEFAULTS["alert_mode"], "auto_remove": True}
    if typed is None:
        rows = rows.select("*", *[F.lit(v).alias(c) for c, v in base.items()])
    else:
        rows = rows.join(typed, "user_id", "left").select(*rows.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in base.items()])
    fields = [f.split()[0] for f in SESSION.split(", ")]

    def step(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        own = pd.concat([f.assign(_check=f["kind"] == "check") for f in frames if len(f)], ignore_index=True)
        own = own.sort_values(["ts", "_check", "seq"], kind="stable", ignore_index=True)
        old = dict(zip(fields, state.get, strict=True)) if state.exists else dict.fromkeys(fields)
        out, new = session_step(own, old)
        state.update(tuple(new[f] for f in fields))
        yield out

    return rows.groupBy("user_id").applyInPandasWithState(step, OUT, SESSION, "append", "NoTimeout")


def triggered(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    """A tick each so often, or, without a period, all that is there now."""
    return writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)


def session_query(checks: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a session stream's rows to a folder; the sink's log makes a replayed batch count once."""
    return triggered(checks.writeStream.format("parquet").option("checkpointLocation", checkpoint), every).start(out)


def run_sessions(spark: SparkSession, path: str, typed: DataFrame | None = None, files: int | None = None) -> DataFrame:
    """Drain the stream that is there now and give back what it wrote, in scratch folders."""
    out = scratch_dir(spark, "session-out")
    session_query(session_stream(session_rows(event_stream(spark, path, files)), typed), out, scratch_dir(spark, "session")).awaitTermination()
    return spark.read.schema(OUT).parquet(out)


def upsert(out: str):
    """A sink that writes each batch's new totals under its own number, so a replay overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def rollup_stream(checks: DataFrame, out: str, checkpoint: str, hourly: bool = False, zone: str = "UTC", late: str | None = None, every: str | None = None) -> StreamingQuery:
    """Sums by user and UTC day, or by day and hour of a zone's clock, upserted.

    Without ``late`` no check is ever dropped, however late, and the state keeps all its groups; with it (a
    length of time), checks later than that behind the newest are dropped and the state is bounded.
    """
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_checks") for s in ("good", "fair", "poor")]
    keys: list[Column] = [local_day().alias("day")]
    if hourly:
        keys.append(F.pmod(F.floor(local_micros(zone) / F.lit(3_600_000_000)), F.lit(24)).cast("int").alias("hour"))
    rows = checks.withColumn("at", F.col("ts"))
    if late is not None:
        rows = rows.withWatermark("at", late)
        keys.append(F.window("at", "1 hour" if hourly else "1 day").alias("w"))
    sums = rows.groupBy("user_id", *keys).agg(F.count(F.lit(1)).alias("total_checks"), *counts, F.sum("score").alias("total_score"))
    sums = sums.drop("w") if late is not None else sums
    return triggered(sums.writeStream.outputMode("update").foreachBatch(upsert(out)).option("checkpointLocation", checkpoint), every).start()


def newest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """Of each group the newest batch's totals."""
    rows = spark.read.parquet(out).groupBy("user_id", *keys)
    return rows.agg(F.max_by(F.struct(*COUNTS), "batch").alias("x")).select("user_id", *keys, "x.*")


def run_daily(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Drain the stream that is there now; daily totals with their rounded average."""
    out = scratch_dir(spark, "daily-out")
    rollup_stream(check_stream(spark, path, files), out, scratch_dir(spark, "daily")).awaitTermination()
    return newest(spark, out, "day").withColumn("average_score", F.round(F.col("total_score") / F.col("total_checks")).cast("int"))


def run_hourly(spark: SparkSession, path: str, zone: str = "UTC", files: int | None = None) -> DataFrame:
    """Drain the stream that is there now; hourly sums and counts."""
    out = scratch_dir(spark, "hourly-out")
    rollup_stream(check_stream(spark, path, files), out, scratch_dir(spark, "hourly"), hourly=True, zone=zone).awaitTermination()
    return newest(spark, out, "day", "hour").select("user_id", "day", "hour", F.col("total_score").alias("score_sum"), F.col("total_checks").alias("n"))
