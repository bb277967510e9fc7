"""Time-series monitoring: seasonal decomposition, availability, smoothing, sessions, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seasonal(df: DataFrame, at: str, value: str, period: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, value, trend, season, residual) of a series in order of at.

    trend is a centred mean of width 2 (period div 2) + 1 where that is full, else the series mean;
    season the mean of value - trend at each phase. A series under two periods gives no rows.
    """
    by = list(by)
    order, whole = Window.partitionBy(*by).orderBy(at), Window.partitionBy(*by)
    half = period // 2
    frame = order.rowsBetween(-half, half)
    rows = df.select(*by, F.col(at), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col(value).alias("value"))
    rows = rows.withColumns({"_n": F.count("*").over(frame), "_avg": F.avg("value").over(frame), "_all": F.avg("value").over(whole), "_len": F.count("*").over(whole)})
    rows = rows.where(F.col("_len") >= 2 * period).withColumn("trend", F.when(F.col("_n") == 2 * half + 1, F.col("_avg")).otherwise(F.col("_all")))
    phase = Window.partitionBy(*by, F.pmod("i", F.lit(period)))
    rows = rows.withColumn("season", F.avg(F.col("value") - F.col("trend")).over(phase))
    return rows.select(*by, at, "i", "value", "trend", "season", (F.col("value") - F.col("trend") - F.col("season")).alias("residual"))


def seasonal_anomalies(parts: DataFrame, k: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows of seasonal() whose residual lies over k population deviations from the mean residual."""
    whole = Window.partitionBy(*by)
    away = F.abs(F.col("residual") - F.avg("residual").over(whole))
    return parts.withColumn("_far", away > k * F.stddev_pop("residual").over(whole)).where("_far").drop("_far")


def seasonal_forecast(parts: DataFrame, period: int, ahead: int) -> DataFrame:
    """(step, forecast) of the next points: mean of the last period of trends plus the season of the phase."""
    end = parts.agg((F.max("i") + 1).alias("n"))
    tail = parts.crossJoin(F.broadcast(end)).where(F.col("i") >= F.col("n") - period).agg(F.avg("trend").alias("base"), F.first("n").alias("n"))
    seasons = parts.groupBy(F.pmod("i", F.lit(period)).alias("phase")).agg(F.first("season").alias("season"))
    steps = tail.select("base", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ahead - 1).cast("long"))).alias("step"))
    return steps.join(F.broadcast(seasons), F.pmod(F.col("n") + F.col("step"), F.lit(period)) == F.col("phase")).select("step", (F.col("base") + F.col("season")).alias("forecast"))


def availability(df: DataFrame, by: Sequence[str], at: str, tie: str, up: Column, now: Column) -> DataFrame:
    """(by..., up_time, total, pct): repeated states are collapsed; a state lasts to the next change, the last to now."""
    order = Window.partitionBy(*by).orderBy(at, tie)
    rows = df.withColumns({"_up": up, "_now": now})
    turns = rows.withColumn("_was", F.lag("_up").over(order)).where(F.col("_was").isNull() | (F.col("_was") != F.col("_up")))
    lasting = turns.withColumn("_for", F.coalesce(F.lead(at).over(order), F.col("_now")) - F.col(at))
    out = lasting.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_up"), F.col("_for"))), F.lit(0)).alias("up_time"), F.sum("_for").alias("total"))
    return out.withColumn("pct", F.when(F.col("total") > 0, F.col("up_time") / F.col("total") * 100.0).otherwise(100.0))


def sessions(df: DataFrame, user: str, at: str, tie: str, idle: int) -> DataFrame:
    """df with session: events of a user, a new one after idle time units without any."""
    order = Window.partitionBy(user).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > idle).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def binges(df: DataFrame, user: str, at: str, tie: str, gap: int, least: int = 3, count_last: bool = True) -> DataFrame:
    """(user, binges): runs of at least so many events with gaps up to gap. count_last=False leaves a user's last run out."""
    runs = sessions(df, user, at, tie, gap).groupBy(user, "session").agg(F.count("*").alias("n"))
    last = F.max("session").over(Window.partitionBy(user))
    kept = runs.withColumn("_last", last)
    open_ = F.lit(True) if count_last else F.col("session") < F.col("_last")
    return kept.groupBy(user).agg(F.sum(((F.col("n") >= least) & open_).cast("long")).alias("binges"))


def zero_filled(df: DataFrame, at: str, start: int, stop: int, width: int) -> DataFrame:
    """(bucket, n): counts of fixed buckets from start to stop, empty ones too; the last may be cut short."""
    spark = df.sparkSession
    calendar = spark.range(start, stop, width).withColumnRenamed("id", "bucket")
    rows = df.where((F.col(at) >= start) & (F.col(at) < stop))
    counts = rows.groupBy((F.floor((F.col(at) - start) / width) * width + start).alias("bucket")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def trailing_sum(df: DataFrame, by: Sequence[str], at: str, value: str, width: int) -> DataFrame:
    """df with trailing: the sum of value over the last width time units, the row's own included."""
    frame = Window.partitionBy(*by).orderBy(at).rangeBetween(-width, 0)
    return df.withColumn("trailing", F.sum(value).over(frame))


def rolling_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int) -> DataFrame:
    """df with rolling: mean of the last size rows."""
    return df.withColumn("rolling", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)))


def half_trend(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, band: float = 0.1) -> DataFrame:
    """(by..., first, second, trend): means of the two halves of each series; rising or falling beyond the band."""
    by = list(by)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumns({"_i": at, "_n": F.count("*").over(Window.partitionBy(*by))})
    early = F.col("_i") <= F.floor(F.col("_n") / 2)
    out = rows.groupBy(*by).agg(F.avg(F.when(early, F.col(value))).alias("first"), F.avg(F.when(~early, F.col(value))).alias("second"))
    trend = F.when(F.col("second") > F.col("first") * (1 + band), "rising").when(F.col("second") < F.col("first") * (1 - band), "falling").otherwise("stable")
    return out.withColumn("trend", trend)


def suppress_repeats(df: DataFrame, by: Sequence[str], at: str, tie: str, window: int) -> DataFrame:
    """Rows whose group was not seen within the window before (by the last row seen, suppressed or not)."""
    before = F.lag(at).over(Window.partitionBy(*by).orderBy(at, tie))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(at) - F.col("_b") >= window)).drop("_b")


def chunk_styles(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int, fast: float, slow: float) -> DataFrame:
    """(by..., chunk, mean, style): tumbling chunks of size rows, by the mean of value: fast under one bound, slow over the other."""
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("long")
    out = df.withColumn("chunk", at).groupBy(*by, "chunk").agg(F.avg(value).alias("mean"))
    return out.withColumn("style", F.when(F.col("mean") < fast, "fast").when(F.col("mean") > slow, "slow").otherwise("medium"))


def recent_mode(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, size: int) -> DataFrame:
    """(by..., label, n): the most frequent label of the last size rows of each group; ties go to the one seen last."""
    by = list(by)
    back = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    last = df.withColumn("_b", back).where(F.col("_b") <= size)
    counts = last.groupBy(*by, label).agg(F.count("*").alias("n"), F.min("_b").alias("_b"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_b"))
    return counts.withColumn("_r", best).where("_r = 1").drop("_r", "_b")
