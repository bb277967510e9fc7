"""Operators on the rows that media analysis gives out: shots, frames, cues, blocks, calls, packets, assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import hamming
from lumenframe.operators.intervals import islands
from lumenframe.session import broadcast_if_small


def boundaries(df: DataFrame, by: Sequence[str], order: str, distance: str, hard: float, soft: float) -> DataFrame:
    """(by..., frame, kind): frames after a distance over a bound: hard or gradual."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    kind = F.when(F.col(distance) >= hard, "hard").when(F.col(distance) >= soft, "gradual")
    return df.select(*by, i.cast("long").alias("frame"), kind.alias("kind")).where("kind is not null")


def jump_cuts(df: DataFrame, by: Sequence[str], order: str, coverage: str, angle: str, least: float = 15.0) -> DataFrame:
    """Shots of the same coverage as the one before whose angle differs by less than least degrees, round the circle."""
    w = Window.partitionBy(*by).orderBy(order)
    turn = F.abs(F.col(angle) - F.lag(angle).over(w)) % 360
    rows = df.withColumns({"_same": F.col(coverage) == F.lag(coverage).over(w), "_turn": F.least(turn, 360 - turn)})
    return rows.where(F.col("_same") & (F.col("_turn") < least)).drop("_same", "_turn")


def frozen_runs(df: DataFrame, by: Sequence[str], order: str, code: str, radius: int, least: int) -> DataFrame:
    """(by..., first, last, n): runs of frames whose code differs from the one before in at most radius bits, least frames long."""
    by = list(by)
    before = F.lag(code).over(Window.partitionBy(*by).orderBy(order))
    marked = df.withColumn("_far", hamming(F.col(code), before) > radius)
    runs = islands(marked, by, [order], F.col("_far"))
    return runs.groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def quiet_breaks(df: DataFrame, by: Sequence[str], order: str, value: str, size: int, under: float) -> DataFrame:
    """(by..., first, last): runs of rows whose mean over the last size rows lies under a bound."""
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    low = df.withColumn("_low", F.avg(value).over(w.rowsBetween(-(size - 1), 0)) < under)
    runs = islands(low, by, [order], F.col("_low") & ~F.coalesce(F.lag("_low").over(w), F.lit(False))).where("_low")
    return runs.groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("island")


def loudness_range(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., range): distance of the 95th and 10th percentiles of gated blocks, at the index floor(n q); under two blocks 0.

    Blocks of equal value are counted before they are placed.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull() & (F.abs(F.col(value)) < float("inf"))).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    placed = counts.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    at = lambda q: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_all") * q), F.col("_all") - 1), F.col(value)))
    out = placed.groupBy(*by).agg(at(0.95).alias("_hi"), at(0.10).alias("_lo"), F.max("_all").alias("_all"))
    return out.select(*by, F.when(F.col("_all") < 2, 0.0).otherwise(F.abs(F.col("_hi") - F.col("_lo"))).alias("range"))


def last_n_stats(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """(by..., n, mean, spread, variation): of the last n rows; the variance is divided by max(n, 2)."""
    by = list(by)
    back = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    last = df.withColumn("_b", back).where(F.col("_b") <= n)
    v = F.col(value)
    out = last.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("_var"))
    spread = F.sqrt(F.col("_var") * F.col("n") / F.greatest(F.col("n"), F.lit(2)))
    return out.select(*by, "n", "mean", spread.alias("spread"), F.when(F.col("mean") == 0, 0.0).otherwise(spread / F.col("mean")).alias("variation"))


def caption_score(words: Column, seconds: Column, over: Column, cues: Column) -> Column:
    """100 less a penalty for dense captions and up to 30 for cues over the limit, cut to a whole number within 0 and 100."""
    wpm = F.when(seconds > 0, words / seconds * 60.0).otherwise(0.0)
    density = F.when(wpm > 250, 40.0).when(wpm > 200, 20.0).when(wpm > 160, 10.0).otherwise(0.0)
    kept = F.when(cues > 0, 1 - over / cues).otherwise(1.0)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - density - 30.0 * (1 - kept)))).cast("long")


def call_edges(calls: DataFrame) -> DataFrame:
    """(caller, callee, n, time) of calls(caller, callee, time)."""
    return calls.groupBy("caller", "callee").agg(F.count("*").alias("n"), F.sum("time").alias("time"))


def stage_latency(df: DataFrame, stage: str, value: str) -> DataFrame:
    """One row (slowest, total): the stage of highest mean (ties: the last name) and the sum of the means, each cut to a whole number."""
    means = df.groupBy(stage).agg(F.avg(value).alias("m"))
    return means.agg(F.max_by(stage, F.struct("m", stage)).alias("slowest"), F.sum(F.floor("m")).cast("long").alias("total"))


def compare_runs(baseline: DataFrame, current: DataFrame, name: str, value: str, limit: float) -> DataFrame:
    """(name, speedup, regressed) of runs in both: baseline by current; slower than the limit is a regression."""
    met = baseline.select(name, F.col(value).alias("_b")).join(current.select(name, F.col(value).alias("_c")), name)
    return met.select(name, F.when(F.col("_c") == 0, 1.0).otherwise(F.col("_b") / F.col("_c")).alias("speedup"), (F.col("_c") > F.col("_b") * (1 + limit)).alias("regressed"))


def best_distance_per_asset(queries: DataFrame, items: DataFrame, asset: str, distance: Column, most: float) -> DataFrame:
    """(query, asset, distance): least distance of any item of an asset to each of the stated queries, up to most. Queries are broadcast once they are counted."""
    met = items.crossJoin(broadcast_if_small(queries, 50_000)).withColumn("distance", distance)
    return met.groupBy("query", asset).agg(F.min("distance").alias("distance")).where(F.col("distance") <= most)


def relink(names: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """A proxy's name rewritten by the first pattern part that it holds."""
    out = names
    for i, (old, new) in enumerate(reversed(patterns)):
        out = F.when(names.contains(old), F.replace(names, F.lit(old), F.lit(new))).otherwise(out if i else names)
    return out


def segments_in_range(segments: DataFrame, packets: DataFrame, start: int, end: int) -> DataFrame:
    """Packets(segment, at) within [start, end) of segments(segment, s, e) that touch it: segments are pruned first."""
    live = segments.where((F.col("s") < end) & (F.col("e") > start)).select("segment")
    return packets.join(live, "segment", "left_semi").where((F.col("at") >= start) & (F.col("at") < end))


def lifecycle_violations(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str, legal: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose change from the state before is not legal; staying is."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in legal])
    rows = df.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))
    return rows.where(~F.array_contains(pairs, F.concat_ws(">", "before", state)))


def lockouts(df: DataFrame, user: str, at: str, tie: str, failed: Column, window: int, most: int) -> DataFrame:
    """Failed attempts with lock: whether the user has most or more failures within the window that ends here."""
    w = Window.partitionBy(user).orderBy(at).rangeBetween(-window, 0)
    return df.where(failed).withColumn("lock", F.count("*").over(w) >= most)


def keep_latest(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The last n versions of each group, and those to be pruned."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    ranked = df.withColumn("_b", back)
    return ranked.where(F.col("_b") <= n).drop("_b"), ranked.where(F.col("_b") > n).drop("_b")


def due_jobs(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The first n jobs(job, priority, due, seq) that are due: by priority from high to low, then in order of arrival."""
    return jobs.where(F.col("due") <= now).orderBy(F.desc("priority"), "seq").limit(n)


def mean_drift(a: DataFrame, b: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by..., drift, n): mean difference of the rows at the same place of two series."""
    by = list(by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    left, right = a.select(*by, place.alias("_i"), F.col(value).alias("_a")), b.select(*by, place.alias("_i"), F.col(value).alias("_b"))
    return left.join(right, [*by, "_i"]).groupBy(*by).agg(F.avg(F.col("_b") - F.col("_a")).alias("drift"), F.count("*").alias("n"))


def minimum_gaps(df: DataFrame, by: Sequence[str], start: str, end: str, gap: int) -> DataFrame:
    """Cues whose end is drawn back so that gap lies before the next start; never before their own start."""
    follow = F.lead(start).over(Window.partitionBy(*by).orderBy(start, end))
    return df.withColumn(end, F.greatest(F.col(start), F.least(F.col(end), F.coalesce(follow - gap, F.col(end)))))
