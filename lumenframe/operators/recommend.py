"""Recommendation: collaborative filtering, hybrids, balance, trends, engagement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.scores import log_rate_decay
from lumenframe.session import broadcast_if_small


def user_similarity(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """(user, other, sim): cosine of each stated user (users(user), a small set) with all who share an item; over full norms."""
    norms = ratings.groupBy("user").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))
    mine = ratings.join(broadcast_if_small(users), "user")
    met = ratings.select(F.col("user").alias("other"), "item", F.col("rating").alias("r2")).join(mine, "item").where("user <> other")
    dots = met.groupBy("user", "other").agg(F.sum(F.col("rating") * F.col("r2")).alias("dot"))
    both = dots.join(norms, "user").join(norms.select(F.col("user").alias("other"), F.col("norm").alias("norm2")), "other")
    return both.where("norm > 0 and norm2 > 0").select("user", "other", (F.col("dot") / (F.col("norm") * F.col("norm2"))).alias("sim"))


def collaborative(ratings: DataFrame, users: DataFrame, neighbours: int, n: int) -> DataFrame:
    """(user, item, score, rank): items that a user has not rated, by the ratings of the most similar users."""
    frame = Window.partitionBy("user").orderBy(F.desc("sim"), "other")
    sims = user_similarity(ratings, users).withColumn("sim", F.round("sim", 9)).withColumn("_r", F.row_number().over(frame)).where(F.col("_r") <= neighbours)
    theirs = ratings.select(F.col("user").alias("other"), "item", "rating")
    scored = theirs.join(sims, "other").groupBy("user", "item").agg(F.round(F.sum(F.col("sim") * F.col("rating")), 6).alias("score"))
    fresh = scored.join(ratings.select("user", "item"), ["user", "item"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= n)


def baseline(ratings: DataFrame) -> DataFrame:
    """ratings with predicted: the global mean plus the user's and the item's mean deviations, cut to 0 to 5; only ratings over 0 count."""
    rated = ratings.where("rating > 0")
    rows = ratings.crossJoin(F.broadcast(rated.agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("mu"))))
    users = rated.groupBy("user").agg(F.avg("rating").alias("mean_u"))
    items = rated.groupBy("item").agg(F.avg("rating").alias("mean_i"))
    bias = lambda c: F.coalesce(F.col(c) - F.col("mu"), F.lit(0.0))
    predicted = F.least(F.greatest(F.col("mu") + bias("mean_u") + bias("mean_i"), F.lit(0.0)), F.lit(5.0))
    return rows.join(users, "user", "left").join(items, "item", "left").select("user", "item", "rating", predicted.alias("predicted"))


def combine(lists: Mapping[str, DataFrame], weights: Mapping[str, float], n: int) -> DataFrame:
    """(item, score, rank): weighted sum of the scores of lists(item, score); lists without a weight count 0."""
    union = None
    for name, df in lists.items():
        one = df.select("item", (F.col("score") * float(weights.get(name, 0.0))).alias("score"))
        union = one if union is None else union.unionAll(one)
    total = union.groupBy("item").agg(F.round(F.sum("score"), 6).alias("score"))
    best = total.orderBy(F.desc("score"), "item").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item")))


def diversified(df: DataFrame, item: str, group: str, score: str, weight: float, n: int) -> DataFrame:
    """A ranking that discounts the i-th item of each group by weight ** (i - 1)."""
    inner = Window.partitionBy(group).orderBy(F.desc(score), item)
    marked = df.withColumn("adjusted", F.round(F.col(score) * F.pow(F.lit(weight), F.row_number().over(inner) - 1), 6))
    return marked.orderBy(F.desc("adjusted"), item).limit(n)


def blend_freshness(df: DataFrame, score: str, boost: Column, weight: float) -> DataFrame:
    """df with blended: score (1 - w) + boost w."""
    return df.withColumn("blended", F.col(score) * (1 - weight) + boost * weight)


def trend_hours(views: DataFrame, item: str, at: str, now: Column, hours: int = 24, half_life: float = 6.0, velocity_hours: int = 6) -> DataFrame:
    """(item, decayed, velocity): hourly counts of the last hours decayed by age; velocity is the mean of the last few hours less that of the few before."""
    age = F.floor((now - F.col(at)) / 3600)
    rows = views.select(F.col(item), age.alias("age")).where((F.col("age") >= 0) & (F.col("age") < hours))
    counts = rows.groupBy(item, "age").agg(F.count("*").alias("n"))
    near = F.coalesce(F.sum(F.when(F.col("age") < velocity_hours, F.col("n"))), F.lit(0)) / float(velocity_hours)
    before = F.coalesce(F.sum(F.when((F.col("age") >= velocity_hours) & (F.col("age") < 2 * velocity_hours), F.col("n"))), F.lit(0)) / float(velocity_hours)
    return counts.groupBy(item).agg(F.sum(F.col("n") * log_rate_decay(F.col("age"), half_life)).alias("decayed"), (near - before).alias("velocity"))


def view_statistics(events: DataFrame, item: str, user: str, seconds: str, done: Column) -> DataFrame:
    """(item, views, viewers, mean_seconds, completion): the mean is cut to whole seconds."""
    return events.groupBy(item).agg(
        F.count("*").alias("views"), F.countDistinct(user).alias("viewers"), F.floor(F.sum(seconds) / F.count("*")).cast("long").alias("mean_seconds"), F.avg(done.cast("int")).alias("completion")
    )


def share(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share) of the rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(key, "n", (F.col("n") / F.col("_all")).alias("share"))


def distribution_gap(actual: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row (gap): sum of absolute differences of actual(key, share) and target(key, goal)."""
    joined = actual.join(target, key, "full_outer")
    return joined.agg(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("goal", F.lit(0.0)))).alias("gap"))


def retention(reach: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, start, stop, retention): share of reach(viewer, reach) that got to the end of each of the few segments."""
    totals = reach.agg(F.count("*").alias("_n"))
    # The segments travel to the viewers, in one row, and never the other way round.
    listed = F.broadcast(segments.agg(F.collect_list(F.struct("segment", "start", "stop")).alias("_s")))
    passed = reach.crossJoin(listed).select(F.explode(F.filter("_s", lambda x: x["stop"] <= F.col("reach"))).alias("p"))
    hits = passed.groupBy("p.segment", "p.start", "p.stop").agg(F.count("*").alias("_h"))
    every = segments.select("segment", "start", "stop").join(F.broadcast(hits), ["segment", "start", "stop"], "left")
    return every.crossJoin(F.broadcast(totals)).where("_n > 0").select("segment", "start", "stop", (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("retention"))


def drop_offs(curve: DataFrame, order: str, value: str, least: float) -> DataFrame:
    """Rows where a curve falls by more than least against the row before, with the fall."""
    fall = F.lag(value).over(Window.orderBy(order)) - F.col(value)
    return curve.withColumn("fall", fall).where(F.col("fall") > least)


def cohorts(events: DataFrame, user: str, day: str, length: int) -> DataFrame:
    """(cohort, period, users): users by the period of their first event, and how many are seen in each later period."""
    first = events.groupBy(user).agg(F.min(day).alias("_first"))
    rows = events.select(user, day).distinct().join(first, user)
    period = F.floor(F.datediff(F.col(day), F.col("_first")) / length).cast("long")
    return rows.groupBy(F.col("_first").alias("cohort"), period.alias("period")).agg(F.countDistinct(user).alias("users"))


def funnel(events: DataFrame, user: str, kind: str, at: str, steps: Sequence[str]) -> DataFrame:
    """(step, name, users): users that did the steps in order, each after the one before."""
    rows = events.where(F.col(kind).isin(list(steps))).select(user, kind, at)
    reached = rows.where(F.col(kind) == steps[0]).groupBy(user).agg(F.min(at).alias("_since"))
    out = reached.agg(F.count("*").alias("users")).select(F.lit(1).cast("long").alias("step"), F.lit(steps[0]).alias("name"), "users")
    for i, name in enumerate(steps[1:], 2):
        later = rows.where(F.col(kind) == name).join(reached, user).where(F.col(at) > F.col("_since"))
        reached = later.groupBy(user).agg(F.min(at).alias("_since"))
        out = out.unionAll(reached.agg(F.count("*").alias("users")).select(F.lit(i).cast("long").alias("step"), F.lit(name).alias("name"), "users"))
    return out


def proportions_test(df: DataFrame, variant: str, hit: Column, a: str, b: str) -> DataFrame:
    """One row (n_a, n_b, p_a, p_b, z, winner): two-proportion z-test; a winner needs |z| >= 1.96."""
    v = lambda x: F.col(variant) == x
    h = hit.cast("double")
    sums = df.agg(
        F.sum(v(a).cast("long")).alias("n_a"), F.sum(v(b).cast("long")).alias("n_b"), F.avg(F.when(v(a), h)).alias("p_a"), F.avg(F.when(v(b), h)).alias("p_b"), F.avg(F.when(v(a) | v(b), h)).alias("p")
    )
    z = (F.col("p_b") - F.col("p_a")) / F.sqrt(F.col("p") * (1 - F.col("p")) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    winner = F.when(F.abs("z") < 1.96, "none").when(F.col("z") > 0, b).otherwise(a)
    return sums.withColumn("z", z).withColumn("winner", winner).drop("p")


def click_through(events: DataFrame, kind: str, by: Sequence[str], click: str, view: str) -> DataFrame:
    """(by..., clicks, views, ctr); 0 without views."""
    n = lambda x: F.sum((F.col(kind) == x).cast("long"))
    out = events.groupBy(*by).agg(n(click).alias("clicks"), n(view).alias("views"))
    return out.withColumn("ctr", F.when(F.col("views") > 0, F.col("clicks") / F.col("views")).otherwise(0.0))
