"""Viewer analytics: experiments, attribution, coverage, retention curves, bandits; and map-valued search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import broadcast_if_small


def assign_variants(df: DataFrame, user: str, weights: Mapping[str, float], salt: str = "") -> DataFrame:
    """df with variant: the same for a user each time, in proportion to the weights."""
    place = F.pmod(F.xxhash64(F.concat_ws("\x1f", F.lit(salt), F.col(user).cast("string"))), F.lit(1_000_000)) / 1e6
    total, upto, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        upto += w / total
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return df.withColumn("variant", out.otherwise(list(weights)[-1]))


def attribute_time(watched: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, seconds, viewers): time of watched(viewer, s, e) that falls in each of the few segments(segment, s, e)."""
    seg = segments.select("segment", F.col("s").alias("_s"), F.col("e").alias("_e"))
    met = watched.join(broadcast_if_small(seg, 10_000), (F.col("s") < F.col("_e")) & (F.col("_s") < F.col("e")))
    return met.groupBy("segment").agg(F.sum(F.least("e", "_e") - F.greatest("s", "_s")).alias("seconds"), F.countDistinct("viewer").alias("viewers"))


def coverage(watched: DataFrame, width: int) -> DataFrame:
    """(slot, views): how many of watched(s, e) cover each slot of width; spans go to their own slots only."""
    slots = F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))
    return watched.where("s < e").select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count("*").alias("views"))


def retention_curve(reach: DataFrame, points: int, length: float) -> DataFrame:
    """(point, share, area) of reach(viewer, reach, weight): weighted share that got to each checkpoint, and the area under the curve up to it."""
    spark = reach.sparkSession
    marks = spark.range(points + 1).select(F.col("id").alias("point"), (F.col("id") * length / points).alias("at"))
    # Viewers are counted by the last checkpoint they reach; the suffix sums go over the checkpoints only.
    last = F.least(F.floor(F.col("reach") / (length / points)), F.lit(points)).cast("long")
    counts = reach.where("reach >= 0").groupBy(last.alias("point")).agg(F.sum("weight").alias("w"))
    rows = marks.join(counts, "point", "left").fillna(0.0, ["w"])
    behind = F.sum("w").over(Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0))
    total = reach.agg(F.sum("weight").alias("_t"))
    shared = rows.withColumn("_b", behind).crossJoin(F.broadcast(total)).withColumn("share", F.col("_b") / F.col("_t"))
    order = Window.orderBy("point")
    step = (F.col("share") + F.coalesce(F.lag("share").over(order), F.col("share"))) / 2 * F.when(F.col("point") == 0, 0.0).otherwise(length / points)
    return shared.withColumn("_s", step).select("point", "share", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("area"))


def bandit_choice(rewards: DataFrame, arm: str, reward: str, epsilon: float) -> DataFrame:
    """(arm, mean, n, p): epsilon-greedy chances: the best arm (ties: the smaller name) gets 1 - epsilon more than the others."""
    arms = rewards.groupBy(arm).agg(F.avg(reward).alias("mean"), F.count("*").alias("n"))
    best = arms.agg(F.min_by(arm, F.struct(-F.col("mean"), arm)).alias("_b"), F.count("*").alias("_k"))
    return arms.crossJoin(F.broadcast(best)).select(arm, "mean", "n", (F.lit(epsilon) / F.col("_k") + F.when(F.col(arm) == F.col("_b"), 1 - epsilon).otherwise(0.0)).alias("p"))


def search_fields(df: DataFrame, fields: str, wanted: Mapping[str, str], terms: Sequence[str] = (), path: str | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Rows whose map column holds each wanted substring under its key and each term in any value or the path; excluded paths go."""
    low = F.transform(F.map_values(fields), lambda v: F.lower(v))
    condition = F.lit(True)
    for key, part in wanted.items():
        condition = condition & F.coalesce(F.lower(F.try_element_at(F.col(fields), F.lit(key))).contains(part.lower()), F.lit(False))
    for term in terms:
        hit = F.array_join(low, "\n").contains(term.lower())
        condition = condition & ((hit | F.lower(F.col(path)).contains(term.lower())) if path else hit)
    if path and excluded:
        condition = condition & ~F.col(path).isin(list(excluded))
    return df.where(F.coalesce(condition, F.lit(False)))


def best_alignment(query: Column, target: Column, bits: int = 64, steps: int = 256) -> Column:
    """struct(similarity, offset): the best place of a query array of codes in a target; offsets go in steps of the span by steps.

    A target shorter than the query is compared with the query's beginning, an empty one has similarity 0. Null for an empty query.
    """
    span = F.size(target) - F.size(query)
    step = F.greatest(F.lit(1), F.floor(span / steps).cast("int"))

    def at(o: Column) -> Column:
        apart = F.aggregate(F.zip_with(query, F.slice(target, o + 1, F.size(query)), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, d: a + d)
        return F.struct((1 - apart / (F.size(query) * F.lit(float(bits)))).alias("similarity"), (-o).alias("back"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), span, step), at))
    met = F.aggregate(F.zip_with(F.slice(query, 1, F.size(target)), target, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, d: a + d)
    near = F.when(F.size(target) > 0, 1 - met / (F.size(target) * F.lit(float(bits)))).otherwise(0.0)
    short = F.struct(near.alias("similarity"), F.lit(0).alias("offset"))
    return F.when(F.size(query) <= 0, None).when(span < 0, short).otherwise(F.struct(best["similarity"].alias("similarity"), (-best["back"]).alias("offset")))


def colour_distance(colours: Column, r: float, g: float, b: float) -> Column:
    """Least squared distance of any of an array of struct(r, g, b) to a colour."""
    return F.array_min(F.transform(colours, lambda c: (c["r"] - r) ** 2 + (c["g"] - g) ** 2 + (c["b"] - b) ** 2))


def merge_shards(shards: Sequence[DataFrame], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of all shards: each gives its own k best, so only those meet."""
    best = None
    for shard in shards:
        one = shard.orderBy(F.desc(score), tie).limit(k)
        best = one if best is None else best.unionByName(one)
    return best.orderBy(F.desc(score), tie).limit(k)


def flush_words(words: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Words(track, at, word) before a cutoff as committed text of each track, and those that stay."""
    gone = words.where(F.col("at") < cutoff).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return gone.select("track", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text")), words.where(F.col("at") >= cutoff)


def soft_novelty(items: Column, seen: Column) -> Column:
    """1 less the share of items that were seen; 1 for none."""
    return F.when(F.size(items) == 0, 1.0).otherwise(1 - F.size(F.filter(items, lambda x: F.array_contains(seen, x))) / F.size(items))


def digest_bits(name: Column) -> Column:
    """Width of a digest by name."""
    return F.when(F.lower(name).isin("md5"), 128).when(F.lower(name).isin("sha1", "sha-1"), 160).when(F.lower(name).isin("sha256", "sha-256", "blake3"), 256).when(F.lower(name).isin("sha512", "sha-512"), 512).when(F.lower(name).isin("crc32"), 32)
