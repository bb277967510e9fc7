"""Similarity joins over vectors and bit strings, and exact-duplicate groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenframe.functions import vectors as V
from lumenframe.operators import blocks
from lumenframe.session import broadcast_if_small, let

#: Rows of a stated query set that are broadcast; a larger set meets the items in a join that Spark plans itself.
QUERIES = 50_000
#: Rests by which a short name meets others.
RESTS = 4000


#: Scores that blocks.best() knows, with the order in which it ranks them.
KERNELS = {
    (V.cosine, True): blocks.Angle(False), (V.pearson, True): blocks.Angle(True), (V.l2, False): blocks.Euclid(False), (V.l2_likeness, True): blocks.Euclid(True), (V.l1, False): blocks.Manhattan(),
}


def nearest(queries: DataFrame, items: DataFrame, ident: str, vector: str, k: int, score: Callable[[Column, Column], Column], descending: bool, exclude_self: bool = True) -> DataFrame:
    """(query, item, score, rank): the k best items of each query vector; ties go to the smaller item.

    Scores of KERNELS are taken in blocks, those of vectors that have another length than most queries or
    odd components and all other scores by the column expression.
    """
    q = queries.select(F.col(ident).alias("query"), V.doubles(F.col(vector)).alias("_q"))
    i = items.select(F.col(ident).alias("item"), V.doubles(F.col(vector)).alias("_i"))

    def expressed(q: DataFrame, i: DataFrame) -> DataFrame:
        small = broadcast_if_small(q, QUERIES)
        met = i.join(small, F.col("query") != F.col("item")) if exclude_self else i.crossJoin(small)
        return met.select("query", "item", score(F.col("_q"), F.col("_i")).alias("score"))

    kernel, whole = KERNELS.get((score, descending)), all(isinstance(df.schema[c].dataType, IntegralType) for df, c in ((q, "query"), (i, "item")))
    size = q.agg(F.mode(F.when(F.size("_q") > 0, F.size("_q")))).first()[0] if kernel and whole else None
    if size is None or size > blocks.LONGEST:
        scored = expressed(q, i)
    else:
        fits = lambda v, n: F.coalesce(F.col(n).isNotNull() & (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < blocks.LARGEST)), F.lit(False))
        good, fit = fits("_q", "query"), fits("_i", "item")
        scored = blocks.best(q.where(good), i.where(fit), size, k, kernel, exclude_self)
        if not i.where(~fit).isEmpty():
            scored = scored.unionAll(expressed(q.where(good), i.where(~fit)))
        if not q.where(~good).isEmpty():
            scored = scored.unionAll(expressed(q.where(~good), i))
    order = [F.desc("score") if descending else F.col("score"), F.col("item")]
    return scored.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def nearest_assets(queries: DataFrame, items: DataFrame, ident: str, vector: str, asset: str, most: float) -> DataFrame:
    """(query, asset, distance): the least Euclidean distance of the items of an asset to each query, up to most.

    Vectors that blocks.least_distances() does not take, as in nearest(), are compared by an expression.
    """
    q = queries.select(F.col(ident).alias("query"), V.doubles(F.col(vector)).alias("_q"))
    i = items.select(F.col(asset).alias("asset"), V.doubles(F.col(vector)).alias("_i"))

    def expressed(q: DataFrame, i: DataFrame) -> DataFrame:
        far = F.sqrt(F.aggregate(F.zip_with("_q", "_i", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
        return i.crossJoin(broadcast_if_small(q, QUERIES)).select("query", "asset", far.alias("distance")).where(F.col("distance") <= most)

    whole = isinstance(q.schema["query"].dataType, IntegralType)
    size = q.agg(F.mode(F.when(F.size("_q") > 0, F.size("_q")))).first()[0] if whole else None
    if size is None or size > blocks.LONGEST:
        met = expressed(q, i)
    else:
        fits = lambda v: F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < blocks.LARGEST)), F.lit(False))
        good, fit = fits("_q") & F.col("query").isNotNull(), fits("_i")
        met = blocks.least_distances(q.where(good), i.where(fit), size, most)
        if not i.where(~fit).isEmpty():
            met = met.unionAll(expressed(q.where(good), i.where(~fit)))
        if not q.where(~good).isEmpty():
            met = met.unionAll(expressed(q.where(~good), i))
    return met.groupBy("query", "asset").agg(F.min("distance").alias("distance"))


def hamming_pairs(items: DataFrame, ident: str, code: str, bits: int, radius: int) -> DataFrame:
    """(a, b, distance), a < b: pairs of codes of bits bits within radius, found by blocks.

    radius + 2 blocks of the code: a pair within the radius agrees on two at least, and meets under each
    two. The first two that it agrees on give it out, so no pair comes twice.
    """
    n = radius + 2
    edges = [bits * i // n for i in range(n + 1)]
    masks = [((1 << y) - 1) ^ ((1 << x) - 1) for x, y in zip(edges, edges[1:], strict=False)]
    signed = lambda x: F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")
    # upto: the blocks to the second one as bits; both: the two blocks.
    twos = [(i, j) for j in range(n) for i in range(j)]
    keys = F.array(*[F.struct(F.lit(t).alias("two"), F.col(code).bitwiseAND(signed(masks[i] | masks[j])).alias("v"), F.lit((2 << j) - 1).alias("upto"), F.lit(1 << i | 1 << j).alias("both")) for t, (i, j) in enumerate(twos)])
    rows = items.where(F.col(ident).isNotNull() & F.col(code).isNotNull()).select(F.col(ident).alias("id"), F.col(code).cast("long").alias("c"), F.explode(keys).alias("k")).select("id", "c", "k.*")
    a, b = rows.select(F.col("id").alias("a"), F.col("c").alias("ca"), "two", "v", "upto", "both"), rows.select(F.col("id").alias("b"), F.col("c").alias("cb"), "two", "v")
    apart = F.col("ca").bitwiseXOR(F.col("cb"))
    agree = sum((F.when(apart.bitwiseAND(signed(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    met = a.join(b, ["two", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & (agree.bitwiseAND(F.col("upto")) == F.col("both")))
    return met.select("a", "b", F.bit_count(apart).alias("distance"))


def hamming_query(queries: DataFrame, items: DataFrame, ident: str, code: str, radius: int) -> DataFrame:
    """(query, item, distance) of all items but the query itself within radius; the queries go in blocks to all cores."""
    return blocks.hamming(*_coded(queries, items, ident, code), radius).select("query", "item", "distance")


def _coded(queries: DataFrame, items: DataFrame, ident: str, code: str) -> tuple[DataFrame, DataFrame]:
    return queries.select(F.col(ident).alias("query"), F.col(code).alias("_q")), items.select(F.col(ident).alias("item"), F.col(code).alias("_c"))


def ratio_match(queries: DataFrame, items: DataFrame, ident: str, code: str, most: int, ratio: float) -> DataFrame:
    """(query, item, best, second): the nearest item of each query if it lies within most and under ratio times the second."""
    # The two least distances of a query in each block of items hold those of all.
    found = blocks.hamming(*_coded(queries, items, ident, code), 64, two=True).groupBy("query", "distance").agg(F.min("item").alias("item"), F.sum("n").alias("n"))
    pair = found.groupBy("query").agg(
        F.min_by("item", "distance").alias("item"), F.min("distance").alias("best"), F.min_by("n", "distance").alias("n"), F.sort_array(F.collect_list("distance")).alias("all")
    )
    pair = pair.select("query", "item", "best", F.when(F.col("n") > 1, F.col("best")).otherwise(F.get("all", F.lit(1))).alias("second"))
    return pair.where((F.col("best") <= most) & (F.col("second") > 0) & (F.col("best") < ratio * F.col("second")))


def fuzzy_names(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(a, b, score) of left(a) and right(b) names within most edits: 1 - distance / longer length.

    Names within the distance have a common rest after at most most deletions from each, so they meet by
    the hashes of such rests, which few names share even if they all begin alike. A name has some
    RESTS of them at most: longer names meet by pieces.
    """
    lefts, rights = left.select("a").distinct(), right.select("b").distinct()
    limit = int(RESTS ** (1 / max(1, most)))
    short = _rests(lefts.where(F.length("a") <= limit), "a", most).join(_rests(rights.where(F.length("b") <= limit + most), "b", most), "_h").select("a", "b")
    met = short.unionAll(_by_pieces(lefts.where(F.length("a") > limit), rights.where(F.length("b") > limit - most), most))
    d = F.levenshtein("a", "b")
    met = met.where(F.abs(F.length("a") - F.length("b")) <= most).where(d <= most).distinct()
    return met.select("a", "b", (1 - d / F.greatest(F.length("a"), F.length("b"), F.lit(1))).alias("score"))


def _rests(df: DataFrame, name: str, most: int) -> DataFrame:
    """(name, _h): hashes of what is left of each name after at most most deletions."""
    places = lambda x: F.filter(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: i <= F.length(x))
    cut = lambda x: F.transform(places(x), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    every = F.array(F.col(name))
    for _ in range(most):
        every = let(every, lambda rests: F.array_distinct(F.concat(rests, F.flatten(F.transform(rests, cut)))))
    return df.select(name, F.explode(every).alias("_r")).select(name, F.xxhash64("_r").alias("_h"))


def _by_pieces(lefts: DataFrame, rights: DataFrame, most: int) -> DataFrame:
    """(a, b) of lefts(a) and rights(b) that share a piece: cut into most + 1 parts, one part of a stays whole in any name within the distance, at a place that moved by at most that many characters."""
    n = F.length("a")
    cuts = [F.floor(n * i / (most + 1)).cast("int") for i in range(most + 2)]
    pieces = F.array(*[F.struct(F.lit(i).alias("part"), F.substr(F.col("a"), x + 1, y - x).alias("piece"), x.alias("at"), n.alias("size")) for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))])
    index = lefts.select("a", F.explode(pieces).alias("k")).select("a", "k.part", "k.piece", "k.at", "k.size")
    sizes = index.select("size", "part", "at", F.length("piece").alias("len")).distinct()
    probe = rights.join(F.broadcast(sizes), F.abs(F.length("b") - F.col("size")) <= most)
    shifts = F.explode(F.sequence(F.greatest(F.col("at") - most, F.lit(0)), F.col("at") + most))
    probe = probe.withColumn("_s", shifts).select("b", "size", "part", F.substr(F.col("b"), F.col("_s") + 1, F.col("len")).alias("piece")).distinct()
    return probe.join(index, ["size", "part", "piece"]).select("a", "b")


def duplicate_groups(df: DataFrame, key: Column, ident: str) -> DataFrame:
    """(digest, n, first): groups of rows with equal keys, more than one.

    A group is given by its count and least member; its rows are found by joining on the digest, so
    that a group of any size is never one row.
    """
    rows = df.select(key.alias("digest"), F.col(ident).alias("_id"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("_id").alias("first")).where("n > 1")


def duplicate_stats(df: DataFrame, key: Column, size: str, ident: str) -> DataFrame:
    """One row (total, uniques, wasted, ratio): wasted bytes are those of all members after the first of a group; ratio is 1 if there are no rows."""
    rows = df.select(key.alias("k"), F.col(size).alias("s"), F.col(ident).alias("i"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("s").alias("all"), F.min_by("s", "i").alias("kept"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("uniques"), F.coalesce(F.sum(F.col("all") - F.col("kept")), F.lit(0)).alias("wasted"))
    return out.withColumn("ratio", F.when(F.col("total") == 0, 1.0).otherwise(F.col("uniques") / F.col("total")))


def tags_all(bridge: DataFrame, item: str, tag: str, wanted: Sequence[str]) -> DataFrame:
    """Items that have every wanted tag; none if no tag is wanted."""
    hit = bridge.where(F.col(tag).isin(list(wanted))).select(item, tag).distinct()
    return hit.groupBy(item).agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(wanted))).where(F.lit(bool(wanted))).select(item)


def tags_any(bridge: DataFrame, item: str, tag: str, wanted: Sequence[str]) -> DataFrame:
    """Items that have one of the wanted tags."""
    return bridge.where(F.col(tag).isin(list(wanted))).select(item).distinct()


def co_tags(bridge: DataFrame, item: str, tag: str, given: str) -> DataFrame:
    """(tag, n): tags that stand beside a given one, by how many items."""
    mine = bridge.where(F.col(tag) == given).select(item).distinct()
    return bridge.select(item, tag).distinct().where(F.col(tag) != given).join(mine, item, "left_semi").groupBy(tag).agg(F.count("*").alias("n"))
