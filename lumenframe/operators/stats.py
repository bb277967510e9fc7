"""Aggregates, percentiles and distribution statistics.

Every operator takes a DataFrame and column names and returns a DataFrame. Groups are aggregated
with map-side partials; exact percentiles work on counts of distinct values, so a value that many
rows share is one row of the window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenframe.operators.order import positions, range_parts

#: How a percentile p (0 to 100) of n sorted values picks an index from 0.
INDEX_RULES = {
    "nearest": lambda n, p: F.greatest(F.ceil(n * p / 100.0) - 1, F.lit(0)),
    "floor": lambda n, p: F.floor((n - 1) * p / 100.0),
    "round": lambda n, p: F.floor((n - 1) * p / 100.0 + 0.5),
    "floor_n": lambda n, p: F.least(F.floor(n * p / 100.0), n - 1),
    "upper_median": lambda n, p: F.floor(n / 2),
}


def percentile(df: DataFrame, value: str, p: float, rule: str = "nearest", by: Sequence[str] = ()) -> DataFrame:
    """(by..., percentile): the value at the index that a rule of INDEX_RULES names, or interpolated ("linear").

    Nulls take no part; a group without values gives no row.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    if rule == "linear":
        return rows.groupBy(*by).agg(F.expr(f"percentile({value}, {p / 100.0!r}D)").alias("percentile")).where("percentile is not null")
    counts = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    frame = Window.partitionBy(*by)
    placed = counts.withColumns({"_upto": F.sum("_n").over(frame.orderBy("_v")), "_all": F.sum("_n").over(frame)})
    index = INDEX_RULES[rule](F.col("_all"), p)
    return placed.where(F.col("_upto") > index).groupBy(*by).agg(F.min("_v").alias("percentile")).where("percentile is not null")


#: Shares of the rows on either side of a rank that exact_quantiles() counts, far over the error of the sketch that finds them.
BRACKET, ACCURACY = 0.002, 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list]:
    """For each column the ceil(q n)-th smallest of its n values, for each q of shares; None if there is no value. Nulls take no part.

    A sketch only brackets a rank. What lies under the bracket is counted, and only the values inside it
    are counted one by one; should a bracket miss its rank, all values are. df is read a few times.
    """
    return {c: _ranked(df.select(F.col(c).alias("v")).where("v is not null"), shares) for c in columns}


def _ranked(values: DataFrame, shares: Sequence[float]) -> list:
    ends = sorted({min(max(e, 0.0), 1.0) for q in shares for e in (q - BRACKET, q + BRACKET)})
    total, least, most, near = values.agg(F.count("v"), F.min("v"), F.max("v"), F.percentile_approx("v", ends, ACCURACY)).first()
    if not total:
        return [None] * len(shares)
    near = dict(zip(ends, near, strict=True))
    ranks = [max(1, total - math.floor(total - q * total)) for q in shares]
    brackets = [(near[min(max(q - BRACKET, 0.0), 1.0)], near[min(max(q + BRACKET, 0.0), 1.0)]) for q in shares]
    for tried in (brackets, [(least, most)] * len(shares)):
        low = [F.lit(a) for a, _ in tried]
        under = values.agg(*[F.count(F.when(F.col("v") < x, 1)) for x in low]).first()
        inside = F.array_compact(F.array(*[F.when((F.col("v") >= x) & (F.col("v") <= F.lit(b)), i) for i, (x, (_, b)) in enumerate(zip(low, tried, strict=True))]))
        counts = values.select("v", F.explode(inside).alias("i")).groupBy("i", "v").agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
        want = F.element_at(F.array(*[F.lit(r - u).cast("long") for r, u in zip(ranks, under, strict=True)]), F.col("i") + 1)
        found = {r["i"]: r["v"] for r in upto.where((F.col("upto") >= want) & (F.col("upto") - F.col("n") < want)).select("i", "v").collect()}
        if len(found) == len(shares):
            return [found[i] for i in range(len(shares))]
    raise RuntimeError("values changed while they were ranked")


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, total, mean, low, high, spread): spread is the population standard deviation; an empty whole gives zeros."""
    v = F.col(value)
    out = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("spread")
    )
    return out if by else out.fillna(0)


def full_aggregate(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], p: float = 95.0) -> DataFrame:
    """(by..., low, high, mean, total, n, p, delta): delta is the last value less the first, in the order given."""
    at = F.struct(*order)
    out = df.groupBy(*by).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("n"),
        (F.max_by(value, at) - F.min_by(value, at)).alias("delta"),
    )
    return out.join(percentile(df, value, p, "floor", by).withColumnRenamed("percentile", "p"), list(by))


def rate_compliance(df: DataFrame, passing: Column, by: Sequence[str] = (), empty: float = 100.0) -> DataFrame:
    """(by..., n, passed, pct): 100 times the share of rows that pass; without rows, empty."""
    hit = F.coalesce(passing, F.lit(False)).cast("long")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("passed"), F.coalesce(F.avg(hit) * 100.0, F.lit(empty)).alias("pct")
    )


def tukey_outliers(df: DataFrame, value: str, by: Sequence[str] = (), least: int = 4) -> DataFrame:
    """Rows outside the fences of the interpolated quartiles, with severity mild (1.5) or extreme (3); groups under least rows have none."""
    by = list(by)
    quart = df.groupBy(*by).agg(F.count(value).alias("_n"), F.expr(f"percentile({value}, array(0.25D, 0.75D))").alias("_q"))
    joined = df.join(quart, by) if by else df.crossJoin(F.broadcast(quart))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    over = lambda k: (F.col(value) < q1 - (q3 - q1) * k) | (F.col(value) > q3 + (q3 - q1) * k)
    return joined.where((F.col("_n") >= least) & over(1.5)).withColumn("severity", F.when(over(3.0), "extreme").otherwise("mild")).drop("_n", "_q")


def _concordance(rows: DataFrame) -> DataFrame:
    """One row (s): the sum of sign(later v - earlier v) over the pairs of rows(a, v) with different a.

    Two values first differ at one bit of their ranks, so a pair is counted at that bit, among the rows of equal higher bits: rows by
    logarithm of the values. Such a group is cut into ranges of a; what stands in earlier ranges is known from their totals.
    """
    ranks = positions(rows.select("v").distinct(), "r", "v")
    top = ranks.count()
    ranked = range_parts(rows, "a").join(ranks, "v")
    bits = F.explode(F.sequence(F.lit(0), F.lit(max(0, top.bit_length() - 1)))).alias("b")
    each = ranked.select("a", "_part", "r", bits).select("a", "_part", "b", F.expr("shiftright(r, b + 1)").alias("g"), F.expr("shiftright(r, b) & 1").alias("one"))
    counts = each.groupBy("b", "g", "_part", "a").agg(F.sum("one").alias("ones"), F.sum(1 - F.col("one")).alias("zeros"))
    inside = Window.partitionBy("b", "g", "_part").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("b", "g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def crossed(df: DataFrame, frame: WindowSpec) -> DataFrame:
        before = {c: F.coalesce(F.sum(c).over(frame), F.lit(0)) for c in ("ones", "zeros")}
        return df.select((F.col("ones") * before["zeros"] - F.col("zeros") * before["ones"]).alias("s"))

    totals = counts.groupBy("b", "g", "_part").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    return crossed(counts, inside).unionAll(crossed(totals, over)).agg(F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("s"))


def mann_kendall(df: DataFrame, value: str, at: str) -> DataFrame:
    """One row (n, s, variance, z) of the trend test over (at, value); ties of value correct the variance. Rows with a null take no part."""
    rows = df.select(F.col(at).alias("a"), F.col(value).alias("v")).where("a is not null and v is not null")
    s = _concordance(rows)
    n = rows.agg(F.count("*").alias("n"))
    t = F.col("t").cast("double")
    ties = rows.groupBy("v").agg(F.count("*").alias("t")).agg(F.sum(t * (t - 1) * (2 * t + 5)).alias("ties"))
    nn = F.col("n").cast("double")
    joined = n.crossJoin(s).crossJoin(ties).withColumn("variance", (nn * (nn - 1) * (2 * nn + 5) - F.coalesce("ties", F.lit(0.0))) / 18.0)
    z = F.when((F.col("n") < 4) | (F.col("variance") <= 0), 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt("variance"))
    return joined.select("n", "s", "variance", z.alias("z"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, high, n) of an integer column, for every bin, by its upper bound: width is the range by the number of bins, rounded up; the last bin takes the rest.

    Equal values give one bin that ends at them; no values or no bins give none.
    """
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(float(bins))), F.lit(1)).cast("long")
    placed = df.crossJoin(F.broadcast(ends.withColumn("_w", width)))
    number = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("long")
    counts = placed.where(F.col(value).isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    last = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(bins - 1)
    every = ends.where(F.col("_lo").isNotNull() & F.lit(bins > 0)).withColumn("_w", width).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    high = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).cast("long")
    return every.join(counts, "bin", "left").select("bin", high.alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def grouping_report(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(kind, key, n, total): one scan, with the total and an independent sum for each key (grouping sets)."""
    sets = [[], *[[k] for k in keys]]
    named = df.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(value).alias("_v"))
    out = named.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.sum("_v").alias("total")
    )
    kind = F.lit("total")
    for i, k in enumerate(keys):
        kind = F.when(F.col("_g") == (2 ** len(keys) - 1) - 2 ** (len(keys) - 1 - i), k).otherwise(kind)
    return out.select(kind.alias("kind"), F.coalesce(*[F.col(k) for k in keys]).alias("key"), "n", "total")


def proportional(df: DataFrame, weight: str, total: float, by: Sequence[str] = (), uniform: bool = False) -> DataFrame:
    """df with share: total by weight; negative weights count as 0. Where the weights sum to 0 all shares are 0, or equal (uniform)."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    sums = df.groupBy(*by).agg(F.sum(w).alias("_s"), F.count("*").alias("_k"))
    joined = df.join(sums, list(by)) if by else df.crossJoin(F.broadcast(sums))
    return joined.withColumn("share", F.when(F.col("_s") > 0, F.lit(total) * w / F.col("_s")).otherwise(F.lit(total) / F.col("_k") if uniform else F.lit(0.0))).drop("_s", "_k")


def pooled_scores(df: DataFrame, score: str, by: Sequence[str]) -> DataFrame:
    """(by..., mean, harmonic, low, high, spread) of quality scores; the harmonic mean takes scores under 1e-10 as 1e-10."""
    safe = F.greatest(F.col(score), F.lit(1e-10))
    return df.groupBy(*by).agg(
        F.avg(score).alias("mean"), (F.count(score) / F.sum(1.0 / safe)).alias("harmonic"), F.min(score).alias("low"), F.max(score).alias("high"), F.stddev_pop(score).alias("spread")
    )


def gated_loudness(df: DataFrame, energy: str, by: Sequence[str], absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """(by..., lufs): mean energy of the blocks over an absolute gate, then over a gate relative to their mean."""
    by = list(by)
    loud = lambda e: -0.691 + 10.0 * F.log10(e)
    rows = df.where((F.col(energy) > 0) & (loud(F.col(energy)) > absolute))
    first = rows.groupBy(*by).agg(loud(F.avg(energy)).alias("_gate"))
    return rows.join(first, by).where(loud(F.col(energy)) > F.col("_gate") + relative).groupBy(*by).agg(loud(F.avg(energy)).alias("lufs"))


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats: none has both x and y at least as high and one of them higher.

    Rows are reduced to the best y of each x, then kept where y exceeds every y of larger x; the
    running maximum goes over distinct values of x only.
    """
    best = df.groupBy(F.col(x).alias("_x")).agg(F.max(y).alias("_y"))
    over = Window.orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("_m", F.max("_y").over(over)).where("_m is null or _y > _m").drop("_m")
    return df.join(front, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).drop("_x", "_y")


def rolling_z(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], size: int = 20) -> DataFrame:
    """df with z: the population z-score of a row among the last size rows, itself included; null for the first row or a flat window."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)
    mean, spread, n = F.avg(value).over(frame), F.stddev_pop(value).over(frame), F.count(value).over(frame)
    return df.withColumn("z", F.when((n >= 2) & (spread > 1e-12), (F.col(value) - mean) / spread))


def nth_last(df: DataFrame, order: Sequence[str], by: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each group with their rank from the end."""
    frame = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rank", F.row_number().over(frame)).where(F.col("rank") <= n)
