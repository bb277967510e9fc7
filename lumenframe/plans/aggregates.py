"""Aggregation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.scores import half_life_weight, royalty_cents
from lumenframe.operators import stats
from lumenframe.plans.common import EV, HOUR, LI, OD, events, lineitem, orders
from lumenframe.session import table

r6 = lambda c: F.round(c, 6)


def trending_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by decayed views times the log of distinct viewers; half-life one day before the last event."""
    rows = events(spark, sf_dir).select("event_type", "user_id", "t", "value")
    aged = rows.crossJoin(F.broadcast(rows.agg(F.max("t").alias("now"))))
    weight = half_life_weight((F.col("now") - F.col("t")) / 1e6, 86400.0)
    scored = aged.groupBy(F.col("event_type").alias("item")).agg(F.sum(weight).alias("w"), F.countDistinct("user_id").alias("viewers"), r6(F.avg("value")).alias("mean_value"))
    score = r6(F.col("w") * F.greatest(F.log(F.col("viewers") + 1.0), F.lit(1.0)))
    return scored.select("item", score.alias("score"), "viewers", "mean_value").orderBy(F.desc("score"), "item").limit(20)


def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, sum, mean and extremes of document sizes."""
    out = stats.summary(table(spark, sf_dir, "documents"), "n_chars")
    return out.select("n", "total", r6("mean").alias("mean"), "low", "high")


def storage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sizes by kind of source."""
    kind = F.when(F.col("source").like("src0%"), "primary").when(F.col("source").like("src1%"), "secondary").otherwise("other")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))


def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rollup of each metric."""
    hour = F.floor(F.col("t") / HOUR).cast("long").alias("hour")
    return events(spark, sf_dir).groupBy("event_type", hour).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), r6(F.avg("value")).alias("mean"), r6(F.sum("value")).alias("total"), F.count("value").alias("n")
    )


def metric_rollup_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a metric by the grain that suits the range: over 7 days by day, over 24 hours by hour, over 2 hours by minute."""
    rows = events(spark, sf_dir).where("event_type = 'view'").select("t", "value")
    ends = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    span = F.col("hi") - F.col("lo")
    grain = F.when(span > 7 * 24 * HOUR, 24 * HOUR).when(span > 24 * HOUR, HOUR).when(span > 2 * HOUR, HOUR // 60).otherwise(1)
    joined = rows.crossJoin(F.broadcast(ends.withColumn("grain", grain.cast("long"))))
    return joined.groupBy(F.floor(F.col("t") / F.col("grain")).cast("long").alias("slot")).agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("n"))


def metric_aggregate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven aggregates of each metric."""
    out = stats.full_aggregate(events(spark, sf_dir), "value", ["t", "event_id"], ["event_type"])
    return out.select("event_type", "low", "high", r6("mean").alias("mean"), r6("total").alias("total"), "n", "p", r6("delta").alias("delta"))


def percentile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 90th percentile of each event type by every rule."""
    rows, out = events(spark, sf_dir), None
    for rule in ("nearest", "floor", "round", "floor_n", "upper_median", "linear"):
        one = stats.percentile(rows, "value", 90.0, rule, ["event_type"]).select(F.lit(rule).alias("rule"), "event_type", r6("percentile").alias("percentile"))
        out = one if out is None else out.unionAll(one)
    return out


def slo_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of events of each type within the objective."""
    return stats.rate_compliance(events(spark, sf_dir), F.col("value") <= 100.0, ["event_type"]).withColumn("pct", r6("pct"))


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside the Tukey fences of their type."""
    return stats.tukey_outliers(events(spark, sf_dir).select("event_id", "event_type", "value"), "value", ["event_type"]).select("event_id", "event_type", "value", "severity")


def mann_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend test of the daily number of events."""
    daily = events(spark, sf_dir).groupBy(F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.count("*").alias("n"))
    return stats.mann_kendall(daily.select("day", F.col("n").alias("v")), "v", "day").select("n", "s", r6("variance").alias("variance"), r6("z").alias("z"))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by whole-number price in ten bins."""
    return stats.histogram(table(spark, sf_dir, "lineitem").select(F.floor("l_extendedprice").alias("v")), "v", 10)


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sample deviation and objective of the prices by return flag."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(
        r6(F.avg("l_extendedprice")).alias("mean"), r6(F.stddev_samp("l_extendedprice")).alias("deviation"), F.sum((F.col("l_extendedprice") > 50000).cast("long")).alias("violations"),
        r6(F.avg((F.col("l_extendedprice") <= 50000).cast("double")) * 100).alias("pct"),
    )


def throughput_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of returned items against all others; 1 where the latter is 0."""
    rows = table(spark, sf_dir, "lineitem").agg(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("c"), F.avg(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("b"))
    return rows.select(r6(F.when(F.col("b") == 0, 1.0).otherwise(F.col("c") / F.col("b"))).alias("speedup"))


def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in all and by flag, status and supplier region, in one scan."""
    rows = lineitem(spark, sf_dir).where((F.col("d") >= 9000) & (F.col("d") <= 11000))
    return stats.grouping_report(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_quantity").withColumn("total", r6("total"))


def usage_by_territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by the nation of the customer, largest first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    summed = rows.groupBy("c_nationkey").agg(F.sum("l_quantity").alias("plays"))
    return summed.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("territory"), r6("plays").alias("plays")).orderBy(F.desc("plays"), "territory")


def royalty_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents due by ship status, each line at 1250 basis points, cut to cents."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.sum(royalty_cents(cents, F.lit(1250).cast("long"))).alias("due"), F.count("*").alias("n"))


def revenue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total of 1,000,000 dealt to customers by their balance."""
    return stats.proportional(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1_000_000.0).select("c_custkey", r6("share").alias("share"))


def pooled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled scores of each event type."""
    out = stats.pooled_scores(events(spark, sf_dir), "value", ["event_type"])
    return out.select("event_type", *[r6(c).alias(c) for c in ("mean", "harmonic", "low", "high", "spread")])


def gated_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage gated mean of each event type, values as energies."""
    return stats.gated_loudness(events(spark, sf_dir), "value", ["event_type"]).select("event_type", r6("lufs").alias("lufs"))


def heatmap_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of day and value band, by the densest cell."""
    rows = events(spark, sf_dir).where((F.col("value") >= 0) & (F.col("value") < 200))
    cells = rows.groupBy(F.floor(F.col("t") / HOUR % 24).cast("long").alias("x"), F.floor(F.col("value") / 10).cast("long").alias("y")).agg(F.count("*").alias("n"))
    return cells.crossJoin(F.broadcast(cells.agg(F.max("n").alias("m")))).select("x", "y", "n", r6(F.col("n") / F.col("m")).alias("density"))


def rating_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by language: number, mean, deviation and a histogram of the quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(
        F.count("*").alias("n"), r6(F.avg("quality")).alias("mean"), r6(F.stddev_pop("quality")).alias("spread"), F.sum((F.col("quality") == 0).cast("long")).alias("zeros"), F.sum((F.col("quality") == 1).cast("long")).alias("ones")
    )


def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All and healthy events in all and by type (rollup)."""
    ok = (F.col("event_type") != "error").cast("long")
    return events(spark, sf_dir).rollup("event_type").agg(F.count("*").alias("n"), F.sum(ok).alias("healthy"))


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with over 4 % of the retail price of all parts."""
    parts = table(spark, sf_dir, "part")
    total = parts.agg(F.sum("p_retailprice").alias("all"))
    by = parts.groupBy("p_brand").agg(F.sum("p_retailprice").alias("own")).crossJoin(F.broadcast(total))
    return by.select("p_brand", r6(F.col("own") / F.col("all") * 100).alias("pct")).where("pct >= 4").orderBy(F.desc("pct"), "p_brand")


def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no other part beats in size and price."""
    return stats.pareto_front(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


def expiring_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose 90-day window ends within the 30 days after the last order."""
    rows = orders(spark, sf_dir)
    now = rows.agg(F.max("d").alias("now"))
    ends = rows.withColumn("ends", F.col("d") + 90).crossJoin(F.broadcast(now))
    return ends.where((F.col("ends") >= F.col("now")) & (F.col("ends") <= F.col("now") + 30)).select("o_orderkey", "ends", (F.col("ends") - F.col("now")).alias("left_days"))


def fixity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose stored size is not that of the text, by source, with a verdict."""
    bad = (F.char_length("text") != F.col("n_chars")).cast("long")
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(bad).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "Healthy").when(F.col("failed") <= F.floor(F.col("n") / 2), "Degraded").otherwise("Critical"))


def geo_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by segment and nation (cube)."""
    rows = table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), r6(F.sum("c_acctbal")).alias("total"))
    return rows


def engagement_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares slope of the daily mean value of each event type."""
    daily = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.avg("value").alias("m"))
    return daily.groupBy("event_type").agg(r6(F.regr_slope("m", "day")).alias("slope"), r6(F.corr("m", "day")).alias("r"))


QUERIES = {
    "trending_topk": (trending_topk, f"""with {EV}, n as (select max(t) as now from ev)
        select event_type as item, round(sum(pow(0.5, (now - t) / 1e6 / 86400.0)) * greatest(ln(count(distinct user_id) + 1.0), 1.0), 6) as score,
          count(distinct user_id) as viewers, round(avg(value), 6) as mean_value from ev, n group by event_type order by score desc, item limit 20"""),
    "storage_stats": (storage_stats, "select count(n_chars) n, coalesce(sum(n_chars), 0)::bigint total, round(avg(n_chars), 6) mean, min(n_chars) low, max(n_chars) high from documents"),
    "storage_by_type": (storage_by_type, """select case when source like 'src0%' then 'primary' when source like 'src1%' then 'secondary' else 'other' end kind,
        count(*) n, sum(n_chars)::bigint total from documents group by 1"""),
    "metric_rollup": (metric_rollup, f"""with {EV} select event_type, t // {HOUR} as hour, min(value) low, max(value) high, round(avg(value), 6) mean, round(sum(value), 6) total, count(value) n from ev group by 1, 2"""),
    "metric_rollup_smart": (metric_rollup_smart, f"""with {EV}, v as (select t, value from ev where event_type = 'view'), g as (select case when max(t) - min(t) > {7 * 24 * HOUR} then {24 * HOUR}
        when max(t) - min(t) > {24 * HOUR} then {HOUR} when max(t) - min(t) > {2 * HOUR} then {HOUR // 60} else 1 end as grain from v)
        select t // grain as slot, round(avg(value), 6) mean, count(*) n from v, g group by 1"""),
    "metric_aggregate_all": (metric_aggregate_all, f"""with {EV}, s as (select event_type, list_sort(list(value)) l from ev group by 1),
        a as (select event_type, min(value) low, max(value) high, round(avg(value), 6) mean, round(sum(value), 6) total, count(value) n,
          round(arg_max(value, (t, event_id)) - arg_min(value, (t, event_id)), 6) delta from ev group by 1)
        select event_type, low, high, mean, total, n, l[floor((n - 1) * 95.0 / 100.0)::bigint + 1] p, delta from a join s using (event_type)"""),
    "percentile_rules": (percentile_rules, """with s as (select event_type, list_sort(list(value)) l, count(value) n, quantile_cont(value, 0.9) q from events where value is not null group by 1)
        select 'nearest' as rule, event_type, round(l[greatest(ceil(n * 90.0 / 100.0)::bigint - 1, 0) + 1], 6) percentile from s
        union all select 'floor', event_type, round(l[floor((n - 1) * 90.0 / 100.0)::bigint + 1], 6) from s
        union all select 'round', event_type, round(l[floor((n - 1) * 90.0 / 100.0 + 0.5)::bigint + 1], 6) from s
        union all select 'floor_n', event_type, round(l[least(floor(n * 90.0 / 100.0)::bigint, n - 1) + 1], 6) from s
        union all select 'upper_median', event_type, round(l[n // 2 + 1], 6) from s
        union all select 'linear', event_type, round(q, 6) from s"""),
    "slo_compliance": (slo_compliance, "select event_type, count(*) n, sum((value <= 100)::bigint)::bigint passed, round(avg((value <= 100)::int) * 100, 6) pct from events group by 1"),
    "iqr_outliers": (iqr_outliers, """with q as (select event_type, count(value) n, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 from events group by 1)
        select event_id, event_type, value, case when value < q1 - 3 * (q3 - q1) or value > q3 + 3 * (q3 - q1) then 'extreme' else 'mild' end severity
        from events join q using (event_type) where n >= 4 and (value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1))"""),
    "mann_kendall": (mann_kendall, f"""with {EV}, d as (select t // {24 * HOUR} a, count(*) v from ev group by 1), s as (select sum(sign(y.v - x.v))::bigint s from d x join d y on x.a < y.a),
        n as (select count(*) n from d), k as (select sum(c * (c - 1) * (2 * c + 5))::double ties from (select count(*) c from d group by v)),
        r as (select n, s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 variance from n, s, k)
        select n, s, round(variance, 6) variance, round(case when n < 4 or variance <= 0 then 0.0 else (s - sign(s)) / sqrt(variance) end, 6) z from r"""),
    "latency_histogram": (latency_histogram, """with v as (select floor(l_extendedprice)::bigint v from lineitem), e as (select min(v) lo, greatest(ceil((max(v) - min(v)) / 10.0), 1)::bigint w from v)
        select bin, lo + (bin + 1) * w high, count(v) n from e, unnest(range(10)) t(bin) left join v on least((v - lo) // w, 9) = bin group by 1, 2"""),
    "latency_summary": (latency_summary, """select l_returnflag, round(avg(l_extendedprice), 6) mean, round(stddev_samp(l_extendedprice), 6) deviation, sum((l_extendedprice > 50000)::bigint)::bigint violations,
        round(avg((l_extendedprice <= 50000)::int) * 100, 6) pct from lineitem group by 1"""),
    "throughput_speedup": (throughput_speedup, "select round(avg(l_quantity) filter (where l_returnflag = 'R') / avg(l_quantity) filter (where l_returnflag <> 'R'), 6) speedup from lineitem"),
    "cost_report": (cost_report, f"""with {LI}, f as (select * from li where d between 9000 and 11000)
        select 'total' kind, null::varchar as key, count(*) n, round(sum(l_quantity), 6) total from f union all select 'l_returnflag', l_returnflag, count(*), round(sum(l_quantity), 6) from f group by 2
        union all select 'l_linestatus', l_linestatus, count(*), round(sum(l_quantity), 6) from f group by 2 union all select 'l_linenumber', l_linenumber::varchar, count(*), round(sum(l_quantity), 6) from f group by 2"""),
    "usage_by_territory": (usage_by_territory, """select n_name territory, round(sum(l_quantity), 6) plays from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey group by 1 order by plays desc, territory"""),
    "royalty_amounts": (royalty_amounts, "select l_linestatus, sum(round(l_extendedprice * 100)::bigint * 1250 // 10000)::bigint due, count(*) n from lineitem group by 1"),
    "revenue_share": (revenue_share, """with s as (select sum(greatest(c_acctbal, 0)) s from customer) select c_custkey, round(1000000.0::double * greatest(c_acctbal, 0) / s, 6) share from customer, s"""),
    "pooled_quality": (pooled_quality, """select event_type, round(avg(value), 6) mean, round(count(value) / sum(1 / greatest(value, 1e-10)), 6) harmonic, round(min(value), 6) low, round(max(value), 6) high,
        round(stddev_pop(value), 6) spread from events group by 1"""),
    "gated_loudness": (gated_loudness, """with g as (select event_type, -0.691 + 10 * log10(avg(value)) gate from events where value > 0 and -0.691 + 10 * log10(value) > -70 group by 1)
        select event_type, round(-0.691 + 10 * log10(avg(value)), 6) lufs from events join g using (event_type) where value > 0 and -0.691 + 10 * log10(value) > -70 and -0.691 + 10 * log10(value) > gate - 10 group by 1"""),
    "heatmap_density": (heatmap_density, f"""with {EV}, c as (select (t // {HOUR}) % 24 x, floor(value / 10)::bigint y, count(*) n from ev where value >= 0 and value < 200 group by 1, 2)
        select x, y, n, round(n / (select max(n) from c), 6) density from c"""),
    "rating_statistics": (rating_statistics, """select lang, count(*) n, round(avg(quality), 6) mean, round(stddev_pop(quality), 6) spread, sum((quality = 0)::bigint)::bigint zeros, sum((quality = 1)::bigint)::bigint ones
        from labels join documents using (doc_id) group by 1"""),
    "health_summary": (health_summary, "select event_type, count(*) n, sum((event_type <> 'error')::bigint)::bigint healthy from events group by rollup (event_type)"),
    "hotspots": (hotspots, "select p_brand, round(sum(p_retailprice) / (select sum(p_retailprice) from part) * 100, 6) pct from part group by 1 having pct >= 4 order by pct desc, p_brand"),
    "pareto_front": (pareto_front, """select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice >= a.p_retailprice
        and (b.p_size > a.p_size or b.p_retailprice > a.p_retailprice))"""),
    "expiring_orders": (expiring_orders, f"""with {OD}, n as (select max(d) as now from od) select o_orderkey, d + 90 as ends, d + 90 - now as left_days from od, n where d + 90 >= now and d + 90 <= now + 30"""),
    "fixity_report": (fixity_report, """with f as (select source, count(*) n, sum((length(text) <> n_chars)::bigint)::bigint failed from documents group by 1)
        select *, case when failed = 0 then 'Healthy' when failed <= n // 2 then 'Degraded' else 'Critical' end status from f"""),
    "geo_cube": (geo_cube, "select c_mktsegment, c_nationkey, count(*) n, round(sum(c_acctbal), 6) total from customer group by cube (c_mktsegment, c_nationkey)"),
    "engagement_slope": (engagement_slope, f"""with {EV}, d as (select event_type, t // {24 * HOUR} as day, avg(value) m from ev group by 1, 2) select event_type, round(regr_slope(m, day), 6) slope, round(corr(m, day), 6) r from d group by 1"""),
}
