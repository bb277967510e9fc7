"""Queries of the media operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.vectors import sign_bits
from lumenframe.operators import media as M
from lumenframe.operators import stats
from lumenframe.operators.similarity import nearest_assets as nearest_by_asset
from lumenframe.plans.common import DAY, EV, OD, events, orders
from lumenframe.session import table

r6 = lambda c: F.round(c, 6)


def scene_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as frames: those over 150 are hard cuts, over 80 gradual."""
    return M.boundaries(events(spark, sf_dir), ["user_id"], "event_id", "value", 150.0, 80.0)


def jump_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the type before, at an angle (the value) close to it."""
    return M.jump_cuts(events(spark, sf_dir), ["user_id"], "event_id", "event_type", "value").select("event_id")


def frozen_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of vectors of a label whose first eight signs hardly change."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", sign_bits(F.col("embedding"), 8).alias("code"))
    return M.frozen_runs(rows, ["label"], "vec_id", "code", 3, 3)


def quiet_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of a user with a low mean over five."""
    return M.quiet_breaks(events(spark, sf_dir), ["user_id"], "event_id", "value", 5, 30.0)


def loudness_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of the values of each event type."""
    return M.loudness_range(events(spark, sf_dir), "value", ["event_type"]).select("event_type", r6("range").alias("range"))


def last_n_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the last eight values of each user."""
    out = M.last_n_stats(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 8)
    return out.select("user_id", "n", r6("mean").alias("mean"), r6("spread").alias("spread"), r6("variation").alias("variation"))


def caption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the captions of each conversation; a turn has 20 seconds."""
    n = F.size(F.split(F.trim("text"), "\\s+"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).alias("w"), F.count("*").alias("c"), F.sum((n > 60).cast("long")).alias("o"))
    return rows.select("conv_id", M.caption_score(F.col("w"), F.col("c") * 20, F.col("o"), F.col("c")).alias("score"))


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event type follows which of a user, how often and with what values."""
    from pyspark.sql import Window

    rows = events(spark, sf_dir).withColumn("callee", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).where("callee is not null")
    return M.call_edges(rows.select(F.col("event_type").alias("caller"), "callee", F.col("value").alias("time"))).withColumn("time", r6("time"))


def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type of highest mean, and the sum of all means."""
    return M.stage_latency(events(spark, sf_dir), "event_type", "value")


def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values of items before and after the middle of January."""
    rows = events(spark, sf_dir)
    half = 1_705_320_000_000_000
    one = lambda c: rows.where(c).groupBy("k").agg(F.avg("value").alias("v"))
    return M.compare_runs(one(F.col("t") < half), one(F.col("t") >= half), "k", "v", 0.2).withColumn("speedup", r6("speedup"))


def nearest_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance of each label to each query."""
    rows = table(spark, sf_dir, "embeddings")
    out = nearest_by_asset(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", "label", 12.0)
    return out.select("query", F.col("asset").alias("label"), r6("distance").alias("distance"))


def relinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names rewritten by a pattern table."""
    return table(spark, sf_dir, "part").select("p_partkey", M.relink(F.col("p_name"), [("ring", "loop"), ("small", "tiny")]).alias("name"))


def segment_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three days, found through the days (segments) that touch them."""
    rows = events(spark, sf_dir).withColumn("segment", F.floor(F.col("t") / DAY).cast("long"))
    segments = rows.groupBy("segment").agg(F.min("t").alias("s"), (F.max("t") + 1).alias("e"))
    start = 1_704_844_800_000_000
    return M.segments_in_range(segments, rows.select("segment", F.col("t").alias("at"), "event_id"), start, start + 3 * DAY).select("event_id")


def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of event type of a user that are not on a list."""
    legal = [("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "error"), ("error", "view"), ("purchase", "view")]
    return M.lifecycle_violations(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type", legal).groupBy("before", F.col("event_type").alias("after")).agg(F.count("*").alias("n"))


def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user with two or more within three days."""
    return M.lockouts(events(spark, sf_dir), "user_id", "t", "event_id", F.col("event_type") == "error", 3 * DAY, 2).select("event_id", "lock")


def pruned_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer beyond the last three."""
    return M.keep_latest(orders(spark, sf_dir), ["o_custkey"], ["d", "o_orderkey"], 3)[1].select("o_orderkey")


def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 orders due on day 10000, by priority."""
    rows = orders(spark, sf_dir).select(F.col("o_orderkey").alias("job"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("d").alias("due"), F.col("o_orderkey").alias("seq"))
    return M.due_jobs(rows, F.lit(10000), 20).select("job", "priority")


def mean_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the values of clicks and views at the same place of a user."""
    rows = events(spark, sf_dir)
    out = M.mean_drift(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), ["user_id"], "event_id", "value")
    return out.select("user_id", r6("drift").alias("drift"), "n")


def minimum_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the turns of a conversation with 80 ms to the next."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 300).alias("s"), (F.col("turn") * 300 + F.char_length("text")).alias("e"))
    return M.minimum_gaps(rows, ["conv_id"], "s", "e", 80).select("conv_id", "turn", "e")


def uniform_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget dealt to suppliers by balance."""
    return stats.proportional(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_acctbal", 500.0, ["s_nationkey"]).select("s_suppkey", r6("share").alias("share"))


def bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a second of each user from first to last event; 0 with fewer than two or under a millisecond."""
    out = events(spark, sf_dir).groupBy("user_id").agg(F.sum("value").alias("v"), (F.max("t") - F.min("t")).alias("d"), F.count("*").alias("n"))
    return out.select("user_id", F.round(F.when((F.col("n") < 2) | (F.col("d") < 1000), 0.0).otherwise(F.col("v") * 8 / (F.col("d") / 1e6)), 9).alias("bps"))


QUERIES = {
    "scene_boundaries": (scene_boundaries, """with f as (select user_id, row_number() over (partition by user_id order by event_id) frame, value from events) select user_id, frame, case when value >= 150 then 'hard' else 'gradual' end kind from f where value >= 80"""),
    "jump_cuts": (jump_cuts, """with l as (select event_id, event_type = lag(event_type) over w same, abs(value - lag(value) over w) % 360 d from events window w as (partition by user_id order by event_id)) select event_id from l where same and least(d, 360 - d) < 15"""),
    "frozen_runs": (frozen_runs, """with c as (select label, vec_id, list_sum(list_transform(range(0, 8), lambda i: case when embedding[i + 1] > 0 then 1::bigint << i else 0 end))::bigint code from embeddings),
        l as (select *, coalesce(bit_count(xor(code, lag(code) over (partition by label order by vec_id))) > 3, false) far from c), i as (select *, sum(far::int) over (partition by label order by vec_id) g from l)
        select label, min(vec_id) as first, max(vec_id) as last, count(*) n from i group by label, g having count(*) >= 3"""),
    "quiet_breaks": (quiet_breaks, """with a as (select user_id, event_id, avg(value) over (partition by user_id order by event_id rows between 4 preceding and current row) < 30 low from events),
        b as (select *, low and not coalesce(lag(low) over (partition by user_id order by event_id), false) nw from a), i as (select *, sum(nw::int) over (partition by user_id order by event_id) g from b) select user_id, min(event_id) as first, max(event_id) as last from i where low group by user_id, g"""),
    "loudness_range": (loudness_range, """with s as (select event_type, list_sort(list(value)) l, count(*) n from events group by 1) select event_type, round(abs(l[least(floor(n * 0.95::double)::bigint, n - 1) + 1] - l[least(floor(n * 0.1::double)::bigint, n - 1) + 1]), 6) as range from s"""),
    "last_n_stats": (last_n_stats, f"""with {EV}, l as (select user_id, value from ev qualify row_number() over (partition by user_id order by t desc, event_id desc) <= 8), a as (select user_id, count(*) n, avg(value) m, sqrt(var_pop(value) * count(*) / greatest(count(*), 2)) s from l group by 1)
        select user_id, n, round(m, 6) mean, round(s, 6) spread, round(case when m = 0 then 0 else s / m end, 6) variation from a"""),
    "caption_scores": (caption_scores, """with w as (select conv_id, len(regexp_split_to_array(trim(text), '\\s+')) n from conversations), a as (select conv_id, sum(n) w, count(*) c, sum((n > 60)::int) o from w group by 1), r as (select *, w / (c * 20) * 60.0::double wpm from a)
        select conv_id, floor(greatest(0, least(100, 100 - case when wpm > 250 then 40 when wpm > 200 then 20 when wpm > 160 then 10 else 0 end - 30.0::double * (o / c))))::bigint score from r"""),
    "call_graph": (call_graph, f"with {EV}, l as (select event_type caller, lead(event_type) over (partition by user_id order by t, event_id) callee, value from ev) select caller, callee, count(*) n, round(sum(value), 6) as time from l where callee is not null group by 1, 2"),
    "stage_latency": (stage_latency, "with m as (select event_type, avg(value) m from events group by 1) select arg_max(event_type, (m, event_type)) slowest, sum(floor(m))::bigint total from m"),
    "compare_runs": (compare_runs, f"""with {EV}, a as (select k, avg(value) v from ev where t < 1705320000000000 group by 1), b as (select k, avg(value) v from ev where t >= 1705320000000000 group by 1)
        select k, round(case when b.v = 0 then 1.0 else a.v / b.v end, 6) speedup, b.v > a.v * 1.2::double regressed from a join b using (k)"""),
    "nearest_assets": (nearest_assets, """with d as (select q.vec_id as query, e.label, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(q.embedding[i]::double - e.embedding[i]::double, 2)))) d from embeddings q, embeddings e where q.vec_id % 20 = 0) select query, label, round(min(d), 6) distance from d group by 1, 2 having min(d) <= 12"""),
    "relinked": (relinked, "select p_partkey, case when contains(p_name, 'ring') then replace(p_name, 'ring', 'loop') when contains(p_name, 'small') then replace(p_name, 'small', 'tiny') else p_name end as name from part"),
    "segment_packets": (segment_packets, f"with {EV} select event_id from ev where t >= 1704844800000000 and t < 1704844800000000 + {3 * DAY}"),
    "lifecycle_violations": (lifecycle_violations, f"""with {EV}, l as (select event_type as after, lag(event_type) over (partition by user_id order by t, event_id) as before from ev) select before, after, count(*) n from l where before is not null and before <> after
        and before || '>' || after not in ('view>click', 'click>purchase', 'signup>view', 'view>error', 'error>view', 'purchase>view') group by 1, 2"""),
    "lockouts": (lockouts, f"with {EV} select event_id, count(*) over (partition by user_id order by t range between {3 * DAY} preceding and current row) >= 2 as lock from ev where event_type = 'error'"),
    "pruned_versions": (pruned_versions, f"with {OD} select o_orderkey from od qualify row_number() over (partition by o_custkey order by d desc, o_orderkey desc) > 3"),
    "due_jobs": (due_jobs, f"with {OD} select o_orderkey job, 5 - substring(o_orderpriority, 1, 1)::int priority from od where d <= 10000 order by priority desc, o_orderkey limit 20"),
    "mean_drift": (mean_drift, f"""with r as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id) i from events where event_type in ('view', 'click'))
        select user_id, round(avg(b.value - a.value), 6) drift, count(*) n from r a join r b using (user_id, i) where a.event_type = 'view' and b.event_type = 'click' group by 1"""),
    "minimum_gaps": (minimum_gaps, """with c as (select conv_id, turn, turn * 300 s, turn * 300 + length(text) e from conversations) select conv_id, turn, greatest(s, least(e, coalesce(lead(s) over (partition by conv_id order by s, e) - 80, e))) e from c"""),
    "uniform_budget": (uniform_budget, "select s_suppkey, round(case when sum(greatest(s_acctbal, 0)) over w > 0 then 500.0::double * greatest(s_acctbal, 0) / sum(greatest(s_acctbal, 0)) over w else 0 end, 6) share from supplier window w as (partition by s_nationkey)"),
    "bandwidth": (bandwidth, f"with {EV}, a as (select user_id, sum(value) v, max(t) - min(t) d, count(*) n from ev group by 1) select user_id, round(case when n < 2 or d < 1000 then 0 else v * 8 / (d / 1e6::double) end, 9) bps from a"),
}
