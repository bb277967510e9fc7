"""Window and sequence queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators import intervals, monitoring, stats
from lumenframe.plans.common import DAY, EV, HOUR, LI, OD, events, lineitem, orders
from lumenframe.session import table

MIN = 60_000_000
r6 = lambda c: F.round(c, 6)


def rolling_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value lies over three deviations from the last 30 of their type."""
    rows = stats.rolling_z(events(spark, sf_dir).select("event_id", "event_type", "t", "value"), "value", ["t", "event_id"], ["event_type"], 30)
    return rows.where(F.abs("z") > 3).select("event_id", "event_type", r6("z").alias("z"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.floor(F.col("t") / DAY).cast("long").alias("day")).agg(F.count("*").cast("double").alias("n"))


def seasonal_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events with trend, weekly season and residual."""
    parts = monitoring.seasonal(_daily(spark, sf_dir), "day", "n", 7)
    return parts.select("day", "value", *[r6(c).alias(c) for c in ("trend", "season", "residual")])


def seasonal_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose residual lies over one and a half deviations off."""
    return monitoring.seasonal_anomalies(monitoring.seasonal(_daily(spark, sf_dir), "day", "n", 7), 1.5).select("day", r6("residual").alias("residual"))


def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next seven days."""
    return monitoring.seasonal_forecast(monitoring.seasonal(_daily(spark, sf_dir), "day", "n", 7), 7, 7).select("step", r6("forecast").alias("forecast"))


def uptime_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of time that each user was not in an error, up to the last event of all."""
    rows = events(spark, sf_dir).select("user_id", "t", "event_id", "event_type")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("t").alias("now"))))
    return monitoring.availability(rows, ["user_id"], "t", "event_id", F.col("event_type") != "error", F.col("now")).withColumn("pct", r6("pct"))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user (12 idle hours): number, mean length, mean distinct items."""
    rows = monitoring.sessions(events(spark, sf_dir), "user_id", "t", "event_id", 12 * HOUR)
    each = rows.groupBy("user_id", "session").agg((F.max("t") - F.min("t")).alias("len"), F.countDistinct("k").alias("items"))
    return each.groupBy("user_id").agg(F.count("*").alias("sessions"), F.floor(F.sum("len") / F.count("*")).cast("long").alias("mean_us"), r6(F.avg("items")).alias("mean_items"))


def binge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more events with gaps up to six hours."""
    return monitoring.binges(events(spark, sf_dir), "user_id", "t", "event_id", 6 * HOUR)


def binge_runs_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the last run of a user."""
    return monitoring.binges(events(spark, sf_dir), "user_id", "t", "event_id", 6 * HOUR, count_last=False)


def active_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour of the day and day of the week (0: Thursday, that of 1970-01-01)."""
    t = F.col("t")
    return events(spark, sf_dir).groupBy(F.floor(t / HOUR % 24).cast("long").alias("hour"), F.floor(t / DAY % 7).cast("long").alias("weekday")).agg(F.count("*").alias("n"))


def frequency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases in six-hour buckets of January 2024, empty ones too."""
    start = 1_704_067_200
    rows = events(spark, sf_dir).where("event_type = 'purchase'").select(F.floor(F.col("t") / 1_000_000).cast("long").alias("s"))
    return monitoring.zero_filled(rows, "s", start, start + 31 * 86400, 6 * 3600)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem(spark, sf_dir).select("l_suppkey", "l_orderkey", "l_linenumber", F.col("d").alias("s"), (F.col("d") + F.col("l_quantity").cast("long")).alias("e"))


def adjacent_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the shipping spans of each supplier."""
    rows = _spans(spark, sf_dir).withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    out = intervals.adjacent_gaps(rows.groupBy("l_suppkey", "s", "e").agg(F.min("id").alias("id")), ["l_suppkey"], "s", "e", "e")
    return out.where("gap is not null").groupBy("l_suppkey").agg(F.sum((F.col("gap") > 0).cast("long")).alias("gaps"), F.sum((F.col("gap") < 0).cast("long")).alias("overlaps"), F.max("gap").alias("widest"))


def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of the shipping spans of each supplier, at most a day apart."""
    return intervals.merge_intervals(_spans(spark, sf_dir), ["l_suppkey"], "s", "e", 1)


def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of order numbers that a customer does not have between two of theirs."""
    return intervals.missing_numbers(orders(spark, sf_dir), ["o_custkey"], "o_orderkey", 1000)


def density_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day windows each day: events that last six hours from their time."""
    rows = events(spark, sf_dir).crossJoin(F.broadcast(events(spark, sf_dir).agg(F.min("t").alias("t0"))))
    spans = rows.select(((F.col("t") - F.col("t0")) / MIN).cast("long").alias("s")).withColumn("e", F.col("s") + 360)
    return intervals.window_counts(spans, "s", "e", 2880, 1440)


def density_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with more than the mean number of events."""
    rows = events(spark, sf_dir).groupBy(F.floor(F.col("t") / HOUR).cast("long").alias("w")).agg(F.count("*").alias("n"))
    return intervals.bursts(rows, 3)


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best users by their highest value."""
    best = events(spark, sf_dir).groupBy("user_id").agg(F.max("value").alias("best"))
    top = best.orderBy(F.desc("best"), "user_id").limit(25)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("best"), "user_id")).cast("long"))


def recent_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three events of each user."""
    return stats.nth_last(events(spark, sf_dir).select("user_id", "event_id", "t"), ["t", "event_id"], ["user_id"], 3).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


def recently_played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 items seen last, each once, newest first."""
    return events(spark, sf_dir).groupBy("k").agg(F.max("event_id").alias("last")).orderBy(F.desc("last")).limit(20)


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the last ten values of each user."""
    return monitoring.rolling_mean(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 10).select("event_id", r6("rolling").alias("rolling"))


def trailing_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the values of a user over the last day."""
    return monitoring.trailing_sum(events(spark, sf_dir), ["user_id"], "t", "value", DAY).select("event_id", r6("trailing").alias("trailing"))


def half_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend of each user's values between the halves of their events."""
    return monitoring.half_trend(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value").select("user_id", r6("first").alias("first"), r6("second").alias("second"), "trend")


def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user that no other error went before within three days."""
    rows = events(spark, sf_dir).where("event_type = 'error'")
    return monitoring.suppress_repeats(rows, ["user_id"], "t", "event_id", 3 * DAY).select("event_id", "user_id")


def pacing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style of each five events of a user."""
    return monitoring.chunk_styles(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 5, 30.0, 70.0).select("user_id", "chunk", r6("mean").alias("mean"), "style")


def recent_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent type of the last seven events of each user."""
    return monitoring.recent_mode(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type", 7).select("user_id", "event_type", "n")


def screen_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time that each event type was the current one of a user, up to the last event of all."""
    rows = events(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("t").alias("now"))))
    follow = F.coalesce(F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id")), F.col("now"))
    return rows.withColumn("len", follow - F.col("t")).groupBy("event_type").agg(F.sum("len").alias("screen_us"), F.count("*").alias("n"))


def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user between 0 and 1, a half where they do not vary, with z-scores."""
    w = Window.partitionBy("user_id")
    v = F.col("value")
    span = F.max(v).over(w) - F.min(v).over(w)
    sd = F.stddev_pop(v).over(w)
    return events(spark, sf_dir).select(
        "event_id", r6(F.when(span < 1e-12, 0.5).otherwise((v - F.min(v).over(w)) / span)).alias("scaled"), r6(F.when(sd < 1e-12, 0.0).otherwise((v - F.avg(v).over(w)) / sd)).alias("z")
    )


def start_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each turn of a conversation, if a turn lasts as many milliseconds as it has characters, less 10 of crossfade."""
    rows = table(spark, sf_dir, "conversations")
    before = F.sum(F.char_length("text") - 10).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("conv_id", "turn", F.coalesce(before, F.lit(0)).cast("long").alias("start_ms"))


def recurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly dates of the 60 days from each of the first orders of a customer, at most five."""
    first = orders(spark, sf_dir).groupBy("o_custkey").agg(F.min("d").alias("d"))
    return first.select("o_custkey", F.explode(F.slice(F.sequence(F.col("d"), F.col("d") + 60, F.lit(7)), 1, 5)).alias("day"))




def item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's item state: events before the first signup are ignored; the last counts."""
    rows = events(spark, sf_dir)
    start = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.min(F.struct("t", "event_id")).alias("s"))
    live = rows.join(start, "user_id").where(F.struct("t", "event_id") >= F.col("s"))
    out = live.groupBy("user_id").agg(F.max_by("event_type", F.struct("t", "event_id")).alias("last"), F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))
    return out.withColumn("state", F.when(F.col("last") == "error", "failed").when(F.col("last") == "purchase", "finished").otherwise("running")).drop("last")


QUERIES = {
    "rolling_zscore": (rolling_zscore, f"""with {EV}, w as (select event_id, event_type, value, avg(value) over f m, stddev_pop(value) over f s, count(value) over f n from ev
        window f as (partition by event_type order by t, event_id rows between 29 preceding and current row))
        select event_id, event_type, round((value - m) / s, 6) z from w where n >= 2 and s > 1e-12 and abs((value - m) / s) > 3"""),
    "seasonal_decompose": (seasonal_decompose, f"""with {EV}, d as (select t // {DAY} as day, count(*)::double n from ev group by 1),
        r as (select day, row_number() over (order by day) - 1 i, n, count(*) over f c, avg(n) over f a, avg(n) over () m, count(*) over () len from d window f as (order by day rows between 3 preceding and 3 following)),
        t as (select *, case when c = 7 then a else m end trend from r where len >= 14), s as (select *, avg(n - trend) over (partition by i % 7) season from t)
        select day, n as value, round(trend, 6) trend, round(season, 6) season, round(n - trend - season, 6) residual from s"""),
    "seasonal_outliers": (seasonal_outliers, f"""with {EV}, d as (select t // {DAY} as day, count(*)::double n from ev group by 1),
        r as (select day, row_number() over (order by day) - 1 i, n, count(*) over f c, avg(n) over f a, avg(n) over () m, count(*) over () len from d window f as (order by day rows between 3 preceding and 3 following)),
        t as (select *, case when c = 7 then a else m end trend from r where len >= 14), s as (select *, n - trend - avg(n - trend) over (partition by i % 7) res from t),
        z as (select *, avg(res) over () m2, stddev_pop(res) over () s2 from s) select day, round(res, 6) residual from z where abs(res - m2) > 1.5 * s2"""),
    "seasonal_forecast": (seasonal_forecast, f"""with {EV}, d as (select t // {DAY} as day, count(*)::double n from ev group by 1),
        r as (select day, row_number() over (order by day) - 1 i, n, count(*) over f c, avg(n) over f a, avg(n) over () m, count(*) over () len from d window f as (order by day rows between 3 preceding and 3 following)),
        t as (select *, case when c = 7 then a else m end trend from r where len >= 14), s as (select i % 7 p, avg(n - trend) season from t group by 1),
        b as (select avg(trend) base, max(len) len from t where i >= len - 7)
        select step::bigint step, round(base + season, 6) forecast from (select unnest(range(0, 7)) step) x, b, s where (len + step) % 7 = p"""),
    "uptime_availability": (uptime_availability, f"""with {EV}, n as (select max(t) as now from ev), u as (select user_id, t, event_id, event_type <> 'error' up, lag(event_type <> 'error') over (partition by user_id order by t, event_id) was from ev),
        c as (select user_id, t, up, lead(t) over (partition by user_id order by t, event_id) nx from u where was is null or was <> up), l as (select user_id, up, coalesce(nx, now) - t as len from c, n)
        select user_id, coalesce(sum(len) filter (where up), 0)::bigint up_time, sum(len)::bigint total, round(case when sum(len) > 0 then coalesce(sum(len) filter (where up), 0) / sum(len) * 100.0 else 100.0 end, 6) pct from l group by 1"""),
    "session_stats": (session_stats, f"""with {EV}, g as (select *, t - lag(t) over (partition by user_id order by t, event_id) > {12 * HOUR} b from ev), s as (select *, sum(coalesce(b, false)::int) over (partition by user_id order by t, event_id) session from g),
        e as (select user_id, session, max(t) - min(t) len, count(distinct k) items from s group by 1, 2)
        select user_id, count(*) sessions, (sum(len) // count(*))::bigint mean_us, round(avg(items), 6) mean_items from e group by 1"""),
    "binge_runs": (binge_runs, f"""with {EV}, g as (select *, t - lag(t) over (partition by user_id order by t, event_id) > {6 * HOUR} b from ev), s as (select *, sum(coalesce(b, false)::int) over (partition by user_id order by t, event_id) session from g),
        e as (select user_id, session, count(*) n from s group by 1, 2) select user_id, sum((n >= 3)::bigint)::bigint binges from e group by 1"""),
    "binge_runs_closed": (binge_runs_closed, f"""with {EV}, g as (select *, t - lag(t) over (partition by user_id order by t, event_id) > {6 * HOUR} b from ev), s as (select *, sum(coalesce(b, false)::int) over (partition by user_id order by t, event_id) session from g),
        e as (select user_id, session, count(*) n from s group by 1, 2), m as (select *, max(session) over (partition by user_id) last from e) select user_id, sum((n >= 3 and session < last)::bigint)::bigint binges from m group by 1"""),
    "active_hours": (active_hours, f"with {EV} select (t // {HOUR}) % 24 as hour, (t // {DAY}) % 7 as weekday, count(*) n from ev group by 1, 2"),
    "frequency_buckets": (frequency_buckets, f"""with {EV}, c as (select unnest(range(1704067200, 1704067200 + 31 * 86400, 21600)) bucket), p as (select (t // 1000000 - 1704067200) // 21600 * 21600 + 1704067200 bucket, count(*) n
        from ev where event_type = 'purchase' group by 1) select bucket::bigint bucket, coalesce(n, 0)::bigint n from c left join p using (bucket)"""),
    "adjacent_gaps": (adjacent_gaps, f"""with {LI}, s as (select distinct l_suppkey, d s, d + l_quantity::bigint e from li), g as (select l_suppkey, s - lag(e) over (partition by l_suppkey order by s, e) gap from s)
        select l_suppkey, sum((gap > 0)::bigint)::bigint gaps, sum((gap < 0)::bigint)::bigint as "overlaps", max(gap) widest from g where gap is not null group by 1"""),
    "merged_spans": (merged_spans, f"""with {LI}, s as (select l_suppkey, d s, d + l_quantity::bigint e from li), r as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) m from s),
        i as (select *, sum((m is null or s > m + 1)::int) over (partition by l_suppkey order by s, e rows between unbounded preceding and current row) g from r)
        select l_suppkey, min(s) s, max(e) e, count(*) n from i group by l_suppkey, g"""),
    "missing_numbers": (missing_numbers, """with l as (select o_custkey, o_orderkey n, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) f from orders)
        select o_custkey, n + 1 as first, least(f - 1, n + 1000) as last from l where f - n > 1"""),
    "density_windows": (density_windows, f"""with {EV}, s as (select (t - (select min(t) from ev)) // {MIN} s from ev), e as (select s, s + 360 e from s), w as (select unnest(range(0, (select (max(e) - 1) // 1440 from e) + 1)) * 1440 w)
        select w::bigint w, count(s) n from w left join e on s < w + 2880 and e > w group by 1"""),
    "density_bursts": (density_bursts, f"""with {EV}, h as (select t // {HOUR} w, count(*) n from ev group by 1), b as (select *, n >= 3 busy, lead(w) over (order by w) nx, lag(n >= 3) over (order by w) pb from h),
        i as (select *, sum((busy and not coalesce(pb, false))::int) over (order by w) g from b) select min(w) as start, max(coalesce(nx, w)) as stop, max(n) peak from i where busy group by g"""),
    "leaderboard": (leaderboard, """select user_id, best, row_number() over (order by best desc, user_id) as rank from (select user_id, max(value) best from events group by 1) order by best desc, user_id limit 25"""),
    "recent_per_user": (recent_per_user, f"with {EV} select user_id, event_id, row_number() over (partition by user_id order by t desc, event_id desc) as rank from ev qualify rank <= 3"),
    "recently_played": (recently_played, f"with {EV} select k, max(event_id) as last from ev group by 1 order by 2 desc limit 20"),
    "rolling_mean": (rolling_mean, f"with {EV} select event_id, round(avg(value) over (partition by user_id order by t, event_id rows between 9 preceding and current row), 6) rolling from ev"),
    "trailing_bandwidth": (trailing_bandwidth, f"""with {EV} select event_id, round(sum(value) over (partition by user_id order by t range between {DAY} preceding and current row), 6) as "trailing" from ev"""),
    "half_trend": (half_trend, f"""with {EV}, r as (select user_id, value, row_number() over (partition by user_id order by t, event_id) i, count(*) over (partition by user_id) n from ev),
        a as (select user_id, avg(value) filter (where i <= n // 2) f, avg(value) filter (where i > n // 2) s from r group by 1)
        select user_id, round(f, 6) as first, round(s, 6) as second, case when s > f * (1 + 0.1::double) then 'rising' when s < f * (1 - 0.1::double) then 'falling' else 'stable' end trend from a"""),
    "alert_dedup": (alert_dedup, f"""with {EV}, e as (select event_id, user_id, t, lag(t) over (partition by user_id order by t, event_id) b from ev where event_type = 'error') select event_id, user_id from e where b is null or t - b >= {3 * DAY}"""),
    "pacing_chunks": (pacing_chunks, f"""with {EV}, c as (select user_id, value, (row_number() over (partition by user_id order by t, event_id) - 1) // 5 as chunk from ev), m as (select user_id, chunk, avg(value) m from c group by 1, 2)
        select user_id, chunk, round(m, 6) mean, case when m < 30 then 'fast' when m > 70 then 'slow' else 'medium' end style from m"""),
    "recent_mode": (recent_mode, f"""with {EV}, b as (select user_id, event_type, row_number() over (partition by user_id order by t desc, event_id desc) b from ev qualify b <= 7), c as (select user_id, event_type, count(*) n, min(b) b from b group by 1, 2)
        select user_id, event_type, n from c qualify row_number() over (partition by user_id order by n desc, b) = 1"""),
    "screen_time": (screen_time, f"""with {EV}, l as (select event_type, coalesce(lead(t) over (partition by user_id order by t, event_id), (select max(t) from ev)) - t as len from ev) select event_type, sum(len)::bigint screen_us, count(*) n from l group by 1"""),
    "normalized_values": (normalized_values, """select event_id, round(case when max(value) over w - min(value) over w < 1e-12 then 0.5 else (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) scaled,
        round(case when stddev_pop(value) over w < 1e-12 then 0.0 else (value - avg(value) over w) / stddev_pop(value) over w end, 6) z from events window w as (partition by user_id)"""),
    "start_offsets": (start_offsets, """select conv_id, turn, coalesce(sum(length(text) - 10) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint start_ms from conversations"""),
    "recurrences": (recurrences, f"with {OD}, f as (select o_custkey, min(d) d from od group by 1) select o_custkey, unnest(range(d, d + 61, 7)[1:5]) as day from f"),
    "item_states": (item_states, f"""with {EV}, s as (select user_id, min((t, event_id)) s from ev where event_type = 'signup' group by 1), l as (select ev.* from ev join s using (user_id) where (t, event_id) >= s),
        a as (select user_id, arg_max(event_type, (t, event_id)) last, count(*) n, sum((event_type = 'error')::bigint)::bigint errors from l group by 1)
        select user_id, n, errors, case when last = 'error' then 'failed' when last = 'purchase' then 'finished' else 'running' end state from a"""),
}
