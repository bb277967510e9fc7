"""Queries of the viewer analytics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import sign_bits
from lumenframe.operators import analytics as A
from lumenframe.operators import recommend, stats
from lumenframe.plans.common import EV, HOUR, events
from lumenframe.session import checkpointed, table

r6 = lambda c: F.round(c, 6)


def experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases by assigned variant, with the test of two of them."""
    rows = A.assign_variants(events(spark, sf_dir), "user_id", {"a": 1.0, "b": 1.0}, "exp1")
    return recommend.proportions_test(rows, "variant", F.col("event_type") == "purchase", "a", "b").select("n_a", "n_b", r6("p_a").alias("p_a"), r6("p_b").alias("p_b"), r6("z").alias("z"), "winner")


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return rows.select(F.col("user_id").alias("viewer"), (F.floor(F.col("value")) * 3).cast("long").alias("s"), (F.floor(F.col("value")) * 3 + F.col("k")).cast("long").alias("e"))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of the watched spans in each of four segments."""
    segments = spark.createDataFrame([("a", 0, 60), ("b", 60, 200), ("c", 200, 500), ("d", 500, 1500)], "segment string, s long, e long")
    return A.attribute_time(_watched(spark, sf_dir), segments)


def playback_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched spans over each ten seconds."""
    return A.coverage(_watched(spark, sf_dir), 10)


def retention_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of users, weighted by their events, that got to each tenth, with the area below."""
    reach = events(spark, sf_dir).groupBy(F.col("user_id").alias("viewer")).agg(F.max("value").alias("reach"), F.count("*").cast("double").alias("weight"))
    return A.retention_curve(reach, 10, 400.0).select("point", r6("share").alias("share"), r6("area").alias("area"))


def bandit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of the event types as arms."""
    return A.bandit_choice(events(spark, sf_dir), "event_type", "value", 0.2).select("event_type", r6("mean").alias("mean"), "n", r6("p").alias("p"))


def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a map of their fields."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")).alias("f"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"))
    return A.search_fields(rows, "f", {"name": "RING"}, ["brand#1"], "path", ["part/8"]).select("p_partkey")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best place of the sign codes of four components in those of all of a vector."""
    codes = lambda v, n, w: F.array(*[sign_bits(F.slice(v, i + 1, w), w) for i in range(n)])
    rows = table(spark, sf_dir, "embeddings")
    best = A.best_alignment(codes(F.col("embedding"), 2, 4), codes(F.slice("embedding", 5, 12), 8, 4), 4)
    return rows.select("vec_id", r6(best["similarity"]).alias("similarity"), best["offset"].cast("long").alias("place"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 dearest parts of four shards."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return A.merge_shards([part.where(F.col("p_partkey") % 4 == i) for i in range(4)], "p_retailprice", "p_partkey", 15)


def committed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the turns before the fourth of each conversation."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("at"), F.col("role").alias("word"))
    return A.flush_words(rows, 3)[0]


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of new items among those that a user met in the second half of their events."""
    rows = events(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    half = F.floor(F.count("*").over(Window.partitionBy("user_id")) / 2)
    marked = rows.select("user_id", "k", (place <= half).alias("early"))
    sets = marked.groupBy("user_id").agg(F.collect_set(F.when(~F.col("early"), F.col("k"))).alias("items"), F.collect_set(F.when(F.col("early"), F.col("k"))).alias("seen"))
    return sets.select("user_id", r6(A.soft_novelty(F.col("items"), F.col("seen"))).alias("novelty"))


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users do next: counts and chances of an event type after another."""
    follow = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    rows = events(spark, sf_dir).select(F.col("event_type").alias("now"), follow.alias("next")).where("next is not null")
    counts = rows.groupBy("now", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", r6(F.col("n") / F.sum("n").over(Window.partitionBy("now"))))


def loyalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the users by recency, frequency and value, and their sum; the bounds are exact and come without a global sort."""
    rows = checkpointed(events(spark, sf_dir).groupBy("user_id").agg(F.max("t").alias("r"), F.count("*").alias("f"), F.round(F.sum("value"), 6).alias("m")))
    bounds = stats.exact_quantiles(rows, ["r", "f", "m"], [0.25, 0.5, 0.75])
    q = lambda c: sum(((F.col(c) > F.lit(bound)).cast("long") for bound in bounds[c]), F.lit(1).cast("long"))
    out = rows.select("user_id", q("r").alias("recency"), q("f").alias("frequency"), q("m").alias("monetary"))
    return out.withColumn("score", F.col("recency") + F.col("frequency") + F.col("monetary"))


def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the hourly counts of two event types, hours without any left out."""
    hourly = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / HOUR).alias("h")).agg(F.count("*").alias("n"))
    a, b = hourly.select(F.col("event_type").alias("a"), "h", F.col("n").alias("x")), hourly.select(F.col("event_type").alias("b"), "h", F.col("n").alias("y"))
    return a.join(b, "h").where("a < b").groupBy("a", "b").agg(r6(F.corr("x", "y")).alias("r"), F.count("*").alias("n"))


QUERIES = {
    "experiment": (experiment, None),
    "attribution": (attribution, f"""with {EV}, w as (select user_id, floor(value)::bigint * 3 s, floor(value)::bigint * 3 + k e from ev), g as (select * from (values ('a', 0, 60), ('b', 60, 200), ('c', 200, 500), ('d', 500, 1500)) v(segment, a, b))
        select segment, sum(least(e, b) - greatest(s, a))::bigint as "seconds", count(distinct user_id) viewers from w join g on s < b and a < e group by 1"""),
    "playback_map": (playback_map, f"""with {EV}, w as (select floor(value)::bigint * 3 s, floor(value)::bigint * 3 + k e from ev) select slot, count(*) as "views" from (select unnest(range(s // 10, (e - 1) // 10 + 1)) slot from w where s < e) group by 1"""),
    "retention_curve": (retention_curve, """with u as (select user_id, max(value) reach, count(*) w from events group by 1), p as (select unnest(range(0, 11)) point), c as (select point, sum(w) filter (where least(floor(reach / 40), 10) >= point) / (select sum(w) from u) share from p, u group by 1),
        s as (select point, coalesce(share, 0) share from c), a as (select point, share, case when point = 0 then 0 else (share + lag(share) over (order by point)) / 2 * 40 end x from s)
        select point::bigint as point, round(share, 6) share, round(sum(x) over (order by point), 6) area from a"""),
    "bandit": (bandit, """with a as (select event_type, avg(value) m, count(*) n from events group by 1), b as (select arg_min(event_type, (-m, event_type)) b, count(*) c from a) select event_type, round(m, 6) mean, n, round(0.2::double / c + case when event_type = b then 0.8::double else 0 end, 6) p from a, b"""),
    "field_search": (field_search, "select p_partkey from part where p_name ilike '%ring%' and p_brand ilike '%brand#1%' and p_partkey <> 8"),
    "alignments": (alignments, None),
    "shards": (shards, "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 15"),
    "committed_text": (committed_text, "select conv_id as track, string_agg(role, ' ' order by turn) as text from conversations where turn < 3 group by 1"),
    "novelty": (novelty, f"""with {EV}, m as (select user_id, k, row_number() over (partition by user_id order by t, event_id) <= count(*) over (partition by user_id) // 2 early from ev),
        s as (select user_id, coalesce(list(distinct k) filter (where not early), []) items, coalesce(list(distinct k) filter (where early), []) seen from m group by 1)
        select user_id, round(case when len(items) = 0 then 1.0 else 1 - len(list_intersect(items, seen)) / len(items) end, 6) novelty from s"""),
    "bigrams": (bigrams, f"""with {EV}, l as (select event_type as now, lead(event_type) over (partition by user_id order by t, event_id) as next from ev), c as (select now, next, count(*) n from l where next is not null group by 1, 2) select now, next, n, round(n / sum(n) over (partition by now), 6) p from c"""),
    "loyalty": (loyalty, f"""with {EV}, u as (select user_id, max(t) r, count(*) f, round(sum(value), 6) m from ev group by 1), b as (select quantile_disc(r, [0.25, 0.5, 0.75]) br, quantile_disc(f, [0.25, 0.5, 0.75]) bf, quantile_disc(m, [0.25, 0.5, 0.75]) bm from u),
        q as (select user_id, 1 + (r > br[1])::bigint + (r > br[2])::bigint + (r > br[3])::bigint recency, 1 + (f > bf[1])::bigint + (f > bf[2])::bigint + (f > bf[3])::bigint frequency, 1 + (m > bm[1])::bigint + (m > bm[2])::bigint + (m > bm[3])::bigint monetary from u, b)
        select *, recency + frequency + monetary as score from q"""),
    "correlations": (correlations, f"""with {EV}, h as (select event_type, t // {HOUR} h, count(*) n from ev group by 1, 2) select x.event_type a, y.event_type b, round(corr(x.n, y.n), 6) r, count(*) n from h x join h y using (h) where x.event_type < y.event_type group by 1, 2"""),
}
