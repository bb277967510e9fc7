"""Similarity, duplicate, recommendation and analytics queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import scores as SC
from lumenframe.functions import vectors as V
from lumenframe.operators import recommend as R
from lumenframe.operators import similarity as S
from lumenframe.plans.common import DAY, EV, HOUR, OD, events, orders
from lumenframe.session import checkpointed, table

r6 = lambda c: F.round(c, 6)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.where("vec_id % 20 = 0"), rows


def _top(score, descending):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q, rows = _vectors(spark, sf_dir)
        return S.nearest(q, rows, "vec_id", "embedding", 10, score, descending).withColumn("rank", F.col("rank").cast("long"))

    return run


cosine_topk, l2_topk, l1_topk, pearson_topk = _top(V.cosine, True), _top(V.l2, False), _top(V.l1, False), _top(V.pearson, True)


def visual_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten items of each query by 1 / (1 + L2)."""
    q, rows = _vectors(spark, sf_dir)
    return S.nearest(q, rows, "vec_id", "embedding", 10, V.l2_likeness, True).withColumn("rank", F.col("rank").cast("long"))


def _codes(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.sign_bits(F.col("embedding"), bits).alias("code"))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors whose first 32 signs differ in at most four places."""
    return S.hamming_pairs(_codes(spark, sf_dir, 32), "vec_id", "code", 32, 4).select("a", "b", F.col("distance").cast("long").alias("distance"))


def hamming_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors within ten signs of each query."""
    codes = _codes(spark, sf_dir, 32)
    return S.hamming_query(codes.where("vec_id % 20 = 0"), codes, "vec_id", "code", 10).select("query", "item", F.col("distance").cast("long").alias("distance"))


def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by sign, where the second nearest is clearly farther."""
    codes = _codes(spark, sf_dir, 32)
    out = S.ratio_match(codes.where("vec_id % 10 = 0"), codes, "vec_id", "code", 14, 0.95)
    return out.select("query", "item", F.col("best").cast("long").alias("best"), F.col("second").cast("long").alias("second"))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers and customers within one edit of each other."""
    left = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.regexp_extract("s_name", "#(\\d+)$", 1)).alias("a"))
    right = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.regexp_extract("c_name", "#(\\d+)$", 1)).alias("b"))
    return S.fuzzy_names(left, right, 1).withColumn("score", r6("score"))


def set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the word sets of all parts that share a word: a set is one class, under its least part, with the number of its parts."""
    words = F.sort_array(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")))
    sets = checkpointed(table(spark, sf_dir, "part").select("p_partkey", words.alias("w")).groupBy("w").agg(F.min("p_partkey").alias("id"), F.count("*").alias("n")))
    each = sets.select("id", F.explode("w").alias("word"))
    met = each.select(F.col("id").alias("a"), "word").join(each.select(F.col("id").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("w").alias(f"w{x}"), F.col("n").alias(f"n{x}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    wa, wb = F.col("wa"), F.col("wb")
    return both.select("a", "b", "na", "nb", r6(V.jaccard(wa, wb)).alias("jaccard"), r6(V.dice(wa, wb)).alias("dice"), r6(V.overlap(wa, wb)).alias("least"), r6(V.cosine_sets(wa, wb)).alias("cosine"))


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same text."""
    return S.duplicate_groups(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id")


def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, different texts, wasted characters and share of different texts."""
    return S.duplicate_stats(table(spark, sf_dir, "documents"), F.md5("text"), "n_chars", "doc_id").withColumn("ratio", r6("ratio"))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("user"), F.col("k").alias("item")).agg(F.avg("value").alias("rating"))


def user_cf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five new items for each of three users by their ten most similar users."""
    users = spark.createDataFrame([(1,), (2,), (3,)], "user long")
    return R.collaborative(_ratings(spark, sf_dir), users, 10, 5).select("user", "item", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def user_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of three users with all others."""
    return R.user_similarity(_ratings(spark, sf_dir), spark.createDataFrame([(1,), (2,), (3,)], "user long")).withColumn("sim", r6("sim"))


def baseline_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with those that means predict."""
    return R.baseline(_ratings(spark, sf_dir).withColumn("rating", F.col("rating") / 20)).select("user", "item", r6("predicted").alias("predicted"))


def hybrid_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve items by the weighted sum of views and values."""
    rows = events(spark, sf_dir)
    views = rows.groupBy(F.col("k").alias("item")).agg(F.count("*").cast("double").alias("score"))
    values = rows.groupBy(F.col("k").alias("item")).agg(F.max("value").alias("score"))
    return R.combine({"views": views, "values": values}, {"views": 0.7, "values": 0.3}, 12).withColumn("rank", F.col("rank").cast("long"))


def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen parts by price, discounted for each further one of a type."""
    return R.diversified(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice"), "p_partkey", "p_type", "p_retailprice", 0.9, 15)


def freshness_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price and freshness in one."""
    rows = orders(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("d").alias("now"), F.max("o_totalprice").alias("top"))))
    age = (F.col("now") - F.col("d")).cast("double")
    scored = rows.withColumn("s", F.col("o_totalprice") / F.col("top"))
    parts = [r6(SC.freshness(age, 90.0, kind)).alias(kind) for kind in ("exponential", "linear", "step", "logarithmic")]
    return R.blend_freshness(scored, "s", SC.freshness(age, 90.0, "exponential"), 0.4).select("o_orderkey", r6("blended").alias("blended"), *parts)


def decay_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of events that fall with age, and those of votes."""
    rows = events(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("t").alias("now"))))
    hours = (F.col("now") - F.col("t")) / float(HOUR)
    return rows.select(
        "event_id", r6(SC.log_rate_decay(hours, 6.0)).alias("log_rate"), r6(SC.linear_decay(hours, 100.0)).alias("linear"), r6(SC.step_decay(hours, [(24.0, 1.0), (168.0, 0.5)], 0.1)).alias("step"),
        r6(SC.gravity_score(F.col("value"), hours)).alias("gravity"), r6(SC.hot_score(F.floor("value"), F.lit(20), F.floor(F.col("t") / 1000000))).alias("hot"),
    )


def ucb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper confidence bounds, Beta means and trend multipliers of the items."""
    rows = events(spark, sf_dir)
    total = rows.agg(F.count("*").alias("all"))
    by = rows.groupBy("k").agg(F.avg(F.col("value") / 500).alias("m"), F.count("*").alias("n"), F.sum((F.col("event_type") == "purchase").cast("long")).alias("hits")).crossJoin(F.broadcast(total))
    return by.select(
        "k", r6(SC.upper_confidence(F.col("m"), F.col("n"), F.col("all"))).alias("ucb"), r6(SC.beta_mean(F.col("hits"), F.col("n") - F.col("hits"))).alias("beta"), r6(SC.trend_multiplier(F.col("n"), 10, 0.5, 1.12)).alias("trend")
    )


#: What the event types stand for.
EVENT_SIGNALS = {"purchase": "completion", "signup": "bookmark", "view": "view", "click": "pause", "error": "skip"}


def implicit_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings that events stand for."""
    signal = F.create_map(*[F.lit(x) for kv in EVENT_SIGNALS.items() for x in kv])
    return events(spark, sf_dir).select("event_id", r6(SC.implicit_rating(F.try_element_at(signal, "event_type"), F.col("value") / 50)).alias("rating"))


def trend_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly trend and velocity of each event type over the last 24 hours of its own."""
    rows = events(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.floor(F.max("t") / 1000000).alias("now")))).withColumn("s", F.floor(F.col("t") / 1000000))
    out = R.trend_hours(rows, "event_type", "s", F.col("now"))
    return out.select("event_type", r6("decayed").alias("decayed"), r6("velocity").alias("velocity"))


def view_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, viewers, mean value and share of purchases of each item."""
    out = R.view_statistics(events(spark, sf_dir), "k", "user_id", "value", F.col("event_type") == "purchase")
    return out.withColumn("completion", r6("completion"))


def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each language, and the distance of all from equal shares."""
    own = R.share(table(spark, sf_dir, "documents"), "lang")
    goal = own.select("lang", F.lit(0.25).alias("goal"))
    gap = R.distribution_gap(own, goal, "lang").select(F.lit("gap").alias("lang"), F.lit(None).cast("long").alias("n"), F.col("gap").alias("share"))
    return own.unionAll(gap).withColumn("share", r6("share"))


def segment_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of users whose farthest item got to the end of each segment, with falls over 0.01."""
    reach = events(spark, sf_dir).groupBy(F.col("user_id").alias("viewer")).agg(F.max("k").cast("double").alias("reach"))
    segments = spark.createDataFrame([("intro", 0.0, 20.0), ("act1", 20.0, 90.0), ("act2", 90.0, 97.0), ("outro", 97.0, 99.0)], "segment string, start double, stop double")
    curve = R.retention(reach, segments)
    falls = R.drop_offs(curve, "start", "retention", 0.01).select("segment", r6("fall").alias("fall"))
    return curve.join(falls, "segment", "left").select("segment", "start", "stop", r6("retention").alias("retention"), "fall")


def cohort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by first day and week since."""
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    out = R.cohorts(rows, "user_id", "day", 7)
    return out.select(F.datediff("cohort", F.lit("1970-01-01").cast("date")).cast("long").alias("cohort"), "period", "users")


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that viewed, then clicked, then bought, each after the first time of the step before."""
    return R.funnel(events(spark, sf_dir), "user_id", "event_type", "t", ["view", "click", "purchase"])


def ab_ztest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of purchases of users with even and odd numbers."""
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    out = R.proportions_test(rows, "v", F.col("event_type") == "purchase", "a", "b")
    return out.select("n_a", "n_b", *[r6(c).alias(c) for c in ("p_a", "p_b", "z")], "winner")


def click_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks by views of each item."""
    return R.click_through(events(spark, sf_dir), "event_type", ["k"], "click", "view").withColumn("ctr", r6("ctr"))


def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations at made-up places within 9000 km of one."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 7 - 85).cast("double").alias("lat"), (F.col("n_nationkey") * 13 - 150).cast("double").alias("lon"))
    return n.select("n_nationkey", F.round(V.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.0), F.lit(11.0)), 3).alias("km")).where("km <= 9000")


_D = "list_transform(x.embedding, lambda v: v::double) xa, list_transform(y.embedding, lambda v: v::double) ya"
_VEC = f"p as (select x.vec_id as query, y.vec_id as item, {_D} from embeddings x join embeddings y on x.vec_id % 20 = 0 and x.vec_id <> y.vec_id)"


def _topk_sql(score: str, order: str) -> str:
    return f"with {_VEC}, s as (select query, item, round({score}, 6) score from p) select query, item, score, row_number() over (partition by query order by score {order}, item) as rank from s qualify rank <= 10"


_PEARSON = """(list_inner_product(list_transform(xa, lambda v: v - list_avg(xa)), list_transform(ya, lambda v: v - list_avg(ya))) / sqrt(list_inner_product(list_transform(xa, lambda v: v - list_avg(xa)), list_transform(xa, lambda v: v - list_avg(xa)))
    * list_inner_product(list_transform(ya, lambda v: v - list_avg(ya)), list_transform(ya, lambda v: v - list_avg(ya)))))"""
_CODE = "c as (select vec_id, list_sum(list_transform(range(0, 32), lambda i: case when embedding[i + 1] > 0 then 1::bigint << i else 0 end))::bigint code from embeddings)"
_RATE = f"{EV}, r as (select user_id as user, k item, avg(value) rating from ev group by 1, 2)"
_SIM = f"""{_RATE}, n as (select "user", sqrt(sum(rating * rating)) norm from r group by 1), s as (select a."user" u, b."user" o, sum(a.rating * b.rating) / (any_value(na.norm) * any_value(nb.norm)) sim from r a join r b on a.item = b.item and a."user" <> b."user"
        join n na on a."user" = na."user" join n nb on b."user" = nb."user" where a."user" in (1, 2, 3) group by 1, 2)"""
QUERIES = {
    "cosine_topk": (cosine_topk, _topk_sql("list_cosine_similarity(xa, ya)", "desc")),
    "l2_topk": (l2_topk, _topk_sql("list_distance(xa, ya)", "")),
    "l1_topk": (l1_topk, _topk_sql("list_sum(list_transform(list_zip(xa, ya), lambda z: abs(z[1] - z[2])))", "")),
    "pearson_topk": (pearson_topk, _topk_sql(_PEARSON, "desc")),
    "visual_topk": (visual_topk, _topk_sql("1 / (1 + list_distance(xa, ya))", "desc")),
    "hamming_pairs": (hamming_pairs, f"with {_CODE} select x.vec_id a, y.vec_id b, bit_count(xor(x.code, y.code))::bigint distance from c x join c y on x.vec_id < y.vec_id where bit_count(xor(x.code, y.code)) <= 4"),
    "hamming_query": (hamming_query, f"with {_CODE} select x.vec_id as query, y.vec_id as item, bit_count(xor(x.code, y.code))::bigint distance from c x join c y on x.vec_id % 20 = 0 and x.vec_id <> y.vec_id where bit_count(xor(x.code, y.code)) <= 10"),
    "ratio_matches": (ratio_matches, f"""with {_CODE}, d as (select x.vec_id as query, y.vec_id as item, bit_count(xor(x.code, y.code))::bigint d from c x join c y on x.vec_id % 10 = 0 and x.vec_id <> y.vec_id),
        r as (select *, row_number() over (partition by query order by d, item) r from d qualify r <= 2), p as (select query, max(item) filter (where r = 1) as item, max(d) filter (where r = 1) best, max(d) filter (where r = 2) as second from r group by 1)
        select query, item, best, second from p where best <= 14 and second > 0 and best < 0.95::double * second"""),
    "fuzzy_names": (fuzzy_names, """with a as (select distinct 'S' || regexp_extract(s_name, '#(\\d+)$', 1) a from supplier), b as (select distinct 'S' || regexp_extract(c_name, '#(\\d+)$', 1) b from customer)
        select a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) score from a, b where levenshtein(a, b) <= 1"""),
    "set_similarity": (set_similarity, """with r as (select min(p_partkey) id, count(*) n, list_sort(list_distinct(string_split(p_name || ' ' || p_type, ' '))) w from part group by w), p as (select x.id a, y.id b, x.n na, y.n nb, x.w wa, y.w wb, len(list_intersect(x.w, y.w)) i from r x join r y on x.id < y.id and list_has_any(x.w, y.w))
        select a, b, na, nb, round(i / (len(wa) + len(wb) - i), 6) jaccard, round(2 * i / (len(wa) + len(wb)), 6) dice, round(i / least(len(wa), len(wb)), 6) as least, round(i / sqrt((len(wa) * len(wb))::double), 6) cosine from p"""),
    "exact_groups": (exact_groups, "select md5(text) digest, count(*) n, min(doc_id) as first from documents group by 1 having count(*) > 1"),
    "duplicate_stats": (duplicate_stats, """with g as (select md5(text) k, count(*) n, sum(n_chars) s, arg_min(n_chars, doc_id) f from documents group by 1) select sum(n)::bigint total, count(*) uniques, sum(s - f)::bigint wasted, round(count(*) / sum(n), 6) ratio from g"""),
    "user_cf_topk": (user_cf_topk, f"""with {_SIM}, t as (select u, o, round(sim, 9) sim from s qualify row_number() over (partition by u order by round(sim, 9) desc, o) <= 10), c as (select u, item, round(sum(sim * rating), 6) score from t join r on r."user" = t.o
        where not exists (select 1 from r q where q."user" = t.u and q.item = r.item) group by 1, 2) select u as "user", item, round(score, 4) score, row_number() over (partition by u order by score desc, item) as rank from c qualify rank <= 5"""),
    "user_similarity": (user_similarity, f"""with {_SIM} select u as "user", o as other, round(sim, 6) sim from s"""),
    "baseline_ratings": (baseline_ratings, f"""with {EV}, r as (select user_id as user, k item, avg(value) / 20 rating from ev group by 1, 2), m as (select avg(rating) mu from r where rating > 0), u as (select "user", avg(rating) bu from r where rating > 0 group by 1), i as (select item, avg(rating) bi from r where rating > 0 group by 1)
        select "user", item, round(least(greatest(mu + coalesce(bu - mu, 0) + coalesce(bi - mu, 0), 0), 5), 6) predicted from r left join u using ("user") left join i using (item), m"""),
    "hybrid_combine": (hybrid_combine, f"""with {EV}, s as (select k item, round(0.7::double * count(*) + 0.3::double * max(value), 6) score from ev group by 1) select item, score, row_number() over (order by score desc, item) as rank from s order by score desc, item limit 12"""),
    "diversified": (diversified, """with r as (select p_partkey, p_type, p_retailprice, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) i from part) select p_partkey, p_type, p_retailprice, round(p_retailprice * pow(0.9::double, i - 1), 6) adjusted from r order by adjusted desc, p_partkey limit 15"""),
    "freshness_rerank": (freshness_rerank, f"""with {OD}, m as (select max(d) as now, max(o_totalprice) as top from od), a as (select o_orderkey, (now - d)::double / 90 r, o_totalprice / top s from od, m)
        select o_orderkey, round(s * 0.6::double + exp(-ln(2) * r) * 0.4::double, 6) blended, round(exp(-ln(2) * r), 6) exponential, round(greatest(1 - r / 2, 0), 6) linear, case when r <= 1 then 1.0::double else 0.0::double end step, round(1 / (1 + log2(1 + r)), 6) logarithmic from a"""),
    "decay_scores": (decay_scores, f"""with {EV}, a as (select *, (max(t) over () - t) / {HOUR}.0::double h from ev) select event_id, round(exp(-ln(6) / 6 * h), 6) log_rate, round(greatest(1 - h / 100, 0), 6) linear, round(case when h < 24 then 1.0 when h < 168 then 0.5 else 0.1 end::double, 6) step,
        round(value / pow(h + 2, 1.8::double), 6) gravity, round(sign(floor(value) - 20) * greatest(log10(greatest(abs(floor(value) - 20), 1)), 1) + (t // 1000000 - 1114293600) / 45000, 6) hot from a"""),
    "ucb_scores": (ucb_scores, f"""with {EV}, b as (select k, avg(value / 500) m, count(*) n, sum((event_type = 'purchase')::bigint) hits from ev group by 1), a as (select count(*) c from ev)
        select k, round(m + 1.4142135623730951::double * sqrt(ln(c) / n), 6) ucb, round((hits + 1) / (n + 2), 6) beta, round(case when n < 10 then 1.0 else least(1 + 0.5::double * log10(n) / 10, 1.12::double) end, 6) trend from b, a"""),
    "implicit_ratings": (implicit_ratings, """select event_id, round(least(case event_type when 'purchase' then 4.0 when 'signup' then 4.5 when 'view' then 2.0 when 'click' then 2.5 when 'error' then 1.0 end::double * least(greatest(value / 50, 0), 1), 5), 6) rating from events"""),
    "trend_hours": (trend_hours, f"""with {EV}, a as (select event_type, ((select max(t) // 1000000 from ev) - t // 1000000) // 3600 age from ev), c as (select event_type, age, count(*) n from a where age >= 0 and age < 24 group by 1, 2)
        select event_type, round(sum(n * exp(-ln(6) / 6 * age)), 6) decayed, round((coalesce(sum(n) filter (where age < 6), 0) - coalesce(sum(n) filter (where age >= 6 and age < 12), 0)) / 6.0::double, 6) velocity from c group by 1"""),
    "view_statistics": (view_statistics, f"with {EV} select k, count(*) views, count(distinct user_id) viewers, floor(sum(value) / count(*))::bigint mean_seconds, round(avg((event_type = 'purchase')::int), 6) completion from ev group by 1"),
    "category_share": (category_share, """with s as (select lang, count(*) n, count(*) / (select count(*) from documents) share from documents group by 1) select lang, n, round(share, 6) share from s union all select 'gap', null, round(sum(abs(share - 0.25)), 6) from s"""),
    "segment_retention": (segment_retention, f"""with {EV}, r as (select user_id, max(k) reach from ev group by 1), s as (select * from (values ('intro', 0.0::double, 20.0::double), ('act1', 20, 90), ('act2', 90, 97), ('outro', 97, 99)) v(segment, start, stop)),
        c as (select segment, start, stop, avg((reach >= stop)::int) q from s, r group by 1, 2, 3), l as (select *, lag(q) over (order by start) - q f from c) select segment, start, stop, round(q, 6) retention, case when f > 0.01 then round(f, 6) end fall from l"""),
    "cohort_matrix": (cohort_matrix, f"""with {EV}, f as (select user_id, min(t // {DAY}) c from ev group by 1), r as (select distinct user_id, t // {DAY} as day from ev) select c as cohort, (day - c) // 7 as period, count(distinct user_id) users from r join f using (user_id) group by 1, 2"""),
    "funnel": (funnel, f"""with {EV}, a as (select user_id, min(t) t from ev where event_type = 'view' group by 1), b as (select ev.user_id, min(ev.t) t from ev join a using (user_id) where event_type = 'click' and ev.t > a.t group by 1),
        c as (select ev.user_id, min(ev.t) t from ev join b using (user_id) where event_type = 'purchase' and ev.t > b.t group by 1)
        select 1::bigint step, 'view' as name, count(*) users from a union all select 2, 'click', count(*) from b union all select 3, 'purchase', count(*) from c"""),
    "ab_ztest": (ab_ztest, """with s as (select count(*) filter (where user_id % 2 = 0) n_a, count(*) filter (where user_id % 2 = 1) n_b, avg((event_type = 'purchase')::int) filter (where user_id % 2 = 0) p_a, avg((event_type = 'purchase')::int) filter (where user_id % 2 = 1) p_b, avg((event_type = 'purchase')::int) p from events),
        z as (select *, (p_b - p_a) / sqrt(p * (1 - p) * (1 / n_a + 1 / n_b)) z from s) select n_a, n_b, round(p_a, 6) p_a, round(p_b, 6) p_b, round(z, 6) z, case when abs(z) < 1.96 then 'none' when z > 0 then 'b' else 'a' end winner from z"""),
    "click_through": (click_through, f"with {EV}, c as (select k, sum((event_type = 'click')::bigint)::bigint clicks, sum((event_type = 'view')::bigint)::bigint as \"views\" from ev group by 1) select *, round(case when \"views\" > 0 then clicks / \"views\" else 0 end, 6) ctr from c"),
    "geo_distance": (geo_distance, """with n as (select n_nationkey, radians(n_nationkey * 7 - 85) la, radians(n_nationkey * 13 - 150) lo from nation), k as (select n_nationkey, round(2 * 6371 * asin(sqrt(pow(sin((radians(48) - la) / 2), 2) + cos(la) * cos(radians(48)) * pow(sin((radians(11) - lo) / 2), 2))), 3) km from n) select * from k where km <= 9000"""),
}
