"""Order-dependent, streaming and learned queries; SQL checks them where it can, tests do the rest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text as T
from lumenframe.functions.vectors import doubles
from lumenframe.operators import folds
from lumenframe.plans.common import DAY, EV, HOUR, events
from lumenframe.session import shared_folder, table
from lumenframe.sources import captions, files
from lumenframe.streaming import stateful, windows

r6 = lambda c: F.round(c, 6)


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that a bucket of two tokens, filled once a day, lets pass."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), (F.col("t") / 1e6).alias("at"))
    return folds.token_bucket(rows, 1 / 86400.0, 2.0).select("user", "id", "allowed")


def sliding_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user under a quota of two accepted in two days."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("user"), F.col("event_id").alias("id"), (F.col("t") / 1e6).alias("at"))
    return folds.sliding_quota(rows, 2, 2 * 86400.0, 1).select("user", "id", "decision")


def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes of a frame for each brand, without those that overlap a better one."""
    p = table(spark, sf_dir, "part")
    boxes = p.select(
        F.regexp_extract("p_brand", "(\\d+)$", 1).cast("long").alias("frame"), F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"),
        F.col("p_size").cast("double").alias("w"), F.lit(20.0).alias("h"), F.col("p_retailprice").alias("score"),
    )
    return folds.suppress_overlaps(boxes, 0.3).select("frame", "id")


def merged_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of two roles as one track without overlaps."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("id"), (F.col("turn") * 100).alias("s"), (F.col("turn") * 100 + F.char_length("text")).alias("e"), F.col("role").alias("source"))
    return folds.merge_tracks(rows, "prefer_first").select("track", "id")


def smoothed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user, smoothed with attack and release."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("channel"), F.col("event_id").alias("i"), F.col("value").alias("level"))
    return folds.smooth_levels(rows, 0.5, 0.1).select("channel", "i", r6("smooth").alias("smooth"))


TRANSITIONS = {("new", "view"): "seen", ("seen", "click"): "keen", ("keen", "purchase"): "won", ("seen", "error"): "new", ("keen", "error"): "seen"}


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user after each event."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("t").cast("double").alias("at"), F.col("event_type").alias("event"))
    return folds.run_states(rows, TRANSITIONS, "new", {"won"})


def scaled_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a fleet for each user by the values of their events."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("fleet"), F.col("event_id").alias("i"), F.col("value").alias("load"))
    return folds.scale_fleet(rows, 20.0, 80.0, 1, 5)


def nearest_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tours of the vectors of each label, a tenth of a path each."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") * 10 + F.col("vec_id") % 10).cast("long").alias("path"), F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"))
    return folds.nearest_tour(rows)


def scene_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as shots, grouped in scenes of two or more."""
    rows = events(spark, sf_dir).select(F.col("user_id").alias("video"), F.col("event_id").alias("i"), F.col("value").alias("distance"))
    return folds.group_scenes(rows, 60.0, 2).select("video", "i", "scene")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of the URLs of the pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.fnv1a("url").alias("digest"))


def caption_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues of an srt file each conversation, written and read again."""
    rows = table(spark, sf_dir, "conversations")
    cues = rows.select("conv_id", (F.col("turn") * 1000).alias("start_ms"), (F.col("turn") * 1000 + 900).alias("end_ms"), F.regexp_replace("text", "\\s+", " ").alias("text"))
    return captions.explode_cues(captions.render(cues, "conv_id", "srt"), "content").select("conv_id", F.col("n").cast("long").alias("n"), "start_ms", F.md5("text").alias("digest"))


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a playlist of the parts of each brand."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("place"), F.col("p_size").cast("long").alias("seconds"), F.col("p_name").alias("title"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"))
    return files.playlist(rows, "p_brand", "m3u").select("p_brand", F.md5("content").alias("digest"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return windows.event_stream(spark, path, spark.read.parquet(path).schema)


def _place(spark: SparkSession) -> tuple[str, str]:
    name = f"stream_{uuid.uuid4().hex}"
    return name, f"{shared_folder(spark)}/{name}"


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of a stream, complete at its end."""
    name, place = _place(spark)
    out = windows.to_table(windows.tumbling(_stream(spark, sf_dir), "1 day"), name, place, "complete")
    return out.select(F.floor(F.unix_micros("start") / DAY).cast("long").alias("day"), "event_type", "n", r6("total").alias("total"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day windows each day of a stream."""
    name, place = _place(spark)
    out = windows.to_table(windows.sliding(_stream(spark, sf_dir), "2 days", "1 day"), name, place, "complete")
    return out.select(F.floor(F.unix_micros("start") / DAY).cast("long").alias("day"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream with gaps under twelve hours."""
    name, place = _place(spark)
    out = windows.to_table(windows.sessions(_stream(spark, sf_dir), "12 hours"), name, place, "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream that comes twice, each once."""
    _, place = _place(spark)
    both = _stream(spark, sf_dir).unionAll(_stream(spark, sf_dir))
    return windows.to_parquet(windows.without_repeats(both, ["event_id"], "40 days"), f"{place}-out", place).select("event_id", "user_id")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream over a threshold."""
    _, place = _place(spark)
    return windows.to_parquet(windows.metric_alerts(_stream(spark, sf_dir), 150.0), f"{place}-out", place).select("event_id", "value")


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of each user of a stream."""
    _, place = _place(spark)
    rows = _stream(spark, sf_dir).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), "event_type")
    out = windows.to_parquet(stateful.state_machine(rows, TRANSITIONS, "new", {"won"}), f"{place}-out", place)
    return out.groupBy("user_id").agg(F.max_by("state", "n").alias("state"), F.max("n").alias("n"))


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors by the library's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(doubles(F.col("embedding"))).alias("features"))
    return KMeans(k=8, seed=7, maxIter=10).fit(rows).transform(rows).select("vec_id", "prediction")


def als(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items for each user by alternating least squares on mean values."""
    from pyspark.ml.recommendation import ALS

    rows = events(spark, sf_dir).groupBy(F.col("user_id").cast("int").alias("user"), F.col("k").cast("int").alias("item")).agg(F.avg("value").cast("float").alias("rating"))
    best = ALS(userCol="user", itemCol="item", ratingCol="rating", rank=8, maxIter=5, seed=7, coldStartStrategy="drop").fit(rows).recommendForAllUsers(3)
    return best.select("user", F.explode("recommendations").alias("r")).select("user", "r.item", F.round(F.col("r.rating").cast("double"), 3).alias("score"))


def sketch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate percentiles of each event type from a mergeable sketch."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 10000).alias("p")).select("event_type", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def _fold(rows: str, key: str, order: str, first: str, step: str, out: str, state: str) -> str:
    """SQL of a fold: rows of a key o in order, each with the state that step makes of it and the state r before."""
    return f"""with recursive {EV}, i as ({rows}), o as (select *, row_number() over (partition by {key} order by {order}) rn from i),
        r as (select o.*, {first} from o where rn = 1 union all select o.*, {step} from r join o on o.{key} = r.{key} and o.rn = r.rn + 1) select {out} from r {state}"""


_REQUESTS = "select user_id as \"user\", event_id as id, t / 1e6 as tm from ev"
_NEXT = "case " + " ".join(f"when {{s}} = '{was}' and o.event = '{e}' then '{now}'" for (was, e), now in TRANSITIONS.items()) + " else {s} end"
_STATES = ("select user_id as key, event_id as id, t as tm, event_type as event from ev", "key", "tm, id", _NEXT.format(s="'new'") + " as state", _NEXT.format(s="r.state"))
_TOKENS = "least(2e0, r.tokens + (o.tm - r.tm) * (1 / 86400e0))"
_RECENT = "list_filter(r.accepted, lambda x: o.tm - x < 172800e0)"
_CUT = "r.size >= 2 and o.distance > 60"

QUERIES = {
    "token_bucket": (token_bucket, _fold(_REQUESTS, '"user"', "tm, id", "true as allowed, 1e0 as tokens", f"{_TOKENS} >= 1, {_TOKENS} - ({_TOKENS} >= 1)::int", '"user", id, allowed', "")),
    "sliding_quota": (sliding_quota, _fold(
        _REQUESTS, '"user"', "tm, id", "'allow' as decision, [tm] as accepted, 0 as denied",
        f"case when len({_RECENT}) < 2 then 'allow' when r.denied < 1 then 'throttle' else 'reject' end, case when len({_RECENT}) < 2 then list_append({_RECENT}, o.tm) else {_RECENT} end, case when len({_RECENT}) < 2 then 0 else r.denied + 1 end",
        '"user", id, decision', "",
    )),
    "box_suppression": (box_suppression, None),
    "merged_tracks": (merged_tracks, _fold(
        "select conv_id as track, turn as id, turn * 100 as s, turn * 100 + length(text) as e, role as source from conversations", "track", "s, source, id", "true as kept, e as upto",
        "o.s >= r.upto, case when o.s >= r.upto then o.e else r.upto end", "track, id", "where kept",
    )),
    "smoothed_levels": (smoothed_levels, _fold("select user_id as channel, event_id as i, value as level from ev", "channel", "i", "case when level > 0 then 0.5e0 else 0.1e0 end * level as now",
        "r.now + case when o.level > r.now then 0.5e0 else 0.1e0 end * (o.level - r.now)", "channel, i, round(now, 6) smooth", "")),
    "run_states": (run_states, _fold(*_STATES, "key, id, state", "")),
    "scaled_fleet": (scaled_fleet, _fold("select user_id as fleet, event_id as i, value as load from ev", "fleet", "i", "case when load > 80 then 2 else 1 end::bigint as size",
        "case when o.load > 80 then least(5, r.size + 1) when o.load < 20 then greatest(1, r.size - 1) else r.size end", "fleet, i, size", "")),
    "nearest_tour": (nearest_tour, None),
    "scene_groups": (scene_groups, _fold("select user_id as video, event_id as i, value as distance from ev", "video", "i", "0::bigint as scene, 1 as size",
        f"r.scene + ({_CUT})::int, case when {_CUT} then 1 else r.size + 1 end", "video, i, scene", "")),
    "fingerprints": (fingerprints, """select page_id, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(string_split(url, ''), lambda c: ord(c)::hugeint)),
        lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint), 16, '0')) digest from pages"""),
    "caption_round_trip": (caption_round_trip, """select conv_id, row_number() over (partition by conv_id order by turn) as n, turn * 1000 as start_ms, md5(regexp_replace(text, '\\s+', ' ', 'g')) digest from conversations"""),
    "playlists": (playlists, """select p_brand, md5('#EXTM3U' || chr(10) || string_agg('#EXTINF:' || p_size || ',' || p_name || chr(10) || 'part/' || p_partkey, chr(10) order by p_partkey) || chr(10)) digest from part group by 1"""),
    "stream_tumbling": (stream_tumbling, f"with {EV} select t // {DAY} as day, event_type, count(*) n, round(sum(value), 6) total from ev group by 1, 2"),
    "stream_sliding": (stream_sliding, f"with {EV}, w as (select event_type, unnest([t // {DAY}, t // {DAY} - 1]) as day from ev) select day, event_type, count(*) n from w group by 1, 2"),
    "stream_sessions": (stream_sessions, f"""with {EV}, g as (select *, t - lag(t) over (partition by user_id order by t, event_id) >= {12 * HOUR} b from ev), s as (select *, sum(coalesce(b, false)::int) over (partition by user_id order by t, event_id) x from g)
        select user_id, min(t) start_us, count(*) n from s group by user_id, x"""),
    "stream_dedup": (stream_dedup, "select event_id, user_id from events"),
    "stream_alerts": (stream_alerts, "select event_id, value from events where value > 150"),
    "stream_states": (stream_states, _fold(*_STATES, "key as user_id, arg_max(state, rn) as state, max(rn) as n", "group by key")),
    "kmeans": (kmeans, None),
    "als": (als, None),
    "sketch_percentiles": (sketch_percentiles, None),
}
