"""Operators and functions on small hand-made tables, with edge cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import registry, scores
from lumenframe.functions import text as T
from lumenframe.functions import timecode as TC
from lumenframe.functions import vectors as V
from lumenframe.operators import diffs, filters, folds, graphs, intervals, monitoring, ranking, recommend, similarity, stats
from lumenframe.sources import captions, catalogs, files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def test_segment_retention(spark):
    segments = frame(spark, [("intro", 0.0, 60.0), ("act_1", 60.0, 300.0), ("act_2", 300.0, 600.0), ("outro", 600.0, 660.0)], "segment string, start double, stop double")
    reach = frame(spark, [(i, 660.0 if i < 50 else 300.0) for i in range(100)], "viewer long, reach double")
    curve = recommend.retention(reach, segments)
    assert {r["segment"]: r["retention"] for r in curve.collect()} == {"intro": 1.0, "act_1": 1.0, "act_2": 0.5, "outro": 0.5}
    assert [r["segment"] for r in recommend.drop_offs(curve, "start", "retention", 0.1).collect()] == ["act_2"]
    assert recommend.retention(reach.where("1 = 0"), segments).collect() == []


def test_rolling_z(spark):
    z = lambda values: [r["z"] for r in stats.rolling_z(frame(spark, list(enumerate(values)), "i long, v double"), "v", ["i"], [], 20).orderBy("i").collect()]
    last = z([100.0] * 19 + [-1000.0])
    assert last[-1] < -3 and all(x is None for x in last[:-1])
    assert z([42.0] * 10) == [None] * 10 and z([]) == []


def test_wildcard_overlaps(spark):
    pairs = lambda rows: sorted(map(tuple, intervals.wildcard_overlaps(frame(spark, [(i, *r) for i, r in enumerate(rows)], "id long, scope string, s long, e long"), "scope", 50).collect()))
    assert pairs([("US", 0, 100), ("US", 100, 200)]) == []
    assert pairs([("*", 0, 200), ("US", 100, 300)]) == [(0, 1)]
    assert pairs([("US", 0, 300), ("US", 100, 400), ("US", 200, 500)]) == [(0, 1), (0, 2), (1, 2)]
    assert pairs([("US", 0, 100), ("GB", 0, 100)]) == [] and pairs([("*", 0, 10), ("*", 5, 20)]) == [(0, 1)] and pairs([("US", 5, 5), ("US", 0, 9)]) == []


def test_intervals(spark):
    spans = frame(spark, [("A", 5, 15), ("A", 20, 30)], "k string, s long, e long")
    assert [r["gap"] for r in intervals.adjacent_gaps(spans, ["k"], "s", "e", "e").orderBy("s").collect()] == [None, 5]
    assert [tuple(r) for r in intervals.merge_intervals(spans, ["k"], "s", "e", 5).collect()] == [("A", 5, 30, 2)]
    assert [tuple(r) for r in intervals.missing_numbers(frame(spark, [("A", 1), ("A", 5), ("A", 6)], "k string, n long"), ["k"], "n").collect()] == [("A", 2, 4)]
    shots = frame(spark, [(0, 500), (500, 1000), (1000, 1500), (1500, 2000), (10000, 15000)], "s long, e long")
    windows = intervals.window_counts(shots, "s", "e", 2000, 1000)
    assert windows.where("n >= 3").count() >= 1 and intervals.bursts(windows, 3).count() >= 1
    assert [tuple(r) for r in intervals.window_counts(frame(spark, [(0, 5)], "s long, e long"), "s", "e", 10, 10).collect()] == [(0, 1)]


def test_usage_records(spark):
    rows = [("a-1", "STREAM", 1000, "US"), ("a-2", "BCAST", 500, "GB"), ("a-1", "STREAM", 2000, "DE"), ("a-3", "download", 200, None)]
    out = stats.grouping_report(frame(spark, rows, "asset string, kind string, plays long, territory string"), ["kind"], "plays")
    assert {(r["kind"], r["key"]): r["total"] for r in out.collect()} == {("total", None): 3700, ("kind", "STREAM"): 3000, ("kind", "BCAST"): 500, ("kind", "download"): 200}


def test_ratings(spark):
    rows = [(1, 1, 4.0), (1, 2, 2.0), (2, 1, 4.0), (2, 2, 2.0), (3, 9, 5.0)]
    ratings = frame(spark, rows, "user long, item long, rating double")
    users = frame(spark, [(1,)], "user long")
    assert [(r["other"], round(r["sim"], 9)) for r in recommend.user_similarity(ratings, users).collect()] == [(2, 1.0)]
    assert recommend.user_similarity(ratings.where("1 = 0"), users).collect() == []


def test_hamming(spark):
    codes = frame(spark, [(1, 0x00), (2, 0x01), (3, 0xFF), (4, 0x0F)], "id long, code long")
    near = similarity.hamming_query(codes.where("id = 1"), codes, "id", "code", 2)
    assert [(r["item"], r["distance"]) for r in near.collect()] == [(2, 1)]
    assert sorted(map(tuple, similarity.hamming_pairs(codes, "id", "code", 8, 4).collect())) == [(1, 2, 1), (1, 4, 4), (2, 4, 3), (3, 4, 4)]


def test_percentiles_and_outliers(spark):
    values = frame(spark, [(float(v),) for v in (1, 5, 3, 9, 2)] + [(None,)], "v double")
    summary = stats.summary(values, "v").first()
    assert (summary["low"], summary["high"], summary["n"]) == (1.0, 9.0, 5)
    p = lambda rule, q: stats.percentile(values, "v", q, rule).first()["percentile"]
    assert (p("nearest", 50.0), p("floor", 95.0), p("round", 90.0), p("upper_median", 0.0), p("linear", 50.0)) == (3.0, 5.0, 9.0, 3.0, 3.0)
    assert stats.percentile(values.where("1 = 0"), "v", 50.0).collect() == [] and stats.summary(values.where("1 = 0"), "v").first()["mean"] == 0.0
    assert stats.tukey_outliers(frame(spark, [(float(v),) for v in (1, 2, 1000)], "v double"), "v").collect() == []


def test_seasonal(spark):
    series = [(i, math.sin(2 * math.pi * i / 24) * 10 + (100 if i == 50 else 0)) for i in range(96)]
    parts = monitoring.seasonal(frame(spark, series, "t long, v double"), "t", "v", 24)
    assert 50 in [r["t"] for r in monitoring.seasonal_anomalies(parts, 2.0).collect()]
    assert monitoring.seasonal(frame(spark, series[:10], "t long, v double"), "t", "v", 8).collect() == []
    assert monitoring.seasonal_forecast(parts, 24, 3).count() == 3


def test_search_language(spark):
    rows = frame(spark, [(1, "red car", 5), (2, "blue car", 15), (3, "green boat", None)], "id long, name string, size int")
    ids = lambda q: sorted(r["id"] for r in rows.where(filters.parse_search(q, ["name"])).collect())
    assert ids("") == [1, 2, 3] and ids("car") == [1, 2] and ids("car AND NOT red") == [2] and ids("red OR boat") == [1, 3] and ids('"green boat"') == [3]
    assert ids("size:..10") == [1] and ids("size:10..") == [2] and ids("(red OR blue) -blue") == [1] and ids("graen~1") == [3] and ids("size:5") == [1]
    for bad in ("(car", "car )", "NOT"):
        with pytest.raises(ValueError):
            filters.parse_search(bad, ["name"])


def test_ranking(spark):
    docs = frame(spark, [(1, "the cat sat"), (2, "the cat the cat"), (3, None), (4, "dog")], "id long, t string")
    assert ranking.top(ranking.bm25(docs, "id", "t", ["cat"]), "score", "doc", 5).first()["doc"] == 2
    assert ranking.bm25(docs, "id", "t", ["bird"]).collect() == []
    assert [tuple(r) for r in ranking.phrase_hits(docs, "id", "t", ["cat", "the"]).collect()] == [(2, 1)]
    assert one(spark, ranking.tokens(F.col("v")), "The Cat_1, and é!") == ["cat_1", "é"]


def test_nearest_vectors(spark):
    rows = frame(spark, [(0, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.7071, 0.7071, 0.0])], "id long, v array<float>")
    query = frame(spark, [(9, [1.0, 0.0, 0.0])], "id long, v array<float>")
    found = similarity.nearest(query, rows, "id", "v", 3, V.cosine, True).orderBy("rank").collect()
    assert [r["item"] for r in found] == [1, 2, 0]


def test_fuzzy_names_lose_nothing(spark):
    import itertools

    names = ["".join(x) for n in (2, 3, 4) for x in itertools.product("ab", repeat=n)] + ["clip_one.mov", "clip_0ne.mov", "clp_one.mov", ""]
    left, right = frame(spark, [(x,) for x in names], "a string"), frame(spark, [(x,) for x in names], "b string")
    got = {(r["a"], r["b"]) for r in similarity.fuzzy_names(left, right, 1).collect()}
    all_ = left.crossJoin(right).where(F.levenshtein("a", "b") <= 1)
    assert got == {tuple(r) for r in all_.collect()}


def test_graphs(spark):
    edges = frame(spark, [(1, 2), (2, 3)], "src long, dst long")
    assert {r["node"]: r["level"] for r in graphs.topological_levels(edges).collect()} == {1: 0, 2: 1, 3: 2}
    assert [r["node"] for r in graphs.roots(edges).collect()] == [1] and [r["node"] for r in graphs.tips(edges).collect()] == [3]
    ring = frame(spark, [(1, 2), (2, 1)], "src long, dst long")
    assert graphs.has_cycle(ring) and not graphs.has_cycle(edges)
    assert sorted(r["node"] for r in graphs.reachable(ring, frame(spark, [(1,)], "seed long")).collect()) == [1, 2]
    assert graphs.reachable(edges, frame(spark, [(9,)], "seed long")).collect() == []
    assert {r["node"]: r["height"] for r in graphs.subtree_heights(frame(spark, [(1, None), (2, 1), (3, 2), (4, 1)], "node long, parent long")).collect()} == {1: 2, 2: 1, 3: 0, 4: 0}


def test_diffs(spark):
    old, new = frame(spark, [(1, "a"), (2, None), (3, "c")], "k long, v string"), frame(spark, [(2, None), (3, "d"), (4, "e")], "k long, v string")
    assert {r["k"]: r["change"] for r in diffs.changes(old, new, ["k"], ["v"]).collect()} == {1: "removed", 3: "modified", 4: "added"}
    wide = diffs.pivot_attributes(frame(spark, [("x", "b", "1"), ("x", "a", "2"), ("y", "b", None)], "item string, key string, value string"))
    assert wide.columns == ["item", "a", "b"]
    both = frame(spark, [({"a": "1", "b": "2"}, {"b": "3"})], "p map<string,string>, c map<string,string>").select(diffs.inherit(F.col("p"), F.col("c")).alias("x")).first()["x"]
    assert both == {"a": "1", "b": "3"}


def test_text(spark):
    v = F.col("v")
    assert one(spark, T.strip_tags(v), "a<b>c</b>d<unclosed") == "acd" and one(spark, T.decode_entities(v), "&amp;quot;") == '"'
    assert one(spark, T.remove_descriptions(v), "a [b (c) d] e (f") == "a  e " and one(spark, T.punctuate(v), "hello. world") == "Hello. World."
    assert one(spark, T.wrap(10)(v), "alpha beta gammadeltaepsilon") == ["alpha beta", "gammadelt-", "aepsilon"]
    assert one(spark, T.mask_words(v, ["bad"]), "Bad badly BAD") == "*** badly ***" and one(spark, T.run_lengths(v), "aaab") == "3a1b"
    assert one(spark, T.fnv1a(v), "") == "cbf29ce484222325" and one(spark, T.fnv1a(v), "a") == "af63dc4c8601ec8c" and one(spark, T.fnv1a(v), None) is None
    for url, key in {
        "https://example.com/v?b=2&a=1": "https://example.com/v?a=1&b=2", "https://Example.com/": "https://example.com/", "https://example.com/a/#frag": "https://example.com/a",
    }.items():
        assert one(spark, T.cache_key(v), url) == key
    assert one(spark, T.parse_bitrate(v), "1.5M") == 1_500_000 and one(spark, T.parse_bitrate(v), "fast") is None
    assert one(spark, T.file_size(v), 1536, "long") == "1.50 KB" and one(spark, T.standard_rate(v), 23.9, "double") == 23.976 and one(spark, T.standard_rate(v), 40.0, "double") == 40.0
    assert one(spark, T.route_params("/media/{id}/tags/{tag}", v), "/media/7/tags/x") == {"id": "7", "tag": "x"} and one(spark, T.route_params("/media/{id}", v), "/other") is None
    assert one(spark, T.magic_format(v), bytearray(b"OggS...."), "binary") == "ogg" and [one(spark, T.stem(v), x) for x in ("flies", "running", "walked", "is", "process", "Reseed", "mixes", "éaed", "\u2019ed", "éed")] == ["flie", "runn", "walk", "is", "proc", "rese", "mixe", "éa", "\u2019", "éed"]


def test_timecode(spark):
    v = F.col("v")
    assert one(spark, TC.smpte(v, 25), 90_061, "long") == "01:00:02:11" and one(spark, TC.parse_smpte(v, 25), "01:00:02:11") == 90_061 and one(spark, TC.parse_smpte(v, 25), "x") is None
    assert one(spark, TC.ms_drop_frame(v), 60_060, "long") == "00:01:00;02"
    assert one(spark, TC.intersection(F.lit(0), F.lit(5), F.lit(5), F.lit(9))) is None and one(spark, TC.distance(F.lit(0), F.lit(5), F.lit(8), F.lit(9))) == 3
    with pytest.raises(Exception, match="negative"):
        one(spark, TC.stretch(v, 100, 3.0), 10, "long")


def test_scores(spark):
    v = F.col("v")
    assert one(spark, scores.half_life_weight(v, 3600.0), 7200.0, "double") == 0.25 and one(spark, scores.half_life_weight(v, 0.0), 5.0, "double") == 1.0
    assert one(spark, scores.royalty_cents(v, F.lit(1250).cast("long")), 999, "long") == 124
    assert one(spark, V.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, V.iou(*[F.lit(float(x)) for x in (0, 0, 2, 2, 1, 1, 2, 2)])) == pytest.approx(1 / 7)
    assert one(spark, scores.health(F.lit(0), F.lit(0), F.lit(1.0), 1.0)) == 1.0


def test_folds(spark):
    out = folds.token_bucket(frame(spark, [(1, i, float(t)) for i, t in enumerate((0, 0, 0, 10))], "user long, id long, at double"), 0.1, 2.0).orderBy("id").collect()
    assert [r["allowed"] for r in out] == [True, True, False, True]
    boxes = frame(spark, [(0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (0, 3, 50.0, 50.0, 5.0, 5.0, 0.7)], "frame long, id long, x double, y double, w double, h double, score double")
    assert sorted(r["id"] for r in folds.suppress_overlaps(boxes, 0.5).collect()) == [1, 3]
    cues = frame(spark, [(1, 1, 0, 10, "a"), (1, 2, 5, 15, "b"), (1, 3, 20, 30, "a")], "track long, id long, s long, e long, source string")
    kept = lambda p: sorted(r["id"] for r in folds.merge_tracks(cues, p).collect())
    assert (kept("keep_all"), kept("prefer_first"), kept("prefer_last")) == ([1, 2, 3], [1, 3], [2, 3])
    colours = frame(spark, [(1, 1, 0, 0, 0), (1, 2, 30, 0, 0), (1, 3, 60, 0, 0)], "set long, id long, r int, g int, b int")
    assert [r["cluster"] for r in folds.group_by_first(colours, 40).orderBy("id").collect()] == [0, 0, 1]


def test_sources(spark, tmp_path):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nBye\n"
    assert captions.parse(srt) == [(1, 1000, 2500, "Hello\nthere"), (2, 3000, 4000, "Bye")] and captions.parse(None) == []
    ttml = '<tt xmlns="x"><body><p begin="00:00:01.000" end="00:00:02.5">A &amp; <span>b</span><br/>c</p><p begin="x" end="y">no</p></body></tt>'
    assert captions.parse(ttml) == [(1, 1000, 2500, "A & b\nc")]
    ass = "[Script Info]\n[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\i1}Hi\\Nyou"
    assert captions.parse(ass) == [(1, 1000, 2500, "Hi\nyou")]
    assert captions.parse("WEBVTT\n\n00:01.000 --> 00:02.000 align:left\nx") == [(1, 1000, 2000, "x")] and captions.parse("0:00:01.000,0:00:02.000\ny") == [(1, 1000, 2000, "y")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.srt").write_text(srt)
    assert captions.read_cues(spark, str(tmp_path / "in")).count() == 2
    assert one(spark, captions.dialect(F.col("v")), srt) == "srt" and one(spark, captions.dialect(F.col("v")), "WEBVTT\n") == "webvtt"
    sums = files.checksums(files.scan(spark, str(tmp_path / "in"), ["srt"])).collect()
    assert len(sums) == 1 and sums[0]["bytes"] == len(srt)
    (tmp_path / "m").write_text(f"# list\n{sums[0]['md5']}  {sums[0]['path']}\nffff  gone.bin\n\n")
    status = files.verify(files.manifest(spark, str(tmp_path / "m")), files.checksums(files.scan(spark, str(tmp_path / "in"))), "md5")
    assert sorted(r["status"] for r in status.collect()) == ["match", "missing"]
    (tmp_path / "tc").write_text("# x\n00:00:01:00,00:00:02:00\n00:00:03:00\t00:00:04:00\nbad,line\n")
    assert sorted(map(tuple, files.timecode_list(spark, str(tmp_path / "tc"), 25).collect())) == [(25, 50), (75, 100)]
    rows = frame(spark, [(1, "a"), (2, None)], "k long, v string")
    for kind in ("csv", "tsv", "json", "xml", "parquet"):
        files.write(rows, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.format("xml").option("rowTag", "row").load(str(tmp_path / "xml")).count() == 2
    entries = frame(spark, [("l", 1, 5, "T & t", "u1"), ("l", 2, 6, "S", "u2")], "l string, place int, seconds long, title string, uri string")
    assert files.playlist(entries, "l", "m3u").first()["content"] == "#EXTM3U\n#EXTINF:5,T & t\nu1\n#EXTINF:6,S\nu2\n"
    assert "NumberOfEntries=2" in files.playlist(entries, "l", "pls").first()["content"] and "T &amp; t" in files.playlist(entries, "l", "xspf").first()["content"]
    catalogs.register(spark, {"media_metadata": frame(spark, [("m", "k", "v")], "media_id string, key string, value string")})
    assert spark.table("media_metadata").count() == 1 and spark.table("grants").count() == 0


def test_extension_surface(spark):
    registry.register_operator("double", "projection", lambda df, by=2: df.select((F.col("v") * by).alias("v")))
    rows = frame(spark, [(1,), (None,)], "v long")
    assert registry.apply_operator("double", rows, by=3).first()["v"] == 3 and "double" in registry.operators("projection")
    with pytest.raises(ValueError):
        registry.register_operator("double", "x", lambda df: df)
    assert registry.script_filter(rows, "v > 0").count() == 1
    assert one(spark, registry.template("pad", F.col("v"), "5"), "42") == "00042"
    spark.udtf.register("word_windows", registry.word_windows(2))
    assert [r["words"] for r in spark.sql("select words from word_windows('a b c')").collect()] == ["a b", "b c"]
    registry.register_source(spark)
    assert spark.read.format("frames").option("frames", 10).load().count() == 10


def test_binary_tags(spark):
    import struct

    from lumenframe.sources import tags

    item = struct.pack("<II", 5, 0) + b"Title\0" + b"Hello"
    ape = item + b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 0) + b"\0" * 8
    assert tags.ape(b"xx" + ape) == {"Title": "Hello"} and tags.ape(b"") == {} and tags.ape(b"APETAGEX") == {}
    record = lambda n, v: b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(v)) + v
    assert tags.iptc(record(5, b"T") + record(25, b"a") + record(25, b"b") + b"\x1c\x02\x05\x00\xff") == {"title": "T", "keywords": "a; b"}
    text = struct.pack(">HH", 3, 0) + b"abc"
    atom = struct.pack(">I4s", 8 + len(text), b"\xa9nam") + text
    assert tags.quicktime(atom + b"\0\0\0\0") == {"title": "abc"}
    files_ = frame(spark, [("p", bytearray(atom)), ("q", None)], "path string, content binary")
    assert [tuple(r) for r in tags.exploded(files_, "quicktime").collect()] == [("p", "title", "abc")]


def test_analytics(spark):
    from lumenframe.operators import analytics as A

    users = frame(spark, [(i,) for i in range(2000)], "user long")
    shares = {r["variant"]: r["count"] for r in A.assign_variants(users, "user", {"a": 3.0, "b": 1.0}).groupBy("variant").count().collect()}
    assert 1350 < shares["a"] < 1650
    curve = A.retention_curve(frame(spark, [(1, 10.0, 1.0), (2, 5.0, 1.0)], "viewer long, reach double, weight double"), 2, 10.0)
    assert [(r["point"], r["share"], r["area"]) for r in curve.orderBy("point").collect()] == [(0, 1.0, 0.0), (1, 1.0, 5.0), (2, 0.5, 8.75)]
    row = frame(spark, [([1, 2], [9, 1, 2, 9], [])], "q array<long>, t array<long>, e array<long>")
    found = row.select(A.best_alignment(F.col("q"), F.col("t")).alias("x"), A.best_alignment(F.col("t"), F.col("q")).alias("y"), A.best_alignment(F.col("e"), F.col("t")).alias("z")).first()
    assert (found["x"]["similarity"], found["x"]["offset"]) == (1.0, 1) and (found["y"]["similarity"], found["y"]["offset"]) == (1 - 3 / 128, 0) and found["z"] is None
    shares = stats.proportional(frame(spark, [(1, 0.0), (2, -5.0)], "i long, w double"), "w", 10.0, uniform=True)
    assert [r["share"] for r in shares.collect()] == [5.0, 5.0]


def test_codecs_and_detections(spark):
    from lumenframe.functions import codecs
    from lumenframe.operators import detections

    rows = codecs.with_containers(frame(spark, [("AV1",), ("none",)], "c string"), "c").collect()
    assert {r["c"]: r["containers"] for r in rows} == {"AV1": ["mkv", "mp4", "webm"], "none": []}
    assert one(spark, codecs.compatible(F.lit("flac"), F.col("v")), "MP4") is True and one(spark, codecs.compatible(F.lit("vp8"), F.col("v")), "mp4") is False
    # Three anchors of two classes: the second overlaps the first, the third is of the other class.
    raw = [10.0, 11.0, 10.0, 10.0, 10.0, 10.0, 8.0, 8.0, 8.0, 8.0, 8.0, 8.0, 3.0, 2.0, -5.0, -5.0, -5.0, 1.0]
    found = detections.detections(frame(spark, [(1, raw), (2, None), (3, [1.0])], "frame long, out array<double>"), "out", 2).collect()
    assert [(r["frame"], r["class"], r["x"]) for r in found] == [(1, 0, 6.0), (1, 1, 6.0)]


def test_locks_replays_and_content_ids(spark):
    errors = frame(spark, [(1, i, 5.0) for i in range(4)], "device long, i long, error double")
    assert [r["frequency"] for r in folds.locked_frequency(errors, 100.0, 1.0).orderBy("i").collect()] == [105.0, 110.0, 110.0, 110.0]
    out = graphs.replay(frame(spark, [(1,), (2,), (9,)], "node long"), frame(spark, [(1, 2)], "src long, dst long"), 50).orderBy("node").collect()
    assert [tuple(r) for r in out] == [(1, 0, 0, False), (2, 1, 50, False), (9, None, None, True)]
    assert one(spark, T.content_id(F.col("v")), bytearray(b""), "binary") == "25232284e49cf2cb8cec01864cdc63af" and one(spark, T.content_id(F.col("v")), None, "binary") is None


def test_bucketed_joins_equal_naive_ones(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("ab*"), s, s + rng.choice([0, 1, 5, 40, 400])) for i, s in enumerate(rng.randrange(500) for _ in range(150))] + [(200 + i, "a", 100, 110) for i in range(20)]
    df = frame(spark, rows, "id long, scope string, s long, e long")
    for bucket in (1, 7, 1000):
        got = [(r["l"]["id"], r["r"]["id"]) for r in intervals.overlap_join(df, df, ["scope"], bucket).collect()]
        want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]}
        assert len(got) == len(want) and set(got) == want
    wild = set(map(tuple, intervals.wildcard_overlaps(df, "scope", 50).collect()))
    assert wild == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] or "*" in (a[1], b[1])) and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]}
    points = frame(spark, [(i, rng.choice("ab"), rng.randrange(600)) for i in range(80)], "id long, scope string, t long")
    facts = frame(spark, [(i, rng.choice("ab"), rng.randrange(600), float(i)) for i in range(60)], "n long, scope string, t long, v double")
    known = facts.collect()
    for r in intervals.as_of(points, facts, ["scope"], "t", "v", "n").collect():
        past = [f for f in known if f["scope"] == r["scope"] and f["t"] <= r["t"]]
        assert r["v"] == (max(past, key=lambda f: (f["t"], f["n"]))["v"] if past else None)


def test_bounds_raise(spark, monkeypatch):
    from lumenframe.operators import diffs, graphs

    chain = frame(spark, [(i, i + 1) for i in range(12)], "src long, dst long")
    calls = chain.selectExpr("src as caller", "dst as callee", "1 as time")
    assert graphs.reachable(chain, frame(spark, [(0,)], "seed long"), 12).count() == 12 and graphs.topological_levels(chain, 13).count() == 13 and graphs.hot_path(calls, 0, 12).count() == 13
    for run in (lambda: graphs.reachable(chain, frame(spark, [(0,)], "seed long"), 11), lambda: graphs.topological_levels(chain, 12), lambda: graphs.hot_path(calls, 0, 11)):
        with pytest.raises(RuntimeError):
            run()
    monkeypatch.setattr(diffs, "MOST_KEYS", 2)
    for n in (2, 3):
        rows = frame(spark, [(1, f"k{i}", "v") for i in range(n)], "item long, key string, value string")
        if n > 2:
            with pytest.raises(ValueError, match="keys"):
                diffs.pivot_attributes(rows)
        else:
            assert diffs.pivot_attributes(rows).columns == ["item", "k0", "k1"]


def test_scores_at_their_edges(spark):
    from lumenframe.functions import scores as SC

    v = F.col("v")
    waits = [one(spark, SC.retry_delay(v, 200, 1000, 5), i, "long") for i in range(7)]
    assert waits == [200, 400, 800, 1000, 1000, 0, 0]
    shaken = [one(spark, SC.retry_delay(v, 200, 10_000, 3, 0.5), i, "long") for i in range(4)]
    assert all(w <= s < 1.5 * w for w, s in zip((200, 400, 800), shaken, strict=False)) and shaken[3] == 0 and 0 <= SC.jitter(0) < 1
    assert [one(spark, SC.freshness(v, 10.0, "step"), x, "double") for x in (-1.0, 10.0, 10.5)] == [0.0, 1.0, 0.0] and one(spark, SC.freshness(v, 0.0, "linear"), 1.0, "double") == 0.0
    assert [one(spark, SC.implicit_rating(v, F.lit(s)), x) for x, s in (("share", 2.0), ("view", 0.5), ("pause", -1.0), ("other", 1.0))] == [5.0, 1.0, 0.0, None]
    assert [round(one(spark, SC.trend_multiplier(v, 100, 0.5, 2.0), x, "long"), 6) for x in (99, 100, 10**6)] == [1.0, 1.1, 1.3]
    assert [one(spark, T.has_mojibake(v), x) for x in ("schÃ¶n", "Â", "â€™", "é")] == [True, True, False, False]
    assert one(spark, T.has_word(v, []), "some text") is False and one(spark, T.has_word(v, ["text"]), "some text") is True


def test_histogram_has_every_bin(spark):
    values = frame(spark, [(x,) for x in (0, 1, 2, 99, 100, None)], "x long")
    out = [tuple(r) for r in stats.histogram(values, "x", 4).orderBy("bin").collect()]
    assert out == [(0, 25, 3), (1, 50, 0), (2, 75, 0), (3, 100, 2)]
    assert [tuple(r) for r in stats.histogram(frame(spark, [(7,), (7,)], "x long"), "x", 4).collect()] == [(0, 7, 2)]
    assert stats.histogram(values.where("x > 1000"), "x", 4).collect() == []


def test_baseline_leaves_unrated_out(spark):
    from lumenframe.operators import recommend

    rows = frame(spark, [("a", "x", 5.0), ("a", "y", 4.0), ("b", "x", 5.0), ("b", "y", 0.0), ("c", "y", 0.0)], "user string, item string, rating double")
    out = {(r["user"], r["item"]): round(r["predicted"], 6) for r in recommend.baseline(rows).collect()}
    mu = 14 / 3
    assert out == {("a", "x"): round(min(mu + 4.5 - mu + 5 - mu, 5), 6), ("a", "y"): round(4.5 + 4 - mu, 6), ("b", "x"): 5.0, ("b", "y"): round(5 + 4 - mu, 6), ("c", "y"): 4.0}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trend_counts_every_pair(spark):
    rows = [(i * 37 % 53, (i * i * 29) % 17 - 5) for i in range(120)] + [(None, 1), (3, None)]
    plain = [r for r in rows if None not in r]
    want = sum((y[1] > x[1]) - (y[1] < x[1]) for x in plain for y in plain if x[0] < y[0])
    out = stats.mann_kendall(spark.createDataFrame(rows, "a int, v int"), "v", "a").first()
    assert (out["n"], out["s"]) == (len(plain), want)
    none = stats.mann_kendall(spark.createDataFrame([], "a int, v int"), "v", "a").first()
    assert (none["n"], none["s"], none["z"]) == (0, 0, 0.0)


def test_interleaved_lists_of_any_length(spark):
    sizes, lists = [5, 0, 9, 2], []
    for i, n in enumerate(sizes):
        lists.append([(100 * i + j, float((j * 7) % 5)) for j in range(n)])
    ranked = [sorted(rows, key=lambda r: (-r[1], r[0])) for rows in lists]
    want = [rows[p][0] for p in range(max(sizes)) for rows in ranked if p < len(rows)]
    out = ranking.interleave([spark.createDataFrame(rows, "id long, s double") for rows in lists], "s", "id")
    assert [r["id"] for r in out.orderBy("place").collect()] == want
    assert sorted(r["place"] for r in out.collect()) == list(range(1, 17))


def test_suggestions_lose_nothing(spark):
    terms = ["", "a", "ab", "their", "tier", "thier", "ion", "tion", "nation", "with", "white", "whit", "éa", "their"]
    asked = ["thier", "tion", "wiht", "a", "zzzzzz"]
    want = {(w, t) for w in asked for t in terms if w != t and _edits(w, t) <= 2}
    out = ranking.suggest(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in asked], "word string")).collect()
    assert {(r["word"], r["term"]) for r in out} == want and len(out) == len(want)
    assert all(math.isclose(r["score"], 1 - _edits(r["word"], r["term"]) / max(len(r["word"]), len(r["term"]))) for r in out)


def test_ratio_of_the_two_nearest(spark):
    rows = [(i, (i * 2654435761) % (1 << 32)) for i in range(60)] + [(100, 5), (101, 5), (102, 4)]
    want = set()
    for q, c in rows:
        (best, item), (second, _) = sorted((bin(c ^ d).count("1"), i) for i, d in rows if i != q)[:2]
        if best <= 12 and second > 0 and best < 0.95 * second:
            want.add((q, item, best, second))
    codes = spark.createDataFrame(rows, "id long, code long")
    assert want and {tuple(r) for r in similarity.ratio_match(codes, codes, "id", "code", 12, 0.95).collect()} == want


def test_digests_by_plain_loops(spark):
    def fnv(data, h):
        for b in data:
            h = ((h ^ b) * 0x100000001B3) % (1 << 64)
        return h

    texts = [None, "", "é", *("x" * (i % 23) + str(i) for i in range(40)), "long " * 300]
    rows = spark.createDataFrame([(i, t, None if t is None else t.encode()) for i, t in enumerate(texts)], "i int, t string, b binary").coalesce(1)
    for r in rows.select("t", T.fnv1a("t").alias("f"), T.content_id("b").alias("c")).collect():
        if r["t"] is None:
            assert r["f"] is None and r["c"] is None
            continue
        data = r["t"].encode()
        assert r["f"] == f"{fnv(data, 0xCBF29CE484222325):016x}"
        lanes = (fnv(data[::2], 0xCBF29CE484222325), fnv(data[1::2], 0xAF63DC4C8601EC8C))
        assert r["c"] == b"".join(x.to_bytes(8, "little") for x in lanes).hex()


def test_tours_and_boxes_by_plain_loops(spark):
    points = [(p, 10 * i + p, [float((i * 7 + p) % 11), float((i * 5) % 3)]) for p in (1, 2) for i in range(20)]
    want = set()
    for path in (1, 2):
        left = {i: v for p, i, v in points if p == path}
        now = min(left)
        for place in range(20):
            v = left.pop(now)
            want.add((path, now, place))
            now = min(left, key=lambda i, v=v: (math.dist(v, left[i]) ** 2, i), default=None)
    assert {tuple(r) for r in folds.nearest_tour(spark.createDataFrame(points, "path long, id long, v array<double>")).collect()} == want
    alone = folds.nearest_tour(spark.createDataFrame([(3, 7, [1.0])], "path long, id long, v array<double>")).collect()
    assert [tuple(r) for r in alone] == [(3, 7, 0)]

    boxes = [(f, i, float(i * 13 % 40), float(i * 7 % 30), 12, 9, float(i * 31 % 17)) for f in (0, 1) for i in range(30)]
    cells = {(f, i): {(a, b) for a in range(int(x), int(x) + w) for b in range(int(y), int(y) + h)} for f, i, x, y, w, h, _ in boxes}
    kept = []
    for f, i, *_, _score in sorted(boxes, key=lambda b: (-b[6], b[1])):
        mine = cells[f, i]
        if all(g != f or len(mine & cells[g, j]) / len(mine | cells[g, j]) <= 0.3 for g, j in kept):
            kept.append((f, i))
    rows = spark.createDataFrame([(f, i, x, y, float(w), float(h), s) for f, i, x, y, w, h, s in boxes], "frame long, id long, x double, y double, w double, h double, score double")
    assert {(r["frame"], r["id"]) for r in folds.suppress_overlaps(rows, 0.3).collect()} == set(kept)


def test_exact_quantiles_of_many_values(spark):
    """Ranks among more distinct values than a sketch keeps apart, with ties, nulls and few values."""
    n = 150_001
    rows = spark.range(n).select(F.expr("id * 7919 % 150001").alias("a"), F.expr("if(id % 5 = 0, null, id div 1000)").alias("b"), F.lit(None).cast("double").alias("c")).repartition(16)
    b = sorted(i // 1000 for i in range(n) if i % 5)
    rank = lambda m, q: math.ceil(m * q) - 1
    found = stats.exact_quantiles(rows, ["a", "b", "c"], [0.1, 0.25, 0.5, 0.75])
    assert found == {"a": [rank(n, q) for q in (0.1, 0.25, 0.5, 0.75)], "b": [b[rank(len(b), q)] for q in (0.1, 0.25, 0.5, 0.75)], "c": [None] * 4}
    few = frame(spark, [(3.5,), (1.0,), (2.0,)], "x double")
    assert stats.exact_quantiles(few, ["x"], [0.0, 0.5, 1.0]) == {"x": [1.0, 2.0, 3.5]}


def test_nearest_by_blocks(spark, monkeypatch):
    """Blocks give what the column expressions give: ties, copies, vectors of other lengths, nulls and infinities."""
    import random

    rng = random.Random(5)
    some = [[round(rng.gauss(0, 1), 1) for _ in range(4)] for _ in range(90)]
    odd = [[0.0] * 4, None, [1.0, 2.0], [1.0, None, 0.0, 2.0], [float("inf"), 0.0, 0.0, 1.0], [1e200, 0.0, 0.0, 1.0], [2.0] * 4]
    rows = frame(spark, list(enumerate([*some, *some[:40], *some[:40], *odd])), "id long, v array<double>")
    for score, descending in ((V.cosine, True), (V.pearson, True), (V.l2, False), (V.l2_likeness, True), (V.l1, False)):
        got = similarity.nearest(rows.where("id % 3 = 0 or id > 169"), rows, "id", "v", 5, score, descending)
        plan = got._jdf.queryExecution().toString()
        assert "MapInArrow" in plan
        found = sorted(repr(tuple(r)) for r in got.collect())
        with monkeypatch.context() as m:
            m.setattr(similarity, "KERNELS", {})
            want = sorted(repr(tuple(r)) for r in similarity.nearest(rows.where("id % 3 = 0 or id > 169"), rows, "id", "v", 5, score, descending).collect())
        assert len(want) > 200 and found == want, score


def test_hamming_of_wide_codes(spark):
    """Codes of 64 bits, copies and negative ones among them, against all pairs; every pair once."""
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    codes = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for c in base for _ in range(8)] + base[:3] * 2 + [0, (1 << 64) - 1]
    rows = [(i, c - (1 << 64) if c >= 1 << 63 else c) for i, c in enumerate(codes)]
    df = frame(spark, rows, "id long, code long")
    far = lambda i, j: bin(codes[i] ^ codes[j]).count("1")
    pairs = similarity.hamming_pairs(df, "id", "code", 64, 6)
    assert sorted(map(tuple, pairs.collect())) == [(i, j, far(i, j)) for i in range(len(codes)) for j in range(i + 1, len(codes)) if far(i, j) <= 6]
    met = similarity.hamming_query(df.where("id % 5 = 0"), df, "id", "code", 30)
    assert sorted(map(tuple, met.collect())) == [(i, j, far(i, j)) for i in range(0, len(codes), 5) for j in range(len(codes)) if i != j and far(i, j) <= 30]
    assert "MapInArrow" in met._jdf.queryExecution().toString() and "zip_with" not in pairs._jdf.queryExecution().toString()


def test_nearest_assets_by_blocks(spark):
    """The least distance of each asset, one of them null, with odd vectors, against plain loops."""
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "c", None]), [rng.gauss(0, 2) for _ in range(3)]) for i in range(120)]
    rows += [(120, "d", rows[0][2]), (121, "e", [1.0, None, 0.0]), (122, "a", None), (123, "f", [1e150, 0.0, 0.0]), (124, "g", [1e120, 0.0, 0.0]), (125, "h", [0.0, 0.0])]
    df = frame(spark, rows, "id long, asset string, v array<double>")
    want = {}
    usual = [r for r in rows if r[2] and len(r[2]) == 3 and None not in r[2]]
    for q in usual:
        for r in usual:
            far = math.dist(q[2], r[2])
            if q[0] % 2 == 0 and far <= 5.0:
                want[q[0], r[1]] = min(far, want.get((q[0], r[1]), 9.0))
    out = similarity.nearest_assets(df.where("id % 2 = 0"), df, "id", "v", "asset", 5.0)
    found = {(r["query"], r["asset"]): r["distance"] for r in out.collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-12) for k in want)
    assert "MapInArrow" in out._jdf.queryExecution().toString()


def test_fuzzy_names_of_common_beginnings(spark):
    """Numbered names meet by rests that few share: no piece that all have in common."""
    n = 3000
    left, right = spark.range(0, n, 7).select(F.format_string("S%09d", "id").alias("a")), spark.range(n).select(F.format_string("S%09d", "id").alias("b"))
    out = similarity.fuzzy_names(left, right, 1)
    edits = lambda x: {x[:i] + c + x[i + 1 :] for i in range(1, 10) for c in "0123456789"}
    want = {(f"S{i:09d}", y) for i in range(0, n, 7) for y in edits(f"S{i:09d}") if int(y[1:]) < n}
    found = [(r["a"], r["b"]) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "_h" in out._jdf.queryExecution().toString()  # they met by the substring S0000 before


def test_fuzzy_names_of_any_length(spark, monkeypatch):
    """Short names, long ones, and those at the bound between them."""
    import random

    rng = random.Random(3)
    monkeypatch.setattr(similarity, "RESTS", 81)  # 9 signs at two edits
    names = {"".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 7, 8, 9, 10, 11, 12) for _ in range(14)}
    left, right = frame(spark, [(x,) for x in sorted(names)], "a string"), frame(spark, [(x,) for x in sorted(names)], "b string")
    found = [(r["a"], r["b"]) for r in similarity.fuzzy_names(left, right, 2).collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in names for b in names if _edits(a, b) <= 2}


def test_wildcard_links_count_the_pairs(spark):
    """Numbers of links against the pairs of plain loops: wildcards, null scopes, touching, equal and empty intervals."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice(["*", "a", "b", "c", None]), s := rng.randrange(40), s + rng.choice((0, 3, 7, 7, 20))) for i in range(160)]
    live = [r for r in rows if r[2] < r[3]]
    pairs = {(x[0], y[0]) for x in live for y in live if x[0] < y[0] and x[2] < y[3] and y[2] < x[3] and ("*" in (x[1], y[1]) or x[1] is not None and x[1] == y[1])}
    df = frame(spark, rows, "id long, scope string, s long, e long")
    found = [tuple(r) for r in intervals.wildcard_overlaps(df, "scope", 8).collect()]
    assert len(found) == len(pairs) and set(found) == pairs
    want = {i: (min(r[0] for r in rows if r[1:] == (c, s, e)), sum(i in p for p in pairs)) for i, c, s, e in rows}
    assert {r["id"]: (r["class"], r["n"]) for r in intervals.wildcard_links(df, "scope").collect()} == want


def test_reachable_without_broadcasts(spark, monkeypatch):
    """Frontiers over the bound are shuffled and give the same; what induced() joins is not broadcast."""
    edges = frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (1, 4), (4, 5), (7, 8), (2, 2)], "src long, dst long")
    seeds = frame(spark, [(1,), (7,), (5,)], "seed long")
    want = [(1, 1, 3), (1, 2, 1), (1, 3, 2), (1, 4, 1), (1, 5, 2), (7, 8, 1)]
    for most in (0, 1, graphs.FRONTIER):
        monkeypatch.setattr(graphs, "FRONTIER", most)
        assert sorted(map(tuple, graphs.reachable(edges, seeds).collect())) == want
    inside = graphs.induced(edges, frame(spark, [(1,), (2,), (4,)], "node long"))
    assert sorted(map(tuple, inside.collect())) == [(1, 2), (1, 4), (2, 2)]
    assert "Broadcast" not in inside._jdf.queryExecution().executedPlan().toString()


def test_checkpoints_in_loops_forget_huge_estimates(spark):
    """Estimated sizes multiply from join to join: after some dozens of rounds they are numbers of more bits than there can be."""
    from lumenframe.session import checkpointed

    rows = frame(spark, [(1, 2), (3, 4)], "a long, b long").coalesce(1)
    for _ in range(12):
        other = rows.select("a", F.col("b").alias("c")).hint("broadcast")
        rows = checkpointed(rows.join(other, "a").select("a", F.col("c").alias("b")))
        assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
    assert sorted(map(tuple, rows.collect())) == [(1, 2), (3, 4)]
