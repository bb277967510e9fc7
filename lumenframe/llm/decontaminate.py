"""Benchmark decontamination with DataFrame functions only.

Windows of a document as long as the benchmark items of a size (in shingles of WORDS words) are
fingerprinted by SimHash and met with all items of that size through RADIUS + 1 blocks of the
fingerprint: two fingerprints within RADIUS bits agree on one block at least, so none within the
radius is lost. The pairs that are close enough are verified by the exact weighted similarity
(multiset Jaccard).

Windows that cannot reach the threshold for any item are never made: similarity s of two multisets
of m and w shingles takes s (m + w) / (1 + s) shared ones, so a window has to hold that many
positions whose shingle is one of the benchmark's. This bound is exact; the starts that meet it are
disjoint ranges between hits. Fingerprints come from running sums over a document's shingles, taken
where windows start and end, so a window costs two rows whatever its length.

The similarity comes from running sums, too: the occurrence of a shingle at place p counts for the
windows that hold p but not its times-th occurrence before, times being how often the item has it.
These windows have consecutive starts, hence two rows an occurrence.

A window at the threshold differs from its item in about 10 of 64 bits with a standard deviation
of 3; RADIUS 24 lies five deviations above that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import broadcast_if_small, checkpointed, let

WORDS = 5
SIMILARITY = 0.8
RADIUS = 24
#: A long with the lowest bit of each half set: a sum of such longs counts two bits.
_LANES = 0x0000000100000001


def with_shingles(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rows with sh array<long>: hashes of the word shingles of text in order, repeats included.

    Words are lower-cased and end at ASCII white space. Fewer words than a shingle has: one
    shingle of them all; none, or a null text: an empty array.
    """
    found = F.split(F.lower(F.coalesce("text", F.lit(""))), "[\\x20\\x09-\\x0D]+")
    hashes = F.transform(F.filter(found, lambda x: x != ""), lambda x: F.xxhash64(x))

    def runs(wh: Column) -> Column:
        n = F.size(wh)
        each = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(F.slice(wh, i, words)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < words, F.array(F.xxhash64(wh))).otherwise(each)

    return rows.withColumn("sh", let(hashes, runs))


def lanes(h: Column) -> list[Column]:
    """32 longs with two bits of h each, one in each half: their sums count all 64 bits."""
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)) for k in range(32)]


def majority(sums: list[Column], n: Column) -> Column:
    """The SimHash of sums of lanes over n hashes: a bit is set that is set in over half of them."""
    out = []
    for k, both in enumerate(sums):
        for half, count in ((0, both.bitwiseAND(F.lit(0xFFFFFFFF))), (32, F.shiftrightunsigned(both, 32))):
            bit = 1 << (k + half)
            out.append(F.when(count * 2 > n, F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), out)


def _starts(p: Column, need: Column, w: Column, n: Column) -> Column:
    """Starts, in order, of the windows of w of n places that hold need of the sorted places p."""

    def between(j: Column) -> Column:
        last = F.element_at(p, j + need - 1)
        low = F.greatest(last - w + 1, F.when(j > 1, F.element_at(p, F.greatest(j - 1, F.lit(1))) + 1).otherwise(F.lit(0)))
        high = F.least(F.element_at(p, j), n - w)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(p) - need + 1), between))


def blocks(fp: Column, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint: array of (block, value)."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*parts)


def windows(places: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(r1, r2, m, w, s) of places(r1, r2, n, pos, h): the windows of w shingles from s on that may match an item of m shingles.

    sizes(h, sizes) has the sizes of the items that hold a shingle.
    """
    hits = places.join(broadcast_if_small(sizes), "h").select("r1", "r2", "n", "pos", F.explode("sizes").alias("m"))
    held = hits.groupBy("r1", "r2", "n", "m").agg(F.sort_array(F.collect_set("pos")).alias("p")).withColumn("w", F.least("m", "n"))
    held = held.withColumn("need", F.ceil(similarity * (F.col("m") + F.col("w")) / (1 + similarity) - 1e-9).cast("int")).where(F.size("p") >= F.col("need"))
    starts = let(F.col("p"), lambda p: _starts(p, F.col("need"), F.col("w"), F.col("n")))
    return held.select("r1", "r2", "m", "w", F.explode(starts).alias("s"))


def fingerprinted(found: DataFrame, places: DataFrame) -> DataFrame:
    """found, windows (r1, r2, m, w, s), with fp, by running sums over the shingles of places(r1, r2, pos, h)."""
    none = F.lit(None).cast("int")
    ends = F.array(F.struct(F.col("s").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("s") + F.col("w")).alias("at"), F.lit(1).alias("sign")))
    asked = found.select("r1", "r2", "m", "w", "s", F.explode(ends).alias("e"))
    # A bound stands before the shingle of its place: sums run over what comes before.
    rows = places.select("r1", "r2", F.col("pos").alias("at"), F.lit(1).alias("last"), "h", none.alias("m"), none.alias("w"), none.alias("s"), none.alias("sign")).unionAll(
        asked.select("r1", "r2", "e.at", F.lit(0), F.lit(0).cast("long"), "m", "w", "s", "e.sign")
    )
    upto = Window.partitionBy("r1", "r2").orderBy("at", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.repartition("r1", "r2").withColumns({f"c{k}": F.sum(x).over(upto) for k, x in enumerate(lanes(F.col("h")))}).where(F.col("sign").isNotNull())
    sums = summed.groupBy("r1", "r2", "m", "w", "s").agg(*[F.sum(F.col(f"c{k}") * F.col("sign")).alias(f"c{k}") for k in range(32)])
    return sums.select("r1", "r2", "m", "w", "s", majority([F.col(f"c{k}") for k in range(32)], F.col("w")).alias("fp"))


def similar(near: DataFrame, places: DataFrame, bag: DataFrame) -> DataFrame:
    """near(r1, r2, item, m, w, s) with x, the number of shingles that window and item share as multisets.

    places(r1, r2, pos, h) are the shingles of the documents, bag(item, h, times) those of the items.
    """
    pairs = near.select("r1", "r2", "item", "w").distinct()
    spots = places.join(pairs, ["r1", "r2"]).join(broadcast_if_small(bag), ["item", "h"])
    spots = spots.groupBy("r1", "r2", "item", "w", "h", "times").agg(F.sort_array(F.collect_set("pos")).alias("p"))

    def opened(p: Column) -> Column:
        before = lambda i: F.coalesce(F.get(p, i - F.col("times").cast("int")), F.lit(-1))
        return F.transform(p, lambda x, i: F.struct(F.greatest(before(i) + 1, x - F.col("w") + 1, F.lit(0)).alias("low"), (x + 1).alias("end")))

    spans = spots.select("r1", "r2", "item", F.explode(let(F.col("p"), opened)).alias("o")).where("o.low < o.end")
    ends = F.array(F.struct(F.col("o.low").alias("s"), F.lit(1).alias("d")), F.struct(F.col("o.end").alias("s"), F.lit(-1).alias("d")))
    none = F.lit(None).cast("int")
    steps = spans.select("r1", "r2", "item", F.explode(ends).alias("e")).groupBy("r1", "r2", "item", "e.s").agg(F.sum("e.d").cast("int").alias("d"))
    rows = steps.select("r1", "r2", "item", "s", "d", none.alias("m"), none.alias("w")).unionAll(near.select("r1", "r2", "item", "s", F.lit(0), "m", "w"))
    # Steps at a start count for the window that starts there: the default frame holds all rows of equal s.
    upto = Window.partitionBy("r1", "r2", "item").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("x", F.sum("d").over(upto)).where(F.col("m").isNotNull())


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs of docs(doc_id, text) and items(item_id, text) that share a passage: doc_id, item_id, window_start, similarity, r1, r2.

    Of each pair the best window is given, the first of several: window_start is the place of its
    first word. Items without words match nothing. Rows that repeat doc_id and text count once;
    r1 and r2 stand for both.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(7)).alias("r2"))
    named = with_shingles(items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item")).dropDuplicates(["item"]), words)
    each = checkpointed(named.select("item", "item_id", F.size("sh").alias("m"), F.explode("sh").alias("h")))
    bag = each.groupBy("item", "h").agg(F.count("*").alias("times"))
    sums = each.groupBy("item", "item_id", "m").agg(*[F.sum(x).alias(f"c{k}") for k, x in enumerate(lanes(F.col("h")))])
    prints = sums.select("item", "item_id", "m", majority([F.col(f"c{k}") for k in range(32)], F.col("m")).alias("item_fp"))

    shingled = with_shingles(docs, words).select("r1", "r2", "sh", F.size("sh").alias("n"))
    places = shingled.select("r1", "r2", "n", F.posexplode("sh").alias("pos", "h"))
    found = checkpointed(windows(places, each.groupBy("h").agg(F.collect_set("m").alias("sizes")), similarity))
    # Only documents with a window are shingled again, each once.
    some = broadcast_if_small(checkpointed(found.select("r1", "r2").distinct()))
    again = with_shingles(docs.join(some, ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]), words)
    again = checkpointed(again.select("doc_id", "r1", "r2", "sh"))
    places = again.select("r1", "r2", F.posexplode("sh").alias("pos", "h"))

    index = prints.select("item", "m", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b")).select("item", "m", "item_fp", "b.*")
    probes = fingerprinted(found, places).withColumn("b", F.explode(blocks(F.col("fp"), radius))).select("r1", "r2", "m", "w", "s", "fp", "b.*")
    met = probes.join(broadcast_if_small(index), ["m", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = checkpointed(met.select("r1", "r2", "item", "m", "w", "s").distinct())
    scored = similar(near, places, bag).withColumn("similarity", F.col("x") / (F.col("m") + F.col("w") - F.col("x"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("r1", "r2", "item").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"))).alias("best"))
    ids = again.select("r1", "r2", "doc_id")
    named = best.join(ids, ["r1", "r2"]).join(broadcast_if_small(prints.select("item", "item_id")), "item")
    return named.select("doc_id", "item_id", (-F.col("best.s")).cast("long").alias("window_start"), F.col("best.similarity").alias("similarity"), "r1", "r2")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the item and the best window."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "window_start", "similarity")


ORACLE = r"""
with w as (
  select doc_id as id, 1 as kind, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
  union all
  select item_id, 2, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark),
s as (
  select id, kind, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end as sh from w),
d as (select id as doc_id, sh, len(sh) as n from s where kind = 1),
i as (select id as item_id, sh, len(sh) as m from s where kind = 2 and len(sh) > 0),
bag as (select item_id, m, h, count(*) as times from (select item_id, m, unnest(sh) as h from i) group by all),
pairs as (
  select doc_id, item_id, m, n from (select doc_id, n, unnest(sh) as h from d) e join bag using (h)
  group by all having count(*) >= ceil(0.8 * (m + least(m, n)) / 1.8 - 1e-9)),
win as (
  select p.doc_id, p.item_id, p.m, least(p.m, p.n) as w, unnest(range(0, p.n - least(p.m, p.n) + 1)) as st from pairs p),
cut as (
  select win.doc_id, win.item_id, win.m, win.w, win.st, unnest(d.sh[win.st + 1:win.st + win.w]) as h from win join d on win.doc_id = d.doc_id),
cnt as (select doc_id, item_id, m, w, st, h, count(*) as here from cut group by all),
x as (
  select c.doc_id, c.item_id, c.m, c.w, c.st, sum(least(c.here, b.times)) as x from cnt c join bag b on c.item_id = b.item_id and c.h = b.h group by all),
sim as (select doc_id, item_id, st, x::double / (m + w - x)::double as similarity from x)
select doc_id, item_id, st::bigint as window_start, similarity from sim where similarity >= 0.8
qualify row_number() over (partition by doc_id, item_id order by similarity desc, st) = 1
"""
