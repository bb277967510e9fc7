"""Line dedup with DataFrame functions only.

Lines become 128-bit hashes of their keys, which are range-partitioned by hash and a salt of the
document and sorted within by document and position. A window streams over each sorted run: a row
whose document differs from that of the row before it is the document's first occurrence of the
key, and the last of these is the run's largest document. The salt cuts the run of a common line
into SALTS pieces; their counts meet in one row a key. The decisions come back as compressed
bitmaps per document (64-bit words, only those that drop a line) instead of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.columns import packed, unpacked
from lumenframe.session import checkpointed

MIN_CHARS = 40
MIN_DOCS = 5
#: Pieces of a key's run of rows, by document.
SALTS = 64
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """Lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_keys() -> list[Column]:
    """Two hashes that stand for a row's doc_id and text: rows that repeat both have the same lines and get the same bitmap."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(7)).alias("r2")]


def first_occurrences(hashed: DataFrame) -> DataFrame:
    """(h1, h2, doc_id) of the first line of every key in every document, streamed off the sorted partitions."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    dealt = hashed.select("h1", "h2", salt.alias("salt"), "doc_id", "pos").repartitionByRange("h1", "h2", "salt")
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    streamed = dealt.withColumn("before", F.lag(F.struct("doc_id")).over(run))
    return streamed.where(F.col("before").isNull() | ~F.col("before.doc_id").eqNullSafe(F.col("doc_id"))).select("h1", "h2", "doc_id")


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Bitmaps of the lines that go, of the documents that lose any: r1, r2, dropped map<word, bits>, n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
    min_chars code points or more that min_docs or more different doc_ids hold lose their lines
    in every document but that of the largest doc_id. A null doc_id counts as no document and
    never holds the kept copy. Bit p mod 64 of word p div 64 stands for line p, from 0.
    """
    lines = docs.select("doc_id", *row_keys(), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    stripped = lines.where(F.char_length("line") >= min_chars).withColumn("line", F.trim("line", F.lit(_BLANKS)))
    keyed = stripped.where(F.char_length("line") >= min_chars).withColumn("line", F.translate("line", _UPPER, _LOWER))
    hashed = keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc_id", "r1", "r2", "pos")
    hashed = checkpointed(hashed)  # range bounds, counts and decisions all read it: texts are split once
    firsts = first_occurrences(hashed)
    shared = firsts.groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    shared = checkpointed(shared)  # the join then reads two plain shuffles, whose hot partitions adaptive execution can split
    gone = hashed.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    placed = gone.select("r1", "r2", F.shiftrightunsigned("pos", 6).alias("word"), F.expr("shiftleft(1L, pos & 63)").alias("bit"))
    words = placed.repartition("r1", "r2").groupBy("r1", "r2", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("r1", "r2").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, the lines that stay joined by newlines.

    Columns of docs that have one of these names are replaced; all others stay, whatever their names.
    """
    joined = packed(docs, "doc_id", "text").select("text", "rest", *row_keys()).join(bitmaps, ["r1", "r2"], "left")
    lines = split_lines(F.col("text"))
    span = F.sequence(F.lit(0), F.shiftrightunsigned(F.size(lines) - 1, 6))
    joined = joined.withColumn("words", F.when(F.col("dropped").isNotNull(), F.transform(span, lambda w: F.coalesce(F.try_element_at("dropped", w), F.lit(0).cast("long")))))
    kept = F.filter(lines, lambda x, i: F.get("words", F.shiftrightunsigned(i, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63))) == 0)
    text = F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return unpacked(joined, docs.columns, n_lines=F.size(lines).cast("long"), n_dropped=F.coalesce("n_dropped", F.lit(0).cast("long")), kept_text=text)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped, and a digest of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = apply_bitmaps(docs, drop_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
with d as (select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, r, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
g as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.*, (g.key is not null and k.doc_id is distinct from g.keeper) as gone from k left join g on k.key = g.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r, doc_id
"""
