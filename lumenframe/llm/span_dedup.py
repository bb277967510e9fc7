"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed: from each sentence on, the shortest run of
SENTENCES sentences or more that has MIN_WORDS words. A long
sentence is cut before words that a hash picks, so that text without full stops is cut alike
wherever it stands. Runs are joined globally by hash; the first
occurrence (by doc_id, then place) stays, and the sentences under any other one go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.columns import packed, unpacked
from lumenframe.session import checkpointed

SENTENCES = 2
MIN_WORDS = 20
#: A sentence of more words is cut: before each word whose hash leaves 0 by CUT_ONE_IN, and after so many words at the latest.
MAX_SENTENCE = 25
CUT_ONE_IN, LEAST_PIECE = 8, 4
_END = re.compile(r"[.!?]+[\"')\]]*(?=\s)|\n")
_WORD = re.compile(r"\S+")


def sentences(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, words) of the sentences of a text in order; they end at full stops and line ends."""
    text = text or ""
    out: list[tuple[int, int, int]] = []

    def cut(start: int, end: int) -> None:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text, start, end)]
        first = 0
        for at in range(1, len(words) + 1) if len(words) > MAX_SENTENCE else (len(words),):
            n = at - first
            if at == len(words) or n == MAX_SENTENCE or (n >= LEAST_PIECE and xxhash.xxh64_intdigest(text[words[at][0] : words[at][1]].encode("utf-8", "surrogatepass")) % CUT_ONE_IN == 0):
                if n:
                    out.append((words[first][0], words[at - 1][1], n))
                first = at

    at = 0
    for stop in _END.finditer(text):
        cut(at, stop.end())
        at = stop.end()
    cut(at, len(text))
    return out


def runs(text: str | None, n: int = SENTENCES, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """(first sentence, end sentence, 128-bit hash) of every run of a text; white space counts as one blank."""
    text = text or ""
    found = sentences(text)
    flat = [" ".join(text[s:e].split()) for s, e, _ in found]
    total = np.cumsum([0, *(w for _, _, w in found)]).tolist()
    done = lambda i, end: end - i >= n and total[end] - total[i] >= min_words
    end = 0
    for i in range(len(found)):
        end = max(end, i + 1)
        while end <= len(found) and not done(i, end):
            end += 1
        if end > len(found):
            break
        yield i, end, xxhash.xxh3_128_intdigest("\x1f".join(flat[i:end]).encode("utf-8", "surrogatepass"))


def span_rows(docs: DataFrame, n: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, r, i, e, h1, h2): the runs of every row; r tells rows of one doc_id with different texts apart."""

    @F.pandas_udf("i array<int>, e array<int>, h1 array<long>, h2 array<long>")
    def hashed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = [list(runs(text, n, min_words)) for text in series]
            yield pd.DataFrame(
                {
                    "i": [np.array([x[0] for x in f], dtype=np.int32) for f in found],
                    "e": [np.array([x[1] for x in f], dtype=np.int32) for f in found],
                    "h1": [np.array([x[2] >> 64 for x in f], dtype=np.uint64).view(np.int64) for f in found],
                    "h2": [np.array([x[2] & 0xFFFFFFFFFFFFFFFF for x in f], dtype=np.uint64).view(np.int64) for f in found],
                }
            )

    named = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("r"), hashed("text").alias("s")))  # both sides of the join read it
    each = named.select("doc_id", "r", F.explode(F.arrays_zip("s.i", "s.e", "s.h1", "s.h2")).alias("s"))
    return each.select("doc_id", "r", "s.i", "s.e", "s.h1", "s.h2")


def removals(docs: DataFrame, n: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """What goes, of the documents that lose any sentence: doc_id, r, n_removed, ranges, first_doc_ids.

    ranges are the half-open sentence ranges that go, merged and in order; first_doc_ids are the
    documents that hold the occurrences that stay. Null and empty texts have no sentences. Rows that
    repeat doc_id and text are one document; a null doc_id comes before all others.
    """
    spans = span_rows(docs, n, min_words)
    place = F.struct("doc_id", "r", "i")
    first = spans.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    first = checkpointed(first)  # the join then reads two plain shuffles, whose hot partitions adaptive execution can split
    later = spans.join(first, ["h1", "h2"]).where(place != F.col("first"))
    covered = later.groupBy("doc_id", "r").agg(F.collect_set(F.struct("i", "e")).alias("spans"), F.sort_array(F.collect_set("first.doc_id")).alias("first_doc_ids"))
    merged = F.aggregate(
        F.sort_array("spans"),
        F.array().cast("array<struct<i:int,e:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["i"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["i"].alias("i"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    ranged = covered.select("doc_id", "r", merged.alias("ranges"), "first_doc_ids")
    count = F.aggregate("ranges", F.lit(0), lambda acc, x: acc + x["e"] - x["i"]).cast("long")
    return ranged.select("doc_id", "r", count.alias("n_removed"), "ranges", "first_doc_ids")


def remove(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with kept_text: text without the sentences under gone's ranges (other text stays as it is).

    A column named kept_text is replaced, all others stay.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([without(t, g) for t, g in zip(text, ranges, strict=True)])

    base = packed(docs, "doc_id", "text").withColumn("r", F.xxhash64("text"))
    lost = gone.select(F.col("doc_id").alias("lost_id"), F.col("r").alias("lost_r"), "ranges")
    matched = base.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("r") == F.col("lost_r")), "left")
    text = F.when(F.col("ranges").isNull(), F.coalesce("text", F.lit(""))).otherwise(cut("text", "ranges"))
    return unpacked(matched, docs.columns, kept_text=text)


def without(text: str | None, ranges) -> str:
    """The text without the sentences in the ranges."""
    text, found, at, out = text or "", sentences(text), 0, []
    for item in ranges if ranges is not None else []:
        i, e = item["i"], item["e"]
        out.append(text[at : found[i][0]])
        at = found[e][0] if e < len(found) else len(text)
    return "".join(out) + text[at:]


def op8_span_dedup(spark, sf_dir: str) -> DataFrame:
    """The sentences that go of every document that shares a passage with an earlier place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return removals(docs).select("doc_id", "n_removed", "ranges", "first_doc_ids")
