"""Full-text search: postings, BM25, TF-IDF, facets, suggestions, and merged rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.order import positions
from lumenframe.operators.similarity import fuzzy_names
from lumenframe.session import broadcast_if_small

#: Words that the tokenizer drops (fixed values).
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was will with".split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def words(text: Column) -> Column:
    """Lower-cased words between blanks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")


def postings(docs: DataFrame, ident: str, fields: Mapping[str, float]) -> DataFrame:
    """(doc, field, term, boost, pos): one row for each occurrence of a word in a field."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(b)).alias("boost"), words(F.col(f)).alias("w")) for f, b in fields.items()])
    rows = docs.select(F.col(ident).alias("doc"), F.explode(each).alias("f"))
    return rows.select("doc", "f.field", "f.boost", F.posexplode("f.w").alias("pos", "term"))


def term_counts(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, term, tf, len): how often a document holds a term, and its length in words."""
    split = docs.select(F.col(ident).alias("doc"), words(F.col(text)).alias("w"))
    each = split.select("doc", F.size("w").alias("len"), F.explode("w").alias("term"))
    return each.groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))


def _query_counts(docs: DataFrame, ident: str, text: str, query: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of the query's terms, their document frequencies and the corpus figures; only query terms are exploded."""
    asked = F.array(*[F.lit(q.lower()) for q in query])
    split = docs.select(F.col(ident).alias("doc"), words(F.col(text)).alias("w"))
    held = split.select("doc", F.size("w").alias("len"), F.explode(F.filter("w", lambda x: F.array_contains(asked, x))).alias("term"))
    counts = held.groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    corpus = split.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg_len"))
    return counts, frequency, corpus


def bm25(docs: DataFrame, ident: str, text: str, query: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score) of the documents that hold a query term."""
    counts, frequency, corpus = _query_counts(docs, ident, text, query)
    rows = counts.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rows.groupBy("doc").agg(F.sum(score).alias("score"))


def tf_idf(docs: DataFrame, ident: str, text: str, query: Sequence[str]) -> DataFrame:
    """(doc, score): sum of tf / length times ln(N / df + 1)."""
    counts, frequency, corpus = _query_counts(docs, ident, text, query)
    rows = counts.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(corpus))
    return rows.groupBy("doc").agg(F.sum(F.col("tf") / F.col("len") * F.log(F.col("n") / F.col("df") + 1.0)).alias("score"))


def log_tf_idf(docs: DataFrame, ident: str, text: str, query: Sequence[str]) -> DataFrame:
    """(doc, score): sum of (1 + ln tf) max(ln(N / df), 0)."""
    counts, frequency, corpus = _query_counts(docs, ident, text, query)
    rows = counts.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(corpus))
    return rows.groupBy("doc").agg(F.sum((1 + F.log("tf")) * F.greatest(F.log(F.col("n") / F.col("df")), F.lit(0.0))).alias("score"))


def top(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The k rows of highest score with rank; ties go to the smaller tie column."""
    best = df.orderBy(F.desc(score), tie).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))


def normalised(df: DataFrame, score: str) -> DataFrame:
    """df with score by its maximum, where that is positive."""
    high = df.agg(F.max(score).alias("_m"))
    return df.crossJoin(F.broadcast(high)).withColumn(score, F.when(F.col("_m") > 0, F.col(score) / F.col("_m")).otherwise(F.col(score))).drop("_m")


def phrase_hits(docs: DataFrame, ident: str, text: str, phrase: Sequence[str]) -> DataFrame:
    """(doc, pos): places where the words of a phrase follow each other."""
    split = docs.select(F.col(ident).alias("doc"), words(F.col(text)).alias("w"))
    n = len(phrase)
    want = F.array(*[F.lit(p.lower()) for p in phrase])
    near = split.where(F.size(F.array_except(want, "w")) == 0).select("doc", F.posexplode("w").alias("pos", "term"), "w")
    return near.where((F.col("term") == phrase[0].lower()) & (F.slice("w", F.col("pos") + 1, n) == want)).select("doc", F.col("pos").cast("long").alias("pos"))


def facets(df: DataFrame, fields: Sequence[str], k: int) -> DataFrame:
    """(field, value, n): the k most frequent values of each field; ties go to the smaller value."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = each.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    frame = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("_r", F.row_number().over(frame)).where(F.col("_r") <= k).drop("_r")


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(term, n): words by frequency."""
    return docs.select(F.explode(words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def autocomplete(vocab: DataFrame, prefix: str, k: int) -> DataFrame:
    """The k most frequent terms with a prefix."""
    return vocab.where(F.col("term").startswith(prefix.lower())).orderBy(F.desc("n"), "term").limit(k)


def suggest(vocab: DataFrame, asked: DataFrame, distance: int = 2) -> DataFrame:
    """(word, term, score): terms of vocab within an edit distance of asked(word), each once, the word itself left out.

    Words and terms meet by the pieces of similarity.fuzzy_names; score is 1 less the distance by the longer length.
    """
    met = fuzzy_names(asked.select(F.col("word").alias("a")), vocab.select(F.col("term").alias("b")), distance)
    return met.where("a <> b").select(F.col("a").alias("word"), F.col("b").alias("term"), "score")


def auto_correct(vocab: DataFrame, asked: DataFrame, distance: int = 2) -> DataFrame:
    """(word, corrected): the best suggestion, or the word if there is none; ties go to the smaller term."""
    best = suggest(vocab, asked, distance).groupBy("word").agg(F.min_by("term", F.struct(-F.col("score"), "term")).alias("term"))
    return asked.join(best, "word", "left").select("word", F.coalesce("term", "word").alias("corrected"))


def expand_synonyms(query: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query(term) with the terms that synonyms(term, other) adds."""
    extra = query.join(broadcast_if_small(synonyms), "term").select(F.col("other").alias("term"))
    return query.select("term").unionAll(extra).distinct()


def interleave(lists: Sequence[DataFrame], score: str, tie: str) -> DataFrame:
    """Round-robin union of ranked lists, without removing repeats: item columns with place from 1.

    Before the row at position p of a list stand the first p - 1 rows of every list and the p-th of the lists before it.
    """
    sizes = [df.count() for df in lists]
    out = None
    for i, df in enumerate(lists):
        p = F.col("place")
        earlier = [F.least(p - 1, F.lit(n)) for n in sizes] + [(p <= n).cast("long") for n in sizes[:i]]
        one = positions(df, "place", F.desc(score), tie).withColumn("place", sum(earlier, F.lit(1)))
        out = one if out is None else out.unionByName(one)
    return out


def field_boost(df: DataFrame, fields: str, boosts: Mapping[str, float], score: str) -> DataFrame:
    """df with score times the product of the boosts of its matched fields; unknown fields count 1."""
    table = F.create_map(*[F.lit(x) for kv in boosts.items() for x in (kv[0], float(kv[1]))])
    factor = F.aggregate(F.col(fields), F.lit(1.0), lambda a, f: a * F.coalesce(F.try_element_at(table, f), F.lit(1.0)))
    return df.withColumn(score, F.col(score) * factor)


def weighted_contains(df: DataFrame, weights: Mapping[str, float], term: str) -> DataFrame:
    """df with score, the sum of the weights of the fields that hold a term; rows without any go."""
    parts = [F.when(F.coalesce(F.lower(F.col(f)).contains(term.lower()), F.lit(False)), float(w)).otherwise(0.0) for f, w in weights.items()]
    return df.withColumn("score", sum(parts[1:], parts[0])).where("score > 0")
