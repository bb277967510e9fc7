"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, hash-chosen sample of labelled documents
(max_docs_per_lang documents of each language in expectation). The log-probability
matrix has one row per hash bucket and one column per language; it is broadcast, and
documents are scored in numpy as sparse rows (bucket indices with repeats).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.columns import packed, unpacked

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_DOCS_PER_LANG = 3_000
#: Most languages: each is a column of the matrix. More values mean that the labels are no languages.
MAX_LANGS = 500
#: Code points hashed at once; a longer text is scored piece by piece, so memory is bounded.
SEGMENT = 1 << 16
UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str | None) -> np.ndarray:
    """Lower-cased letters of a text, each run of anything else as one space."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, raw, 32)[keep].astype(np.uint64)


def _segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document index, bucket) of every n-gram of the texts, in pieces of bounded size."""
    reach = max(ORDERS) - 1
    parts: list[tuple[int, np.ndarray, int]] = []
    size = 0
    for index, text in enumerate(texts):
        codes = _codes(text)
        for at in range(0, len(codes), SEGMENT):
            piece = codes[at : at + SEGMENT + reach]
            parts.append((index, piece, min(SEGMENT, len(codes) - at)))
            size += len(piece)
            if size >= SEGMENT:
                yield _features(parts)
                parts, size = [], 0
    if parts:
        yield _features(parts)


def _features(parts: list[tuple[int, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for _, p, _ in parts])
    codes = np.concatenate([p for _, p, _ in parts])
    where = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.repeat(lengths, lengths)
    starts = np.repeat(np.array([n for _, _, n in parts]), lengths)
    owner = np.repeat(np.array([i for i, _, _ in parts]), lengths)
    owners, buckets = [], []
    for order in ORDERS:
        ok = np.flatnonzero((where < starts) & (where + order <= ends))
        mixed = np.full(len(ok), order, dtype=np.uint64)
        for k in range(order):
            mixed = (mixed ^ codes[ok + k]) * _MULTIPLIERS[k]
            mixed ^= mixed >> np.uint64(29)
        owners.append(owner[ok])
        buckets.append((mixed & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over labelled(text, lang); counted per partition, then summed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, group in frame.groupby("lang"):
                held = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, buckets in _segments(group["text"].tolist()):
                    held += np.bincount(buckets, minlength=BUCKETS)
        for lang, held in totals.items():
            at = np.flatnonzero(held)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": held[at]})

    counts = labelled.select("text", "lang").mapInPandas(run, "lang string, bucket long, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, max_docs_per_lang: int = MAX_DOCS_PER_LANG, alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix (BUCKETS x languages) and log priors from labelled(doc_id, text, lang).

    Only the matrix reaches the driver: its size is BUCKETS times the number of languages, of which
    there may be MAX_LANGS; more raise a ValueError.
    """
    labelled = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0)), np.zeros(0)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_docs_per_lang / sizes[lang]))])
    dice = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    counted = count_ngrams(labelled.where(dice < share[F.col("lang")])).toPandas()
    counts = np.zeros((BUCKETS, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[counted["bucket"].to_numpy(dtype=np.int64), counted["lang"].map(place).to_numpy(dtype=np.int64)] = counted["n"].to_numpy()
    matrix = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * BUCKETS))
    prior = np.log(np.array([sizes[x] for x in langs], dtype=float) / sum(sizes.values()))
    return langs, matrix, prior


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score, the posterior probability of the predicted language.

    A text that is null or has no letter gets `und` and 0, as does every text if nothing was
    learned. Ties go to the language that sorts first. Columns named lang_pred or score are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, matrix, prior = shared.value
        for frame in frames:
            texts = frame.tolist()
            totals = np.zeros((len(texts), len(langs)))
            seen = np.zeros(len(texts), dtype=np.int64)
            for owner, bucket in _segments(texts):
                seen += np.bincount(owner, minlength=len(texts))
                for k in range(len(langs)):
                    totals[:, k] += np.bincount(owner, weights=matrix[bucket, k], minlength=len(texts))
            if not langs:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": np.zeros(len(texts))})
                continue
            totals += prior
            best = totals.argmax(axis=1)
            odds = np.exp(totals - totals.max(axis=1, keepdims=True))
            score = odds.max(axis=1) / odds.sum(axis=1)
            known = seen > 0
            yield pd.DataFrame(
                {"lang_pred": [langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], "score": np.where(known, score, 0.0)}
            )

    guess = F.pandas_udf(run, "lang_pred string, score double")
    rows = packed(docs, "text").select("rest", guess(F.col("text")).alias("guess"))
    return unpacked(rows, docs.columns, lang_pred=F.col("guess.lang_pred"), score=F.col("guess.score"))


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 4 (a null id: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where("doc_id is not null").where(~held_out()))
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(marked, model).select("doc_id", "held_out", "lang_pred", "score")
