"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than LONG code points are split before encoding, at places where no match of the
splitting pattern can cross: before a blank or line feed that follows something other than white
space. Every alternative of a pattern in SPLITTABLE ends before white space that follows something
else, so the pieces have together the same matches, hence the same ids, as the whole text. Texts
under any other pattern are encoded whole. Ids are decoded to raw bytes, never to text, so a token
that ends inside a character is kept.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.columns import packed, unpacked

LONG = 1 << 16
#: Fixed value: the pattern for which the cut is proven, as white space is at most the first sign of a match or all of it.
SPLITTABLE = frozenset((r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",))
_SAFE = re.compile(r"(?<=\S)[ \n]")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; one per worker process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about LONG code points, cut only at safe places."""
    at = 0
    while len(text) - at > LONG:
        cut = _SAFE.search(text, at + LONG)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, rank_file: str, pattern: str) -> list[int]:
    """Ids of a whole text; a null text is empty."""
    codec = encoding(rank_file, pattern)
    ids: list[int] = []
    for piece in pieces(text or "") if pattern in SPLITTABLE else (text or "",):
        ids += codec.encode_ordinary(piece)
    return ids


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The bytes that ids stand for."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def tokenize(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """docs with ids array<int> and decoded binary. A null text has no ids; columns of these names are replaced, all others stay."""

    @F.pandas_udf("ids array<int>, decoded binary")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            ids = [encode(x, rank_file, pattern) for x in series]
            yield pd.DataFrame({"ids": ids, "decoded": [decode(x, rank_file, pattern) for x in ids]})

    rows = packed(docs, "text").select("rest", both("text").alias("both"))
    return unpacked(rows, docs.columns, ids=F.col("both.ids"), decoded=F.col("both.decoded"))


def digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, through encode() and decode().

    The digests are taken next to the codec, so ids and bytes never leave the Python worker.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def sums(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = []
            for text in series:
                ids = encode(text, rank_file, pattern)
                listed = " ".join(map(str, ids)).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decode(ids, rank_file, pattern)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", sums("text").alias("_s")).select("doc_id", "_s.*")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded bytes of every document's whole text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
