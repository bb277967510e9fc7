"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most RADIUS (2) bits share at least 8 - RADIUS (6)
of their 8 positional bytes. Lists of one byte would hold a 256th of all fingerprints each, so the
index has a list for every value of four positions together, for the 14 choices of four that form
the Steiner system S(3, 4, 8): a pair that shares six positional bytes meets in exactly three of
its lists, one that shares five in one, one that shares four in at most one. The tally of a pair
over the lists therefore tells whether it reaches the guaranteed minimum: pairs of LEAST (3) lists
or more are kept and verified by their Hamming distance.

A list of more than MEMBERS fingerprints is not enumerated: its members meet again in the lists of
all six positions that contain the four, where the minimum holds by the key itself, at most 2**16
fingerprints share a list, and a list gives out a spanning forest of its links, never all pairs.
Equal fingerprints are one node from the start.

With a similarity (representatives()) the fingerprints of the index only propose: links are
verified by the Jaccard similarity of the shingle sets, and near_copies completes them, as a pair
at 0.8 differs in about ten bits and need not share any positional byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import near_copies
from lumenframe.llm.columns import packed, unpacked
from lumenframe.operators.components import connected_components
from lumenframe.session import checkpointed

RADIUS = 2
#: Four of the eight byte positions: the blocks of S(3, 4, 8), which are the fours whose numbers cancel by exclusive or.
FOURS = tuple(x for x in combinations(range(8), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0)
#: Lists of FOURS that a pair with six equal positions shares.
LEAST = 3
#: Six of the eight byte positions.
SIXES = tuple(combinations(range(8), 8 - RADIUS))
#: A longer list is refined instead of enumerated.
MEMBERS = 16
#: Shingles hashed at once in one document.
PIECE = 1 << 17


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text, XXH64 with seed 42 of each; 0 if it has no words.

    Only A-Z are lower-cased and words end at ASCII white space, hence the work on UTF-8 bytes.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(words, len(parts)) - 1 :]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(ends)
    for at in range(0, n, PIECE):
        upto = min(n, at + PIECE)
        hashes = np.array([digest(flat[s:e], 42) for s, e in zip(starts[at:upto], ends[at:upto], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs with fp, the fingerprint of text as a signed long (null text: 0); a column of that name is replaced."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(np.array([fingerprint(x, words) for x in series], dtype=np.uint64).astype(np.int64))

    return unpacked(packed(docs, "text"), docs.columns, fp=simhash("text"))


def _mask(positions: tuple[int, ...]) -> Column:
    """Literal of the long that has all bits of the byte positions."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def links(fps: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) of the distinct fingerprints in fps(fp): their components are those of all pairs within RADIUS."""
    lists = F.array(*[F.struct(F.lit(i).cast("byte").alias("four"), F.col("fp").bitwiseAND(_mask(x)).alias("bytes")) for i, x in enumerate(FOURS)])
    postings = fps.select("fp", F.explode(lists).alias("k")).select("k.four", "k.bytes", "fp")
    # Counts and the least members of every list, combined map-side: a long list never stands in one row.
    sizes = checkpointed(postings.groupBy("four", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    met = postings.join(sizes, ["four", "bytes"])
    short = met.where(F.col("n") <= members).groupBy("four", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, members), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = short.select(F.explode(each).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("tally"))
    near = pairs.where((F.col("tally") >= LEAST) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    long_ = met.where(F.col("n") > members).groupBy("fp").agg(F.collect_set("four").alias("fours"))
    sixes = [
        F.when(F.arrays_overlap("fours", F.array(*[F.lit(i).cast("byte") for i, x in enumerate(FOURS) if set(x) <= set(six)])), F.struct(F.lit(k).cast("byte").alias("set"), F.col("fp").bitwiseAND(_mask(six)).alias("bytes")))
        for k, six in enumerate(SIXES)
    ]
    refined = long_.select("fp", F.explode(F.array_compact(F.array(*sixes))).alias("k")).select("k.set", "k.bytes", "fp")
    dealt = refined.repartition("set", "bytes").sortWithinPartitions("set", "bytes", "fp")
    return near.unionAll(dealt.mapInPandas(_verify, "a long, b long")).distinct()


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside the posting lists of a partition that is sorted by list."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if held is not None and len(held):
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        kind, value = frame["set"].to_numpy(), frame["bytes"].to_numpy()
        last = (kind != kind[-1]) | (value != value[-1])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        held = frame.iloc[cut:]
        yield _linked(kind[:cut], value[:cut], frame["fp"].to_numpy()[:cut])
    if held is not None and len(held):
        yield _linked(held["set"].to_numpy(), held["bytes"].to_numpy(), held["fp"].to_numpy())


def _linked(kind: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    out_a, out_b = [], []
    if len(fp):
        new = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])])
        sizes = np.diff(np.r_[new, len(fp)])
        two = new[sizes == 2]
        close = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= RADIUS
        out_a.append(fp[two][close])
        out_b.append(fp[two + 1][close])
        for at, size in zip(new[sizes > 2], sizes[sizes > 2], strict=True):
            a, b = forest(np.unique(fp[at : at + size]))
            out_a.append(a)
            out_b.append(b)
    empty = np.zeros(0, dtype=np.int64)
    return pd.DataFrame({"a": np.concatenate([empty, *out_a]), "b": np.concatenate([empty, *out_b])})


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one posting list, found breadth-first.

    Each frontier is compared with the members not reached yet, block by block: the shared
    positional bytes are tallied first and the Hamming distance of the rest is verified.
    """
    left = members.view(np.uint64).copy()
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            parent = np.zeros(len(left), dtype=np.uint64)
            found = np.zeros(len(left), dtype=bool)
            for at in range(0, len(frontier), 64):
                block = frontier[at : at + 64]
                open_ = np.flatnonzero(~found)
                if not len(open_):
                    break
                differing = left[open_][:, None] ^ block[None, :]
                shared = (differing.view(np.uint8).reshape(len(open_), len(block), 8) == 0).sum(axis=2)
                near = (shared >= 8 - RADIUS) & (np.bitwise_count(differing) <= RADIUS)
                hit = near.any(axis=1)
                found[open_[hit]] = True
                parent[open_[hit]] = block[near[hit].argmax(axis=1)]
            out_a.append(parent[found])
            out_b.append(left[found])
            frontier, left = left[found], left[~found]
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([empty, *out_a]).view(np.int64), np.concatenate([empty, *out_b]).view(np.int64)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text) as (doc_id, fp, component_id): the smallest doc_id reachable by links.

    Texts without words, null texts among them, have fingerprint 0 and are linked like any others.
    Repeated rows stay; a null doc_id is no candidate for component_id.
    """
    marked = checkpointed(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp"))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes.select("fp")))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # A large group's fingerprints share one root: the joins read plain shuffles, whose hot partitions adaptive execution can split.
    smallest = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, words: int = 3, similarity: float | None = None) -> DataFrame:
    """The one row of each component that stays, as (doc_id, r): r is xxhash64 of the row's text.

    Without a similarity, components are those of the fingerprints. With one, links are pairs of
    texts whose shingle sets have that Jaccard similarity: what the index of fingerprints proposes,
    and what near_copies finds, verified on the sets.
    The row of smallest doc_id stays (null ids come last; of several texts under one id, that of least r).
    """
    docs = docs.select("doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r")
    if similarity is None:
        marked = fingerprints(docs, words).select("doc_id", F.xxhash64("text").alias("r"), F.col("fp").alias("k"))
        nodes = checkpointed(marked.groupBy("k").agg(F.min(place).alias("least")))
        roots = connected_components(links(nodes.select(F.col("k").alias("fp"))))
    else:
        marked = near_copies.keys(docs, words).select("doc_id", F.xxhash64("text").alias("r"), "k", "fp", "n", "sketch")
        nodes = checkpointed(marked.groupBy("k").agg(F.min(place).alias("least"), *[F.min(c).alias(c) for c in ("fp", "n", "sketch")]))
        heads = checkpointed(nodes.groupBy("fp").agg(F.min("k").alias("k")))
        same = nodes.select("fp", F.col("k").alias("b")).join(heads.withColumnRenamed("k", "a"), "fp").select("a", "b").where("a <> b")
        ends = links(heads.select("fp"))
        met = ends.join(heads.select(F.col("fp").alias("a"), F.col("k").alias("ka")), "a").join(heads.select(F.col("fp").alias("b"), F.col("k").alias("kb")), "b")
        proposed = checkpointed(same.unionAll(met.select("ka", "kb")))
        roots = connected_components(near_copies.links(docs, nodes.select("k", "least.r", "n", "sketch"), words, similarity, proposed))
    rooted = nodes.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("least", F.coalesce("root", "k").alias("root"))
    return rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.r")


def op3_near_dup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
