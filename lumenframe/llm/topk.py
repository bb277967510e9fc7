"""Exact top-k inner products by distributed histogram selection.

All candidates are scored against a block of queries; each pass counts the scores of every
query in BINS bins of its current range, the global histogram tells which bin holds the k-th
largest score, and the next pass refines that bin, until it is one score wide. A last pass
keeps what lies above the k-th score and breaks ties at it by the smaller vec_id. Queries go
in blocks of QUERY_BLOCK vectors, the only thing that is broadcast; per pass the driver holds
two longs for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import checkpointed

BINS = 1024
QUERY_BLOCK = 2048
K = 10
#: Of doubles; of scores on either side, which leaves the least long to mark a query's own row, and so that a range of scores has a width as a long.
_GREATEST, _LARGEST = 1.7976931348623157e308, (1 << 62) - 1
#: Candidate vectors scored at once.
ROWS = 2048


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component x as double; vectors that are null or hold null or non-finite components go."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # From 2**53 on a double is whole already, and floor() would saturate as a long.
    scaled = lambda x: F.least(F.greatest(x.cast("double") * 1024, F.lit(-_GREATEST)), F.lit(_GREATEST))
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", whole.alias("v"))


def _scores(frame: pd.DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query positions, candidate ids, score matrix) for each dimension; a query's own row is masked by the least long.

    Inner products of integers are exact in double precision while they stay under 2**53;
    larger ones are taken in 64-bit integers, and beyond these in Python's, cut to the range of
    _LARGEST. Vectors of different lengths do not meet.
    """
    sizes = frame["v"].map(len).to_numpy()
    for size in np.unique(sizes):
        if size not in queries:
            continue
        where, ids, matrix = queries[size]
        rows = np.flatnonzero(sizes == size)
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            block = np.stack(frame["v"].to_numpy()[part]) if size else np.zeros((len(part), 0))
            mine = frame["vec_id"].to_numpy()[part]
            bound = (np.abs(block).max(initial=0.0) * np.abs(matrix).max(initial=0.0)) * max(1, size)
            if bound < 2.0**53:
                product = (matrix @ block.T).astype(np.int64)
            elif bound < 2.0**62:
                product = matrix.astype(np.int64) @ block.astype(np.int64).T
            else:
                exact = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
                product = np.clip(exact(matrix) @ exact(block).T, -_LARGEST, _LARGEST).astype(np.int64)
            product[ids[:, None] == mine[None, :]] = np.iinfo(np.int64).min
            yield where, mine, product


def _grouped(block: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    by: dict[int, list[int]] = {}
    for i, row in enumerate(block):
        by.setdefault(len(row["v"]), []).append(i)
    return {
        size: (np.array(at), np.array([block[i]["vec_id"] for i in at]), np.array([block[i]["v"] for i in at]).reshape(len(at), size))
        for size, at in by.items()
    }


def _block_topk(candidates: DataFrame, block: list, k: int) -> DataFrame:
    context = candidates.sparkSession.sparkContext
    queries = context.broadcast(_grouped(block))
    n, floor_ = len(block), np.iinfo(np.int64).min

    def extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, count = np.full(n, np.iinfo(np.int64).max), np.full(n, floor_), np.zeros(n, dtype=np.int64)
        for frame in frames:
            for where, _, product in _scores(frame, queries.value):
                own = product == floor_
                count[where] += (~own).sum(axis=1)
                high[where] = np.maximum(high[where], product.max(axis=1))
                low[where] = np.minimum(low[where], np.where(own, np.iinfo(np.int64).max, product).min(axis=1))
        at = np.flatnonzero(count)
        yield pd.DataFrame({"q": at, "low": low[at], "high": high[at], "n": count[at]})

    ranges = candidates.mapInPandas(extremes, "q long, low long, high long, n long")
    ranges = ranges.groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()
    # low/width: the range that holds the k-th score; above: scores over that range.
    low, width, above = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    target = np.zeros(n, dtype=np.int64)
    q = ranges["q"].to_numpy(dtype=np.int64)
    low[q], target[q] = ranges["low"], np.minimum(k, ranges["n"])
    width[q] = ranges["high"].to_numpy() - ranges["low"].to_numpy() + 1
    while (width > 1).any():
        step = -(-width // BINS)
        state = context.broadcast((low, width, np.maximum(step, 1)))

        def histogram(frames: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            low, width, step = state.value
            total = np.zeros(n * BINS, dtype=np.int64)
            for frame in frames:
                for where, _, product in _scores(frame, queries.value):
                    inside = (width[where, None] > 1) & (product >= low[where, None]) & (product - low[where, None] < width[where, None])
                    row, col = np.nonzero(inside)
                    bins = (product[row, col] - low[where[row]]) // step[where[row]]
                    total += np.bincount(where[row] * BINS + bins, minlength=n * BINS)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"q": at // BINS, "bin": at % BINS, "n": total[at]})

        counts = candidates.mapInPandas(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        over = counts.withColumn("over", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        want = candidates.sparkSession.createDataFrame(
            pd.DataFrame({"q": np.arange(n), "need": target - above}), "q long, need long"
        )
        chosen = over.join(F.broadcast(want), "q").where("over < need and over + n >= need").select("q", "bin", "over").toPandas()
        q = chosen["q"].to_numpy(dtype=np.int64)
        low[q] += chosen["bin"].to_numpy(dtype=np.int64) * step[q]
        above[q] += chosen["over"].to_numpy(dtype=np.int64)
        width[q] = np.minimum(step[q], width[q] - chosen["bin"].to_numpy(dtype=np.int64) * step[q])
        state.unpersist()
    final = context.broadcast((low, target - above))

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kth, ties = final.value
        tied: dict[int, np.ndarray] = {}
        for frame in frames:
            for where, ids, product in _scores(frame, queries.value):
                row, col = np.nonzero((product > kth[where, None]) & (product > floor_))
                yield pd.DataFrame({"q": where[row], "vec_id": ids[col], "score": product[row, col]})
                row, col = np.nonzero((product == kth[where, None]) & (ties[where, None] > 0))
                for r in np.unique(row):
                    both = np.concatenate([tied.get(where[r], np.zeros(0, dtype=np.int64)), ids[col[row == r]]])
                    tied[where[r]] = np.sort(both)[: ties[where[r]]]
        for q, ids in tied.items():
            yield pd.DataFrame({"q": q, "vec_id": ids, "score": kth[q]})

    kept = candidates.mapInPandas(keep, "q long, vec_id long, score long")
    names = candidates.sparkSession.createDataFrame([(i, r["vec_id"]) for i, r in enumerate(block)], "q long, query_id long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best inner products of every query: query_id, rank, vec_id, score.

    vectors and queries are (vec_id, v); a query does not meet rows of its own vec_id. Fewer than
    k candidates give fewer rows; no queries or no candidates give none. Query rows that repeat a
    vec_id give that query's rows once for each.
    """
    vectors = checkpointed(vectors)
    blocks = checkpointed(queries)
    size = blocks.count()
    parts = max(1, -(-size // QUERY_BLOCK))
    result = None
    for part in range(parts):
        mine = blocks.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).collect()
        for at in range(0, len(mine), 2 * QUERY_BLOCK):
            found = _block_topk(vectors, mine[at : at + 2 * QUERY_BLOCK], k)
            found = checkpointed(found) if parts > 1 else found
            result = found if result is None else result.unionAll(found)
    if result is None:
        result = vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    return result.withColumn("rank", F.col("rank").cast("int"))


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Ten best candidates of every vector whose id is divisible by 100."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0 and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
