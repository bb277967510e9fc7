"""Verification and completion of near_dup by exact similarity: links between texts whose shingle sets have a Jaccard of SIMILARITY.

A pair at 0.8 differs in about 10 of 64 SimHash bits, more than any number of positional bytes can
guarantee to find, so what the byte-position index proposes is verified here and the rest is found
by prefixes. A text is the set of its WORDS-word shingles; equal sets are one node. In any one order
of all shingles, two sets of similarity s share one of the first n - ceil(s n) + 1 shingles of each,
so the index holds only these, and no pair is lost. The order puts shingles that occur often last,
which keeps lists short; how well their number is known changes the cost, never the result. Pairs of
a list are tallied, dropped where the tally proves them too far apart, and verified on the sets.

Lists of more than MEMBERS sets are those of large groups of near copies. At first they are not
enumerated, as that would take a square number of pairs: each member is proposed with the members
next to it by size and with the list's hub, the set of the most common shingles, which is the text
that the others are copies of if that is there. Components of what that links are then compared
exactly (across()): members of a long list that stand in different components meet in cells of
bounded size, all of them, while members of one component need no more links.

A pair is verified only if the sketches of its sets allow it. A sketch has the parity of the number
of shingles in each of BITS slots; every slot that differs is a shingle that only one set has, so
pairs too far apart are told without the sets, and no other pair is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.components import connected_components
from lumenframe.session import broadcast_if_small, checkpointed, release

WORDS = 5
SIMILARITY = 0.8
#: Shingles, or pairs, that a task holds before it passes them on.
HELD = 1_000_000
#: Most shingles whose frequency the order knows.
KNOWN = 1 << 18
#: A longer list is not enumerated at once; places up to which its members are proposed with each other then.
MEMBERS, PLACES = 16, 8
#: Members of a long list on one side of a cell, and pairs that a cell proposes at most for two components, round by round: in the last one all.
CELL, ROUNDS = 512, (16, 1024, None)
#: Slots of a sketch.
BITS = 1024
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text: one of all words if they are fewer, none without words.

    Only A-Z are lower-cased and words end at ASCII white space.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], dtype=np.uint64)
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * _MIX[0]
        out = (out ^ (out >> np.uint64(29))) * _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def key(found: np.ndarray) -> int:
    """The node of a shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def simhash(found: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed long."""
    bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(found), bitorder="little").view("<i8")[0])


def sketch(found: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of BITS slots."""
    return np.packbits((np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def keys(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) with k, the node of text, fp, the SimHash of its shingle set, n, the set's size, and its sketch."""

    @F.pandas_udf("k long, fp long, n int, sketch binary")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            found = [shingles(x, words) for x in series]
            numbers = pd.DataFrame({"k": [key(x) for x in found], "fp": [simhash(x) for x in found], "n": [len(x) for x in found]}, dtype="int64")
            yield numbers.assign(sketch=pd.Series([sketch(x) for x in found], dtype=object))

    return docs.select("doc_id", "text", run("text").alias("s")).select("doc_id", "text", "s.*")


def frequent(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of at most KNOWN shingles that repeat within tasks, with the logarithm of their number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0
        for frame in frames:
            for text in frame["text"]:
                held.append(shingles(text, words))
                waiting += len(held[-1])
                if waiting > HELD:
                    yield repeated(held)
                    held, waiting = [], 0
        if held:
            yield repeated(held)

    def repeated(held: list[np.ndarray]) -> pd.DataFrame:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    counts = docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.select("h", F.floor(F.log2("n")).cast("int").alias("level")))
    sizes, total, least = counts.groupBy("level").count().orderBy(F.desc("level")).collect(), 0, None
    for r in sizes:
        total += r["count"]
        if total > KNOWN:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    rows = counts.where(F.col("level") >= least).toPandas()
    h, level = rows["h"].to_numpy(dtype=np.int64).view(np.uint64), rows["level"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], level[order]


def postings(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(h, k, n, common): the first shingles h of every set k that another set has among its first; n is its size, common how frequent its shingles are."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, words))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, level = shared.value
        seen: set[int] = set()  # copies within a task go out once
        for frame in frames:
            h, k, n, common = [np.zeros(0, dtype=np.uint64)], [], [], []
            for text in frame["text"]:
                found = shingles(text, words)
                size, node = len(found), key(found)
                if not size or node in seen:
                    continue
                if len(seen) > HELD:
                    seen.clear()
                seen.add(node)
                levels = np.zeros(size, dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    levels = np.where(known[at] == found, level[at], 0)
                first = found[np.argsort(levels, kind="stable")][: size - int(np.ceil(similarity * size - 1e-9)) + 1]
                h.append(first)
                k.append(np.full(len(first), node, dtype=np.int64))
                n.append(np.full(len(first), size, dtype=np.int32))
                common.append(np.full(len(first), 1000 * levels.sum() // size, dtype=np.int32))
            if k:
                yield pd.DataFrame({"h": np.concatenate(h).view(np.int64), "k": np.concatenate(k), "n": np.concatenate(n), "common": np.concatenate(common)})

    dealt = docs.select("text").mapInPandas(run, "h long, k long, n int, common int").repartition("h")
    # A set stays at its first row in a list, if the list has another set.
    along, whole = Window.partitionBy("h").orderBy("k"), Window.partitionBy("h")
    beside = dealt.withColumns({"before": F.lag("k").over(along), "least": F.min("k").over(whole), "most": F.max("k").over(whole)})
    return checkpointed(beside.where((F.col("least") != F.col("most")) & ~F.col("before").eqNullSafe(F.col("k"))).select("h", "k", "n", "common"))


def candidates(lists: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes, a < b, of lists(h, k, n, common) that may have the similarity: all of the short lists, some of the long ones; and the long lists (h, k)."""

    def beside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h, k, n = (frame[c].to_numpy() for c in ("h", "k", "n"))
            for step in range(1, PLACES + 1):
                at = np.flatnonzero(h[step:] == h[:-step])
                yield pd.DataFrame({"x": k[at], "y": k[at + step], "m": n[at], "n": n[at + step]})

    hub = F.max(F.struct("common", "k", "n")).alias("hub")
    sizes = checkpointed(lists.groupBy("h").agg(F.count("*").alias("members"), hub).where("members > 1"))
    met = lists.join(broadcast_if_small(sizes), "h")
    short = met.where(F.col("members") <= MEMBERS).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("s"))
    each = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, MEMBERS), lambda y: F.struct(x["k"].alias("a"), y["k"].alias("b"), x["n"].alias("m"), y["n"].alias("n")))))
    pairs = short.select(F.explode(each).alias("p")).select("p.*", F.lit(False).alias("proposed"))
    long_ = checkpointed(met.where(F.col("members") > MEMBERS).select("h", "k", "n", "hub"))
    near = long_.select("h", "k", "n").repartitionByRange("h", "n", "k").sortWithinPartitions("h", "n", "k").mapInPandas(beside, "x long, y long, m int, n int")
    ends = near.unionAll(long_.select("k", "hub.k", "n", "hub.n")).where("x <> y")
    turned = F.col("x") < F.col("y")
    ends = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(turned, F.col("m")).otherwise(F.col("n")).alias("m"), F.when(turned, F.col("n")).otherwise(F.col("m")).alias("n"))
    every = pairs.unionAll(ends.withColumn("proposed", F.lit(True))).where(F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9)
    whole = lambda x: F.ceil(x - 1e-9)
    # Shared shingles past the end of one of the two prefixes are at most ceil(s n) - 1.
    least: Column = whole(similarity * (F.col("m") + F.col("n")) / (1 + similarity)) - whole(similarity * F.greatest("m", "n")) + 1
    tallied = every.groupBy("a", "b", "m", "n").agg(F.count("*").alias("c"), F.max("proposed").alias("proposed"))
    # The tally lacks the long lists, of which a pair shares no more than either of its sets stands in.
    more = broadcast_if_small(checkpointed(long_.groupBy("k").agg(F.count("*").alias("l"))))
    tallied = tallied.join(more.select(F.col("k").alias("a"), F.col("l").alias("la")), "a", "left").join(more.select(F.col("k").alias("b"), F.col("l").alias("lb")), "b", "left")
    untold = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return tallied.where(F.col("proposed") | (F.col("c") + untold >= least)).select("a", "b"), long_.select("h", "k")


def _apart(m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Most shingles that only one of two sets of these sizes has if they have the similarity; -1 if no such sets can."""
    both = np.ceil(similarity * (m + n) / (1 + similarity) - 1e-6)
    return np.where(both <= np.minimum(m, n), m + n - 2 * both, -1)


def _slots(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(-1, BITS // 64)


def _met(cells: pd.DataFrame, similarity: float, most: int | None) -> pd.DataFrame:
    """The pairs (a, b, cut) of whole cells, as across() describes them; rows of a cell are neighbours."""
    of, side, root, k = cells[["h", "i", "j"]].to_numpy(), cells["side"].to_numpy(), cells["root"].to_numpy(), cells["k"].to_numpy()
    n, bits = cells["n"].to_numpy().astype(np.int64), _slots(cells["sketch"])
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]).any(axis=1)])
    a, b, cut = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
    for start, end in zip(new, np.r_[new[1:], len(of)], strict=True):
        one, two = start + np.flatnonzero(side[start:end] == 0), start + np.flatnonzero(side[start:end] == 1)
        own = of[start, 2] == -1  # here, the others of the cell meet each other as well
        two = np.r_[one, two] if own else two
        found = []
        for at in range(0, len(one), 64):
            i, j = one[at : at + 64], two[at + 1 :] if own else two
            differ = np.bitwise_count(bits[i][:, None] ^ bits[j][None, :]).sum(axis=2, dtype=np.int64)
            near = (differ <= _apart(n[i][:, None], n[j][None, :], similarity)) & (root[i][:, None] != root[j][None, :])
            x, y = np.nonzero(np.triu(near) if own else near)
            found.append((i[x], j[y], differ[x, y] / (n[i[x]] + n[j[y]])))
        if not found:
            continue
        i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
        more = np.zeros(len(i), dtype=bool)
        if most is not None and len(i) > most:
            ends = np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j])], axis=1)
            _, which, counts = np.unique(ends, axis=0, return_inverse=True, return_counts=True)
            order = np.lexsort((far, which))
            rank = np.arange(len(i)) - (np.cumsum(counts) - counts)[which[order]]
            order = order[rank < most]
            i, j, more = i[order], j[order], counts[which[order]] > most
        a.append(np.minimum(k[i], k[j]))
        b.append(np.maximum(k[i], k[j]))
        cut.append(more)
    return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "cut": np.concatenate(cut)})


def allowed(pairs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that the sketches of nodes(k, n, sketch) allow to have the similarity."""

    @F.pandas_udf("boolean")
    def near(m: pd.Series, n: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.bitwise_count(_slots(x) ^ _slots(y)).sum(axis=1) <= _apart(m.to_numpy(), n.to_numpy(), similarity))

    one, two = (nodes.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").where(near("na", "nb", "sa", "sb")).select("a", "b")


def across(crowded: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, most: int | None = None) -> DataFrame:
    """Pairs (a, b, cut), a < b, of members of a list of crowded(h, k) that stand in different components of roots(node, root), if their sketches allow the similarity.

    A list's largest component is dealt to cells apart from the others, as its members need not meet
    each other: a cell holds at most some CELL members of the others and as many of that component, or
    of the others again. Lists of the same members count once. A cell gives out at most `most` pairs of
    two components, those of least distance, all marked as cut if it had more; None: every pair.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            if held is not None and len(held):
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            of = frame[["h", "i", "j"]].to_numpy()
            rest = (of != of[-1]).any(axis=1)
            cut = int(np.flatnonzero(rest)[-1]) + 1 if rest.any() else 0
            held = frame.iloc[cut:]
            if cut:
                yield _met(frame.iloc[:cut], similarity, most)
        if held is not None and len(held):
            yield _met(held, similarity, most)

    rooted = crowded.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("h", "k", F.coalesce("root", "k").alias("root"))
    hashes = [F.bit_xor(F.xxhash64("k", F.lit(i))).alias(f"x{i}") for i in range(2)]
    lists = rooted.groupBy("h", "root").agg(F.count("*").alias("c"), *hashes)
    lists = lists.groupBy("h").agg(F.sum("c").alias("members"), F.max(F.struct("c", "root")).alias("main"), *[F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)])
    lists = lists.where(F.col("members") > F.col("main.c")).groupBy("x0", "x1", "members").agg(F.min(F.struct("h", "main")).alias("one"))
    cells = lambda x: F.ceil(x / CELL).cast("int")
    lists = checkpointed(lists.select("one.h", F.col("one.main.root").alias("main"), cells(F.col("one.main.c")).alias("d"), cells(F.col("members") - F.col("one.main.c")).alias("u")))
    dealt = rooted.join(broadcast_if_small(lists), "h").withColumn("side", (F.col("root") == F.col("main")).cast("int"))
    dealt = dealt.withColumn("at", F.pmod(F.xxhash64("k", F.lit(2)), F.when(F.col("side") == 1, F.col("d")).otherwise(F.col("u"))).cast("int"))
    # Cells (i, j) of two blocks i < j of the others; cells (i, -1 - j) of block i of the others and block j of the main component.
    cell = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    at = F.col("at")
    others = F.concat(
        F.transform(upto(F.col("d")), lambda j: cell(at, -1 - j, 0)),
        F.transform(F.filter(upto(F.col("u")), lambda j: j > at), lambda j: cell(at, j, 0)),
        F.transform(F.filter(upto(F.col("u")), lambda i: i < at), lambda i: cell(i, at, 1)),
    )
    main = F.transform(upto(F.col("u")), lambda i: cell(i, -1 - at, 1))
    dealt = dealt.select("h", "k", "root", F.explode(F.when(F.col("side") == 1, main).otherwise(others)).alias("c")).select("h", "c.*", "k", "root")
    dealt = dealt.join(nodes.select("k", "n", "sketch"), "k").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return dealt.mapInPandas(run, "a long, b long, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut"))


def _table(needed: DataFrame) -> np.ndarray:
    """Bits that tell almost all longs r that needed(r) lacks, and none that it has: 16 or more for each r up to 2**23 of them."""
    bits = 1 << max(16, min(27, int(16 * max(1, needed.count()) - 1).bit_length()))
    place = F.col("r").bitwiseAND(F.lit(bits - 1))
    bit = F.expr("shiftleft(1L, cast(r & 63 as int))")
    rows = needed.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of nodes(k, r) whose sets have the similarity; r is xxhash64 of one text of the node, the only one whose set is made."""
    needed = checkpointed(pairs.select(F.col("a").alias("k")).unionAll(pairs.select("b")).distinct().join(nodes.select("k", "r"), "k").select("r"))
    shared = docs.sparkSession.sparkContext.broadcast(_table(needed))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        seen: set[int] = set()  # copies within a task go out once
        for frame in frames:
            r = frame["r"].to_numpy(dtype=np.int64).view(np.uint64)
            place = r & np.uint64(64 * len(table) - 1)
            frame = frame[(table[place >> np.uint64(6)] >> (r & np.uint64(63))) & np.uint64(1) == 1].drop_duplicates("r")
            frame = frame[np.array([x not in seen for x in frame["r"].tolist()], dtype=bool)]
            if len(seen) > HELD:
                seen.clear()
            seen.update(frame["r"].tolist())
            found = [shingles(x, words) for x in frame["text"]]
            yield pd.DataFrame({"k": pd.Series([key(x) for x in found], dtype="int64"), "s": pd.Series([x.tobytes() for x in found], dtype=object)})

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out, dtype=float)

    sets = docs.select("text", F.xxhash64("text").alias("r")).mapInPandas(run, "k long, s binary")
    sets = checkpointed(sets.dropDuplicates(["k"]))
    met = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("y")), "b")
    return checkpointed(met.where(jaccard("x", "y") >= similarity - 1e-9).select("a", "b"))


def links(docs: DataFrame, nodes: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, proposed: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of nodes(k, r, n, sketch) of docs(text) whose components are those of all pairs of the similarity.

    They come from the lists and from the pairs (a, b) of proposed. Long lists are completed in rounds:
    each compares the components that the links so far leave apart, and the last one cuts nothing.
    """
    lists = postings(docs, words, similarity)
    release(docs.sparkSession)
    found, crowded = candidates(lists, similarity)
    if proposed is not None:
        found = found.unionAll(proposed.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    found = checkpointed(allowed(found, nodes, similarity))
    del lists
    release(docs.sparkSession)
    out = verified(found, docs, nodes, words, similarity)
    if crowded.isEmpty():
        return out
    for most in ROUNDS:
        release(docs.sparkSession)
        more = checkpointed(across(crowded, connected_components(out), nodes, similarity, most))
        if more.isEmpty():
            break
        out = checkpointed(out.unionAll(verified(more.select("a", "b"), docs, nodes, words, similarity)).distinct())
        if more.where("cut").isEmpty():
            break
    return out
