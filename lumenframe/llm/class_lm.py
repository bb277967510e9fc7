"""Brown class-based bigram language model: P(text) = product of P(class | context) P(word | class).

Counts cover all training documents and every word that occurs twice has a learned class. Exchange
clustering assigns the core, the words whose share of the training tokens is at least EXCHANGE_SHARE
(so at most 1 / EXCHANGE_SHARE words, whatever the corpus): from the bigram table each word's
neighbours are counted by class, and words move to the class that makes the corpus most likely; the
moves are chosen on the executors. Then every other word goes to the class that makes its own
occurrences most likely, given the contexts they stand in: one distributed step over the counts of
all (word, context), so that the clustered vocabulary grows with the corpus.

A context is what stands before a word: the class of a core word, the shape (length, last sign,
script) of any other word, or the begin of the text. Words that occur once share classes by shape,
which also hold all unseen words: there are SHAPES of them beside CLASSES learned ones.
Transitions and emissions are smoothed and each sum to one.

Words of at least TABLE_SHARE are scored from a broadcast table, which the same argument bounds to
1 / TABLE_SHARE words; every rarer token is joined with the full table of words, by the word itself.
What goes through the shuffle grows with the corpus; what reaches the driver does not.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.columns import packed, unpacked
from lumenframe.session import checkpointed

CLASSES = 64
EXCHANGE_SHARE = 2e-5
TABLE_SHARE = 2e-6
ROUNDS = 6
BANDS = 4
SHAPES = 4 * BANDS
#: Classes and contexts: learned classes, shapes, and the end (as a context: the begin).
KINDS = CLASSES + SHAPES + 1
#: Weight of the class unigram in the smoothed class transitions.
BACKOFF = 5.0
END = "\n"
_MARKS = frozenset(range(33, 48)) | frozenset(range(58, 65)) | frozenset(range(91, 97)) | frozenset(range(123, 127))
#: Distinct words, or pairs, that a task holds before it passes them on.
HELD = 1_000_000
#: Tokens worked on at once; words outside the table that a task knows at once.
CHUNK, FRESH = 1 << 18, 300_000


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shape(word: bytes) -> int:
    """Shape of a word: by length, last sign and script."""
    return min((len(word) - 1) // 3, BANDS - 1) * 4 + (word[-1] in _MARKS) * 2 + (not word.isascii())


_SCORED = pa.struct(
    [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.string())), ("codes", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
)
_EMPTY = pa.array([], _SCORED)


class Symbols:
    """Numbers the words of texts: those of a table as it says, others as they come, from first on, until FRESH of these are known."""

    def __init__(self, number: dict[bytes, int]) -> None:
        self.number, self.first = number, len(number)
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = defaultdict(itertools.count(self.first).__next__, self.number)
        self.names: list[bytes] = []
        self.shapes = np.zeros(0, dtype=np.int64)
        self.full = False

    def chunks(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The numbers of the words of some texts at a time, -1 for the end of each text and before the first; full: the next ones are new."""
        parts, size = [[-1]], 1
        for text in texts:
            found = words(text)
            parts += (list(map(self.at.__getitem__, found)), [-1])
            size += len(found) + 1
            self.full = len(self.at) - self.first > FRESH
            if size > CHUNK or self.full:
                yield self._flat(parts, size)
                parts, size = [[-1]], 1
                if self.full:
                    self.forget()
        if size > 1:
            yield self._flat(parts, size)

    def _flat(self, parts: list[list[int]], size: int) -> np.ndarray:
        new = list(itertools.islice(self.at, self.first + len(self.names), None))
        self.names += new
        self.shapes = np.concatenate([self.shapes, np.fromiter(map(shape, new), dtype=np.int64, count=len(new))])
        return np.fromiter(itertools.chain.from_iterable(parts), dtype=np.int64, count=size)

    def symbols(self, flat: np.ndarray) -> np.ndarray:
        """Table numbers, then shapes, then END."""
        shapes = np.concatenate([self.shapes, [SHAPES]])  # the last for -1, by its index
        return np.where((flat >= 0) & (flat < self.first), flat, self.first + shapes[np.where(flat < 0, -1, np.maximum(flat - self.first, 0))])


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 by 7 (a null id: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the texts of docs, with one END a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        ends = 0
        for frame in frames:
            for text in frame["text"]:
                held.update(words(text))
                ends += 1
                if len(held) > HELD:
                    yield _counted(held)
                    held = Counter()
        held[END.encode()] = ends
        yield _counted(held)

    counts = docs.select("text").mapInPandas(run, "word string, n long")
    return counts.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series([w.decode("utf-8", "replace") for w in held], dtype=object), "n": np.fromiter(held.values(), dtype=np.int64, count=len(held))})


def count_pairs(docs: DataFrame, exchanged: dict[bytes, int]) -> DataFrame:
    """(a, b, n): bigrams of symbols: words of the exchange by number, then shapes, then END, which also stands before a text."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(exchanged)
    size = len(exchanged) + SHAPES + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Symbols(shared.value)
        keys, counts, buffer = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
        for flat in known.chunks(text for frame in frames for text in frame["text"]):
            line = known.symbols(flat)
            buffer.append(line[:-1] * size + line[1:])
            if sum(map(len, buffer)) > 2 * HELD:
                keys, counts = _merge(keys, counts, buffer)
                buffer = []
                if len(keys) > 2 * HELD:
                    yield pd.DataFrame({"a": keys // size, "b": keys % size, "n": counts})
                    keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys, counts = _merge(keys, counts, buffer)
        yield pd.DataFrame({"a": keys // size, "b": keys % size, "n": counts})

    pairs = docs.select("text").mapInPandas(run, "a int, b int, n long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _merge(keys: np.ndarray, counts: np.ndarray, buffer: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *buffer]), return_counts=True)
    both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
    return both, np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)


def profiles(pairs: DataFrame, of: np.ndarray, kinds: int) -> DataFrame:
    """(symbol, code, n): how often a symbol stands before each class, code, and after it, kinds + code."""
    shared = pairs.sparkSession.sparkContext.broadcast(of)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for frame in frames:
            a, b, n = (frame[c].to_numpy(dtype=np.int64) for c in ("a", "b", "n"))
            both = np.concatenate([a * (2 * kinds) + of[b], b * (2 * kinds) + kinds + of[a]])
            keys, where = np.unique(both, return_inverse=True)
            yield pd.DataFrame({"symbol": keys // (2 * kinds), "code": keys % (2 * kinds), "n": np.bincount(where, weights=np.concatenate([n, n])).astype(np.int64)})

    counts = pairs.mapInPandas(run, "symbol long, code int, n long").groupBy("symbol", "code").agg(F.sum("n").alias("n"))
    return checkpointed(counts)


def class_bigrams(counts: DataFrame, of: np.ndarray, kinds: int) -> np.ndarray:
    """Bigram counts of classes, from the profiles of all symbols."""
    shared = counts.sparkSession.sparkContext.broadcast(of)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(kinds * kinds, dtype=np.int64)
        for frame in frames:
            symbol, code, n = (frame[c].to_numpy(dtype=np.int64) for c in ("symbol", "code", "n"))
            total += np.bincount(shared.value[symbol] * kinds + code, weights=n, minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "n": total[at]})

    rows = counts.where(F.col("code") < kinds).mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(kinds * kinds)
    out[rows["k"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return out.reshape(kinds, kinds)


def moves(counts: DataFrame, joint: np.ndarray, n_words: int, classes: int, moving: np.ndarray) -> pd.DataFrame:
    """(symbol, class): the best class of every moving word by its profile, found on the executors."""
    kinds = len(joint)
    smooth = np.log(joint + 0.5)
    # Rows: a neighbour's class after the word, then before it; columns: the word's class.
    table = np.concatenate([smooth[:classes].T, smooth[:, :classes]])
    shared = counts.sparkSession.sparkContext.broadcast((moving, table, np.log(joint.sum(axis=1)[:classes] + 0.5) * 2))

    @F.pandas_udf("boolean")
    def moves_now(symbols: pd.Series) -> pd.Series:
        moving = np.append(shared.value[0], False)
        return pd.Series(moving[np.minimum(symbols.to_numpy(), len(moving) - 1)])

    @F.pandas_udf("int")
    def best(codes: pd.Series, times: pd.Series) -> pd.Series:
        _, table, margin = shared.value
        held = np.zeros((len(codes), 2 * kinds))
        for i, (c, n) in enumerate(zip(codes, times, strict=True)):
            held[i, c] = n
        return pd.Series((held @ table - held[:, :kinds].sum(axis=1)[:, None] * margin).argmax(axis=1), dtype="int32")

    each = counts.where(F.col("symbol") < n_words).groupBy("symbol").agg(F.collect_list(F.struct("code", "n")).alias("p"))
    return each.where(moves_now("symbol")).select("symbol", best("p.code", "p.n").alias("class")).toPandas()


def exchange(pairs: DataFrame, n_words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols, and the class bigram counts, by batch exchange.

    Words start in classes by rank. In a round half of them may move, each to the class that the
    current class counts make most likely for all of its neighbours; the assignment of highest
    corpus likelihood stays. Shapes and END keep classes of their own.
    """
    kinds = classes + SHAPES + 1
    of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(SHAPES + 1)]).astype(np.int64)
    best = None
    for step in range(rounds + 1):
        counts = profiles(pairs, of, kinds)
        joint = class_bigrams(counts, of, kinds)
        # Class likelihood: sum of n log n over class pairs, less both margins.
        total = lambda x: (x * np.log(np.maximum(x, 1.0))).sum()
        gain = total(joint) - total(joint.sum(axis=1)) - total(joint.sum(axis=0))
        if best is None or gain > best[0]:
            best = (gain, of.copy(), joint)
        elif step > 3:
            break
        if step == rounds or not n_words:
            break
        moving = (np.arange(n_words) * 2654435761 >> 7) % 2 == step % 2
        moved = moves(counts, joint, n_words, classes, moving)
        of[moved["symbol"].to_numpy(dtype=np.int64)] = moved["class"].to_numpy(dtype=np.int64)
    return best[1], best[2]


_CONTEXTS = pa.schema([("word", pa.string()), ("codes", pa.list_(pa.int32()))])


def count_contexts(docs: DataFrame, exchanged: dict[bytes, int], of: np.ndarray) -> DataFrame:
    """(word, codes): the contexts of every word outside the core, each as n * KINDS + context, combined within tasks only."""
    shared = docs.sparkSession.sparkContext.broadcast((exchanged, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, of = shared.value
        known = Symbols(number)
        buffer: list[np.ndarray] = []
        for flat in known.chunks(text for batch in batches for text in batch.column(0).to_pylist()):
            context = of[known.symbols(flat[:-1])]
            rare = np.flatnonzero(flat[1:] >= known.first)
            buffer.append((flat[1:][rare] - known.first) * KINDS + context[rare])
            if known.full or sum(map(len, buffer)) > 4 * HELD:
                yield flushed(known.names, buffer)
                buffer = []
        if buffer:
            yield flushed(known.names, buffer)

    def flushed(names: list[bytes], buffer: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(buffer), return_counts=True)
        word, first = np.unique(keys // KINDS, return_index=True)
        spelled = pa.array([names[i].decode("utf-8", "replace") for i in word.tolist()], pa.string())
        codes = pa.ListArray.from_arrays(np.append(first, len(keys)).astype(np.int32), pa.array((n * KINDS + keys % KINDS).astype(np.int32)))
        return pa.RecordBatch.from_arrays([spelled, codes], schema=_CONTEXTS)

    return docs.select("text").mapInArrow(run, "word string, codes array<int>")


def assign(contexts: DataFrame, joint: np.ndarray) -> DataFrame:
    """Every word of contexts(word, codes) with its count and its class: (word, n, class, null).

    A word that occurs twice or more goes to the learned class that makes its occurrences most
    likely, one that occurs once to the class of its shape. Rows without a word have, for a part of
    the words, how many tokens n of a class stand in a context.
    """
    learned = joint[:, :CLASSES] + 0.5
    shared = contexts.sparkSession.sparkContext.broadcast((np.log(learned / learned.sum(axis=1, keepdims=True)), np.log(learned.sum(axis=0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = shared.value
        sums = np.zeros((KINDS, KINDS))
        for names, held in _by_word(batches):
            total = held.sum(axis=1)
            cls = (held @ table - total[:, None] * size).argmax(axis=1)
            once = np.flatnonzero(total == 1)
            cls[once] = [CLASSES + shape(w.encode()) for w in names[once]]
            np.add.at(sums.T, cls, held)
            yield rows(names, total, cls, None)
        context, cls = np.nonzero(sums)
        yield rows(None, sums[context, cls], cls, context)

    def rows(names: np.ndarray | None, n: np.ndarray, cls: np.ndarray, context: np.ndarray | None) -> pa.RecordBatch:
        word = pa.nulls(len(n), pa.string()) if names is None else pa.array(names, pa.string())
        place = pa.nulls(len(n), pa.int32()) if context is None else pa.array(context.astype(np.int32))
        return pa.RecordBatch.from_arrays([word, pa.array(n.astype(np.int64)), pa.array(cls.astype(np.int32)), place], ["word", "n", "class", "context"])

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, n long, class int, context int")


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of a partition that is sorted by word, with their tokens by context; a word has one vector here however many tasks have seen it."""
    last, sums = None, None
    for batch in (part.slice(at, 1 << 14) for part in batches for at in range(0, part.num_rows, 1 << 14)):
        word = np.array(batch.column(0).to_pylist(), dtype=object)
        starts = np.r_[True, word[1:] != word[:-1]]
        names, place = word[starts], np.cumsum(starts) - 1
        codes = batch.column(1).flatten().to_numpy().astype(np.int64)
        place = np.repeat(place, batch.column(1).value_lengths().to_numpy())
        held = np.bincount(place * KINDS + codes % KINDS, weights=codes // KINDS, minlength=len(names) * KINDS).reshape(-1, KINDS)
        if last is not None and names[0] == last:
            held[0] += sums
        elif last is not None:
            names, held = np.append([last], names), np.vstack([sums, held])
        last, sums = names[-1], held[-1].copy()
        if len(names) > 1:
            yield names[:-1], held[:-1]
    if last is not None:
        yield np.array([last], dtype=object), sums[None]


class Model:
    """Probabilities of a fitted model: transition (contexts x classes) and size, the tokens of every class.

    A word of n tokens in a learned class has the probability n / size; in the class of a shape,
    each word seen once, and all unseen words together, have 1 / (size + 1).
    """

    def __init__(self, joint: np.ndarray) -> None:
        self.size = joint.sum(axis=0)
        unigram = (self.size + 1) / (self.size.sum() + KINDS)
        self.transition = np.log10((joint + BACKOFF * unigram) / (joint.sum(axis=1, keepdims=True) + BACKOFF))

    def emission(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words of n tokens; END, of the last class, is certain."""
        learned = np.log10(np.maximum(n, 1) / np.maximum(self.size[cls], 1))
        return np.where(cls < CLASSES, learned, np.where(cls < KINDS - 1, -np.log10(self.size[cls] + 1), 0.0))


def fit(training: DataFrame, n_train: int, frequent: dict[bytes, int]) -> tuple[Model, dict[bytes, int], np.ndarray, DataFrame]:
    """The model, the core words by number, the classes of symbols, and all other words (word, n, class)."""
    core = [w for w, n in frequent.items() if n >= EXCHANGE_SHARE * n_train]
    exchanged = {w: i for i, w in enumerate(core)}
    pairs = checkpointed(count_pairs(training, exchanged))
    of, joint = exchange(pairs, len(core))
    others = checkpointed(assign(count_contexts(training, exchanged, of), joint))
    whole = joint.copy()
    whole[:, CLASSES : KINDS - 1] = 0.0  # tokens outside the core: by the classes they got
    for r in others.where("word is null").groupBy("context", "class").agg(F.sum("n").alias("n")).collect():
        whole[r["context"], r["class"]] += r["n"]
    return Model(whole), exchanged, of, others.where("word is not null").select("word", "n", "class")


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score, from a model of training's texts.

    A null text is empty: its only token is the end. Without training rows every token is unknown
    (base: log10 1 = 0, as V and N are 0). Columns of docs with these names are replaced, text goes,
    and all others stay, whatever their names. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    counts = checkpointed(count_words(training))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_types = sums["n"], sums["v"]
    ends = n_train and counts.where(F.col("word") == END).first()["n"]
    rows = counts.where((F.col("word") != END) & (F.col("n") >= TABLE_SHARE * n_train)).orderBy(F.desc("n"), "word").select("word", "n").toPandas()
    frequent = {w.encode(): n for w, n in zip(rows["word"], rows["n"], strict=True)}
    model, exchanged, of, others = fit(training, n_train, frequent)
    learned = others.where(F.col("n") >= TABLE_SHARE * n_train).select("word", "class").toPandas()
    classes = dict(zip((w.encode() for w in learned["word"]), learned["class"], strict=True))
    number = {w: i for i, w in enumerate(frequent)}
    cls = np.array([of[exchanged[w]] if w in exchanged else classes[w] for w in number], dtype=np.int64)
    context = np.array([of[exchanged[w]] if w in exchanged else CLASSES + shape(w) for w in number], dtype=np.int64)
    n_table, times = len(number), np.array(list(frequent.values()), dtype=float)
    unseen = CLASSES + np.arange(SHAPES)
    known = {
        "class": np.concatenate([cls, unseen, [KINDS - 1]]).astype(np.int64),
        "context": np.concatenate([context, unseen, [KINDS - 1]]).astype(np.int64),
        "emission": np.concatenate([model.emission(times, cls), model.emission(np.ones(SHAPES), unseen), [0.0]]),
        "base": np.concatenate([np.log10(times + 1), np.zeros(SHAPES), [np.log10(ends + 1)]]),
    }
    shared = spark.sparkContext.broadcast((number, known, model.transition))
    spread = float(np.log10(n_train + n_types + 1))
    known_end = int(ends > 0)

    @F.arrow_udf("n_tokens long, n_known long, base double, score double, tail array<string>, codes array<int>, times array<int>")
    def local(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        number, known, transition = shared.value
        numbered = Symbols(number)
        for series in texts:
            yield pa.concat_arrays([_EMPTY, *(scored(numbered, known, transition, flat) for flat in numbered.chunks(series.to_pylist()))])

    def scored(numbered: Symbols, known: dict[str, np.ndarray], transition: np.ndarray, flat: np.ndarray) -> pa.Array:
        at = numbered.symbols(flat)
        before, tokens = known["context"][at[:-1]], at[1:]
        ends = np.flatnonzero(flat[1:] < 0)
        starts = np.r_[0, ends[:-1] + 1]
        score = np.add.reduceat(transition[before, known["class"][tokens]] + known["emission"][tokens], starts)
        size = ends - starts + 1
        base = np.add.reduceat(known["base"][tokens], starts) - spread * size
        n_known = np.add.reduceat((tokens < n_table).astype(np.int64), starts) + known_end
        rare = np.flatnonzero((tokens >= n_table) & (tokens < n_table + SHAPES))
        row = np.searchsorted(ends, rare)
        word, cell = flat[1:][rare] - numbered.first, before[rare]
        span = max(1, len(numbered.names)) * KINDS
        keys, times = np.unique(row * span + word * KINDS + cell, return_counts=True)
        row, word = keys // span, keys % span // KINDS
        codes = numbered.shapes[word] * KINDS + keys % KINDS
        some, where = np.unique(word, return_inverse=True)
        spelled = pa.array([numbered.names[i].decode("utf-8", "replace") for i in some.tolist()], pa.string()).take(pa.array(where))
        cut = pa.array(np.searchsorted(row, np.arange(len(ends) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, x) for x in (spelled, pa.array(codes.astype(np.int32)), pa.array(times.astype(np.int32)))]
        return pa.StructArray.from_arrays([pa.array(size), pa.array(n_known), pa.array(base), pa.array(score), *lists], fields=list(_SCORED))

    kept = [c for c in docs.columns if c != "text"]
    first = packed(docs, "text", but=("text",)).select("rest", F.monotonically_increasing_id().alias("row"), local("text").alias("l"))
    first = checkpointed(first)
    tail = first.select("row", F.explode(F.arrays_zip("l.tail", "l.codes", "l.times")).alias("t"))
    tail = tail.select("row", F.col("t.tail").alias("word"), F.expr(f"t.codes div {KINDS}").alias("shape"), (F.col("t.codes") % KINDS).alias("context"), "t.times")
    # A rare word was scored as unseen; where it is known, its own class and count replace that.
    rarer = others.where(F.col("n") < TABLE_SHARE * n_train)
    grown = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(model.transition)], "context int, to array<double>")
    sizes, alone = F.lit(np.log10(np.maximum(model.size, 1)).tolist()), F.lit((model.transition[:, unseen] + model.emission(np.ones(SHAPES), unseen)).tolist())
    met = tail.join(rarer, "word").join(F.broadcast(grown), "context")
    better = F.get("to", F.col("class")) + F.log10("n") - F.get(sizes, F.col("class")) - F.get(F.get(alone, F.col("context")), F.col("shape").cast("int"))
    gain = F.when(F.col("n") > 1, better).otherwise(F.lit(0.0))
    met = met.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("base_gain"), F.sum(F.col("times") * gain).alias("gain"))
    joined = first.select("row", "rest", "l.n_tokens", "l.n_known", "l.base", "l.score").join(met, "row", "left")
    return unpacked(
        joined, kept,
        n_tokens=F.col("n_tokens"), n_known=F.col("n_known") + F.coalesce("known", F.lit(0)), train_tokens=F.lit(n_train).cast("long"),
        base_score=F.col("base") + F.coalesce("base_gain", F.lit(0.0)), score=F.col("score") + F.coalesce("gain", F.lit(0.0)),
    )


def op10_class_lm(spark, sf_dir: str) -> DataFrame:
    """Base and class-model log10 probabilities of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out().alias("held_out"))
    return score_texts(docs, docs.where(~F.col("held_out"))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
