"""Near-duplicates, line and span dedup, decontamination and top-k against brute force, with odd rows and hot groups."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from lumenframe.llm import decontaminate, line_dedup, near_dup, queries, span_dedup, topk
from lumenframe.operators.components import connected_components

SF = "/root/testdata/sf0.001"


def roots(nodes, edges):
    """Smallest member of each node's component."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(spark):
    """Words at random, with exact copies, near copies, shared lines, clashing columns and odd rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = "This line, of more than forty signs, stands in many documents."
    rows = []
    for i in range(60):
        text = "\n".join(say(rng.randint(3, 20)) + "." for _ in range(6))
        if i % 6 == 0:
            text = f"{text}\n  {line.upper() if i % 12 else line} \t"
        rows.append((i, text))
    rows += [(100 + i, rows[7][1]) for i in range(20)]
    words = rows[8][1].split(" ")
    for i in range(20):
        near = list(words)
        near[rng.randrange(len(near))] = rng.choice(vocabulary)
        rows.append((200 + i, " ".join(near)))
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "one"), (303, "one"), (None, line), (304, rows[3][1].upper()), (305, say(30_000))]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, r1 long, dropped string, fp long")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).cache()


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = near_dup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in out) == Counter((i, plain_fingerprint(t)) for i, t in rows)
    prints = sorted({r["fp"] for r in out})
    close = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    top = roots(prints, close)
    least = {}
    for r in out:
        if r["doc_id"] is not None:
            least[top[r["fp"]]] = min(least.get(top[r["fp"]], r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(top[r["fp"]]) for r in out)


def test_tally_of_lists_tells_the_shared_bytes():
    fours = [set(x) for x in near_dup.FOURS]
    assert len(fours) == 14 and len(near_dup.SIXES) == 28
    for n, counts in ((8, {14}), (7, {7}), (6, {near_dup.LEAST}), (5, {1}), (4, {0, 1}), (3, {0})):
        for shared in combinations(range(8), n):
            assert sum(x <= set(shared) for x in fours) in counts


@pytest.mark.parametrize("size", [3, 700, 5000])
def test_links_lose_no_pair(spark, size):
    rng = random.Random(size)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(size // 5 + 1)} | {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    signed = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    found = [(r["a"], r["b"]) for r in near_dup.links(df).collect()]
    assert len(found) < 28 * len(signed)
    near = [(int(a), int(b)) for a in signed for b in signed[np.bitwise_count((signed ^ a).view(np.uint64)) <= 2] if a < b]
    assert all((a ^ b) & (1 << 64) - 1 and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found)
    assert roots(signed.tolist(), found) == roots(signed.tolist(), near)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (7, 7), (None, 3)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r["node"]: r["root"] for r in out}
    assert len({label[i] for i in range(201)}) == 1 and len({label[i] for i in range(1000, 1400)}) == 1 and len(set(label.values())) == 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_representatives_keep_one_of_each_group(spark, docs):
    classes = {(r["doc_id"], r["fp"]): r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    kept = near_dup.representatives(docs).collect()
    assert len(kept) == len(set(classes.values()))


def plain_lines(rows):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if len(k) >= 40 and i is not None:
                holders[k].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x, k in zip(lines, keys(t), strict=True) if len(k) < 40 or len(holders[k]) < 5 or i == max(holders[k])]
        out[(i, len(lines), len(lines) - len(keep), "\n".join(keep))] += 1
    return out


def test_line_dedup(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out) == plain_lines(rows)
    assert sum(r["n_dropped"] for r in out) > 5
    empty = docs.where("1 = 0")
    assert line_dedup.apply_bitmaps(empty, line_dedup.drop_bitmaps(empty)).collect() == []


def test_first_occurrences_are_streamed_off_sorted_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), 0, rng.randrange(30) or None, i) for i in range(2000)]
    found = line_dedup.first_occurrences(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long, pos int"))
    assert Counter(tuple(r) for r in found.collect()) == Counter({r[:3] for r in rows})
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    shape = [x for x in re.findall(r"Window|Sort|rangepartitioning|hashpartitioning", plan)]
    assert "rangepartitioning" in shape and "hashpartitioning" not in shape and shape.index("Window") < shape.index("Sort") < shape.index("rangepartitioning")


def test_line_dedup_of_many_lines(spark):
    shared = [f"a shared line with a number and more than forty signs {i}" for i in range(200)]
    rows = [(i, "\n".join([f"own {i} {k}" if (k + i) % 3 else shared[k] for k in range(200)])) for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.apply_bitmaps(df, line_dedup.drop_bitmaps(df)).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out) == plain_lines(rows)


def shingle_bag(text, n=5):
    words = (text or "").lower().split()
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def plain_leaks(docs, items):
    out = {}
    for i, t in docs:
        have = shingle_bag(t)
        for j, u in items:
            want = shingle_bag(u)
            if not want or not have or not set(want) & set(have):
                continue
            w, goal = min(len(want), len(have)), Counter(want)
            for s in range(len(have) - w + 1):
                x = sum((Counter(have[s : s + w]) & goal).values())
                score = x / (len(want) + w - x)
                if score >= 0.8 and score > out.get((i, j), (0, 0))[0]:
                    out[(i, j)] = (score, s)
    return out


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([12, 25, 60])))) for i in range(12)] + [(20, None), (21, ""), (22, "only three words"), (23, "again and again " * 12)]
    docs = []
    for i in range(40):
        text = say(120)
        if i % 2:
            j = i % 12
            passage = items[j][1].split()
            if i % 4 == 1 and len(passage) > 40:
                passage[0], passage[-1] = "x", "y"
            if i % 8 == 3:
                passage.insert(len(passage) // 2, "extra")
            text[50:50] = passage * (1 + i % 3)
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    docs += [(50, None), (51, ""), (52, "only three words"), (53, "again and again " * 30), (54, "w1"), (None, items[2][1]), (55, items[1][1]), (55, items[1][1])]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id long, similarity long")
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    out = {(r["doc_id"], r["item_id"]): (r["similarity"], r["window_start"]) for r in decontaminate.contaminated(d, b).collect()}
    assert out == plain_leaks(docs, items)
    assert decontaminate.contaminated(d.where("1 = 0"), b).collect() == [] and decontaminate.contaminated(d, b.where("1 = 0")).collect() == []


def test_decontamination_of_long_repetitive_text(spark):
    docs = [(1, "again and " * 6000), (2, "again and more " * 40)]
    items = [(1, "again and " * 700), (2, "nothing of the kind is in here at all")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contaminated(d, b).collect()] == [(1, 1, 0, 1.0)]


def test_windows_within_the_radius_are_found(spark):
    """Recall of the blocks: windows that hold an item with words changed, against all fingerprints within the radius."""
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(40))) for i in range(30)]
    docs = []
    for i in range(120):
        words = items[i % 30][1].split()
        words[rng.choice((0, 1, 2, 37, 38, 39))] = "other"
        docs.append((i, " ".join(words)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert out == {(i, i % 30) for i in range(120)} & set(plain_leaks(docs, items)) and len(out) > 100


def test_span_dedup(spark, docs):
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    places = defaultdict(list)
    for i, t in rows:
        for a, e, h in span_dedup.runs(t):
            places[h].append((i is not None, i or 0, a, e, t))
    gone = defaultdict(set)
    for spots in places.values():
        for spot in sorted(spots)[1:]:
            gone[(spot[1] if spot[0] else None, spot[4])].update(range(spot[2], spot[3]))
    assert any(e > 1 for d in gone.values() for e in d)
    found = span_dedup.removals(docs)
    texts = span_dedup.remove(docs, found).select("doc_id", "text", "kept_text").collect()
    assert {r["doc_id"]: r["n_removed"] for r in found.collect()} == {k[0]: len(v) for k, v in gone.items()}
    for r in texts:
        text, drop = r["text"] or "", gone.get((r["doc_id"], r["text"]), set())
        cut = span_dedup.sentences(text)
        ends = [*(s for s, _, _ in cut[1:]), len(text)][: len(cut)]
        left = "".join(text[s:e] for i, ((s, _, _), e) in enumerate(zip(cut, ends, strict=True)) if i not in drop)
        assert r["kept_text"] == (text[: cut[0][0]] if cut else text) + left
    assert span_dedup.removals(docs.where("1 = 0")).collect() == []


def test_span_dedup_catches_passages_of_fifty_words(spark):
    rng = random.Random(9)
    say = lambda n, tag: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    passage = " ".join(say(n, "p").capitalize() + "." for n in (12, 9, 20, 11))
    rows = [(i, f"{say(30, f'a{i}')}. {passage if i % 5 == 0 else ''} {say(30, f'b{i}')}.") for i in range(20)]
    out = {r["doc_id"]: r for r in span_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(out) == [5, 10, 15] and all(r["first_doc_ids"] == [0] for r in out.values())


def test_span_dedup_leaves_short_boilerplate_alone(spark):
    rng = random.Random(11)
    say = lambda n, tag: " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{say(30, f'a{i}')}.\nAll rights are reserved. Use at your own risk. Released under a free license.\n{say(30, f'b{i}')}.") for i in range(8)]
    assert span_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [2048, 3])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] + [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2100, [1.0, 2.0]), (2101, [1.0, 3.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = topk.quantized(df)
    out = topk.exact_topk(vectors, vectors.where("vec_id % 50 = 0")).collect()
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)}
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    assert topk.exact_topk(vectors.where("1 = 0"), vectors.where("1 = 0")).collect() == []


def test_topk_of_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1e15, 1e15]), (4, [0.5, 0.25]), (5, [3e3, 1.0])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = [tuple(r) for r in topk.exact_topk(vectors, vectors.where("vec_id in (0, 4)")).orderBy("query_id", "rank").collect()]
    top = (1 << 62) - 1
    whole = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows}
    want = []
    for q in (0, 4):
        scored = sorted((-max(-top, min(top, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert out == want


TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    out = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in out.description]
    place = [df.columns.index(c) for c in names]
    got = sorted(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in place) for r in df.collect())
    assert got == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in out.fetchall())


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline
    from lumenframe.llm import byte_bpe, language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    model = language_id.train(docs.where(~language_id.held_out()))
    rows = [(r["doc_id"], r["text"]) for r in language_id.predict(docs, model).where("lang_pred <> 'und' and score >= 0.5").collect()]
    rows = [(i, t) for i, _, _, t in plain_lines(rows)]
    sets = {i: plain_shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 1.25 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]))]
    top = roots(list(sets), near)
    rows = [(i, t) for i, t in rows if top[i] == i]
    leaks = {i for i, _ in plain_leaks(rows, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    rows = [(i, t) for i, t in rows if i not in leaks]
    tokens = pytest.importorskip("public_tokenizers")
    assert set(out) == {i for i, _ in rows}
    for i, t in rows:
        ids = byte_bpe.encode(t, tokens.path("byte_bpe_50k.tiktoken"), tokens.PATTERN)
        assert out[i]["n_tokens"] == len(ids) and out[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    import corpus_pipeline

    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "the cat sat on the mat", "en", "a", 22), (3, "the cat sat on the mat", "en", "a", 22), (4, "le chat est sur la table", "fr", "b", 24)]
    docs = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, r1 long, rest string")
    for frame, left in ((docs, 2), (docs.where("1 = 0"), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns
            frame = spark.createDataFrame(out.collect(), docs.schema)
        assert frame.count() == left
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == left


def plain_shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def test_pipeline_drops_near_copies(spark, docs):
    import corpus_pipeline

    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] != 303]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 100, 300]))]
        for c in range(12):
            words = list(base)
            for _ in range(c % 6):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((1000 + 20 * g + c, " ".join(words + [rng.choice(vocabulary) for _ in range(c % 3 * 4)])))
    sets = {i: plain_shingles(t) for i, t in rows}
    close = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 1.25 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]))]
    top = roots(list(sets), close)
    frame = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.keep_one(spark, frame, SF).collect()} == set(top.values())


def test_pipeline_finds_large_groups_of_near_copies(spark):
    """Groups whose lists are not enumerated: recall of the links against all pairs, with and without the text that was copied."""
    import corpus_pipeline

    rng = random.Random(33)
    rows = []
    for g in range(4):
        base = [f"g{g}w{rng.randrange(3000)}" for _ in range(200)]
        for c in range(150):
            words = list(base)
            for _ in range(c % 5 + (g % 2)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * g + c, " ".join(words)))
    sets = {i: plain_shingles(t) for i, t in rows}
    close = [(a, b) for a in sets for b in sets if a < b and a // 1000 == b // 1000 and (sets[a] == sets[b] or 1.25 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]))]
    top = roots(list(sets), close)
    frame = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one(spark, frame, SF).collect()}
    assert set(top.values()) <= kept
    assert len(rows) - len(kept) >= 0.9 * (len(rows) - len(set(top.values())))


def test_pipeline_loses_no_link_in_long_lists(spark):
    """Texts made of passages that many share: their pairs meet in long lists only."""
    import corpus_pipeline

    rng = random.Random(5)
    passages = [" ".join(f"p{p}w{i}" for i in range(60)) for p in range(14)]
    rows = [(i, " ".join(passages[p] for p in sorted(rng.sample(range(14), 10)))) for i in range(90)]
    sets = {i: plain_shingles(t) for i, t in rows}
    close = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 1.25 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]))]
    left = set(roots(list(sets), close).values())
    assert 10 < len(left) < 80
    frame = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.keep_one(spark, frame, SF).collect()} == left


def test_components_that_long_lists_leave_apart_are_compared(spark):
    """All pairs of two components in a list: none lost in cells, few of each two components if told so, and none within a component."""
    from lumenframe.llm import near_copies

    rng = np.random.default_rng(4)
    base = rng.integers(1 << 63, size=200, dtype=np.uint64)
    sets = [np.unique(np.r_[base[i % 20 :], rng.integers(1 << 63, size=i % 7 * 8, dtype=np.uint64)]) for i in range(1300)]
    root = [-1 if i < 600 else i // 2 for i in range(1300)]
    nodes = spark.createDataFrame([(i, len(x), near_copies.sketch(x)) for i, x in enumerate(sets)], "k long, n int, sketch binary")
    crowded = spark.createDataFrame([(h, i) for h in range(2) for i in range(1300) if h < 1 or i > 590], "h long, k long")
    labels = spark.createDataFrame([(i, r) for i, r in enumerate(root)], "node long, root long")
    all_, some = ([tuple(r) for r in near_copies.across(crowded, labels, nodes, 0.8, most).collect()] for most in (None, 2))
    assert len(set(all_)) == len(all_) and all(a < b and root[a] != root[b] and not cut for a, b, cut in all_)
    found = {(a, b) for a, b, _ in all_}
    for a in range(0, 1300, 13):
        for b in range(a + 1, 1300):
            same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if root[a] != root[b] and same >= 0.8 * (len(sets[a]) + len(sets[b]) - same):
                assert (a, b) in found
    assert {(a, b) for a, b, _ in some} < found and any(cut for *_, cut in some) and {(root[a], root[b]) for a, b, _ in some} == {(root[a], root[b]) for a, b in found}


def test_sketches_and_tables_reject_no_pair_and_no_text(spark):
    from lumenframe.llm import near_copies

    rng = np.random.default_rng(6)
    pairs, sets, near = [], [], []
    for i in range(300):
        a = rng.integers(1 << 63, size=rng.integers(1, 400), dtype=np.uint64)
        b = np.unique(np.r_[a[: max(1, int(len(a) * rng.uniform(0.5, 1)))], rng.integers(1 << 63, size=rng.integers(0, 1 + len(a) // 4), dtype=np.uint64)])
        sets += [np.unique(a), b]
        same = len(np.intersect1d(*sets[-2:], assume_unique=True))
        pairs.append((2 * i, 2 * i + 1))
        near.append(same >= 0.8 * (len(sets[-1]) + len(sets[-2]) - same))
    nodes = spark.createDataFrame([(i, len(x), near_copies.sketch(x)) for i, x in enumerate(sets)], "k long, n int, sketch binary")
    left = {tuple(r) for r in near_copies.allowed(spark.createDataFrame(pairs, "a long, b long"), nodes).collect()}
    assert {p for p, n in zip(pairs, near, strict=True) if n} <= left and len(left) < 1.3 * sum(near)
    r = rng.integers(-(1 << 63), (1 << 63) - 1, size=5000)
    table = near_copies._table(spark.createDataFrame([(int(x),) for x in r], "r long"))
    place = r.view(np.uint64) & np.uint64(64 * len(table) - 1)
    assert ((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).all()
    assert sum(int(x).bit_count() for x in table) <= 5000 <= 64 * len(table) // 12
