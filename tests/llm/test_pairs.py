"""Near-duplicates, components, neighbours and the n-gram trie against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.llm import dedup, elias_fano, neighbours, ngram_lm
from factorspark.llm.components import connected


def shingles(text):
    ws = text.encode().lower().split() if text else []
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_components(rows):
    """Least id of each row's component, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [least.get(top(k)) for k in range(len(rows))]


def near_copies(seed, groups, copies, edits):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(rng.randrange(40, 160))]
        for _ in range(copies):
            ws = list(base)
            for _ in range(rng.randrange(edits)):
                ws[rng.randrange(len(ws))] = str(rng.random())
            out.append(" ".join(ws))
    rng.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("block", [4, 1024])
def test_near_dedup_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rows = [*near_copies(1, 6, 9, 12), (500, None), (501, ""), (502, " \n "), (503, "a b"), (504, "A  b"), (505, "a b c"), (None, "a b"), (504, "A  b"), (506, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, "k", b"") for i, t in rows], "doc_id long, text string, key string, node binary")
    out = dedup.components(docs).collect()
    want = Counter((i, len(shingles(t)), c if shingles(t) else i) for (i, t), c in zip(rows, brute_components(rows), strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in out)
    kept = dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in want if i is None or i == c}
    assert dedup.components(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rows = near_copies(2, 1, 150, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in dedup.components(docs).collect()}
    assert [out[i] for i, _ in rows] == brute_components(rows)


def test_pruning_keeps_what_may_reach_the_threshold():
    needed = dedup.needed_matches()
    rng = np.random.default_rng(4)
    match = rng.random((20_000, dedup.HASHES)) < 0.75
    left = np.zeros(match.shape, np.uint8)
    assert len(dedup._promising(left, np.where(match, 0, 1).astype(np.uint8), needed)) >= 0.999 * len(match)
    assert len(dedup._promising(left, np.where(rng.random(match.shape) < 0.2, 0, 1).astype(np.uint8), needed)) == 0


def test_connected(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(100, 140)]
    links = chain + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (7, 8), (8, 7)]
    up = {x: x for e in links for x in e}

    def top(k):
        return k if up[k] == k else top(up[k])

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    out = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert out == {x: top(x) for x in linked}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 12)).astype("float32")
    x[5:40] = x[3]  # copies, of a query too
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    bad = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 12, 0), (2003, [float("nan")] * 12, 0), (2004, [None] * 12, 0), (2005, [float("inf")] * 12, 0), (2006, [1.0], 0), (None, [1.0] * 12, 0)]
    table = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<double>, node long")
    out = {}
    for r in neighbours.nearest(table).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5].tolist()
        found = [v for _, v, _ in sorted(out[q])]
        assert [k for k, _, _ in sorted(out[q])] == [1, 2, 3, 4, 5] and q not in found
        assert all(abs(score - s[v]) < 1e-12 for _, v, score in out[q])
        hits += len(set(best) & set(found))
    assert hits >= 0.9 * 90 and sorted(out) == list(range(0, 900, 50))
    few = table.where("vec_id in (0, 50, 51)")
    assert {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(few).collect()} == {(0, 50), (0, 51), (50, 0), (50, 51)}
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_nearest_by_descent_from_small_blocks(spark, monkeypatch):
    """The blocks see 16 of 2400 vectors, half of them in one tight group: the rest is up to NN-descent and search, which settle or raise."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2400, 12))
    x[1200:] = x[0] + x[1200:] * 1e-2
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(table).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = [len(found[q] & set(np.argsort(np.where(np.arange(len(x)) == q, 9, -(unit @ unit[q])))[:5].tolist())) for q in range(0, len(x), 50)]
    assert neighbours.CODES * neighbours.BLOCK * 100 < len(x) and sum(hits) >= 0.95 * 5 * len(hits)
    units = neighbours.arrow_map(table.select("vec_id", "embedding"), neighbours._unit, "node long, unit binary").localCheckpoint()
    with pytest.raises(RuntimeError, match="not settled"):
        neighbours.graph(units, rounds=1)
    line = spark.createDataFrame([(i, i + 1, 0.5) for i in range(2399)], neighbours.EDGE)
    asked = units.where("node = 0")
    with pytest.raises(RuntimeError, match="not settled"):
        neighbours.search(line, units, asked.select("node", F.col("node").alias("other")), asked, rounds=2)


def test_elias_fano():
    rng = np.random.default_rng(9)
    for n, universe in ((0, 10), (1, 1), (5, 7), (3, 2**45), (1000, 50), (3000, 10**9), (20_000, 20_000)):
        values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        sequence = elias_fano.EliasFano.build(values, universe)
        assert (sequence.access(np.arange(n)) == values).all()
        values = np.unique(values)
        sequence = elias_fano.EliasFano.build(values, universe)
        asked = np.concatenate([values[::3], rng.integers(0, universe, 100).astype(np.uint64)])
        first, end = np.zeros(len(asked), np.int64), np.full(len(asked), len(values))
        at = np.searchsorted(values, asked)
        inside = at < len(values)
        want = np.where(inside & (values[np.minimum(at, max(0, len(values) - 1))] == asked if len(values) else False), at, -1)
        assert (sequence.find(asked, first, end) == want).all()
        assert (sequence.find(asked, end, end) == -1).all()


def test_mapped_files(tmp_path):
    arrays = {"a": np.arange(5, dtype=np.uint64), "b": np.empty(0, np.int64), "c": np.array([1, 2], np.uint16)}
    address = elias_fano.write_arrays(f"file://{tmp_path}/x", "part", arrays)
    found = elias_fano.map_arrays(address)
    assert all((found[k] == v).all() and found[k].dtype == v.dtype for k, v in arrays.items())


@pytest.mark.parametrize("shard", [1 << 21, 200])
def test_language_model(spark, shard, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    rng = random.Random(10)
    lines = [" ".join(rng.choice(("the", "The", "a", "of", "cat", "dog", "é", str(rng.randrange(40)))) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [*enumerate(lines), *enumerate(lines[:20], 200), (400, None), (401, ""), (402, "unseen words only"), (403, "x y " * 3000), (403, "x y " * 3000), (None, "the cat")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    texts = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    c1, c2, c3 = (Counter(g for t in train for g in zip(*(t[k:] for k in range(n)), strict=False)) for n in (1, 2, 3))
    total, distinct, d = sum(c1.values()), len(c1), ngram_lm.DISCOUNT
    r2, r3 = Counter(), Counter()
    for grams, rest, contexts in ((c2, r2, c1), (c3, r3, c2)):
        for g, n in grams.items():
            if n >= 2:
                rest[g[:-1]] += (n - d) / contexts[g[:-1]]

    def score(t):
        s = 0.0
        for j in range(len(t)):
            p = (c1[(t[j],)] + 0.1) / (total + 0.1 * (distinct + 1))
            if j > 0 and c1[(t[j - 1],)]:
                n, u = c2[tuple(t[j - 1:j + 1])], (t[j - 1],)
                p = ((n - d) / c1[u] if n >= 2 else 0) + max(1 - r2[u], 1e-9) * p
            if j > 1 and c2[tuple(t[j - 2:j])] >= 2:
                n, u = c3[tuple(t[j - 2:j + 1])], tuple(t[j - 2:j])
                p = ((n - d) / c2[u] if n >= 2 else 0) + max(1 - r3[u], 1e-9) * p
            s += math.log10(p)
        return s

    want = sorted((str(i), h, len(t), sum(c1[(w,)] > 0 for w in t), total, sum(math.log10((c1[(w,)] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), score(t)) for (i, _), h, t in zip(rows, held, texts, strict=True))
    found = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in ngram_lm.judged(docs).collect())
    for f, w in zip(found, want, strict=True):
        assert f[:5] == w[:5] and abs(f[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(f[6] - w[6]) <= 4e-4 * w[2], (f, w)
    assert ngram_lm.judged(docs.limit(0)).count() == 0
