"""Merkle manifest, spelling variants and balanced mix against plain Python on small and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from factorspark.llm import balanced_mix, merkle, spelling
from factorspark.llm.ranges import dense_positions

ODD = [
    (1, "src1", "en", 3, "a\nb"), (1, "src1", "en", 3, "a\nb"), (1, "src1", "de", 3, "other\n"), (None, "src1", None, None, None), (None, "src1", "x", 1, "y"),
    (64, "src1", "en", 0, ""), (63, "src1", "en", None, "\n\n"), (-5, "src1", "en", 1, "é×中"), (2**40, "src1", "en", 1, "far"), (7, None, "en", 1, "null source\n"),
    (8, "", "en", 1, "empty source"), (9, "", "en", 1, "z"), (10, "\U00010000", "en", 1, "astral"), (11, "src1", "en", 1, "x\n" * 50_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, a source of 300 rows, and extra columns whose names the operators use themselves."""
    rows = [*ODD, *((1000 + 7 * i, "hot", "en", i, f"text\n{i}") for i in range(300))]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int, size int")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha(*low[i:i + 3]) for i in range(0, len(low), 3)])
    return levels


def siblings(levels, at):
    for low in levels[:-1]:
        first = at - at % 3
        yield low[first:at], low[at + 1:first + 3]
        at //= 3


def merkle_rows(rows):
    by = defaultdict(list)
    for d, s, lang, n, text in rows:
        leaf = sha(*map(field, (d, s, lang, n, text)))
        tampered = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        by[s].append((d, leaf, sha(*map(field, (d, s, lang, n, text and text.replace("\n", "")))) if tampered else leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climbed([r[1] for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for s in order}
    upper = climbed([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for at, (d, leaf, node) in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
            proof = []
            for left, right in [*siblings(trees[s], at), *siblings(upper, k)]:
                node = sha(*left, node, *right)
                proof += left + right
            yield d, leaf, trees[s][-1][0], upper[-1][0], sha(*proof), node, node == upper[-1][0]


def test_merkle(odd):
    found = merkle.audited(odd)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [tuple(r) for r in odd.select(*merkle.FIELDS).collect()]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(merkle_rows(rows), key=str)


def test_merkle_of_one_row_and_of_none(spark, odd):
    one = odd.where("doc_id = 64")
    row = merkle.audited(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha()
    assert merkle.audited(odd.limit(0)).count() == 0


def test_places_are_dense(spark):
    values = [random.Random(2).randrange(40) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    out = dense_positions(df, [df["v"].desc()]).collect()
    assert sorted(r["position"] for r in out) == list(range(500))
    assert [r["v"] for r in sorted(out, key=lambda r: r["position"])] == sorted(values, reverse=True)


def spelled(rows):
    total = Counter()
    for d, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            total[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    others = {w: [u for u in n if near(w, u)] for w in n}
    form = {}
    for w in n:
        best = min(others[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(others[w]), n.get(form[w])


def test_spelling_variants(spark):
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(150)}
    words |= {w[:i] + c + w[i + 1:] for w in sorted(words)[:40] for i in range(3) for c in "ab"} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷" * 4, "A" * 3000, "A" * 3001, "A" * 1500 + "b" + "A" * 1500}
    words = sorted(words)
    weights = [9 ** rng.randrange(4) for _ in words]
    rows = [(i if i else None, " ".join(w for w in rng.choices(words, weights, k=400))) for i in range(40)]
    rows += [(50, " ".join(words * 3)), (50, " ".join(words * 3)), (51, None), (52, ""), (53, "Ärger ÄRGER straße_straße1straßen " * 30)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    found = spelling.variants(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = set(spelled(rows))
    assert set(map(tuple, found.collect())) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)
    assert spelling.variants(docs.limit(0)).count() == 0


def shares(size_of):
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:
        rest = [s for s in order if s not in full]
        level = (1.5 * sum(size_of.values()) - 2 * sum(size_of[s] for s in full)) / (sum(weight[s] for s in rest) or 1)
        above = {s for s in rest if weight[s] * level > 2 * size_of[s]}
        if not above:
            return {s: 2 * size_of[s] if s in full else weight[s] * level for s in order}
        full |= above


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(balanced_mix, "BLOCK", 40)  # several rounds of flights
    monkeypatch.setattr(balanced_mix, "JOINED", 4)
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "a", "", None]), " ".join(["w"] * int(rng.lognormvariate(3, 1)))) for i in range(1200)]
    rows += [(3, "hot", "same text")] * 30 + [(None, "hot", "x " * 5000), (None, None, None), (1300, "a", ""), (1301, "zero", None), (1302, "", "one"), (1303, "\U00010000", "tab\tand\x0bmore here")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, place string")
    out = balanced_mix.mixed(docs.repartition(5))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    found = sorted(map(tuple, out.collect()), key=str)
    assert found == sorted(map(tuple, balanced_mix.mixed(docs.repartition(2)).collect()), key=str)
    size_of = Counter()
    for _, s, t in rows:
        size_of[s] += len((t or "").encode().split())
    assert Counter((r[0], r[1]) for r in found) == Counter((d, len((t or "").encode().split())) for d, _, t in rows)
    want = shares(size_of)
    by_target = defaultdict(float)
    for _, size, whole, target, taken in found:
        assert any(size_of[s] == whole and target == pytest.approx(want[s]) for s in want)
        assert 0 <= taken <= 2 * size and (size == 0 or taken % size == 0)
        by_target[whole, target] += taken
    for (whole, target), taken in by_target.items():
        assert abs(taken - target) <= max(1, 0.01 * target), (whole, target, taken)
    assert sum(want.values()) == pytest.approx(1.5 * sum(size_of.values()))
    assert balanced_mix.mixed(docs.limit(0)).count() == 0
    assert {r["taken"] for r in balanced_mix.mixed(docs.where("size is null or text is null")).collect()} == {0}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 400):
        size, chance = rng.integers(0, 900, n), rng.random(n)
        moved = balanced_mix.fly(size, chance, rng)
        assert ((moved > 0) & (moved < 1)).sum() <= 2
        assert moved.sum() == pytest.approx(chance.sum(), abs=1e-5) and moved @ size == pytest.approx(chance @ size, abs=1e-2)


def test_flight_is_unbiased():
    size, chance = np.array([5, 9, 2, 7, 1, 3]), np.full(6, 0.3)
    mean = np.mean([balanced_mix.fly(size, chance, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.allclose(mean, chance, atol=0.03)


def test_sizes():
    texts = [b"", None, b" a", b"a b\n", b"\xc2\xa0 x\x0b\x0cy", b"word"]
    assert balanced_mix.sizes(texts).tolist() == [len((t or b"").split()) for t in texts]
    assert balanced_mix.sizes([]).tolist() == []
