"""Rule ledger, classifier, byte BPE and packing against plain Python on small and odd inputs."""

import bisect
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factorspark.llm import bpe, byte_cnn, packing, quality_rules
from factorspark.llm.queries import tokenizer_file

ODD = [
    (1, "a b c d e f g h i j k"), (2, None), (3, ""), (4, "one two"), (4, "one two"), (5, "x " * 3000), (6, "a b c d e\na b c d e\nz"), (None, "no id at all"),
    (7, "It's  'quoted' \t\n text, isn't it? 's 'll've  "), (8, "é ü — ½²٣ 中文 \u200b\u3000 x"), (9, "# $ % & | < > ! " * 9), (10, " \n\t\r\x0b\x0c "), (11, "A" * 5000),
    (12, "<|endoftext|> \0 b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, i, "x", 1) for i, t in ODD], "doc_id long, text string, row long, fail_bits string, length int")


def words(text):
    return text.encode().split() if text else []


def repeated(ws):
    runs = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    often = Counter(runs)
    return len({j for i, r in enumerate(runs) if often[r] > 1 for j in range(i, i + 5)})


def dup_lines(text):
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            n += line in seen
            seen.add(line)
    return n


def test_rule_measures(odd):
    found = sorted(map(tuple, quality_rules.judged(odd).select("doc_id", *quality_rules.MEASURES[:5], "base_failed").collect()), key=str)
    want = []
    for i, t in ODD:
        ws = words(t)
        n, rep = len(ws), repeated(ws)
        want.append((i, n, sum(len(w.decode()) for w in ws), sum((t or "").count(c) for c in "#*$%&|<>"), dup_lines(t), rep, n < 10 or 100 * rep > 20 * n))
    assert found == sorted(want, key=str)


def test_repeated_words_at_random():
    rng = random.Random(3)
    for _ in range(300):
        ws = [bytes([97 + rng.randrange(rng.choice((2, 6)))]) for _ in range(rng.randrange(60))]
        assert quality_rules.repeated_words(ws) == repeated(ws)


def test_policies_and_ablations(odd):
    rows = quality_rules.ledger(quality_rules.measured(odd)).cache()
    bits = [r["fail_bits"] for r in rows.collect()]
    names = {r.name: 1 << r.bit for r in quality_rules.RULES}
    for r in quality_rules.ablations(rows).collect():
        mask, bit = sum(names[n] for n in quality_rules.POLICIES[r["policy"]]), names[r["rule"]]
        assert r["failed"] == sum(b & bit > 0 for b in bits)
        assert r["failed_alone"] == sum(b & mask == bit for b in bits)
        assert r["kept"] == sum(b & mask == 0 for b in bits)
        assert r["kept_without_rule"] == sum(b & mask & ~bit == 0 for b in bits)
    kept = quality_rules.filtered(odd)
    assert kept.columns == odd.columns
    assert kept.count() == quality_rules.judged(odd).where("kept").count()
    assert quality_rules.judged(odd.limit(0)).count() == quality_rules.filtered(odd.limit(0)).count() == 0


def test_classifier_learns_and_covers_the_whole_text(spark):
    rng = random.Random(5)

    def text(good, n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("" if good else "%%%") for _ in range(n))

    rows = [(i, text(i % 3 > 0, rng.randrange(20, 200))) for i in range(240)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 200_000), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in byte_cnn.judged(docs, labels).collect()}
    assert len(out) == 244
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows) and out[None]["held_out"] is False
    held = [i for i, _ in rows if out[i]["held_out"]]
    assert sum(out[i]["predicted"] == (i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    net = byte_cnn.fitted(docs, labels)
    plain, late = text(True, 4000).encode(), (text(True, 4000) + text(False, 40)).encode()
    assert byte_cnn.scores(net, [late])[0] < byte_cnn.scores(net, [plain])[0]
    one = byte_cnn.scores(net, [t.encode() for _, t in rows[:20]])
    assert np.allclose(one, [byte_cnn.scores(net, [t.encode()])[0] for _, t in rows[:20]])
    assert byte_cnn.fitted(docs, labels.limit(0)).constant == 0.5
    with pytest.warns(UserWarning, match="keeps every document"):
        assert byte_cnn.filtered(docs, byte_cnn.fitted(docs, labels.where("quality = 0"))).count() == docs.count()
    assert byte_cnn.filtered(docs, net).columns == docs.columns and byte_cnn.scored(docs.limit(0), net).count() == 0


def test_classifier_sample_and_share(spark, monkeypatch):
    """Labels without a document do not count; the share is that of the judged documents where they have both classes."""
    seen = []
    monkeypatch.setattr(byte_cnn, "train", lambda texts, labels, share: seen.append((sorted(labels), share)))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20 and i % 2)) for i in range(600)], "doc_id long, quality int")
    byte_cnn.fitted(docs, labels, per_class=10)
    byte_cnn.fitted(docs, labels, per_class=3, judged=docs.where("doc_id < 3"))
    byte_cnn.fitted(docs, labels, per_class=3, judged=docs.where("doc_id % 2 = 1"))
    monkeypatch.setattr(byte_cnn, "SAMPLE_BYTES", 30)
    byte_cnn.fitted(docs, labels, per_class=10)
    assert seen[:3] == [([0] * 10 + [1] * 10, 0.5), ([0] * 3 + [1] * 3, 1 / 3), ([0] * 3 + [1] * 3, 0.5)]
    assert len(seen[3][0]) == 4


def convolved(net, text):
    """The score by plain loops over every window of every chunk of the padded text."""
    codes = byte_cnn.halves(text).ravel()
    x = net.embed[np.concatenate([codes, np.zeros(byte_cnn.WIDTH, int)])]
    windows = [x[i:i + byte_cnn.WIDTH].ravel() @ net.kernel + net.bias for i in range(0, len(codes), byte_cnn.STRIDE)]
    steps = byte_cnn.HALF // byte_cnn.STRIDE
    starts = range(0, max(1, len(windows) - steps), steps)
    features = np.array([np.maximum(np.max(windows[i:i + 2 * steps], axis=0), 0) for i in starts])
    return 1 / (1 + np.exp(-(np.concatenate([features.mean(0), features.max(0)]) @ net.combine + net.offset + net.shift)))


def test_classifier_forward_pass_is_a_plain_convolution():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (0, 1, 5, 255, 256, 257, 511, 512, 513, 3000)]
    net = byte_cnn.train(texts, [0, 1] * 5, 0.4, epochs=2)
    assert np.allclose(byte_cnn.scores(net, texts), [convolved(net, t) for t in texts], atol=1e-5)


def test_classifier_gradients():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, n).tolist()) for n in (700, 90, 1500)]
    net = byte_cnn.train(texts, [0, 1, 1], 0.5, epochs=1)
    data = [(byte_cnn.halves(t), byte_cnn._following(byte_cnn.halves(t))) for t in texts]
    y, w, offset = np.array([0.0, 1, 1]), np.ones(3), np.zeros(1)

    def loss():
        p = []
        for t in texts:
            f = byte_cnn.chunked(byte_cnn._pooled(net, byte_cnn.halves(t), byte_cnn._following(byte_cnn.halves(t)))).astype(float)
            p.append(1 / (1 + np.exp(-(np.concatenate([f.mean(0), f.max(0)]) @ net.combine))))
        p = np.array(p)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + 5e-5 * (net.combine**2).sum()

    grads = byte_cnn._gradients(net, offset, data, y, w)
    for k, step in ((3, 1e-4), (1, 3e-3)):
        p = (net.embed, net.kernel, net.bias, net.combine)[k]
        at = np.unravel_index(np.abs(grads[k]).argmax(), p.shape)
        old = p[at]
        values = []
        for s in (step, -step):
            p[at] = old + s
            net.__post_init__()
            values.append(loss())
        p[at] = old
        net.__post_init__()
        assert abs((values[0] - values[1]) / (2 * step) - grads[k][at]) < 0.1 * abs(grads[k][at]) + 1e-5


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(tokenizer_file("byte_bpe_50k.tiktoken"))


def test_classifier_learns_from_whole_texts(monkeypatch):
    """Every half of a training text is learned from, as scoring reads it, in slices of any length."""
    seen, gradients = [], byte_cnn._gradients
    monkeypatch.setattr(byte_cnn, "_gradients", lambda net, offset, batch, y, weight: seen.extend(batch) or gradients(net, offset, batch, y, weight))
    texts = [bytes(np.random.default_rng(i).integers(97, 110, n).tolist()) for i, n in enumerate((30_000, 90))]
    nets = []
    for length in (256, 7):
        monkeypatch.setattr(byte_cnn, "TRAINING_SLICE", length, raising=False)
        nets.append(byte_cnn.train(texts, [0, 1], 0.5, epochs=1))
    assert sorted(len(codes) for codes, _ in seen) == [1, 1, 118, 118]
    assert np.allclose(nets[0].kernel, nets[1].kernel, atol=1e-4) and np.allclose(nets[0].embed, nets[1].embed, atol=1e-4)


def test_byte_bpe_equals_the_library(coder):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(7)
    texts = [t or "" for _, t in ODD] + ["'s", "a's''s 's\n's's", "'ll've'r'", " \n a \n\nb  ", "x" * 3000, " " * 900 + "a", "!" * 500 + "'s", "'re\r\n\r\n", "\u3000\u3000a"]
    texts += ["".join(rng.choice("'stmdrevl aA1½ \n\t\u3000!.\0é中") for _ in range(rng.randrange(50))) for _ in range(400)]
    ids, ends = coder.encode(texts)
    at = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[at:end].tolist() == library.encode_ordinary(text), text[:60]
        assert coder.decode(ids[at:end]) == text.encode()
        offsets = coder.offsets(ids[at:end])
        assert offsets[-1] == len(text.encode()) and text.encode()[:offsets[len(offsets) // 2]] == coder.decode(ids[at:end][:len(offsets) // 2])
        at = end


def test_scan_is_the_automaton():
    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 5000):
        symbols = rng.integers(0, 10, n)
        state, want = bpe.START, []
        for s in symbols:
            state = bpe._step(state, int(s))
            want.append(state)
        assert bpe.STATE[bpe.scan(bpe.ELEMENT[symbols])].tolist() == want


def test_byte_bpe_rows(odd, coder):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    rows = bpe.digests(odd, path).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        texts = [t or "" for i, t in ODD if i == r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(texts[0].encode()).hexdigest()
        ids, _ = coder.encode(texts[:1])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    tokens = bpe.encoded(odd, path)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decoded(tokens, path).collect()}
    assert back == {i: (t or "").encode() for i, t in ODD}
    assert bpe.digests(odd.limit(0), path).count() == 0


def best_fit_decreasing(items, capacity):
    left = []
    for size in sorted(items, reverse=True):
        at = bisect.bisect_left(left, size)
        rest = capacity - size if at == len(left) else left.pop(at) - size
        bisect.insort(left, rest)
    return len(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(11)
    for _ in range(150):
        capacity = rng.choice((7, 50, 2048))
        items = [rng.randint(1, capacity) if rng.random() < 0.7 else max(1, capacity // 3) for _ in range(rng.choice((0, 1, 9, 300)))]
        bins = {}
        for run in packing.plan(Counter(items), capacity):
            for k in range(run.last_rank - run.first_rank + 1):
                bins.setdefault(run.first_bin + k // run.per_bin, []).append((run.offset + k % run.per_bin * run.length, run.length))
        assert sum(map(len, bins.values())) == len(items) and len(bins) == best_fit_decreasing(items, capacity)
        for spots in bins.values():
            at = 0
            for offset, length in sorted(spots):
                assert offset == at
                at += length
            assert at <= capacity


def test_tightest_fit():
    tree, open_ = packing.TightestFit(50), set()
    rng = random.Random(13)
    for _ in range(2000):
        c = rng.randrange(51)
        tree.set(c, c not in open_)
        open_ ^= {c}
        need = rng.randrange(51)
        assert tree.find(need) == min((o for o in open_ if o >= need), default=None)


def test_packing_rows(odd):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.packed(odd, path, capacity=512).collect()
    want = []
    for i, t in ODD:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, at, len(ids[at:at + 512]), zlib.crc32(np.array(ids[at:at + 512], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 512))]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in bins.values():
        assert sum(n for _, n in spots) <= 512
        assert [o for o, _ in sorted(spots)] == np.cumsum([0, *(n for _, n in sorted(spots))])[:-1].tolist()
    assert len(bins) == best_fit_decreasing([r["length"] for r in rows], 512)
    assert packing.packed(odd.limit(0), path).count() == 0


def test_word_cache_turns_over(monkeypatch):
    """With a cache of a few words the ids stay those of the untouched tokenizer, marks of special tokens included."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_WORDS", 8)
    path = tokenizer_file("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>", "The the THE, the. The, Straße don't 12th \x1c \u00a0z", "one two three four five six seven eight nine ten", "", None, "the a ten, One. <|endoftext|>"]
    for _ in range(3):
        found = [list(np.frombuffer(ids, "<u4")) for ids in words.batch([t.encode() if t is not None else None for t in texts])]
        assert found == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(words.before) <= 60
