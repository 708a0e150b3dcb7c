"""Language-model scoring with an Elias-Fano n-gram trie.

Training makes, in shards by the hash of a context's first word:
* the vocabulary, sorted by hash: a word's number is its place, so numbers are spread evenly;
* level 2: for each word, its following words; level 3: for each kept pair, the words after it. A level holds monotone pointers
  (where each context's words start) and the words as monotone values relative to their context, both as Elias-Fano
  sequences, and quantised log probabilities. Shards are files in the shared folder that workers map into memory.

Probabilities interpolate absolutely discounted counts with the next lower order, down to (c + 0.1) / (N + 0.1 (V + 1)).
Pairs and triples seen once are pruned; their mass goes to the lower order. Look-ups are vectorised successor searches within
the context's range, for the distinct pairs of some hundred thousand tokens at a time.

The number of shards follows the number of training tokens, so shards, counts and files grow with the input and no task
holds more than a shard. A word or pair of any share is combined within each task before it is sent.

Defined cases: a null or empty text is the end token alone. Words unknown in training have count 0. Rows that repeat are scored each by
itself. A null id is learned from. Without training rows N = V = 0 and every token has probability 1. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, durable, remainder, scratch_path, text_bytes
from .elias_fano import EliasFano, map_arrays, write_arrays

#: The end of a text; no word holds white space.
END = b"\n"
SMOOTH = 0.1
DISCOUNT = 0.75
#: Pairs and triples seen less often are pruned.
LEAST = 2
#: Training tokens of a shard, and distinct n-grams counted at once in a task.
SHARD_TOKENS = 1 << 21
COUNTED = 1 << 22
#: Log10 probabilities are stored in steps of 1 / 4096, down to -16.
STEP = 4096.0
_U = np.uint64


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(np.maximum(p, 1e-15)) * STEP), 65535).astype(np.uint16)


_PROBABILITY = 10.0 ** (np.arange(65536) / -STEP)


def probability(q: np.ndarray) -> np.ndarray:
    return _PROBABILITY[q]


def words_of(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END]


def held_out() -> Column:
    """The tenth of the ids that is not learned from."""
    return F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in chunks(batches):
        for text in text_bytes(batch):
            counts.update(words_of(text))
        if len(counts) > COUNTED // 8:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all whole texts, A-Z in lower case, with the end token of each."""
    return arrow_map(texts.select("text"), _count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Sizes and the addresses of each shard's files: vocabulary, level 2, level 3."""

    tokens: int
    distinct: int
    bits: int
    first: tuple[int, ...]
    vocabulary: tuple[str, ...]
    pairs: tuple[str, ...] = ()
    triples: tuple[str, ...] = ()

    @property
    def floor(self) -> float:
        """Log10 probability of a word never seen, by the base formula."""
        return float(np.log10(SMOOTH / (self.tokens + SMOOTH * (self.distinct + 1))))

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each hash of a sorted array; ``distinct`` and 0 for words not seen."""
        number = np.full(len(hashes), self.distinct, np.int64)
        count = np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(self.shard_of(hashes), np.arange(len(self.vocabulary) + 1))
        for shard, (lo, hi) in enumerate(pairwise(cuts.tolist())):
            if lo < hi:
                arrays = map_arrays(self.vocabulary[shard])
                known = arrays["hash"]
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes[lo:hi]), len(known) - 1)
                    same = known[at] == hashes[lo:hi]
                    number[lo:hi][same] = at[same] + self.first[shard]
                    count[lo:hi][same] = arrays["count"][at[same]]
        return number, count


def _manifest(rows: DataFrame) -> dict[int, tuple[int, str]]:
    """One row for each shard."""
    return {r["shard"]: (r["n"], r["path"]) for r in rows.collect()}


MANIFEST = "shard int, n long, path string"


def _listed(shard: int, n: int, path: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([path])], ["shard", "n", "path"])


def vocabulary(counts: DataFrame, folder: str) -> Model:
    """Write the vocabulary's shards: hashes in order and counts."""
    from xxhash import xxh3_64_intdigest

    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    bits = max(0, (int(totals["tokens"]) // SHARD_TOKENS).bit_length())
    model = Model(int(totals["tokens"]), int(totals["distinct"]), bits, (), ())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.fromiter(map(xxh3_64_intdigest, batch.column(0).to_pylist()), _U, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(model.shard_of(h), pa.int32()), pa.array(h.view(np.int64)), batch.column(1)], ["shard", "hash", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        shard, h, n = (np.concatenate([b.column(i).to_numpy() for b in found]) for i in range(3))
        order = np.lexsort((h.view(_U), shard))
        shard, h, n = shard[order], h.view(_U)[order], n[order]
        for s in np.unique(shard):
            own = shard == s
            yield _listed(s, int(own.sum()), write_arrays(folder, f"words-{s}", {"hash": h[own], "count": n[own]}))

    rows = arrow_map(counts.select("word", "n"), hashed, "shard int, hash long, n long").repartition(1 << bits, "shard")
    listed = _manifest(durable(arrow_map(rows, write, MANIFEST), "lm-words"))
    empty = write_arrays(folder, "words", {"hash": np.empty(0, _U), "count": np.empty(0, np.int64)}) if len(listed) < 1 << bits else ""
    sizes = [listed.get(s, (0, ""))[0] for s in range(1 << bits)]
    first = tuple(np.concatenate(([0], np.cumsum(sizes))).tolist())
    return Model(model.tokens, sum(sizes), bits, first, tuple(listed.get(s, (0, empty))[1] for s in range(1 << bits)))


def numbered(docs: DataFrame, model: Model) -> DataFrame:
    """Per text of ``doc_id, text, learned``: the numbers of its tokens, and its base score."""
    from xxhash import xxh3_64_intdigest

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.log10(model.tokens + SMOOTH * (model.distinct + 1))
        for batch in chunks(batches, limit=2 << 20):
            texts = [words_of(t) for t in text_bytes(batch)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            h = np.fromiter((xxh3_64_intdigest(w) for t in texts for w in t), _U, int(sizes.sum()))
            distinct, inverse = np.unique(h, return_inverse=True)
            number, count = model.numbers(distinct)
            ids = number[inverse].astype("<u4")
            starts = np.concatenate(([0], np.cumsum(sizes)))
            base = np.add.reduceat((np.log10(count + SMOOTH) - scale)[inverse], starts[:-1])
            known = np.add.reduceat((count > 0)[inverse].astype(np.int64), starts[:-1])
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes), pa.array(known), pa.array(base),
                pa.array([raw[4 * a:4 * b] for a, b in pairwise(starts.tolist())], pa.binary())], ["doc_id", "learned", "n_tokens", "n_known", "base_score", "ids"])

    return arrow_map(docs.select("doc_id", "text", "learned"), run, f"doc_id {kind}, learned boolean, n_tokens long, n_known long, base_score double, ids binary")


def _tokens(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a batch, and for each token its place in its text."""
    raw = batch.column(column).to_pylist()
    ids = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    starts = np.cumsum(sizes) - sizes
    return ids, np.arange(len(ids)) - np.repeat(starts, sizes)


class Blobs:
    """Counts of 64-bit keys within a task, sent as one row of sorted keys and counts for each shard."""

    SCHEMA = "shard int, keys binary, counts binary"

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, shard: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((shard.astype(np.int32), key))
        self.size += len(key)
        if self.size >= COUNTED:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        import zstandard

        shard, key = (np.concatenate([h[i] for h in self.held]) if self.held else np.empty(0, t) for i, t in ((0, np.int32), (1, _U)))
        self.held, self.size = [], 0
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(shard[order], kind="stable")]
        shard, key = shard[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.empty(0, np.int64)
        n = np.diff(np.concatenate((first, [len(key)])))
        shard, key = shard[first], key[first]
        names = np.unique(shard)
        cuts = [*np.searchsorted(shard, names).tolist(), len(shard)]
        packer = zstandard.ZstdCompressor(level=1)
        keys, counts = [], []
        for lo, hi in pairwise(cuts):
            keys.append(packer.compress(np.diff(key[lo:hi], prepend=_U(0)).tobytes()))
            counts.append(packer.compress(n[lo:hi].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["shard", "keys", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard's keys and total counts; rows come in the order of shards."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    name = None

    def total() -> tuple[int, np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return name, key, np.bincount(inverse, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

    for batch in batches:
        for shard, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if shard != name and held:
                yield total()
                held = []
            name = shard
            held.append((np.cumsum(np.frombuffer(unpacker.decompress(keys), _U), dtype=_U), np.frombuffer(unpacker.decompress(counts), "<u4")))
    if held:
        yield total()


def _level(parent: np.ndarray, child: np.ndarray, n: np.ndarray, contexts: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Arrays of a level from its kept n-grams in the order of (parent, child); ``contexts`` has each parent's count."""
    share = (n - DISCOUNT) / np.maximum(contexts[parent], 1)
    rest = np.clip(1 - np.bincount(parent, share, len(contexts)), 1e-9, 1)
    starts = np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=len(contexts)))))
    pointers = EliasFano.build(starts.astype(_U), len(n) + 1)
    values = EliasFano.build(parent.astype(_U) * _U(width) + child.astype(_U), max(1, len(contexts)) * width)
    return pointers.arrays("pointers") | values.arrays("values") | {"share": quantised(share), "rest": quantised(rest), "n": n.astype(np.uint32)}


def _look(arrays: dict[str, np.ndarray], parent: np.ndarray, child: np.ndarray, width: int) -> np.ndarray:
    """Place of each (parent, child) in a level, or -1: a successor search within the context's range."""
    pointers, values = EliasFano.of(arrays, "pointers"), EliasFano.of(arrays, "values")
    ends = pointers.access(np.concatenate([parent, parent + 1])).astype(np.int64)
    first, end = ends[:len(parent)], ends[len(parent):]
    found = np.full(len(parent), -1, np.int64)
    some = np.flatnonzero(first < end)
    if len(some):
        x = parent[some].astype(_U) * _U(width) + child[some].astype(_U)
        found[some] = values.find(x, first[some], end[some])
    return found


def _pair_places(model: Model, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the token pairs that end at each token: place in level 2 of its shard (-1: none), shard, and quantised share."""
    inside = np.flatnonzero((place > 0) & (ids < model.distinct))
    inside = inside[ids[inside - 1] < model.distinct]
    key, inverse = np.unique((ids[inside - 1].astype(_U) << _U(32)) | ids[inside].astype(_U), return_inverse=True)
    left, right = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64)
    at, share = np.full(len(key), -1, np.int64), np.zeros(len(key), np.uint16)
    cuts = np.searchsorted(left, np.array(model.first))
    for shard, (lo, hi) in enumerate(pairwise(cuts.tolist())):
        if lo < hi:
            arrays = map_arrays(model.pairs[shard])
            found = _look(arrays, left[lo:hi] - model.first[shard], right[lo:hi], model.distinct)
            at[lo:hi] = found
            share[lo:hi] = np.where(found >= 0, arrays["share"][np.maximum(found, 0)] if len(arrays["share"]) else 0, 0)
    out_at, out_share = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.uint16)
    out_at[inside], out_share[inside] = at[inverse], share[inverse]
    shards = np.full(len(ids), -1, np.int64)
    shards[inside] = (np.searchsorted(np.array(model.first), left, side="right") - 1)[inverse]
    return out_at, shards, out_share


def _with(model: Model, **levels: tuple[str, ...]) -> Model:
    return Model(**(model.__dict__ | levels))


def _files(rows: DataFrame, count: int, make, name: str) -> tuple[str, ...]:
    """The files that ``make`` writes, one for each shard."""
    listed = _manifest(durable(arrow_map(rows, make, MANIFEST), name))
    return tuple(listed[s][1] for s in range(count))


def trie(tokens: DataFrame, model: Model, folder: str) -> Model:
    """Levels 2 and 3 from the learned rows of ``numbered``."""
    shards = 1 << model.bits
    learned = tokens.where("learned").select("ids")
    # One row for every shard, so that each gets its file.
    every = tokens.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))

    def gathered(counted: DataFrame) -> DataFrame:
        return counted.unionByName(every).repartition(shards, "shard").sortWithinPartitions("shard")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Kept keys of each shard, of those without any n-gram as well."""
        named: set[int] = set()
        done: set[int] = set()

        def real() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                empty = batch.column(1).is_null()
                named.update(batch.filter(empty).column(0).to_pylist())
                yield batch.filter(pa.compute.invert(empty))

        for shard, key, n in _merged(real()):
            done.add(shard)
            keep = n >= LEAST
            yield shard, key[keep], n[keep]
        for shard in sorted(named - done):
            yield shard, np.empty(0, _U), np.empty(0, np.int64)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = Blobs()
        for batch in chunks(batches, "ids", 4 << 20):
            ids, place = _tokens(batch, 0)
            inside = np.flatnonzero(place > 0)
            left = ids[inside - 1]
            yield from blobs.add(np.searchsorted(np.array(model.first), left, side="right") - 1, (left.astype(_U) << _U(32)) | ids[inside].astype(_U))
        yield blobs.flush()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, key, n in merged(batches):
            parent = (key >> _U(32)).astype(np.int64) - model.first[shard]
            contexts = np.asarray(map_arrays(model.vocabulary[shard])["count"])
            yield _listed(shard, len(n), write_arrays(folder, f"pairs-{shard}", _level(parent, (key & _U(0xFFFFFFFF)).astype(np.int64), n, contexts, model.distinct)))

    pairs = _files(gathered(arrow_map(learned, count_pairs, Blobs.SCHEMA)), shards, write_pairs, "lm-pairs")
    model = _with(model, pairs=pairs)

    def count_triples(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
        blobs = Blobs()
        for batch in chunks(batches, "ids", 4 << 20):
            ids, place = _tokens(batch, 0)
            at, shard, _ = _pair_places(model, ids, place)
            # A triple seen twice has two pairs seen twice.
            inside = np.flatnonzero((place > 1) & (at >= 0))
            inside = inside[at[inside - 1] >= 0]
            yield from blobs.add(shard[inside - 1], (at[inside - 1].astype(_U) << _U(32)) | ids[inside].astype(_U))
        yield blobs.flush()

    def write_triples(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
        for shard, key, n in merged(batches):
            contexts = np.asarray(map_arrays(model.pairs[shard])["n"]).astype(np.int64)
            yield _listed(shard, len(n), write_arrays(folder, f"triples-{shard}", _level((key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.int64), n, contexts, model.distinct)))

    triples = _files(gathered(arrow_map(learned, count_triples, Blobs.SCHEMA)), shards, write_triples, "lm-triples")
    return _with(model, triples=triples)


def token_scores(model: Model, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Log10 probability of each token after the two before it in its text."""
    if not model.tokens:
        return np.zeros(len(ids))
    distinct, inverse = np.unique(ids, return_inverse=True)
    first, rest = np.full(len(distinct), model.floor), np.zeros(len(distinct), np.uint16)
    cuts = np.searchsorted(distinct, np.array(model.first))
    for shard, (lo, hi) in enumerate(pairwise(cuts.tolist())):
        if lo < hi:
            own = distinct[lo:hi] - model.first[shard]
            count = map_arrays(model.vocabulary[shard])["count"][own]
            first[lo:hi] = np.log10(count + SMOOTH) - np.log10(model.tokens + SMOOTH * (model.distinct + 1))
            rest[lo:hi] = map_arrays(model.pairs[shard])["rest"][own]
    p = probability(quantised(10.0**first))[inverse]
    back = probability(rest)[inverse]
    known = ids < model.distinct
    at, shard, share = _pair_places(model, ids, place)
    inside = np.flatnonzero(place > 0)
    inside = inside[known[inside - 1]]
    p[inside] = np.where(at[inside] >= 0, probability(share[inside]), 0) + back[inside - 1] * p[inside]
    # Level 3: the pair before is the context.
    inside = np.flatnonzero(place > 1)
    inside = inside[at[inside - 1] >= 0]
    inside = inside[np.argsort(shard[inside - 1], kind="stable")]
    cuts = np.searchsorted(shard[inside - 1], np.arange(len(model.triples) + 1))
    for s, (lo, hi) in enumerate(pairwise(cuts.tolist())):
        if lo < hi:
            here, arrays = inside[lo:hi], map_arrays(model.triples[s])
            parent = at[here - 1]
            own = np.zeros(len(here))
            # A kept triple ends in a kept pair.
            maybe = np.flatnonzero(at[here] >= 0)
            found = _look(arrays, parent[maybe], ids[here[maybe]], model.distinct)
            hit = found >= 0
            own[maybe[hit]] = probability(arrays["share"][found[hit]])
            p[here] = own + probability(arrays["rest"][parent]) * p[here]
    return np.log10(np.minimum(p, 1))


def scored(tokens: DataFrame, model: Model) -> DataFrame:
    """Rows of ``numbered`` with ``score`` in place of the numbers."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "ids", 4 << 20):
            ids, place = _tokens(batch, 5)
            score = np.add.reduceat(token_scores(model, ids, place), np.flatnonzero(place == 0)) if len(ids) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], [*batch.schema.names[:5], "score"])

    return arrow_map(tokens, run, f"doc_id {kind}, learned boolean, n_tokens long, n_known long, base_score double, score double")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, learned from the rows not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("learned", ~held_out())
    folder = scratch_path(docs.sparkSession, "lm")
    model = vocabulary(durable(word_counts(rows.where("learned")), "lm-counts"), folder)
    tokens = durable(numbered(rows, model), "lm-tokens")
    model = trie(tokens, model, folder)
    return scored(tokens, model).select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
