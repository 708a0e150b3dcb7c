"""Near-duplicates by MinHash bands with sequential Bayesian verification and an exact check of every survivor.

1. Every distinct shingle set is one node; exact copies meet by a digest of the whole set, so a group of copies of any size
   costs one node.
2. Signatures are cut into bands. In a bucket, every node is paired with the bucket's least node (a star).
3. A pair's signatures are compared batch by batch; it is given up as soon as the posterior probability of reaching the
   threshold is below the chosen miss probability. Survivors are verified on their full shingle sets.
4. What is left are buckets whose nodes lie in different components. There, and only there, the nodes of
   different components are compared with each other, in blocks of bounded size spread over tasks, each pair in the first band
   it shares; survivors are verified exactly within the block. Pairs inside one component need no comparison.

So no bucket is capped and no pair of a bucket is left out: each is linked, in one component already, or compared.

Defined cases: texts without words are linked with nothing and keep their own id. Texts with fewer words than a shingle are one
shingle. Ties go to the least id. Rows that repeat an id are one document. A null id is a member of its component but
never names it. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, durable, text_bytes
from .components import connected

WIDTH = 5
THRESHOLD = (75, 100)
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-5
#: Nodes of a block in the comparison across components.
BLOCK = 1024

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)
_PLACES = _RANDOM.integers(0, 2**63, (WIDTH + 1, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles, A-Z in lower case; empty without words."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out += h[k:k + len(out)] * _PLACES[width, k]
    return np.unique(_mixed(out))


def signature(items: np.ndarray) -> np.ndarray:
    """The least value of each of the ``HASHES`` permutations over the shingles."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (low[at:at + 2048, None] * _FACTORS + _OFFSETS).min(0))
    return least


def node_of(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        nodes, sizes, sketches, bands = [], [], [], []
        for text in text_bytes(batch):
            items = shingles(text)
            sizes.append(len(items))
            if not len(items):
                nodes.append(None), sketches.append(None), bands.append(None)
                continue
            least = signature(items)
            nodes.append(node_of(items))
            sketches.append(least.astype(np.uint8).tobytes())
            keys = _mixed((least.reshape(BANDS, ROWS) * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            bands.append(keys.view(np.int64))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), batch.column(2), pa.array(sketches, pa.binary()),
            pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "node", "n_shingles", "text_key", "sketch", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of ``doc_id, text``: its set's node, size, one byte of each hash, and band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return arrow_map(rows, _sign, f"doc_id {kind}, node binary, n_shingles long, text_key long, sketch binary, bands array<long>")


def needed_matches(miss: float = MISS, threshold: tuple[int, int] = THRESHOLD) -> list[int]:
    """For each batch end, the least number of equal bytes with which a pair may still reach the threshold.

    Posterior under a uniform prior of the similarity s; a byte agrees with probability s + (1 - s) / 256.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(logs - logs.max())
            if weight[s >= threshold[0] / threshold[1]].sum() >= miss * weight.sum():
                out.append(m)
                break
    return out


def _promising(left: np.ndarray, right: np.ndarray, needed: list[int]) -> np.ndarray:
    """Which rows of two signature matrices survive all batches."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int32)
    for k, least in enumerate(needed):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal[:len(alive)] + (left[alive, part] == right[alive, part]).sum(1)
        keep = equal >= least
        alive, equal = alive[keep], equal[keep]
    return alive


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def promising(pairs: DataFrame, nodes: DataFrame, miss: float = MISS) -> DataFrame:
    """The pairs ``a, b`` whose sizes and signatures leave the threshold possible."""
    needed = needed_matches(miss)
    least, most = THRESHOLD

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _promising(_matrix(batch.column(2), HASHES), _matrix(batch.column(3), HASHES), needed)
                yield batch.select([0, 1]).take(pa.array(keep))

    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("n_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("n_b"))
    possible = F.least("n_a", "n_b") * most >= F.greatest("n_a", "n_b") * least
    rows = pairs.join(left, "a").join(right, "b").where(possible).select("a", "b", "sketch_a", "sketch_b")
    return arrow_map(rows, prune, "a binary, b binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        items = [shingles(t) for t in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in items], pa.binary()), pa.array([x.tobytes() for x in items], pa.binary())], ["node", "items"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (len(a) + len(b) - shared)


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, items``: the full sets of the wanted nodes, taken anew from one whole text of each."""
    keys = nodes.join(wanted, "node", "left_semi").select("text_key").distinct()
    # Copies of a text meet within their task first.
    once = docs.select("text", F.xxhash64("text").alias("text_key")).groupBy("text_key").agg(F.first("text").alias("text"))
    return durable(arrow_map(once.join(keys, "text_key", "left_semi").select("text"), _sets, "node binary, items binary").dropDuplicates(["node"]), "near-sets")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, salt) with a's own set first; each further row is checked against it."""
    own, own_name = np.empty(0, np.uint64), None
    for batch in chunks(batches, "items", 16 << 20):
        a, b, items = (batch.column(i).to_pylist() for i in range(3))
        left, right = [], []
        for x, y, raw in zip(a, b, items, strict=True):
            other = np.frombuffer(raw, np.uint64)
            if y is None:
                own, own_name = other.copy(), x
                continue
            if own_name != x:
                raise RuntimeError("a pair came before its first set")
            if similar(own, other):
                left.append(x), right.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that reach the threshold on their full sets, taken anew from the whole texts.

    A first set is sent once for each salt of its partners, not once for each pair.
    """
    pairs = durable(pairs, "near-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(wanted, nodes, docs)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(8)))
    first = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("binary").alias("b"), "items", "salt")
    others = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "b", "items", "salt")
    rows = first.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return arrow_map(rows, _verify, "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal first ``keys`` columns, also across batches."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(c[lo] for c in columns)
            if this != name and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            name = this
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


BLOCK_ROW = "key long, i long, j long, own long, node binary, root binary, n_shingles long, sketch binary, bands array<long>"


def _block_pairs(group: pa.RecordBatch, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows x, y of a block pair that are promising, in different components, and have no earlier band in common."""
    least, most = THRESHOLD
    i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
    own = group.column(3).to_numpy()
    number: dict[bytes, int] = {}
    root = np.array([number.setdefault(r, len(number)) for r in group.column(5).to_pylist()])
    size = group.column(6).to_numpy()
    if i == j:
        x, y = np.triu_indices(group.num_rows, 1)
    else:
        x, y = (v.ravel() for v in np.meshgrid(np.flatnonzero(own == i), np.flatnonzero(own == j), indexing="ij"))
    keep = (root[x] != root[y]) & (np.minimum(size[x], size[y]) * most >= np.maximum(size[x], size[y]) * least)
    x, y = x[keep], y[keep]
    if not len(x):
        return x, y
    alive = _promising_pairs(_matrix(group.column(7), HASHES), x, y, needed)
    x, y = x[alive], y[alive]
    bands = group.column(8).flatten().to_numpy().reshape(group.num_rows, BANDS)
    first = np.empty(len(x), bool)
    for at in range(0, len(x), 16384):
        equal = bands[x[at:at + 16384]] == bands[y[at:at + 16384]]
        first[at:at + 16384] = bands[x[at:at + 16384], equal.argmax(1)] == group.column(0)[0].as_py()
    return x[first], y[first]


def across(members: DataFrame, nodes: DataFrame, roots: DataFrame, docs: DataFrame, miss: float = MISS) -> DataFrame:
    """Links between nodes of one bucket that lie in different components.

    Blocks of a bucket are compared by signatures first; nodes with a promising partner come back to their block with
    their full sets and are verified there. A block returns at most one link for each of its nodes: links that join
    nothing new are left out, so a large group never turns into its pairs.
    """
    needed = needed_matches(miss)
    rooted = durable(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high")
    blocks = F.ceil(F.col("size") / BLOCK)
    rows = rooted.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    rows = rows.join(nodes.select("node", "n_shingles", "sketch", "bands"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n_shingles", "sketch", "bands")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            if group.num_rows > 1:
                x, y = _block_pairs(group, needed)
                if len(x):
                    yield group.take(pa.array(np.union1d(x, y)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            if group.num_rows > 1:
                yield _block_links(group, *_block_pairs(group, needed))

    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    hopeful = durable(arrow_map(rows, compare, BLOCK_ROW), "near-hopeful")
    sets = full_sets(hopeful.select("node").distinct(), nodes, docs)
    rows = hopeful.join(sets, "node").select(*hopeful.columns, "items").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return arrow_map(rows, verify, "a binary, b binary")


def _block_links(group: pa.RecordBatch, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """The verified links among the pairs that join what no earlier one of the block joins."""
    items = [np.frombuffer(raw, np.uint64) for raw in group.column(9).to_pylist()]
    name = group.column(4).to_pylist()
    number: dict[bytes, int] = {}
    part = [number.setdefault(r, len(number)) for r in group.column(5).to_pylist()]
    up = list(range(len(number)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    left, right = [], []
    for p, q in zip(x.tolist(), y.tolist(), strict=True):
        a, b = top(part[p]), top(part[q])
        if a != b and similar(items[p], items[q]):
            up[a] = b
            left.append(name[p]), right.append(name[q])
    return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _promising_pairs(sketch: np.ndarray, x: np.ndarray, y: np.ndarray, needed: list[int], step: int = 16384) -> np.ndarray:
    found = [at + _promising(sketch[x[at:at + step]], sketch[y[at:at + step]], needed) for at in range(0, len(x), step)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = durable(signatures(docs), "near-signatures")
    named = signed.where("node is not null")
    nodes = durable(named.groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.min("text_key").alias("text_key"), F.first("sketch").alias("sketch"),
        F.first("bands").alias("bands")), "near-nodes")
    banded = nodes.select("node", F.explode("bands").alias("key")).repartition("key")
    led = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = durable(banded.join(led.select("key", "leader"), "key"), "near-members")
    stars = members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = durable(verified(promising(stars, nodes, miss), nodes, docs), "near-links")
    roots = connected(links)
    more = durable(across(members, nodes, roots, docs, miss), "near-links")
    # Old components shrink to their roots; the further links join the roots.
    by_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    by_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    joined = more.join(by_a, "a", "left").join(by_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    final = connected(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    tops = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(final, "root", "left")
    tops = tops.select("node", "least_id", F.coalesce("top", "root").alias("top"))
    least = tops.groupBy("top").agg(F.min("least_id").alias("component_id"))
    classes = tops.join(least, "top").select("node", "component_id")
    linked = named.select("doc_id", "node", "n_shingles").join(classes, "node").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows without an id are kept."""
    gone = components(docs, id_col, text_col, miss).where("doc_id is not null and not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
