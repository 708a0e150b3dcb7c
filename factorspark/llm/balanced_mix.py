"""Mixing sources to target weights by balanced (cube-method) sampling of whole documents.

Every document of a source is taken ``floor(rate)`` times, and once more with the fraction of ``rate`` = target / source size as inclusion
probability. Which ones is decided by the cube method: three open probabilities at a time move along the null space of the two
constraints of a source, its number of documents and its words, until one of them is 0 or 1; both totals stay as they are.

* Documents are placed by (source, size, id), largest first, and fly in blocks of neighbouring places, each a task's group of bounded size.
  The largest few of a block and at most two others stay open; those of 64 blocks fly together in the next round, so rounds grow
  with the logarithm of the table, and one source's share of the rows does not matter.
* In the last round each source also keeps a few documents of all sizes back; with the (at most two) others still open they are the
  landing problem, decided by trying all choices for the words nearest to the open total, and then the nearest count.

Sources share 150 % of all words by their weights; what a source's target exceeds twice its size is shared again among the others.

Defined cases: a null or empty text has size 0 and is taken 0 words. A null source is the last source, an empty one another. Null ids
are rows like others. Repeated rows are sampled each by itself; rows equal in source, size and id are interchangeable. Without
words every target is 0. An empty table gives an empty result. The random choices depend on source and place alone, so reruns agree.
Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, durable, text_bytes
from .ranges import dense_positions

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Places of a block, and blocks whose open documents fly together in the next round.
BLOCK, JOINED = 1024, 64
#: The largest documents of a block or source that wait for the landing, and more of all sizes that wait in the last round.
LARGEST, SPREAD = 7, 7
CLOSE = 1e-9

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def sizes(texts: Sequence[bytes | None]) -> np.ndarray:
    """Words of each text: places where a byte that is no white space follows one that is."""
    data = np.frombuffer(b" " + b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
    return np.diff(np.searchsorted(starts, ends), prepend=0)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source_key, source, size`` of every row; the keys have the sources' order, null last."""
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    rows = docs.select("doc_id", key.alias("source_key"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes(text_bytes(batch)), pa.int64())], ["doc_id", "source_key", "size"])

    return arrow_map(rows, run, f"doc_id {kind}, source_key string, size long")


def targets(rows: DataFrame) -> DataFrame:
    """``source_key, source_size, target``: weights share the words; targets stop at MOST times a source's size.

    One small aggregation for each time that more sources reach their limit.
    """
    totals = durable(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), "mix-sources")
    placed = dense_positions(totals, [F.col("source_key").asc()], "mix-order", "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    sources = durable(placed.select("source_key", "source_size", weight.alias("weight")), "mix-weights")
    limit = F.col("source_size") * MOST
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > limit
        row = sources.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(above, limit)).alias("limits"), F.sum(F.when(~above, F.col("weight"))).alias("weights"), F.count_if(above).alias("capped")).first()
        if row["capped"] == capped or not row["words"] or not row["weights"]:
            break
        capped = row["capped"]
        level = (SHARE * row["words"] - (row["limits"] or 0)) / row["weights"]
    return sources.select("source_key", "source_size", F.least(limit.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def fly(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances moved until at most two of the given documents are open; the sums of chances and of chances times sizes stay."""
    p = chance.astype(float).tolist()
    s = size.astype(float).tolist()
    pool: list[int] = []
    waiting = iter(range(len(p)))
    while True:
        for i in waiting:
            if CLOSE < p[i] < 1 - CLOSE:
                pool.append(i)
                if len(pool) == 3:
                    break
            else:
                p[i] = float(round(p[i]))
        if len(pool) == 3:
            a, b, c = (s[i] for i in pool)
            move = [b - c, c - a, a - b]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        elif len(pool) == 2 and s[pool[0]] == s[pool[1]]:
            move = [1.0, -1.0]
        else:
            return np.array(p)
        reach, back = ([min(((1 - p[i]) / (d * v) if d * v > 0 else p[i] / -(d * v), i) for i, v in zip(pool, move, strict=True) if v) for d in (1, -1)])
        (step, stop), d = (reach, 1) if rng.random() * (reach[0] + back[0]) < back[0] else (back, -1)
        for i, v in zip(pool, move, strict=True):
            p[i] += d * step * v
            if i == stop or not CLOSE < p[i] < 1 - CLOSE:
                p[i] = float(round(p[i]))
        pool = [i for i in pool if CLOSE < p[i] < 1 - CLOSE]


def land(size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """0 or 1 for each open document: the words nearest to the open total, then the count nearest to the open count."""
    options = np.arange(1 << len(size))[:, None] >> np.arange(len(size)) & 1
    off = np.abs(options @ size - chance @ size)
    count = np.abs(options.sum(1) - chance.sum())
    return options[np.lexsort((count, off.round(6)))[0]]


def thinned(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight of a block but for its LARGEST documents: large ones stay open longest, and only their kind can make up for one."""
    return np.concatenate([chance[:LARGEST], fly(size[LARGEST:], chance[LARGEST:], rng)])


def settled(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight of all but the LARGEST and SPREAD more of all sizes (which descend), then the landing."""
    p = chance.copy()
    spread = np.linspace(LARGEST, len(p) - 1, SPREAD).round().astype(int)
    kept = np.unique([*range(LARGEST), *spread]) if len(p) > LARGEST + SPREAD else np.arange(len(p))
    others = np.setdiff1d(np.arange(len(p)), kept)
    p[others] = fly(size[others], p[others], rng)
    rest = np.flatnonzero((p > CLOSE) & (p < 1 - CLOSE))
    p[rest] = land(size[rest].astype(float), p[rest])
    return p.round()


def _flight(width: int, final: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """What happens to the documents of one block of ``width`` places."""

    def flown(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("position").drop_columns(["block"])
        rng = np.random.default_rng(zlib.crc32(f"{width}:{key[1].as_py()}:{key[0].as_py()}".encode()))
        moved = (settled if final else thinned)(table["size"].to_numpy(), table["chance"].to_numpy(), rng)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(moved, pa.float64()))

    return flown


def sampled(rows: DataFrame) -> DataFrame:
    """``rows`` (``source_key, position, size, chance``, and more) with ``chosen`` 0 or 1, round by round of flights."""
    last = (rows.agg(F.max("position")).first()[0] or 0) + 1
    width, decided, moving = BLOCK, rows.where("chance = 0"), rows.where("chance > 0")
    while True:
        final = width >= last
        placed = moving.withColumn("block", F.floor(F.col("position") / width).cast("long"))
        flown = durable(placed.groupBy("source_key", "block").applyInArrow(_flight(width, final), rows.schema), "mix-flown")
        decided = decided.unionByName(flown.where("chance in (0, 1)"))
        if final:
            return decided.withColumn("chosen", F.col("chance").cast("int")).drop("chance")
        moving = flown.where("chance not in (0, 1)")
        width *= JOINED


def mixed(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    rows = durable(sized(docs), "mix-sizes")
    goals = targets(rows)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(rate + CLOSE)
    chance = F.greatest(rate - whole, F.lit(0.0))
    goals = durable(goals.withColumns({"times": whole.cast("int"), "chance": F.when(chance < CLOSE, 0.0).otherwise(chance)}), "mix-targets")
    order = [F.col("source_key").asc(), F.col("size").desc(), F.xxhash64("doc_id").asc(), F.col("doc_id").asc()]
    placed = dense_positions(rows, order, "mix-places").join(goals.select("source_key", "times", "chance"), "source_key")
    taken = sampled(placed).join(goals.select("source_key", "source_size", "target"), "source_key")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("chosen"))).alias("taken"))
