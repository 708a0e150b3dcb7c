"""Approximate nearest neighbours by cosine: a neighbour graph from NN-descent, searched greedily.

* Equal vectors are one node, so a vector that fills any share of the rows costs one node.
* The graph starts from small blocks of vectors with like random-projection codes (a few codes, each with an order of its own), so a
  vector is compared with at most CODES * BLOCK others, a vanishing share of a large table.
* NN-descent: every node's neighbours, and a sample of the nodes whose neighbour it is, meet at the node (a join); among
  each other they are neighbours of neighbours, and pairs closer than a node's worst neighbour are proposed. Proposals are
  joined to the lists and the best are kept. Rounds end when few neighbours change.
* Search: a beam for each query starts at its own place in the graph (or at random nodes, if it has none) and is extended by
  the neighbours of its nodes, round by round, until none of its best is new.
* Both go on until they settle; where they do not within many rounds, they raise.

All steps are joins and grouped limits over tables in the shared folder; no task holds the vectors of more than a block.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors of
another length than the most frequent one. Repeated ids count as one row (the first in the order of components). Ties go to
the smaller id. Fewer candidates than asked for are all returned. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, durable

#: Neighbours of a node, sampled reverse neighbours, and the share of changed neighbours that ends the rounds.
K, REVERSE, SETTLED = 24, 12, 0.01
#: Random-projection codes for the start, bits of each, vectors of a block, and of a task.
CODES, BITS, BLOCK, TASK = 4, 16, 128, 1 << 14
#: Nodes of a query's beam.
BEAM = 192
#: Rounds after which a graph or a search that has not settled raises.
ROUNDS = 60


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1)
    return rows.join(F.broadcast(width.select("width")), F.size("embedding") == F.col("width"), "left_semi")


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            matrix = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            matrix = matrix / np.abs(matrix).max(1, keepdims=True)  # so that squares neither vanish nor overflow
            matrix = (matrix / np.sqrt((matrix * matrix).sum(1, keepdims=True))).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in matrix], pa.binary())], ["node", "unit"])


def _rows(column: pa.Array) -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), "<f4").reshape(len(found), -1)


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], ["node", "other", "closeness"])


EDGE = "node long, other long, closeness float"


def _best(edges: DataFrame, k: int, key: str = "node") -> DataFrame:
    """The ``k`` closest of each node; Spark limits within the map tasks first."""
    order = Window.partitionBy(key).orderBy(F.desc("closeness"), "other")
    return edges.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vector once for each code: ``draw`` numbers the code, ``code`` has its bits."""
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch.column(1))
            for draw in range(CODES):
                planes = np.random.default_rng(draw).normal(size=(x.shape[1], BITS))
                code = ((x @ planes) > 0) @ (1 << np.arange(BITS))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(x), draw), pa.int32()), pa.array(code, pa.int64())], ["node", "unit", "draw", "code"])


def _first_graph(units: DataFrame, k: int) -> DataFrame:
    """Neighbours within blocks of like codes, the best over all codes; one shuffle serves all codes."""
    parts = max(1, units.count() * CODES // TASK)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            draw = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(draw)) + 1).tolist(), len(draw)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                for at in range(start, end, BLOCK):
                    part = batch.slice(at, min(BLOCK, end - at))
                    if part.num_rows < 2:
                        continue
                    ids, x = part.column(0).to_numpy(), _rows(part.column(1))
                    most = min(k, len(ids) - 1)
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    top = np.argpartition(s, -most, axis=1)[:, -most:]
                    yield _edges(np.repeat(ids, most), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel())

    # Rows of like codes are neighbours in the order; blocks cut it at fixed lengths. Within a code each draw has another order.
    order = ["draw", "code", F.xxhash64("node", "draw")]
    ordered = arrow_map(units, _coded, "node long, unit binary, draw int, code long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    drawn = arrow_map(ordered.select("node", "unit", "draw"), blocks, EDGE)
    return _best(drawn.groupBy("node", "other").agg(F.max("closeness").alias("closeness")), k)


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``meeting, node, unit, worst`` in the order of ``meeting``: closer pairs among those that meet."""
    held: pa.RecordBatch | None = None

    def closer(batch: pa.RecordBatch) -> pa.RecordBatch:
        meeting, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x, worst = _rows(batch.column(2)), batch.column(3).to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(ids)])))
        a, b, s = [], [], []
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size]
            for lo in range(0, len(at), 256):
                place = at[lo:lo + 256, None] + np.arange(size)
                close = np.matmul(x[place], x[place].transpose(0, 2, 1))
                good = close > worst[place][:, :, None]
                good[:, np.arange(size), np.arange(size)] = False
                g, i, j = np.nonzero(good)
                a.append(ids[place[g, i]]), b.append(ids[place[g, j]]), s.append(close[g, i, j])
        if not a:
            return _edges(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        a, b, s = map(np.concatenate, (a, b, s))
        # One proposal of a pair, and the best of each node, before anything is sent.
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b, s = a[once], b[once], s[once]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.concatenate((first, [len(a)]))))
        keep = rank < K
        return _edges(a[keep], b[keep], s[keep])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        meeting = batch.column(0).to_numpy()
        cut = int(np.searchsorted(meeting, meeting[-1]))  # the last node's rows may go on
        if cut:
            yield closer(batch.slice(0, cut))
        held = batch.slice(cut)
    if held is not None:
        yield closer(held)


def graph(units: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """``node, other, closeness``: the ``k`` neighbours of each node that NN-descent finds; raises if it has not settled after ``rounds``."""
    edges = durable(_first_graph(units, k), "graph")
    size = edges.count()
    for turn in range(rounds):
        worst = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.min("closeness")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        reverse = edges.select(F.col("other").alias("meeting"), F.col("node").alias("member"))
        # A fresh sample of bounded size each round, so hubs stay small.
        order = Window.partitionBy("meeting").orderBy(F.xxhash64("member", F.lit(turn)))
        reverse = reverse.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= REVERSE).drop("_place")
        forward = edges.select(F.col("node").alias("meeting"), F.col("other").alias("member"))
        itself = units.select(F.col("node").alias("meeting"), F.col("node").alias("member"))
        meetings = forward.unionByName(reverse).unionByName(itself).distinct()
        known = units.join(worst, "node", "left").select(F.col("node").alias("member"), "unit", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        rows = meetings.join(known, "member").select("meeting", "member", "unit", "worst").repartition("meeting").sortWithinPartitions("meeting")
        proposed = arrow_map(rows, _proposals, EDGE)
        merged = edges.withColumn("old", F.lit(1)).unionByName(proposed.withColumn("old", F.lit(0)))
        merged = merged.groupBy("node", "other").agg(F.max("closeness").alias("closeness"), F.max("old").alias("old"))
        after = durable(_best(merged, k), "graph")
        counted = after.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(1 - F.col("old")), F.lit(0)).alias("new")).first()
        edges, before, size = after.drop("old"), size, counted["n"]
        if counted["new"] <= SETTLED * max(size, before):
            return edges
    raise RuntimeError(f"the neighbour graph has not settled after {rounds} rounds: {counted['new']} of {size} neighbours are new")


def _closeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = (_rows(batch.column(2)) * _rows(batch.column(3))).sum(1)
            yield _edges(batch.column(0).to_numpy(), batch.column(1).to_numpy(), s)


def search(edges: DataFrame, units: DataFrame, starts: DataFrame, asked: DataFrame, beam: int = BEAM, rounds: int = ROUNDS) -> DataFrame:
    """``node, other, closeness``: the beam of each query.

    ``asked`` has ``node, unit`` of the queries, ``starts`` the first ``node, other`` of each. A round extends every beam by
    the neighbours of those of its nodes that are new, until no beam gains one; raises if some still do after ``rounds``.
    """
    ways = edges.select(F.col("node").alias("other"), F.col("other").alias("next"))

    def valued(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(units.select(F.col("node").alias("other"), F.col("unit").alias("theirs")), "other").join(asked, "node")
        return arrow_map(rows.select("node", "other", "unit", "theirs"), _closeness, EDGE)

    beams = durable(_best(valued(starts.distinct()), beam).withColumn("new", F.lit(True)), "beams")
    for _ in range(rounds):
        reached = beams.where("new").join(ways, "other").select("node", F.col("next").alias("other")).distinct()
        reached = reached.join(beams.select("node", "other"), ["node", "other"], "left_anti")
        gained = valued(reached).withColumn("new", F.lit(True))
        beams = durable(_best(beams.withColumn("new", F.lit(False)).unionByName(gained), beam), "beams")
        if beams.where("new").isEmpty():
            return beams.drop("new")
    raise RuntimeError(f"the search has not settled after {rounds} rounds")


def _cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.stack(batch.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3))
            score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["node", "other", "score"])


def nearest(vectors: DataFrame, queries: str = "vec_id % 50 = 0", count: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each row of ``vectors`` where ``queries`` holds."""
    rows = durable(usable(vectors, id_col, vector_col), "vectors")
    nodes = durable(rows.groupBy("embedding").agg(F.min("vec_id").alias("node")), "nodes")
    units = durable(arrow_map(nodes.select("node", "embedding"), _unit, "node long, unit binary"), "units")
    # The members of a node that can be among the nearest: one more than asked for, as a query is not its own.
    place = Window.partitionBy("embedding").orderBy("vec_id")
    members = rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= count + 1).join(nodes, "embedding").select("node", "vec_id")
    asking = durable(rows.where(queries).join(nodes, "embedding").select(F.col("vec_id").alias("query_id"), "node"), "queries")
    asked = asking.select("node").distinct()
    edges = graph(units)
    near = edges.join(asked, "node", "left_semi").select("node", "other").unionByName(asked.select("node", F.col("node").alias("other")))
    beams = search(edges, units, near, units.join(asked, "node", "left_semi"))
    whole = nodes.select("node", F.col("embedding").alias("x"))
    exact = beams.select("node", "other").join(whole, "node").join(nodes.select(F.col("node").alias("other"), F.col("embedding").alias("y")), "other")
    exact = arrow_map(exact.select("node", "other", "x", "y"), _cosine, "node long, other long, score double")
    best = exact.join(members.select(F.col("node").alias("other"), "vec_id"), "other")
    # One more than asked for of each query node, before its queries are joined to it.
    best = best.withColumn("_place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))).where(F.col("_place") <= count + 1)
    best = asking.join(best.select("node", "vec_id", "score"), "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
