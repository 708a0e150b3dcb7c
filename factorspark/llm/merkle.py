"""Merkle manifest of a dataset, its leaves placed by bitmap ranks.

* **Coordinates without sorting.** The ids of a source are a sparse bitmap: a row for each 64 ids that occur, built by ``bit_or``
  (combined within each task before the shuffle). Three popcount directories (64 ids, 2^16 ids, 2^26 ids) hold how many rows come
  before, so no window sees more than 1024 rows of a level. A leaf's place is the directory's count plus the set bits below its own.
* **Levels by slot arrays.** Nodes meet under the key (tree, place div 81) in arrays of at most 81 slots, and four levels of three
  are folded at a time: a third of all rows in one source still makes groups of 81. The roots of the sources are the leaves of one
  more tree.
* **Proofs from the top down.** A group's path to the root is made once and handed to its children; a document joins its lowest
  group alone, and its siblings are hashed there without being written.

Defined cases: an empty table gives an empty result. A null source is a source of its own, before all others; an empty one is
another. Rows of one source with one id are ordered by their leaf, a null id comes before all others; such rows are placed by a range
sort of the rows whose 64 ids hold a repetition. Rows that are equal in all fields are leaves each. Nulls in any field are ``-``.
Null ids are never tampered with. Extra columns are not read. Ids are whole numbers of 64 bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, remainder
from .ranges import dense_positions

ARITY = 3
#: Levels folded in one group, and the slots of a group.
DEPTH = 4
WIDTH = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The place of null ids in the bitmap: a word before that of the least id.
NULL_WORD = -(1 << 57) - 1


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(field: Column) -> Column:
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``row, doc_id, tree, leaf, altered``: every row's leaf, and the leaf of its tampered text where it is tampered with.

    ``tree`` names the source without nulls and keeps the sources' order.
    """
    field = {c: encoded(F.col(c)) for c in FIELDS}
    altered = encoded(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return durable(docs.select(*FIELDS).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("tree"),
        digest(*field.values()).alias("leaf"),
        F.when(remainder("doc_id", 2) == 0, digest(*(field | {"text": altered}).values())).alias("altered"),
    ), "merkle-leaves")


def _before(counts: DataFrame, within: list[str], at: str) -> DataFrame:
    """How many rows the earlier entries of the same directory hold."""
    earlier = Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def directory(rows: DataFrame) -> DataFrame:
    """``tree, word, bits, n, before, size``: the bitmaps of the trees' ids with the rows before each word and in the whole tree."""
    bits = F.coalesce(F.bit_or(F.expr("shiftleft(1L, int(doc_id & 63))")), F.lit(0).cast("long"))
    words = durable(rows.groupBy("tree", "word").agg(bits.alias("bits"), F.count(F.lit(1)).alias("n")), "merkle-words")
    words = words.withColumns({"block": F.shiftright("word", 10), "region": F.shiftright("word", 20)})
    blocks = words.groupBy("tree", "region", "block").agg(F.sum("n").alias("n"))
    regions = blocks.groupBy("tree", "region").agg(F.sum("n").alias("n"))
    regions = _before(regions, ["tree"], "region").withColumn("size", F.sum("n").over(Window.partitionBy("tree")))
    blocks = _before(blocks, ["tree", "region"], "block").alias("b").join(regions.alias("r"), ["tree", "region"])
    blocks = blocks.select("tree", "block", (F.col("b.before") + F.col("r.before")).alias("first"), "size")
    return durable(_before(words, ["tree", "block"], "word").join(blocks, ["tree", "block"]).select(
        "tree", "word", "bits", "n", (F.col("before") + F.col("first")).alias("before"), "size"), "merkle-directory")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place`` (from 0) in their tree by ascending id, and the tree's ``size``."""
    rows = rows.withColumn("word", F.coalesce(F.shiftright("doc_id", 6), F.lit(NULL_WORD)))
    words = directory(rows)
    single = F.col("n") == F.bit_count("bits")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, int(doc_id & 63))")))
    met = rows.join(words, ["tree", "word"])
    kept = [*(c for c in rows.columns if c != "word"), "size"]
    placed = met.where(single).select(*kept, (F.col("before") + below).alias("place"))
    if words.where(~single).isEmpty():
        return placed
    order = [F.col("tree").asc(), F.col("word").asc(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()]
    repeated = dense_positions(met.where(~single).select(*kept, "word", "before"), order, "merkle-repeated")
    first = repeated.groupBy("tree", "word").agg(F.min("position").alias("first"))
    repeated = repeated.join(first, ["tree", "word"]).withColumn("place", F.col("before") + F.col("position") - F.col("first"))
    return placed.unionByName(repeated.select(*kept, "place"))


def _folded(nodes: Column) -> Column:
    """The parents of an array of neighbours."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From ``tree, place, size, hash``: tables of groups from the lowest to the highest, and ``tree, hash`` of the roots.

    A group holds its nodes and their next levels (``level0``.. ), and how many levels it folds (``depth``). A tree is done
    at its single node, which passes through the later steps as it is.
    """
    tables: list[DataFrame] = []
    while True:
        depth = F.lit(DEPTH)
        for k in reversed(range(DEPTH)):
            depth = F.when(F.col("size") <= ARITY**k, k).otherwise(depth)
        slots = F.sort_array(F.collect_list(F.struct("place", "hash")))  # at most WIDTH
        groups = nodes.groupBy("tree", F.floor(F.col("place") / WIDTH).cast("long").alias("group")).agg(slots.alias("slots"), F.max("size").alias("size"))
        groups = groups.select("tree", "group", "size", depth.alias("depth"), F.col("slots.hash").alias("level0"))
        for k in range(DEPTH):
            groups = groups.withColumn(f"level{k + 1}", F.when(F.col("depth") > k, _folded(F.col(f"level{k}"))))
        top = reduce(lambda rest, k: F.when(F.col("depth") == k, F.col(f"level{k}")[0]).otherwise(rest), range(DEPTH), F.col(f"level{DEPTH}")[0])
        tables.append(durable(groups.withColumn("top", top).drop(f"level{DEPTH}"), "merkle-groups"))
        above = tables[-1].select("tree", F.col("group").alias("place"), F.ceil(F.col("size") / WIDTH).cast("long").alias("size"), F.col("top").alias("hash"))
        if (above.agg(F.max("size")).first()[0] or 1) == 1:
            return tables, above.select("tree", "hash")
        nodes = above


def _path(slot: Column) -> Column:
    """The siblings left and right of a slot on each level that its group folds."""
    sides = []
    for k in range(DEPTH):
        at = F.floor(slot / ARITY**k).cast("int")
        run = at % ARITY
        level = F.col(f"level{k}")
        sides.append(F.struct(F.array_join(F.slice(level, at - run + 1, run), "").alias("left"),
                              F.array_join(F.slice(level, at + 2, F.lit(ARITY - 1) - run), "").alias("right")))
    return F.slice(F.array(*sides), F.lit(1), F.col("depth"))


def descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest groups with ``above``, the path of each from its top on. ``above``: ``tree, above`` and what else goes down."""
    given = [c for c in above.columns if c not in ("tree", "above")]
    met = tables[-1].join(above, "tree")
    for table in reversed(tables[:-1]):
        slots = met.select("*", F.explode(F.sequence(F.lit(0), F.size("level0") - 1)).alias("slot"))
        handed = slots.select("tree", (F.col("group") * WIDTH + F.col("slot")).alias("group"), F.concat(_path(F.col("slot")), "above").alias("above"), *given)
        met = table.join(handed, ["tree", "group"])
    return met


def with_paths(nodes: DataFrame, lowest: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, from the leaf to the root, and what was handed down."""
    group, slot = F.floor(F.col("place") / WIDTH).cast("long"), (F.col("place") % WIDTH).cast("int")
    met = nodes.withColumns({"group": group, "slot": slot}).join(lowest.drop("size", "top"), ["tree", "group"])
    path = F.concat(_path(F.col("slot")), F.col("above")).alias("path")
    return met.select(*nodes.columns, path, *[c for c in lowest.columns if c in ("subroot", "root")])


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id``, ``leaf``, ``subroot`` of its source, ``root``, and its ``path``; with ``altered`` for tampered rows."""
    nodes = durable(ranked(leaves(docs)), "merkle-nodes")
    tables, subroots = climb(nodes.select("tree", "place", "size", F.col("leaf").alias("hash")))
    # The sources' places in their order, then the one tree above them; each source is handed its path and the roots.
    sources = dense_positions(subroots.withColumnRenamed("tree", "source_key"), [F.col("source_key").asc()], "merkle-sources", "place")
    sources = sources.select("source_key", F.lit("").alias("tree"), "place", F.col("hash"), F.lit(sources.count()).cast("long").alias("size"))
    upper, root = climb(sources)
    top = with_paths(sources, descend(upper, root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("above"), F.col("hash").alias("root"))))
    above = top.select(F.col("source_key").alias("tree"), F.col("path").alias("above"), F.col("hash").alias("subroot"), "root")
    return with_paths(nodes, descend(tables, above))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, at: digest(at["left"], node, at["right"]))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and whether each row, some of them tampered with, still proves the root."""
    rows = manifest(docs)
    proof = F.sha2(F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), ""), 256)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
