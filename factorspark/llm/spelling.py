"""Spelling variants: words one edit apart, grouped under their most frequent form, found on relational tries.

The vocabulary's trie is a table with a row for each node where words part or end (the root included), and in each row the edges to
the next such nodes: letters in between are part of the edge's label. Frontier states are ``(word, pos, node, edits)``. Those without an edit
are the nodes on the word's own path. There a state tries

* a replaced code point: the other edges whose label, but for its first code point, continues the word. Only larger code points are
  tried, since the pair is met once from each side;
* a deleted code point: the edge that continues the word after it. Only the last of equal neighbours is deleted, so a pair is met once.

Where labels part from the word no other word can follow, so edits happen at nodes alone. A state with its edit is joined with the trie
level by level and must match to the end; there, at the end of a word, the two words are neighbours, taken in both directions (an
insertion is a deletion from the other side). The rounds are as many as nodes lie behind the edit, whatever the word's length.

Near the root a trie branches into everything. So edits of a word's second half are looked for on the trie of the words, those of its
first half on the trie of the reversed words, and both only where branches are few.

The keys of nodes are 64-bit hashes of their prefixes: prefixes that collided would be one node and only add pairs, and every pair is
compared exactly before it counts. Nodes are met by a shuffled join; one that many words pass is split by adaptive execution, as its
own side is one row, with an edge a letter at most.

Defined cases: a null or empty text and an empty table have no words. A null id is hashed as an empty text. Repeated rows count
each. Only A-Z are lower-cased. A tie of the largest near words goes to the smallest in code-point order. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, durable

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: One run in so many, by its hash, loses a code point.
NOISE = 199
#: A form is so many times as frequent as its variant.
RATIO = 5
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Rounds of following forms; counts grow by RATIO at each step, so 64-bit counts need fewer.
STEPS = 32


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words of at least LEAST_LENGTH code points, whatever their count.

    Words are counted within each task before the shuffle. Runs shorter than LEAST_LENGTH never become longer and are skipped.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")

    def batch_of(total: Counter[str]) -> pa.RecordBatch:
        found = [(w, n) for w, n in total.items() if n and len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in chunks(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                own = runs.findall(text.encode().lower().decode())  # bytes.lower: A-Z alone
                total.update(own)
                start = zlib.crc32(f"{doc}:".encode())
                changed = {run: h % len(run) for run in set(own) if (h := zlib.crc32(run.encode(), start)) % NOISE == 0}
                if changed:
                    for run, n in Counter(filter(changed.__contains__, own)).items():
                        at = changed[run]
                        total[run] -= n
                        total[run[:at] + run[at + 1:]] += n
            if len(total) > HELD:
                yield batch_of(total)
                total.clear()
        yield batch_of(total)

    return arrow_map(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the frequent words, each with a number of its own."""
    frequent = counted(docs).where(F.col("n") >= LEAST_COUNT)
    return durable(frequent.withColumn("id", F.monotonically_increasing_id()), "spelling-words")


def _prefixes(words: DataFrame) -> DataFrame:
    """``id, depth, key, next``: every prefix of every word by its hash, with the code point after it (empty at the word's end)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "word", 1 << 18):
            ids, depth, key, after = [], [], [], []
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state = xxhash.xxh3_64()
                for d, letter in enumerate([*word, ""]):
                    ids.append(number), depth.append(d), key.append(state.intdigest() - (1 << 63)), after.append(letter)
                    state.update(letter.encode())
                    if len(ids) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(depth, pa.int32()), pa.array(key, pa.int64()), pa.array(after, pa.string())], names)
                        ids, depth, key, after = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(depth, pa.int32()), pa.array(key, pa.int64()), pa.array(after, pa.string())], names)

    names = ["id", "depth", "key", "next"]
    return arrow_map(words.select("id", "word"), cut, "id long, depth int, key long, next string")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``depth, key, end, edges``: a row for each node; ``end`` is the word that ends there, ``edges`` are (label, child's key) by label.

    With it each word's own nodes, ``word, n, path``. A node has at most one edge for each letter. Prefixes are combined within each
    task, so the root is no hot key.
    """
    prefixes = durable(_prefixes(words), "spelling-prefixes")
    ends = F.max(F.when(F.col("next") == "", F.col("id")))
    nodes = prefixes.groupBy("depth", "key").agg(F.min("next").alias("low"), F.max("next").alias("high"), ends.alias("end"))
    nodes = durable(nodes.where("low != high or low = '' or depth = 0").select("depth", "key", "end"), "spelling-nodes")
    passed = prefixes.join(nodes.select("depth", "key"), ["depth", "key"], "left_semi")
    paths = passed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("path"))  # as many as nodes on a word's path
    paths = durable(words.join(paths, "id").select("word", "n", "path"), "spelling-paths")
    steps = paths.select("word", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as a, path[i] as b))")).alias("step"))
    label = F.substring("word", F.col("step.a.depth") + 1, F.col("step.b.depth") - F.col("step.a.depth"))
    edges = steps.select(F.col("step.a.depth").alias("depth"), F.col("step.a.key").alias("key"), F.struct(label.alias("label"), F.col("step.b.key").alias("child")).alias("edge"))
    edges = edges.groupBy("depth", "key").agg(F.array_sort(F.collect_set("edge")).alias("edges"))  # one a letter
    ended = words.select(F.col("id").alias("end"), F.struct("word", "n").alias("ended"))
    nodes = nodes.join(edges, ["depth", "key"], "left").join(ended, "end", "left")
    table = nodes.select("depth", "key", F.col("ended").alias("end"), F.coalesce("edges", F.array().cast(edges.schema["edges"].dataType)).alias("edges"))
    return durable(table, "spelling-trie"), paths


STATE = "struct<pos:int,key:bigint,depth:int,near:string,near_n:bigint>"


def _rest(start: Column | int) -> Column:
    """The state's word after ``start`` code points."""
    return F.substring(F.col("word"), start + F.lit(1), F.length("word"))


def _moved(start: Column) -> Callable[[Column], Column]:
    """To the end of an edge whose label matches the word from ``start`` on."""
    return lambda e: F.struct(
        (start + F.length(e["label"])).cast("int").alias("pos"), e["child"].alias("key"), (F.col("depth") + F.length(e["label"])).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")).cast(STATE)


def _only(condition: Column, rows: Column) -> Column:
    return F.when(condition, rows).otherwise(F.array().cast(f"array<{STATE}>"))


def _along(start: Column) -> Column:
    """The states past the edges whose label continues the word at ``start``: one at most."""
    rest = _rest(start)
    return F.transform(F.filter("edges", lambda e: F.startswith(rest, e["label"])), _moved(start))


def _ended(over: Column) -> Column:
    """The pair of the state's word and the word that ends at its node."""
    return _only(over & F.col("end").isNotNull(), F.array(F.struct("pos", "key", "depth", F.col("end.word"), F.col("end.n")).cast(STATE)))


def edited(states: DataFrame, table: DataFrame, apart: Column) -> DataFrame:
    """The states with one edit that the states without one, ``word, n, pos, key, depth``, make at their nodes.

    ``apart`` says where a deletion is left to the other trie, which finds it as well.
    """
    met = states.join(table, ["depth", "key"])
    pos = F.col("pos")
    letter, following = F.substring("word", pos + 1, F.lit(1)), F.substring("word", pos + 2, F.lit(1))

    def replaced(e: Column) -> Column:
        rest = F.substring(e["label"], F.lit(2), F.length(e["label"]))
        return (F.substring(e["label"], F.lit(1), F.lit(1)) > letter) & F.startswith(_rest(pos + 1), rest)

    swaps = F.transform(F.filter("edges", replaced), _moved(pos))
    deletes = (letter != following) & ~apart
    drops = _only(deletes & (following != ""), _along(pos + 1))
    # The last code point is deleted where the rest is a word.
    return met.select("word", "n", F.explode(F.concat(swaps, drops, _ended(deletes & (following == "")))).alias("to")).select("word", "n", "to.*")


def advance(states: DataFrame, table: DataFrame) -> DataFrame:
    """One round: states with their edit at the children of their nodes and, with ``near``, the pairs of words that ended."""
    met = states.join(table, ["depth", "key"])
    onward = F.concat(_along(F.col("pos")), _ended(F.col("pos") == F.length("word")))
    return met.select("word", "n", F.explode(onward).alias("to")).select("word", "n", "to.*")


def _half(words: DataFrame, least: Column, apart: Column) -> DataFrame:
    """``word, n, near, near_n`` of the pairs whose edit lies at ``least`` or later, each once."""
    table, paths = trie(words)
    states = paths.select("word", "n", F.explode("path").alias("at")).select("word", "n", F.col("at.depth").alias("pos"), F.col("at.key").alias("key"), F.col("at.depth").alias("depth"))
    after = durable(edited(states.where((F.col("pos") >= least) & (F.col("pos") < F.length("word"))), table, apart), "spelling-states")
    found = None
    while True:
        ended = after.where("near is not null").select("word", "n", "near", "near_n")
        found = ended if found is None else found.unionByName(ended)
        states = after.where("near is null").drop("near", "near_n")
        if states.isEmpty():
            return found
        after = durable(advance(states, table), "spelling-states")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all pairs one edit apart, in both directions."""
    middle = F.floor(F.length("word") / 2).cast("int")
    pairs = _half(words, middle, F.lit(False))
    # On the reversed words a run's last letter is its first; where the run reaches the middle, the deletion has been found forwards.
    least = F.length("word") - middle
    run = F.substring("word", least, F.col("pos") - least + 2)
    whole = F.replace(run, F.substring("word", F.col("pos") + 1, F.lit(1)), F.lit("")) == ""
    backward = _half(words.withColumn("word", F.reverse("word")), least, whole)
    pairs = pairs.unionByName(backward.withColumns({"word": F.reverse("word"), "near": F.reverse("near")}))
    pairs = pairs.where(F.levenshtein("word", "near") == 1)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form of every word that has one, by doubling the reach of each step."""
    reach = durable(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(STEPS):
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = durable(reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        reach = after.select("word", "root")
        if after.where("moved").isEmpty():
            return reach
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of the whole table."""
    words = vocabulary(docs)
    # The largest near word is the least by (-n, word).
    best = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best"))
    judged = words.join(best, "word", "left")
    has = -F.col("best.rank") >= RATIO * F.col("n")
    judged = durable(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.rank")).alias("form_n")), "spelling-forms")
    last = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
