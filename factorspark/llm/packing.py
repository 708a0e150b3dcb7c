"""Best-fit decreasing packing of tokenized documents into fixed-length sequences.

Token lengths are whole numbers up to the capacity, so best-fit decreasing over any number of documents is
decided by the histogram of lengths: a segment tree over the remaining capacities finds the tightest open bin in
logarithmic time, and all bins with one remaining capacity are filled by equal documents as a run. The plan is a
table of runs (at most a few per length, whatever the input), and every document finds its sequence from its rank
among the documents of its length. Ranks are counted in salted parts, so one length may hold any share of the rows.

Defined cases: a null or empty text is its end token alone. Repeated rows are packed each by itself. Null ids stay
null. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, chunks, durable, keeps, text_bytes

CAPACITY = 2048
END = 0
#: Parts in which the documents of one length are counted.
SALTS = 256
#: Cached words of one Python worker, in two generations: those met since the last turn and those met before it.
CACHE_WORDS = 800_000
#: Words encoded in one call.
ENCODED = 4096

_TOKENIZERS: dict[str, WordIds] = {}
#: Marks that the tokenizer splits off at a word's end, and words of letters that have one lower case and need no normalisation.
_TAILS = b".,!?:;"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordIds:
    """Ids of a tokenizer that drops white space, word by word through a cache.

    White space always splits such a tokenizer's input, so a text's ids are its words' ids in order. Only words not seen lately reach
    the tokenizer, those of a whole batch of texts together. Words of Latin letters are one piece for the tokenizer, whatever their
    case, and a trailing mark is another: they are encoded in lower case, many in one string, by the same model without its
    normalisation, and told apart by the ids that end a word. All other words are encoded each by itself. Words met again move to
    the new generation, so frequent words stay when the old one goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        rules = json.loads(Path(path).read_text())
        suffix = rules["model"].get("end_of_word_suffix")
        self.plain = None
        if suffix:
            bare = rules | {"normalizer": None, "added_tokens": [], "post_processor": None}
            split, to_bytes = {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
            self.plain = {
                True: Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": split})),  # ASCII letters stand for themselves
                False: Tokenizer.from_str(json.dumps(bare | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, to_bytes]}})),
            }
            self.ends = np.zeros(1 + max(rules["model"]["vocab"].values()), bool)
            self.ends[[i for token, i in rules["model"]["vocab"].items() if token.endswith(suffix)]] = True

    def _encode(self, words: list[bytes]) -> None:
        # In slices: the library's encodings are far larger than the ids kept of them.
        for at in range(0, len(words), ENCODED):
            part = words[at:at + ENCODED]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for word, encoding in zip(part, found, strict=True):
                self.words[word] = array("I", encoding.ids).tobytes()

    def _encode_letters(self, words: list[bytes], ascii_only: bool) -> None:
        """Words of lower-case Latin letters."""
        if self.plain is None:
            return self._encode(words)
        for at in range(0, len(words), ENCODED):
            part = words[at:at + ENCODED]
            ids = np.array(self.plain[ascii_only].encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end every word with its suffix")
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.words.update((word, raw[a:b]) for word, a, b in zip(part, cuts, cuts[1:], strict=False))

    def add(self, words: set[bytes]) -> None:
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.before = {}, self.words
        known, before = self.words, self.before
        # difference() with the dict itself looks up the set's words; its keys view would be walked as a whole.
        unknown = words.difference(known)
        again = {w for w in unknown if w in before}
        known.update((w, before[w]) for w in again)
        unknown -= again
        letters = {w for w in unknown if w.isalpha() and w.islower()}  # bytes.isalpha: ASCII letters only
        cut, others = [], set()
        for word in unknown - letters:
            stem, tail = (word[:-1], word[-1:]) if word[-1] in _TAILS else (word, b"")
            if not stem.isalpha():
                found = _LATIN.fullmatch(stem.decode())
                if not found:
                    others.add(word)
                    continue
                stem = found[0].lower().encode()
            else:
                stem = stem.lower()
            letters.add(stem)
            cut.append((word, stem, tail))
            if tail:
                others.add(tail)
        for kind in (letters, others):
            known.update((w, before[w]) for w in kind.difference(known) if w in before)
        fresh = letters.difference(known)
        for ascii_only in (True, False):
            self._encode_letters([w for w in fresh if w.isascii() is ascii_only], ascii_only)
        self._encode(list(others.difference(known)))
        for word, stem, tail in cut:
            known[word] = known[stem] + known[tail] if tail else known[stem]

    def batch(self, texts: Sequence[bytes | None]) -> Iterator[bytes]:
        """Unsigned 32-bit ids of each text, in the machine's (little-endian) order."""
        words = [(text or b"").split() for text in texts]
        self.add(set().union(*words))
        find = self.words.__getitem__
        return (b"".join(map(find, own)) for own in words)


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
        keeps(__name__, _TOKENIZERS.clear)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut only beyond ``capacity``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = END.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer_ids = word_ids(tokenizer)
        gc.disable()  # millions of small objects and no cycles among them
        try:
            yield from pieces_of(tokenizer_ids, batches)
        finally:
            gc.enable()

    def pieces_of(tokenizer_ids: WordIds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, own in enumerate(tokenizer_ids.batch(text_bytes(batch))):
                ids = own + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(rows, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class TightestFit:
    """Segment tree over the remaining capacities 0..capacity; each leaf tells whether an open bin has that much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        i = self.size + remaining
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def find(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` among the open bins."""
        i = self.size + need
        if self.open[i]:
            return need
        while i > 1:  # up to the first right neighbour with an open bin, then down its left edge
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Documents ``first_rank ..`` of one length: ``per_bin`` to each of the sequences from ``first_bin``, from ``offset``."""

    length: int
    first_rank: int
    last_rank: int
    per_bin: int
    first_bin: int
    offset: int


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over the histogram of lengths, equal documents placed as runs.

    A document goes to the tightest bin that holds it; the next equal one finds the same bin tightest until it is full.
    So the bins with the tightest remaining capacity take ``remaining // length`` documents each, one bin after
    the other, and all but the last of them end alike. The order among bins of one remaining capacity is free.
    """
    tree = TightestFit(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: ranges (first bin, how many)
    runs: list[Run] = []
    opened = 0

    def put(remaining: int, first: int, count: int) -> None:
        if count:
            bins.setdefault(remaining, []).append((first, count))
            tree.set(remaining, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.find(length)
            if remaining is None:
                remaining = capacity
                per = capacity // length
                first, count = opened, -(-left // per)
                opened += count
            else:
                first, count = bins[remaining].pop()
                per = remaining // length
            used = min(count, -(-left // per))
            placed = min(left, used * per)
            runs.append(Run(length, rank, rank + placed - 1, per, first, capacity - remaining))
            full = placed // per
            ends = [(remaining - per * length, first, full), (remaining - (placed - full * per) * length, first + full, used - full), (remaining, first + used, count - used)]
            if remaining in bins and not bins[remaining]:
                del bins[remaining]
                tree.set(remaining, False)
            for rest, at, n in ends:
                put(rest, at, n)
            rank, left = rank + placed, left - placed
    return runs


def place(cut: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with a ``length``; ``cut`` must be a written table, as it is read twice.

    The histogram (at most ``capacity`` rows) is what the driver sees; the plan has a few rows for each length.
    """
    spark = cut.sparkSession
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    parts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(parts.select("length", "_salt", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "packing-parts")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = [(r.length, r.first_rank, r.last_rank, r.per_bin, r.first_bin, r.offset) for r in plan(histogram, capacity)]
    table = spark.createDataFrame(runs, "length long, first_rank long, last_rank long, per_bin long, first_bin long, run_offset long")
    order = Window.partitionBy("length", "_salt").orderBy(*keys)
    ranked = salted.withColumn("_local", F.row_number().over(order) - 1).join(parts.select("length", "_salt", "_before"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_local"))
    # A few runs per length, at most some thousand rows in all: bounded by the capacity.
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & F.col("_rank").between(F.col("first_rank"), F.col("last_rank")))
    at = F.col("_rank") - F.col("first_rank")
    return placed.select(
        *[cut[c] for c in cut.columns],
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + at % F.col("per_bin") * cut["length"]).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(durable(pieces(docs, tokenizer, capacity, id_col, text_col), "packing-pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order (at most ``capacity`` of them) and how full it is."""
    return placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("pieces"), F.sum("length").alias("used"))
