"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Every codepoint gets a class; white space is told apart by
what follows it, apostrophes by whether a contraction follows. A small automaton over these symbols knows which token is
open. Each symbol is a function from states to states; the functions form a finite monoid, so all states come
from an associative scan over its multiplication table: positions are laid out in rows, rows are scanned in parallel column by column,
row totals are scanned by doubling, and one look-up per position tells whether a token starts there.
The slices feed pair merging through a cache; ids stay with their offsets, from which any span can be decoded.

Defined cases: a null or empty text has no tokens. Texts of any length are handled whole; merging a slice of n bytes takes
O(n log n). Repeated rows are encoded each by itself. Null ids stay null. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks

#: Symbols of the automaton. *_LAST: the last white space before other text. CUT1, CUT2: an apostrophe with a contraction of one or two letters after it.
RESET, LETTER, NUMBER, OTHER, SPACE, BLANK, SPACE_LAST, BLANK_LAST, CUT1, CUT2 = range(10)
#: States: what the last character has left open.
START, WORD, DIGITS, MARKS, WHITE, JOINING, ALONE, ONE_MORE, TWO_MORE, ENDED = range(10)
#: Contractions after an apostrophe (fixed values of the pattern).
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: Cached slices of one Python worker; the cache is emptied beyond.
CACHE_SLICES = 600_000
#: Below this many bytes, pairs are looked through one by one.
SHORT = 48
#: Characters worked on at once.
BLOCK = 1 << 20


def _step(state: int, symbol: int) -> int:
    if symbol == RESET:
        return START
    if symbol == LETTER:
        return {TWO_MORE: ONE_MORE, ONE_MORE: ENDED}.get(state, WORD)
    if symbol in (CUT1, CUT2) and state not in (JOINING, MARKS):
        return ONE_MORE if symbol == CUT1 else TWO_MORE
    return {NUMBER: DIGITS, SPACE: WHITE, BLANK: WHITE, SPACE_LAST: JOINING, BLANK_LAST: ALONE}.get(symbol, MARKS)


def _starts(state: int, symbol: int) -> bool:
    """Whether a token starts at ``symbol`` when the characters before it led to ``state``."""
    if symbol == RESET:
        return False
    inside = {LETTER: (WORD, JOINING, ONE_MORE, TWO_MORE), NUMBER: (DIGITS, JOINING), SPACE: (WHITE,), BLANK: (WHITE,), SPACE_LAST: (), BLANK_LAST: ()}
    return state not in inside.get(symbol, (MARKS, JOINING))


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol; product table (first, then second); state of each element from START; starts by (state, symbol)."""
    states = range(10)
    symbol_functions = [tuple(_step(s, x) for s in states) for x in range(10)]
    elements = {tuple(states): 0}
    queue = list(elements)
    while queue:
        f = queue.pop()
        for g in symbol_functions:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    listed = list(elements)
    product = np.array([[elements[tuple(g[s] for s in f)] for g in listed] for f in listed], np.uint8)
    return (np.array([elements[f] for f in symbol_functions], np.uint8), product, np.array([f[START] for f in listed], np.uint8),
            np.array([[_starts(s, x) for x in range(10)] for s in states], bool))


ELEMENT, PRODUCT, STATE, STARTS = _monoid()
_WIDTH = len(PRODUCT)
_PRODUCT = PRODUCT.ravel()


def scan(elements: np.ndarray, row: int = 256) -> np.ndarray:
    """All prefix products of monoid elements."""
    n = len(elements)
    rows = -(-n // row)
    table = np.zeros(rows * row, np.uint8)
    table[:n] = elements
    table = np.ascontiguousarray(table.reshape(rows, row).T)
    for i in range(1, row):
        table[i] = _PRODUCT[table[i - 1].astype(np.intp) * _WIDTH + table[i]]
    total = table[-1].copy()
    shift = 1
    while shift < rows:
        total[shift:] = _PRODUCT[total[:-shift].astype(np.intp) * _WIDTH + total[shift:]]
        shift *= 2
    if rows > 1:
        table[:, 1:] = _PRODUCT[total[:-1].astype(np.intp)[None, :] * _WIDTH + table[:, 1:]]
    return table.T.reshape(-1)[:n]


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE, BLANK or OTHER of every codepoint, from the character database."""
    if not _CLASSES:
        import regex

        every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\p{White_Space}")):
            table[np.frombuffer("".join(regex.findall(name, every)).encode("utf-32-le"), np.uint32)] = kind
        table[0x20] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def boundaries(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by a separator, where tokens start and end in it, and each token's text number."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    symbols = classes()[codes]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    symbols[ends] = RESET
    white = (symbols == SPACE) | (symbols == BLANK)
    last = np.zeros(len(symbols), bool)
    last[:-1] = white[:-1] & ~white[1:] & (symbols[1:] != RESET)
    symbols[last] += SPACE_LAST - SPACE
    marks = np.flatnonzero(codes == 0x27)
    if len(marks):
        after = codes[np.minimum(marks[:, None] + [1, 2], len(codes) - 1)]
        two = np.zeros(len(marks), bool)
        for a, b in TWO_LETTERS:
            two |= (after[:, 0] == ord(a)) & (after[:, 1] == ord(b))
        symbols[marks[np.isin(after[:, 0], list(map(ord, ONE_LETTER)))]] = CUT1
        symbols[marks[two]] = CUT2
    states = STATE[scan(ELEMENT[symbols])]
    before = np.empty_like(states)
    before[0], before[1:] = START, states[:-1]
    starts = np.flatnonzero(STARTS[before, symbols])
    stops = np.empty_like(starts)
    stops[:-1] = starts[1:]
    if len(starts):
        stops[-1] = len(symbols) - 1
    owner = np.searchsorted(ends, starts)
    return joined, starts, np.minimum(stops, ends[owner]) if len(starts) else stops


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair of the lowest rank, leftmost first, is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) <= SHORT:
        get, none = ranks.get, 1 << 60
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in itertools.pairwise(parts)]
        while pairs:
            rank = min(pairs)
            if rank == none:
                break
            at = pairs.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        return [ranks[p] for p in parts]
    n = len(piece)
    stop = list(range(1, n + 1))  # end of the part that starts here; 0 once it is merged into an earlier one
    previous = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)

    def offer(a: int) -> None:
        b = stop[a]
        if b < n and (r := ranks.get(piece[a:stop[b]])) is not None:
            heapq.heappush(heap, (r, a, stop[b]))

    while heap:
        _, a, end = heapq.heappop(heap)
        b = stop[a]
        if not b or b >= n or stop[b] != end:
            continue  # one of the two parts has changed since
        stop[a], stop[b] = end, 0
        if end < n:
            previous[end] = a
        offer(a)
        if previous[a] >= 0:
            offer(previous[a])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:stop[at]]])
        at = stop[at]
    return out


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.parts: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for part, rank in self.ranks.items():
            self.parts[rank] = part
        self.lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's ids end."""
        joined, starts, stops = boundaries(texts)
        cache = self.cache
        if len(cache) > CACHE_SLICES:
            cache.clear()
        slices = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        for piece in set(slices).difference(cache):
            cache[piece] = array("I", merged(piece.encode(), self.ranks)).tobytes()
        found = list(map(cache.__getitem__, slices))
        ids = np.frombuffer(b"".join(found), "<u4")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        counts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)))
        return ids, counts[np.searchsorted(starts, ends)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of every token in the decoded bytes, and their end."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids.tolist()))


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def encoded(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: token ids of every whole text, and each token's byte offset (one more: the text's length)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        for batch in chunks(batches, limit=BLOCK):
            ids, ends = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            cuts = np.concatenate(([0], ends))
            offsets = [bpe.offsets(ids[a:b]) for a, b in itertools.pairwise(cuts.tolist())]
            at = np.concatenate(([0], np.cumsum([len(x) for x in offsets])))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(offsets)))], ["doc_id", "ids", "offsets"])

    return arrow_map(rows, run, f"doc_id {kind}, ids array<int>, offsets array<long>")


def decoded(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes``: what the ids stand for; null where the ids are null."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        for batch in batches:
            out = [None if ids is None else bpe.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return arrow_map(rows, run, f"doc_id {kind}, bytes binary")


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text; ids and bytes stay in the task."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        shown = list(map(str, range(len(bpe.parts))))
        for batch in chunks(batches, limit=BLOCK):
            ids, ends = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
            counts, first, second = [], [], []
            for a, b in itertools.pairwise([0, *ends.tolist()]):
                own = ids[a:b].tolist()
                counts.append(b - a)
                first.append(hashlib.sha256(" ".join(map(shown.__getitem__, own)).encode()).hexdigest())
                second.append(hashlib.sha256(b"".join(map(bpe.parts.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first), pa.array(second)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
