"""Elias-Fano sequences in numpy: compact monotone integers with vectorised access and successor search, and their files."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Mapping
from urllib.parse import urlparse

import numpy as np

_U = np.uint64
_ONES = _U(0x0101010101010101)
_TOPS = _U(0x8080808080808080)
#: Position of the r-th one in a byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()


def _in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th one (from 0) of each word."""
    s = w - ((w >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    upto = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    shift = np.bitwise_count((((r * _ONES) | _TOPS) - upto) & _TOPS).astype(_U) * _U(8)
    before = ((upto << _U(8)) >> shift) & _U(255)
    return shift + _IN_BYTE[(((w >> shift) & _U(255)) * _U(8) + r - before).astype(np.intp)]


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray, flip: bool) -> np.ndarray:
    """Bit position of the i-th one, or zero if ``flip``; ``before`` counts those before each word.

    The word is found by bisection, so a long run of the other bit costs no steps.
    """
    word = np.searchsorted(before, i.astype(before.dtype), side="right") - 1
    w = words[word]
    return word.astype(_U) * _U(64) + _in_word(~w if flip else w, i.astype(_U) - before[word].astype(_U))


class EliasFano:
    """``values`` in non-decreasing order, all below ``universe``."""

    FIELDS = ("low", "high", "ones", "zeros")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            rest = values & ((_U(1) << _U(bits)) - _U(1))
            place = np.arange(n, dtype=_U) * _U(bits)
            word, off = (place >> _U(6)).astype(np.intp), place & _U(63)
            np.bitwise_or.at(low, word, rest << off)
            over = off + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (_U(64) - off[over]))
        total = (max(universe, 1) - 1 >> bits) + 1 + n
        flags = np.zeros(-(-total // 64) * 64 + 64, np.uint8)
        flags[((values >> _U(bits)) + np.arange(n, dtype=_U)).astype(np.intp)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8").astype(_U)
        ones = np.cumsum(np.bitwise_count(high), dtype=np.uint32) - np.bitwise_count(high)
        return cls(n, bits, low, high, ones, np.arange(len(high), dtype=np.uint32) * np.uint32(64) - ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        place = i.astype(_U) * _U(self.bits)
        word, off = (place >> _U(6)).astype(np.intp), place & _U(63)
        upper = (self.low[word + 1] << _U(1)) << (_U(63) - off)  # two shifts: 64 at once is undefined
        return ((self.low[word] >> off) | upper) & ((_U(1) << _U(self.bits)) - _U(1))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((_select(self.high, self.ones, i, False) - i.astype(_U)) << _U(self.bits)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of x among the elements ``first .. end - 1``, or -1: the successor of x there, if it equals x."""
        x = x.astype(_U)
        upper = x >> _U(self.bits)
        both = np.concatenate([np.maximum(upper, _U(1)) - _U(1), upper])
        zeros = _select(self.high, self.zeros, both, True) - both
        lo = np.maximum(np.where(upper == 0, _U(0), zeros[:len(x)]).astype(np.int64), first)
        stop = np.minimum(zeros[len(x):].astype(np.int64), end)
        hi = stop.copy()
        want = x & ((_U(1) << _U(self.bits)) - _U(1))
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self._low(mid) < want[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        found = np.full(len(x), -1, np.int64)
        inside = np.flatnonzero(lo < stop)
        equal = inside[self._low(lo[inside]) == want[inside]]
        found[equal] = lo[equal]
        return found

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.{f}": getattr(self, f) for f in self.FIELDS} | {f"{name}.size": np.array([self.n, self.bits])}

    @classmethod
    def of(cls, arrays: Mapping[str, np.ndarray], name: str) -> EliasFano:
        n, bits = arrays[f"{name}.size"].tolist()
        return cls(n, bits, *(arrays[f"{name}.{f}"] for f in cls.FIELDS))


def write_arrays(folder: str, name: str, arrays: Mapping[str, np.ndarray]) -> str:
    """Write named arrays as one new file of the shared folder, aligned for mapping; returns its address.

    The name is new for every attempt, so a task that is run again leaves the files of others alone.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    header, at = {}, 0
    for key, a in arrays.items():
        header[key] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(header).encode()
    file = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{file}") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        out.write(b"\0" * (-(8 + len(head)) % 64))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    return f"{folder.rstrip('/')}/{file}"


_MAPPED: dict[str, dict[str, np.ndarray]] = {}


def map_arrays(address: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. From a store that cannot be mapped, the file is fetched once into the worker's own folder."""
    if address in _MAPPED:
        return _MAPPED[address]
    parsed = urlparse(address)
    path, fetched = parsed.path if parsed.scheme in ("", "file") else "", ""
    if not path:
        from pyarrow import fs

        system, remote = fs.FileSystem.from_uri(address)
        handle, path = tempfile.mkstemp()
        fetched = path
        with os.fdopen(handle, "wb") as out, system.open_input_stream(remote) as source:
            while part := source.read(1 << 20):
                out.write(part)
    whole = np.memmap(path, np.uint8, "r")
    if fetched:
        os.unlink(fetched)  # the mapping keeps it until the worker ends
    size = int(whole[:8].view("<u8")[0])
    start = -(-(8 + size) // 64) * 64
    header = json.loads(whole[8:8 + size].tobytes())
    out = {}
    for key, (kind, n, at) in header.items():
        kind = np.dtype(kind)
        out[key] = np.asarray(whole[start + at:start + at + n * kind.itemsize]).view(kind)
    if len(_MAPPED) > 100_000:
        _MAPPED.clear()
    _MAPPED[address] = out
    return out
