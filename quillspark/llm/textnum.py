"""Words and hashes of many texts at once, on the bytes of Arrow arrays.

All functions here see whole texts. A batch is cut between rows only, into
pieces of about ``LIMIT`` bytes, so that memory follows one piece (or the one
longest text), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LIMIT = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    z = x ^ (x >> _U(30))
    z *= _U(0xBF58476D1CE4E5B9)
    z ^= z >> _U(27)
    z *= _U(0x94D049BB133111EB)
    z ^= z >> _U(31)
    return z


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 19)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=_U)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice ``values[start:end]``, from one prefix sum modulo 2**64."""
    up, down = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    out = prefix[ends] - prefix[starts]
    out *= down[starts]
    out += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(out)


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbours; the last n-1 places are left out."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = np.full(len(hashes) - n + 1, _U(n))
    for k in range(n):
        out *= _BASE
        out += hashes[k : k + len(out)]
    return mix(out)


#: Byte classes and values. A-Z count as a-z everywhere.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER = _LOWER
VALUES = mix(_LOWER.astype(_U) + _U(1))
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """The batch's rows in slices of at most ``limit`` bytes of text, or of one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(raw(batch.column(column))[1]))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each begins; a null is empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    if not wide and not pa.types.is_string(array.type):
        array, wide = array.cast(pa.large_string()), True
    _, where, data = array.buffers()
    kind = np.int64 if wide else np.int32
    if not len(array) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of texts: byte spans in ``data``, and the range of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE):
        n = len(data)
        is_word = inside[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = is_word
        here = np.zeros(n + 1, bool)
        here[:n] = is_word
        self.data = data
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(VALUES[self.data], self.starts, self.ends)

    def lowered(self, first: int, last: int) -> bytes:
        """Words first to last-1, lower case, with one blank between."""
        return b" ".join(LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes() for i in range(first, last))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
