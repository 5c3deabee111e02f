"""Line dedup across documents: exact and fuzzy repeats of lines keep one occurrence.

Lines (split at ``\n``) are normalised: A-Z become a-z, digits become 0, runs of
other ASCII signs separate words, words are joined by one blank. Lines without a
word are layout and always stay. Lines of one normal form are one node. Two
nodes are linked if the edit similarity of the normal forms, 1 - edits / longer
length, is at least ``SIMILARITY`` (0.8). Of each connected group the first
occurrence stays, by doc_id and line number.

Candidates come from SimHashes by blocks. Block c of a line's hash is the 32-bit
SimHash of those of its words whose hash falls into share c of 2**j shares, so a
changed word touches two blocks at most, and of two lines that differ in k words
all blocks but 2k agree (pigeonhole). Lines of ``SHORT`` (24) words or more use so
many shares that each holds three to six words, the first ``SHARES`` (8) of them,
and those of 0.8 times as many words too; shorter lines use 8 shares, joined in
neighbouring pairs. Lines that agree in a block are candidates if the SimHashes
over all their words are within ``DISTANCE`` (16) of 64 bits, and within twice that
of 128 bits once their texts are there. Only hashes are
dealt out at first. Lines whose hash has a partner are then dealt out with their
text and verified by edits, and a bucket gives out a spanning forest of its
links, not its pairs. Buckets above ``BLOCK`` lines are cut into blocks: links
inside a block, then between the blocks' first lines, and at last, for keys whose
lines are still in several groups, all pairs of blocks.

Which pairs are found: every link given out is verified, but pairs of which each
block holds a changed word are missed (README has the measured recall: lines of
few words, and lines with a changed letter in nearly every word).

Defined cases: a null or empty text has no lines with words and stays as it is; a
document all of whose lines with words were dropped has an empty ``text``
(:func:`drop_repeated_lines` leaves such documents out); rows with one doc_id and
one text count as one document and lose the same lines, rows with one doc_id and
different texts are documents of their own; a null doc_id comes first; ties go to
the least text hash; an
empty table gives an empty result; a long text is read by its lines, in pieces,
so memory follows its longest line; ``docs`` may have any other columns, of which
only n_lines and n_dropped are replaced (by :func:`dedup_lines`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.components import components
from quillspark.llm.durable import durable, light
from quillspark.llm.textnum import LIMIT, Words, mix, pieces, raw, signed, span_hashes

#: Bits of the SimHash over a whole line in which candidates may differ.
DISTANCE = 16
_BASIS = np.uint64(0x6A09E667F3BCC909)
SIMILARITY = 0.8
#: Words from which a line's blocks stand alone, words in a block at least, blocks of a line at most.
SHORT, LEAST, SHARES = 24, 3, 8
#: Lines of one bucket that meet in one task.
BLOCK = 4096
#: One line in so many is counted to find the buckets above BLOCK.
COUNTED = 16
_CACHE_BITS = 18
_U = np.uint64
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = 48
_NORMAL[65:91] = _NORMAL[97:123] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)
_WORD = _NORMAL != 32
_TABLE = _NORMAL.tobytes()
_NORMAL_VALUES = mix(_NORMAL.astype(_U) + _U(1))
#: For each byte: its eight bits as eight counters of eight bits.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], _U)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins (a line ends before the next one's newline), and the range of lines of each text."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.sort(np.concatenate((breaks, offsets[:-1])), kind="stable")
    return starts, np.searchsorted(breaks, offsets[:-1], "left") + np.arange(len(offsets) - 1)


def _sim_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 8) -> np.ndarray:
    """SimHash (of ``size`` bytes) of each non-empty range of word hashes: the majority of each bit (a tie is 0)."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    parts = (sizes + 254) // 255  # eight-bit counters hold 255 words
    first, cuts, single = np.cumsum(parts) - parts, starts, bool((parts == 1).all())
    if not single:
        owner = np.repeat(np.arange(len(sizes)), parts)
        cuts = starts[owner] + 255 * (np.arange(len(owner)) - np.repeat(first, parts))
    signs, half = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), (sizes >> 1)[:, None]
    if single:
        half = half.astype(np.uint8)
    out = np.zeros((len(sizes), 8), np.uint8)
    for byte in range(size):
        ones = np.add.reduceat(_SPREAD[signs[:, byte]], cuts).view(np.uint8).reshape(-1, 8)
        if not single:
            ones = np.add.reduceat(ones.astype(np.int64), first, axis=0)
        out[:, byte] = np.packbits(ones > half, axis=1, bitorder="little")[:, 0]
    return out.view(_U).ravel()


def _blocks(line: np.ndarray, share: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words sorted by line and share: line, share, SimHash and word count of each block."""
    first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (share[1:] != share[:-1]))))
    edges = np.concatenate((first, [len(line)]))
    return line[first], share[first], _sim_hashes(feature, edges, 4), np.diff(edges)


def _level(words: np.ndarray) -> np.ndarray:
    """Log of the number of shares of lines of so many words; 0: a short line."""
    return np.where(words < SHORT, 0, np.log2(np.maximum(words, SHORT) / LEAST).astype(np.int64))


def _block_keys(line: np.ndarray, place: np.ndarray, feature: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all blocks; words come sorted by line and ``place``, 40 bits that say the share."""
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    level = _level(words)
    lower = _level(np.ceil(words * SIMILARITY))  # a line that has lost words may have fewer shares
    for at, use in ((level, level > 0), (lower, (lower > 0) & (lower != level))):
        share = (place >> (40 - at[line]).astype(_U)).astype(np.int64)
        chosen = use[line] & (share < SHARES)
        if chosen.any():
            of, share, sim, size = _blocks(line[chosen], share[chosen], feature[chosen])
            full = size >= LEAST
            lines.append(of[full])
            keys.append(mix(sim[full] + (share[full] + 64 * at[of[full]]).astype(_U) * _U(0x9E3779B97F4A7C15)))
    short = (level == 0) | (lower == 0)
    chosen = short[line]
    if chosen.any():
        of, share, sim, size = _blocks(line[chosen], (place[chosen] >> _U(37)).astype(np.int64), feature[chosen])
        rows = np.flatnonzero(short)
        row = np.searchsorted(rows, of)
        sims, sizes = np.zeros((len(rows), 8), _U), np.zeros((len(rows), 8), np.int64)
        sims[row, share], sizes[row, share] = sim, size
        least = np.maximum(2, 0.15 * words[rows])
        for a in range(8):
            b = (a + 1) % 8
            full = sizes[:, a] + sizes[:, b] >= least
            lines.append(rows[full])
            keys.append(mix(mix(sims[full, a] + _U(a)) + sims[full, b]))
    return np.concatenate(lines), np.concatenate(keys)


class LineBatch:
    """The lines with words of texts: text and line number, normal form's hash, SimHash, and the keys of the blocks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, first_line = _lines(data, offsets)
        edges = np.concatenate((starts, [len(data)]))
        found = Words(data, edges, _WORD)
        hashes = span_hashes(_NORMAL_VALUES[data], found.starts, found.ends)
        full = np.flatnonzero(found.counts)
        bounds, words = np.concatenate((found.bounds[full], [len(found)])), found.counts[full]
        self.text = np.searchsorted(first_line, full, "right") - 1
        self.line = full - first_line[self.text]
        self.line_hash = self.sim_hash = np.zeros(0, _U)
        self._words = np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
        if not len(full):
            return
        self.line_hash = span_hashes(hashes, bounds[:-1], bounds[1:])
        ordered = np.sort(np.repeat(np.arange(len(full)), words).astype(_U) << _U(40) | hashes >> _U(24))
        line, place = (ordered >> _U(40)).astype(np.int64), ordered & _U((1 << 40) - 1)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        again = np.arange(len(ordered)) - np.repeat(first, np.diff(np.concatenate((first, [len(ordered)]))))
        feature = mix(place + _U(1) + (again.astype(_U) << _U(41)))  # a word's second occurrence is a feature of its own
        self.sim_hash = _sim_hashes(feature, bounds)
        self._bounds = bounds
        self._words = line, place, feature, words

    def second_hash(self) -> np.ndarray:
        """The other 64 bits of the SimHash of each line."""
        return _sim_hashes(mix(self._words[2] ^ _BASIS), self._bounds)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of all blocks."""
        return _block_keys(*self._words)

    def key_lists(self, fresh: np.ndarray) -> pa.Array:
        """The keys of each line, none for lines that are not ``fresh``."""
        line, key = self.keys()
        own = fresh[line]
        line, key = line[own], key[own]
        order = np.argsort(line, kind="stable")
        ends = np.searchsorted(line[order], np.arange(len(fresh) + 1))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(key[order])))


def line_batches(column: pa.Array) -> Iterator[tuple[LineBatch, int]]:
    """Line batches with the number of their first line; one long text is cut between lines."""
    data, offsets = raw(column)
    if len(offsets) != 2 or len(data) <= LIMIT:
        yield LineBatch(data, offsets), 0
        return
    breaks = np.flatnonzero(data == 10)
    begin = line = 0
    while begin < len(data):
        k = int(np.searchsorted(breaks, begin + LIMIT))
        end = int(breaks[k]) if k < len(breaks) else len(data)
        yield LineBatch(data[begin:end], np.array([0, end - begin])), line
        begin, line = end + 1, k + 1


def normal_form(line: str) -> str:
    return b" ".join(line.encode().translate(_TABLE).split()).decode()


def edits(a: Sequence, b: Sequence, most: int | None = None) -> int:
    """Levenshtein distance, a column of bits at a time (Myers' method on Python integers); if above ``most``, any number above it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[object, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    left, most = len(b), len(a) + len(b) if most is None else most
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        y = ((((eq & up) + up) ^ up) | eq) & mask
        plus, minus = down | (mask & ~(y | up)), up & y
        if plus & top:
            score += 1
        if minus & top:
            score -= 1
        left -= 1
        if score - left > most:  # each column to come lowers it by one at most
            return score - left
        plus, minus = (plus << 1 | 1) & mask, (minus << 1) & mask
        up, down = minus | (mask & ~(x | plus)), plus & x
    return score


def _common(a: str, b: str, end: bool) -> int:
    """Length of the common beginning (or end) of two texts, by bisection."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        k = (low + high + 1) // 2
        if a[len(a) - k :] == b[len(b) - k :] if end else a[:k] == b[:k]:
            low = k
        else:
            high = k - 1
    return low


def _word_cost(a: str, b: str) -> int:
    """No fewer edits than turn one word into another: what lies between their common ends is replaced."""
    longer, least = max(len(a), len(b)), min(len(a), len(b))
    first = 0
    while first < least and a[first] == b[first]:
        first += 1
    last = 0
    while last < least - first and a[-1 - last] == b[-1 - last]:
        last += 1
    return longer - first - last


#: Words that may be skipped on both sides together before an alignment agrees again.
AHEAD = 8
_SKIPS = [(p, d - p) for d in range(1, AHEAD + 1) for p in sorted(range(d + 1), key=lambda p, d=d: abs(d - 2 * p))]


def _aligned(x: list[str], y: list[str], most: int) -> bool:
    """Whether one alignment of the words, found by looking a few words ahead, needs at most ``most`` edits: then the distance is no greater. False says nothing."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p = q = 1
        for k, t in _SKIPS:
            u, v = i + k, j + t
            if u < n and v < m and x[u] == y[v] and (u + 1 == n or v + 1 == m or x[u + 1] == y[v + 1]):
                p, q = k, t
                break
        if p == q:
            cost += sum(map(_word_cost, x[i : i + p], y[j : j + q]))
        else:
            cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most:
            return False
        i, j = i + p, j + q
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


def _at_a_glance(a: str, b: str, similarity: float) -> bool | None:
    """Whether two normal forms are alike, where their lengths or one alignment of the words say so; else None."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < similarity * longer:
        return False
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q) <= (1 - similarity) * longer:
        return True  # replacing those words is enough
    return _aligned(x, y, int((1 - similarity + 1e-12) * longer)) or None


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Two texts without their common beginning and end."""
    first = _common(a, b, False)
    a, b = a[first:], b[first:]
    last = _common(a, b, True)
    return a[: len(a) - last], b[: len(b) - last]


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Edit similarity of two normal forms."""
    told = _at_a_glance(a, b, similarity)
    if told is not None:
        return told
    most = int((1 - similarity + 1e-12) * max(len(a), len(b)))
    a, b = _trimmed(a, b)
    if max(len(a), len(b)) <= most:
        return True
    return edits(a, b, most) <= most


#: Entries of the table of signs of pairs that are measured side by side; pairs from which, and blocks of 64 signs up to which that pays.
SIGNS, SIDE_BY_SIDE, LONG = 1 << 19, 12, 32


def edits_of_pairs(pairs: list[tuple[str, str]]) -> list[int]:
    """Levenshtein distances of pairs of non-empty texts, those of about one length side by side."""
    out, at = [0] * len(pairs), 0
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    while at < len(order):
        to, signs, most, longest = at, set(), 64 + 5 * len(pairs[order[at]][1]) // 4, 0
        while to < len(order) and len(pairs[order[to]][1]) <= most:
            a = pairs[order[to]][0]
            more, longer = signs.union(a), max(longest, len(a))
            if to > at and (to + 1 - at) * (longer // 64 + 1) * (len(more) + 1) > SIGNS:
                break
            to, signs, longest = to + 1, more, longer
        some = [pairs[k] for k in order[at:to]]
        # few or long texts are faster on Python's integers
        found = _side_by_side(some) if len(some) >= SIDE_BY_SIDE and longest <= 64 * LONG else [edits(a, b) for a, b in some]
        for k, n in zip(order[at:to], found, strict=True):
            out[k] = n
        at = to
    return out


def _side_by_side(pairs: list[tuple[str, str]]) -> list[int]:
    """Myers' method on blocks of 64 rows (Hyyro): in step t, block w of each pair has column t - w, so what block w - 1 gave out the step before comes in.

    All pairs end in the same column: before a shorter text begins nothing agrees and nothing comes in, which leaves its blocks as they are.
    """
    n = len(pairs)
    rows, columns = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    codes = [np.frombuffer("".join(p[k] for p in pairs).encode("utf-32-le"), np.uint32) for k in (0, 1)]
    signs = np.unique(codes[0])
    kinds, blocks, width = len(signs) + 1, (int(rows.max()) + 63) // 64, int(columns.max())
    owner, inner = np.repeat(np.arange(n), rows), np.arange(len(codes[0])) - np.repeat(np.cumsum(rows) - rows, rows)
    table = np.zeros(blocks * n * kinds, _U)
    np.add.at(table, ((inner >> 6) * n + owner) * kinds + np.searchsorted(signs, codes[0]), _U(1) << (inner & 63).astype(_U))
    sign = np.minimum(np.searchsorted(signs, codes[1]), len(signs) - 1)
    sign = np.where(signs[sign] == codes[1], sign, len(signs))
    text = np.full((width, n), len(signs))  # the last column first: a step's signs are neighbours
    text[np.repeat(np.cumsum(columns), columns) - 1 - np.arange(len(sign)), np.repeat(np.arange(n), columns)] = sign
    begun = (np.arange(width)[:, None] >= width - columns).astype(_U)  # the row above the first grows by one a column
    base = np.arange(blocks * n).reshape(blocks, n) * kinds
    up, down = np.full((blocks, n), ~_U(0)), np.zeros((blocks, n), _U)
    plus_in, minus_in = np.zeros((blocks + 1, n), _U), np.zeros((blocks + 1, n), _U)
    one, top = _U(1), _U(63)
    for t in range(width + blocks - 1):
        lo, hi = max(0, t - width + 1), min(blocks, t + 1)
        u, d, m_in = up[lo:hi], down[lo:hi], minus_in[lo:hi]
        if not lo:
            plus_in[0] = begun[t]
        eq = table.take(base[lo:hi] + text[width - 1 - t + lo : width - 1 - t + hi])
        v = eq | d
        eq |= m_in
        h = eq & u
        h += u
        h ^= u
        h |= eq
        plus = h | u
        np.invert(plus, out=plus)
        plus |= d
        h &= u
        p_out, m_out = plus >> top, h >> top
        plus <<= one
        plus |= plus_in[lo:hi]
        h <<= one
        h |= m_in
        plus_in[lo + 1 : hi + 1], minus_in[lo + 1 : hi + 1] = p_out, m_out
        np.bitwise_and(plus, v, out=d)
        plus |= v
        np.invert(plus, out=plus)
        np.bitwise_or(h, plus, out=u)
    left = np.clip(rows - 64 * np.arange(blocks)[:, None], 0, 64)
    mask = np.where(left == 64, ~_U(0), (one << (left & 63).astype(_U)) - one)
    return (columns + (np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask)).sum(axis=0)).tolist()


def all_alike(pairs: list[tuple[str, str]], similarity: float = SIMILARITY) -> list[bool]:
    """:func:`alike` of pairs of which a glance says nothing."""
    most = [int((1 - similarity + 1e-12) * max(len(a), len(b))) for a, b in pairs]
    cut = [_trimmed(a, b) for a, b in pairs]
    far = [k for k, (a, b) in enumerate(cut) if max(len(a), len(b)) > most[k]]
    out = [True] * len(pairs)
    measured = [k for k in far if cut[k][0] and cut[k][1]]
    for k in far:
        out[k] = False
    for k, n in zip(measured, edits_of_pairs([cut[k] for k in measured]), strict=True):
        out[k] = n <= most[k]
    return out


class Grams:
    """Counts of pairs of neighbouring signs in normal forms: an edit changes at most four of them."""

    KINDS = 256

    def __init__(self, forms: pa.Array):
        texts = forms.to_pylist()
        size = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        kind = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(24)
        owner = np.repeat(np.arange(len(size)), size)
        inside = owner[1:] == owner[:-1]
        self.size = size
        self.counts = np.bincount(owner[:-1][inside] * self.KINDS + kind[inside], minlength=len(size) * self.KINDS).reshape(-1, self.KINDS).astype(np.int32)

    def may_be_alike(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """False only for pairs of places that are too many edits apart."""
        most = np.floor((1 - similarity + 1e-12) * np.maximum(self.size[a], self.size[b]))
        changed = [np.abs(self.counts[a[k : k + 8192]] - self.counts[b[k : k + 8192]]).sum(axis=1) for k in range(0, len(a), 8192)]
        return np.concatenate([np.zeros(0, np.int64), *changed]) <= 4 * most


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normal forms of the wanted lines, beside what is known of them."""
    for batch in (some for whole in batches for some in pieces(whole)):
        wanted = batch.column("wanted")
        flat, sizes = wanted.flatten(), wanted.value_lengths().to_pylist()
        numbers, out = iter(flat.field("line").to_pylist()), []
        for text, n in zip(batch.column("text").to_pylist(), sizes, strict=True):
            lines = (text or "").split("\n")
            out += [normal_form(lines[next(numbers)]) for _ in range(n)]
        for lo in range(0, len(out), 4096):
            part, forms = flat.slice(lo, 4096), pa.array(out[lo : lo + 4096], pa.string())
            yield pa.RecordBatch.from_arrays([part.field("line_hash"), part.field("sim"), part.field("keys"), forms, pa.array(signed(LineBatch(*raw(forms)).second_hash()))], ["line_hash", "sim", "keys", "form", "sim2"])


#: Rows from which a bucket is compared by itself; pairs compared in one step, and pairs given out at once.
LARGE, TILE, GIVEN = 64, 1 << 17, 4096


def _near_pairs(cell: np.ndarray, sim: np.ndarray, distance: int, done: np.ndarray, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of one bucket whose hashes are close; pairs equal in ``done``, which the caller may change between steps, or in ``part`` are left out.

    All buckets go together through pairs of neighbours, and small ones through all steps. What is left of a large one
    is compared as tiles of a matrix, which reads its hashes in order: its pairs grow with the square of its rows.
    """
    sim, at, step = sim.view(_U), np.arange(len(cell)), 1
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    ends = np.concatenate((first[1:], [len(cell)]))
    which = np.repeat(np.arange(len(first)), ends - first)
    large = ends - first >= LARGE
    while True:
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        if step == 9:
            at = at[~large[which[at]]]
        if step % 8 == 1 and len(at):  # buckets that have become one leave
            at = at[(np.minimum.reduceat(done, first) != np.maximum.reduceat(done, first))[which[at]]]
        if not len(at):
            break
        open_ = at[done[at] != done[at + step]]
        near = open_[np.bitwise_count(sim[open_] ^ sim[open_ + step]) <= distance]
        if part is not None:
            near = near[part[near] != part[near + step]]
        if len(near):
            yield near, near + step
        step += 1
    for low, end in zip(first[large].tolist(), ends[large].tolist(), strict=True):
        while low < end - 9:
            if (done[low:end] == done[low]).all():
                break
            high = min(end, low + max(1, TILE // (end - low)))
            row, column = np.nonzero(np.bitwise_count(sim[low:high, None] ^ sim[None, low + 9 : end]) <= distance)
            later = column >= row  # at least nine places apart: nearer ones have been seen
            a, b = row[later] + low, column[later] + low + 9
            if part is not None:
                apart = part[a] != part[b]
                a, b = a[apart], b[apart]
            for k in range(0, len(a), GIVEN):
                x, y = a[k : k + GIVEN], b[k : k + GIVEN]
                open_ = done[x] != done[y]
                if open_.any():
                    yield x[open_], y[open_]
            low = high


def _partnered(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, sim) sorted by cell: those that another hash of their bucket is close to."""
    for rows in _whole_buckets(batches):
        cell, sim = rows.column("cell").to_numpy(), rows.column("sim").to_numpy()
        order = np.lexsort((sim, cell))
        cell, sim = cell[order], sim[order]
        first = np.concatenate(([True], (cell[1:] != cell[:-1]) | (sim[1:] != sim[:-1])))
        cell, sim = cell[first], sim[first]
        found = np.arange(len(cell))  # all that have a partner get the number -1
        for a, b in _near_pairs(cell, sim, distance, found):
            found[a] = found[b] = -1
        yield pa.RecordBatch.from_arrays([pa.array(cell[found < 0]), pa.array(sim[found < 0])], ["key", "sim"])


def _whole_buckets(batches: Iterator[pa.RecordBatch], once: str | None = None) -> Iterator[pa.Table]:
    """Rows sorted by cell, cut between cells; of rows equal in ``once`` too, one stays in a batch. (A sort by one number alone is a radix sort.)"""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        if once:
            value = batch.column(once).to_numpy()
            order = np.lexsort((value, cell))
            again = (cell[order][1:] == cell[order][:-1]) & (value[order][1:] == value[order][:-1])
            new = np.ones(len(cell), bool)
            new[order[1:][again]] = False
            if again.any():
                batch, cell = batch.filter(pa.array(new)), cell[new]
        cut = int(np.searchsorted(cell, cell[-1]))  # the last bucket may go on
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column("cell")[-1].as_py() != cell[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _padded(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of keys as rows of one width."""
    lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], sizes)] = lists.flatten().to_numpy()
    return out


def _earlier(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pairs of rows of keys that share a key less than the one at hand (0 is no key)."""
    out = np.zeros(len(key), bool)
    for k in range(0, len(key), 4096):
        x, y, z = a[k : k + 4096], b[k : k + 4096], key[k : k + 4096]
        out[k : k + 4096] = ((x[:, :, None] == y[:, None, :]) & (x != 0)[:, :, None] & (x < z[:, None])[:, :, None]).any(axis=(1, 2))
    return out


def _ranks(keys: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """Numbers of which two rows have one alike only if they share a key less than the one at hand: their least keys, and the next ones."""
    ordered = np.sort(np.where(keys == 0, np.iinfo(np.int64).max, keys), axis=1)
    out = []
    for k in range(min(3, ordered.shape[1])):
        number = np.unique(ordered[:, k], return_inverse=True)[1]
        out.append(np.where(ordered[:, k] < key, number, -1 - np.arange(len(key))))
    return out


#: Pairs that wait for their distance (they may be joined meanwhile), and of which distances are measured at once.
WAITING, MEASURED = 20_000, 256


def _verified(batches: Iterator[pa.RecordBatch], distance: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, key, sim, sim2, line_hash, keys, size, form, comp, part) sorted by cell: links that join each bucket's groups.

    A pair that shares several keys is verified in the bucket of the least one. Rows of one ``comp`` are joined already, rows of one
    ``part`` (none if null) have been compared already.
    """
    for rows in _whole_buckets(batches, "line_hash"):
        rows = rows.take(np.lexsort((rows.column("line_hash"), rows.column("size"), rows.column("cell"))))
        cell, key, sim, more, ids, sizes, comp = (rows.column(c).to_numpy() for c in ("cell", "key", "sim", "sim2", "line_hash", "size", "comp"))
        forms, keys = rows.column("form").combine_chunks(), _padded(rows.column("keys"))
        grams = Grams(forms)
        order = np.lexsort((comp, cell))
        group = np.zeros(len(cell), np.int64)  # rows of a bucket that are joined
        group[order[1:]] = np.cumsum((cell[order][1:] != cell[order][:-1]) | (comp[order][1:] != comp[order][:-1]))
        home = _ranks(keys, key)
        found: list[tuple[int, int]] = []
        waiting: list[tuple[int, int, int]] = []  # bits apart and places of pairs that only their distance tells

        def joined(i: int, j: int) -> None:
            found.append((int(ids[i]), int(ids[j])))
            group[group == group[j]] = group[i]

        def settled() -> None:
            waiting.sort()
            while waiting:
                some = [(i, j) for _, i, j in waiting[:MEASURED] if group[i] != group[j]]
                for (i, j), yes in zip(some, all_alike([(forms[i].as_py(), forms[j].as_py()) for i, j in some], similarity), strict=True):
                    if yes and group[i] != group[j]:
                        joined(i, j)
                waiting[:] = [w for w in waiting[MEASURED:] if group[w[1]] != group[w[2]]]

        part = rows.column("part").fill_null(-1).to_numpy()
        part = np.where(part < 0, -1 - np.arange(len(part)), part)
        for a, b in _near_pairs(cell, sim, distance, group, part if (part >= 0).any() else None):
            bits = np.bitwise_count(sim[a].view(_U) ^ sim[b].view(_U)).astype(np.int64) + np.bitwise_count(more[a].view(_U) ^ more[b].view(_U))
            keep = bits <= 2 * distance
            keep &= np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
            for least in home:
                keep &= least[a] != least[b]
            a, b, bits = a[keep], b[keep], bits[keep]
            keep = ~_earlier(keys[a], keys[b], key[a])
            a, b, bits = a[keep], b[keep], bits[keep]
            keep = grams.may_be_alike(a, b, similarity)
            for i, j, apart in zip(a[keep].tolist(), b[keep].tolist(), bits[keep].tolist(), strict=True):
                if group[i] != group[j]:
                    told = _at_a_glance(forms[i].as_py(), forms[j].as_py(), similarity)
                    if told:
                        joined(i, j)
                    elif told is None:
                        waiting.append((apart, i, j))
            if len(waiting) > WAITING:
                settled()
        settled()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, copy, line, line_hash, sim and keys of every line with words; a line that its task has just seen again brings no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << _CACHE_BITS, _U)
        for whole in batches:
            for batch in pieces(whole):
                for found, first in line_batches(batch.column("text")):
                    slot = found.line_hash >> _U(64 - _CACHE_BITS)
                    fresh = seen[slot] != found.line_hash
                    seen[slot] = found.line_hash
                    once = np.zeros(len(slot), bool)
                    once[np.unique(found.line_hash, return_index=True)[1]] = True
                    text = pa.array(found.text)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(text), batch.column("copy").take(text), pa.array((found.line + first).astype(np.int32)), pa.array(signed(found.line_hash)), pa.array(signed(found.sim_hash)), found.key_lists(fresh & once)],
                        ["doc_id", "copy", "line", "line_hash", "sim", "keys"],
                    )

    return docs.select("doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, line int, line_hash long, sim long, keys array<long>")


def _entries(df: DataFrame, column: str) -> int:
    """Entries of all lists of a column."""
    return df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]


def _crowded(lines: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of the keys of more than about ``block`` lines, by counting one line in ``COUNTED``."""
    counted = lines.filter(F.pmod("line_hash", F.lit(COUNTED)) == 0).select("line_hash", F.explode("keys").alias("key")).distinct()
    sizes = counted.groupBy("key").agg((F.count(F.lit(1)) * COUNTED).alias("n")).filter(F.col("n") > block)
    return durable(sizes.select("key", F.ceil(F.col("n") / (block // 2)).cast("int").alias("blocks")), "crowded")


def fuzzy_links(docs: DataFrame, lines: DataFrame, forms: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of line hashes; ``forms`` has line_hash, sim and one occurrence (doc_id, copy, line) of each normal form."""

    def verified(cells: DataFrame) -> DataFrame:
        return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _verified(it, distance, similarity), "a long, b long")

    crowded, same = _crowded(lines, block), durable(forms.groupBy("sim").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sim"), "same")
    n_crowded, n_same = crowded.count(), same.count()
    dealt = lines.select(F.explode("keys").alias("key"), "sim")
    apart, always = dealt, []
    if n_crowded:  # all lines of a crowded bucket are candidates
        apart = dealt.join(light(crowded, n_crowded), "key", "left_anti")
        always.append(dealt.join(light(crowded.select("key"), n_crowded), "key", "left_semi"))
    if n_same:  # as are lines of one SimHash
        always.append(dealt.join(light(same, n_same), "sim", "left_semi").select("key", "sim"))
    cells = apart.withColumnRenamed("key", "cell").repartition("cell").sortWithinPartitions("cell")
    suspects = cells.mapInArrow(lambda it: _partnered(it, distance), "key long, sim long")
    for more in always:
        suspects = suspects.unionByName(more)
    suspects = suspects.groupBy("sim").agg(F.collect_set("key").alias("keys"))
    entry = F.struct("line", "line_hash", "sim", "keys")
    wanted = durable(forms.select("doc_id", "copy", "line", "line_hash", "sim").join(suspects, "sim").groupBy("doc_id", "copy").agg(F.collect_list(entry).alias("wanted")), "wanted")
    texts = docs.select(F.col("doc_id").alias("of"), F.col("copy").alias("of_copy"), "text")
    same_row = F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("of_copy") == F.col("copy"))
    found = durable(texts.join(light(wanted, _entries(wanted, "wanted")), same_row).select("text", "wanted").mapInArrow(_texts_of, "line_hash long, sim long, keys array<long>, form string, sim2 long"), "texts")
    cells = found.select(F.explode("keys").alias("key"), "sim", "sim2", "line_hash", "keys", F.length("form").alias("size"), "form", F.col("line_hash").alias("comp"), F.lit(None).cast("int").alias("part"))
    if not n_crowded:
        return verified(cells.withColumn("cell", F.col("key"))).distinct()
    return _crowded_links(cells, crowded, n_crowded, verified)


def _crowded_links(cells: DataFrame, crowded: DataFrame, n_crowded: int, verified) -> DataFrame:  # noqa: ANN001
    """Links where some keys are cut into blocks: inside blocks, between the first lines of a key's blocks, then between blocks whose lines are still apart."""
    small = light(crowded, n_crowded)
    cells = cells.join(small, "key", "left")
    place = F.pmod(F.xxhash64("line_hash"), "blocks").cast("int")
    many = durable(cells.filter("blocks is not null").withColumn("x", place), "many")
    inside = cells.filter("blocks is null").withColumn("cell", F.col("key")).drop("blocks").unionByName(many.withColumn("cell", F.xxhash64("key", "x")).drop("blocks", "x"))
    heads = many.groupBy("key", "x").agg(F.min_by(F.struct("sim", "sim2", "line_hash", "keys", "size", "form", "comp", "part"), "line_hash").alias("h")).select("key", "h.*").withColumn("cell", F.xxhash64("key", F.lit(-1)))
    links = durable(verified(inside).unionByName(verified(heads)).distinct(), "inside")
    groups = components(links).select(F.col("child").alias("line_hash"), F.col("root"))
    known = durable(many.drop("comp").join(groups, "line_hash", "left").withColumn("comp", F.coalesce("root", "line_hash")).drop("root"), "grouped")
    apart = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least("x", y).alias("low"), F.greatest("x", y).alias("high")))
    pairs = known.join(apart, "key", "left_semi").withColumn("pair", F.explode(others)).filter("pair.low <> pair.high").withColumn("cell", F.xxhash64("key", "pair.low", "pair.high"))
    return links.unionByName(verified(pairs.withColumn("part", F.col("x")).drop("pair", "blocks", "x"))).distinct()


def repeated_lines(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, copy, lines): the numbers of the lines to drop, for documents that lose any; copy is the hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), copy_of("text").alias("copy"), "text")
    lines = durable(line_table(docs), "lines")
    first = F.struct("doc_id", "line", "copy")
    forms = lines.groupBy("line_hash").agg(F.min(first).alias("first"), F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n"))
    forms = durable(forms.select("line_hash", "sim", "n", "first.doc_id", "first.line", "first.copy"), "forms")
    groups = components(fuzzy_links(docs, lines, forms, distance, similarity, block))
    linked = forms.join(groups.select(F.col("child").alias("line_hash"), F.col("root").alias("group")), "line_hash", "left").withColumn("group", F.coalesce("group", "line_hash"))
    firsts = linked.groupBy("group").agg(F.min(first).alias("first"), F.sum("n").alias("n")).filter("n > 1")
    known = linked.select("line_hash", "group").join(firsts.select("group", "first"), "group").select("line_hash", "first")
    dropped = lines.select("doc_id", "copy", "line", "line_hash").join(known, "line_hash").filter("not (doc_id <=> first.doc_id and line = first.line and copy = first.copy)")
    return dropped.groupBy("doc_id", "copy").agg(F.collect_set("line").alias("lines"))


def copy_of(text: str) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


_N_LINES, _N_DROPPED, _GONE = "__quillspark_n_lines", "__quillspark_n_dropped", "__quillspark_gone"


def _rewritten(batches: Iterator[pa.RecordBatch], plain: pa.Schema, at: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            texts, dropped, out = batch.column("text").to_pylist(), batch.column(_GONE).to_pylist(), []
            for text, numbers in zip(texts, dropped, strict=True):
                lines = (text or "").split("\n")
                if not numbers:
                    left = text
                else:
                    gone = set(numbers)
                    kept = [x for k, x in enumerate(lines) if k not in gone]
                    left = "\n".join(kept) if any(_WORD[np.frombuffer(x.encode(), np.uint8)].any() for x in kept) else ""
                out.append((left, len(lines) if text else 0, len(numbers or ())))
            columns = [c for k, c in enumerate(batch.columns) if batch.schema.names[k] != _GONE]
            columns[at] = pa.array([r[0] for r in out], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], schema=plain)


def _deduped(docs: DataFrame, distance: int, similarity: float) -> DataFrame:
    dropped = durable(repeated_lines(docs, distance, similarity), "dropped")
    dropped = dropped.select(F.col("doc_id").alias("__quillspark_doc"), F.col("copy").alias("__quillspark_copy"), F.col("lines").alias(_GONE))
    schema = T.StructType([*docs.schema.fields, T.StructField(_N_LINES, T.LongType()), T.StructField(_N_DROPPED, T.LongType())])
    plain, at = to_arrow_schema(schema), docs.columns.index("text")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__quillspark_doc")) & (copy_of("text") == F.col("__quillspark_copy"))
    both = docs.join(light(dropped, _entries(dropped, _GONE) // 4), same, "left").drop("__quillspark_doc", "__quillspark_copy")
    return both.mapInArrow(lambda it: _rewritten(it, plain, at), schema)


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with its text rewritten, and the columns n_lines and n_dropped (in place of any of those names)."""
    return _deduped(docs.drop("n_lines", "n_dropped"), distance, similarity).withColumnsRenamed({_N_LINES: "n_lines", _N_DROPPED: "n_dropped"})


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with rewritten texts, all other columns as they were, without documents that lost every line with words."""
    return _deduped(docs, DISTANCE, SIMILARITY).filter(f"{_N_DROPPED} = 0 or text <> ''").select(*docs.columns)
