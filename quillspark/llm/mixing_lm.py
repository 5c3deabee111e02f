"""Language-model scoring by online logistic context mixing, in bits per byte.

A text is a sequence of words (as of the base score), each with the white space
before it and a case pattern, and an end. Everything is coded as binary decisions:

* the folded word by its path in a Huffman tree over the words that training has
  more than once (``COMMON_WORDS`` at most; ids by falling count);
* any other word by an escape, then byte by byte along a second tree;
* whether white space is one blank, or one newline; whether a word is in lower case,
  capitalised, in capitals.

Each decision has opinions (log odds): of its node alone; of a context table (the word
before and the node for the first ``LEVELS`` decisions of a word, the word for case
and white space, the hashed last three bytes for spelling); and of the successor that
training saw most often after the same three words. The last one is the part that grows
with the corpus: no table holds it. Each batch of documents asks for its contexts, the
requests are shuffled by the context's hash, meet the training events there, and the
answers go back to the batch (a document's own event is not counted for itself).

The opinions are mixed by weights that a gate selects (how sure the successor is, or the
kind of decision), and refined online: after each block of decisions of a text
(``BLOCK`` at first, later a sixteenth of those before it) the weights move along the
gradient of the coding cost at the weights as they are then, for each gate at a rate that
falls with the decisions that it has seen. Many texts are read side by side, each with
weights of its own. The sum of the decisions' costs is the text's total bits.

Counts come from all training documents. The weights that a text begins with are
constants (``_START``), not fitted on any texts. The context table holds ``CONTEXTS`` words, the commonest ones each in a row of
its own, rarer ones hashed into the last rows.

Defined cases: a null text is empty (one end token); rows with one doc_id are scored
each for itself; with no training text each word is spelled; a text above ``PIECE`` bytes
is cut at white space and adaptation begins anew in each piece, as it does after
``SEGMENT`` words; words above ``LONGEST`` bytes cost eight bits a byte. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.durable import durable
from quillspark.llm.textnum import NOT_SPACE, Words, mix, pieces, raw, signed, span_hashes

#: Words of the context table; the last RARE rows are shared by hashing.
CONTEXTS, RARE = 1 << 13, 1 << 10
#: Decisions of a word that the context table sees.
LEVELS = 8
#: Rows of the tables for white space and case, and bits of the spelling table.
SMALL, SPELL_BITS = 1 << 13, 19
CHUNK_BITS = 15
#: Places that are held before they are counted.
COUNTED = 4_000_000
FAN_IN = 64
BLOCK = 24
RATE, EASE = 6.0, 300.0
#: Neighbouring decisions of a text that are read one after another before those of the next text.
RUN = 24
#: What a node's share counts against a table's decisions.
PRIOR = 6.0
END = 256
#: Bytes of text in a batch, words of a text that are read with one set of weights, bytes of a word that is spelled.
BATCH, PIECE, SEGMENT, LONGEST = 4 << 20, 1 << 20, 50_000, 256
COMMON_WORDS = 1_000_000
#: The hash that stands for the end token in word counts.
END_HASH = 0
#: Words, by falling count, whose paths are kept.
CACHED = 1 << 18
#: Requests that meet in one task.
ENTRIES = 500_000
#: Batches of training texts that first weights are fitted on: none (the name stays for callers that set it to 0).
FIT_BATCHES = 0
ESCAPE, STOP = 0, 1
EXTRA = 5  # nodes beside the words': white space (2) and case (3)
GATES, INPUTS = 9, 3
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Documents that no count may come from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2


class Code:
    """A binary code for 257 signs; decision ``first[sign] + j`` has a tree node and a bit."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i, (i,)) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        paths: dict[int, list[tuple[int, int]]] = {i: [] for i in range(len(counts))}
        node = 0
        while len(heap) > 1:
            (a, i, left), (b, j, right) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, signs in ((0, left), (1, right)):
                for s in signs:
                    paths[s].append((node, bit))
            heapq.heappush(heap, (a + b, min(i, j), left + right))
            node += 1
        self.length = np.array([len(paths[s]) for s in range(len(counts))], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        steps = [step for s in range(len(counts)) for step in reversed(paths[s])]
        # nodes by rank, the root (made last) as 0: the frequent nodes of a context are neighbours in memory
        self.node_hash = np.array([node - 1 - n for n, _ in steps], np.int64)
        self.bit = np.array([b for _, b in steps], np.float32)
        self.step = 2 * self.node_hash + self.bit.astype(np.int64)  # a counter's place: the slot and the bit


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one range after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _decisions(code: Code, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each decision: its place in the code; the number of decisions of each sign."""
    lengths = code.length.take(signs)
    ends = np.cumsum(lengths)
    first = code.first.take(signs)
    flat = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(flat):
        flat[0] = first[0]
        flat[ends[:-1]] = first[1:] - first[:-1] - lengths[:-1] + 1
    return np.cumsum(flat, out=flat), lengths


def _count_signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n): words (0, hash, count), the end token, and byte counts (1, byte, count)."""
    hist, docs = np.zeros(257, np.int64), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts, first)

    def told(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), 100_000):
            part = keys[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(counts[lo : lo + 100_000])], ["kind", "key", "n"])

    for whole in batches:
        for batch in pieces(whole):
            data, offsets = raw(batch.column("text"))
            hist[:256] += np.bincount(data, minlength=256)
            docs += batch.num_rows
            words = np.sort(Words(data, offsets).hashes())
            if len(words):
                first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
                held.append((signed(words[first]), np.diff(np.concatenate((first, [len(words)])))))
                size += len(first)
            if size > 3_000_000:
                keys, counts = merged()
                if len(keys) > 1_500_000:
                    yield from told(0, keys, counts)
                    held, size = [], 0
                else:
                    held, size = [(keys, counts)], len(keys)
    if held:
        yield from told(0, *merged())
    hist[END] = docs
    yield from told(1, np.arange(257), hist)
    yield from told(0, np.array([END_HASH]), np.array([docs]))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths (two queues over the sorted counts)."""
    m = len(counts)
    order = np.argsort(counts, kind="stable")
    leaf, inner, parent = counts[order].tolist(), [], [0] * (2 * m - 1)
    i = j = 0
    for node in range(m, 2 * m - 1):
        total = 0
        for _ in range(2):
            if i < m and (j >= len(inner) or leaf[i] <= inner[j]):
                total, parent[i], i = total + leaf[i], node, i + 1
            else:
                total, parent[m + j], j = total + inner[j], node, j + 1
        inner.append(total)
    depth = [0] * (2 * m - 1)
    for node in range(2 * m - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    out = np.zeros(m, np.int64)
    out[order] = depth[:m]
    return out


class Vocabulary:
    """Codes and node shares of ESCAPE, STOP and the words, by id."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64) + 1
        self._lay_out(code_lengths(counts))
        ones, total = np.zeros(self.nodes), np.zeros(self.nodes)
        for lo in range(0, len(counts), CACHED):
            ids = np.arange(lo, min(lo + CACHED, len(counts)))
            of, _, step = self.path(ids)
            node, bit = step >> 1, step & 1
            weight = counts[ids][of].astype(np.float64)
            total += np.bincount(node, weight, self.nodes)
            ones += np.bincount(node, weight * bit, self.nodes)
        self.share = (np.log(ones) - np.log(total - ones)).astype(np.float32)

    def __getstate__(self) -> tuple:
        return self.length.astype(np.uint8), self.share

    def __setstate__(self, state: tuple) -> None:
        self._lay_out(state[0].astype(np.int64))
        self.share = state[1]

    def _lay_out(self, length: np.ndarray) -> None:
        """Canonical codes and numbers of nodes; all of it follows from the lengths."""
        self.length = length
        deepest = int(self.length.max())
        by_length = np.bincount(self.length, minlength=deepest + 1)
        first = np.zeros(deepest + 1, np.int64)
        for d in range(1, deepest + 1):
            first[d] = (first[d - 1] + by_length[d - 1]) << 1
        m = len(length)
        order = np.lexsort((np.arange(m), self.length))
        self.code = np.zeros(m, np.int64)
        within = np.arange(m) - np.repeat(np.cumsum(by_length) - by_length, by_length)
        self.code[order] = first[self.length[order]] + within
        # leaves have the least codes of a depth, so a depth's inner nodes are one range
        self.low = first + by_length
        self.base = np.concatenate(([0], np.cumsum((np.int64(1) << np.arange(deepest + 1)) - self.low)[:-1]))
        self.shift = np.zeros(max(LEVELS, deepest + 1), np.int64)  # from a node to its prefix among those of its depth
        self.shift[: deepest + 1] = self.low - self.base
        self.nodes = m - 1
        self.cached = 0
        self.start, self.step = np.zeros(m, np.int32), np.zeros(1, np.int32)
        ids = np.arange(min(CACHED, m))
        self.step = self.path(ids)[2]
        self.start[ids] = np.cumsum(length[ids]) - length[ids]
        self._heads: np.ndarray | None = None
        self.cached = len(ids)  # the commonest words' steps are looked up

    def path(self, ids: np.ndarray, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each decision (the first ``most`` of a word): the place in ``ids``, the depth, and the step (twice the node, and the bit)."""
        length = np.minimum(self.length[ids], most)
        of = np.repeat(np.arange(len(ids), dtype=np.int32), length)
        depth = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(length) - length).astype(np.int32), length)
        if self.cached:
            step = self.step.take(self.start[ids].take(of) + depth, mode="clip")
            rare = np.flatnonzero((ids >= self.cached).take(of))
        else:
            step, rare = np.empty(len(of), np.int32), np.arange(len(of))
        if len(rare):
            of_rare, at = ids[of[rare]], depth[rare]
            left = self.code[of_rare] >> (self.length[of_rare] - at - 1)
            step[rare] = 2 * (self.base[at] + (left >> 1) - self.low[at]) + (left & 1)
        return of, depth, step

    def prefix(self, node: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The bits before a decision after a leading one, of nodes at depths below LEVELS."""
        return node + (1 << depth) + self.shift.take(depth)

    def heads(self) -> np.ndarray:
        """Of each common word's first ``LEVELS`` decisions: twice the prefix and the bit, or 0 where its path is over."""
        if self._heads is None:
            of, depth, step = self.path(np.arange(self.cached), LEVELS)
            self._heads = np.zeros((self.cached, LEVELS), np.int32)
            self._heads[of, depth] = 2 * self.prefix(step >> 1, depth) + (step & 1)
        return self._heads

    def agreement(self, guess: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The decisions in which the paths of two words agree from the first on; -1 where there is no guess."""
        out = np.full(len(ids), -1, np.int32)
        at = np.flatnonzero(guess)
        a, b = self.length[guess[at]], self.length[ids[at]]
        both = np.minimum(a, b)
        differ = (self.code[guess[at]] >> (a - both)) ^ (self.code[ids[at]] >> (b - both))
        out[at] = both - np.frexp(differ.astype(np.float64))[1]  # the exponent is the number of bits from the highest that differs
        return out


class Common:
    """Counts and ids of the commonest words: one probe in a table of about twice their number, then a sorted rest for clashes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.lexsort((keys, -counts))
        self.__setstate__((keys[order].astype(np.int64).view(_U), counts[order].astype(np.int64)))

    def __getstate__(self) -> tuple:
        return self.keys, self.counts

    def __setstate__(self, state: tuple) -> None:
        keys, counts = self.keys, self.counts = state
        ids = np.where(counts > 1, np.arange(len(keys)) + 2, ESCAPE).astype(np.int32)
        self.words = counts[counts > 1]
        self.shift = _U(64 - max(8, (2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        slot = (keys >> self.shift).astype(np.int64)
        self.ids = ids
        self.rank = np.zeros(size, np.int32)  # of the word in a slot: the commonest words' keys and counts are neighbours in memory
        self.rank[slot] = np.arange(len(keys))
        lost = np.flatnonzero(self.rank[slot] != np.arange(len(keys)))
        lost = lost[np.argsort(keys[lost])]
        self.rest = np.concatenate((keys[lost], [_U(0xFFFFFFFFFFFFFFFF)]))
        self.rest_count, self.rest_id = np.concatenate((counts[lost], [0])), np.concatenate((ids[lost], [0]))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, found, id) of each word."""
        slot = (hashes >> self.shift).astype(np.int64)
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int32)
        rank = self.rank.take(slot)
        found = self.keys.take(rank) == hashes
        count, ids = np.where(found, self.counts.take(rank), 0), np.where(found, self.ids.take(rank), ESCAPE)
        at = np.flatnonzero(~found)
        place = np.searchsorted(self.rest, hashes[at])
        hit = self.rest[place] == hashes[at]
        count[at[hit]], ids[at[hit]] = self.rest_count[place[hit]], self.rest_id[place[hit]]
        found[at[hit]] = True
        return count, found, ids


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


class Tokens:
    """Texts as words: ids, white space and case classes, spelled words, and bits that no decision has a say in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, common: Common, words: Words | None = None):
        words = words or Words(data, offsets)
        n, m = len(offsets) - 1, len(words)
        size = words.counts + 1
        self.first = np.concatenate(([0], np.cumsum(size)))  # a text's words, then its end
        hashes = words.hashes()
        self.hashes = hashes
        self.count, self.found, ids = common.find(hashes)
        at = np.arange(m) + np.repeat(np.arange(n), words.counts)
        stop = self.first[1:] - 1
        self.id = np.full(m + n, STOP, np.int32)
        self.id[at] = ids
        # white space before each word and before the end
        begin, until = np.zeros(m + n, np.int64), np.zeros(m + n, np.int64)
        until[at], until[stop] = words.starts, offsets[1:]
        begin[self.first[:-1]] = offsets[:-1]
        begin[at + 1] = words.ends
        gap = until - begin
        opening = np.zeros(m + n, bool)
        opening[self.first[:-1]] = True
        opening[stop] = True  # nothing is what to expect there
        lone = np.where((gap == 1) & ~opening, data[np.minimum(begin, max(len(data) - 1, 0))] if len(data) else 0, 0)
        self.space = np.where(np.where(opening, gap == 0, lone == 32), 0, np.where(lone == 10, 1, 2)).astype(np.uint8)
        fixed = np.where(self.space == 2, gap + 1 + gap * np.log2(6), 0.0)
        # case
        capital = np.flatnonzero(_UPPER[data])  # all of them in words
        up = np.bincount(np.searchsorted(words.starts, capital, "right") - 1, minlength=m) if m else np.zeros(0, np.int64)
        some = np.flatnonzero(up)
        long = words.ends[some] - words.starts[some]
        letter = np.zeros(m, np.int64)
        if len(some):
            letter[some] = np.add.reduceat(_LETTER[data[_ranges(words.starts[some], long)]], np.cumsum(long) - long, dtype=np.int64)
        case = np.zeros(m, np.int64)
        case[some] = np.where((up[some] == 1) & _UPPER[data[words.starts[some]]], 1, np.where(up[some] == letter[some], 2, 3))
        self.case = np.zeros(m + n, np.uint8)
        self.case[at] = case
        fixed[at] += np.where(case == 3, letter, 0)
        # spelling
        length = words.ends - words.starts
        own = np.flatnonzero((ids == ESCAPE) & (length <= LONGEST))
        huge = np.flatnonzero((ids == ESCAPE) & (length > LONGEST))
        fixed[at[huge]] += 8.0 * length[huge] + 64
        self.spelled = at[own]
        size = length[own]
        place = np.repeat(words.starts[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        folded = data[place]
        self.letters = np.where(_UPPER[folded], folded | 32, folded).astype(np.uint8)
        self.spelled_size = size
        self.fixed = np.add.reduceat(fixed, self.first[:-1]) if n else np.zeros(0)
        self.n_words = words.counts

    def kept(self) -> tuple:
        return self.first, self.id, self.space, self.case, self.spelled, self.letters, self.spelled_size.astype(np.int16), self.fixed


def _before(values: np.ndarray, first: np.ndarray, steps: int, start: int) -> np.ndarray:
    """The value so many places before, inside a text."""
    out = np.full(len(values), start, values.dtype)
    out[steps:] = values[: len(values) - steps]
    for k in range(steps):
        at = first[:-1] + k
        out[at[at < first[1:]]] = start
    return out


class Decisions:
    """The decisions of some texts in parts, each with its places in the whole; ``ends`` has where texts begin."""

    def __init__(self, kept: tuple, vocabulary: Vocabulary, code: Code, layout: Layout):
        first, ids, space, case, spelled, letters, sizes, _ = kept
        self.layout, n = layout, len(ids)
        self.signs = self._spell(letters, sizes.astype(np.int64), code) if len(spelled) else None
        self.paths = vocabulary.length[ids]
        spelling = np.zeros(n, np.int64)
        if self.signs:
            spelling[spelled] = self.signs[2]
        self.worded = np.ones(n, bool)
        self.worded[first[1:] - 1] = False
        self.space, self.case, self.ids = space, case, ids
        self.each = 1 + (space > 0) + self.paths + spelling + np.where(self.worded, np.minimum(case, 2) + 1, 0)
        self.start = np.cumsum(self.each) - self.each
        self.begin = self.start + 1 + (space > 0)  # of the path
        self.cased = self.begin + self.paths + spelling
        self.size = int(self.each.sum())
        self.ends = np.append(self.start, self.size)[first]
        self.before = _before(ids, first, 1, STOP).astype(np.int64)
        self.row = np.where(self.before < CONTEXTS - RARE, self.before, CONTEXTS - RARE + (self.before * 0x9E3779B1 >> 8) % RARE) << LEVELS

    @staticmethod
    def _spell(letters: np.ndarray, sizes: np.ndarray, code: Code) -> tuple[np.ndarray, ...]:
        """Of all spelled words: steps, contexts of one and of three letters for each decision, and decisions of each word."""
        signs = np.empty(len(letters) + len(sizes), np.int64)
        ends = np.cumsum(sizes) + np.arange(len(sizes))
        keep = np.ones(len(signs), bool)
        keep[ends] = False
        signs[keep], signs[ends] = letters, END
        edges = np.concatenate(([0], ends + 1))
        one, two, three = (_before(signs, edges, k, END) for k in (1, 2, 3))
        flat, lengths = _decisions(code, signs)
        near = np.repeat(one << 8, lengths) + code.node_hash.take(flat)
        far = mix(np.repeat((one | two << 9 | three << 18).astype(_U), lengths) << _U(9) | code.node_hash.take(flat).astype(_U)) >> _U(64 - SPELL_BITS)
        return flat, (near, far.astype(np.int64)), np.add.reduceat(lengths, edges[:-1])

    def others(self) -> Iterator[tuple]:
        """White space and case: (places, steps, twice the slots and the bits, kind)."""
        lay, before, space, case, ids = self.layout, self.before, self.space, self.case, self.ids

        def told(at: np.ndarray, node: int, bit: np.ndarray, slot: np.ndarray) -> tuple:
            return at, 2 * (lay.extra + node) + bit, 2 * (lay.extra_at + node * SMALL + slot) + bit, 7

        after = np.where(before < SMALL // 2, before, SMALL // 2 + (before * 0x9E3779B1 >> 8) % (SMALL // 2))
        yield told(self.start, 0, space > 0, after)
        other = np.flatnonzero(space > 0)
        yield told(self.start[other] + 1, 1, space[other] > 1, after[other])
        small = np.where(ids < SMALL // 2, ids, SMALL // 2 + (ids.astype(np.int64) * 0x9E3779B1 >> 8) % (SMALL // 2))
        for k in range(3):
            at = np.flatnonzero(self.worded & (case >= k))
            yield told(self.cased[at] + k, 2 + k, case[at] > k, small[at])


class Layout:
    """Places in the one table of counters."""

    def __init__(self, vocabulary: Vocabulary):
        self.extra = vocabulary.nodes
        self.extra_at = CONTEXTS << LEVELS
        self.letter_at = self.extra_at + EXTRA * SMALL
        self.spell_at = self.letter_at + (257 << 8)
        self.none = self.spell_at + (1 << SPELL_BITS)
        self.size = -(-(self.none + 1) >> CHUNK_BITS) << CHUNK_BITS


def _count_contexts(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, code: Code) -> Iterator[pa.RecordBatch]:
    layout = Layout(vocabulary)
    table, seen = np.zeros(2 * layout.size, np.int32), False
    first = vocabulary.heads()
    for batch in batches:
        for body in batch.column("body"):
            places, waiting = [], 0
            for part, _, _ in _segments(_unpacked(body.as_py())[0]):
                d, ids = Decisions(part, vocabulary, code, layout), part[1]
                rare = np.flatnonzero(ids >= vocabulary.cached)
                of, depth, step = vocabulary.path(ids[rare], LEVELS)
                near = first.take(ids, axis=0, mode="clip")
                near[rare] = 0
                places.append((near + 2 * d.row[:, None]).ravel())
                places.append(2 * (d.row[rare].take(of) + vocabulary.prefix(step >> 1, depth)) + (step & 1))
                places += [place for _, _, place, _ in d.others()]
                if d.signs:
                    flat, slots, _ = d.signs
                    bit = code.step.take(flat) & 1
                    places += [2 * (start + slot) + bit for start, slot in zip((layout.letter_at, layout.spell_at), slots, strict=True)]
                waiting = sum(len(x) for x in places)
                if waiting > COUNTED:
                    table += np.bincount(np.concatenate(places), minlength=len(table)).astype(np.int32)
                    places, waiting = [], 0
            if places:
                table += np.bincount(np.concatenate(places), minlength=len(table)).astype(np.int32)
            seen = True
    table[: 2 * layout.extra_at : 2 << LEVELS] = 0  # the place of paths shorter than LEVELS
    if seen:
        yield from _chunks(table, TaskContext.get().partitionId())


def _cut(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(data, offsets) of the texts; one long text comes in pieces that end at white space."""
    data, offsets = raw(column)
    if len(offsets) != 2 or len(data) <= PIECE:
        yield data, offsets
        return
    gaps = np.flatnonzero(~NOT_SPACE[data])
    begin = 0
    while begin < len(data):
        k = int(np.searchsorted(gaps, begin + PIECE))
        end = int(gaps[k]) if k < len(gaps) else len(data)
        yield data[begin:end], np.array([0, end - begin])
        begin = end


def _chunks(table: np.ndarray, source: int) -> Iterator[pa.RecordBatch]:
    rows = [(c, source, _small(np.minimum(part, 1 << 30).astype(np.int32).tobytes())) for c, part in enumerate(table.reshape(-1, 2 << CHUNK_BITS)) if part.any()]
    for lo in range(0, len(rows), 16):
        some = rows[lo : lo + 16]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.binary())], ["chunk", "source", "counts"])


def _summed(rows: pa.Table) -> pa.Table:
    total = np.zeros(2 << CHUNK_BITS, np.int64)
    for body in rows.column("counts"):
        total += np.frombuffer(_whole(body.as_py()), np.int32)
    total = np.minimum(total, 1 << 30).astype(np.int32)
    first = rows.slice(0, 1)
    return pa.table({"chunk": first.column("chunk"), "source": pa.array([first.column("source")[0].as_py() // FAN_IN], pa.int64()), "counts": pa.array([_small(total.tobytes())], pa.binary())})


#: Opinions are stored in sixteenths of log odds; UNSEEN has none.
SCALE, UNSEEN = 16, -128
#: The weights that a text begins with: node, context, successor, for each gate.
_START = np.array([[1.0, 0.6, 0.0], *([1.0, 0.3, s] for s in (2.0, 1.5, 3.0, 4.0, 5.0, 2.0)), [1.0, 0.8, 0.0], [0.7, 0.6, 0.0]], np.float32)


class Model:
    """Vocabulary, byte code, opinions of nodes and contexts, and the weights that a text begins with."""

    def __init__(self, vocabulary: Vocabulary, code: Code, counts: np.ndarray, weights: np.ndarray | None = None):
        self.vocabulary, self.code, self.layout = vocabulary, code, Layout(vocabulary)
        self.weights = _START.copy() if weights is None else weights
        lay = self.layout
        pair = counts.reshape(-1, 2).astype(np.float32)
        extra = pair[lay.extra_at : lay.letter_at].reshape(EXTRA, SMALL, 2)
        sums = extra.sum(axis=1, dtype=np.float64)
        extra_share = np.log((sums[:, 1] + 0.5) / (sums[:, 0] + 0.5))
        self.share = np.concatenate((vocabulary.share, extra_share.astype(np.float32), np.zeros(256, np.float32)))
        shares = np.zeros(lay.size, np.float32)
        prefix = np.arange(1, 1 << LEVELS)
        depth = np.log2(prefix).astype(np.int64)
        inside = depth < len(vocabulary.base)
        node = np.full(len(prefix), -1)
        node[inside] = prefix[inside] - (1 << depth[inside]) + vocabulary.base[depth[inside]] - vocabulary.low[depth[inside]]
        real = inside & (prefix - (1 << depth) >= vocabulary.low[np.minimum(depth, len(vocabulary.low) - 1)])
        row = np.zeros(1 << LEVELS, np.float32)
        row[prefix[real]] = vocabulary.share[node[real]]
        shares[: lay.extra_at] = np.tile(row, CONTEXTS)
        shares[lay.extra_at : lay.letter_at] = np.repeat(extra_share, SMALL)
        self.opinion = np.full(2 * lay.size, UNSEEN, np.int8)  # twice the slot, and the bit: what counts against that bit
        for lo in range(0, lay.size, 1 << 20):
            part, prior = pair[lo : lo + (1 << 20)], 1 / (1 + np.exp(-shares[lo : lo + (1 << 20)]))
            held = np.log((part[:, 1] + PRIOR * prior) / (part[:, 0] + PRIOR * (1 - prior)))
            # words, white space and case: what the context adds to the node's share
            worded = np.arange(lo, lo + len(part)) < lay.letter_at
            told = np.where(worded, held - shares[lo : lo + (1 << 20)], np.log((part[:, 1] + 0.4) / (part[:, 0] + 0.4)))
            told = np.clip(np.rint(SCALE * told), -127, 127)
            seen = part.sum(axis=1) > 0
            for bit, stored in ((0, told), (1, -told)):
                self.opinion[2 * lo + bit : 2 * (lo + len(part)) : 2] = np.where(seen, stored, np.where(worded, 0, UNSEEN))
        self._look_up()

    def __getstate__(self) -> tuple:
        return self.vocabulary, self.code, self.weights, self.share, self.opinion

    def __setstate__(self, state: tuple) -> None:
        self.vocabulary, self.code, self.weights, self.share, self.opinion = state
        self.layout = Layout(self.vocabulary)
        self._look_up()

    def _look_up(self) -> None:
        """What follows from the shares, for the decisions of the commonest words one after another."""
        vocabulary = self.vocabulary
        self.against = np.stack((self.share, -self.share), axis=1).ravel()  # by step: a node's share against its bit
        step = vocabulary.step[: int(vocabulary.length[: vocabulary.cached].sum())]
        self.path_share = self.against.take(step)
        depth = _ranges(np.zeros(vocabulary.cached, np.int64), vocabulary.length[: vocabulary.cached])
        self.path_slot = self._within(step, depth).astype(np.uint16)

    def _within(self, step: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Of each decision: its place in a context's row, twice the prefix and the bit; 0, which no decision has, below the first LEVELS."""
        return np.where(depth < LEVELS, 2 * self.vocabulary.prefix(step >> 1, np.minimum(depth, LEVELS - 1)) + (step & 1), 0)

    def inputs(self, kept: tuple, guess: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all decisions, text by text: three opinions (log odds against what is true) and gates; and where texts begin.

        ``guess`` and ``sure`` have the predicted id (0: none) and its class for each word.
        """
        v, d, ids = self.vocabulary, Decisions(kept, self.vocabulary, self.code, self.layout), kept[1]
        n, size = d.size, d.each
        # as if all decisions were those of a path; the others are set below
        source = np.repeat(v.start.take(ids) - d.begin, size)
        source += np.arange(n)
        share = self.path_share.take(source, mode="clip")
        slot = np.repeat(2 * d.row, size)
        slot += self.path_slot.take(source, mode="clip")
        told = self.opinion.take(slot)
        gate, hint = np.zeros(n, np.int8), np.zeros(n, np.float32)
        rare = np.flatnonzero(ids >= v.cached)
        if len(rare):
            of, depth, step = v.path(ids[rare])
            at = d.begin[rare].take(of) + depth
            share[at] = self.against.take(step)
            told[at] = self.opinion.take(2 * d.row[rare].take(of) + self._within(step, depth))
        extra = np.multiply(told, np.float32(1 / SCALE), dtype=np.float32)
        until = v.agreement(guess, ids)  # the path agrees with the guess's so far
        on = np.flatnonzero(until >= 0)
        missed = until[on] < d.paths[on]
        count = until[on] + missed
        at = _ranges(d.begin[on], count)
        hint[at] = -1
        gate[at] = np.repeat(sure[on].astype(np.int8), count)
        hint[(d.begin[on] + until[on])[missed]] = 1
        for at, step, place, kind in d.others():
            share[at], extra[at], gate[at] = self.against.take(step), np.multiply(self.opinion.take(place), np.float32(1 / SCALE), dtype=np.float32), kind
        if d.signs:
            flat, (near, far), each = d.signs
            at = _ranges(d.begin[kept[4]] + d.paths[kept[4]], each)
            bit = self.code.step.take(flat) & 1
            first, second = self.opinion.take(2 * (d.layout.letter_at + near) + bit), self.opinion.take(2 * (d.layout.spell_at + far) + bit)
            one = np.where(first == UNSEEN, np.float32(0), first / np.float32(SCALE))
            share[at], extra[at], gate[at] = one, np.where(second == UNSEEN, np.float32(0), second / np.float32(SCALE) - one), 8
        return share, extra, hint, gate, d.ends

    def read(self, share: np.ndarray, extra: np.ndarray, hint: np.ndarray, gate: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text.

        A text's blocks have ``BLOCK`` decisions at first, then a sixteenth of those before it; the same blocks of all texts are read at once.
        """
        n, sizes = len(ends) - 1, np.diff(ends)
        if not len(gate):
            return np.zeros(n)
        longest = np.argsort(-sizes, kind="stable")  # the longest text first: those that a block still has are the first ones
        blocks = [0]
        while blocks[-1] < sizes[longest[0]]:
            blocks.append(blocks[-1] + max(BLOCK, blocks[-1] // 16))
        # runs: some neighbours of one text in one block, block by block; short ones, so that sums don't wait for one another
        edges = np.union1d(blocks, np.arange(0, blocks[-1], RUN))
        live = np.searchsorted(-sizes[longest], -edges[:-1])  # texts that are longer than a run's beginning
        rank = _ranges(np.zeros(len(live), np.int64), live)
        block = np.repeat(np.arange(len(live)), live)
        begin, size = ends[longest[rank]] + edges[block], np.minimum(edges[block + 1], sizes[longest[rank]]) - edges[block]
        order = _ranges(begin, size)
        share, extra, gate = share.take(order), extra.take(order), gate.take(order)
        cells = np.repeat(rank * GATES, size)
        cells += gate
        starts = np.cumsum(size) - size
        at = np.searchsorted(edges, blocks)
        cuts = np.append(starts, len(order))[np.concatenate(([0], np.cumsum(live)))[at]].tolist()
        hinted = np.flatnonzero((gate > 0) & (gate < 7))  # those that have a successor to go by
        bounds = np.searchsorted(hinted, cuts).tolist()
        own, told = cells.take(hinted), hint.take(order.take(hinted))
        weights = [np.tile(self.weights[:, k], n).astype(np.float32) for k in range(INPUTS)]
        seen, cost = np.full(n * GATES, EASE, np.float32), np.empty(len(order), np.float32)
        for lo, hi, a, b, texts in zip(cuts[:-1], cuts[1:], bounds[:-1], bounds[1:], live[at[:-1]].tolist(), strict=True):
            cell, some = cells[lo:hi], texts * GATES
            odds = weights[0].take(cell)
            odds *= share[lo:hi]
            more = weights[1].take(cell)
            more *= extra[lo:hi]
            odds += more
            at_hints, hinted_cell, hinted_by = hinted[a:b] - lo, own[a:b], told[a:b]
            odds[at_hints] += weights[2].take(hinted_cell) * hinted_by
            np.minimum(odds, np.float32(30), out=odds)
            np.exp(odds, out=odds)  # against what is true
            wrong = np.add(odds, np.float32(1), out=cost[lo:hi])
            odds /= wrong
            seen[:some] += np.bincount(cell, minlength=some)
            rate = np.float32(RATE) / seen[:some]
            weights[0][:some] -= rate * np.bincount(cell, odds * share[lo:hi], some)
            weights[1][:some] -= rate * np.bincount(cell, odds * extra[lo:hi], some)
            weights[2][:some] -= rate * np.bincount(hinted_cell, odds.take(at_hints) * hinted_by, some)
        np.log(cost, out=cost)
        return np.bincount(longest[rank], np.add.reduceat(cost, starts, dtype=np.float64), n) / np.log(2)

    def bits(self, kept: tuple, guess: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Total bits of each text."""
        out = []
        for part, lo, hi in _segments(kept):
            out.append(self.read(*self.inputs(part, guess[lo:hi], sure[lo:hi])))
        return np.concatenate([np.zeros(0), *out]) + kept[7]


def _segments(kept: tuple, words: int = 20_000) -> Iterator[tuple[tuple, int, int]]:
    """Runs of whole texts of about so many words (or of one text), with the words' range."""
    first, ids, space, case, spelled, letters, sizes, fixed = kept
    until = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(first, first[at] + words, "right")) - 1)
        lo, hi = int(first[at]), int(first[to])
        a, b = np.searchsorted(spelled, [lo, hi])
        yield (first[at : to + 1] - lo, ids[lo:hi], space[lo:hi], case[lo:hi], spelled[a:b] - lo, letters[until[a] : until[b]], sizes[a:b], fixed[at:to]), lo, hi
        at = to


def _split_long(kept: tuple, row: np.ndarray) -> tuple[tuple, np.ndarray]:
    """Texts above SEGMENT words as several; ``row`` follows."""
    first, sizes = kept[0], np.diff(kept[0])
    if not len(sizes) or sizes.max() <= SEGMENT:
        return kept, row
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), parts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    new = np.concatenate((first[owner] + inner * SEGMENT, first[-1:]))
    return (new, *kept[1:7], np.where(inner == 0, kept[7][owner], 0.0)), row[owner]


_SCORES = "kind byte, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, word long, n long, body binary"


def _coded(batches: Iterator[pa.RecordBatch], common: Common, total: int, kinds: int, end_count: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 (a document), 1 (a rare word of one) and 2 (a batch of texts as tokens; ``row`` is its first)."""
    fields = [c.split() for c in _SCORES.split(", ")]
    types = {"byte": pa.int8(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    row = TaskContext.get().partitionId() << 40
    step = np.log10(total + kinds + 1) if total + kinds + 1 > 0 else 0.0

    def told(size: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
        return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(size, types[t]) for c, t in fields], [c for c, _ in fields])

    held: dict[bool, list[tuple]] = {True: [], False: []}
    size = {True: 0, False: 0}

    def batch_of(trained: bool) -> pa.RecordBatch:
        out = told(1, kind=np.array([2], np.int8), row=held[trained][0][1][:1], held_out=[not trained], body=[_packed(_joined_tokens(held[trained]))])
        held[trained], size[trained] = [], 0
        return out

    for whole in batches:
        out = whole.column("held_out")
        for trained in (True, False):
            for batch in pieces(whole.filter(pc.invert(out) if trained else out)):
                n = batch.num_rows
                rows = row + np.arange(n)
                n_tokens, n_known, base, n_bytes = np.ones(n, np.int64), np.full(n, int(end_count > 0)), np.full(n, np.log10(end_count + 1.0)), np.zeros(n, np.int64)
                for data, offsets in _cut(batch.column("text")):
                    t = Tokens(data, offsets, common)
                    owner = np.repeat(np.arange(n), t.n_words)
                    n_tokens += t.n_words
                    n_bytes += np.diff(offsets)
                    base += np.bincount(owner[t.found], np.log10(t.count[t.found] + 1.0), n)
                    n_known += np.bincount(owner[t.found], minlength=n)
                    rest, of = t.hashes[~t.found], owner[~t.found]
                    if len(rest):
                        order = np.lexsort((rest, of))
                        rest, of = rest[order], of[order]
                        first = np.flatnonzero(np.concatenate(([True], (rest[1:] != rest[:-1]) | (of[1:] != of[:-1]))))
                        yield told(len(first), kind=np.ones(len(first), np.int8), row=rows[of[first]], word=signed(rest[first]), n=np.diff(np.concatenate((first, [len(rest)]))))
                    kept, of_text = _split_long(t.kept(), np.arange(n))
                    held[trained].append((kept, rows[of_text]))
                    size[trained] += len(data)
                    if size[trained] > BATCH:
                        yield batch_of(trained)
                yield told(n, kind=np.zeros(n, np.int8), row=rows, doc_id=batch.column("doc_id").cast(pa.int64()), held_out=batch.column("held_out"), n_tokens=n_tokens, n_known=n_known, base=base - n_tokens * step, n_bytes=n_bytes)
                row += n
    for trained in (True, False):
        if held[trained]:
            yield batch_of(trained)


def _joined_tokens(held: list[tuple]) -> tuple:
    """Several (tokens, rows) as one."""
    words = np.concatenate(([0], np.cumsum([k[0][0][-1] for k in held])))
    first = np.concatenate([*(k[0][0][:-1] + w for k, w in zip(held, words[:-1], strict=True)), words[-1:]])
    spelled = np.concatenate([k[0][4] + w for k, w in zip(held, words[:-1], strict=True)])
    rest = [np.concatenate([k[0][c] for k in held]) for c in (1, 2, 3, 5, 6, 7)]
    kept = (first, rest[0], rest[1], rest[2], spelled, rest[3], rest[4], rest[5])
    return kept, np.concatenate([k[1] for k in held])


_CODEC = pa.Codec("zstd", compression_level=1)


def _small(body: bytes) -> bytes:
    """Compressed, after eight bytes that say the size."""
    return len(body).to_bytes(8, "little") + _CODEC.compress(body, asbytes=True)


def _whole(body: bytes) -> bytes:
    return _CODEC.decompress(memoryview(body)[8:], int.from_bytes(body[:8], "little"), asbytes=True)


def _packed(x: object) -> bytes:
    return _small(pickle.dumps(x, protocol=5))


def _unpacked(body: bytes) -> tuple:
    return pickle.loads(_whole(body))  # noqa: S301  written by the job itself


def _asked(kept: tuple, parts: int) -> tuple[np.ndarray, ...]:
    """The distinct requests of a batch, sorted: part, context hash, word; how often each is made; and the request of each word."""
    first, ids, spelled, letters, sizes = kept[0], kept[1], kept[4], kept[5], kept[6].astype(np.int64)
    value = mix(ids.astype(_U) + _U(3))
    if len(spelled):
        ends = np.cumsum(sizes)
        value[spelled] = span_hashes(mix(letters.astype(_U) + _U(1)), ends - sizes, ends)
    context = np.zeros(len(ids), _U)
    for k in (3, 2, 1):
        context = mix(context * _U(0x9E3779B97F4A7C15) + _before(value, first, k, 0))
    part = ((context >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    short = (context & _U(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(part << 52 | short << 20 | ids) if parts <= 1 << 11 else np.lexsort((ids, part << 32 | short))
    p, c, w = part[order], short[order], ids[order]
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (c[1:] != c[:-1]) | (w[1:] != w[:-1]))) if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    which = np.empty(len(ids), np.int64)
    which[order] = np.cumsum(new) - 1
    times = np.diff(np.concatenate((at, [len(p)])))
    return p[at], c[at], w[at], times, which


def _requests(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, body, out_of in zip(batch.column("row").to_pylist(), batch.column("body"), batch.column("held_out").to_pylist(), strict=True):
            p, c, w, times, _ = _asked(_unpacked(body.as_py())[0], parts)
            cuts = np.searchsorted(p, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts))
            gaps = np.diff(c, prepend=0)
            gaps[cuts[some]] = c[cuts[some]]  # each part's first one from 0
            planes = np.concatenate([_planes(x) for x in (gaps, w, times << 1 | (not out_of))])
            out = [(int(k), row, _small(planes[:, cuts[k] : cuts[k + 1]].copy().tobytes())) for k in some]
            for lo in range(0, len(out), 256):
                some = out[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.binary())], ["part", "row", "asked"])


def _planes(x: np.ndarray) -> np.ndarray:
    """The four bytes of each number, all first ones, then all second ones, and so on."""
    x = x.astype(np.uint32)
    return np.stack([(x >> np.uint32(8 * k)).astype(np.uint8) for k in range(4)])


def _numbers(planes: np.ndarray) -> np.ndarray:
    out = planes[3].astype(np.uint32)
    for k in (2, 1, 0):
        out <<= np.uint32(8)
        out |= planes[k]
    return out.astype(np.int64)


def _opened(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, whether trained, and times of the requests of some bodies; and where each body begins."""
    plain = [np.frombuffer(_whole(body), np.uint8).reshape(12, -1) for body in bodies]
    ends = np.concatenate(([0], np.cumsum([x.shape[1] for x in plain])))
    planes = np.concatenate(plain, axis=1)
    gaps, word, last = (_numbers(planes[k : k + 4]) for k in (0, 4, 8))
    sums = np.concatenate(([0], np.cumsum(gaps)))
    return sums[1:] - np.repeat(sums[ends[:-1]], np.diff(ends)), word, last & 1, last >> 1, ends


def successors(context: np.ndarray, word: np.ndarray, trained: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each event: the word that training saw most often after its context, the event itself left out (0: none), and how sure that is (1 to 6).

    Contexts have 32 bits and words 20, so that sorts are of whole numbers. For the order of successors, counts above 2,047 are alike.
    """
    best, sure = np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
    own = (trained > 0) & (word != ESCAPE)
    pair, n = context[own] << 20 | word[own], times[own]
    if not len(n):
        return best, sure
    if n.max() < 1 << 11:
        key = np.sort(pair << 11 | n)
        pair, n = key >> 11, key & 2047
    else:
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    n, pair = np.add.reduceat(n, at), pair[at]
    c = pair >> 20
    low = np.sort((c << 31) | ((2047 - np.minimum(n, 2047)) << 20) | (pair & 0xFFFFF))  # the commonest successor of each context first
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    total, size = np.add.reduceat(n, first), np.diff(np.append(first, len(c)))
    keys, w1 = c[first], low[first] & 0xFFFFF
    second = np.minimum(first + 1, len(c) - 1)
    w2 = np.where(size > 1, low[second] & 0xFFFFF, 0)
    if n.max() < 2047:
        ordered = 2047 - (low >> 20 & 2047)
        n1, n2 = ordered[first], np.where(size > 1, ordered[second], 0)
    else:
        count_of = lambda w: n[np.searchsorted(pair, keys << 20 | w)]
        n1, n2 = count_of(w1), np.where(size > 1, count_of(np.where(size > 1, w2, w1)), 0)
    place = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
    live = np.flatnonzero((keys.take(place) == context) & (total.take(place) > own))  # most contexts have the event itself alone
    place, word, own = place.take(live), word.take(live), own.take(live)
    one, two = w1.take(place), w2.take(place)
    top, second = n1.take(place) - (own & (word == one)), n2.take(place) - (own & (word == two))
    all_ = total.take(place) - own
    told = np.where(top < second, two, one)
    top = np.maximum(top, second)
    told = np.where(top > 0, told, 0)
    class_ = np.where(10 * top >= 9 * all_, 5, 4)
    class_[top < 4] = 3
    class_[2 * top < all_] = 6
    class_[top == 1] = 2
    class_[all_ <= 1] = 1
    best[live], sure[live] = told, np.where(told > 0, class_, 0)
    return best, sure


def _answers(rows: pa.Table) -> pa.Table:
    """The answers to all requests of one part, in the order of each batch's requests."""
    *events, ends = _opened([x.as_py() for x in rows.column("asked")])
    best, sure = successors(*events)
    planes = np.concatenate((_planes(best), sure.astype(np.uint8)[None]))
    told = [_small(planes[:, a:b].copy().tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"part": rows.column("part"), "row": rows.column("row"), "told": pa.array(told, pa.binary())})


def _guesses(kept: tuple, parts: int, told: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The answers for each word of a batch."""
    p, *_, which = _asked(kept, parts)
    planes = np.zeros((5, len(p)), np.uint8)
    cuts = np.searchsorted(p, np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        planes[:, cuts[k] : cuts[k + 1]] = np.frombuffer(_whole(told[int(k)]), np.uint8).reshape(5, -1)
    return _numbers(planes[:4]).take(which), planes[4].take(which)


def _mixed(rows: pa.Table, model: Model, parts: int) -> pa.Table:
    """The bits of each text of one batch; a row that was cut into several texts comes several times."""
    bodies, told = [], {}
    for part, body, asked in zip(rows.column("part").to_pylist(), rows.column("body"), rows.column("told"), strict=True):
        if part < 0:
            bodies.append(body.as_py())
        else:
            told[part] = asked.as_py()
    kept, of = _unpacked(bodies[0])
    guess, sure = _guesses(kept, parts, told)
    return pa.table({"row": pa.array(of), "bits": pa.array(model.bits(kept, guess, sure))})


def counted_words(training: DataFrame) -> DataFrame:
    """Rows (kind, key, n): words (0), bytes and texts (1), of all rows of ``training``."""
    return durable(training.select("text").mapInArrow(_count_signs, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


def lexicon(counts: DataFrame) -> tuple[Vocabulary, Code, Common, int, int]:
    """(vocabulary, byte code, common words, count from which words are in them, number of training texts) of counted words."""
    hist = np.zeros(257, np.int64)
    for key, n in counts.filter("kind = 1").select("key", "n").collect():  # 257 rows
        hist[key] = n
    words = counts.filter((F.col("kind") == 0) & (F.col("key") != END_HASH)).select("key", "n")
    common, least = common_words(words)
    spelled = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) - int(common.words.sum())
    return Vocabulary(np.concatenate(([spelled, hist[END]], common.words))), Code(hist), common, least, int(hist[END])


def train(bodies: DataFrame, vocabulary: Vocabulary, code: Code) -> Model:
    """The model, from batches of all training texts."""
    shared = bodies.sparkSession.sparkContext.broadcast((vocabulary, code))
    tables = durable(bodies.mapInArrow(lambda it: _count_contexts(it, *shared.value), "chunk int, source long, counts binary"), "tables")
    parts = (tables.agg(F.max("source")).first()[0] or 0) + 1
    while True:
        tables = tables.groupBy("chunk", F.floor(F.col("source") / FAN_IN).alias("part")).applyInArrow(_summed, "chunk int, source long, counts binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    table = np.zeros(2 * Layout(vocabulary).size, np.int32)
    for chunk, _, body in tables.collect():  # one table of fixed size, whatever the corpus
        lo = chunk * (2 << CHUNK_BITS)
        table[lo : lo + (2 << CHUNK_BITS)] = np.frombuffer(_whole(bytes(body)), np.int32)
    return Model(vocabulary, code, table)


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> tuple[Common, int]:
    """A table of at most ``most`` words, and the count from which words are in it."""
    top = 1 << 14
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(F.least("n", F.lit(top)).alias("n")).count().collect()), reverse=True)  # at most `top` rows
    size, least = 0, top + 1
    for n, words in steps:
        if size + words > most:
            break
        size, least = size + words, n
    found = counts.filter(F.col("n") >= least).toArrow() if size else None
    if found is None:
        return Common(np.zeros(0, np.int64), np.zeros(0, np.int64)), 1 << 62
    return Common(found["key"].to_numpy(), found["n"].to_numpy()), least


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte of each row of ``docs`` (doc_id, held_out, text).

    Learns from the rows that are not ``held_out`` (null counts as false).
    """
    docs = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text")
    counts = counted_words(docs.filter("not held_out"))
    total, kinds = counts.filter("kind = 0 and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    vocabulary, code, common, least, end_count = lexicon(counts)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(common)  # a table of bounded size
    coded = durable(docs.mapInArrow(lambda it: _coded(it, shared.value, total, kinds, end_count), _SCORES), "coded")
    bodies = coded.filter("kind = 2").select("row", "held_out", "body")
    model = train(bodies.filter("not held_out").select("body"), vocabulary, code)
    words = coded.filter("kind = 0").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = 1 + words // ENTRIES
    asked = bodies.mapInArrow(lambda it: _requests(it, parts), "part int, row long, asked binary")
    told = durable(asked.groupBy("part").applyInArrow(_answers, "part int, row long, told binary"), "told")
    mixer = context.broadcast(model)
    gathered = bodies.select("row", F.lit(-1).alias("part"), "body", F.lit(None).cast("binary").alias("told")).unionByName(told.select("row", "part", F.lit(None).cast("binary").alias("body"), "told"))
    bits = gathered.groupBy("row").applyInArrow(lambda t: _mixed(t, mixer.value, parts), "row long, bits double").groupBy("row").agg(F.sum("bits").alias("bits"))
    rare = counts.filter((F.col("kind") == 0) & (F.col("key") != END_HASH) & (F.col("n") < least)).select(F.col("key").alias("word"), F.col("n").alias("c"))
    more = coded.filter("kind = 1").select("row", "word", "n").join(rare, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("known"))
    rows = coded.filter("kind = 0").drop("word", "n", "body").join(bits, "row", "left").join(more, "row", "left")
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (-F.col("bits") * float(np.log10(2))).alias("score"), "bits", (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """All documents, learning from those that are not held out."""
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"))
