"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the tokenizer's pattern; each piece is encoded on its own. A
piece that is a token is that token. Otherwise the leaves of a segment tree hold,
for each byte position, the rank of the pair of symbols that begins there, and
the root names the leftmost pair of least rank. A merge changes three leaves (the
merged position, its live left neighbour, the position that died), each in a
logarithmic number of steps, so a piece of n bytes takes O(n log n).

Short pieces go through many trees side by side (numpy, one column each); long
pieces through one tree of Python integers. Encoded pieces are kept in a cache of
bounded size in each worker.

The rank file is read by the driver from a path given as a parameter and is
broadcast (its size is the vocabulary's). Defined cases: a null text is empty
and has no tokens; any text decodes to exactly its UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.durable import bound_batches
from quillspark.llm.textnum import pieces

SHORT = 32
CACHE = 500_000
#: Bytes of text at a time, so that many new pieces are encoded side by side.
PIECE = 1 << 20
_NONE = np.int64(1 << 62)


class Ranks:
    """A vocabulary: tokens by id, and the id of each pair of tokens that is a token again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.concatenate((keys[order], [_NONE]))
        self.merged = np.concatenate((np.fromiter(pairs.values(), np.int64, len(pairs))[order], [0]))

    @classmethod
    def read(cls, path: str, pattern: str) -> Ranks:
        """From a rank file: a token in base64 and its rank on each line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}, pattern)


class Encoder:
    """Encodes and decodes with one vocabulary; keeps a bounded cache of pieces."""

    def __init__(self, ranks: Ranks, cache: int = CACHE):
        self.r = ranks
        self.find = regex.compile(ranks.pattern).findall
        self.limit = cache
        self.cache: dict[str, bytes] = {}
        self._pairs: dict[int, int] | None = None

    # one long piece
    def _long(self, piece: bytes) -> list[int]:
        if self._pairs is None:
            self._pairs = dict(zip(self.r.keys[:-1].tolist(), self.r.merged[:-1].tolist(), strict=True))
        pair, none = self._pairs.get, int(_NONE)
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        shift = width.bit_length() - 1
        symbol = self.r.bytes[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pair(symbol[i] << 32 | symbol[i + 1])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    return
                tree[k] = value

        while (root := tree[1]) != none:
            i, rank = root & (width - 1), root >> shift
            dead = after[i]
            right = after[dead]
            symbol[i], symbol[dead] = rank, -1
            after[i] = right
            put(dead, none)
            if right < n:
                before[right] = i
                new = pair(rank << 32 | symbol[right])
                put(i, none if new is None else new << shift | i)
            else:
                put(i, none)
            left = before[i]
            if left >= 0:
                new = pair(symbol[left] << 32 | rank)
                put(left, none if new is None else new << shift | left)
        return [s for s in symbol if s >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each merged pair, or a large number; a symbol under 0 has no pair."""
        key = (a << 32) | b
        at = np.searchsorted(self.r.keys, key)
        at[at >= len(self.r.keys)] = 0
        return np.where((self.r.keys[at] == key) & (a >= 0) & (b >= 0), self.r.merged[at], _NONE >> 32)

    # many short pieces, side by side: arrays are [position, piece]
    def _short(self, found: list[bytes]) -> list[bytes]:
        longest = max(map(len, found))
        width = 1 << max(1, (longest - 1).bit_length())
        shift, m = width.bit_length() - 1, len(found)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in found), np.uint8).reshape(m, width).T
        sizes = np.array([len(p) for p in found])
        symbol = np.where(np.arange(width)[:, None] < sizes, self.r.bytes[data], -1)
        symbol = np.vstack((symbol, np.full((1, m), -1)))  # row `width` stands for the end
        following = np.arange(1, width + 1)[:, None]
        after = np.where(following < sizes, following, width)
        before = np.vstack((np.arange(-1, width - 1)[:, None] + np.zeros((1, m), np.int64), np.zeros((1, m), np.int64)))
        tree = np.full((2 * width, m), _NONE, np.int64)
        place = np.arange(width)[:, None]
        rank = np.full((width, m), _NONE >> 32, np.int64)
        rank[:-1] = self._rank(symbol[: width - 1], symbol[1:width])
        tree[width:] = np.where(rank < _NONE >> 32, rank << shift | place, _NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        live = np.flatnonzero(tree[1] != _NONE)
        while len(live):
            root = tree[1, live]
            i, new = root & (width - 1), root >> shift
            dead = after[i, live]
            right = after[dead, live]
            left = before[i, live]
            symbol[i, live], symbol[dead, live] = new, -1
            after[i, live] = right
            before[right, live] = i  # row `width` takes what has no right neighbour
            ra = self._rank(new, symbol[right, live])
            rb = self._rank(np.where(left >= 0, symbol[np.maximum(left, 0), live], -1), new)
            tree[width + dead, live] = _NONE
            tree[width + i, live] = np.where(ra < _NONE >> 32, ra << shift | i, _NONE)
            some = left >= 0
            tree[width + left[some], live[some]] = np.where(rb[some] < _NONE >> 32, rb[some] << shift | left[some], _NONE)
            node = np.concatenate((width + dead, width + i, width + np.maximum(left, 0)))
            who = np.concatenate((live, live, live))
            for _ in range(shift):
                node >>= 1
                tree[node, who] = np.minimum(tree[2 * node, who], tree[2 * node + 1, who])
            live = live[tree[1, live] != _NONE]
        flat = symbol[:width].T
        keep = flat >= 0
        ids = flat[keep].astype("<u4")
        ends = np.cumsum(keep.sum(1)) * 4
        body = ids.tobytes()
        return [body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, new: Iterable[str]) -> dict[str, bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        out: dict[str, bytes] = {}
        short: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode()
            if (i := self.r.ranks.get(data)) is not None:
                out[piece] = i.to_bytes(4, "little")
            elif len(data) > SHORT:
                out[piece] = np.array(self._long(data), "<u4").tobytes()
            else:
                short.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for group in short.values():
            for lo in range(0, len(group), 20_000):
                some = group[lo : lo + 20_000]
                out.update(zip((p for p, _ in some), self._short([d for _, d in some]), strict=True))
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        found = [self.find(t) for t in texts]
        kinds = set().union(*found)
        if len(self.cache) + len(kinds) > self.limit:
            self.cache = {}
        new = self._learn(kinds.difference(self.cache))
        self.cache.update((p, v) for p, v in new.items() if len(p) <= 64)
        known = self.cache if all(len(p) <= 64 for p in new) else self.cache | new
        for text_pieces in found:
            yield np.frombuffer(b"".join(map(known.__getitem__, text_pieces)), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.r.tokens.__getitem__, ids))


_WORKER: dict[object, Encoder] = {}


def worker_encoder(key: object, ranks: Ranks) -> Encoder:
    """One encoder, with its cache, for all tasks of a Python worker."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(ranks)
    return _WORKER[key]


_FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _run(docs: DataFrame, ranks: Ranks, fields: list[T.StructField], rows) -> DataFrame:  # noqa: ANN001
    docs = docs.drop(*[f.name for f in fields])
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key, schema = shared._jbroadcast.id(), T.StructType([*docs.schema.fields, *fields])
    plain = to_arrow_schema(schema)
    own = [plain.field(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, shared.value)
        for whole in batches:
            for batch in pieces(whole, limit=PIECE):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                out = [rows(encoder, ids) for ids in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in out], f.type) for k, f in enumerate(own)]], schema=plain)

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """``docs`` with a column ``token_ids``."""
    return _run(docs, ranks, [T.StructField("token_ids", T.ArrayType(T.IntegerType()))], lambda _, ids: (ids.astype(np.int32),))


def decode_documents(encoded: DataFrame, ranks: Ranks, column: str = "token_ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (bytes)."""
    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != "decoded"], T.StructField("decoded", T.BinaryType())])
    shared, plain = encoded.sparkSession.sparkContext.broadcast(ranks.tokens), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for batch in batches:
            ids = batch.column(column)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b"".join(map(get, x.as_py() or ())) for x in ids], pa.binary())], schema=plain)

    return encoded.drop("decoded").mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """Encode each text, decode the ids again: n_tokens, and the hashes of the decimal ids and of the decoded bytes, beside ``docs``' columns but text."""
    decimal = [str(i) for i in range(len(ranks.tokens))]

    def row(encoder: Encoder, ids: np.ndarray) -> tuple:
        numbers = ids.tolist()
        listed = ",".join(map(decimal.__getitem__, numbers)).encode()
        return len(numbers), hashlib.sha256(listed).hexdigest(), hashlib.sha256(encoder.decode(numbers)).hexdigest()

    return _run(docs, ranks, _FIELDS, row).drop("text")
