"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over the word windows of all texts.

Words are runs of ASCII letters or digits and of any non-ASCII characters,
after A-Z became a-z. A window is ``n`` (13) consecutive words of an item; an
item of fewer words, but not none, is one window. Every document word inside
any occurrence of a window is hit. Hash hits are verified on the words
themselves, so no hash collision can mark a document.

The windows go to the executors as one broadcast only while they number at most
``MAX_WINDOWS``; beyond that both sides are shuffled on the window hash
(:func:`_joined_hits`), with the same result.

Defined cases: a null or empty text has no words, hits nothing and is clean; an
item without words is ignored; repeated items count each for themselves;
repeated documents get one result row each; either table may be empty; a text of any
length is scanned as a whole, in memory of about 40 times its bytes; ``docs`` may have
any other columns (:func:`mark` replaces those of its results, :func:`clean` none).
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.durable import durable
from quillspark.llm.textnum import ALNUM, Words, joined, pieces, raw

N = 13
#: About 150 bytes each in a worker.
MAX_WINDOWS = 400_000
_FILTER_BITS = 22

_OWN = "__quillspark_"
RESULT = T.StructType(
    [
        T.StructField(_OWN + "n_words", T.LongType()),
        T.StructField(_OWN + "n_hit", T.LongType()),
        T.StructField(_OWN + "n_items", T.LongType()),
        T.StructField(_OWN + "items_sha256", T.StringType()),
        T.StructField(_OWN + "contaminated", T.BooleanType()),
        T.StructField(_OWN + "spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


def _item_windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(hash, length, words, item_id) of each window of each item."""
    for whole in batches:
        for batch in pieces(whole):
            words = Words(*raw(batch.column("text")), ALNUM)
            hashes, ids = words.hashes(), batch.column("item_id").to_pylist()
            out: list[tuple[int, int, bytes, str]] = []
            for k, item in enumerate(ids):
                first, last = int(words.bounds[k]), int(words.bounds[k + 1])
                if last > first:
                    size = min(n, last - first)
                    for i, h in enumerate(joined(hashes[first:last], size).view(np.int64).tolist()):
                        out.append((h, size, words.lowered(first + i, first + i + size), str(item)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["hash", "length", "words", "item_id"])


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """The windows of all items, each item's distinct ones once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(lambda it: _item_windows(it, n), "hash long, length int, words binary, item_id string").distinct()


class Lookup:
    """Windows by hash, with a bit filter in front."""

    def __init__(self, rows: list[tuple[int, int, bytes, str]]):
        found: dict[int, dict[int, dict[bytes, list[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for h, size, words, item in rows:
            found[size][h][bytes(words)].append(item)
        self.by_size = {size: {h: dict(w) for h, w in hs.items()} for size, hs in sorted(found.items())}
        self.filters = {}
        for size, hs in self.by_size.items():
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[np.fromiter(hs, np.int64, len(hs)).view(np.uint64) >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[size] = bits


def _result(n_words: int, hit: np.ndarray | None, items: set[str]) -> tuple:
    n_hit = int(hit.sum()) if hit is not None else 0
    spans: list[list[int]] = []
    if n_hit:
        change = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        spans = change.reshape(-1, 2).tolist()
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words, spans


def _scan(batches: Iterator[pa.RecordBatch], look: Lookup, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            words = Words(*raw(batch.column("text")), ALNUM)
            hashes = words.hashes()
            last_of = np.repeat(words.bounds[1:], words.counts)
            hits: dict[int, list[tuple[int, int, list[str]]]] = defaultdict(list)
            for size, known in look.by_size.items():
                windows = joined(hashes, size)
                if not len(windows):
                    continue
                maybe = look.filters[size][windows >> np.uint64(64 - _FILTER_BITS)]
                maybe &= np.arange(size, len(words) + 1) <= last_of[: len(windows)]
                at = np.flatnonzero(maybe)
                for i, h in zip(at.tolist(), windows[at].view(np.int64).tolist(), strict=True):
                    if (same := known.get(h)) and (items := same.get(words.lowered(i, i + size))):
                        hits[int(np.searchsorted(words.bounds, i, "right")) - 1].append((i, size, items))
            rows = []
            for k in range(batch.num_rows):
                n_words, found = int(words.counts[k]), hits.get(k)
                hit, items = None, set()
                if found:
                    hit = np.zeros(n_words, bool)
                    for i, size, of in found:
                        at = i - int(words.bounds[k])
                        hit[at : at + size] = True
                        items.update(of)
                rows.append(_result(n_words, hit, items))
            cols = [pa.array([r[j] for r in rows], schema.field(batch.num_columns + j).type) for j in range(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=schema)


_ROW = "__quillspark_row"


def _windows_of(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(row, hash, length, at) of every word window of every text: numbers only."""
    for whole in batches:
        for batch in pieces(whole, limit=1 << 18):
            words = Words(*raw(batch.column("text")), ALNUM)
            hashes, rows = words.hashes(), batch.column(_ROW).to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), words.counts)
            last_of = words.bounds[1:][doc]
            for size in sizes:
                windows = joined(hashes, size)
                ok = np.flatnonzero(np.arange(size, len(words) + 1)[: len(windows)] <= last_of[: len(windows)])
                for lo in range(0, len(ok), 100_000):
                    at = ok[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc[at]]), pa.array(windows[at].view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array((at - words.bounds[doc[at]]).astype(np.int32))], [_ROW, "hash", "length", "at"])


def _words_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, hash, length, at, words) of the windows whose hash is a benchmark's."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for whole in batches:
        for batch in pieces(whole, limit=1 << 18):
            words, out = Words(*raw(batch.column("text")), ALNUM), []
            for k, (row, maybe) in enumerate(zip(batch.column(_ROW).to_pylist(), batch.column("maybe").to_pylist(), strict=True)):
                first = int(words.bounds[k])
                out += [(row, m["hash"], m["length"], m["at"], words.lowered(first + m["at"], first + m["at"] + m["length"])) for m in maybe]
            for lo in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out[lo : lo + 20_000]], kind) for j, kind in enumerate(kinds)], [_ROW, "hash", "length", "at", "words"])


def _joined_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """The same result with both sides shuffled on the window hash: for benchmarks beyond the bound.

    Rows get a number that is kept in a table, so no two rows are ever one. Hashes meet first; the
    words of hits only are then compared.
    """
    windows = durable(windows, "windows")
    sizes = [r[0] for r in windows.select("length").distinct().collect()]  # at most n of them
    rows = durable(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    scanned = rows.select(_ROW, "text").mapInArrow(lambda it: _windows_of(it, sizes), f"{_ROW} long, hash long, length int, at int")
    maybe = scanned.join(windows.select("hash", "length").distinct(), ["hash", "length"], "left_semi").groupBy(_ROW).agg(F.collect_list(F.struct("hash", "length", "at")).alias("maybe"))
    found = rows.select(_ROW, "text").join(maybe, _ROW).mapInArrow(_words_at, f"{_ROW} long, hash long, length int, at int, words binary")
    spans, items = "__quillspark_at", "__quillspark_items"
    hits = found.join(windows, ["hash", "length", "words"]).groupBy(_ROW).agg(F.collect_set(F.struct("at", "length")).alias(spans), F.array_sort(F.collect_set("item_id")).alias(items))
    fields = [f.name for f in docs.schema.fields]
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    plain = to_arrow_schema(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                counts, out = Words(*raw(batch.column("text")), ALNUM).counts, []
                for n_words, hit_at, of in zip(counts.tolist(), batch.column(spans).to_pylist(), batch.column(items).to_pylist(), strict=True):
                    hit = np.zeros(n_words, bool) if hit_at else None
                    for s in hit_at or []:
                        hit[s["at"] : s["at"] + s["length"]] = True
                    out.append(_result(n_words, hit, set(of or [])))
                cols = [pa.array([r[j] for r in out], plain.field(len(fields) + j).type) for j in range(6)]
                yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in fields], *cols], schema=plain)

    return rows.join(hits, _ROW, "left").select(*fields, spans, items).mapInArrow(finish, schema)


def _marked(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int) -> DataFrame:
    """``docs`` with the private columns of :data:`RESULT`."""
    windows = item_windows(benchmark, n)
    rows = [tuple(r) for r in windows.limit(max_windows + 1).collect()]  # bounded; the size decides the way
    if len(rows) > max_windows:
        return _joined_hits(docs, windows)
    look = docs.sparkSession.sparkContext.broadcast(Lookup(rows))
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])
    plain = to_arrow_schema(schema)
    return docs.mapInArrow(lambda it: _scan(it, look.value, plain), schema)


def mark(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and spans ([first, last+1] word ranges that are hit), in place of columns of these names."""
    names = {f.name: f.name.removeprefix(_OWN) for f in RESULT.fields}
    return _marked(docs.drop(*names.values()), benchmark, n, max_windows).withColumnsRenamed(names)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Only documents that are not contaminated, with all their own columns as they are."""
    return _marked(docs, benchmark, n, max_windows).filter(f"not {_OWN}contaminated").select(*docs.columns)
