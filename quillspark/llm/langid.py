"""Language identification with language-bitmask n-gram filters.

Training learns, for each language, which byte 3-grams and 4-grams are typical:
n-grams seen ``MIN_COUNT`` times whose rate is at least ``SHARE`` of the highest
rate that any language has for them. They are stored in Bloom filters, one per
language, kept bit-sliced: position ``p`` of the table holds one bit for each
language, so that two look-ups and one AND return all languages that contain an
n-gram. A text's n-grams are counted per language (popcounts), each count is
corrected for the filter's false positives, and the highest decides.

Training reads at most about ``MAX_PER_LANGUAGE`` labelled documents of each
language, picked by a hash of doc_id (documented bound; all are used below it).
Prediction covers every whole text and uses the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language with more training texts, then by name; n-grams never
cross documents; if no labelled text exists all is ``und``; repeated rows count each
for itself, in training and in the result; a text of any length is read as a whole, in
memory of about 60 times its bytes; other columns stay as they are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.durable import durable
from quillspark.llm.textnum import LOWER, mix, pieces

MAX_PER_LANGUAGE = 8000
MIN_COUNT = 4
SHARE = 0.4
SLOT_BITS = 21
TABLE_BITS = 21
UNKNOWN = "und"
#: Tables of counts (8 MB each) that a worker holds at once.
MOST_TABLES = 16
_LETTER = regex.compile(r"\p{L}")
_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not (97 <= LOWER[b] <= 122)]] = 32
_BOTH = np.uint64((1 << SLOT_BITS) - 1)


def held_out(doc_id: Column) -> Column:
    """Documents that training must not see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of all texts, and the range of slots of each text.

    Bytes that are no letters become blanks; capitals of ASCII and of Latin-1 are folded.
    """
    parts = [b"  " + t.encode() + b" " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    data = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20
    b = data.astype(np.uint32)
    four = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    use = ~((data[1:-2] == 32) & (data[2:-1] == 32))
    # a gram that ends in another text is not used: each text begins with two blanks
    border = ends[:-1]
    for k in range(1, 4):
        use[border[border - k < len(use)] - k] = False
    at = np.flatnonzero(use)
    keys = four[at].astype(np.uint64)
    bounds = np.searchsorted(at, np.concatenate(([0], ends)))
    slots = np.empty(2 * len(keys), np.uint64)
    slots[0::2] = mix(keys + np.uint64(1)) & _BOTH
    slots[1::2] = mix((keys & np.uint64(0xFFFFFF)) | np.uint64(1 << 40)) & _BOTH
    return slots.astype(np.int64), bounds * 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for whole in batches:
        for batch in pieces(whole):
            texts, langs = [t or "" for t in batch.column("text").to_pylist()], batch.column("lang").to_pylist()
            slots, bounds = _grams(texts)
            for k, lang in enumerate(langs):
                if lang not in counts:
                    counts[lang] = np.zeros(1 << SLOT_BITS, np.int32)
                np.add.at(counts[lang], slots[bounds[k] : bounds[k + 1]], 1)
                docs[lang] = docs.get(lang, 0) + 1
        if len(counts) > MOST_TABLES:
            yield from _told(counts, docs)
            counts, docs = {}, {}
    yield from _told(counts, docs)


def _told(counts: dict[str, np.ndarray], docs: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        for lo in range(0, len(at), 50_000):
            some = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(c[some].astype(np.int64))], ["lang", "slot", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([-1]), pa.array([docs[lang]])], ["lang", "slot", "n"])


class Filters:
    """Bit-sliced Bloom filters: ``table[w, p]`` has the bits of languages 64*w to 64*w+63 at position p."""

    def __init__(self, langs: list[str], typical: list[np.ndarray]):
        self.langs = langs
        size = 1 << TABLE_BITS
        self.table = np.zeros((max(1, (len(langs) + 63) // 64), size), np.uint64)
        self.false_rate = np.zeros(len(langs))
        for k, slots in enumerate(typical):
            for p in self.positions(slots):
                self.table[k // 64, p] |= np.uint64(1 << (k % 64))
            filled = float(np.count_nonzero(self.table[k // 64] & np.uint64(1 << (k % 64)))) / size
            self.false_rate[k] = filled**2

    @staticmethod
    def positions(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(slots.astype(np.uint64) + np.uint64(0x5851F42D))
        return (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64), (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def shares(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each text and language: the corrected share of the text's n-grams that the language has."""
        p, q = self.positions(slots)
        n = np.diff(bounds)
        out = np.zeros((len(n), len(self.langs)))
        some = np.flatnonzero(n)
        if not len(some):
            return out
        for w, rows in enumerate(self.table):
            masks = rows[p] & rows[q]
            for k in range(w * 64, min(len(self.langs), w * 64 + 64)):
                bits = ((masks >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int32)
                out[some, k] = np.add.reduceat(bits, bounds[:-1][some]) / n[some]
        return np.clip((out - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        shares = self.shares(*_grams([t or "" for t in texts])) if texts and self.langs else np.zeros((len(texts), 0))
        names, scores = [], []
        for k, t in enumerate(texts):
            if t is None or not self.langs or not _LETTER.search(t):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(np.argmax(shares[k]))
                names.append(self.langs[best])
                scores.append(float(shares[k, best]))
        return names, scores


def train(labelled: DataFrame, max_per_language: int = MAX_PER_LANGUAGE) -> Filters:
    """Filters of the languages in ``labelled`` (doc_id, text, lang); rows without text or lang are ignored."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Filters([], [])
    rank = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    bound = F.create_map(*[F.lit(x) for x in itertools.chain.from_iterable((k, min(1 << 30, (max_per_language << 30) // n)) for k, n in sizes.items())])
    picked = rows.filter(rank < bound[F.col("lang")]).select("text", "lang")
    counted = durable(picked.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")), "grams")
    docs = {r[0]: r[1] for r in counted.filter("slot < 0").select("lang", "n").collect()}
    seen = counted.filter((F.col("n") >= MIN_COUNT) & (F.col("slot") >= 0))
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = seen.join(F.broadcast(totals), "lang").select("lang", "slot", (F.col("n") / F.col("total")).alias("rate"))  # one row for each language
    top = rates.groupBy("slot").agg(F.max("rate").alias("top"))
    found = rates.join(top, "slot").filter(F.col("rate") >= SHARE * F.col("top")).groupBy("lang").agg(F.collect_list("slot").alias("slots"))
    typical = {r[0]: np.sort(np.array(r[1], np.int64)) for r in found.collect()}  # what the filters hold: few languages share an n-gram
    langs = sorted(docs, key=lambda k: (-docs[k], k))
    return Filters(langs, [typical.get(k, np.zeros(0, np.int64)) for k in langs])


def identify(docs: DataFrame, filters: Filters, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, in place of columns of these names."""
    docs = docs.drop(*names)
    known = docs.sparkSession.sparkContext.broadcast(filters)  # bounded: languages/64 x 2**TABLE_BITS words
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    plain = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                found, scores = known.value.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], schema=plain)

    return docs.mapInArrow(run, schema)


def of_known_language(docs: DataFrame, filters: Filters) -> DataFrame:
    """Documents of which a language is known, with all their own columns as they are."""
    own = ("__quillspark_lang", "__quillspark_score")
    return identify(docs, filters, own).filter(F.col(own[0]) != UNKNOWN).select(*docs.columns)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Train on the labelled documents that are not held out, then predict all: doc_id, held_out, lang_pred, score."""
    filters = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, filters).drop("text")
