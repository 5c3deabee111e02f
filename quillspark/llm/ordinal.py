"""Quality grading by ordinal cumulative-link regression on hashed text features.

A document's rating is 0 (toxic), 1 (not toxic, poor) or 2 (not toxic, good). One
vector of weights over hashed features is shared by all grades, and ordered
thresholds cut its line: P(grade > k) = logistic(w . x - threshold_k). From it come
the expected grade and the tail probability P(grade >= g) by which documents are
selected.

Features (2**``BITS`` slots): the distinct words of the whole text in lower case, their
first 4, 5 and 6 bytes, and the level of some measures of its form (shares of capitals, signs, digits and line breaks, word length,
words repeated at once).

Training uses at most about ``MAX_LABELLED`` rated documents, picked by a hash of
doc_id (documented bound; all below it), and never those with crc32(doc_id as
text) mod 5 = 0, which stay for measuring. Words in fewer than ``MIN_DOCUMENTS``
of them, or that tell nothing (:func:`_telling`), get no weight. Grading covers all documents.

Defined cases: a null or empty text has no features and gets the grade that the
thresholds alone give; labels with a null in quality or toxic are not used, nor
labels without a document; repeated labels of a document count each; without any
label all grades are equally probable; repeated rows are graded each for itself; equal
tails at a threshold are kept; a text of any length is read as a whole, in memory of
about 60 times its bytes; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.llm.textnum import ALNUM, VALUES, Words, mix, pieces, raw, span_hashes

BITS = 20
MAX_LABELLED = 16_000
MIN_DOCUMENTS = 12
#: Lengths in bytes of the word beginnings that are features, so that inflected forms share weights.
PREFIXES = (4, 5, 6)
GRADES = 3
#: A slot gets a weight if its rates on both sides of a threshold differ by this many standard errors and this factor.
CLEAR, FACTOR = 5.0, 1.5
_U = np.uint64
_LEVELS = 12


def held_out(doc_id: Column) -> Column:
    """Rated documents that training must not see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _form(data: np.ndarray, offsets: np.ndarray, words: Words, hashes: np.ndarray) -> list[np.ndarray]:
    """For each measure: the level of each text."""
    n = len(offsets) - 1
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    upper = total((data >= 65) & (data <= 90))
    lower = total((data >= 97) & (data <= 122))
    digit = total((data >= 48) & (data <= 57))
    blank = total((data == 32) | ((data >= 9) & (data <= 13)))
    sign = total((data > 32) & (data < 127) & ~ALNUM[data])
    breaks = total(data == 10)
    size = np.diff(offsets)
    again = np.zeros(len(words), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    first = words.bounds[:-1]
    again[first[first < len(words)]] = False
    repeats = np.diff(np.concatenate(([0], np.cumsum(again)))[words.bounds])
    share = lambda a, b: np.minimum(_LEVELS - 1, (np.sqrt(a / np.maximum(1, b)) * _LEVELS).astype(np.int64))
    length = np.minimum(_LEVELS - 1, (size - blank) // np.maximum(1, words.counts))
    return [share(upper, upper + lower), share(sign, size - blank), share(digit, size - blank), share(20 * breaks, 20 * size), share(repeats, words.counts), length.reshape(n)]


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of each text, one after another, and their ranges."""
    data, offsets = raw(column)
    n = len(offsets) - 1
    words = Words(data, offsets, ALNUM)
    hashes = words.hashes()
    owner = np.repeat(np.arange(n), words.counts)
    at = owner.astype(_U) << _U(BITS)
    found = [at | (hashes >> _U(64 - BITS))]
    values = VALUES[data]
    for k in PREFIXES:
        long = np.flatnonzero(words.ends - words.starts > k)
        found.append(at[long] | (mix(span_hashes(values, words.starts[long], words.starts[long] + k) + _U(k)) >> _U(64 - BITS)))
    full = np.flatnonzero(np.diff(offsets)).astype(_U)
    for k, level in enumerate(_form(data, offsets, words, hashes)):
        slot = mix(np.full(len(full), 1000 * (k + 1), _U) + level[full.astype(np.int64)].astype(_U)) >> _U(64 - BITS)
        found.append((full << _U(BITS)) | slot)
    keys = np.unique(np.concatenate(found))
    return (keys & _U((1 << BITS) - 1)).astype(np.int64), np.searchsorted(keys, np.arange(n + 1).astype(_U) << _U(BITS))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Grader:
    """Weights by slot and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text, for k below the highest grade."""
        n = len(bounds) - 1
        line = np.bincount(np.repeat(np.arange(n), np.diff(bounds)), self.weights[slots], n) if n else np.zeros(0)
        return _logistic(line[:, None] - self.thresholds)


def _telling(slots: np.ndarray, of: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Slots whose rate differs clearly, and by a factor, between the documents above and below some threshold."""
    size, n = 1 << BITS, len(grades)
    total = np.bincount(slots, minlength=size)
    used = np.zeros(size, bool)
    for k in range(GRADES - 1):
        n_up = int((grades > k).sum())
        if not 0 < n_up < n:
            continue
        up = np.bincount(slots[of > k], minlength=size)
        a, b, p = (up + 0.5) / (n_up + 1), (total - up + 0.5) / (n - n_up + 1), (total + 0.5) / (n + 1)
        z = np.abs(a - b) / np.sqrt(p * (1 - p) * (1 / n_up + 1 / (n - n_up)))
        used |= (z > CLEAR) & (np.maximum(a, b) > FACTOR * np.minimum(a, b))
    return used & (total >= MIN_DOCUMENTS)


def fit(slots: np.ndarray, bounds: np.ndarray, grades: np.ndarray, rounds: int = 400, decay: float = 1e-5, rate: float = 0.1) -> Grader:
    """Minimise the cumulative-link cost by full-batch gradients with adaptive steps (Adam)."""
    n, size = len(grades), 1 << BITS
    if not n:
        return Grader(np.zeros(size, np.float32), np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    used = _telling(slots, grades[owner], grades)
    place = np.cumsum(used) - 1
    keep = used[slots]
    cols, rows = place[slots[keep]], owner[keep]
    m = int(used.sum())
    share = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)])
    x = np.concatenate((np.zeros(m), np.log((1 - share) / share)))
    first, second = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        line = np.bincount(rows, x[cols], n)
        p = _logistic(line[:, None] - x[m:])
        # log-likelihood of grade g: log(P(>g-1) - P(>g))
        upper = np.concatenate((np.ones((n, 1)), p), 1)[np.arange(n), grades]
        lower = np.concatenate((p, np.zeros((n, 1))), 1)[np.arange(n), grades]
        gap = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / gap, lower * (1 - lower) / gap
        pull = np.empty_like(x)
        pull[:m] = np.bincount(cols, (du - dl)[rows], m) / n - decay * x[:m]
        for k in range(GRADES - 1):
            pull[m + k] = (dl * (grades == k) - du * (grades == k + 1)).sum() / n
        first += 0.1 * (pull - first)
        second += 0.001 * (pull * pull - second)
        x += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        x[m:] = np.sort(x[m:])
    weights = np.zeros(size, np.float32)
    weights[used] = x[:m]
    return Grader(weights, x[m:])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            slots, bounds = features(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(slots.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int32()), lists], ["grade", "slots"])


def train(rated: DataFrame, most: int = MAX_LABELLED) -> Grader:
    """From (doc_id, text, grade): features are made on the executors, the bounded sample is fitted on the driver."""
    n = rated.count()
    bound = min(1 << 30, (most << 30) // max(1, n))
    picked = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < bound).select("text", "grade")
    found = picked.mapInArrow(_features, "grade int, slots array<int>").toArrow()
    lists = found.column("slots").combine_chunks()
    slots = np.asarray(lists.flatten()).astype(np.int64)
    sizes = np.array([] if not len(lists) else lists.value_lengths(), np.int64)
    return fit(slots, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), found.column("grade").to_numpy().astype(np.int64))


def grade(docs: DataFrame, grader: Grader, least: int = 1, probability: float = 0.5, good_probability: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, p_not_toxic, p_good, kept and selected, in place of columns of these names.

    ``kept`` is the filter (P(grade >= least) is at least ``probability``: not toxic), ``selected`` the
    selection by quality (P(grade is good) is at least ``good_probability``, and kept).
    """
    new = ["expected_grade", "p_not_toxic", "p_good", "kept", "selected"]
    docs = docs.drop(*new)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in new[:3]], *[T.StructField(c, T.BooleanType()) for c in new[3:]]])
    plain, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(grader)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                tails = shared.value.tails(*features(batch.column("text")))
                kept = np.ones(len(tails), bool) if least < 1 else tails[:, least - 1] >= probability
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(kept), pa.array(kept & (tails[:, 1] >= good_probability))], schema=plain)

    return docs.mapInArrow(run, schema)


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade) of the rated documents that training may see."""
    rating = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rows = labels.filter("quality is not null and toxic is not null").select("doc_id", rating.alias("grade"))
    return docs.select("doc_id", "text").join(rows.filter(~held_out(F.col("doc_id"))), "doc_id")


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, p_not_toxic, p_good, kept and selected of all documents."""
    grader = train(rated_documents(docs, labels))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return grade(rows, grader).drop("text")
