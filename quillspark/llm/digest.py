"""Document fingerprints: a quartile bucket digest of hashed byte triplets, compared by a bounded difference.

Every three neighbouring bytes of a text (of its UTF-8 form) are hashed into one
of 256 buckets. The digest holds each bucket's quartile in two bits (64 bytes),
a logarithmic length code (one byte) and a checksum (one byte), 132
hexadecimal digits. Texts of fewer than three bytes have no triplet: all
quartiles are 0 and length and checksum alone tell them apart.

Difference: the distance of the quartile codes summed over the buckets (3 counts
as 6, as opposite quartiles are strong evidence), plus 12 for each step of the
length code, plus 1 if the checksums differ, held at ``WORST``. Likeness is
1 - difference / WORST, between 0 and 1.

Defined cases: a null text is empty; equal texts have equal digests; empty
digests are alike (1.0); equal counts at a quartile's border share the lower quartile;
rows with one doc_id, and equal rows, are neighbours in an order by text hash; an empty
table gives an empty result; a long text is hashed as a whole, in memory of about 20
times its bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.durable import durable
from quillspark.llm.textnum import mix

BUCKETS = 256
WORST = 512
_T = mix(np.arange(1, 257, dtype=np.uint64))
_FIRST, _SECOND, _THIRD = ((mix(_T + np.uint64(k)) >> np.uint64(40)).astype(np.uint32) for k in (1, 2, 3))


def digest(data: bytes) -> str:
    """The fingerprint of a text's bytes."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 3:
        codes, check = np.zeros(BUCKETS, np.uint8), (sum(data) * 7 + len(data)) & 255
    else:
        h = _FIRST[b[:-2]] + _SECOND[b[1:-1]] * np.uint32(5) + _THIRD[b[2:]] * np.uint32(17)
        h *= np.uint32(0x9E3779B1)
        counts = np.bincount(h >> np.uint32(24), minlength=BUCKETS)
        order = np.sort(counts)
        q1, q2, q3 = order[BUCKETS // 4 - 1], order[BUCKETS // 2 - 1], order[3 * BUCKETS // 4 - 1]
        codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
        check = int(np.bitwise_xor.reduce(h) >> np.uint32(16)) & 255
    packed = codes[0::4] | (codes[1::4] << 2) | (codes[2::4] << 4) | (codes[3::4] << 6)
    size = min(255, round(math.log(len(data) + 1) * 8))
    return packed.astype(np.uint8).tobytes().hex() + f"{size:02x}{check:02x}"


_GAP = np.array([0, 1, 2, 6], np.int64)
_CODES = np.stack([(np.arange(256) >> s) & 3 for s in (0, 2, 4, 6)])
_DIFF = _GAP[np.abs(_CODES[:, :, None] - _CODES[:, None, :])].sum(0)


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most ``WORST``."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    body = int(_DIFF[x[:-2], y[:-2]].sum())
    return min(WORST, body + 12 * abs(int(x[-2]) - int(y[-2])) + int(x[-1] != y[-1]))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / WORST


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` (replacing one of that name)."""

    @F.pandas_udf("string")
    def of(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: digest((t or "").encode()))

    return docs.withColumn("fingerprint", of(F.col(column)))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/4) code points replaced by the first as many, or all, of the following text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


_ROWS = pa.schema(
    [
        ("kind", pa.int8()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
    ]
)
_DDL = "kind byte, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _judge(doc_id: int, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following).encode()
    own = digest(new)
    return 0, 0, doc_id, len(text), hashlib.sha256(new).hexdigest(), mark, own, likeness(mark, own), likeness(mark, next_mark), None


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _ROWS.field(k).type) for k in range(len(_ROWS))], schema=_ROWS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of one range: results (kind 0) of all but the last, and the range's first (1) and last (2) with their texts."""
    held, part, out = None, None, []
    for batch in batches:
        for doc_id, text, p in zip(batch.column("doc_id"), batch.column("text"), batch.column("part"), strict=True):
            doc_id, text, part = doc_id.as_py(), text.as_py() or "", p.as_py()
            mark = digest(text.encode())
            if held is None:
                out.append((1, part, doc_id, None, None, mark, None, None, None, text))
            else:
                out.append(_judge(*held, text, mark))
            held = (doc_id, text, mark)
            if len(out) >= 2000:
                yield _rows(out)
                out = []
    if held is not None:
        out.append((2, part, held[0], None, None, held[2], None, None, None, held[1]))
    if out:
        yield _rows(out)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            yield _rows([_judge(r["doc_id"], r["text"] or "", r["fingerprint"], r["next_text"] or "", r["next_mark"]) for r in rows])


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document by ascending doc_id (after the last: the first).

    One range shuffle deals the texts out; all pairs inside a range are judged in
    one pass, and the last document of a range is judged against the first of the
    next range that has rows. Rows with one doc_id are ordered by a hash of their
    text, which also splits a doc_id that holds many rows. One document is its own next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = durable(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_neighbours, _DDL), "digest")
    firsts = done.filter("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    order = Window.orderBy("next_part")  # one row for each range, without texts
    ring = firsts.select("next_part").select("next_part", F.lag("next_part").over(order).alias("before"), F.max("next_part").over(Window.partitionBy()).alias("highest"))
    ring = ring.select("next_part", F.coalesce("before", "highest").alias("part"))
    last = done.filter("kind = 2").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(ring), "part").join(firsts, "next_part")
    border = last.select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(_borders, _DDL)
    return done.filter("kind = 0").unionByName(border).drop("kind", "part", "text")
