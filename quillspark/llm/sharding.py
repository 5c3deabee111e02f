"""Sharding by a Feistel permutation with cycle walking over global row numbers (DataFrame functions only).

Rows get global numbers 0..n-1 without a global sort: a row's place is its hash
bucket, then its key inside the bucket. Only the bucket sizes (a fixed number
of rows) meet in one place. Number ``i`` goes to ``p = permute(i)``, a
bijection of 0..n-1; shard is ``p % shards`` and slot ``p // shards``, so shard
sizes differ by one row at most and any row's place can be computed from its
number, n and the seed alone (:func:`place_of`).

Defined cases: a null text has no bytes and counts as empty; rows that agree in
all key columns are counted first and numbered one after another, so a key
repeated in any share of the rows costs one row of the window; an empty table
gives an empty result; a long text is only measured and summed up; ties between equal
keys are broken by number, which makes no difference; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
ROUNDS = 6
#: Rows of one key that are numbered from one array.
RUN = 1 << 16
#: The domain is less than twice n, so a step leaves 0..n-1 with probability under 1/2.
WALK = 64


def _bits(n: int) -> int:
    return max(2, (max(n, 2) - 1).bit_length())


def _round_keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + 7919 * (r + 1)) & 0x7FFFFFFF for r in range(ROUNDS)]


def _mixed(x: int, key: int, mask: int) -> int:
    """The round function, in plain arithmetic that Spark and Python share: no overflow of 63 bits."""
    y = ((x ^ key) & 0x7FFFFFFF) * 1_103_515_245 & 0x7FFFFFFFFFFF
    y ^= y >> 19
    y = (y & 0x7FFFFFFF) * 747_796_405 & 0x7FFFFFFFFFFF
    return (y ^ (y >> 17)) & mask


def _mixed_column(x: Column, key: int, mask: int) -> Column:
    y = x.bitwiseXOR(F.lit(key).cast("long")).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) * F.lit(1_103_515_245).cast("long")
    y = y.bitwiseAND(F.lit(0x7FFFFFFFFFFF).cast("long"))
    y = y.bitwiseXOR(F.shiftright(y, 19))
    y = y.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) * F.lit(747_796_405).cast("long")
    y = y.bitwiseAND(F.lit(0x7FFFFFFFFFFF).cast("long"))
    return y.bitwiseXOR(F.shiftright(y, 17)).bitwiseAND(F.lit(mask).cast("long"))


def _halves(bits: int) -> tuple[int, int]:
    return bits // 2, bits - bits // 2


def permute(i: int, n: int, seed: int) -> int:
    """Where row number ``i`` of ``n`` goes (plain Python twin of the column expression)."""
    low, high = _halves(_bits(n))
    x = i
    for _ in range(WALK):
        a, b, wa, wb = x >> low, x & ((1 << low) - 1), high, low
        for key in _round_keys(seed):
            a, b, wa, wb = b, (a ^ _mixed(b, key, (1 << wa) - 1)), wb, wa
        x = (a << wb) | b
        if x < n:
            return x
    raise ValueError("no end of the walk")


def place_of(i: int, n: int, shards: int, seed: int = 17) -> tuple[int, int]:
    """(shard, slot) of row number ``i``."""
    p = permute(i, n, seed)
    return p % shards, p // shards


def _round(key: int, mask: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["b"].alias("a"), s["a"].bitwiseXOR(_mixed_column(s["b"], key, mask)).alias("b"))


def _feistel(x: Column, n: int, seed: int) -> Column:
    """One pass over the domain. Each round is a struct field of the one before it, so nothing is expanded twice."""
    low, high = _halves(_bits(n))
    state = F.struct(F.shiftright(x, low).alias("a"), x.bitwiseAND(F.lit((1 << low) - 1).cast("long")).alias("b"))
    steps, wa, wb = [], high, low
    for key in _round_keys(seed):
        steps.append((key, (1 << wa) - 1))
        wa, wb = wb, wa
    for key, mask in steps:
        state = F.transform(F.array(state), _round(key, mask))[0]
    return F.transform(F.array(state), lambda s: F.shiftleft(s["a"], wb).bitwiseOR(s["b"]))[0]


def permuted(number: Column, n: int, seed: int = 17) -> Column:
    """Column of :func:`permute`. The walk is unrolled over a constant array and stops calculating at the first number below ``n``."""
    end = F.lit(n).cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALK)),
        _feistel(number, n, seed),
        lambda x, _: F.when(x < end, x).otherwise(_feistel(x, n, seed)),
    )
    return F.when(walked < end, walked).otherwise(F.raise_error(F.lit("no end of the walk")).cast("long"))


def row_numbers(df: DataFrame, keys: list[str], number: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of ``df[keys]`` with its global number from 0.

    Rows are ordered by hash bucket, then by ``keys``; equal rows are exchangeable. The
    window of a bucket sees each distinct key once, whatever its count.
    """
    counted = df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = counted.groupBy("__bucket").agg(F.sum("__n").alias("__size"))
    everything = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__size").over(everything), F.lit(0)).alias("__start"))  # at most `buckets` rows
    inside = Window.partitionBy("__bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__n").over(inside), F.lit(0)) + F.col("__start")
    placed = counted.join(F.broadcast(starts), "__bucket").withColumn("__first", first)
    # a key's copies are numbered in runs, so that no array grows with their count
    end = F.col("__first") + F.col("__n") - 1
    runs = placed.select(*keys, end.alias("__end"), F.explode(F.sequence(F.col("__first"), end, F.lit(RUN).cast("long"))).alias("__from"))
    return runs.select(*keys, F.explode(F.sequence(F.col("__from"), F.least("__end", F.col("__from") + RUN - 1))).alias(number))


def shard_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 17) -> DataFrame:
    """``df[keys]`` with ``shard`` and ``slot``; law ``rows``: shard sizes differ by one at most, slots are gapless from 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    n = df.select(F.count(F.lit(1))).first()[0]
    p = permuted(F.col("row_number"), n, seed)
    numbered = row_numbers(df, keys).withColumn("__place", p)
    return numbered.select(
        *keys, "row_number", F.pmod(F.col("__place"), F.lit(shards)).cast("int").alias("shard"), F.expr(f"__place div {shards}").alias("slot")
    )


def document_shards(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """Shards of documents: doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
