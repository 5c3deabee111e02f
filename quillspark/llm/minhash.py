"""MinHash near-duplicates by tensored banding, every link confirmed on the full shingle sets.

Each text gets two small collections of keys, U and V, of ``SIDE`` keys each; a
key joins ``ROWS`` minhashes. A table key is the combination of one key of U and
one of V, so that 2 * SIDE * ROWS minhashes (72) stand for SIDE**2 tables (144) of
2 * ROWS minhashes each. At a similarity of 0.8 a pair shares a table with
probability 0.9996, above 0.85 with more than 0.99998.

Texts with equal sets are one node before banding. In each table bucket, members
are first compared along a tree (member i with member i & (i-1)), a number of
pairs that is linear in the bucket. Buckets whose members are then in more than
one component are opened again, three times: first the member nearest to the
bucket's consensus meets all others, then each member outside the largest
component meets the one it agrees with most, and at last all remaining pairs
that cross components become candidates, each in the first table that the pair
shares. A candidate must be able to reach the threshold by size, and agree in
``AGREE`` of the 72 minhashes. In the last round the members of a block also bring
the ``LOWEST`` least hashes of their sets: a pair of sets that fit in is decided in
the block (unlike pairs end there, of like ones only a forest goes on), a pair of
larger sets ends there if its estimate is ``SIGMAS`` deviations below the threshold.
All that goes on is confirmed on the texts. So no candidate is skipped whose link
could matter, and pairs inside a component are never listed. Buckets of any size
are cut into blocks of bounded size.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; a text of
fewer words than a shingle, but not none, is one shingle; null and empty texts
have an empty set and link with nothing; rows with one doc_id are one node, which is
linked if any of their texts is; equal rows are one text; ties go to the least doc_id; a
long text is read as a whole, in memory of about 60 times its bytes; an empty table gives
an empty result; a null doc_id is the least of all, and a component_id is null where it
is in the group; :func:`drop_near_duplicates` leaves all other columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.durable import durable, light
from quillspark.llm.textnum import LOWER, Words, joined, mix, pieces, raw, signed

SIDE, ROWS = 12, 3
BLOCK = 4096
#: Of its 72 minhashes, a pair must agree in so many before its texts are fetched (at a similarity of 0.8, all but 0.0001 do).
AGREE = 44
#: Least 32-bit hashes that stand for a set in the last round, and deviations of an estimate from them that end a pair.
LOWEST, SIGMAS = 512, 5
#: Stands for a null doc_id inside: the least of all.
NO_ID = -(1 << 63)
_U = np.uint64
_FACTORS = mix(np.arange(1, 2 * SIDE * ROWS + 1, dtype=_U)) | _U(1)
_LOWER = LOWER.tobytes()


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else set(zip(*[words[k:] for k in range(size)], strict=False))


def similar(a: set, b: set, percent: int) -> bool:
    """Whether the sets share ``percent`` per cent of their union; an empty set is like nothing."""
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, and their ranges."""
    hashes = words.hashes()
    grams = joined(hashes, size)
    out, counts = [], []
    for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if last - first >= size:
            own = np.unique(grams[first : last - size + 1])
        else:
            own = joined(hashes[first:last], last - first) if last > first else grams[:0]
        out.append(own)
        counts.append(len(own))
    return (np.concatenate(out) if out else grams[:0]), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def _keys(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U and V keys (2 * SIDE) and a byte of each minhash, one row for each non-empty text."""
    some = np.flatnonzero(np.diff(bounds))
    least = np.empty((2 * SIDE * ROWS, len(some)), _U)
    if len(some):
        starts, work = bounds[:-1][some], np.empty_like(shingles)
        for k, factor in enumerate(_FACTORS):
            np.multiply(shingles, factor, out=work)
            np.minimum.reduceat(work, starts, out=least[k])
    sketch = (mix(least) & _U(255)).astype(np.uint8).view(np.int8)
    least = least.reshape(2 * SIDE, ROWS, -1)
    keys = np.zeros((2 * SIDE, len(some)), _U)
    for r in range(ROWS):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + least[:, r] + _U(r))
    return keys.T, sketch.T


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole):
            shingles, bounds = _sets(Words(*raw(batch.column("text"))), size)
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            keys, sketch = _keys(shingles, bounds)
            h = np.zeros((2, batch.num_rows), _U)
            if len(some):
                h[0, some] = np.add.reduceat(mix(shingles), bounds[:-1][some])
                h[1, some] = np.add.reduceat(mix(shingles ^ _U(0xA5A5A5A55A5A5A5A)), bounds[:-1][some])
            ends = np.zeros(batch.num_rows + 1, np.int32)
            ends[1:] = np.cumsum(np.where(n > 0, SIDE, 0))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.ascontiguousarray(keys[:, k : k + SIDE]).reshape(-1)))) for k in (0, SIDE)]
            lists.append(pa.ListArray.from_arrays(pa.array(ends * (2 * ROWS)), pa.array(np.ascontiguousarray(sketch).reshape(-1))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(signed(h[0])), pa.array(signed(h[1])), *lists], ["doc_id", "n", "h1", "h2", "u", "v", "sketch"])


_MEMBERS = ["key", "t", "id", "n", "parent"]


def _trees(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and id, of buckets with several members; parent: the member to compare with, if sizes allow."""
    last_key, seen, kept = None, 0, {}  # kept: place in the open bucket -> (id, n), of the last member and those above it in the tree
    for batch in batches:
        key, t, ids, n = (batch.column(k).to_numpy() for k in range(4))
        m = len(key)
        if not m:
            continue
        new = np.ones(m, bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = key[0] != last_key
        first = np.maximum.accumulate(np.where(new, np.arange(m), -1))
        place = np.arange(m) - np.maximum(first, 0)
        open_rows = first < 0  # they continue the bucket of the batch before
        if not open_rows.any():
            kept, seen = {}, 0
        place[open_rows] += seen
        at = np.flatnonzero(place > 0)
        above = place[at] & (place[at] - 1)
        inside = np.where(open_rows[at], above - seen, first[at] + above)
        here = inside >= 0
        far = {p: kept[p] for p in set(above[~here].tolist())}
        parent = np.where(here, ids[np.maximum(inside, 0)], 0)
        parent_n = np.where(here, n[np.maximum(inside, 0)], 0)
        for i in np.flatnonzero(~here).tolist():
            parent[i], parent_n[i] = far[int(above[i])]
        fits = 100 * np.minimum(n[at], parent_n) >= percent * np.maximum(n[at], parent_n)
        second = np.flatnonzero(place[at] == 1)  # with them, the bucket's first member is told too
        columns = [np.concatenate((c[at], extra)) for c, extra in ((key, key[at][second]), (t, t[at][second]), (ids, parent[second]), (n, parent_n[second]))]
        parents = pa.concat_arrays([pa.array(parent, pa.int64(), mask=~fits), pa.nulls(len(second), pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3]), parents], _MEMBERS)
        end = int(place[-1])
        begin = m - 1 - end if not open_rows[-1] else None
        chain, p = {}, end
        while True:
            index = p - seen if begin is None else begin + p
            chain[p] = (int(ids[index]), int(n[index])) if index >= 0 and (begin is not None or p >= seen) else kept[p]
            if not p:
                break
            p &= p - 1
        last_key, kept, seen = key[-1], chain, end + 1


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    plain = [rows.column(c).to_numpy() for c in ("side", "id", "n", "comp", "in_big")]
    flat = [np.concatenate([np.asarray(c.flatten()) for c in rows.column(x).chunks]).reshape(rows.num_rows, -1) for x in ("u", "v", "sketch")]
    return *plain, np.hstack(flat[:2]), flat[2]


def _hub_pairs(rows: pa.Table, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The member nearest to the bucket's consensus (each key's commonest value) with all members of other components."""
    _, ids, n, comp, _, _, keys = _columns(rows)
    score = np.zeros(len(ids), np.int32)
    for column in keys.T:
        values, place, counts = np.unique(column, return_inverse=True, return_counts=True)
        score += place == np.argmax(counts)
    x = int(np.argmax(score))
    ok = np.flatnonzero((comp != comp[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
    ok = ok[(keys[ok] == keys[x]).sum(1) >= AGREE]
    return [(np.full(len(ok), ids[x]), ids[ok])] if len(ok) else []


def _best_pairs(rows: pa.Table, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each left row with the right row of another component that agrees most."""
    side, ids, n, comp, _, _, sketch = _columns(rows)
    right, found = np.flatnonzero(side == 1), []
    rs, rn, rc, rid = sketch[right], n[right], comp[right], ids[right]
    for x in np.flatnonzero(side == 0).tolist():
        ok = np.flatnonzero((rc != comp[x]) & (100 * np.minimum(rn, n[x]) >= percent * np.maximum(rn, n[x])))
        if len(ok):
            agree = (rs[ok] == sketch[x]).sum(1)
            if agree.max() >= AGREE:
                found.append((ids[[x]], rid[ok[[np.argmax(agree)]]]))
    return found


def _lowest(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The least ``LOWEST`` hashes of each text's set, as numbers of 32 bits."""
    for whole in batches:
        for batch in pieces(whole):
            shingles, bounds = _sets(Words(*raw(batch.column("text"))), size)
            n = np.diff(bounds)
            taken = np.minimum(n, LOWEST)
            ends = np.concatenate(([0], np.cumsum(taken)))
            at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], taken)
            low = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((shingles[at] >> _U(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), low], ["id", "n", "low"])


class _Lows:
    """Compares a row's least hashes with those of many others."""

    def __init__(self, lists: pa.ChunkedArray, n: np.ndarray, percent: int):
        flat = lists.combine_chunks()
        values, self.sizes = flat.flatten().to_numpy(), flat.value_lengths().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.known, self.n, self.percent = self.sizes > 0, n, percent
        names, codes = np.unique(values, return_inverse=True)
        self.codes = codes.reshape(-1).astype(np.int32)  # in the order of the hashes
        self.mark = np.zeros(len(names), bool)
        self.whole = n <= LOWEST
        self.most = np.where(self.whole, len(names), -1)  # the greatest code that a row would list
        cut = np.flatnonzero(~self.whole & self.known)
        self.most[cut] = self.codes[self.first[cut] + self.sizes[cut] - 1]

    def verdicts(self, x: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(similar for sure, open) of x with each of ``others``."""
        unknown = ~(self.known[others] & self.known[x])
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        theirs = self.codes[np.arange(ends[-1]) + np.repeat(self.first[others] - (ends - sizes), sizes)]
        own = self.codes[self.first[x] : self.first[x] + self.sizes[x]]
        most = np.minimum(self.most[others], self.most[x])
        inside = theirs <= np.repeat(most, sizes)
        self.mark[own] = True
        hits = self.mark[theirs] & inside
        self.mark[own] = False
        sums = [np.diff(np.concatenate(([0], np.cumsum(c)))[np.concatenate(([0], ends))]) for c in (hits, inside)]
        both, union = sums[0], np.searchsorted(own, most, "right") + sums[1] - sums[0]
        exact = self.whole[others] & self.whole[x]
        limit = self.percent / 100
        far = limit - np.where(exact, 0, SIGMAS * np.sqrt(limit * (1 - limit) / np.maximum(union, 1)))
        # equal 32-bit numbers of unequal shingles can only raise ``both``: one less must do for a sure link
        sure = exact & ~unknown & (100 * (both - 1) >= self.percent * (union + 1))
        return sure, unknown | (~sure & (both + 1e-9 >= far * union))


def _all_pairs(rows: pa.Table, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each left row with the right rows of other components, in the first table they share; sure links join components at once."""
    side, ids, n, comp, big, keys, sketch = _columns(rows)
    lows = _Lows(rows.column("low"), n, percent)
    right, found = np.flatnonzero(side == 1), []
    rk, rs, rn, rid, rb = keys[right], sketch[right], n[right], ids[right], big[right]
    kinds, code = np.unique(comp, return_inverse=True)
    label = np.arange(len(kinds))
    i, j = divmod(int(rows.column("t")[0].as_py()), SIDE)
    for x in np.flatnonzero(side == 0).tolist():
        ok = np.flatnonzero((label[code[right]] != label[code[x]]) & (rb | (rid > ids[x])) & (100 * np.minimum(rn, n[x]) >= percent * np.maximum(rn, n[x])))
        ok = ok[(rs[ok] == sketch[x]).sum(1) >= AGREE]
        same = rk[ok] == keys[x]
        ok = ok[~same[:, :i].any(1) & ~same[:, SIDE : SIDE + j].any(1)]
        if not len(ok):
            continue
        sure, left_open = lows.verdicts(x, right[ok])
        other, one_each = np.unique(label[code[right[ok[sure]]]], return_index=True)
        label[np.isin(label, other)] = label[code[x]]
        ok = np.concatenate((ok[sure][one_each], ok[left_open]))
        found.append((np.full(len(ok), ids[x]), rid[ok]))
    return found


def _crossing(batches: Iterator[pa.RecordBatch], percent: int, way: str) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of blocks of rows that are sorted by key, x and y."""

    def pairs(rows: pa.Table) -> pa.RecordBatch | None:
        found = {"hub": _hub_pairs, "best": _best_pairs, "all": _all_pairs}[way](rows, percent)
        if found:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])
        return None

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, x, y = (batch.column(c).to_numpy() for c in ("key", "x", "y"))
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            here = (k[lo], x[lo], y[lo])
            if held and here != last and (out := pairs(pa.Table.from_batches(held))):
                yield out
            held = [*(held if here == last else []), batch.slice(lo, hi - lo)]
            last = here
    if held and (out := pairs(pa.Table.from_batches(held))):
        yield out


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    last, mine = None, set()
    for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
        a, b, good = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for k in range(batch.num_rows):
            text = batch.column("text_a")[k].as_py()
            if (a[k], text) != last:  # an id may have several texts
                last, mine = (a[k], text), shingle_set(text, size)
            good.append(similar(mine, shingle_set(batch.column("text_b")[k].as_py(), size), percent))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar."""
    used = durable(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "used")
    texts = durable(docs.join(light(used, used.count()), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("copy"), "text").dropDuplicates(["doc_id", "copy"]).drop("copy"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return durable(both.mapInArrow(lambda it: _confirm(it, size, percent), "a long, b long").distinct(), "links")


def _open_blocks(members: DataFrame, found: DataFrame, way: str) -> DataFrame:
    """Buckets of more than two members in several components, as blocks (x, y) of at most ``BLOCK`` left and right rows.

    Right are all members, left those outside the bucket's largest component; the way "hub" needs right rows only.
    """
    labels = found.select(F.col("child").alias("id"), F.col("root").alias("comp"))
    placed = members.select("key", "t", "id", "n").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    opened = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("big"), F.sum("m").alias("all"), F.max("m").alias("most"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1 and all > 2")
    blocks = placed.join(opened, "key").withColumn("in_big", F.col("comp") == F.col("big"))
    xs, ys = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    own = F.abs(F.xxhash64("id") % (1 << 30))
    columns = ["key", "t", "id", "n", "comp", "in_big"]
    if way == "hub":
        return blocks.select(*columns, F.lit(1).alias("side"), F.lit(0).alias("x"), (own % ys).cast("int").alias("y"))
    left = blocks.filter(~F.col("in_big")).select(*columns, F.lit(0).alias("side"), (own % xs).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), ys - 1)).alias("y"))
    right = blocks.select(*columns, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), xs - 1)).alias("x"), (own % ys).cast("int").alias("y"))
    return left.unionByName(right)


def _with_lowest(blocks: DataFrame, docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``blocks`` with the least hashes of their members, from the texts of these members only; and their number."""
    held = durable(blocks, "blocks")
    used = durable(held.select(F.col("id").alias("doc_id")).distinct(), "used")
    texts = docs.join(light(used, used.count()), "doc_id", "left_semi").select("doc_id", "text")
    low = durable(texts.mapInArrow(lambda it: _lowest(it, size), "id long, n long, low array<long>").groupBy("id", "n").agg(F.min("low").alias("low"), F.max("low").alias("other")), "lowest")
    low = low.select("id", "n", F.when(F.col("low") == F.col("other"), F.col("low")).alias("low"))  # two sets of one id are not decided here
    return held.join(low, ["id", "n"], "left").withColumn("low", F.coalesce("low", F.array().cast("array<long>"))), held.count()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over confirmed links), kept; one row for each row of ``docs``."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    marked = durable(docs.mapInArrow(lambda it: _signatures(it, shingle), "doc_id long, n long, h1 long, h2 long, u array<long>, v array<long>, sketch array<tinyint>"), "signatures")
    sets = durable(marked.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), F.any_value("u").alias("u"), F.any_value("v").alias("v"), F.any_value("sketch").alias("sketch")), "sets")
    tables = f"flatten(transform(u, (x, i) -> transform(v, (y, j) -> struct(xxhash64(x, y, i, j) as key, i * {SIDE} + j as t))))"
    rows = sets.select("id", "n", F.explode(F.expr(tables)).alias("k")).select("k.key", "k.t", "id", "n")
    dealt = rows.repartition("key").sortWithinPartitions("key", "id")
    members = durable(dealt.mapInArrow(lambda it: _trees(it, percent), "key long, t int, id long, n long, parent long"), "buckets")
    tried = members.filter("parent is not null and parent <> id").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b")).distinct()
    keys = sets.select("id", "sketch")
    tried = tried.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b").filter(f"size(filter(zip_with(ka, kb, (x, y) -> x = y), z -> z)) >= {AGREE}")
    tried = durable(tried.select("a", "b"), "pairs")
    links = _confirmed(tried, docs, shingle, percent)
    found = components(links)
    for way in ("hub", "best", "all"):
        blocks = _open_blocks(members, found, way).join(sets.select("id", "u", "v", "sketch"), "id")
        if way == "all":  # few bytes but much work in a row: partitions by rows
            blocks, n_rows = _with_lowest(blocks, docs, shingle)
            blocks = blocks.repartition(1 + n_rows // BLOCK, "key", "x", "y")
        else:
            blocks = blocks.repartition("key", "x", "y")
        blocks = blocks.sortWithinPartitions("key", "x", "y")
        more = blocks.mapInArrow(partial(_crossing, percent=percent, way=way), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = durable(more.join(tried, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        tried = tried.unionByName(more)
        links = _confirmed(more, docs, shingle, percent)
        if not links.isEmpty():
            found = components(found.select(F.col("child").alias("a"), F.col("root").alias("b")).unionByName(links))
    labels = found.select(F.col("child").alias("id"), F.col("root").alias("component_id"))
    by_set = sets.select("n", "h1", "h2", "id").join(labels, "id", "left").select("n", "h1", "h2", F.coalesce("component_id", "id").alias("component_id"))
    joined_rows = marked.select("doc_id", "n", "h1", "h2").join(by_set, ["n", "h1", "h2"], "left")
    component = F.coalesce("component_id", "doc_id")
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    return joined_rows.select(named(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), named(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of documents that are not the least of their component."""
    dropped = near_duplicates(docs, shingle, percent).filter(~F.col("kept")).select("doc_id").distinct()
    dropped = durable(dropped, "dropped")
    return docs.join(light(dropped, dropped.count()), "doc_id", "left_anti").select(*docs.columns)
