"""Line dedup against brute force on edit similarity alone: the truth here knows nothing of SimHashes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import line_dedup

WORDS = [f"{a}{b}{c}" for a in ("ba", "kor", "li", "men", "st", "ü") for b in ("a", "en", "or", "i") for c in ("x", "nd", "tion", "r", "sh")]


def _line(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(n))


def _changed(rng, line, rate):
    """Words replaced, left out or added at a rate."""
    out = []
    for word in line.split():
        out += rng.choice([[rng.choice(WORDS)], [], [word, rng.choice(WORDS)]]) if rng.random() < rate else [word]
    return " ".join(out) or "x"


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(9)
    base = [_line(rng, rng.choice([6, 9, 14, 20, 25, 30, 49, 100])) for _ in range(150)]
    return [x for line in base for x in (line, _changed(rng, line, 0.03), _changed(rng, line, 0.08))]


def _groups(forms):
    """Brute force: connected groups of edit similarity of at least 0.8, and the number of links."""
    up, links = list(range(len(forms))), []

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, a in enumerate(forms):
        for j in range(i):
            if 0.8 * max(len(a), len(forms[j])) <= min(len(a), len(forms[j])) and line_dedup.edits(a, forms[j]) <= 0.2 * max(len(a), len(forms[j])) + 1e-9:
                links.append((i, j))
                up[find(i)] = find(j)
    return [find(i) for i in range(len(forms))], links


@pytest.mark.parametrize("block", [line_dedup.BLOCK, 4])
def test_recall_and_precision_by_edits_alone(spark, lines, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "COUNTED", 1)
    forms = sorted({line_dedup.normal_form(x) for x in lines})
    groups, links = _groups(forms)
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(forms)], "doc_id long, text string").repartition(3)
    gone = {r.doc_id for r in line_dedup.repeated_lines(docs, block=block).collect()}
    first = {}
    for k, g in enumerate(groups):
        first.setdefault(g, k)
    must = {k for k, g in enumerate(groups) if first[g] != k}
    assert len(links) > 200 and gone <= must  # no line goes without a like one
    assert len(gone) >= 0.95 * len(must)


def test_blocks_of_crowded_buckets_give_the_same_lines(spark, monkeypatch):
    rng = random.Random(2)
    base = _line(rng, 40)
    docs = spark.createDataFrame([(k, _changed(rng, base, 0.04) + "\n" + _line(rng, 30)) for k in range(200)], "doc_id long, text string").repartition(4)

    def lost(block):
        return {(r.doc_id, tuple(sorted(r.lines))) for r in line_dedup.repeated_lines(docs, block=block).collect()}

    whole = lost(10**6)
    monkeypatch.setattr(line_dedup, "COUNTED", 1)
    assert lost(16) == whole and len(whole) == 199


def test_defined_cases(spark):
    rng = random.Random(3)
    base = _line(rng, 30)
    rows = [
        (1, base + "\n\n" + base.upper(), "a", 7.5),  # repeated inside a document
        (1, base + "\n\n" + base.upper(), "a", 7.5),  # a repeated row loses the same lines
        (1, "alone here\n" + base, "b", 1.0),  # the same doc_id with another text
        (2, base, "c", None),
        (3, None, "d", 0.0),
        (4, "", None, 0.0),
        (5, " \n !", "e", 0.0),
        (None, base.replace("the", "teh"), "f", 0.0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, score double")
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.schema == docs.schema
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert [r for r in got if r[0] == 2] == [] and (3, None, "d", 0.0) in got and (4, "", None, 0.0) in got and (5, " \n !", "e", 0.0) in got
    assert [r for r in got if r[0] == 1] == [(1, "alone here", "b", 1.0)]  # the null doc_id comes first and keeps the group's line
    assert sum(r[0] is None for r in got) == 1
    counted = line_dedup.dedup_lines(docs)
    assert dict(counted.dtypes)["n_lines"] == "bigint" and sorted(r.n_dropped for r in counted.filter("doc_id < 3").collect()) == [1, 1, 2, 2]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_long_text_is_read_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    text = "\n".join(_line(rng, 12) for _ in range(400)) + "\n\n" + _line(rng, 4000)
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").select("doc_id", line_dedup.copy_of("text").alias("copy"), "text")
    whole = line_dedup.line_table(docs).select("doc_id", "line", "line_hash", F.array_sort("keys").alias("keys")).collect()
    monkeypatch.setattr(line_dedup, "LIMIT", 1000)
    cut = line_dedup.line_table(docs).select("doc_id", "line", "line_hash", F.array_sort("keys").alias("keys")).collect()
    assert sorted(map(tuple, cut), key=repr) == sorted(map(tuple, whole), key=repr) and len(cut) == 2 * 401
    assert line_dedup.dedup_lines(docs.select("doc_id", "text")).agg(F.sum("n_dropped")).first()[0] == 401


@pytest.mark.parametrize("distance", [0, 16, 24])
def test_close_pairs_of_large_and_small_buckets(distance):
    """Every close pair of a bucket once, by brute force, and none of one part: parts have been compared already."""
    rng = np.random.default_rng(4)
    cell = np.repeat(np.arange(6), [1, 3, 700, 64, 10, 63])
    sim = rng.integers(0, 2**63, len(cell))
    sim[1::3] = sim[0:-1:3][: len(sim[1::3])] ^ (1 << 7)
    part = rng.integers(0, 3, len(cell))
    for parts in (None, part):
        found = [(int(i), int(j)) for a, b in line_dedup._near_pairs(cell, sim, distance, np.arange(len(cell)), parts) for i, j in zip(a, b, strict=True)]
        want = {(i, j) for j in range(len(cell)) for i in range(j) if cell[i] == cell[j] and (int(sim[i]) ^ int(sim[j])).bit_count() <= distance and (parts is None or part[i] != part[j])}
        assert len(found) == len(set(found)) and set(found) == want


def test_hashes_of_a_large_bucket_are_read_in_order(monkeypatch):
    """A bucket of n lines takes no n steps: its pairs are compared as tiles."""
    calls = []
    count = np.bitwise_count
    monkeypatch.setattr(line_dedup.np, "bitwise_count", lambda x: calls.append(x.size) or count(x))
    n = 4000
    assert not list(line_dedup._near_pairs(np.zeros(n, np.int64), np.random.default_rng(1).integers(0, 2**63, n), 0, np.arange(n)))
    assert sum(calls) >= n * (n - 1) // 2 and len(calls) < 200


def test_an_alignment_of_words_never_promises_too_much():
    rng = random.Random(11)
    said = 0
    for _ in range(1500):
        a = _line(rng, rng.choice([1, 3, 8, 20, 40]))
        b = _changed(rng, a, rng.choice([0.05, 0.2, 0.5]))
        b = "".join(rng.choice([c, c, c, c + "q", ""]) if rng.random() < 0.05 and c != " " else c for c in b)
        a, b = line_dedup.normal_form(a), line_dedup.normal_form(b)
        k, longer = line_dedup.edits(a, b), max(len(a), len(b))
        assert line_dedup.alike(a, b) == (min(len(a), len(b)) >= 0.8 * longer and k <= int(0.2 * longer + 1e-9))
        most = rng.randrange(longer + 1)
        if line_dedup._aligned(a.split(" "), b.split(" "), most):
            said += 1
            assert k <= most
    assert said > 300


def test_distances_of_pairs_side_by_side():
    rng = random.Random(11)
    texts = lambda most: "".join(rng.choice("abcé中 ") for _ in range(rng.randint(1, most)))
    for most in (3, 63, 64, 65, 130, 400):
        pairs = [(texts(most), texts(most)) for _ in range(40)]
        pairs += [(a, a[3:] + "b") for a, _ in pairs if len(a) > 3]
        assert line_dedup.edits_of_pairs(pairs) == [line_dedup.edits(a, b) for a, b in pairs]
        assert line_dedup._side_by_side(pairs[:1]) == [line_dedup.edits(*sorted(pairs[0], key=len))]


def test_distances_are_measured_last(monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    line, forms = [word() for _ in range(60)], []
    for _ in range(150):  # two of them are up to 22 words apart, each is 11 from the last
        changed = set(rng.sample(range(60), 11))
        forms.append(" ".join(word() if k in changed else w for k, w in enumerate(line)))
    forms.append(" ".join(line))
    n, measured = len(forms), []
    whole, pairs_of = line_dedup.edits, getattr(line_dedup, "edits_of_pairs", None)
    monkeypatch.setattr(line_dedup, "edits", lambda a, b, most=None: measured.append(1) or whole(a, b, most))
    if pairs_of:
        monkeypatch.setattr(line_dedup, "edits_of_pairs", lambda pairs: measured.extend(pairs) or pairs_of(pairs))
    same, ids = pa.array([7] * n), pa.array(range(n))
    rows = {"cell": same, "key": same, "sim": pa.array([0] * n), "sim2": pa.array([0] * n), "line_hash": ids, "keys": pa.array([[7]] * n), "size": pa.array([len(f) for f in forms]), "form": pa.array(forms), "comp": ids, "part": pa.nulls(n, pa.int32())}
    (links,) = line_dedup._verified(iter([pa.RecordBatch.from_pydict(rows)]), line_dedup.DISTANCE, line_dedup.SIMILARITY)
    assert links.num_rows == n - 1 and len(measured) < n
    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
        assert whole(forms[a], forms[b]) <= 0.2 * max(len(forms[a]), len(forms[b]))


def test_pairs_of_an_earlier_bucket_are_left_out_by_rank():
    rng = np.random.default_rng(13)
    keys = np.where(rng.random((60, 8)) < 0.2, 0, rng.integers(1, 30, (60, 8)))
    key = np.full(60, 15)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    earlier = line_dedup._earlier(keys[a], keys[b], key[a])
    found = np.zeros(len(a), bool)
    for least in line_dedup._ranks(keys, key):
        found |= (least[a] == least[b]) & (a != b)
    assert found.any() and (earlier | ~found).all()


def test_a_long_word_that_moved_counts_whole():
    words = [w * 5 for w in "abcdefghij"]
    a, b = " ".join(["k" * 30, *words]), " ".join([*words, "q", "k" * 30])
    assert line_dedup.edits(a, b) > 0.2 * max(len(a), len(b))
    assert not line_dedup.alike(a, b)
