"""Each operator against brute force on small tables with nulls, empty, repeated and odd texts."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import bpe, components, decontaminate, digest, langid, line_dedup, minhash, ordinal, queries, sharding, token_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
VOCABULARY = ["the", "of", "and", "lamp", "river", "stone", "Über", "cloud", "paper", "x1", "green", "tree", "ñandú", "walk", "salt"]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "a", "en", "or"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = sentence(rng, 60)
    words = base.split()
    near = " ".join([*words[:50], "swapped", *words[51:]])
    out = [base, base, near, near.upper(), None, "", " \n ", "one", "!!!", "a b", sentence(rng, 3000), "z" * 5000, "line one is here\n" + sentence(rng, 20) + "\nline one is here", "LINE one, is here\nother words stand", "日本語 текст é"]
    return out + [sentence(rng, rng.randrange(1, 80)) + "\n" + sentence(rng, 12) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k % 2 else "es", "s", 0) for k, t in enumerate(texts)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ranks():
    return queries.public_ranks()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_equals_library(docs, empty, texts, ranks):
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    got = by_id(bpe.encode_and_check(docs, ranks))
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = by_id(bpe.decode_documents(bpe.encode_documents(docs, ranks), ranks))
    assert all(bytes(back[k].decoded) == (t or "").encode() for k, t in enumerate(texts))
    assert bpe.encode_and_check(empty, ranks).count() == 0


def test_segment_trees_agree(ranks):
    encoder, rng = bpe.Encoder(ranks), random.Random(1)
    some = [bytes(rng.choice(b"theandion rs") for _ in range(rng.randrange(2, 33))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder._short(some)] == [encoder._long(x) for x in some]


def test_token_scan_stitches_blocks(spark):
    rng = random.Random(2)
    tokens = [rng.choice([1, 2, 3, 9]) for _ in range(997)]
    data = np.array(tokens, "<u2").tobytes()
    want, start = [], 0
    for k, t in enumerate(tokens):
        if t == 9:
            want.append((start, k - start, True))
            start = k + 1
    if start < len(tokens):
        want.append((start, len(tokens) - start, False))
    for size in (2, 64, 4096):
        blocks = spark.createDataFrame([("f", k, bytearray(data[lo : lo + size])) for k, lo in enumerate(range(0, len(data), size))], "file string, block long, data binary")
        got = [(r.start_token, r.n_tokens, r.closed) for r in token_scan.count_tokens(blocks, 9).orderBy("ordinal").collect()]
        assert got == want
    assert token_scan.count_tokens(blocks.limit(0), 9).count() == 0


def test_token_counts(docs, empty, ranks, tmp_path, spark):
    counts = by_id(bpe.encode_and_check(docs, ranks))
    assert {k: r.n_tokens for k, r in by_id(token_scan.document_token_counts(docs, ranks, queries.SEPARATOR)).items()} == {k: r.n_tokens for k, r in counts.items()}
    assert token_scan.document_token_counts(empty, ranks, queries.SEPARATOR).count() == 0
    (tmp_path / "a.bin").write_bytes(np.array([5, 9, 6, 6, 9], "<u2").tobytes())
    assert [r.n_tokens for r in token_scan.count_tokens(token_scan.flat_files(spark, str(tmp_path), 4), 9).orderBy("ordinal").collect()] == [1, 2]


def test_sharding(docs, empty, texts):
    rows = sharding.document_shards(docs.union(docs.limit(5)), 7).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 16, zlib.crc32(t))
    assert len(rows) == len(texts) + 5 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    placed = sharding.shard_rows(docs.select("doc_id"), ["doc_id"], 4).collect()
    assert all(sharding.place_of(r.row_number, len(texts), 4) == (r.shard, r.slot) for r in placed)
    assert sorted(sharding.permute(i, 100, 5) for i in range(100)) == list(range(100))
    assert sharding.document_shards(empty).count() == 0


@pytest.mark.parametrize(("size", "repeat"), [(2, 1), (5, 2)])
def test_near_duplicates(docs, empty, texts, size, repeat):
    sets = [minhash.shingle_set(t, size) for t in texts]
    up = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if minhash.similar(a, b, 80):
                    up[i] = up[j] = min(up[i], up[j])
    rows = docs
    for _ in range(repeat - 1):
        rows = rows.union(docs)
    got = minhash.near_duplicates(rows, size, 80).collect()
    assert len(got) == repeat * len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), up[r.doc_id], up[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(empty).count() == 0
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs, size).collect()}
    assert kept == {k for k, v in enumerate(up) if k == v}


def test_large_near_copy_group(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 10)):
            w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = [minhash.shingle_set(t, 2) for _, t in rows]
    up = list(range(len(sets)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i in range(len(sets)):
        for j in range(i):
            if minhash.similar(sets[i], sets[j], 80):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in range(len(sets))}


def test_components_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 8)
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (100, 101)], "a long, b long").repartition(6)
    assert sorted(map(tuple, components.components(links).collect())) == [(k, 0) for k in range(1, 41)] + [(101, 100)]


def test_lines_of_other_word_order(spark):
    """Equal words in another order: SimHash over words sees no difference, edit similarity alone decides."""
    lines = ["the an library association bulletin", "the library an association bulletin", "alpha beta gamma delta", "delta gamma beta alpha"]
    assert line_dedup.alike(*lines[:2]) and not line_dedup.alike(*lines[2:])
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    assert [got[k].n_dropped for k in range(4)] == [0, 1, 0, 0]


def test_gram_counts_end_only_unlike_pairs():
    rng = random.Random(6)
    texts = []
    for n in [1, 2, 5, 9, 64, 130, 400]:
        base = [rng.choice("abcdé 語") for _ in range(n)]
        for rate in (0.0, 0.1, 0.2, 0.25, 0.4, 1.0):
            more = (x for c in base for x in (rng.choice([[], [c, "x"], ["y"]]) if rng.random() < rate else [c]))
            texts.append("".join(more) or "z")
    a, b = np.array([(i, j) for i in range(len(texts)) for j in range(i)]).T
    may = line_dedup.Grams(pa.array(texts)).may_be_alike(a, b, 0.8)
    whole = [line_dedup.edits(texts[i], texts[j]) <= (0.2 + 1e-12) * max(len(texts[i]), len(texts[j])) for i, j in zip(a, b, strict=True)]
    assert whole == [line_dedup.alike(texts[i], texts[j]) for i, j in zip(a, b, strict=True)]
    assert all(may[k] for k, same in enumerate(whole) if same) and 10 < sum(whole) < may.sum() < len(may)


def test_edits():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert line_dedup.edits(a, b) == row[-1]
        assert not a or not b or line_dedup.alike(a, b) == (1 - row[-1] / max(len(a), len(b)) >= 0.8)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination(spark, docs, empty, texts, bound):
    import re

    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(FOLD))
    items = {"7": " ".join(texts[0].split()[5:30]), "8": "other, WORDS", "9": None, "10": " ".join(texts[10].split()[100:120])}
    benchmark = spark.createDataFrame([(int(k), t) for k, t in items.items()], "item_id long, text string")
    windows = [(k, tuple(w[i : i + min(13, len(w))])) for k, t in items.items() if (w := words(t)) for i in range(len(w) - min(13, len(w)) + 1)]
    got = by_id(decontaminate.mark(docs, benchmark, max_windows=bound))
    for k, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert got[0].n_hit == 25 and decontaminate.mark(empty, benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts)


def test_language_id(spark, empty):
    rng = random.Random(6)
    pools = {"aa": ["kato", "mira", "sul", "kira", "tomi"], "bb": ["wexel", "druz", "schaff", "wonk", "zept"]}
    rows = [(k, " ".join(rng.choice(pools[lang]) for _ in range(25)), lang, "s", 0) for k, lang in ((k, ("aa", "bb")[k % 2]) for k in range(200))]
    rows += [(900, None, "aa", "s", 0), (901, "123 !!", "bb", "s", 0), (902, "", None, "s", 0), (903, "KATO Mira", None, "s", 0)]
    got = by_id(langid.identify_documents(spark.createDataFrame(rows, SCHEMA)))
    held = [r for r in rows[:200] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and all(got[r[0]].held_out and got[r[0]].lang_pred == r[2] for r in held)
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify_documents(empty).count() == 0


def test_fingerprints(docs, empty, texts):
    got = by_id(digest.compare_neighbours(docs))
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, following = t or "", texts[(k + 1) % len(texts)] or ""
        m = len(t) // 4
        new = t[: len(t) - m] + following[:m]
        r = got[k]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), digest.digest(t.encode()))
        assert math.isclose(r.near_edited, digest.likeness(digest.digest(t.encode()), digest.digest(new.encode())))
        assert math.isclose(r.near_next, digest.likeness(digest.digest(t.encode()), digest.digest(following.encode())))
    assert got[0].fingerprint == got[1].fingerprint and digest.difference(got[0].fingerprint, got[0].fingerprint) == 0
    assert digest.compare_neighbours(empty).count() == 0
    assert digest.fingerprints(docs).count() == len(texts)


def test_quality(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        toxic, good = k % 10 == 0, k % 3 > 0
        t = sentence(rng, 40) if good else " ".join(w.upper() + "!!" for w in sentence(rng, 40).split())
        rows.append((k, t + (" vile" + rng.choice("abcdefgh") if toxic else ""), "en", "s", 0))
        labels.append((k, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (9000, None, "en", "s", 0), (9001, "", "en", "s", 0)], SCHEMA)
    rated = spark.createDataFrame([*labels, (1, None, 0), (123456, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(ordinal.grade_documents(docs, rated))
    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[k].kept == (not toxic) for k, _, toxic in held]) > 0.95
    assert got[9000].expected_grade == got[9001].expected_grade and 0 <= got[9000].p_good <= got[9000].p_not_toxic <= 1
    assert ordinal.grade_documents(empty, rated).count() == 0
    assert ordinal.grade_documents(docs, rated.limit(0)).count() == 602


def test_extra_columns_survive(spark, docs):
    from pyspark.sql import functions as F

    odd = docs.withColumn("n_words", F.lit("x")).withColumn("score", F.lit("y")).withColumn("kept", F.lit("z"))
    bench = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert decontaminate.mark(odd, bench).select("n_words").dtypes == [("n_words", "bigint")]
    assert set(docs.columns) <= set(langid.identify(odd, langid.Filters([], [])).columns)


def test_pipeline_stages(spark, docs, texts, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(texts[20].split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == docs.columns, name
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in got.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    assert 20 not in want and 0 in want and not {1, 2, 3, 4, 5, 8} & set(want)


@pytest.mark.parametrize("most", [30, 400])
def test_least_hashes_end_only_unlike_pairs(most):
    draw = random.Random(5)
    base = [f"w{k}" for k in range(most)]
    texts = ["", "one", *(" ".join(w if draw.random() > cut else f"x{draw.random()}" for w in base[: draw.randint(most // 2, most)]) for cut in (0, 0.02, 0.05, 0.1, 0.3) for _ in range(12))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    sets = [minhash.shingle_set(t, 2) for t in texts]
    try:
        minhash.LOWEST, before = 100, minhash.LOWEST
        rows = pa.Table.from_batches(minhash._lowest(iter([batch]), 2))
        lows = minhash._Lows(rows.column("low"), rows.column("n").to_numpy(), 80)
        others = np.arange(2, len(texts))
        for x in range(2, len(texts)):
            sure, left_open = lows.verdicts(x, others)
            like = np.array([minhash.similar(sets[x], sets[y], 80) for y in others])
            assert not (like & ~sure & ~left_open).any() and not (sure & ~like).any()
            assert most > 100 or (left_open & ~like).sum() == 0
    finally:
        minhash.LOWEST = before
