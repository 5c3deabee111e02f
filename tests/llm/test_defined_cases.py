"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and each stage of the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, digest, langid, line_dedup, minhash, ordinal, queries, sharding, token_scan
from quillspark.llm.textnum import mix

#: Columns of the operators' results, and their private names, as a user's own columns.
CLASHES = ["n_words", "n_hit", "n_items", "contaminated", "spans", "lang_pred", "score", "n_lines", "n_dropped", "kept", "component_id", "n_shingles", "line", "lines", "key", "keys", "sim", "wanted", "id", "n", "row", "word", "file", "block", "data", "fingerprint", "slot", "shard", "grade", "slots", "expected_grade"]


def sentence(rng, n):
    return " ".join(rng.choice(["river", "stone", "paper", "cloud", "walk"]) + rng.choice(["", "a", "en", "or", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    long = "\n".join(sentence(rng, 15) for _ in range(4000))  # 400 kB
    base = sentence(rng, 50)
    return [(1, base), (2, base), (2, base), (3, base + " more"), (4, None), (5, ""), (6, " \n\t "), (7, "!!!"), (8, long), (9, sentence(rng, 8)), (9, sentence(rng, 30)), (None, sentence(rng, 20))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    plain = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return plain.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))) for c in CLASHES}).repartition(3).cache()


def counted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filters_leave_all_other_columns_alone(spark, docs):
    bench = spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")
    others = [c for c in docs.columns if c != "text"]
    want = counted(docs.select(*others))
    for stage in (lambda d: decontaminate.clean(d, bench), lambda d: decontaminate.clean(d, bench, max_windows=0)):
        got = stage(docs)
        assert got.schema == docs.schema and counted(got.select(*others)) == want
    lang = langid.of_known_language(docs, langid.train(docs))
    assert lang.schema == docs.schema and set(counted(lang.select(*others))) <= set(want) and lang.count() == 8
    for got in (line_dedup.drop_repeated_lines(docs), minhash.drop_near_duplicates(docs)):
        assert got.schema == docs.schema and set(counted(got.select(*others))) <= set(want)


def test_results_replace_columns_of_their_names(spark, docs):
    bench = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert dict(decontaminate.mark(docs, bench).dtypes)["n_words"] == "bigint"
    assert dict(langid.identify(docs, langid.Filters([], [])).dtypes)["score"] == "double"
    assert dict(line_dedup.dedup_lines(docs).dtypes)["n_lines"] == "bigint"
    graded = ordinal.grade(docs, ordinal.Grader(np.zeros(1 << ordinal.BITS, np.float32), np.zeros(2)))
    assert dict(graded.dtypes)["kept"] == "boolean" and graded.count() == docs.count()
    assert dict(digest.fingerprints(docs).dtypes)["fingerprint"] == "string"
    assert set(docs.columns) <= set(bpe.encode_documents(docs, queries.public_ranks()).columns)


def test_every_row_gets_its_result(spark, docs, rows):
    n, ranks = len(rows), queries.public_ranks()
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 1), (8, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    found = {
        "bpe": bpe.encode_and_check(docs.select("doc_id", "text"), ranks), "tokens": token_scan.document_token_counts(docs, ranks, queries.SEPARATOR), "near": minhash.near_duplicates(docs, 2),
        "grades": ordinal.grade_documents(docs, labels), "shards": sharding.document_shards(docs), "language": langid.identify_documents(docs), "marks": decontaminate.mark(docs, bench), "digests": digest.compare_neighbours(docs),
    }
    for name, df in found.items():
        assert df.count() == n, name
    again = {r.doc_id: r for r in found["near"].collect()}
    assert again[2].component_id == 1 and again[4].n_shingles == again[5].n_shingles == 0 and again[8].kept
    twice = found["bpe"].filter("doc_id = 2").collect()
    assert twice[0] == twice[1] and found["bpe"].filter("doc_id = 4").first().n_tokens == 0
    assert {r.n_tokens for r in found["tokens"].filter("doc_id in (4, 5)").collect()} == {0}
    assert {(r.lang_pred, r.score) for r in found["language"].filter("doc_id in (4, 5, 6, 7)").collect()} == {("und", 0.0)}
    assert [r.contaminated for r in found["marks"].filter("doc_id in (1, 4, 8)").orderBy("doc_id").collect()] == [True, False, False]
    assert {r.grown_shard for r in found["shards"].collect()} == {None}


def test_empty_tables(spark, docs):
    empty, ranks = docs.limit(0), queries.public_ranks()
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (bpe.encode_and_check(empty, ranks), token_scan.document_token_counts(empty, ranks, queries.SEPARATOR), minhash.near_duplicates(empty), minhash.drop_near_duplicates(empty), line_dedup.drop_repeated_lines(empty), sharding.document_shards(empty), langid.identify_documents(empty), decontaminate.clean(empty, bench), digest.compare_neighbours(empty), ordinal.grade_documents(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        assert df.count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count()


def test_pipeline_with_other_columns(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    others = [c for c in docs.columns if c not in ("text",)]
    want = set(counted(docs.select(*others)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and set(counted(now.select(*others))) <= want, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_doc_id_with_two_texts(spark):
    rng = random.Random(4)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_rows_of_one_doc_id_are_marked_each_for_itself(spark):
    """Either way: by a broadcast, and by the shuffled join in which rows have numbers of their own."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta alpha"), (2, "beta")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "beta"), ("j", "omega")], "item_id string, text string")
    plain = counted(decontaminate.mark(docs, bench))
    assert counted(decontaminate.mark(docs, bench, max_windows=0)) == plain
    assert [r[-2] for r in plain] == [True, True, False]


def test_flat_files_of_any_size(spark, tmp_path):
    rng = random.Random(6)
    for kind, top in (("<u2", 60_000), ("<u4", 3_000_000)):
        folder = tmp_path / kind[1:]
        folder.mkdir()
        files = {name: [rng.choice([7, top - 1, 11, 9]) for _ in range(n)] for name, n in (("a.bin", 4001), ("b.bin", 3), ("c.bin", 0))}
        for name, tokens in files.items():
            (folder / name).write_bytes(np.array(tokens, kind).tobytes())
        blocks = token_scan.flat_files(spark, f"file://{folder}", 64)
        assert blocks.count() > 100
        got = {}
        for r in token_scan.count_tokens(blocks, 9, kind).collect():
            got.setdefault(r.file.split("/")[-1], []).append((r.start_token, r.n_tokens, r.closed))
        for name, tokens in files.items():
            want, start = [], 0
            for k, t in enumerate(tokens):
                if t == 9:
                    want.append((start, k - start, True))
                    start = k + 1
            want += [(start, len(tokens) - start, False)] if start < len(tokens) else []
            assert sorted(got.get(name, [])) == want
    with pytest.raises(ValueError):
        token_scan.write_flat(spark.createDataFrame([(1, "a")], "doc_id long, text string"), queries.public_ranks(), 70_000, "<u2")
    assert token_scan.kind_for(queries.public_ranks(), 70_000) == "<u4"


def plain_digest(data: bytes) -> str:
    """The digest by its definition, without vectors."""
    table = mix(np.arange(1, 257, dtype=np.uint64))
    first, second, third = ([int(x) >> 40 for x in mix(table + np.uint64(k))] for k in (1, 2, 3))
    counts, checks = [0] * 256, []
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        h = (first[a] + 5 * second[b] + 17 * third[c]) * 0x9E3779B1 & 0xFFFFFFFF
        counts[h >> 24] += 1
        checks.append(h >> 16 & 255)
    check = (sum(data) * 7 + len(data)) & 255
    if checks:
        check = 0
        for x in checks:
            check ^= x
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    codes = [sum(n > x for x in q) for n in counts]
    body = bytes(codes[k] | codes[k + 1] << 2 | codes[k + 2] << 4 | codes[k + 3] << 6 for k in range(0, 256, 4))
    return body.hex() + f"{min(255, round(np.log(len(data) + 1) * 8)):02x}{check:02x}"


def plain_likeness(a: str, b: str) -> float:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    gap = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs((p >> s & 3) - (q >> s & 3))] for p, q in zip(x[:-2], y[:-2], strict=True) for s in (0, 2, 4, 6))
    return 1 - min(512, gap + 12 * abs(x[-2] - y[-2]) + (x[-1] != y[-1])) / 512


def test_digests_by_definition(spark, rows):
    ids = [(k, t) for k, t in rows if k is not None and k not in (2, 9)]
    got = {r.doc_id: r for r in digest.compare_neighbours(spark.createDataFrame(ids, "doc_id long, text string").repartition(4)).collect()}
    order = sorted(ids)
    for k, (doc, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        new = t[: len(t) - m] + after[:m]
        own, other, following = (plain_digest(x.encode()) for x in (t, new, after))
        r = got[doc]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.edited_sha256) == (len(t), own, other, hashlib.sha256(new.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (plain_likeness(own, other), plain_likeness(own, following))


def test_language_by_exact_sets(spark):
    """The filters' counts are those of exact sets of n-grams but for false positives; a tie goes to the language with more texts."""
    rng = random.Random(5)
    make = {"aa": "abc def", "bb": "xyz uvw", "cc": "abx dey"}
    texts = [(k, " ".join(rng.choice(make[lang].split()) for _ in range(20)), lang) for k, lang in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 10)]
    filters = langid.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert filters.langs == ["aa", "bb", "cc"]
    counts, totals = {}, {}
    for _, t, lang in texts:
        slots, _ = langid._grams([t])
        for s in slots.tolist():
            counts[s, lang] = counts.get((s, lang), 0) + 1
    counts = {k: n for k, n in counts.items() if n >= langid.MIN_COUNT}
    for (_, lang), n in counts.items():
        totals[lang] = totals.get(lang, 0) + n
    top = {}
    for (s, lang), n in counts.items():
        top[s] = max(top.get(s, 0), n / totals[lang])
    typical = {lang: {s for (s, x), n in counts.items() if x == lang and n / totals[lang] >= langid.SHARE * top[s]} for lang in make}
    for t in ("abc def abc", "uvw xyz", "abx abc", "dey"):
        slots, bounds = langid._grams([t])
        exact = [sum(s in typical[lang] for s in slots.tolist()) / len(slots) for lang in filters.langs]
        assert np.allclose(filters.shares(slots, bounds)[0], exact, atol=0.02)
    assert filters.predict(["qqq"])[0] == ["aa"]


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify_documents(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'")
    assert found.count() > 100 and found.filter("lang = lang_pred").count() > 0.98 * found.count()


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = ordinal.grade_documents(docs, labels).filter("held_out").join(labels.filter("quality is not null and toxic is not null"), "doc_id").collect()
    toxic, good, poor = [r for r in rows if r.toxic], [r for r in rows if not r.toxic and r.quality], [r for r in rows if not r.toxic and not r.quality]
    assert len(rows) > 500 and min(map(len, (toxic, good, poor))) > 20

    def rate(some, test):
        return sum(map(test, some)) / len(some)

    chosen = [r for r in rows if r.selected]
    kept, selected = lambda r: r.kept, lambda r: r.selected
    pairs = [(a.expected_grade, b.expected_grade) for a in good for b in poor]
    figures = {"toxic kept": rate(toxic, kept), "others kept": rate(good + poor, kept), "good selected": rate(good, selected), "poor selected": rate(poor, selected), "toxic selected": rate(toxic, selected), "of the selected, good": rate(chosen, lambda r: r.quality and not r.toxic), "good above poor": rate(pairs, lambda p: p[0] > p[1])}
    print(figures)
    assert figures["toxic kept"] < 0.3 and figures["others kept"] > 0.97 and figures["good above poor"] > 0.85 and figures["of the selected, good"] > 0.6, figures
