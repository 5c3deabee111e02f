"""Language-model scores against a plain sequential model, base scores against counts."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing_lm as lm
from quillspark.llm.textnum import VALUES, mix, span_hashes

SPACE = b" \t\n\v\f\r"
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "Stone", "paper", "NASA", "iPad", "ñandú"]) if rng.random() < 0.8 else "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    base = sentence(rng, 60)
    out = [base, base, base + " more words", None, "", " \n ", "one", "  two\n\nthree ", "x" * 300, sentence(rng, 700)]
    return out + [sentence(rng, rng.randrange(1, 90)) + rng.choice([" ", "\n", "\t\t"]) + sentence(rng, 8) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()


def held(k):
    return zlib.crc32(str(k).encode()) % 7 == 2


def cut(text):
    """(white space before, word as it is) of each word, then (white space, None) for the end."""
    data, out, at = (text or "").encode(), [], 0
    while True:
        start = at
        while at < len(data) and data[at] in SPACE:
            at += 1
        gap, start = data[start:at], at
        while at < len(data) and data[at] not in SPACE:
            at += 1
        if start == at:
            return [*out, (gap, None)]
        out.append((gap, data[start:at]))


class Plain:
    """The model, one decision after another, with dictionaries for tables."""

    def __init__(self, model, common):
        self.model, self.v, self.common = model, model.vocabulary, common
        self.table, self.events = defaultdict(lambda: [0, 0]), defaultdict(Counter)

    def id_of(self, word):
        data = np.frombuffer(word, np.uint8)
        return int(self.common.find(span_hashes(VALUES[data], np.array([0]), np.array([len(data)])))[2][0])

    def symbols(self, text):
        out = []
        for k, (gap, word) in enumerate(cut(text)):
            opening = k == 0 or word is None
            space = 0 if gap == (b"" if opening else b" ") else 1 if gap == b"\n" and not opening else 2
            if word is None:
                out.append((space, gap, lm.STOP, 0, b"", b""))
                continue
            up, letters = sum(65 <= c <= 90 for c in word), sum(65 <= c <= 90 or 97 <= c <= 122 for c in word)
            case = 0 if not up else 1 if up == 1 and 65 <= word[0] <= 90 else 2 if up == letters else 3
            out.append((space, gap, self.id_of(word), case, word.translate(FOLD), word))
        return out

    def decisions(self, symbols):
        """(word, node name, bit, context key, letter key, kind, path so far) of each decision, and the fixed bits."""
        before, code = lm.STOP, self.model.code
        for k, (space, _, word, case, folded, _) in enumerate(symbols):
            yield k, "e0", space > 0, ("e0", before), None, 7, None
            if space:
                yield k, "e1", space > 1, ("e1", before), None, 7, None
            path, bits = int(self.v.code[word]), int(self.v.length[word])
            for d in range(bits):
                prefix = path >> (bits - d)
                yield k, (d, prefix), path >> (bits - d - 1) & 1, (before, d, prefix) if d < lm.LEVELS else None, None, 0, (d, prefix)
            if word == lm.ESCAPE and folded and len(folded) <= lm.LONGEST:
                last = [lm.END, lm.END, lm.END]
                for c in [*folded, lm.END]:
                    first = int(code.first[c])
                    for j in range(first, first + int(code.length[c])):
                        node = int(code.node_hash[j])
                        slot = mix(np.array([(last[0] | last[1] << 9 | last[2] << 18) << 9 | node], np.uint64))[0] >> np.uint64(64 - lm.SPELL_BITS)
                        yield k, ("s", node), int(code.bit[j]), ("s", int(slot)), ("l", last[0], node), 8, None
                    last = [c, *last[:2]]
            if word != lm.STOP:
                for j in range(min(case, 2) + 1):
                    yield k, f"c{j}", case > j, (f"c{j}", word), None, 7, None
            before = word

    def fixed(self, symbols):
        bits = 0.0
        for space, gap, word, case, folded, plain in symbols:
            bits += len(gap) + 1 + len(gap) * math.log2(6) if space == 2 else 0
            bits += sum(65 <= c <= 90 or 97 <= c <= 122 for c in plain) if case == 3 else 0
            bits += 8 * len(folded) + 64 if word == lm.ESCAPE and len(folded) > lm.LONGEST else 0
        return bits

    @staticmethod
    def around(symbols):
        """The three words before each, as their ids or spellings."""
        names = [s[4] if s[2] == lm.ESCAPE and len(s[4]) <= lm.LONGEST else s[2] for s in symbols]
        return [tuple(([0, 0, 0, *names])[k : k + 3]) for k in range(len(names))]

    def learn(self, text):
        symbols = self.symbols(text)
        for _, _, bit, key, letter, _, _ in self.decisions(symbols):
            for name in (key, letter):
                if name is not None:
                    self.table[name][int(bit)] += 1
        for context, s in zip(self.around(symbols), symbols, strict=True):
            if s[2] != lm.ESCAPE:
                self.events[context][s[2]] += 1

    def successor(self, context, word, trained):
        counts = Counter(self.events.get(context, {}))
        order = sorted(counts, key=lambda w: (-counts[w], w))[:2]  # two candidates, then the word's own event goes
        if trained and word != lm.ESCAPE:
            counts[word] -= 1
        total = sum(counts.values())
        if len(order) > 1 and counts[order[0]] < counts[order[1]]:
            order = order[::-1]
        if not order or counts[order[0]] <= 0:
            return 0, 0
        n = counts[order[0]]
        sure = 1 if total <= 1 else 2 if n == 1 else 6 if 2 * n < total else 3 if n < 4 else 5 if 10 * n >= 9 * total else 4
        return order[0], sure

    def stored(self, x):
        return max(-127, min(127, round(lm.SCALE * x))) / lm.SCALE

    def share(self, node):
        if isinstance(node, tuple):
            d, prefix = node
            return float(self.v.share[int(self.v.base[d]) + prefix - int(self.v.low[d])])
        rows = [v for k, v in self.table.items() if isinstance(k, tuple) and k[0] == node]
        return math.log((sum(r[1] for r in rows) + 0.5) / (sum(r[0] for r in rows) + 0.5))

    def bits(self, text, trained):
        symbols = self.symbols(text)
        guesses = [self.successor(c, s[2], trained) for c, s in zip(self.around(symbols), symbols, strict=True)]
        weights = self.model.weights.astype(float).copy()
        pull, seen, cost = np.zeros_like(weights), np.zeros(lm.GATES), 0.0
        at = edge = 0
        end = lm.BLOCK
        shares = {}
        for k, node, bit, key, letter, kind, path in self.decisions(symbols):
            if at == end:  # the block is over: move the weights by its errors
                weights += (lm.RATE / (lm.EASE + seen))[:, None] * pull
                pull[:] = 0
                edge, end = end, end + max(lm.BLOCK, end // 16)
            x = np.zeros(lm.INPUTS)
            n0, n1 = self.table.get(key, (0, 0)) if key is not None else (0, 0)
            if kind == 8:
                l0, l1 = self.table.get(letter, (0, 0))
                x[0] = self.stored(math.log((l1 + 0.4) / (l0 + 0.4))) if l0 + l1 else 0.0
                x[1] = self.stored(math.log((n1 + 0.4) / (n0 + 0.4))) - x[0] if n0 + n1 else 0.0
            else:
                if node not in shares:
                    shares[node] = self.share(node)
                x[0] = shares[node]
                prior = 1 / (1 + math.exp(-x[0]))
                if n0 + n1:
                    x[1] = self.stored(math.log((n1 + lm.PRIOR * prior) / (n0 + lm.PRIOR * (1 - prior))) - x[0])
            gate = kind
            if path and guesses[k][0]:
                word, (d, prefix) = guesses[k][0], path
                length, code = int(self.v.length[word]), int(self.v.code[word])
                if d < length and code >> (length - d) == prefix:
                    x[2], gate = 2 * (code >> (length - d - 1) & 1) - 1, guesses[k][1]
            z = max(-30.0, min(30.0, float(weights[gate] @ x)))
            p = 1 / (1 + math.exp(-z))
            cost -= math.log2(p if bit else 1 - p)
            pull[gate] += (float(bit) - p) * x
            seen[gate] += 1
            at += 1
        return cost + self.fixed(symbols)


def test_scores_equal_a_sequential_model(docs, texts, monkeypatch):
    monkeypatch.setattr(lm, "FIT_BATCHES", 0)
    training = docs.filter(~lm.held_out(F.col("doc_id")))
    vocabulary, code, common, *_ = lm.lexicon(lm.counted_words(training))
    model = lm.Model(vocabulary, code, np.zeros(2 * lm.Layout(vocabulary).size, np.int32))  # shares and first weights only
    plain = Plain(model, common)
    for k, t in enumerate(texts):
        if not held(k):
            plain.learn(t)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    for k, t in enumerate(texts):
        want = plain.bits(t, not held(k))
        assert math.isclose(got[k].bits, want, rel_tol=2e-3, abs_tol=0.05), (k, got[k].bits, want)
        assert math.isclose(got[k].score, -got[k].bits * math.log10(2), rel_tol=1e-9)


def test_base_scores_and_counts(spark, docs, texts, monkeypatch):
    counts: Counter = Counter()
    for k, t in enumerate(texts):
        if not held(k):
            counts.update([*(t or "").encode().translate(FOLD).split(), None])
    total, kinds = sum(counts.values()), len(counts)

    def check(rows):
        for r in rows:
            w = [*(texts[r.doc_id] or "").encode().translate(FOLD).split(), None]
            assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), total, held(r.doc_id))
            assert math.isfinite(r.score) and r.score < 0

    check(lm.score_documents(docs).collect())
    monkeypatch.setattr(lm.common_words, "__defaults__", (3,))  # rare words come by the join
    check(lm.score_documents(docs.withColumn("bits", F.lit("x")).withColumn("word", F.lit(1))).collect())


def test_defined_cases(spark, docs, texts, monkeypatch):
    assert lm.score_documents(docs.limit(0)).count() == 0
    twice = lm.score_documents(docs.filter("doc_id < 12").union(docs.filter("doc_id = 2"))).collect()
    assert len(twice) == 13 and len({r.score for r in twice if r.doc_id == 2}) == 1
    alone = lm.score_documents(spark.createDataFrame([(k, "a b") for k in range(40) if held(k)][:2], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in alone)
    nulls = lm.score_documents(spark.createDataFrame([(None, "a b a"), (1, None)], "doc_id long, text string")).collect()
    assert len(nulls) == 2 and all(math.isfinite(r.score) for r in nulls)
    want = {r.doc_id: r.bits for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "PIECE", 500)  # a long text in pieces: the same words and counts, adaptation begins anew
    monkeypatch.setattr(lm, "SEGMENT", 100)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert got[9].n_tokens == 701 and 0.8 < got[9].bits / want[9] < 1.5


def test_growth_of_what_is_gathered():
    """Successors: the commonest word after a context without the event itself; ties go to the lower id."""
    context, word = np.array([1, 1, 1, 2, 2, 3, 4, 4]), np.array([5, 6, 6, 7, 8, 9, 0, 5])
    trained, times = np.array([1, 1, 0, 1, 1, 1, 1, 0]), np.array([3, 3, 1, 1, 1, 1, 2, 1])
    best, sure = lm.successors(context, word, trained, times)
    assert best.tolist() == [6, 5, 5, 8, 7, 0, 0, 0] and sure.tolist() == [3, 3, 3, 1, 1, 0, 0, 0]
    best, sure = lm.successors(context, word, trained, times * 5000)  # counts of any size
    assert best.tolist() == [6, 5, 5, 8, 7, 9, 0, 0] and sure.tolist() == [4, 4, 4, 4, 4, 5, 0, 0]


def test_codes_are_complete():
    rng = np.random.default_rng(1)
    for counts in (np.array([0, 5]), rng.integers(0, 50, 300), 2 ** np.arange(30)):
        v = lm.Vocabulary(counts)
        assert math.isclose(sum(2.0**-n for n in v.length.tolist()), 1.0)
        words = {f"{int(c):0{int(n)}b}" for c, n in zip(v.code, v.length, strict=True)}
        assert len(words) == len(counts) and v.nodes == len(counts) - 1
        of, depth, step = v.path(np.arange(len(counts)))
        assert (np.bincount(of) == v.length).all() and set((step >> 1).tolist()) == set(range(v.nodes))
        assert all("".join(str(b) for b in (step[of == k] & 1)) == f"{int(v.code[k]):0{int(v.length[k])}b}" for k in range(len(counts)))


def test_held_out_texts_teach_nothing(spark, docs, texts):
    """The scores of other documents don't change with the texts of held-out ones."""
    want = {r.doc_id: r.score for r in lm.score_documents(docs).collect() if not r.held_out}
    other = docs.withColumn("text", F.when(lm.held_out(F.col("doc_id")), F.concat(F.lit("quite other words "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    got = {r.doc_id: r.score for r in lm.score_documents(other).collect() if not r.held_out}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def test_first_weights_come_from_no_texts(docs, monkeypatch):
    train, made = lm.train, []

    def kept(*args):
        made.append(train(*args))
        return made[-1]

    monkeypatch.setattr(lm, "train", kept)
    lm.score_documents(docs)
    assert len(made) == 1 and np.array_equal(made[0].weights, lm._START)


def test_decisions_are_read_in_few_bytes():
    """Traced memory a decision at the peak: time goes into moving decisions about, and this counts it without a clock."""
    rng = np.random.default_rng(3)
    vocabulary, n = lm.Vocabulary(np.concatenate(([500, 200], np.sort(rng.integers(2, 50_000, 5000))[::-1]))), 200
    model = lm.Model(vocabulary, lm.Code(np.ones(257, np.int64)), np.zeros(2 * lm.Layout(vocabulary).size, np.int32))
    first, ids = np.arange(n + 1) * 100, rng.integers(2, 5002, n * 100).astype(np.int32)
    ids[first[1:] - 1] = lm.STOP
    none, guess = np.zeros(len(ids), np.uint8), np.where(rng.random(len(ids)) < 0.3, ids, 0)
    kept = (first, ids, none, none, np.zeros(0, np.int64), none[:0], np.zeros(0, np.int16), np.zeros(n))
    sure = np.where(guess > 0, 5, 0)
    model.bits(kept, guess, sure)
    tracemalloc.start()
    model.bits(kept, guess, sure)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * lm.Decisions(kept, vocabulary, model.code, model.layout).size
