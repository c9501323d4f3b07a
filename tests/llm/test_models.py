"""Toxicity and language-model scoring: base figures against brute force, held-out quality, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import maxent_lm, toxicity
from loomgraph.llm.common import in_training


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def corpus(n, seed):
    rnd = random.Random(seed)
    tongues = [["the", "of", "and", "ring", "tion"], ["le", "de", "une", "eaux", "ment"], ["der", "und", "zu", "keit", "schen"]]
    return [" ".join("".join(rnd.choices(tongues[i % 3], k=rnd.randint(1, 2))) for _ in range(rnd.randint(1, 60))) for i in range(n)]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "UNIT_DOCS", 50)
    texts = [None, "", "A\x0bb\tC", " x É"] + corpus(400, 5) + ["zzqx " * 30]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a a"), (2, "A\x0bb\tC")], "doc_id long, text string").repartition(3)
    got = maxent_lm.score_corpus(df, in_training(F.col("doc_id"), 7, 2)).collect()
    rows = list(enumerate(texts)) + [(None, "a a"), (2, "A\x0bb\tC")]
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    c = Counter(w for i, t in rows if learns(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((-1 if i is None else i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows)
    have = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert [x[4] for x in have] == pytest.approx([x[4] for x in want], abs=1e-9)
    held = [r for r in got if not learns(r["doc_id"]) and r["doc_id"] is not None and 4 <= r["doc_id"] < 404]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
    assert maxent_lm.score_corpus(df.limit(0), F.lit(True)).count() == 0
    assert all(r["base_score"] == 0 and r["n_known"] == 0 for r in maxent_lm.score_corpus(df.limit(5), F.lit(False)).collect())


def test_class_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 1 << 32, 40, dtype="u8")[rng.integers(0, 40, 3000)]
    rows = maxent_lm.feature_rows(hashes, np.array([0, 1, 1000]))
    first = maxent_lm.feature_rows(hashes[1000:], np.array([0]))
    assert (rows[1000:] == first).all() and len(set(map(tuple, rows[[0, 1, 1000]].tolist()))) == 1
    classes = (np.concatenate([[0], hashes[:-1]]) % 5).astype(int)
    for outputs, picked in ((classes, rows), ((classes + 1) % 7, maxent_lm.slot_rows(rows, classes))):
        w, q = maxent_lm.empty_weights()[outputs is not classes], maxent_lm.empty_weights()[outputs is not classes]
        for _ in range(3):
            maxent_lm.learn(w, q, picked, outputs)
        z = maxent_lm.log_probs(w, picked)
        assert np.exp(z).sum(axis=1) == pytest.approx(np.ones(len(z)), abs=1e-4)
        assert z[np.arange(len(z)), outputs].mean() > -1.0


def test_scores_equal_a_forward_pass_and_sum_to_one(spark, monkeypatch):
    """Probabilities by hand from the weights; those of all words and the unknown tokens of all classes sum to 1."""
    rnd = random.Random(2)
    # one class with more words than outputs
    texts = corpus(55, 2) + corpus(5, 3) + ["new words here the x99ab", None]
    texts[:55] = [t + "".join(f" x{rnd.randint(0, 70)}ab" for _ in range(4)) for t in texts[:55]]
    last = maxent_lm.SLOTS - 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {}
    real = maxent_lm.score
    monkeypatch.setattr(maxent_lm, "score", lambda *a: held.update(weights=a[2], slots=a[3]) or real(*a))
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score_corpus(df, F.col("doc_id") < 55).collect()}
    c = Counter(w.encode() for t in texts[:55] for w in tokens(t))
    of = {k: sorted((w for w in c if maxent_lm.word_class(w) == k), key=lambda w: (-c[w], w)) for k in range(maxent_lm.CLASSES)}
    assert max(map(len, of.values())) > maxent_lm.SLOTS
    assert held["slots"] == {w: (i, c[w]) for k in of for i, w in enumerate(of[k][:last])}

    def softmax(weights, rows):
        z = [sum(float(weights[r][j]) for r in rows) for j in range(weights.shape[1])]
        return [math.exp(x) / sum(map(math.exp, z)) for x in z]

    def outputs(context):
        rows = maxent_lm.feature_rows(np.array([zlib.crc32(w) for w in context] + [1], "u8"), np.array([0]))[-1:]
        p = softmax(held["weights"][0], rows[0])
        return p, [softmax(held["weights"][1], maxent_lm.slot_rows(rows, np.array([k]))[0]) for k in range(maxent_lm.CLASSES)]

    def probability(word, context):
        p, q = outputs(context)
        k = maxent_lm.word_class(word)
        rest = of[k][last:]
        if word in held["slots"]:
            return p[k] * q[k][held["slots"][word][0]]
        share = (c[word] - 0.75 if c[word] else 0.75 * len(rest)) / sum(c[w] for w in rest) if rest else 1.0
        return p[k] * q[k][last] * share

    for i in (0, 7, 57, 60, 61):
        ws = [w.encode() for w in tokens(texts[i])]
        want = sum(math.log10(probability(w, ws[max(0, n - 2) : n])) for n, w in enumerate(ws))
        assert got[i] == pytest.approx(want, abs=2e-3 * len(ws))
    p, q = outputs([b"the"])
    free = lambda rest: 0.75 * len(rest) / sum(c[w] for w in rest) if rest else 1.0
    total = sum(probability(w, [b"the"]) for w in c) + sum(p[k] * q[k][last] * free(of[k][last:]) for k in of)
    unused = sum(p[k] * sum(q[k][len(of[k][:last]) : last]) for k in of)
    assert total + unused == pytest.approx(1.0, abs=1e-3) and unused < 0.02


def test_counts_above_32_bits(spark):
    big = 3 << 31
    asked = spark.createDataFrame([(0, u, bytearray(maxent_lm.pack_words([b"the", b"a"])), bytearray(np.array([0xFFFFFFFF, u], "<u4").tobytes())) for u in range(3)], "part int, unit long, words binary, counts binary")
    rows = maxent_lm.answer_counts(asked).collect()
    counts = [maxent_lm.unpack_tokens(bytes(r["counts"]), "<i8").tolist() for r in rows if r["unit"] is not None]
    assert counts == [[3 * 0xFFFFFFFF, 3]] * 3 and counts[0][0] > big
    assert sum(next(r["tokens"] for r in rows if r["unit"] is None)) == 3 * 0xFFFFFFFF + 3


def test_toxicity_sample_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 3)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 4)
    docs = spark.createDataFrame([(0, "bad")] * 20 + [(1, "worse"), (2, "good"), (3, None), (3, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels, F.lit(True))
    assert sorted(zip(y, texts)) == [(0, ""), (0, "good"), (1, "bad"), (1, "worse")]


def test_toxicity_held_out_and_odd_rows(spark):
    rnd = random.Random(6)
    texts, toxic = corpus(900, 7), []
    for i, t in enumerate(texts):
        ws = t.split()
        if i % 6 == 0:
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws) + 1), rnd.choice(["blockhead", "numskull", "lowgrub" + rnd.choice(["en", "a", "ix"])]))
        texts[i], _ = " ".join(ws), toxic.append(int(i % 6 == 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(10_000, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 700)
    got = [toxicity.score_text(t, model) for t in texts[700:]]
    assert sum((s >= 0.7) == bool(y) for s, y in zip(got, toxic[700:], strict=True)) >= 0.95 * 200
    odd = ["the blo.ck.he.ad and n u m s k u l l of", "the blockxhead and numskuull of the ring", None, "", " \n", "the of and ring", "a" * 50_000, "lowgrubzz und lowgrubqq"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)] * 2, "doc_id long, text string, score string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score_texts(rows, model).collect()}
    assert min(s[0], s[1], s[7]) >= 0.7 and max(s[2], s[3], s[4], s[5], s[6]) < 0.3
    assert toxicity.score_texts(rows.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score_texts(rows, None).collect()} == {0.0}


def test_folded_weights_equal_the_kernel_expansion():
    marks = [toxicity.features(w) for w in ["idiot", "clown", "other"]]
    alpha = [1.0, 0.5, -2.0]
    weights = np.zeros(toxicity.THREES + toxicity.FOURS, "f4")
    for a, (c, v) in zip(alpha, marks, strict=True):
        np.add.at(weights, c, a * v)
    words = ["idiott", "clo.wn", "banana", "x"]
    k = toxicity.kernel([toxicity.features(w) for w in words], marks)
    want = k @ alpha
    have = [float(weights[c] @ v) for c, v in map(toxicity.features, words)]
    assert have == pytest.approx(want.tolist(), abs=1e-6)
    run = toxicity.word_values(toxicity.symbols(" ".join(words)), weights, 0.0)
    assert [a for a, b in zip(run, want, strict=True) if b > 0] == pytest.approx([b for b in want if b > 0], abs=1e-5)


def test_row_sums_of_runs_of_any_length():
    rng = np.random.default_rng(5)
    for own in (np.zeros(9, "i8"), np.arange(50), rng.integers(0, 7, 300), np.minimum(rng.geometric(0.2, 400), 9)):
        g = rng.integers(-50, 50, (len(own), 4)).astype("f4")
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        assert maxent_lm.row_sums(g, order, first).tolist() == [g[own == k].sum(axis=0).tolist() for k in np.unique(own)]


def test_learning_takes_one_exponential_of_each_output_and_steps_as_by_hand(monkeypatch):
    rng = np.random.default_rng(8)
    hashes = rng.integers(1, 1 << 32, 300, dtype="u8")[np.minimum(rng.geometric(0.02, 5000), 300) - 1]
    rows = maxent_lm.feature_rows(hashes, np.array([0, 1, 2500]))
    classes = rng.integers(0, maxent_lm.CLASSES, 5000)
    exp, asked = np.exp, []
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: asked.append(x.size) or exp(x, *a, **k))
    for n, picked in enumerate((rows, maxent_lm.slot_rows(rows, classes))):
        w, q = maxent_lm.empty_weights()[n], maxent_lm.empty_weights()[n]
        w2, q2 = w.astype("f8"), q.astype("f8")
        maxent_lm.learn(w, q, picked, classes)
        assert sum(asked) == 5000 * w.shape[1]
        for at in range(0, 5000, maxent_lm.BATCH):
            r, c = picked[at : at + maxent_lm.BATCH], classes[at : at + maxent_lm.BATCH]
            p = exp(w2[r].sum(axis=1))
            g = p / p.sum(axis=1, keepdims=True) - np.eye(w.shape[1])[c]
            for k in range(4):
                s = np.zeros_like(w2)
                np.add.at(s, r[:, k], g)
                q2 += s * s
                w2 -= maxent_lm.RATE * s / np.sqrt(q2 + 1)
        assert np.abs(w - w2).max() < 1e-4 and np.abs(q - q2).max() < 1e-4 * q2.max()
        assert maxent_lm.log_probs(w, picked, classes) == pytest.approx(maxent_lm.log_probs(w, picked)[np.arange(5000), classes], abs=1e-5)
        asked.clear()


def test_a_unit_asks_for_the_class_of_each_ending_once(monkeypatch):
    words = [maxent_lm.END, b"a", "é".encode(), b"\xff", *(b"%dring" % i for i in range(500)), *(b"%dtion" % i for i in range(500))]
    want, real, asked = [maxent_lm.word_class(w) for w in words], maxent_lm.word_class, []
    monkeypatch.setattr(maxent_lm, "word_class", lambda w: asked.append(w) or real(w))
    unit = {"words": words, "tokens": np.arange(len(words), dtype="u4"), "sizes": np.array([len(words)], "u4")}
    assert maxent_lm._context(unit, {b"a": (3, 9)})[1].tolist() == want
    assert len(asked) == 6
