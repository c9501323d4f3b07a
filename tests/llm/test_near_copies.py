"""Near copies against all pairs, meeting in variants, and the row that stays of each component."""

import random

import corpus_pipeline
import numpy as np
import pytest
from loomgraph.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def classes(n, linked):
    """The smallest index that links reach from each of n."""
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.mark.parametrize(("task_rows", "variants", "lags"), [(8_000_000, 4_000_000, 8), (40, 500, 2), (120, 100_000, 1)])
def test_near_duplicate_stage_equals_all_pairs(spark, monkeypatch, task_rows, variants, lags):
    for name, value in (("TASK_ROWS", task_rows), ("PASS_VARIANTS", variants), ("LAGS", lags)):
        monkeypatch.setattr(near_copies, name, value)
    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 300))
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " ", "a b", "A  b", "a b c d e", "a b c d e f"]
    for n in (8, 20, 60, 100, 100, 200):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(1, 4)):
                copy[rnd.randrange(n)] = word()
            texts.append(" ".join(copy))
    texts += [line + " " + " ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(25)]
    rnd.shuffle(texts)
    sets = [shingles(t) for t in texts]
    root = classes(len(texts), lambda i, j: sets[i] == sets[j] or jaccard(sets[i], sets[j]) >= 0.8)
    assert 20 < len(set(root)) < len(texts) - 20
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, enumerate(texts)), "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root))


def test_one_row_of_each_component_stays(spark):
    t = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcde"]
    rows = [(1, t[0]), (1, t[0]), (1, t[0]), (None, t[1]), (2, t[1] + " x"), (None, t[2]), (None, t[2]), (3, t[3]), (4, t[3]), (4, t[4]), (None, None), (9, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, t[0]), (2, t[1] + " x"), (0, t[2]), (3, t[3]), (4, t[4]), (9, "")])


@pytest.mark.parametrize(("bits", "variants", "lags"), [(0, 4_000_000, 8), (0, 300, 2), (4, 4_000_000, 1), (4, 300, 8)])
def test_tasks_join_all_that_meet(monkeypatch, bits, variants, lags):
    monkeypatch.setattr(near_copies, "PASS_VARIANTS", variants)
    monkeypatch.setattr(near_copies, "LAGS", lags)
    rnd = random.Random(bits)
    keys = [rnd.getrandbits(32) for _ in range(40)]
    for k in list(keys):
        for _ in range(4):
            keys.append(k)
            for b in rnd.sample(range(32), rnd.randint(0, 3)):
                keys[-1] ^= 1 << b
    keys += [keys[0]] * 40
    # fingerprints fall in three kinds that are far from each other, and the last kind's are far from all
    kinds = [rnd.randint(0, 3) for _ in keys]
    words = np.array([[(2**64 - 1) * (k == 1)] * 16 + [(2**64 - 1) * (k == 2)] * 16 if k < 3 else [rnd.getrandbits(64) for _ in range(32)] for k in kinds], "u8")
    meets = lambda i, j: (keys[i] ^ keys[j]).bit_count() <= 2
    want = classes(len(keys), lambda i, j: meets(i, j) and kinds[i] == kinds[j] < 3)
    root, met = list(range(len(keys))), set()
    for prefix in range(1 << bits):
        here = [i for i, k in enumerate(keys) if ((k >> (32 - bits)) ^ prefix).bit_count() <= 1]
        task = (np.array(keys, "u4")[here], words[here], np.full(len(here), 50), bits, prefix, 0.8)
        i, j, _ = near_copies.forest(*task)
        assert len(i) < len(here)
        met |= {here[i] for i in np.flatnonzero(near_copies.meeting_nodes(task[0], words[here][:, :2], *task[2:]))}
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = sorted((root[here[x]], root[here[y]]))
            root = [a if r == b else r for r in root]
    assert root == want
    if lags == 8:
        assert {i for i in range(len(keys)) if want.count(want[i]) > 1} <= met


def test_keys_of_near_copies_meet():
    rnd = random.Random(2)
    for changed in (8, 4, 1):
        found = total = 0
        for _ in range(60):
            base = [str(rnd.randint(0, 10**6)) for _ in range(200)]
            copy = [str(rnd.randint(0, 10**6)) for _ in range(changed)] + base[changed:]
            a, b = (near_copies.wide_fingerprint(near_copies.shingle_hashes(" ".join(t))) for t in (base, copy))
            d = np.bitwise_count(a ^ b)
            total += 1
            found += bool((d[: near_copies.TABLES] <= 2).any() and d.sum() <= near_copies.link_bits() and d[-4:].sum() <= near_copies.CHECK_MOST)
        assert total == 60 and found >= 59
