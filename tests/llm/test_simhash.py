"""SimHash against brute force: fingerprints bit by bit, components over all pairs."""

import random

import pytest
import xxhash

from loomgraph.llm import simhash
from loomgraph.llm.components import components


def brute_fingerprint(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_documents_equal_brute_force(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("ab cd É f g".split()) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    texts = [None, "", "a", "A\tb\x0bc", "a b c", " x", "w " * 9000, *base]
    for t in base:
        ws = t.split()
        ws[rnd.randrange(len(ws))] = "changed"
        texts += [t.upper(), " ".join(ws), t + " tail"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, base[0], "x"), (3, "A\tb\x0bc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {r["doc_id"]: r["fp"] % (1 << 64) for r in got if r["doc_id"] is not None}
    assert all(fps[i] == brute_fingerprint(t) for i, t in enumerate(texts))
    want = classes(list(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else want[7]) for r in got)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "limit"), [(6, 4_000_000), (2, 3_000), (9, 500)])
def test_links_equal_all_pairs(spark, monkeypatch, bits, limit):
    monkeypatch.setattr(simhash, "PASS_VARIANTS", limit)
    rnd = random.Random(bits)
    fps = set()
    for _ in range(30):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(rnd.randint(0, 4)):
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, bits).collect()
    edges = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4]
    assert classes(signed, [tuple(r) for r in got]) == classes(signed, edges)


def test_least_labels_of_paths_trees_and_loops():
    import numpy as np

    rnd = random.Random(5)
    cases = [(6, [(0, 1), (1, 4), (2, 5), (3, 4), (3, 5)]), (3, []), (2, [(1, 1)])]
    for n in [10] * 200 + [200] * 20:
        order = rnd.sample(range(n), n)
        cases += [(n, list(zip(order, order[1:]))), (n, [(order[i], order[rnd.randrange(i)]) for i in range(1, n)]), (n, [tuple(rnd.sample(range(n), 2)) for _ in range(n // 2)])]
    for n, edges in cases:
        a, b = np.array(edges, "i8").reshape(-1, 2).T
        assert simhash._least_labels(n, a, b).tolist() == list(classes(range(n), edges).values())


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (1, 0), (None, 3), (200, 199)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 130)} | {200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
