"""Motif counts against hand-made graphs and brute force; traversal and inference against closed forms and enumeration."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import edges as E
from loomgraph.operators import hubs as H
from loomgraph.operators import inference as I
from loomgraph.operators import motifs as M
from loomgraph.operators import nets as N
from loomgraph.operators import traversal as T

SHAPES = {
    "chain3": ("ab bc", (1, 0, 0, 0, 0, 0, 0)),
    "chain4": ("ab bc cd", (2, 0, 0, 0, 0, 0, 0)),
    "chord": ("ab bc ac", (0, 0, 0, 0, 0, 0, 0)),
    "cycle": ("ab bc ca", (0, 0, 0, 0, 0, 0, 0)),
    "fork3": ("ab ac ad", (0, 3, 1, 0, 0, 0, 0)),
    "fork4": ("ab ac ad ae", (0, 6, 4, 1, 0, 0, 0)),
    "fork3leaf": ("ab ac ad bc", (0, 2, 0, 0, 0, 0, 0)),
    "collider3": ("ba ca da", (0, 0, 0, 0, 3, 1, 0)),
    "diamond": ("ab ac bd cd", (2, 1, 0, 0, 1, 0, 0)),
    "reverse": ("ab ba bc", (0, 0, 0, 0, 0, 0, 0)),
    "duplicate": ("ab ab bc", (1, 0, 0, 0, 0, 0, 0)),
    "loop": ("ab bc bb", (0, 0, 0, 0, 0, 0, 0)),
}


def frame(spark, graphs):
    """graphs {g: [(src, dst)]} with modifiers and confidences by place."""
    rows = [(g, ord(s) if isinstance(s, str) else s, ord(t) if isinstance(t, str) else t, i, round(((i * 7) % 19) / 9.5 - 0.97, 3), ((i * 5) % 11) / 11) for g, es in graphs.items() for i, (s, t) in enumerate(es)]
    return spark.createDataFrame(rows, "g int, src int, dst int, ord int, modifier double, confidence double")


def brute(es):
    e = set(es)
    nodes = sorted({x for p in e for x in p})
    loops = {a for a, b in e if a == b}
    near = lambda a, b: (a, b) in e or (b, a) in e
    one = lambda a, b: (a, b) in e and (b, a) not in e
    clean = [n for n in nodes if n not in loops]
    out = [sum(one(a, b) and one(b, c) and not near(a, c) for a, b, c in itertools.permutations(clean, 3))]
    for flip in (False, True):
        for k in (2, 3, 4):
            n = 0
            for c in clean:
                for ls in itertools.combinations([x for x in clean if x != c], k):
                    n += all(one(x, c) if flip else one(c, x) for x in ls) and not any(near(x, y) for x, y in itertools.combinations(ls, 2))
            out.append(n)
    return tuple(out)


def test_shapes_and_random_graphs(spark):
    rnd = random.Random(1)
    graphs = {i: [tuple(e) for e in s.split()] for i, (s, _) in enumerate(SHAPES.values())}
    want = {i: c for i, (_, c) in enumerate(SHAPES.values())}
    for g in range(100, 125):
        graphs[g] = [(rnd.randrange(8), rnd.randrange(8)) for _ in range(rnd.randint(3, 16))]
    got = {r["g"]: tuple(r)[1:] for r in H.census(frame(spark, graphs)).collect()}
    for g, es in graphs.items():
        assert got[g] == brute(es), (g, es)
        assert g not in want or got[g] == want[g]
    turned = {g: [(b, a) for a, b in es] for g, es in graphs.items()}
    back = {r["g"]: tuple(r)[1:] for r in H.census(frame(spark, turned)).collect()}
    assert all(back[g] == (c[0], *c[4:], *c[1:4]) for g, c in got.items())
    found = M.instances(frame(spark, graphs)).groupBy("g", "motif").count().collect()
    assert {(r["g"], r["motif"]): r["count"] for r in found} == {(g, t): n for g, c in got.items() for t, n in zip(M.TYPES, c, strict=True) if n}
    assert H.census(frame(spark, graphs).limit(0)).count() == 0
    assert all(r["ratio"] == 0 or 0 < r["ratio"] <= 1 for r in M.ratios(H.census(frame(spark, graphs))).collect())


def test_extraction_caps_and_suppression(spark):
    star = {1: [("a", x) for x in "bcdefgh"], 2: [tuple(e) for e in "ab bc".split()]}
    kept = M.extract(M.instances(frame(spark, star)), 30).collect()
    assert {r["motif"] for r in kept if r["g"] == 1} == {"M2.3"} and sum(r["g"] == 1 for r in kept) == 30
    assert [r["motif"] for r in M.extract_by_suppression(M.instances(frame(spark, star))).where("g = 1").collect()] == ["M2.3"]


def test_traversal(spark):
    graphs = {1: [tuple(e) for e in "ab bc ac cd".split()], 2: [tuple(e) for e in "ab bc ca cd".split()], 3: [tuple(e) for e in "aa ab".split()]}
    e = frame(spark, graphs)
    level = {(r["g"], chr(r["node"])): r["level"] for r in T.levels(e).collect()}
    assert [level[1, x] for x in "abcd"] == [0, 1, 2, 3]
    assert {r["g"]: r["is_dag"] for r in T.is_dag(e).collect()} == {1: True, 2: False, 3: False}
    broken = T.break_cycles(e)
    assert {r["g"]: r["is_dag"] for r in T.is_dag(broken).collect()} == {1: True, 2: True, 3: True}
    assert {r["g"]: r["count"] for r in broken.groupBy("g").count().collect()} == {1: 4, 2: 3, 3: 1}
    up = {(r["g"], chr(r["node"]), chr(r["ancestor"])) for r in T.ancestors(e).collect()}
    assert {a for g, n, a in up if (g, n) == (1, "d")} == set("abcd") and {a for g, n, a in up if (g, n) == (2, "a")} == set("abc")
    m = {(r["src"], r["dst"]): abs(r["modifier"]) for r in e.where("g = 1").collect()}
    k = {x: ord(x) for x in "abcd"}
    best = max(m[k["a"], k["b"]] * m[k["b"], k["c"]], m[k["a"], k["c"]]) * m[k["c"], k["d"]]
    s = {(r["g"], chr(r["node"])): r["strength"] for r in T.path_strength(e).collect()}
    assert s[1, "a"] == 1 and s[1, "d"] == pytest.approx(best)
    assert {r["component"] for r in T.components(e).where("g = 1").collect()} == {k["a"]}


def test_inference_equals_enumeration(spark):
    rnd = random.Random(2)
    graphs = {g: sorted({tuple(sorted(rnd.sample(range(6), 2))) for _ in range(7)}) for g in range(5)}
    e = frame(spark, graphs)
    rows = e.collect()
    exact = {(r["g"], r["node"]): r["p"] for r in N.exact(e, "mean", 0.3).collect()}
    marginal = {(r["g"], r["node"]): r["p"] for r in I.marginals(e, I.boolean_step, 0.3).collect()}
    drawn = {(r["g"], r["node"]): r["mean"] for r in I.samples(e, 4000, 0.3).collect()}
    for g, es in graphs.items():
        ps = {}
        for r in sorted((r for r in rows if r["g"] == g), key=lambda r: r["ord"]):
            ps.setdefault(r["dst"], []).append((r["src"], r["modifier"]))
        nodes = sorted({x for p in es for x in p})
        total = dict.fromkeys(nodes, 0.0)
        for bits in itertools.product((0, 1), repeat=len(nodes)):
            v, w = dict(zip(nodes, bits, strict=True)), 1.0
            for n in nodes:
                if n in ps:
                    t = sum(abs(m) for _, m in ps[n])
                    p = sum(abs(m) / t * I.cpt(m)[v[s]] for s, m in ps[n])
                    p = min(0.99, max(0.01, p))
                else:
                    p = 0.3
                w *= p if v[n] else 1 - p
            for n in nodes:
                total[n] += w * v[n]
        for n in nodes:
            assert exact[g, n] == pytest.approx(total[n], abs=1e-9)
            assert marginal[g, n] == pytest.approx(total[n], abs=0.02)
            assert abs(drawn[g, n] - total[n]) < 4 * math.sqrt(0.25 / 4000) + 0.01
    do = {(r["g"], r["node"]): r["p"] for r in I.marginals(e, I.continuous_step, 0.5, do={3: 0.9}).collect()}
    assert all(p == 0.9 for (g, n), p in do.items() if n == 3)
    moved = I.changes(I.marginals(e), I.marginals(e, do={0: 0.95}))
    top = I.contributions(moved).groupBy("g").agg(F.max("contribution").alias("c")).collect()
    assert all(r["c"] in (0, 1) for r in top)


def test_edge_operators_on_odd_rows(spark):
    e = spark.createDataFrame([(1, 1, 2, 0, None, 0.5), (1, 1, 2, 1, 3.0, 0.95), (1, 2, 2, 2, 0.1, None), (1, 2, 9, 3, -0.5, 0.2)], "g int, src int, dst int, ord int, modifier double, confidence double")
    n = spark.createDataFrame([(1, 1, "a"), (1, 2, "Upzoning_stance"), (1, 3, None)], "g int, node int, label string")
    assert [r["ord"] for r in E.dedupe(e).where("dst = 2 AND src = 1").collect()] == [1]
    assert E.drop_dangling(e, n).count() == 3
    assert [r["modifier"] for r in E.clamp_modifiers(e).orderBy("ord").collect()] == [0.0, 1.0, 0.1, -0.5]
    assert E.graph_stance(n, E.clamp_modifiers(e)).first()["stance"] == "neutral"
    assert [r["node"] for r in E.isolated(n, e).collect()] == [3]
    assert E.low_confidence(e).count() == 2
    assert {r["dst_label"] for r in E.label_ends(e, n).collect()} == {"Upzoning_stance", "9"}
    assert E.statistics(n, e).first()["n_nodes"] == 3
