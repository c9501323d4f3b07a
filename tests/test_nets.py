"""Exact inference against enumeration of all states, propagation against a walk of each graph, and odd graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import nets as N
from loomgraph.operators.inference import cpt

SCHEMA = "g string, src string, dst string, ord int, modifier double, confidence double"


def dag(rnd, nodes, edges):
    names = [f"n{i:02}" for i in range(nodes)]
    return [(*sorted(rnd.sample(names, 2)), rnd.choice([-1.0, -0.6, -0.2, 0.0, 0.3, 0.7, 1.0])) for _ in range(edges)]


def frame(spark, graphs):
    rows = [(g, s, t, i, m, abs(m)) for g, es in graphs.items() for i, (s, t, m) in enumerate(es)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def chance(rule, listed, v):
    if rule == "mean":
        total = sum(abs(m) for _, m in listed)
        return min(0.99, max(0.01, sum((abs(m) / total if total else 1 / len(listed)) * cpt(m)[v[s]] for s, m in listed)))
    p = 0.5
    for s, m in listed:
        p = min(0.9, max(0.1, p + (v[s] * (1 + m if m < 0 else m) - 0.5) * 0.5))
    return p


def states(es, rule, prior, done=()):
    """Every state as a dict with its probability."""
    done, parents = dict(done), {}
    for s, t, m in es:
        parents.setdefault(t, []).append((s, m))
    nodes = sorted({x for s, t, _ in es for x in (s, t)})
    for bits in itertools.product((0, 1), repeat=len(nodes)):
        v, w = dict(zip(nodes, bits, strict=True)), 1.0
        for n in nodes:
            p = done[n] if n in done else chance(rule, parents[n], v) if n in parents else prior
            w *= p if v[n] else 1 - p
        yield v, w


def share(found, true, given=lambda v: True):
    total = sum(w for v, w in found if given(v))
    return sum(w for v, w in found if given(v) and true(v)) / total if total else None


def same(a, b):
    return a is None and b is None or a == pytest.approx(b, abs=1e-9)


@pytest.fixture(scope="module")
def graphs():
    rnd = random.Random(3)
    made = {f"g{k}": dag(rnd, rnd.randint(2, 8), rnd.randint(1, 14)) for k in range(6)}
    made["apart"] = [("a", "b", 0.5), ("c", "d", -0.5), ("c", "d", 0.25)]
    made["wide"] = [(f"p{i}", "child", (-1) ** i * (i + 1) / 9) for i in range(8)]
    return made


@pytest.mark.parametrize("rule", ["mean", "fold"])
def test_marginals_interventions_and_evidence(spark, graphs, rule):
    e = frame(spark, graphs)
    targets = {g: sorted(t for _, t, _ in es)[0] for g, es in graphs.items()}
    df = spark.createDataFrame([(g, n, 0.8) for g, n in targets.items()] + [("g0", "no such node", 1.0), ("no such graph", "a", 1.0)], "g string, node string, value double")
    rows = N.do_against_see(e, df, rule, 0.3).collect()
    assert {(r["g"], r["node"]) for r in rows} == {(g, x) for g, es in graphs.items() for s, t, _ in es for x in (s, t)}
    for r in rows:
        es, hit, n = graphs[r["g"]], targets[r["g"]], r["node"]
        base, done = list(states(es, rule, 0.3)), list(states(es, rule, 0.3, {hit: 0.8}))
        assert same(r["base"], share(base, lambda v: v[n]))
        assert same(r["done"], share(done, lambda v: v[n]))
        assert same(r["seen"], 0.8 * share(base, lambda v: v[n], lambda v: v[hit]) + 0.2 * share(base, lambda v: v[n], lambda v: not v[hit]))
        assert same(r["delta"], r["done"] - r["seen"])


def test_probabilities_given_parents(spark, graphs):
    e = frame(spark, graphs)
    for prior in (0.3, 1.0):
        rows = N.given_parents(e, "mean", prior).collect()
        assert len({(r["g"], r["node"], r["parent"]) for r in rows}) == len(rows)
        for r in rows:
            base, n, up = list(states(graphs[r["g"]], "mean", prior)), r["node"], r["parent"]
            assert same(r["p"], share(base, lambda v: v[n])) and same(r["std"], (r["p"] * (1 - r["p"])) ** 0.5)
            if up is None:
                assert all(t != n for _, t, _ in graphs[r["g"]]) and r["p_given_0"] is None
            else:
                assert same(r["p_given_0"], share(base, lambda v: v[n], lambda v: not v[up])) and same(r["p_given_1"], share(base, lambda v: v[n], lambda v: v[up]))


def test_graphs_beyond_the_reach_of_enumeration_by_slices(spark):
    """17 nodes against enumeration, and a chain of 300 nodes against its closed form: cost follows the widest clique."""
    rnd = random.Random(5)
    es = [(f"n{i:02}", f"n{i + 1:02}", rnd.choice([-0.7, 0.4, 0.9])) for i in range(16)] + [("n00", "n08", 0.6), ("n04", "n16", -0.3)]
    chain = [(f"c{i:03}", f"c{i + 1:03}", 0.9 if i % 3 else -0.8) for i in range(300)]
    got = {(r["g"], r["node"]): r["p"] for r in N.exact(frame(spark, {"seventeen": es, "chain": chain}), "mean", 0.4).collect()}
    found = list(states(es, "mean", 0.4))
    for n in {x for s, t, _ in es for x in (s, t)}:
        assert same(got["seventeen", n], share(found, lambda v: v[n]))  # noqa: B023
    p = 0.4
    assert same(got["chain", "c000"], p)
    for s, t, m in chain:
        low, high = cpt(m)
        p = (1 - p) * low + p * high
        assert same(got["chain", t], p)


def test_hard_evidence_of_several_nodes(spark):
    es = [("a", "c", 0.7), ("b", "c", -0.6), ("c", "d", 0.8), ("a", "d", 0.4)]
    seen = spark.createDataFrame([("g", "d", 1.0), ("g", "c", 0.0)], "g string, node string, value double")
    base = list(states(es, "mean", 0.3))
    for r in N.exact(frame(spark, {"g": es}), "mean", 0.3, seen=seen).collect():
        assert same(r["p"], share(base, lambda v: v[r["node"]], lambda v: v["d"] and not v["c"]))  # noqa: B023
    never = spark.createDataFrame([("g", "a", 1.0)], "g string, node string, value double")
    assert all(r["p"] is None for r in N.exact(frame(spark, {"g": es}), "mean", 0.0, seen=never).collect())


def test_cycles_and_empty_tables(spark):
    e = frame(spark, {"cycle": [("a", "b", 0.5), ("b", "a", 0.5), ("b", "c", 0.5)], "fine": [("a", "b", 0.5)]})
    rows = N.exact(e).collect()
    assert all((r["p"] is None) == (r["g"] == "cycle") for r in rows) and len(rows) == 5
    cut = spark.createDataFrame([("cycle", "a", 0.9)], "g string, node string, value double")
    assert all(r["p"] is not None for r in N.exact(e, do=cut).collect())
    moved = {(r["g"], r["node"]): r["p"] for r in N.propagate(e).collect()}
    assert {k for k, p in moved.items() if p is None} == {("cycle", x) for x in "abc"} and len(moved) == 5
    assert N.exact(e.limit(0)).count() == N.given_parents(e.limit(0)).count() == N.propagate(e.limit(0)).count() == 0


def test_propagation_level_by_level(spark, graphs):
    deep = {"deep": [(f"n{i:02}", f"n{j:02}", 0.9 - 0.3 * i) for i in range(7) for j in range(i + 1, 7)]}
    every = graphs | deep
    do = {g: sorted(t for _, t, _ in es)[-1] for g, es in every.items()} | {"deep": "n03"}
    fixed = spark.createDataFrame([(g, n, 0.9) for g, n in do.items()] + [("deep", "no such node", 1.0)], "g string, node string, value double")
    for targets in (None, fixed):
        got = {(r["g"], r["node"]): r["p"] for r in N.propagate(frame(spark, every), prior=0.4, do=targets).collect()}
        for g, es in every.items():
            p = {do[g]: 0.9} if targets is not None else {}
            nodes = sorted({x for s, t, _ in es for x in (s, t)})
            for n in nodes:  # sources come first by name, but for the graph of one child
                listed = [(s, m) for s, t, m in es if t == n]
                if n not in p and n != "child":
                    p[n] = chance("fold", listed, p) if listed else 0.4
            if "child" in nodes and "child" not in p:
                p["child"] = chance("fold", [(s, m) for s, _, m in es], p)
            assert all(same(got[g, n], p[n]) for n in nodes) and len(nodes) == sum(k[0] == g for k in got)


def test_propagation_never_groups_by_graph(spark, graphs):
    calls = []
    step = lambda parents: (calls.append(parents), N.fold_step(parents))[1]
    assert N.propagate(frame(spark, graphs), step).where(F.col("p").isNull()).count() == 0
    # one round for each level of the deepest graph, and no more
    depth = {}
    for g, es in graphs.items():
        level = {}
        for s, t, _ in sorted(es, key=lambda e: e[1] if e[1] != "child" else "z"):
            level[t] = max(level.get(t, 0), level.get(s, 0) + 1)
        depth[g] = max(level.values())
    assert len(calls) == max(depth.values())


def test_hard_evidence_takes_one_pass(monkeypatch):
    passes = []
    whole = N.clique_beliefs
    monkeypatch.setattr(N, "clique_beliefs", lambda factors: passes.append(1) or whole(factors))
    parents = {2: [(1, 0.5, 1.0)], 3: [(1, -0.4, 1.0), (2, 0.7, 1.0)], 4: [(3, 0.9, 1.0)]}
    seen = N.infer([1, 2, 3, 4], parents, N.RULES["mean"], 0.1, {}, {4: 1.0, 2: 0.0})
    assert len(passes) == 1
    # the same by passes in turn, the way of soft evidence
    turn = N.infer([1, 2, 3, 4], parents, N.RULES["mean"], 0.1, {}, {4: 1.0 - 1e-15, 2: 0.0})
    assert all(abs(N.joint(seen, (n,))[1] - N.joint(turn, (n,))[1]) < 1e-12 for n in (1, 2, 3, 4))
    assert N.infer([1, 2], {2: [(1, 0.5, 1.0)]}, N.RULES["mean"], 0.0, {}, {1: 1.0}) is None


def test_graphs_of_one_structure_share_an_order():
    N._min_fill.cache_clear()
    assert N.min_fill([(5, 9), (9, 2)]) == [(2, (9,)), (5, (9,)), (9, ())] and N.min_fill([("a", "z"), ("z", "k")])[0] == ("a", ("z",))
    N.min_fill([(50, 90), (90, 20)])
    assert N._min_fill.cache_info().hits == 2


def test_beta_net_is_dealt_by_number(spark):
    import numpy as np

    from loomgraph.operators import inference

    edges = spark.createDataFrame([(1, 0, 2, 1, 0.5, 0.5), (1, 1, 2, 2, -0.5, 0.5)], "g int, src int, dst int, ord int, modifier double, confidence double")
    made = inference.beta_net(edges, 50)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    rng = np.random.default_rng([0, 1])
    roots = [rng.beta(2, 2, 50) for _ in range(2)]
    a = np.clip(0.2 + 0.5 * np.mean(roots, axis=0), 1e-3, 1 - 1e-3)
    assert [r["mean"] for r in made.orderBy("node").collect()] == [float(x.mean()) for x in (*roots, rng.beta(a, 1 - a))]


def test_small_graphs_are_taken_together_and_read_once(spark, monkeypatch):
    rnd, calls, fold = random.Random(7), spark.sparkContext.accumulator(0), N.RULES["fold"]
    graphs = {f"g{k:03}": dag(rnd, rnd.randint(2, 5), rnd.randint(1, 6)) for k in range(300)}
    monkeypatch.setitem(N.RULES, "fold", lambda m, v: (calls.add(1), fold(m, v))[1])
    targets = spark.createDataFrame([(g, min(t for _, t, _ in es), 0.9) for g, es in graphs.items()], "g string, node string, value double")
    found = N.do_against_see(frame(spark, graphs), targets, "fold")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.where("seen IS NOT NULL").count() == sum(len({x for s, t, _ in es for x in (s, t)}) for es in graphs.values())
    # a call takes many graphs' nodes; one by one there are over 900
    assert 0 < calls.value < 300


@pytest.mark.parametrize("rule", ["mean", "fold"])
def test_graphs_taken_together_equal_each_by_itself(spark, rule):
    """Cycles, loops, repeated edges, interventions and soft, hard and impossible evidence of several nodes, on both sides of the limit."""
    rnd = random.Random(11)
    graphs = {f"g{k:02}": dag(rnd, rnd.randint(2, 9), rnd.randint(1, 12)) for k in range(60)}
    for k in range(0, 60, 7):
        s, t, m = graphs[f"g{k:02}"][0]
        graphs[f"g{k:02}"].append((t, s if k % 2 else t, m))
    graphs["large"] = [(f"n{i:02}", f"n{i + 1:02}", 0.3) for i in range(N.STATES_OF)]
    pick = lambda values: {g: {n: rnd.choice(values) for n in {rnd.choice(es)[rnd.randrange(2)] for _ in range(3)} if rnd.random() < 0.6} for g, es in graphs.items()}
    done, seen = pick([0.0, 0.8, 1.0]), pick([0.0, 0.2, 0.7, 1.0])
    df = lambda of: spark.createDataFrame([(g, n, v) for g, listed in of.items() for n, v in listed.items()], "g string, node string, value double")
    e, nulls = frame(spark, graphs), 0
    got = {(r["g"], r["node"]): r["p"] for r in N.exact(e, rule, 0.0, do=df(done), seen=df(seen)).collect()}
    given = {(r["g"], r["node"], r["parent"]): r for r in N.given_parents(e, rule, 0.0, do=df(done), seen=df(seen)).collect()}
    for g, es in graphs.items():
        nodes, parents = sorted({x for s, t, _ in es for x in (s, t)}), {}
        for s, t, m in es:
            parents.setdefault(t, []).append((s, m, abs(m)))
        beliefs = N.infer(nodes, parents, N.RULES[rule], 0.0, done[g], seen[g])
        nulls += beliefs is None
        for n in nodes:
            above = [] if n in done[g] else sorted({s for s, *_ in parents.get(n, ())})
            p = None if beliefs is None else float(N.joint(beliefs, (n,))[1])
            assert same(got.pop((g, n)), p)
            for parent in above or [None]:
                r = given.pop((g, n, parent))
                assert same(r["p"], p) and same(r["std"] and r["std"] ** 2, None if p is None else p * (1 - p))
                if p is None or parent is None:
                    assert r["p_given_0"] is None and r["p_given_1"] is None
                elif parent != n:
                    both = N.joint(beliefs, (parent, n))
                    for name, pair in zip(("p_given_0", "p_given_1"), both, strict=True):
                        # a value that can't be may be left with what rounding makes of it
                        assert pair.sum() < 1e-12 or same(r[name], float(pair[1] / pair.sum()))
    assert not got and not given and 0 < nulls < 61
