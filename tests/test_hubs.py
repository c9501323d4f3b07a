"""Counts by inclusion and exclusion, and first instances, against brute force and closed forms; centres with very many leaves."""

import itertools
import math
import random

from pyspark.sql import functions as F

from loomgraph.operators import hubs as H
from loomgraph.operators import motifs as M

SCHEMA = "g int, src int, dst int"


def frame(spark, graphs):
    return spark.createDataFrame([(g, s, t) for g, es in graphs.items() for s, t in es], SCHEMA).repartition(3)


def star_with(rnd, leaves, p, reverse):
    """A centre, its leaves, and edges among the leaves."""
    es = [(100, x) for x in range(leaves)] + [(a, b) for a, b in itertools.combinations(range(leaves), 2) if rnd.random() < p]
    return [(t, s) for s, t in es] if reverse else es


def independent(leaves, pairs, k):
    barred = {frozenset(p) for p in pairs}
    return [list(c) for c in itertools.combinations(leaves, k) if not any(frozenset(q) in barred for q in itertools.combinations(c, 2))]


def test_star_counts_of_sparse_to_dense_leaves(spark):
    rnd = random.Random(1)
    graphs = {g: star_with(rnd, rnd.randint(1, 11), p, g % 2) for g, p in enumerate([0, 0.1, 0.3, 0.5, 0.6, 0.8, 0.9, 1.0] * 4)}
    for reverse in (False, True):
        part = {g: es for g, es in graphs.items() if bool(g % 2) == reverse}
        edges = frame(spark, part)
        stars = H.both_stars(M.simple_edges(edges)).where(F.col("family") == ("M3" if reverse else "M2"))
        got = {(r["g"], r["center"]): (r["n2"], r["n3"], r["n4"]) for r in H.star_counts(stars, H.leaf_pairs(stars, M.adjacency(edges))).collect()}
        for g, es in part.items():
            es = [(t, s) for s, t in es] if reverse else es
            leaves, pairs = [t for s, t in es if s == 100], [e for e in es if e[0] != 100]
            assert got[g, 100] == tuple(len(independent(leaves, pairs, k)) for k in (2, 3, 4)), g


def test_extraction_equals_the_first_of_all_instances(spark):
    rnd = random.Random(2)
    graphs = {g: [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(1, 3 * n))] for g, n in enumerate([2, 4, 7, 9, 12, 16] * 2)}
    graphs |= {50: star_with(rnd, 12, 0.2, False), 51: star_with(rnd, 12, 0.5, True)}
    edges = frame(spark, graphs)
    every = M.instances(edges)
    for cap in (1, 5, 30):
        rows = lambda df: sorted((r["g"], r["motif"], r["center"], r["nodes"], r["rank"]) for r in df.collect())
        assert rows(H.extract(edges, cap)) == rows(M.extract(every, cap))


def test_sets_in_order():
    rnd = random.Random(3)
    for _ in range(200):
        leaves = sorted(rnd.sample(range(30), rnd.randint(0, 9)))
        pairs = [p for p in itertools.combinations(leaves, 2) if rnd.random() < 0.5]
        for k, most in ((2, 3), (3, 100), (4, 7)):
            assert list(H.independent_sets(leaves, pairs, k, most)) == independent(leaves, pairs, k)[:most]


def test_centres_with_a_hundred_thousand_leaves(spark):
    """A ring among the leaves, so that the closed forms are those of a cycle; nothing grows with the square of the leaves."""
    d = 100_000
    node = F.col("id").cast("int")
    fork = spark.range(d).select(F.lit(1).alias("g"), F.lit(-1).alias("src"), node.alias("dst"))
    collider = spark.range(d).select(F.lit(2).alias("g"), node.alias("src"), F.lit(-1).alias("dst"))
    ring = spark.range(d).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("g"), node.alias("src"), ((F.col("id") + 1) % d).cast("int").alias("dst"))
    edges = fork.union(collider).union(ring)
    # independent sets of k nodes of a cycle
    free = [d * math.comb(d - k, k) // (d - k) for k in (2, 3, 4)]
    got = {r["g"]: r for r in H.census(edges).collect()}
    assert [got[1][m] for m in ("m21", "m22", "m23")] == free and [got[2][m] for m in ("m31", "m32", "m33")] == free
    # a ring node's edges of the same direction are one of the centre's and one of the ring's, whose other ends are adjacent
    assert (got[1]["m31"], got[2]["m21"], got[1]["m1"], got[2]["m1"]) == (0, 0, d, d)
    for r in H.extract(edges).where("motif IN ('M2.3', 'M3.3') AND rank <= 2").collect():
        assert r["nodes"] == [-1, 0, 2, 4, 5 + r["rank"]]


def test_empty_tables(spark):
    none = frame(spark, {1: [(1, 2)]}).limit(0)
    assert H.census(none).count() == 0 and H.extract(none).count() == 0
    loop = H.census(frame(spark, {1: [(1, 1)], 2: [(1, 2), (2, 1)]})).collect()
    assert sorted(tuple(r) for r in loop) == [(1, *[0] * 7), (2, *[0] * 7)]


def mixed(spark):
    """Random graphs with loops and two-way edges; some have more edges than are counted a graph at a time, some a null end."""
    rnd = random.Random(4)
    graphs = {g: [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] for g, (n, m) in enumerate([(2, 3), (5, 9), (9, 20), (14, 40), (25, 60), (30, 140), (40, 150), (25, 200)])}
    graphs |= {50: star_with(rnd, 12, 0.3, False), 51: star_with(rnd, 40, 0.03, True), 60: [(1, None), (None, 1)], None: [(1, 2), (2, 3)]}
    return frame(spark, graphs)


def as_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_small_and_large_graphs_equal_all_instances(spark):
    edges = mixed(spark)
    every = M.instances(edges).persist()
    by_centre = H.numbers_by_centre(edges)
    assert as_rows(by_centre, "g", "motif", "center", "n") == as_rows(every.groupBy("g", "motif", "center").agg(F.count("*").alias("n")), "g", "motif", "center", "n")
    counts = {(r["g"], r["motif"]): r["n"] for r in every.groupBy("g", "motif").agg(F.count("*").alias("n")).collect()}
    census = {r["g"]: r for r in H.census(edges).collect()}
    assert set(census) == {r["g"] for r in edges.select("g").distinct().collect()}
    assert all(r[t.lower().replace(".", "")] == counts.get((g, t), 0) for g, r in census.items() for t in M.TYPES)
    names = ("g", "motif", "center", "nodes", "rank")
    for cap in (3,):
        assert as_rows(H.extract_by_suppression(edges, cap), *names) == as_rows(M.extract_by_suppression(every, cap), *names)
        assert as_rows(H.extract(edges, cap), *names) == as_rows(M.extract(every, cap), *names)
    every.unpersist()


def test_many_small_graphs_move_their_edges_once(spark):
    """One exchange by graph; the joins moved the edges again for every shape."""
    edges = frame(spark, {g: [(0, 1), (0, 2), (1, 3)] for g in range(20)})
    for made in (H.census(edges), H.numbers_by_centre(edges), H.extract(edges), H.extract_by_suppression(edges)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
