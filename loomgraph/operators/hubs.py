"""Counts and first instances of induced motifs in graphs with hubs: nothing is made that is only counted.

A centre with d leaves has C(d, k) sets of k leaves, of which a star's are those without an edge among them. With H the edges among
a centre's leaves, inclusion and exclusion gives their number from d and from how often small shapes stand in H:

* 2 leaves: C(d,2) - edges
* 3 leaves: C(d,3) - edges (d-2) + paths of 2 - triangles
* 4 leaves: C(d,4) - edges C(d-2,2) + (paths of 2 - triangles) (d-3) + pairs of apart edges - paths of 3 - claws + squares + paws - diamonds + K4

H comes from joining every adjacent pair to the centres of that end which has fewer, and the shapes of H from edges directed from the
node of smaller degree to that of larger, so a hub costs as much as there are edges among its leaves and not the square of its degree.
Chains are in-edges times out-edges less the closed ones, which are found likewise.

Extraction keeps the first ``cap`` instances of a type: the counts tell which centres these fall to, and only there sets of leaves are
made, in their order, until there are enough. A task then holds one centre's leaves and the edges among them.

All of this is for graphs of more than ``small.LOCAL_EDGES`` edges; the others are counted a graph at a time (``small``), so that many
small graphs cost one shuffle of their edges.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .motifs import CAP, TYPES, adjacency, simple_edges
from .small import per_small_graph, split

_SHAPES = ("ends", "paths2", "claws", "paths3", "triangles", "paws", "diamonds", "squares", "k4")


KEY = ["family", "g", "center"]


def both_stars(edges: DataFrame) -> DataFrame:
    """(family, g, center, leaf): each edge as a fork's, M2, and as a collider's, M3."""
    side = lambda family, center, leaf: F.struct(F.lit(family).alias("family"), F.col(center).alias("center"), F.col(leaf).alias("leaf"))
    return edges.select("g", F.inline(F.array(side("M2", "src", "dst"), side("M3", "dst", "src")))).select(*KEY, "leaf")


def leaf_pairs(stars: DataFrame, near: DataFrame) -> DataFrame:
    """(family, g, center, u, v) with u < v: adjacent leaves of a centre, of stars(family, g, center, leaf) and near(g, a, b)."""
    centres = stars.groupBy("family", "g", "leaf").agg(F.count("*").alias("n"))
    of = lambda end: centres.select("family", "g", F.col("leaf").alias(end), F.col("n").alias(f"n{end}"))
    few = F.col("na") <= F.col("nb")
    ends = near.join(of("a"), ["g", "a"]).join(of("b"), ["family", "g", "b"])
    pairs = ends.select("family", "g", F.when(few, F.col("a")).otherwise(F.col("b")).alias("leaf"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("other"))
    met = pairs.join(stars, ["family", "g", "leaf"]).join(stars.withColumnRenamed("leaf", "other"), [*KEY, "other"], "left_semi")
    return met.select(*KEY, F.least("leaf", "other").alias("u"), F.greatest("leaf", "other").alias("v"))


def _choose(n: Column, k: int) -> Column:
    out = n
    for i in range(1, k):
        out = out * (n - i)
    return (out / functools.reduce(int.__mul__, range(1, k + 1))).cast("decimal(38,0)")


def shapes(pairs: DataFrame) -> DataFrame:
    """(*KEY, _SHAPES): rows whose sums by centre say how often each shape stands among its leaves; ends is twice the edges."""
    key = KEY
    degree = materialize(pairs.select(*key, F.explode(F.array("u", "v")).alias("x")).groupBy(*key, "x").agg(F.count("*").alias("n")), "leaf-degrees")
    of = lambda end: degree.select(*key, F.col("x").alias(end), F.col("n").alias(f"n{end}"))
    sided = pairs.join(of("u"), [*key, "u"]).join(of("v"), [*key, "v"])
    ahead = F.struct("nu", "u") < F.struct("nv", "v")
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    # from the node of smaller degree, x, to the other, y
    arcs = materialize(sided.select(*key, pick("u", "v").alias("x"), pick("v", "u").alias("y"), pick("nu", "nv").alias("nx"), pick("nv", "nu").alias("ny")), "leaf-arcs")
    second = arcs.select(*key, "x", F.col("y").alias("z"), F.col("ny").alias("nz"))
    closing = arcs.select(*key, F.col("x").alias("y"), F.col("y").alias("z"))
    triangles = materialize(arcs.join(second, [*key, "x"]).where(F.struct("ny", "y") < F.struct("nz", "z")).join(closing, [*key, "y", "z"], "left_semi").select(*key, "x", "y", "z", "nx", "ny", "nz"), "leaf-triangles")
    sides = triangles.select(*key, F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("z").alias("b")), F.struct(F.col("y").alias("a"), F.col("z").alias("b")))).alias("s"))
    on_side = sides.groupBy(*key, "s").agg(F.count("*").alias("n"))
    fourth = triangles.select(*key, "x", "y", F.col("z").alias("w"), F.col("nz").alias("nw"))
    k4 = triangles.join(fourth, [*key, "x", "y"]).where(F.struct("nz", "z") < F.struct("nw", "w")).join(arcs.select(*key, F.col("x").alias("z"), F.col("y").alias("w")), [*key, "z", "w"], "left_semi")
    # squares by their topmost node y: both ways from there to the opposite one, w
    around = arcs.select(*key, "x", F.col("y").alias("w"), F.col("ny").alias("nw")).union(arcs.select(*key, F.col("y").alias("x"), F.col("x").alias("w"), F.col("nx").alias("nw")))
    ways = arcs.join(around, [*key, "x"]).where(F.struct("nw", "w") < F.struct("ny", "y")).groupBy(*key, "y", "w").agg(F.count("*").alias("n"))
    two = F.expr("n * (n - 1) div 2")
    total = lambda df, **terms: df.select(*key, *(v.cast("bigint").alias(k) for k, v in terms.items()))
    parts = [
        total(degree, ends=F.col("n"), paths2=two, claws=F.expr("n * (n - 1) * (n - 2) div 6")),
        total(arcs, paths3=(F.col("nx") - 1) * (F.col("ny") - 1)),
        total(triangles, triangles=F.lit(1), paws=F.col("nx") + F.col("ny") + F.col("nz") - 6),
        total(on_side, diamonds=two),
        total(ways, squares=two),
        total(k4, k4=F.lit(1)),
    ]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def star_counts(stars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(family, g, center, n2, n3, n4): induced stars of each centre by their leaves."""
    terms = stars.select(*KEY, F.lit(1).cast("bigint").alias("d")).unionByName(shapes(pairs), allowMissingColumns=True)
    summed = terms.groupBy(*KEY).agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in ("d", *_SHAPES)))
    c = {s: F.col(s).cast("decimal(38,0)") for s in _SHAPES}
    edges = (c["ends"] / 2).cast("decimal(38,0)")
    paths3 = c["paths3"] - 3 * c["triangles"]
    apart = _choose(edges, 2) - c["paths2"]
    leaves = F.col("d").cast("decimal(20,0)")
    n2 = _choose(leaves, 2) - edges
    n3 = _choose(leaves, 3) - edges * (leaves - 2) + c["paths2"] - c["triangles"]
    n4 = _choose(leaves, 4) - edges * _choose(leaves - 2, 2) + (c["paths2"] - c["triangles"]) * (leaves - 3) + apart - paths3 - c["claws"] + c["squares"] + c["paws"] - c["diamonds"] + c["k4"]
    return summed.select(*KEY, *(n.cast("bigint").alias(name) for name, n in (("n2", n2), ("n3", n3), ("n4", n4))))


def closed_chains(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(g, first, center, last) of chains whose ends are adjacent, of simple edges(g, src, dst)."""
    both = near.select("g", F.col("a").alias("first"), F.col("b").alias("last")).union(near.select("g", F.col("b").alias("first"), F.col("a").alias("last")))
    out = edges.groupBy("g", F.col("src").alias("first")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy("g", F.col("dst").alias("last")).agg(F.count("*").alias("n_in"))
    ends = both.join(out, ["g", "first"]).join(into, ["g", "last"])
    heads = edges.select("g", F.col("src").alias("first"), F.col("dst").alias("center"))
    tails = edges.select("g", F.col("src").alias("center"), F.col("dst").alias("last"))
    # along the end that has fewer edges
    forth = ends.where("n_out <= n_in").join(heads, ["g", "first"]).join(tails, ["g", "center", "last"], "left_semi")
    back = ends.where("n_out > n_in").join(tails, ["g", "last"]).join(heads, ["g", "first", "center"], "left_semi")
    names = ("g", "first", "center", "last")
    return forth.select(*names).union(back.select(*names))


def _held(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return materialize(simple_edges(edges), "simple-edges"), materialize(adjacency(edges), "adjacency")


_NAMES = [t.lower().replace(".", "") for t in TYPES]


def _joined_numbers(edges: DataFrame) -> list[DataFrame]:
    """Rows (g, center, some of m1, m21, m22, m23, m31, m32, m33) whose sums are the counts."""
    e, near = _held(edges)
    out = e.groupBy("g", F.col("src").alias("center")).agg(F.count("*").alias("o"))
    into = e.groupBy("g", F.col("dst").alias("center")).agg(F.count("*").alias("i"))
    paths = into.join(out, ["g", "center"]).select("g", "center", (F.col("i") * F.col("o")).alias("m1"))
    closed = closed_chains(e, near).groupBy("g", "center").agg((-F.count("*")).alias("m1"))
    stars = both_stars(e)
    counted = star_counts(stars, materialize(leaf_pairs(stars, near), "leaf-pairs"))
    of = lambda f, k: F.when(F.col("family") == f"M{f}", F.col(f"n{k}")).alias(f"m{f}{k - 1}")
    return [paths, closed, counted.select("g", "center", *(of(f, k) for f in (2, 3) for k in (2, 3, 4)))]


def _summed(parts: list[DataFrame], *key: str) -> DataFrame:
    joined = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return joined.groupBy(*key).agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in _NAMES))


_LONGS = ", ".join(f"{n} bigint" for n in _NAMES)


def census(edges: DataFrame) -> DataFrame:
    """(g, m1, m21, m22, m23, m31, m32, m33) for every graph with an edge."""

    def run(graph):
        yield [sum(n) for n in zip([0] * len(_NAMES), *(found for _, found in graph.numbers()))]

    few, many = split(edges)
    counted = per_small_graph(few, run, _LONGS)
    return counted if many is None else counted.union(_summed([many.select("g").distinct(), *(p.drop("center") for p in _joined_numbers(many))], "g"))


def numbers_by_centre(edges: DataFrame) -> DataFrame:
    """(g, motif, center, n): how many instances of each type have the centre, where there are any."""

    def run(graph):
        for node, found in graph.numbers():
            yield node, *found

    few, many = split(edges)
    counted = per_small_graph(few, run, f"center {dict(edges.dtypes)['src']}, {_LONGS}")
    if many is not None:
        counted = counted.union(_summed(_joined_numbers(many), "g", "center"))
    listed = F.array(*(F.struct(F.lit(t).alias("motif"), F.col(n).alias("n")) for t, n in zip(TYPES, _NAMES, strict=True)))
    return counted.select("g", "center", F.inline(listed)).where("n > 0").select("g", "motif", "center", "n")


# Extraction


def independent_sets(leaves: list, pairs: list, k: int, most: int):
    """The first ``most`` sets of k leaves, in order, without one of the pairs among them."""
    near: dict = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    # (leaves chosen, leaves that none of them is adjacent to, place of the next one to try)
    stack: list = [([], set(), 0)]
    while stack and most > 0:
        chosen, barred, at = stack.pop()
        while at < len(leaves) and leaves[at] in barred:
            at += 1
        if len(leaves) - at < k - len(chosen):
            continue
        stack.append((chosen, barred, at + 1))
        grown = [*chosen, leaves[at]]
        if len(grown) == k:
            most -= 1
            yield grown
        else:
            stack.append((grown, barred | near.get(leaves[at], set()), at + 1))


def _first_of(rows: DataFrame, n: str, order: list[str], cap: int) -> DataFrame:
    """Of each (g, motif) the rows that its first ``cap`` instances fall to; before and want say which of theirs they are."""
    of_type = W.partitionBy("g", "motif").orderBy(*order)
    first = rows.withColumn("__k", F.row_number().over(of_type)).where(F.col("__k") <= cap)
    before = F.coalesce(F.sum(F.least(F.col(n), F.lit(cap))).over(of_type.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("before", before).where(F.col("before") < cap).withColumn("want", F.least(F.col(n), F.lit(cap) - F.col("before"))).drop("__k")


def _first_stars(edges: DataFrame, near: DataFrame, cap: int, each: int) -> DataFrame:
    stars = both_stars(edges)
    pairs = materialize(leaf_pairs(stars, near), "leaf-pairs")
    counted = star_counts(stars, pairs)
    leaves = F.when(F.col("n4") > 0, 4).when(F.col("n3") > 0, 3).when(F.col("n2") > 0, 2)
    n = F.when(F.col("n4") > 0, F.col("n4")).when(F.col("n3") > 0, F.col("n3")).otherwise(F.col("n2"))
    typed = counted.select(*KEY, leaves.alias("leaves"), F.least(n, F.lit(each)).alias("n")).where("leaves IS NOT NULL").withColumn("motif", F.concat("family", F.lit("."), (F.col("leaves") - 1).cast("string")))
    key = KEY
    kept = materialize(_first_of(typed, "n", ["center"], cap), "star-centres")
    chosen = kept.select(*key)
    listed = stars.join(chosen, key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.col("leaf").cast("bigint"))).alias("ls"))
    barred = pairs.join(chosen, key, "left_semi").groupBy(*key).agg(F.collect_list(F.struct(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))).alias("ps")).select(*key, F.col("ps.u").alias("us"), F.col("ps.v").alias("vs"))
    whole = kept.join(listed, key).join(barred, key, "left").select("g", "motif", F.col("center").cast("bigint").alias("center"), "leaves", "before", "want", "ls", "us", "vs")
    kind = dict(stars.dtypes)["g"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made: dict[str, list] = {c: [] for c in ("g", "motif", "center", "nodes", "rank")}
            columns = [batch.column(c).to_pylist() for c in ("g", "motif", "center", "leaves", "before", "want", "ls", "us", "vs")]
            for g, motif, center, k, before, want, leaves, us, vs in zip(*columns, strict=True):
                for n, found in enumerate(independent_sets(leaves, list(zip(us or [], vs or [], strict=True)), k, want)):
                    for c, value in zip(made, (g, motif, center, [center, *found], before + n + 1), strict=True):
                        made[c].append(value)
            kinds = {"g": batch.schema.field("g").type, "motif": pa.string(), "center": pa.int64(), "nodes": pa.list_(pa.int64()), "rank": pa.int64()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in made.items()})

    return whole.mapInArrow(run, f"g {kind}, motif string, center bigint, nodes array<bigint>, rank bigint")


def _first_chains(edges: DataFrame, near: DataFrame, cap: int) -> DataFrame:
    heads = edges.select("g", F.col("src").alias("first"), F.col("dst").alias("center"))
    tails = edges.select("g", F.col("src").alias("center"), F.col("dst").alias("last"))
    closed = closed_chains(edges, near).groupBy("g", "first", "center").agg(F.count("*").alias("closed"))
    counted = heads.join(tails.groupBy("g", "center").agg(F.count("*").alias("o")), ["g", "center"]).join(closed, ["g", "first", "center"], "left")
    open_ = counted.withColumn("n", F.col("o") - F.coalesce("closed", F.lit(0))).where("n > 0").withColumn("motif", F.lit("M1"))
    kept = _first_of(open_, "n", ["first", "center"], cap).select("g", "motif", "first", "center")
    made = kept.join(tails, ["g", "center"]).withColumns({"a": F.least("first", "last"), "b": F.greatest("first", "last")}).join(near, ["g", "a", "b"], "left_anti")
    nodes = F.array(*(F.col(c).cast("bigint") for c in ("first", "center", "last")))
    ranked = made.select("g", "motif", F.col("center").cast("bigint").alias("center"), nodes.alias("nodes")).withColumn("rank", F.row_number().over(W.partitionBy("g", "motif").orderBy("nodes")).cast("bigint"))
    return ranked.where(F.col("rank") <= cap)


def _extracted(edges: DataFrame, cap: int, each: int) -> DataFrame:
    few, many = split(edges)
    found = per_small_graph(few, lambda graph: graph.first(cap, each), "motif string, center bigint, nodes array<bigint>, rank bigint")
    if many is None:
        return found
    e, near = _held(many)
    return found.union(_first_chains(e, near, cap)).union(_first_stars(e, near, cap, each))


def extract(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """(g, motif, center, nodes, rank): as ``motifs.extract`` of all instances, without making them. Nodes must be of an integer type."""
    return _extracted(edges, cap, cap)


def extract_by_suppression(edges: DataFrame, cap: int = CAP) -> DataFrame:
    """(g, motif, center, nodes, rank): as ``motifs.extract_by_suppression`` of all instances, without making them."""
    largest = F.concat(F.substring("motif", 1, 2), F.lit(".3"))
    return _extracted(edges, cap, 1).withColumn("motif", F.when(F.col("motif") == "M1", "M1").otherwise(largest))
