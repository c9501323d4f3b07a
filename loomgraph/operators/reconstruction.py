"""Graphs grown from a library of motifs around a seed.

The library is a list of motifs (grp, labels, edges as index pairs, demographic); it is sent to all tasks, so its size is checked
against ``MAX_LIBRARY``. Seeds are independent and grow in their own task. Scores of single candidates are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import label_words

MAX_LIBRARY = 20_000
SIMILAR, MERGE, LEAST_SCORE = 0.4, 0.8, 0.3
FIRST_MOTIFS, TRIED, MAX_NODES = 3, 2, 15
#: Demographics that say nothing, and those that stand next to each other.
NO_DEMOGRAPHIC = ("unknown", "other", "", " ", "none")
NEXT_TO = {"young": ("middle_aged",), "middle_aged": ("young", "elderly"), "elderly": ("middle_aged",), "urban": ("suburban",), "suburban": ("urban", "rural"), "rural": ("suburban",)}


def demographic_similarity(own: Column, target: Column) -> Column:
    """1 for the same, .6 for neighbours, .2 for others, 0 where either says nothing."""
    known = lambda c: c.isNotNull() & ~c.isin(list(NO_DEMOGRAPHIC))
    near = F.lit(False)
    for a, others in NEXT_TO.items():
        near |= (own == a) & target.isin(list(others))
    return F.when(~(known(own) & known(target)), 0.0).when(own == target, 1.0).when(near, 0.6).otherwise(0.2)


def demographic_scores(motifs: DataFrame, target: str | None) -> DataFrame:
    """(demographic, score) of .3 rarity and .7 similarity to the target, which is .5 without one."""
    n = motifs.groupBy("demographic").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    similar = demographic_similarity(F.col("demographic"), F.lit(target)) if target else F.lit(0.5)
    return n.select("demographic", (0.3 * (1 - F.col("n") / total) + 0.7 * similar).alias("score"))


def feature_overlap(own: Column, target: Column) -> Column:
    """Shared entries of two arrays by those of the target."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(own, target)), F.size(target)), F.lit(0.0))


def candidates(frontier: DataFrame, motif_nodes: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """frontier(node, label, in_degree, out_degree) and motif_nodes(motif, at, label, in_degree, out_degree, n_edges, n_nodes, n_new) ->
    their pairs over the threshold, with similarity, and the scores forward and reverse.

    Only labels that share a word meet.
    """
    words = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns), F.array_distinct(label_words(F.col("label"))).alias(f"{p}_ws")).withColumn("w", F.explode(f"{p}_ws"))
    met = words(frontier, "f").join(words(motif_nodes, "m"), "w").drop("w").distinct()
    similarity = F.size(F.array_intersect("f_ws", "m_ws")) / F.size(F.array_union("f_ws", "m_ws"))
    pairs = met.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    more = lambda d: F.greatest(F.lit(0), F.col(f"m_{d}") - F.col(f"f_{d}"))
    extend = F.coalesce(F.try_divide(more("in_degree") + more("out_degree"), F.col("m_n_edges")), F.lit(0.0))
    fit = F.coalesce(F.try_divide(more("in_degree"), F.col("m_n_edges")), F.lit(0.0))
    cover = F.coalesce(F.try_divide(F.col("m_n_new"), F.col("m_n_nodes")), F.lit(0.0))
    scored = pairs.withColumns({"forward": 0.6 * F.col("similarity") + 0.4 * extend, "reverse": 0.4 * F.col("similarity") + 0.3 * fit + 0.3 * cover, "fit": fit, "cover": cover})
    return scored.select(F.col("f_node").alias("node"), F.col("m_motif").alias("motif"), F.col("m_at").alias("at"), "similarity", "fit", "cover", "forward", "reverse")


def diverse_score(scored: DataFrame, weight: float, grp: str = "grp", demographic: str = "demographic", demo_score: str = "demo_score") -> DataFrame:
    """candidates with score: (1 - weight) of .4 similarity, .2 fit, .2 cover and .2 for the first of its group, weight of .8 demographic
    and .2 for the first of its demographic; first in the order of similarity, group and motif."""
    order = [F.desc("similarity"), F.col(grp), F.col("motif"), F.col("at")]
    new = lambda c: F.when(F.row_number().over(W.partitionBy("node", c).orderBy(*order)) == 1, 1.0).otherwise(0.0)
    own = 0.4 * F.col("similarity") + 0.2 * F.col("fit") + 0.2 * F.col("cover") + 0.2 * new(grp)
    demo = 0.8 * F.col(demo_score) + 0.2 * new(demographic)
    return scored.withColumn("score", (1 - weight) * own + weight * demo)


def diverse_top(scored: DataFrame, k: int = 5, grp: str = "grp") -> DataFrame:
    """Each node's k best, no two of a group."""
    best = F.row_number().over(W.partitionBy("node", grp).orderBy(F.desc("score"), "motif", "at"))
    one = scored.withColumn("__b", best).where("__b = 1").drop("__b")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), grp))).where(F.col("rank") <= k)


def _set(label: str) -> frozenset:
    import re

    return frozenset(re.sub("[^a-z0-9]", " ", label.lower()).split())


def _similar(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


class _Graph:
    """Labels by number and edges; node 0 is the seed."""

    def __init__(self, label: str) -> None:
        self.labels, self.sets, self.edges = [label], [_set(label)], set()

    def add(self, label: str) -> int:
        self.labels.append(label)
        self.sets.append(_set(label))
        return len(self.labels) - 1

    def reaches(self, a: int, b: int) -> bool:
        seen, open_ = {a}, [a]
        while open_:
            x = open_.pop()
            if x == b:
                return True
            new = {t for s, t in self.edges if s == x} - seen
            seen |= new
            open_ += new
        return False

    def link(self, a: int, b: int) -> None:
        if a != b and not self.reaches(b, a):
            self.edges.add((a, b))

    def in_degree(self, x: int) -> int:
        return sum(t == x for _, t in self.edges)


def _ranked(g: _Graph, node: int, motifs: list, holders: dict) -> list:
    """(score, motif, at), the best first, of motifs that have a node like this one."""
    found = []
    have = set(g.labels)
    for m, at in sorted({x for w in g.sets[node] for x in holders.get(w, ())}):
        _, labels, edges, sets = motifs[m]
        sim = _similar(g.sets[node], sets[at])
        if sim < SIMILAR or ("stance" in labels[at] and any(s == at for s, _ in edges)):
            continue
        fit = max(0, sum(t == at for _, t in edges) - g.in_degree(node)) / max(1, len(edges))
        cover = sum(x not in have for x in labels) / len(labels)
        found.append((-(0.4 * sim + 0.3 * fit + 0.3 * cover), m, at))
    return [(-s, m, at) for s, m, at in sorted(found)]


def _integrate(g: _Graph, node: int, motif: tuple, at: int) -> None:
    _, labels, edges, sets = motif
    place = {at: node}
    for i, s in enumerate(sets):
        if i != at:
            best = max(((_similar(s, o), -n) for n, o in enumerate(g.sets)), default=(0.0, 0))
            place[i] = -best[1] if best[0] >= MERGE else g.add(labels[i])
    for a, b in edges:
        g.link(place[a], place[b])


def grow(label: str, motifs: list, holders: dict, rounds: int = 100) -> _Graph:
    """First the three best motifs at the seed; then, while there are fewer than fifteen nodes, the best of two tried at each node without edges into it."""
    g = _Graph(label)
    for _, m, at in _ranked(g, 0, motifs, holders)[:FIRST_MOTIFS]:
        _integrate(g, 0, motifs[m], at)
    frontier = list(range(1, len(g.labels)))
    while frontier and rounds and len(g.labels) < MAX_NODES:
        rounds -= 1
        before = len(g.labels)
        for node in frontier:
            for score, m, at in _ranked(g, node, motifs, holders)[:TRIED]:
                if score >= LEAST_SCORE and len(g.labels) + sum(x not in g.labels for x in motifs[m][1]) <= MAX_NODES:
                    _integrate(g, node, motifs[m], at)
                    break
        frontier = [n for n in range(before, len(g.labels)) if not g.in_degree(n)]
    # all stance nodes become the seed, which nothing leaves and everything reaches
    stance = {n for n, x in enumerate(g.labels) if n and "stance" in x and "stance" in label}
    g.edges = {(a, b) for s, t in g.edges for a, b in [(0 if s in stance else s, 0 if t in stance else t)] if a != b and a != 0}
    for n in range(1, len(g.labels)):
        if n not in stance and not g.reaches(n, 0):
            g.edges.add((n, 0))
    return g


def reconstruct(seeds: DataFrame, library: DataFrame, seed: str = "seed", label: str = "label") -> DataFrame:
    """seeds(seed, label), library(grp, labels array, edges array of struct(s, t)) -> (seed, src, dst) of labels in lower case with underscores."""
    n = library.limit(MAX_LIBRARY + 1).count()
    if n > MAX_LIBRARY:
        raise ValueError(f"the library has over {MAX_LIBRARY} motifs; choose groups or leaders of it")
    motifs = sorted((r["grp"], list(r["labels"]), sorted((e["s"], e["t"]) for e in r["edges"])) for r in library.collect())
    shared = seeds.sparkSession.sparkContext.broadcast(motifs)
    kind = dict(seeds.dtypes)[seed]

    def run(batches):
        import pyarrow as pa

        known = [(k, ls, es, [_set(x) for x in ls]) for k, ls, es in shared.value]
        holders: dict = {}
        for m, (*_, sets) in enumerate(known):
            for at, s in enumerate(sets):
                for w in s:
                    holders.setdefault(w, []).append((m, at))
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = grow(x, known, holders)
                name = [y.replace(" ", "_").lower() for y in g.labels]
                rows += sorted({(i, name[s], name[t]) for s, t in g.edges})
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["seed", "src", "dst"])

    return seeds.select(seed, label).mapInArrow(run, f"seed {kind}, src string, dst string")
