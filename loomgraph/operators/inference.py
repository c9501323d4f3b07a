"""Probabilities on signed graphs: exact marginals by levels, seeded samples, interventions, divergences, contributions.

An intervention cuts a node's parents off and fixes its probability. Each graph is one document and is evaluated by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import bernoulli_kl, clip
from .traversal import per_graph, topological_order

ROOT_PRIOR = 0.5
CONTINUOUS_RANGE = (0.05, 0.95)
BOOLEAN_RANGE = (0.01, 0.99)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def _clip(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def continuous_step(parents: list, p: dict) -> float:
    """One parent: its impact (2p - 1)m, doubled, through the logistic function; several: their mean by strength, tenfold."""
    impacts = [(2 * p[s] - 1) * m for s, m, _ in parents]
    if len(impacts) == 1:
        return _clip(_sigmoid(2 * impacts[0]), *CONTINUOUS_RANGE)
    total = sum(abs(m) for _, m, _ in parents)
    weights = [abs(m) / total if total else 1 / len(parents) for _, m, _ in parents]
    return _clip(_sigmoid(10 * sum(w * x for w, x in zip(weights, impacts, strict=True))), *CONTINUOUS_RANGE)


def cpt(modifier: float) -> tuple[float, float]:
    """Probability of a child when its parent is false, and when it is true."""
    return (1 - modifier, modifier) if modifier > 0 else (abs(modifier), 1 - abs(modifier))


def boolean_step(parents: list, p: dict) -> float:
    """The mean of the parents' tables by strength; linear in each parent, so marginals of parents give the marginal."""
    total = sum(abs(m) for _, m, _ in parents)
    weights = [abs(m) / total if total else 1 / len(parents) for _, m, _ in parents]
    return _clip(sum(w * ((1 - p[s]) * cpt(m)[0] + p[s] * cpt(m)[1]) for w, (s, m, _) in zip(weights, parents, strict=True)), *BOOLEAN_RANGE)


def marginals(edges: DataFrame, step=continuous_step, root_prior: float = ROOT_PRIOR, do: dict | None = None, do_roots: float | None = None) -> DataFrame:
    """(g, node, p). do fixes nodes in every graph; do_roots fixes each graph's first root."""
    fixed = do or {}

    def run(g, nodes, parents):
        p: dict = {}
        first = next((n for n in nodes if n not in parents), None)
        for n in topological_order(nodes, parents):
            known = [x for x in parents.get(n, ()) if x[0] in p]
            if n in fixed:
                p[n] = fixed[n]
            elif do_roots is not None and n == first:
                p[n] = do_roots
            else:
                p[n] = step(known, p) if known else root_prior
            yield g, n, p[n]

    return per_graph(edges, run, "g int, node int, p double")


def samples(edges: DataFrame, n: int = 1000, root_prior: float = 0.1, seed: int = 0) -> DataFrame:
    """(g, node, mean, std): forward samples of the boolean net, seeded by the graph; std is the population's."""

    def run(g, nodes, parents):
        import numpy as np

        rng = np.random.default_rng([seed, abs(int(g))])
        v: dict = {}
        for x in topological_order(nodes, parents):
            known = [(s, m) for s, m, _ in parents.get(x, ()) if s in v]
            if not known:
                p = np.full(n, root_prior)
            else:
                w = np.array([abs(m) for _, m in known])
                w = w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))
                p = np.clip(sum(a * np.where(v[s], cpt(m)[1], cpt(m)[0]) for a, (s, m) in zip(w, known, strict=True)), *BOOLEAN_RANGE)
            v[x] = rng.random(n) < p
            yield g, x, float(v[x].mean()), float(v[x].std())

    return per_graph(edges, run, "g int, node int, mean double, std double")


def beta_net(edges: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """(g, node, mean): roots Beta(2, 2), children Beta(a, 1 - a) with a = .2 + .5 times the mean of their parents, by seeded samples."""

    def run(g, nodes, parents):
        import numpy as np

        rng = np.random.default_rng([seed, abs(int(g))])
        v: dict = {}
        for x in topological_order(nodes, parents):
            known = [v[s] for s, *_ in parents.get(x, ()) if s in v]
            if known:
                # samples lie within 0 and 1, so a needs no bounds
                a = sum(known[1:], known[0]) / len(known)
                a *= 0.5
                a += 0.2
                v[x] = rng.beta(a, 1 - a)
            else:
                v[x] = rng.beta(2, 2, n)
            yield g, x, float(np.add.reduce(v[x]) / n)

    # draws take long for the bytes of a graph, so the graphs' partitions are not to be joined by their size
    dealt = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g")
    return per_graph(dealt, run, "g int, node int, mean double")


def changes(base: DataFrame, changed: DataFrame) -> DataFrame:
    """(g, node, base, changed, delta); a side that lacks the node counts as 0."""
    both = base.withColumnRenamed("p", "base").join(changed.withColumnRenamed("p", "changed"), ["g", "node"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("g", "node", zero("base").alias("base"), zero("changed").alias("changed"), (zero("changed") - zero("base")).alias("delta"))


def contributions(moved: DataFrame) -> DataFrame:
    """(g, node, contribution, rank): .7 of the change and .3 of the divergence, over the graph's largest; 0 where nothing moved."""
    raw = moved.withColumn("__c", 0.7 * F.abs("delta") + 0.3 * bernoulli_kl(F.col("changed"), F.col("base")))
    top = F.max("__c").over(W.partitionBy("g"))
    scaled = raw.withColumn("contribution", F.coalesce(F.try_divide(F.col("__c"), F.nullif(top, F.lit(0.0))), F.lit(0.0)))
    return scaled.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc(F.round("contribution", 9)), "node"))).drop("__c")


def opinion(mean: Column) -> Column:
    """A probability as a rating, half to even."""
    return F.bround(mean * 10, 0).cast("int")


def reason(contribution: Column) -> Column:
    return F.bround(contribution * 4 + 1, 0).cast("int")


def keyword_interventions(nodes: DataFrame, question: str) -> DataFrame:
    """(g, node, value): nodes all of whose label's words stand in the question; 0 where it speaks of less, else 1.

    The rule stands in for a language model; a provider can give the same rows.
    """
    words = F.lit(question.lower())
    less = any(w in question.lower() for w in ("decrease", "reduce", "less", "without", "remove", "lower"))
    every = F.forall(F.split("label", " "), lambda w: F.contains(words, w))
    return nodes.where(every).select("g", "node", F.lit(0.0 if less else 1.0).alias("value"))


def relation_sentences(labelled: DataFrame) -> DataFrame:
    """(g, ord, sentence): ``a increases b`` or ``a decreases b`` by the modifier's sign."""
    return labelled.select("g", "ord", F.concat_ws(" ", "src_label", F.when(F.col("modifier") > 0, "increases").otherwise("decreases"), "dst_label").alias("sentence"))
