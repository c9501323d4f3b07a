"""Induced motifs: chains (M1), forks of 2, 3 and 4 leaves (M2.1 to M2.3), colliders likewise (M3.1 to M3.3).

Induced means that the nodes of an instance have no other edge among them, in either direction, and no loops. Forks grow leaf by
leaf: with each leaf of a centre stands the array of its later leaves that it has no edge with, so a fork's further leaves are
the intersection of its leaves' arrays. Colliders are forks of the reversed edges. These functions make every instance; ``hubs``
counts them, and finds the first ones, without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialize

TYPES = ("M1", "M2.1", "M2.2", "M2.3", "M3.1", "M3.2", "M3.3")
#: Weights of a graph's complexity.
COMPLEXITY = {"M1": 1, "M2.1": 1, "M2.2": 2, "M2.3": 3, "M3.1": 1, "M3.2": 2, "M3.3": 3}
FAMILIES = {"chain": ("M1",), "fork": ("M2.1", "M2.2", "M2.3"), "collider": ("M3.1", "M3.2", "M3.3")}
#: Families of the means by demographic, by name.
MEAN_FAMILIES = {
    "Chain (M1)": ("M1",),
    "Basic Fork (M2.1)": ("M2.1",),
    "Extended Fork (M2.2+)": ("M2.2", "M2.3"),
    "Basic Collider (M3.1)": ("M3.1",),
    "Extended Collider (M3.2+)": ("M3.2", "M3.3"),
}
#: Instances of a type that extraction keeps of a graph.
CAP = 30


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges that an induced motif can have: none beside its reverse, none at a node with a loop."""
    e = edges.select("g", "src", "dst").distinct()
    loops = e.where("src = dst").select("g", F.col("src").alias("node"))
    two_way = F.count("*").over(W.partitionBy("g", F.least("src", "dst"), F.greatest("src", "dst")))
    e = e.where("src <> dst").withColumn("__n", two_way).where("__n = 1").drop("__n")
    return e.join(loops.withColumnRenamed("node", "src"), ["g", "src"], "left_anti").join(loops.withColumnRenamed("node", "dst"), ["g", "dst"], "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(g, a, b) with a < b where an edge stands in either direction."""
    return edges.where("src <> dst").select("g", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def chains(edges: DataFrame) -> DataFrame:
    """(g, center, first, last) of induced chains."""
    e = simple_edges(edges)
    paths = e.select("g", F.col("src").alias("first"), F.col("dst").alias("center")).join(e.select("g", F.col("src").alias("center"), F.col("dst").alias("last")), ["g", "center"]).where("first <> last")
    near = adjacency(edges)
    return paths.withColumns({"a": F.least("first", "last"), "b": F.greatest("first", "last")}).join(near, ["g", "a", "b"], "left_anti").select("g", "center", "first", "last")


def _later(edges: DataFrame, reverse: bool) -> DataFrame:
    """(g, center, leaf, later): of each leaf, the later ones that no edge joins it with."""
    center, leaf = ("dst", "src") if reverse else ("src", "dst")
    e = simple_edges(edges).select("g", F.col(center).alias("center"), F.col(leaf).alias("leaf"))
    pairs = e.join(e.withColumnRenamed("leaf", "other"), ["g", "center"]).where("leaf < other")
    near = adjacency(edges).withColumnsRenamed({"a": "leaf", "b": "other"})
    return pairs.join(near, ["g", "leaf", "other"], "left_anti").groupBy("g", "center", "leaf").agg(F.array_sort(F.collect_list("other")).alias("later"))


def stars(edges: DataFrame, leaves: int, reverse: bool = False) -> DataFrame:
    """(g, center, leaves) of induced forks, or colliders, with so many leaves."""
    later = _later(edges, reverse) if leaves == 2 else materialize(_later(edges, reverse), "later")
    grown = later.select("g", "center", F.array("leaf").alias("leaves"), F.col("later").alias("open"))
    for _ in range(leaves - 2):
        grown = grown.select("g", "center", "leaves", "open", F.explode("open").alias("leaf"))
        # the open leaves of a fork that grows are those its new leaf leaves open too
        grown = grown.join(later, ["g", "center", "leaf"]).select("g", "center", F.array_append("leaves", F.col("leaf")).alias("leaves"), F.array_intersect("open", "later").alias("open"))
    return grown.select("g", "center", F.explode(F.transform("open", lambda x: F.array_append("leaves", x))).alias("leaves"))


def census_long(counts: DataFrame) -> DataFrame:
    """(g, motif, n) of a census."""
    pairs = F.array(*(F.struct(F.lit(t).alias("motif"), F.col(t.lower().replace(".", "")).alias("n")) for t in TYPES))
    return counts.select("g", F.inline(pairs))


def ratios(counts: DataFrame) -> DataFrame:
    """(g, motif, n, ratio): shares of a graph's motifs, 0 where it has none."""
    total = F.sum("n").over(W.partitionBy("g"))
    return census_long(counts).withColumn("ratio", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)))


def complexity(counts: DataFrame) -> DataFrame:
    weighted = sum(F.col(t.lower().replace(".", "")) * w for t, w in COMPLEXITY.items())
    return counts.select("g", weighted.cast("bigint").alias("complexity"))


def families(counts: DataFrame) -> DataFrame:
    """(g, chain, fork, collider)."""
    return counts.select("g", *(sum(F.col(t.lower().replace(".", "")) for t in ts).cast("bigint").alias(f) for f, ts in FAMILIES.items()))


def family_means(counts: DataFrame, demographics: DataFrame) -> DataFrame:
    """(demographic, family, mean): how many motifs of a family the graphs of a demographic(g, demographic) have on average.

    Graphs that demographics lacks count as ``unknown``; graphs without a motif of the family count with 0.
    """
    named = counts.join(demographics.select("g", "demographic"), "g", "left").withColumn("demographic", F.coalesce("demographic", F.lit("unknown")))
    total = lambda types: sum(F.col(t.lower().replace(".", "")) for t in types)
    pairs = F.array(*(F.struct(F.lit(f).alias("family"), total(ts).cast("double").alias("n")) for f, ts in MEAN_FAMILIES.items()))
    return named.select("demographic", F.inline(pairs)).groupBy("demographic", "family").agg(F.avg("n").alias("mean"))


def heatmap(counts: DataFrame) -> DataFrame:
    """One row for each motif, one column for each graph id that stands in ``g`` is up to the caller; here (motif, g, n), none missing."""
    return census_long(counts).select("motif", "g", "n")


def instances(edges: DataFrame) -> DataFrame:
    """(g, motif, center, nodes) of every instance; a star's type is that of its leaves, its centre the shared end."""
    ids = lambda *x: F.array(*(F.col(c).cast("bigint") for c in x))
    parts = [chains(edges).select("g", F.lit("M1").alias("motif"), F.col("center").cast("bigint").alias("center"), ids("first", "center", "last").alias("nodes"))]
    for family, reverse in (("M2", False), ("M3", True)):
        for k in (2, 3, 4):
            s = stars(edges, k, reverse)
            parts.append(s.select("g", F.lit(f"{family}.{k - 1}").alias("motif"), F.col("center").cast("bigint").alias("center"), F.concat(ids("center"), F.transform("leaves", lambda x: x.cast("bigint"))).alias("nodes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def extract(found: DataFrame, cap: int = CAP) -> DataFrame:
    """Larger stars take their centre from smaller ones of their family; of each type a graph keeps the first ``cap`` by nodes."""
    family, size = F.substring("motif", 1, 2), F.size("nodes")
    largest = F.max(size).over(W.partitionBy("g", family, "center"))
    kept = found.withColumn("__m", F.when(family == "M1", size).otherwise(largest)).where(F.size("nodes") == F.col("__m")).drop("__m")
    rank = F.row_number().over(W.partitionBy("g", "motif").orderBy("nodes"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= cap)


def extract_by_suppression(found: DataFrame, cap: int = CAP) -> DataFrame:
    """The other reading of the types: any star of a centre is the largest type of its family, of as many leaves as first fit.

    Each centre gives one instance, of its largest star and the smallest nodes.
    """
    family = F.substring("motif", 1, 2)
    first = F.row_number().over(W.partitionBy("g", family, "center").orderBy(F.desc(F.size("nodes")), "nodes"))
    one = found.withColumn("__n", first).where((F.col("__n") == 1) | (F.col("motif") == "M1")).drop("__n")
    typed = one.withColumn("motif", F.when(family == "M1", F.lit("M1")).otherwise(F.concat(family, F.lit(".3"))))
    rank = F.row_number().over(W.partitionBy("g", "motif", F.size("nodes")).orderBy("nodes"))
    return typed.withColumn("rank", rank).where(F.col("rank") <= cap)
