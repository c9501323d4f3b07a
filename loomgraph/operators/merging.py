"""Merging of similar nodes, links to a stance, and narratives of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import cosine
from .edges import degrees, remap
from .similarity import LINK_THRESHOLD, VECTOR_THRESHOLD

FALLBACK_LINKS = 5


def vector_leaders(nodes: DataFrame, threshold: float = VECTOR_THRESHOLD) -> DataFrame:
    """nodes(g, node, vector, ord) -> (g, old, new): in their order, a node near enough to an earlier leader of its graph becomes it.

    A graph is a small document; its nodes are compared in one task.
    """
    kinds = dict(nodes.dtypes)

    def run(table):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("ord").to_numpy(), kind="stable")
        ids, vectors = table.column("node").to_pylist(), table.column("vector").to_pylist()
        leaders, out = [], []
        for i in order.tolist():
            v = np.array(vectors[i] or [0.0], "f8")
            size = np.linalg.norm(v)
            hit = next((n for n, u in leaders if len(u) == len(v) and size and u @ v >= threshold * size), None)
            if hit is None:
                if size:
                    leaders.append((ids[i], v / size))
            else:
                out.append((ids[i], hit))
        g = table.column("g")[0].as_py()
        return pa.table({"g": pa.array([g] * len(out), table.schema.field("g").type), "old": pa.array([a for a, _ in out], table.schema.field("node").type), "new": pa.array([b for _, b in out], table.schema.field("node").type)})

    return nodes.select("g", "node", "vector", "ord").groupBy("g").applyInArrow(run, f"g {kinds['g']}, old {kinds['node']}, new {kinds['node']}")


def merge_similar(nodes: DataFrame, edges: DataFrame, threshold: float = VECTOR_THRESHOLD) -> DataFrame:
    """Edges after similar nodes became one."""
    return remap(edges, vector_leaders(nodes, threshold))


def merge_groups(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """nodes(g, node, label, source_qa) after mapping(g, old, new): the kept node's label, and the distinct sources of all it took in."""
    moved = nodes.join(mapping.withColumnRenamed("old", "node"), ["g", "node"], "left").withColumn("id", F.coalesce("new", "node"))
    own = F.when(F.col("id") == F.col("node"), F.col("label"))
    return moved.groupBy("g", F.col("id").alias("node")).agg(
        F.coalesce(F.max(own), F.min("label")).alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_qa")))).alias("source_qa"), F.max(F.when(F.col("new").isNotNull(), True).otherwise(False)).alias("merged")
    )


def stance_links(nodes: DataFrame, edges: DataFrame, stance: list[float], threshold: float = LINK_THRESHOLD) -> DataFrame:
    """(g, node, weight): factors near the stance's vector, by their cosine; in a graph without any, the five nodes with most edges, by 1."""
    near = nodes.select("g", "node", cosine(F.col("vector"), F.array(*map(F.lit, stance))).alias("weight")).where(F.col("weight") > threshold)
    bare = nodes.select("g").distinct().join(near.select("g").distinct(), "g", "left_anti")
    d = degrees(edges).join(bare, "g", "left_semi").withColumn("n", F.col("in_degree") + F.col("out_degree"))
    most = d.withColumn("k", F.row_number().over(W.partitionBy("g").orderBy(F.desc("n"), "node"))).where(F.col("k") <= FALLBACK_LINKS)
    return near.unionByName(most.select("g", "node", F.lit(1.0).alias("weight")))


def narratives(agents: DataFrame, places: DataFrame, shown: int = 5) -> DataFrame:
    """agents(agent_id, neighborhood), places(neighborhood, kind, name) -> (agent_id, narrative): the first five names of each kind."""
    ranked = places.withColumn("k", F.row_number().over(W.partitionBy("neighborhood", "kind").orderBy("name"))).where(F.col("k") <= shown)
    of_kind = ranked.groupBy("neighborhood", "kind").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    lines = of_kind.groupBy("neighborhood").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "kind", "names"))).alias("ls"))
    text = F.concat_ws(". ", F.concat(F.lit("You live in "), F.col("neighborhood")), F.array_join("ls", ". "))
    return agents.join(lines, "neighborhood", "left").select("agent_id", text.alias("narrative"))


def copy_transcripts(agents: DataFrame, template: str) -> DataFrame:
    """Every agent with the same transcript."""
    return agents.withColumn("transcript", F.lit(template))
