"""Edge-table operators. Graphs are rows (g, src, dst, ord, modifier, confidence) and nodes (g, node, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STANCE_SUPPORT, STANCE_OPPOSE = 0.3, -0.3
LOW_CONFIDENCE = 0.9


def dedupe(edges: DataFrame) -> DataFrame:
    """Of edges with the same ends the last counts."""
    newest = F.row_number().over(W.partitionBy("g", "src", "dst").orderBy(F.desc("ord")))
    return edges.withColumn("__n", newest).where("__n = 1").drop("__n")


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    known = nodes.select("g", "node").distinct()
    return edges.join(known.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(known.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi")


def clamp_modifiers(edges: DataFrame, default: float = 0.0) -> DataFrame:
    m = F.coalesce(F.col("modifier"), F.lit(default))
    return edges.withColumn("modifier", F.greatest(F.least(m, F.lit(1.0)), F.lit(-1.0)))


def ends(edges: DataFrame) -> DataFrame:
    """(g, node) of every edge's ends, distinct."""
    return edges.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges), ["g", "node"], "left_semi")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges), ["g", "node"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(g, node, in_degree, out_degree) of nodes with edges, in one aggregation."""
    both = edges.select("g", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return both.groupBy("g", "x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def position(in_degree: Column, out_degree: Column) -> Column:
    """Five classes; the first that fits."""
    return (
        F.when((in_degree == 0) & (out_degree > 0), "source")
        .when((in_degree > 0) & (out_degree == 0), "sink")
        .when(in_degree > 1, "collector")
        .when(out_degree > 1, "distributor")
        .otherwise("intermediate")
    )


def position3(in_degree: Column, out_degree: Column) -> Column:
    return F.when(in_degree == 0, "source").when(out_degree == 0, "sink").otherwise("intermediate")


def position_weight(place: Column) -> Column:
    return F.when(place == "intermediate", 1.0).otherwise(1.5)


def role(in_degree: Column, out_degree: Column) -> Column:
    """Central, influencer, influenced or isolated, by which edges a node has."""
    return F.when((in_degree > 0) & (out_degree > 0), "central").when(out_degree > 0, "influencer").when(in_degree > 0, "influenced").otherwise("isolated")


def node_roles(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of each graph with the most edges, with their roles."""
    d = degrees(edges).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    ranked = d.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("degree"), "node"))).where(F.col("rank") <= k)
    return ranked.withColumn("role", role(F.col("in_degree"), F.col("out_degree")))


def stance_node(nodes: DataFrame) -> DataFrame:
    """(g, node): the first node of each graph whose label holds ``stance``."""
    return nodes.where(F.contains(F.lower("label"), F.lit("stance"))).groupBy("g").agg(F.min("node").alias("node"))


def stance_of(modifier: Column) -> Column:
    return F.when(modifier > STANCE_SUPPORT, "support").when(modifier < STANCE_OPPOSE, "oppose").otherwise("neutral")


def graph_stance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, stance) by the first edge into the stance node; neutral without one."""
    into = stance_node(nodes).join(edges.select("g", F.col("dst").alias("node"), "ord", "modifier"), ["g", "node"], "left")
    first = into.groupBy("g").agg(F.min_by("modifier", "ord").alias("m"))
    return nodes.select("g").distinct().join(first, "g", "left").select("g", stance_of(F.coalesce("m", F.lit(0.0))).alias("stance"))


def low_confidence(edges: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    return edges.where(F.col("confidence") < below)


def label_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds src_label and dst_label; a node without label is called by its id."""
    names = nodes.select("g", "node", "label")
    for end in ("src", "dst"):
        edges = edges.join(names.withColumnsRenamed({"node": end, "label": f"{end}_label"}), ["g", end], "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", F.col(end).cast("string")))
    return edges


def aggregate(edges: DataFrame) -> DataFrame:
    """Graphs laid over each other: how often an edge stands, and the attributes it first had."""
    first = F.struct("g", "ord")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n_graphs"), F.min_by("modifier", first).alias("modifier"), F.min_by("confidence", first).alias("confidence"))


def remap(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping(g, old, new): ends move to their new ids, loops that come of it go, and equal edges become the last of them."""
    for end in ("src", "dst"):
        m = mapping.select("g", F.col("old").alias(end), F.col("new").alias("__new"))
        edges = edges.join(m, ["g", end], "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return dedupe(drop_self_loops(edges))


def merge_stance_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges after all stance nodes of a graph became its first."""
    named = nodes.where(F.contains(F.lower("label"), F.lit("stance")))
    target = stance_node(nodes).withColumnRenamed("node", "new")
    return remap(edges, named.select("g", F.col("node").alias("old")).join(target, "g").where("old <> new"))


def drop_stance_out_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    named = nodes.where(F.contains(F.lower("label"), F.lit("stance"))).select("g", F.col("node").alias("src"))
    return edges.join(named, ["g", "src"], "left_anti")


def from_relations(relations: DataFrame) -> DataFrame:
    """(g, ord, cause, effect, ...) -> edges between phrases; the last of equal pairs counts, and loops go."""
    return dedupe(drop_self_loops(relations.withColumnsRenamed({"cause": "src", "effect": "dst"})))


def connect_to_stances(edges: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Adds links(g, src, dst, ord, modifier, confidence), but for those that lack an end among nodes."""
    return dedupe(edges.unionByName(drop_dangling(links, nodes), allowMissingColumns=True))


def latest(rows: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """The row of the latest time of each key, the first of equals."""
    newest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(time), order))
    return rows.withColumn("__n", newest).where("__n = 1").drop("__n")


def signed_weight(modifier: Column) -> Column:
    return F.when(modifier < 0, 1 + modifier).otherwise(modifier)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, n_nodes, n_edges, density), by two aggregations."""
    n = nodes.groupBy("g").agg(F.countDistinct("node").alias("n_nodes"))
    m = edges.groupBy("g").agg(F.count("*").alias("n_edges"))
    both = n.join(m, "g", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return both.withColumn("density", F.coalesce(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0)))
