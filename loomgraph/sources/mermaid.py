"""Mermaid flow charts: read into nodes and edges, written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import mermaid_label


def read(spark: SparkSession, path: str) -> DataFrame:
    """(g, mermaid) of every .mmd file below path; g is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.mmd", recursiveFileLookup=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.mmd$", 1).alias("g"), F.col("value").alias("mermaid"))


def parse(charts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, mermaid) -> nodes (g, node, label) and edges (g, src, dst, positive, ord).

    A fenced block counts alone where there is one. Of each line the first node counts; positive edges come first, then negative.
    """
    fenced = F.regexp_extract("mermaid", r"(?s)```(?:mermaid)?\s*\n(.*?)```", 1)
    lines = charts.select("g", F.posexplode(F.split(F.when(fenced != "", fenced).otherwise(F.col("mermaid")), "\n")).alias("line_no", "line"))
    node = F.regexp_extract("line", r"\b(n\d+)\[(.*?)\]", 1)
    nodes = lines.where(node != "").select("g", node.alias("node"), F.regexp_extract("line", r"\b(n\d+)\[(.*?)\]", 2).alias("label"), "line_no")
    nodes = nodes.groupBy("g", "node").agg(F.max_by("label", "line_no").alias("label"))
    pattern = r"\b(n\d+)(?:\[[^\]]*\])?\s*(-->|--x)\s*(?:\|[^|]*\|)?\s*(n\d+)"
    part = lambda i: F.regexp_extract("line", pattern, i)
    edges = lines.where(part(2) != "").select("g", part(1).alias("src"), part(3).alias("dst"), (part(2) == "-->").alias("positive"), "line_no")
    order = W.partitionBy("g").orderBy(~F.col("positive"), "line_no")
    return nodes, edges.withColumn("ord", F.row_number().over(order)).drop("line_no")


def _lines(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    """(g, lines): one text for each graph, which is a small document."""
    listed = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("__l")))).alias("ls"))
    return listed.select("g", F.array_join(F.transform("ls", lambda x: x["__l"]), "\n").alias("lines"))


def render(nodes: DataFrame, edges: DataFrame, arrow: Column | None = None) -> DataFrame:
    """(g, mermaid): nodes in the order of their ids, edges in theirs; negative modifiers have crossed arrows."""
    arrow = F.when(F.col("modifier") < 0, " --x ").otherwise(" --> ") if arrow is None else arrow
    n = _lines(nodes, ["node"], F.concat(F.lit("    n"), F.col("node").cast("string"), F.lit("["), mermaid_label(F.col("label")), F.lit("]")))
    e = _lines(edges, ["ord"], F.concat(F.lit("    n"), F.col("src").cast("string"), arrow, F.lit("n"), F.col("dst").cast("string")))
    both = n.join(e.withColumnRenamed("lines", "edge_lines"), "g", "left")
    return both.select("g", F.concat_ws("\n", F.lit("flowchart TD"), "lines", "edge_lines").alias("mermaid"))


def confidence_arrow(confidence: Column) -> Column:
    """Strong, plain and dotted arrows."""
    return F.when(confidence >= 0.8, " ==> ").when(confidence >= 0.5, " --> ").otherwise(" -.-> ")


def link_styles(edges: DataFrame) -> DataFrame:
    """(g, styles): one linkStyle line for each edge, coloured by sign, as thick as three times the confidence, 1 at least."""
    width = F.greatest(F.lit(1), F.floor(F.col("confidence") * 3).cast("int"))
    colour = F.when(F.col("modifier") < 0, "#c0392b").otherwise("#27ae60")
    numbered = edges.withColumn("__i", F.row_number().over(W.partitionBy("g").orderBy("ord")) - 1)
    return _lines(numbered, ["__i"], F.concat(F.lit("    linkStyle "), F.col("__i").cast("string"), F.lit(" stroke:"), colour, F.lit(",stroke-width:"), width.cast("string"), F.lit("px"))).withColumnRenamed("lines", "styles")


def repair_link_styles(charts: DataFrame) -> DataFrame:
    """Takes out linkStyle lines of edges that a chart does not have, and adds plain ones for edges without."""
    lines = F.split("mermaid", "\n")
    body = F.filter(lines, lambda x: ~F.trim(x).startswith("linkStyle"))
    n_edges = F.size(F.filter(body, lambda x: x.rlike(r"n\d+.*(-->|--x|==>|-\.->).*n\d+")))
    own = F.filter(F.transform(F.filter(lines, lambda x: F.trim(x).startswith("linkStyle")), lambda x: F.trim(x)), lambda x: F.regexp_extract(x, r"^linkStyle (\d+)", 1).try_cast("int") < n_edges)
    have = F.transform(own, lambda x: F.regexp_extract(x, r"^linkStyle (\d+)", 1).try_cast("int"))
    missing = F.when(n_edges > 0, F.array_except(F.sequence(F.lit(0), n_edges - 1), have)).otherwise(F.array().cast("array<int>"))
    added = F.transform(missing, lambda i: F.concat(F.lit("linkStyle "), i.cast("string"), F.lit(" stroke:#7f8c8d,stroke-width:1px")))
    styles = F.transform(F.concat(own, added), lambda x: F.concat(F.lit("    "), x))
    return charts.withColumn("mermaid", F.array_join(F.concat(body, styles), "\n"))
