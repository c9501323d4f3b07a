"""Graph documents: JSON in either layout, agents' graph collections, structural samples, motif libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_label

_EVIDENCE = "array<struct<qa_id:string,confidence:double,importance:double,original_modifier:double>>"
_NODE = f"struct<id:string,label:string,aggregate_confidence:double,confidence:double,importance:double,is_stance:boolean,source_qa:array<string>,evidence:{_EVIDENCE}>"
_EDGE = f"struct<id:string,source:string,target:string,`from`:string,`to`:string,aggregate_confidence:double,confidence:double,modifier:double,evidence:{_EVIDENCE}>"
_PAIR = "struct<source:string,target:string,confidence:double>"
_QA = f"struct<question:string,answer:string,extracted_pairs:array<{_PAIR}>>"


def read_texts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(g, text) of every file below path that fits glob; g is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("g"), F.col("value").alias("text"))


def _both_layouts(text: Column, name: str, item: str) -> Column:
    """array<struct<key, value>> of a field that is a map by id or a list of items with their own ids."""
    raw = F.get_json_object(text, f"$.{name}")
    as_map = F.map_entries(F.from_json(raw, f"map<string,{item}>"))
    as_list = F.transform(F.from_json(raw, f"array<{item}>"), lambda x: F.struct(x["id"].alias("key"), x.alias("value")))
    return F.when(F.substring(F.trim(raw), 1, 1) == "[", as_list).otherwise(as_map)


def parse_graphs(docs: DataFrame) -> dict[str, DataFrame]:
    """(g, text) -> graphs, nodes, edges, qa and faults. A text that is no JSON object, or has no nodes, is a fault and nothing else."""
    held = docs.select("g", "text", _both_layouts(F.col("text"), "nodes", _NODE).alias("ns"), _both_layouts(F.col("text"), "edges", _EDGE).alias("es"))
    sound = held.where(F.col("ns").isNotNull())
    meta = lambda k: F.coalesce(F.get_json_object("text", f"$.metadata.{k}"), F.get_json_object("text", f"$.{k}"))
    graphs = sound.select("g", F.get_json_object("text", "$.agent_id").alias("agent_id"), meta("perspective").alias("perspective"), meta("stance").alias("stance"), meta("timestamp").alias("timestamp"), F.from_json(F.get_json_object("text", "$.metadata"), "map<string,string>").alias("metadata"))
    n = sound.select("g", F.posexplode("ns").alias("ord", "x")).select("g", "ord", F.col("x.key").alias("node"), "x.value.*")
    nodes = n.select("g", "node", "label", normal_label(F.coalesce("label", "node")).alias("norm_label"), F.coalesce("aggregate_confidence", "confidence").alias("confidence"), "importance", F.coalesce("is_stance", F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit("stance"))).alias("is_stance"), "source_qa", "evidence", "ord")
    e = sound.select("g", F.posexplode_outer("es").alias("ord", "x")).where("x IS NOT NULL").select("g", "ord", F.col("x.key").alias("edge"), "x.value.*")
    edges = e.select("g", "edge", F.coalesce("source", "from").alias("src"), F.coalesce("target", "to").alias("dst"), F.coalesce("modifier", F.lit(0.0)).alias("modifier"), F.coalesce("aggregate_confidence", "confidence").alias("confidence"), "evidence", "ord")
    qa = sound.select("g", F.explode(F.from_json(F.get_json_object("text", "$.qa_history"), f"map<string,{_QA}>")).alias("qa_id", "x")).select("g", "qa_id", "x.*")
    faults = held.where(F.col("ns").isNull()).select("g", F.lit("no nodes").alias("fault"))
    return {"graphs": graphs, "nodes": nodes, "edges": edges, "qa": qa, "faults": faults}


def read_graphs(spark: SparkSession, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """The graphs of a folder; with strict a faulty file raises."""
    parts = parse_graphs(read_texts(spark, path))
    if strict and (bad := parts["faults"].first()):
        raise ValueError(f"{bad['g']}: {bad['fault']}")
    return parts


def read_agent_graphs(spark: SparkSession, path: str) -> DataFrame:
    """A collection file (a list, or {id: graph}, of graphs with agent and time) -> the latest graph of each agent as (g, text)."""
    from ..operators.edges import latest

    raw = read_texts(spark, path)
    items = raw.select("g", F.explode(F.coalesce(F.from_json("text", "array<string>"), F.map_values(F.from_json("text", "map<string,string>")))).alias("text"))
    rows = items.select(F.coalesce(F.get_json_object("text", "$.agent_id"), F.get_json_object("text", "$.prolificId"), F.get_json_object("text", "$.id")).alias("agent_id"), F.get_json_object("text", "$.timestamp").alias("timestamp"), F.coalesce(F.get_json_object("text", "$.graph"), F.col("text")).alias("text"), F.md5("text").alias("ord"))
    return latest(rows.where(F.col("agent_id").isNotNull() & (F.col("text") != "null")), "agent_id", "timestamp", "ord").select(F.col("agent_id").alias("g"), "text")


def validate_samples(docs: DataFrame) -> DataFrame:
    """(g, fault) of structural samples(g, text, expected_nodes, expected_edges): missing id or keys, node count, edge count off by over two, too few questions, unknown ends."""
    parts = parse_graphs(docs.select("g", "text"))
    n, e = (parts[p].groupBy("g").agg(F.count("*").alias(c)) for p, c in (("nodes", "n"), ("edges", "e")))
    known = parts["nodes"].select("g", F.col("node").alias("end"))
    unknown = parts["edges"].select("g", F.explode(F.array("src", "dst")).alias("end")).join(known, ["g", "end"], "left_anti").groupBy("g").agg(F.count("*").alias("u"))
    qas = F.size(F.from_json(F.get_json_object("text", "$.qas"), "array<string>"))
    joined = docs.join(n, "g", "left").join(e, "g", "left").join(unknown, "g", "left").na.fill(0, ["n", "e", "u"])
    faults = F.array(
        F.when(F.get_json_object("text", "$.agent_id").isNull(), "no agent_id"),
        F.when(F.col("n") == 0, "no nodes"),
        F.when(F.col("n") != F.col("expected_nodes"), "node count"),
        F.when(F.abs(F.col("e") - F.col("expected_edges")) > 2, "edge count"),
        F.when(F.coalesce(qas, F.lit(0)) < F.greatest(F.lit(1), F.floor(F.col("e") / 2)), "too few questions"),
        F.when(F.col("u") > 0, "unknown ends"),
    )
    return joined.select("g", F.explode(F.array_compact(faults)).alias("fault"))


def parse_agent_sheets(docs: DataFrame) -> DataFrame:
    """Markdown sheets (g, text) -> (g, number, role, description): ``### Sample N: role`` up to ``**Decision Structure:**``."""
    pattern = r"(?s)### Sample (\d+):\s*([^\n]+)\n(.*?)\*\*Decision Structure:\*\*"
    found = lambda i: F.regexp_extract_all("text", F.lit(pattern), F.lit(i))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = docs.select("g", F.explode(F.arrays_zip(found(1).alias("number"), found(2).alias("role"), found(3).alias("description"))).alias("x"))
    return rows.select("g", F.col("x.number").cast("int").alias("number"), strip(F.col("x.role")).alias("role"), strip(F.col("x.description")).alias("description"))


def write_library(members: DataFrame, path: str) -> None:
    """members(grp, ord, labels, edges, demographic, ...) as Parquet, by their group's motif type."""
    members.withColumn("motif_type", F.substring_index("grp", "_", 1)).write.partitionBy("motif_type").parquet(path)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Everything that was written, demographics and edges included."""
    return spark.read.parquet(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, json) in the layout by id, with degrees; ``parse_graphs`` reads it back."""
    deg_out = edges.groupBy("g", F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    deg_in = edges.groupBy("g", F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    n = nodes.join(deg_in, ["g", "node"], "left").join(deg_out, ["g", "node"], "left").na.fill(0, ["in_degree", "out_degree"])
    node = F.struct(F.col("node").cast("string").alias("k"), F.struct("label", "in_degree", "out_degree").alias("v"))
    edge = F.struct(F.concat(F.lit("e"), F.col("ord").cast("string")).alias("k"), F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "modifier", F.col("confidence").alias("aggregate_confidence")).alias("v"))
    as_map = lambda df, x, name: df.groupBy("g").agg(F.map_from_entries(F.array_sort(F.collect_list(x))).alias(name))
    both = as_map(n, node, "nodes").join(as_map(edges, edge, "edges"), "g", "left")
    return both.select("g", F.to_json(F.struct("nodes", F.coalesce("edges", F.create_map().cast(both.schema["edges"].dataType)).alias("edges"))).alias("json"))


def graph_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, json) in the layout of lists."""
    ns = nodes.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("string").alias("id"), "label"))).alias("nodes"))
    es = edges.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("string").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "modifier", "confidence"))).alias("edges"))
    return ns.join(es, "g", "left").select("g", F.to_json(F.struct("nodes", "edges")).alias("json"))


def library_summary(members: DataFrame) -> DataFrame:
    """(motif_type, grp, instances), by type, the largest first."""
    return members.groupBy(F.substring_index("grp", "_", 1).alias("motif_type"), "grp").agg(F.count("*").alias("instances")).orderBy("motif_type", F.desc("instances"), "grp")

