"""Graphs as sets of files: nodes, edges, question history and metadata, each a JSON file of its own.

``write_exports`` writes ``<g>_nodes.json``, ``<g>_edges.json``, ``<g>_qa_history.json`` and ``<g>_metadata.json`` for every graph
through a data source with a commit protocol. A task writes whole sets to a folder of its own below ``_staging``, and only when
all tasks are done the driver moves these folders, one for each task, below the target and writes ``_SUCCESS``. So a task that
fails and runs again leaves nothing behind, neither half a set nor a set twice; and a write that fails leaves the target as it was.

``read_exports`` puts the sets together again, from these or from any other folder with files of such names, and a set that lacks
its nodes or edges is a fault. The follow-up questions read three of the files; metadata is made anew from the counts.

Defined cases: graphs without edges or history have empty objects; a name with characters that files can't have is escaped as in
URLs; repeated graphs (rows with one g) raise when their task writes both, or read back as faults; an empty table makes a folder
with ``_SUCCESS`` only; a target that holds a finished export already raises unless mode is overwrite.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .graphs import parse_graphs, read_texts

PARTS = ("nodes", "edges", "qa_history", "metadata")
SCHEMA = "g string, nodes string, edges string, qa_history string, metadata string"
DONE = "_SUCCESS"


def graph_parts(nodes: DataFrame, edges: DataFrame, qa: DataFrame | None = None, timestamp: str | None = None) -> DataFrame:
    """Rows of SCHEMA. nodes(g, node, label, confidence, source_qa), edges(g, edge, src, dst, confidence, modifier, evidence) and

    qa(g, qa_id, question, answer, extracted_pairs) are as ``parse_graphs`` gives them; columns that are absent are left out.
    """
    text = lambda c: F.col(c).cast("string")

    def having(df, names):
        return [F.col(c).alias(a) for c, a in names if c in df.columns]

    def as_object(df, key, fields, name):
        entry = F.struct(text(key).alias("key"), F.struct(*fields).alias("value"))
        return df.groupBy(text("g").alias("g")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias(name), F.count("*").alias(f"n_{name}"))

    ends = lambda side, name: edges.groupBy("g", F.col(side).alias("node")).agg(F.array_sort(F.collect_list(text("edge"))).alias(name))
    listed = nodes.join(ends("dst", "incoming_edges"), ["g", "node"], "left").join(ends("src", "outgoing_edges"), ["g", "node"], "left")
    listed = listed.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("incoming_edges", "outgoing_edges")})
    n = as_object(listed, "node", having(listed, [(c, c) for c in ("label", "confidence", "source_qa", "incoming_edges", "outgoing_edges")]), "nodes")
    e = as_object(edges, "edge", [text("src").alias("source"), text("dst").alias("target"), *having(edges, [("confidence", "aggregate_confidence"), ("evidence", "evidence"), ("modifier", "modifier")]), (F.col("modifier") > 0).alias("positive")], "edges")
    out = n.join(e, "g", "left")
    if qa is not None:
        out = out.join(as_object(qa, "qa_id", having(qa, [(c, c) for c in ("question", "answer", "extracted_pairs")]), "qa_history"), "g", "left")
    else:
        out = out.withColumns({"qa_history": F.lit(None).cast("string"), "n_qa_history": F.lit(0).cast("long")})
    count = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0))
    at = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    metadata = F.to_json(F.struct(count("nodes").alias("total_nodes"), count("edges").alias("total_edges"), at.alias("timestamp"), count("qa_history").alias("total_qa_pairs")))
    return out.select("g", "nodes", *(F.coalesce(c, F.lit("{}")).alias(c) for c in ("edges", "qa_history")), metadata.alias("metadata"))


# Writing


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    sets: int


class ExportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        if not options.get("path"):
            raise ValueError("graph_exports needs a path")
        self.path, self.indent, self.overwrite = options["path"].rstrip("/"), int(options.get("indent", 2)), overwrite
        self.job = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging/{self.job}"
        system, path = _file_system(self.path)
        from pyarrow import fs

        if not overwrite and system.get_file_info(f"{path}/{DONE}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds an export already")

    def write(self, rows: Iterator) -> Staged:
        system, folder = _file_system(f"{self.staging}/{uuid.uuid4().hex}")
        seen: set = set()
        for row in rows:
            if row["g"] in seen:
                raise ValueError(f"graph {row['g']} stands twice")
            seen.add(row["g"])
            if len(seen) == 1:
                system.create_dir(folder, recursive=True)
            for part in PARTS:
                with system.open_output_stream(f"{folder}/{urllib.parse.quote(str(row['g']), safe=' ')}_{part}.json") as f:
                    f.write(json.dumps(json.loads(row[part] or "{}"), indent=self.indent or None, ensure_ascii=False).encode())
        return Staged(folder.rsplit("/", 1)[-1], len(seen))

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, path = _file_system(self.path)
        system.create_dir(path, recursive=True)
        old = [i for i in system.get_file_info(fs.FileSelector(path)) if i.base_name != "_staging"] if self.overwrite else []
        # the mark goes before anything else is touched, so that a reader never takes a mixture for a finished export
        for info in sorted(old, key=lambda i: i.base_name != DONE):
            (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        for m in messages:
            if m is not None and m.sets:
                system.move(f"{path}/_staging/{self.job}/{m.folder}", f"{path}/part-{m.folder}")
        self._clear(system, path)
        with system.open_output_stream(f"{path}/{DONE}") as f:
            f.write(json.dumps({"sets": sum(m.sets for m in messages if m is not None)}).encode())

    def abort(self, messages: list) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, system, path: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{path}/_staging/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_staging/{self.job}")
        if system.get_file_info(f"{path}/_staging").type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(f"{path}/_staging")):
            system.delete_dir(f"{path}/_staging")


class ExportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph_exports"

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        return ExportWriter(dict(self.options), overwrite)


def write_exports(parts: DataFrame, path: str, mode: str = "append", indent: int = 2) -> None:
    """Writes rows of SCHEMA, as ``graph_parts`` makes them; all files of a graph come from one task."""
    parts.sparkSession.dataSource.register(ExportSink)
    parts.select(*(x.split()[0] for x in SCHEMA.split(", "))).write.format("graph_exports").mode(mode).options(path=path, indent=str(indent)).save()


# Reading


def read_exports(spark: SparkSession, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """As ``parse_graphs`` of sets of files; faults are sets without nodes or edges, or with a part twice. With strict they raise."""
    pattern = rf"^(.*)_({'|'.join(PARTS)})$"
    files = read_texts(spark, path, "*_*.json").withColumns({"base": F.regexp_extract("g", pattern, 1), "part": F.regexp_extract("g", pattern, 2)}).where("part <> ''")
    one = lambda p: F.max(F.when(F.col("part") == p, F.col("text"))).alias(p)
    often = F.max(F.col("n")).alias("most")
    counted = files.groupBy("base", "part").agg(F.max("text").alias("text"), F.count("*").alias("n"))
    # Spark reports names percent-encoded, and the sink has encoded them once before
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    sets = counted.groupBy(plain(plain(F.col("base"))).alias("g")).agg(*map(one, PARTS), often)
    fault = F.when(F.col("nodes").isNull(), "no nodes file").when(F.col("edges").isNull(), "no edges file").when(F.col("most") > 1, "a part twice")
    sets = sets.withColumn("fault", fault)
    whole = sets.where("fault IS NULL").select("g", F.concat(F.lit('{"nodes":'), "nodes", F.lit(',"edges":'), "edges", F.lit(',"qa_history":'), F.coalesce("qa_history", F.lit("{}")), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")), F.lit("}")).alias("text"))
    parsed = parse_graphs(whole)
    parsed["faults"] = parsed["faults"].unionByName(sets.where("fault IS NOT NULL").select("g", "fault"))
    if strict and (bad := parsed["faults"].orderBy("g").limit(10).collect()):
        raise ValueError("; ".join(f"{b['g']}: {b['fault']}" for b in bad))
    return parsed
