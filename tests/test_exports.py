"""Exports of graphs as sets of files: round trip, commit after a task that failed, abort, and sets of other origin."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import exports, graphs

EVIDENCE = "array<struct<qa_id:string,confidence:double>>"


def tables(spark, count=6):
    nodes = [(f"g{k}", f"n{i}", f"Label {i}\n\"é\"", 0.5 + i / 10, [f"qa_{i}"]) for k in range(count) for i in range(3)]
    edges = [(f"g{k}", f"e{i}", f"n{i}", f"n{i + 1}", 0.25, -0.5 if i else 0.75, [("qa_1", 0.9)]) for k in range(1, count) for i in range(2)]
    qa = [(f"g{k}", "qa_1", "Why?", "Because.", [("a", "b", 0.5)]) for k in range(0, count, 2)]
    return (
        spark.createDataFrame(nodes, "g string, node string, label string, confidence double, source_qa array<string>"),
        spark.createDataFrame(edges, f"g string, edge string, src string, dst string, confidence double, modifier double, evidence {EVIDENCE}"),
        spark.createDataFrame(qa, "g string, qa_id string, question string, answer string, extracted_pairs array<struct<source:string,target:string,confidence:double>>"),
    )


def found(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if f.endswith(".json"))


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def check_round_trip(spark, path, nodes, edges, qa):
    back = exports.read_exports(spark, str(path), strict=True)
    assert rows(back["nodes"], "g", "node", "label", "confidence", "source_qa") == rows(nodes, "g", "node", "label", "confidence", "source_qa")
    assert rows(back["edges"], "g", "edge", "src", "dst", "confidence", "modifier") == rows(edges, "g", "edge", "src", "dst", "confidence", "modifier")
    assert rows(back["qa"], "g", "qa_id", "question", "answer") == rows(qa, "g", "qa_id", "question", "answer")


def test_round_trip(spark, tmp_path):
    nodes, edges, qa = tables(spark)
    parts = exports.graph_parts(nodes, edges, qa, "2024-01-01 00:00:00")
    exports.write_exports(parts.repartition(3), str(tmp_path / "out"))
    names = found(tmp_path / "out")
    assert names == sorted(f"g{k}_{p}.json" for k in range(6) for p in exports.PARTS) and (tmp_path / "out" / "_SUCCESS").exists() and not (tmp_path / "out" / "_staging").exists()
    check_round_trip(spark, tmp_path / "out", nodes, edges, qa)
    one = {p: json.loads(next((tmp_path / "out").rglob(f"g2_{p}.json")).read_text()) for p in exports.PARTS}
    assert one["metadata"] == {"total_nodes": 3, "total_edges": 2, "timestamp": "2024-01-01 00:00:00", "total_qa_pairs": 1}
    assert one["nodes"]["n1"]["incoming_edges"] == ["e0"] and one["nodes"]["n1"]["outgoing_edges"] == ["e1"] and one["edges"]["e1"]["positive"] is False
    empty = {p: json.loads(next((tmp_path / "out").rglob(f"g0_{p}.json")).read_text()) for p in exports.PARTS}
    assert empty["edges"] == {} and len(empty["qa_history"]) == 1


def test_what_a_failed_task_wrote_is_never_seen(spark, tmp_path):
    """The first attempt at a partition writes half of its sets and dies; a whole write that dies leaves the target alone."""
    nodes, edges, qa = tables(spark)
    parts = exports.graph_parts(nodes, edges, qa).coalesce(1)
    sink = exports.ExportWriter({"path": str(tmp_path / "out")}, False)
    data = parts.collect()

    def dies():
        yield from data[:2]
        raise OSError("the executor is gone")

    with pytest.raises(OSError):
        sink.write(dies())
    half = found(tmp_path / "out")
    assert len(half) == 8
    done = sink.write(iter(data))
    assert done.sets == 6
    sink.commit([done, None])
    assert found(tmp_path / "out") == sorted(f"g{k}_{p}.json" for k in range(6) for p in exports.PARTS) and not (tmp_path / "out" / "_staging").exists()
    check_round_trip(spark, tmp_path / "out", nodes, edges, qa)

    broken = parts.withColumn("edges", F.when(F.col("g") == "g3", F.lit("{not json")).otherwise(F.col("edges")))
    with pytest.raises(Exception, match="JSON|Expecting"):
        exports.write_exports(broken.repartition(3), str(tmp_path / "out"), "overwrite")
    check_round_trip(spark, tmp_path / "out", nodes, edges, qa)
    assert not (tmp_path / "out" / "_staging").exists()


def test_modes_and_odd_names(spark, tmp_path):
    nodes, edges, qa = tables(spark, 2)
    rename = lambda df: df.withColumn("g", F.concat(F.lit("a/b c%+é_"), "g"))
    odd = [rename(x) for x in (nodes, edges, qa)]
    exports.write_exports(exports.graph_parts(*odd), str(tmp_path / "out"))
    check_round_trip(spark, tmp_path / "out", *odd)
    with pytest.raises(Exception, match="already"):
        exports.write_exports(exports.graph_parts(nodes, edges), str(tmp_path / "out"))
    exports.write_exports(exports.graph_parts(nodes, edges), str(tmp_path / "out"), "overwrite")
    check_round_trip(spark, tmp_path / "out", nodes, edges, qa.limit(0))
    with pytest.raises(Exception, match="twice"):
        parts = exports.graph_parts(nodes, edges)
        exports.write_exports(parts.union(parts).coalesce(1), str(tmp_path / "twice"))
    exports.write_exports(exports.graph_parts(nodes.limit(0), edges.limit(0)), str(tmp_path / "none"))
    assert found(tmp_path / "none") == [] and (tmp_path / "none" / "_SUCCESS").exists()


def test_three_files_of_other_origin(spark, tmp_path):
    sets = {"graph_export": ("nodes", "edges", "qa_history"), "bare": ("nodes", "edges"), "lost_nodes": ("edges", "qa_history"), "lost_edges": ("nodes",), "unlike": ()}
    text = {"nodes": {"n1": {"label": "A", "confidence": 0.5, "source_qa": []}}, "edges": {"e1": {"source": "n1", "target": "n1", "aggregate_confidence": 0.4, "modifier": 0.4, "evidence": [{"qa_id": "qa_001", "confidence": 0.4}]}}, "qa_history": {"qa_001": {"question": "Q", "answer": "A", "extracted_pairs": []}}}
    for base, parts in sets.items():
        for p in parts:
            (tmp_path / f"{base}_{p}.json").write_text(json.dumps(text[p]))
    (tmp_path / "some_thing.json").write_text("{}")
    back = exports.read_exports(spark, str(tmp_path))
    assert {r["g"] for r in back["nodes"].collect()} == {"graph_export", "bare"} and [r["qa_id"] for r in back["qa"].collect()] == ["qa_001"]
    assert rows(back["faults"], "g", "fault") == [("lost_edges", "no edges file"), ("lost_nodes", "no nodes file")]
    assert [r["evidence"][0]["qa_id"] for r in back["edges"].where("g = 'bare'").collect()] == ["qa_001"]
    with pytest.raises(ValueError, match="lost_edges"):
        exports.read_exports(spark, str(tmp_path), strict=True)
    assert graphs.parse_graphs(spark.createDataFrame([], "g string, text string"))["nodes"].count() == 0
