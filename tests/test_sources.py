"""Readers and writers round trip; parsers on made-up documents; metrics and text rules against fixed expectations."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph import streaming
from loomgraph.functions import text as X
from loomgraph.functions.numeric import bernoulli_kl, safe_corr, wasserstein
from loomgraph.operators import evaluation as V
from loomgraph.operators import models as O
from loomgraph.operators import places as P
from loomgraph.operators import reconstruction as R
from loomgraph.operators import surveys as S
from loomgraph.sources import graphs, mermaid, records


def one(spark, expr, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(expr).first()[0]


def test_graph_json_layouts(spark, tmp_path):
    by_id = {"agent_id": "x", "nodes": {"n1": {"label": "Rent_Cost ", "aggregate_confidence": 0.9}, "n2": {"label": "upzoning_stance", "confidence": 0.5}}, "edges": {"e1": {"source": "n1", "target": "n2", "modifier": -0.7, "aggregate_confidence": 0.4}}, "qa_history": {"q1": {"question": "Why?", "answer": "So", "extracted_pairs": []}}, "metadata": {"perspective": "young"}}
    lists = {"nodes": [{"id": "a", "label": "A"}, {"id": "b"}], "edges": [{"id": "1", "source": "a", "target": "b"}]}
    for name, doc in (("one", json.dumps(by_id)), ("two", json.dumps(lists)), ("three", "no json"), ("four", "{}")):
        (tmp_path / f"{name}.json").write_text(doc)
    p = graphs.read_graphs(spark, str(tmp_path))
    n = {(r["g"], r["node"]): r for r in p["nodes"].collect()}
    assert n["one", "n1"]["norm_label"] == "rent cost" and n["one", "n2"]["is_stance"] and n["two", "b"]["norm_label"] == "b"
    e = {r["g"]: r for r in p["edges"].collect()}
    assert (e["one"]["modifier"], e["one"]["confidence"], e["two"]["modifier"], e["two"]["src"]) == (-0.7, 0.4, 0.0, "a")
    assert {r["g"] for r in p["faults"].collect()} == {"three", "four"} and p["qa"].first()["question"] == "Why?"
    assert p["graphs"].where("g = 'one'").first()["perspective"] == "young"
    with pytest.raises(ValueError):
        graphs.read_graphs(spark, str(tmp_path), strict=True)


def test_latest_agent_graph(spark, tmp_path):
    items = [{"agent_id": "p", "timestamp": t, "graph": {"nodes": {t: {"label": t}}}} for t in ("2024-01-01", "2025-01-01")] + [{"agent_id": "q", "timestamp": "1", "graph": {"nodes": {"n": {}}}}]
    (tmp_path / "all.json").write_text(json.dumps(items))
    found = graphs.parse_graphs(graphs.read_agent_graphs(spark, str(tmp_path)))["nodes"].collect()
    assert sorted((r["g"], r["node"]) for r in found) == [("p", "2025-01-01"), ("q", "n")]


def test_mermaid(spark, tmp_path):
    (tmp_path / "s1.mmd").write_text("```mermaid\nflowchart TD\nn1[A b]\nn2[C]\nn3[D]\nn1 --x n2\nn2 --> n3\nlinkStyle 0 stroke:red\n```\nn9[not this]")
    charts = mermaid.read(spark, str(tmp_path))
    nodes, edges = mermaid.parse(charts)
    assert {(r["node"], r["label"]) for r in nodes.collect()} == {("n1", "A b"), ("n2", "C"), ("n3", "D")}
    assert [(r["src"], r["dst"], r["positive"]) for r in edges.orderBy("ord").collect()] == [("n2", "n3", True), ("n1", "n2", False)]
    fixed = mermaid.repair_link_styles(spark.createDataFrame([("g", "flowchart TD\nn1 --> n2\nn2 --> n3\nlinkStyle 5 x\nlinkStyle 0 y")], "g string, mermaid string")).first()["mermaid"]
    assert "linkStyle 5" not in fixed and "linkStyle 0 y" in fixed and "linkStyle 1" in fixed
    e = spark.createDataFrame([("g", 1, 2, 0, -0.5, 0.9)], "g string, src int, dst int, ord int, modifier double, confidence double")
    assert mermaid.link_styles(e).first()["styles"].strip() == "linkStyle 0 stroke:#c0392b,stroke-width:2px"


def test_text_rules(spark):
    df = spark.createDataFrame([(0, "Rents rise because supply is short."), (1, "It is so dull"), (2, "due to rain"), (3, "Noise, therefore anger; Density leads to noise")], "k int, s string")
    got = {(r["k"], r["cue"]): (r["cause"], r["effect"]) for r in X.causal_pairs(df, "s").collect()}
    assert got[0, "because"] == ("supply is short", "Rents rise") and got[1, "so"] == ("It is", "dull") and (2, "due to") not in got
    assert got[3, "therefore"][0] == "Noise" and (3, "leads to") in got
    assert one(spark, X.sentences(F.col("t")), t="One. Two!\nThree") == ["One.", "Two!", "Three"]
    assert one(spark, X.label_similarity(F.lit("a_b c"), F.lit("C d"))) == pytest.approx(1 / 4)
    assert one(spark, X.salvage_json(F.lit("x {\"a\": 1} y"))) == '{"a": 1}' and one(spark, X.salvage_json(F.lit("none"))) is None
    rated = spark.createDataFrame([("x", "Rating: 12\nA: 9 (high)\nB: no\nC: 1\nC: 2"), ("y", None)], "k string, r string")
    s = {(r["k"], r["code"]): r["score"] for r in X.parse_rating(rated, "k", "r").collect()}
    assert (s["x", "rating"], s["x", "A"], s["x", "B"], s["x", "C"], s["y", "rating"], s["y", "L"]) == (10, 5, 3, 2, 5, 3)
    assert len(s) == 26


def test_metrics(spark):
    assert one(spark, wasserstein(F.array(F.lit(1), F.lit(5)), F.array(F.lit(5), F.lit(2)))) == 0.5
    assert one(spark, bernoulli_kl(F.lit(0.5), F.lit(0.5))) == 0 and one(spark, bernoulli_kl(F.lit(1.0), F.lit(0.0))) > 20
    flat = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    assert flat.agg(safe_corr("x", "y")).first()[0] is None
    m = spark.createDataFrame([("p", "1.1", 3, 5), ("q", "1.1", 7, 7), ("p", "1.2", 1, 10)], "pid string, scenario string, gt int, pred int")
    assert {r["scenario"]: r["mae"] for r in V.mae(m).collect()} == {None: pytest.approx(11 / 3), "1.1": 1.0, "1.2": 9.0}
    assert {r["scenario"]: r["w1"] for r in V.w1_regions(m).collect()} == {"1.1": 1.0, "1.2": 9.0}
    t = spark.createDataFrame([("p", "1.1", "A", 5), ("p", "1.2", "B", 2)], "pid string, scenario string, code string, score int")
    g = spark.createDataFrame([("p", "1.1", "B", 4)], "pid string, scenario string, code string, score int")
    assert sorted(tuple(r)[2:] for r in V.align_reasons(t, g).collect()) == [("A", 5, 0), ("B", 0, 4)]
    assert V.mae(m.limit(0)).where("scenario IS NOT NULL").count() == 0


def test_places(spark):
    text = json.dumps({"grid_config": {"cell_size": 100}, "heightLimits": {"default": 40}, "cells": {"1_2": {"height_limit": 80, "bbox": {"north": 2, "south": 1, "east": 4, "west": 3}}, "0_0": {"category": "x"}}})
    heads, cells = records.parse_proposals(spark.createDataFrame([("p", text)], "g string, text string"))
    got = {r["cell_id"]: r for r in cells.collect()}
    assert heads.first()["cell_size"] == 100 and (got["1_2"]["height_limit"], got["0_0"]["height_limit"], got["1_2"]["category"]) == (80, 40, "unknown")
    geo = json.dumps({"features": [{"properties": {"h": "65-X"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2]]]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}}]})
    zones = records.parse_geojson(spark.createDataFrame([("z", geo)], "g string, text string"))
    assert zones.count() == 3 and [r["height"] for r in records.zoning_heights(zones, ("h", "k")).collect()] == [65]
    body = json.dumps([["B1_001E", "zip code tabulation area"], ["5", "94102"]])
    census = records.parse_census_response(spark.createDataFrame([(body,)], "body string")).first()
    assert (census["zipcode"], census["codes"]) == ("94102", {"B1_001E": "5"})
    ratio = P.census_ratios(P.census_long(spark.createDataFrame([("94102", {"B11004_001E": "5132", "B11004_004E": "344", "X_001E": "0", "X_002E": "x"})], "zipcode string, codes map<string,string>")))
    assert {(r["table_code"], r["sub_code"]): r["ratio"] for r in ratio.collect()}["B11004", "004E"] == pytest.approx(0.067030, abs=1e-6)


def test_survey_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Prolific ID,"Scenario 1.1\nrate","Scenario 1.1: why [supply]"\nx,7,3\nx,9,1\ny,bad,2\n')
    o, r = S.unpivot_scenarios(records.read_survey(spark, str(tmp_path / "s.csv")), "Prolific ID", {"supply": "A"})
    assert [tuple(x) for x in o.collect()] == [("x", "1.1", 7)] and sorted(tuple(x) for x in r.collect()) == [("x", "1.1", "A", 3), ("y", "1.1", "A", 2)]
    sheet = "### Sample 1: Young Tenant Perspective\nHello\n**Decision Structure:**\nx\n### Sample 2: Expert\nHi there\n**Decision Structure:**"
    assert [(x["number"], x["role"], x["description"]) for x in graphs.parse_agent_sheets(spark.createDataFrame([("m", sheet)], "g string, text string")).collect()] == [(1, "Young Tenant Perspective", "Hello"), (2, "Expert", "Hi there")]


def test_runs_and_models(spark, tmp_path):
    agents = spark.createDataFrame([("a", "p", "t"), ("b", "q", "u")], "agent_id string, profile string, transcript string")
    proposals = spark.createDataFrame([("proposal_000", "tall")], "proposal_id string, description string")
    assert {"random", "census_persona", "two_layer", "naive", "transcript", "chain_of_thought", "reflexion", "population_shares", "nearest_cell"} <= set(O.MODELS)
    for name in ("random", "census_persona", "reflexion"):
        rows = O.MODELS[name](agents, proposals)
        got = {(r["agent_id"], r["code"]): r["score"] for r in rows.collect()}
        assert len(got) == 26 and all(3 <= v <= 9 for (_, c), v in got.items() if c == "rating") and got == {(r["agent_id"], r["code"]): r["score"] for r in rows.collect()}
    with pytest.raises(ValueError):
        O.register_model("random")(lambda a, b: a)
    home = records.write_run(str(tmp_path / "runs"), "random", O.MODELS["random"](agents, proposals), metadata={"agents": 2})
    assert records.read_runs(spark, str(tmp_path / "runs")).count() == 26 and spark.read.json(f"{home}/metadata").count() >= 4


def test_reconstruction_is_a_tree_to_the_seed(spark):
    lib = spark.createDataFrame([("M1", ["rent cost", "housing supply", "upzoning stance"], [(0, 1), (1, 2)]), ("M3", ["upzoning stance", "noise level", "view loss"], [(1, 0), (2, 0)]), ("M1", ["jobs growth", "rent cost", "income level"], [(0, 1), (1, 2)])], "grp string, labels array<string>, edges array<struct<s:int,t:int>>")
    got = R.reconstruct(spark.createDataFrame([(1, "upzoning stance"), (2, "nothing alike")], "seed int, label string"), lib).collect()
    assert {r["seed"] for r in got} == {1} and not any(r["src"] == "upzoning_stance" for r in got)
    out = {}
    for r in got:
        out.setdefault(r["src"], set()).add(r["dst"])
    for n in list(out):
        seen, open_ = {n}, [n]
        while open_:
            new = out.get(open_.pop(), set()) - seen
            seen |= new
            open_ += new
        assert "upzoning_stance" in seen


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"chat_id": "c", "ts": "2024-01-01T00:00:00", "turn": 1, "cause": "More_homes", "effect": "lower rent", "question": ""}
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in (row, row | {"effect": "more homes"}, row)))
    stream = lambda: spark.readStream.schema(streaming.DIALOGUE).json(str(src))
    for _ in range(2):
        streaming.ingest(stream(), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    (src / "2.json").write_text(json.dumps(row))
    streaming.ingest(stream(), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    assert [(r["src"], r["dst"], r["n"]) for r in streaming.edges(spark, str(tmp_path / "t")).collect()] == [("more homes", "lower rent", 3)]
