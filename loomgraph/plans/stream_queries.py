"""Queries of the windowed operators, here over whole tables, and of graph documents written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import streaming
from ..operators import dialogue
from ..operators import edges as E
from ..operators import motifs as M
from ..operators import surveys
from ..sources import graphs, participants, records
from ..sources.shared import materialize, shared_dir
from ..streaming import growing
from .fixtures import basket_nodes, table
from .graph_queries import ORACLES as GRAPH
from .graph_queries import WITH, basket_edges
from .survey_queries import CODES, _polygons, _wide
from .survey_queries import ORACLES as SURVEY


def _documents(spark, d, layout):
    e = basket_edges(spark, d)
    return materialize(layout(basket_nodes(spark, d), e).withColumnRenamed("json", "text"), "documents")


def _events(spark, d):
    return table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _relations(spark, d):
    p = table(spark, d, "part")
    rows = p.select((F.col("p_partkey") % 40).cast("string").alias("chat_id"), F.lit(None).cast("timestamp").alias("ts"), F.upper("p_type").alias("cause"), F.concat_ws("_", "p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size").cast("string"))).alias("effect"))
    return streaming.relations(rows).groupBy("chat_id", "src", "dst").agg(F.count("*").alias("n"))


def _dialogues(spark, d):
    """Each customer's lines as questions of a dialogue, with two relations between the part's type, its brand and the line's flag."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_discount")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    relation = lambda a, b, c: F.struct(a.alias("source"), b.alias("target"), c.alias("confidence"), (F.col("l_returnflag") != "R").alias("positive"))
    relations = F.array(relation(F.col("p_type"), F.col("p_brand"), F.col("l_discount")), relation(F.upper("p_brand"), F.col("l_returnflag"), F.lit(0.5)))
    turn = F.row_number().over(W.partitionBy("chat_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    # texts come last, so that they move once, and lines are dealt by the dialogue that they are read by
    said = line.join(orders, "l_orderkey").join(part, "l_partkey").withColumn("chat_id", F.col("o_custkey").cast("string"))
    return said.select("chat_id", turn.alias("turn"), "ts", relations.alias("relations"))


def _transcripts(spark, d):
    """Conversations as CSV transcripts with quoted cells, every seventh without its participant's id, parsed again."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    qa = dialogue.qa_pairs(table(spark, d, "conversations"))
    record = F.concat_ws(",", quoted(F.col("answer")), F.col("turn").cast("string"), quoted(F.col("question")))
    listed = qa.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", record.alias("r")))), lambda x: x["r"]), "\n").alias("body"))
    head = F.when(F.col("conv_id") % 7 == 0, "Name,nobody").otherwise(F.concat(F.lit("Prolific ID,p"), F.col("conv_id").cast("string")))
    docs = listed.select(F.col("conv_id").cast("string").alias("g"), F.concat(head, F.lit("\nAnswer,Question Number,Question\n"), "body").alias("text"))
    parsed = participants.parse_transcripts(docs)
    failed = parsed["failed"].select("g", F.lit(0).cast("bigint").alias("answers"), F.lit("").alias("question_md5"), F.lit("").alias("answer_md5"), "fault")
    together = lambda c: F.md5(F.array_join(F.array_sort(F.collect_list(F.md5(c))), ","))
    return parsed["answers"].groupBy("g").agg(F.count("*").alias("answers"), together("question").alias("question_md5"), together("answer").alias("answer_md5"), F.lit("").alias("fault")).unionByName(failed)


def _survey_agents(spark, d):
    """Customers as rows of a survey, some with ages or ZIP codes that are no numbers."""
    c = table(spark, d, "customer")
    key, text = F.col("c_custkey"), {f: F.col("c_mktsegment") for f in participants.CSV_FIELDS}
    text |= {"age": F.when(key % 11 == 0, "unknown").otherwise((18 + key % 60).cast("string")), "has children under 18": F.when(key % 3 == 0, "Yes, one").otherwise("No")}
    zipcode = F.when(key % 13 == 0, "94102.5").otherwise(F.concat(F.lit(" "), (94100 + key % 40).cast("string")))
    answers = c.select(key.cast("string").alias("Prolific ID"), zipcode.alias(participants.ZIP_QUESTION), *(v.alias(participants.QUESTIONS[f]) for f, v in text.items()))
    found = participants.agents_from_answers(answers)
    near = F.lit(False)
    for z, lat, lng in participants.ZIP_CENTRES:
        near = near | ((F.col("zip") == z) & (F.abs(F.col("lat") - lat) <= 0.003) & (F.abs(F.col("lng") - lng) <= 0.003))
    agents = found["agents"].select("agent_id", "zip", near.alias("at_centre"), F.col("agent")["age"].cast("int").alias("age"), F.col("agent")["has children under 18"].alias("children"), F.lit("").alias("fault"))
    return agents.unionByName(found["bad"].select("agent_id", F.lit("").alias("zip"), F.lit(False).alias("at_centre"), F.lit(0).alias("age"), F.lit("").alias("children"), "fault"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _validated(spark, d):
    """Basket graphs as structural samples: some lack an id, have another number of nodes or edges than is said, or no questions."""
    e = basket_edges(spark, d)
    n = e.groupBy("g").agg(F.count("*").alias("n"))
    docs = graphs.graph_json(basket_nodes(spark, d), e).join(n, "g")
    asked = F.when(F.col("g") % 2 == 0, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).otherwise(F.lit(0)).cast("int")
    head = F.concat(F.lit("{"), F.when(F.col("g") % 5 > 0, F.concat(F.lit('"agent_id":"'), F.col("g").cast("string"), F.lit('",'))).otherwise(F.lit("")), F.lit('"qas":['), F.array_join(F.array_repeat(F.lit('"q"'), asked), ","), F.lit("],"))
    text = F.concat(head, F.substr("json", F.lit(2)))
    return graphs.validate_samples(docs.select("g", text.alias("text"), (25 + (F.col("g") % 3 == 0).cast("int")).alias("expected_nodes"), (F.col("n") + F.col("g") % 4).alias("expected_edges")))


def _zones_parsed(spark, d):
    """The polygons as GeoJSON, a document for each nation, parsed again."""
    rings = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.struct(F.col("zone_id").cast("string").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")).alias("geometry"))
    zones = _polygons(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("zone_id"), "s_nationkey"), "zone_id")
    docs = zones.groupBy(F.col("s_nationkey").cast("string").alias("g")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("text"))
    parsed = records.parse_geojson(docs)
    points = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring))
    return parsed.select("g", F.col("properties")["name"].alias("name"), F.size("rings").alias("rings"), points.alias("points"), F.round(F.array_min("ring.x"), 9).alias("west"), F.round(F.array_max("ring.y"), 9).alias("north"))


def _survey_file(spark, d):
    """The survey's wide table written as CSV files and read again."""
    path = _folder(spark, "survey")
    _wide(spark, d).write.option("header", True).csv(path)
    return surveys.unpivot_scenarios(records.read_survey(spark, path), "Prolific ID", CODES)[0].withColumn("pid", F.col("pid").cast("bigint"))


def _runs(spark, d):
    """Opinions of customers written as two models' runs and read again."""
    k = F.col("c_custkey")
    opinions = table(spark, d, "customer").select(k.cast("string").alias("agent_id"), F.format_string("proposal_%03d", k % 3).alias("proposal_id"), F.lit("A").alias("code"), (k % 5 + 1).cast("int").alias("score"))
    path = _folder(spark, "runs")
    for model, part in (("even", opinions.where("agent_id % 2 = 0")), ("odd", opinions.where("agent_id % 2 = 1"))):
        records.write_run(path, model, part)
    return records.read_runs(spark, path).select(F.substring_index("run", "_", 1).alias("model"), "agent_id", "proposal_id", "code", "score")


def _library_read(spark, d):
    """A library of parts as motifs, written and read again."""
    path = _folder(spark, "library")
    p = table(spark, d, "part")
    graphs.write_library(p.select(F.concat(F.when(F.col("p_size") > 25, "M1_").otherwise("M2.1_"), F.col("p_type")).alias("grp"), F.col("p_partkey").alias("ord"), F.array("p_name", "p_brand").alias("labels")), path)
    return graphs.read_library(spark, path).select("motif_type", "grp", "ord", F.array_join("labels", "/").alias("labels"))


QUERIES = {
    "samples_validated": _validated,
    "zones_parsed": _zones_parsed,
    "survey_file_opinions": _survey_file,
    "runs_read": _runs,
    "library_read": _library_read,
    "transcripts_parsed": _transcripts,
    "survey_agents": _survey_agents,
    "dialogue_growth": lambda s, d: growing.grown(_dialogues(s, d)),
    "event_windows": lambda s, d: streaming.windowed(_events(s, d), "ts", "event_type", "1 hour").withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm"), "total": F.round("total", 2)}),
    "event_sessions": lambda s, d: streaming.sessions(_events(s, d), "ts", "user_id", "2 hours").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start")),
    "dialogue_relations": _relations,
    "json_edges_by_id": lambda s, d: graphs.parse_graphs(_documents(s, d, graphs.graph_json))["edges"].select("g", "edge", "src", "dst", "modifier", "confidence"),
    "json_edges_by_list": lambda s, d: graphs.parse_graphs(_documents(s, d, graphs.graph_lists))["edges"].select("g", "edge", "src", "dst", "modifier", "confidence"),
    "json_nodes": lambda s, d: graphs.parse_graphs(_documents(s, d, graphs.graph_json))["nodes"].select("g", "node", "label", "norm_label", "is_stance"),
    "json_motifs": lambda s, d: M.chains(materialize(E.dedupe(graphs.parse_graphs(_documents(s, d, graphs.graph_json))["edges"].withColumns({"src": F.col("src").cast("int"), "dst": F.col("dst").cast("int")})), "parsed")),
}
_NORMAL = "trim(replace(lower({}), '_', ' '))"
_CENTRES = ", ".join(f"'{z}'" for z, *_ in participants.ZIP_CENTRES)
ORACLES = {
    "samples_validated": WITH + """, c AS (SELECT g, count(*) AS n FROM e GROUP BY g),
      f AS (SELECT g, unnest([CASE WHEN g % 5 = 0 THEN 'no agent_id' END, CASE WHEN g % 3 = 0 THEN 'node count' END, CASE WHEN g % 4 = 3 THEN 'edge count' END, CASE WHEN g % 2 = 1 THEN 'too few questions' END]) AS fault FROM c)
      SELECT g, fault FROM f WHERE fault IS NOT NULL""",
    "zones_parsed": """WITH z AS (SELECT s_nationkey, s_suppkey AS k, 37.70::DOUBLE + (s_suppkey * 17 % 89) / 89.0::DOUBLE * 0.05::DOUBLE AS south, -122.50::DOUBLE + (s_suppkey * 29 % 97) / 97.0::DOUBLE * 0.1::DOUBLE AS west FROM supplier)
      SELECT s_nationkey::VARCHAR AS g, k::VARCHAR AS name, CASE k % 3 WHEN 1 THEN 2 ELSE 1 END AS rings, [4, 8, 6][k % 3 + 1] AS points, round(west, 9) AS west, round(south + 0.004 + (k % 5) * 0.002, 9) AS north FROM z""",
    "survey_file_opinions": SURVEY["survey_opinions"],
    "runs_read": "SELECT CASE c_custkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS model, c_custkey::VARCHAR AS agent_id, 'proposal_00' || (c_custkey % 3) AS proposal_id, 'A' AS code, CAST(c_custkey % 5 + 1 AS INT) AS score FROM customer",
    "library_read": "SELECT CASE WHEN p_size > 25 THEN 'M1' ELSE 'M2.1' END AS motif_type, CASE WHEN p_size > 25 THEN 'M1_' ELSE 'M2.1_' END || p_type AS grp, p_partkey AS ord, p_name || '/' || p_brand AS labels FROM part",
    "transcripts_parsed": r"""WITH t AS (SELECT conv_id, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      q AS (SELECT conv_id, regexp_replace(question, '^\s+|\s+$', '', 'g') AS question, regexp_replace(answer, '^\s+|\s+$', '', 'g') AS answer FROM t WHERE role = 'user' AND next_role = 'assistant'),
      k AS (SELECT conv_id, question, answer FROM q WHERE question <> '' AND length(answer) >= 2 AND NOT starts_with(lower(question), 'question number') AND conv_id % 7 <> 0)
      SELECT conv_id::VARCHAR AS g, count(*) AS answers, md5(string_agg(md5(question), ',' ORDER BY md5(question))) AS question_md5, md5(string_agg(md5(answer), ',' ORDER BY md5(answer))) AS answer_md5, '' AS fault FROM k GROUP BY conv_id
      UNION ALL SELECT DISTINCT conv_id::VARCHAR, 0, '', '', 'no Prolific ID' FROM q WHERE conv_id % 7 = 0""",
    "survey_agents": f"""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (94100 + c_custkey % 40)::VARCHAR END AS zip, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 18 + c_custkey % 60 END AS age FROM customer)
      SELECT k::VARCHAR AS agent_id, zip, zip IN ({_CENTRES}) AS at_centre, age, CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END AS children, '' AS fault FROM a WHERE zip IS NOT NULL AND age IS NOT NULL
      UNION ALL SELECT k::VARCHAR, '', false, 0, '', CASE WHEN zip IS NULL THEN 'ZIP code' ELSE 'age' END FROM a WHERE zip IS NULL OR age IS NULL""",
    "dialogue_growth": f"""WITH q AS (SELECT o_custkey::VARCHAR AS chat, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS turn, p_type AS a, p_brand AS b, upper(p_brand) AS b2, l_returnflag AS f, l_discount AS c
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
      t AS (SELECT chat, count(*) AS n FROM q GROUP BY chat),
      r AS (SELECT chat, turn, 0 AS place, a AS s, b AS d, c, f <> 'R' AS up FROM q UNION ALL SELECT chat, turn, 1, b2, f, 0.5, f <> 'R' FROM q),
      x AS (SELECT r.*, n, turn <= n - n % 3 AS merged, row_number() OVER (PARTITION BY r.chat ORDER BY turn, place) AS edge FROM r JOIN t ON t.chat = r.chat WHERE s <> d),
      v AS (SELECT chat, edge, merged, 0 AS side, s AS label, 2 * edge - 1 AS node FROM x UNION ALL SELECT chat, edge, merged, 1, d, 2 * edge FROM x),
      k AS (SELECT *, min(node) OVER w AS id, first_value(label) OVER (w ORDER BY node) AS name FROM v WINDOW w AS (PARTITION BY chat, merged, CASE WHEN merged THEN {_NORMAL.format('label')} ELSE node::VARCHAR END)),
      m AS (SELECT x.chat, x.edge, a.id AS src, b.id AS dst, a.name AS src_label, b.name AS dst_label, x.c AS confidence, CASE WHEN up THEN x.c ELSE -x.c END AS modifier
        FROM x JOIN k a ON a.chat = x.chat AND a.edge = x.edge AND a.side = 0 JOIN k b ON b.chat = x.chat AND b.edge = x.edge AND b.side = 1 WHERE a.id <> b.id)
      SELECT t.chat AS chat_id, n AS questions, 0 AS late, edge, src, dst, src_label, dst_label, confidence, modifier FROM t LEFT JOIN m ON m.chat = t.chat""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM b GROUP BY user_id, s""",
    "dialogue_relations": "WITH r AS (SELECT (p_partkey % 40)::VARCHAR AS chat_id, lower(p_type) AS src, trim(replace(lower(p_type || CASE WHEN p_partkey % 3 > 0 THEN '_' || p_size ELSE '' END), '_', ' ')) AS dst FROM part) SELECT chat_id, src, dst, count(*) AS n FROM r WHERE src <> dst GROUP BY 1, 2, 3",
    "json_edges_by_id": WITH + " SELECT g, 'e' || o AS edge, s::VARCHAR AS src, t::VARCHAR AS dst, m AS modifier, c AS confidence FROM e",
    "json_edges_by_list": WITH + " SELECT g, o::VARCHAR AS edge, s::VARCHAR AS src, t::VARCHAR AS dst, m AS modifier, c AS confidence FROM e",
    "json_nodes": WITH + " SELECT g, node::VARCHAR AS node, label, label AS norm_label, false AS is_stance FROM n",
    "json_motifs": GRAPH["motif_m1"],
}
