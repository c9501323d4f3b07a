"""Queries that make motif libraries grow, rebuild graphs from them, and run opinion models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import uniform_sql
from ..functions.text import REASON_CODES
from ..operators import augmentation as A
from ..operators import edges as E
from ..operators import merging as G
from ..operators import models as O
from ..operators import motifs as M
from ..operators import reconstruction as R
from ..sources.shared import materialize
from .fixtures import WITH_TRADE as WITH
from .fixtures import held_trade_edges as trade_edges
from .fixtures import table, trade_nodes
from .graph_queries import _INSTANCES, basket_edges
from .graph_queries import WITH as WITH_BASKET
from .inference_queries import _CONTINUOUS, _PAR, _REC, PRIOR, _net
from .survey_queries import _AG, _GRID, _agents, _cells


def _members(spark, d):
    """Parts as motifs of three nodes, in groups by their type."""
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("M1_"), F.col("p_type")).alias("grp"), F.col("p_partkey").alias("ord"), F.array("p_name", F.concat_ws(" ", "p_brand", "p_name"), F.lower("p_type")).alias("labels"))


def _library(spark, d):
    """Every type of motif of the trade graphs, with the nations' labels."""
    found = materialize(M.extract(M.instances(trade_edges(spark, d))), "instances")
    named = found.select("g", "motif", F.array_join("nodes", ",").alias("id"), F.posexplode("nodes").alias("i", "node")).join(trade_nodes(spark, d), ["g", "node"])
    labels = named.groupBy("g", "motif", "id").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("ls"))
    pair = lambda s, t: F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"))
    leaves = F.sequence(F.lit(1), F.size("ls") - 1)
    chain = F.array(pair(F.lit(0), F.lit(1)), pair(F.lit(1), F.lit(2)))
    fork, collider = F.transform(leaves, lambda i: pair(F.lit(0), i)), F.transform(leaves, lambda i: pair(i, F.lit(0)))
    edges = F.when(F.col("motif") == "M1", chain).when(F.col("motif").startswith("M2"), fork).otherwise(collider)
    return labels.select(F.concat_ws("-", "motif", F.col("g").cast("string")).alias("grp"), F.transform("ls", lambda x: x["label"]).alias("labels"), edges.alias("edges"))


def _motifs(spark, d):
    """Suppliers with demographics."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("motif"), F.when(k % 5 == 0, "young").when(k % 5 == 1, "middle_aged").when(k % 5 == 2, "urban").when(k % 11 == 0, "unknown").otherwise("elderly").alias("demographic"))


def _candidates(spark, d):
    """The nodes of every trade graph against those of every graph as motifs; both are known by year and nation."""
    key = F.col("g") * 100 + F.col("node")
    n = materialize(trade_nodes(spark, d).join(E.degrees(trade_edges(spark, d)), ["g", "node"]), "nodes")
    size = F.col("in_degree") + F.col("out_degree")
    nodes = n.select(key.alias("motif"), F.lit(0).alias("at"), "label", "in_degree", "out_degree", size.alias("n_edges"), (size + 1).alias("n_nodes"), (F.col("node") % 4).alias("n_new"))
    return R.candidates(n.select(key.alias("node"), "label", "in_degree", "out_degree"), nodes)


def _proposals(spark, d):
    return table(spark, d, "region").select(F.format_string("proposal_%03d", F.col("r_regionkey")).alias("proposal_id"), F.concat(F.lit("Taller buildings in "), F.col("r_name")).alias("description"))


def _personas(spark, d):
    return _agents(spark, d).select("agent_id", "lat", "lng", F.col("c_mktsegment").alias("profile"), F.concat(F.lit("I work in "), F.lower("c_mktsegment")).alias("transcript"))


def _model(name):
    return lambda s, d: O.MODELS[name](_personas(s, d), _proposals(s, d))


def _demographic_stats(spark, d):
    n = _motifs(spark, d).groupBy("demographic").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(_all()), 6))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def _diverse(spark, d):
    c = _candidates(spark, d).withColumns({"grp": F.col("motif") % 6, "demographic": F.col("motif") % 3, "demo_score": (F.col("motif") % 5) / 5.0})
    return R.diverse_top(R.diverse_score(c, 0.3)).select("node", "motif", F.round("score", 6).alias("score"), "rank")


def _vector_nodes(spark, d):
    """Trade nodes with vectors of the embeddings table; every third has the vector of the one before."""
    v = table(spark, d, "embeddings").where("vec_id < 25").select(F.col("vec_id").cast("int").alias("k"), F.col("embedding").alias("vector"))
    n = trade_nodes(spark, d).withColumn("k", F.when(F.col("node") % 3 == 2, F.col("node") - 1).otherwise(F.col("node")))
    return n.join(v, "k").select("g", "node", "label", "vector", F.col("node").alias("ord"))


def _merged_groups(spark, d):
    n = trade_nodes(spark, d).select("g", "node", "label", F.array(F.concat(F.lit("q"), (F.col("node") % 4).cast("string")), F.lit("q0")).alias("source_qa"))
    mapping = n.where("node % 3 = 2").select("g", F.col("node").alias("old"), (F.col("node") - 1).alias("new"))
    return G.merge_groups(n, mapping).withColumn("source_qa", F.array_join("source_qa", ","))


def _narratives(spark, d):
    places = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("neighborhood"), F.concat(F.lit("kind"), (F.col("s_suppkey") % 3).cast("string")).alias("kind"), F.col("s_name").alias("name"))
    return G.narratives(table(spark, d, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_nationkey").cast("string").alias("neighborhood")), places)


QUERIES = {
    "nodes_merged_by_vector": lambda s, d: G.vector_leaders(_vector_nodes(s, d)),
    "edges_merged_by_vector": lambda s, d: G.merge_similar(_vector_nodes(s, d), trade_edges(s, d)).select("g", "src", "dst", "modifier"),
    "nodes_merged_in_groups": _merged_groups,
    "stance_links": lambda s, d: G.stance_links(_vector_nodes(s, d), trade_edges(s, d), [2.0] * 8 + [0.0] * 56).withColumn("weight", F.round("weight", 6)),
    "place_narratives": _narratives,
    "transcripts_copied": lambda s, d: G.copy_transcripts(table(s, d, "supplier").select(F.col("s_suppkey").alias("agent_id")), "Q: Why? A: Because."),
    "augmented_by_neighbour": lambda s, d: A.by_neighbour(_members(s, d), 5).withColumn("labels", F.array_join("labels", "|")),
    "augmented_by_bootstrap": lambda s, d: A.by_bootstrap(_members(s, d), 5).withColumn("labels", F.array_join("labels", "|")),
    "augmented_summary": lambda s, d: A.summary(A.library(m := materialize(_members(s, d), "members"), A.by_neighbour(m, 5), A.by_bootstrap(m, 5))),
    "demographic_stats": _demographic_stats,
    "demographic_scores": lambda s, d: R.demographic_scores(_motifs(s, d), "middle_aged").withColumn("score", F.round("score", 6)),
    "library_summary": lambda s, d: materialize(_library(s, d), "library").groupBy(F.substring_index("grp", "-", 1).alias("motif_type")).agg(F.count("*").alias("instances"), F.countDistinct("grp").alias("groups")),
    "reconstruction_candidates": lambda s, d: _candidates(s, d).select("node", "motif", "at", *(F.round(c, 6).alias(c) for c in ("similarity", "fit", "cover", "forward", "reverse"))),
    "reconstruction_diverse": _diverse,
    "reconstructed_graphs": lambda s, d: R.reconstruct(table(s, d, "nation").select("n_nationkey", F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("label")), _library(s, d), "n_nationkey"),
    **{f"model_{m}": _model(m) for m in ("random", "population_shares", "census_persona", "two_layer", "naive", "transcript", "chain_of_thought", "reflexion")},
    "model_nearest_cell": lambda s, d: O.MODELS["nearest_cell"](_personas(s, d), _cells(s, d)),
    "model_belief_net": lambda s, d: O.belief_net(e := basket_edges(s, d), e.groupBy("g").agg(F.max("dst").alias("node")), {0: 0.9}, 0.1),
}

_DEMO = "dm AS (SELECT s_suppkey AS motif, CASE WHEN s_suppkey % 5 = 0 THEN 'young' WHEN s_suppkey % 5 = 1 THEN 'middle_aged' WHEN s_suppkey % 5 = 2 THEN 'urban' WHEN s_suppkey % 11 = 0 THEN 'unknown' ELSE 'elderly' END AS demographic FROM supplier)"
_CAND = WITH + """, d AS (SELECT g, node, CAST(sum(i) AS BIGINT) AS ind, CAST(sum(o) AS BIGINT) AS outd FROM (SELECT g, s AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT g, t, 1, 0 FROM e) GROUP BY g, node),
w AS (SELECT n.g, n.node, ind, outd, string_split(label, ' ') AS ws FROM n JOIN d USING (g, node)),
p AS (SELECT f.g * 100 + f.node AS node, m.g * 100 + m.node AS motif, len(list_intersect(f.ws, m.ws))::DOUBLE / len(list_distinct(list_concat(f.ws, m.ws))) AS similarity, greatest(0, m.ind - f.ind) AS di, greatest(0, m.outd - f.outd) AS dd, m.ind + m.outd AS ne, m.node % 4 AS nn FROM w f, w m),
c AS (SELECT node, motif, 0 AS "at", similarity, di::DOUBLE / ne AS fit, nn::DOUBLE / (ne + 1) AS cover, 0.6 * similarity + 0.4 * (di + dd)::DOUBLE / ne AS forward, 0.4 * similarity + 0.3 * di::DOUBLE / ne + 0.3 * nn::DOUBLE / (ne + 1) AS reverse FROM p WHERE similarity >= 0.4)"""
_MEMBERS = "m AS (SELECT 'M1_' || p_type AS grp, p_partkey AS ord, [p_name, p_brand || ' ' || p_name, lower(p_type)] AS labels FROM part)"
_ASKED = "ag AS (SELECT c_custkey AS agent_id, c_mktsegment AS profile, 'I work in ' || lower(c_mktsegment) AS transcript FROM customer), pr AS (SELECT printf('proposal_%03d', r_regionkey) AS proposal_id, 'Taller buildings in ' || r_name AS description FROM region)"
_CODES = ["rating", *REASON_CODES]


def _word_sql(side: str, key: str) -> str:
    return f"string_split({side}, ' ')[CAST(floor({uniform_sql(key, 'grp', 's', 'i - 1')} * len(string_split({side}, ' '))) AS BIGINT) + 1]"


def _byte_sql(prompt: str, n: int) -> str:
    return f"('0x' || substr(sha256({prompt}), {2 * n + 1}, 2))::INT"


def _scores_sql(prompt: str) -> list[str]:
    """What the offline provider answers, for each code."""
    return [f"CAST({3 if n == 0 else 2} + {_byte_sql(prompt, n)} % {7 if n == 0 else 3} AS INT)" for n in range(len(_CODES))]


def _model_sql(name: str, columns: str, calls: int = 1) -> str:
    said = " || chr(10) || ".join(f"'{c.replace('rating', 'Rating')}: ' || {v}" for c, v in zip(_CODES, _scores_sql("prompt"), strict=True))
    ctes = [_ASKED, f"q0 AS (SELECT agent_id, proposal_id, '{name}' || chr(10) || concat_ws(chr(10), {columns}, 'Give Rating: 1 to 10, then A to L: 1 to 5.') AS prompt FROM ag, pr)"]
    ctes += [f"q{n} AS (SELECT agent_id, proposal_id, prompt || chr(10) || 'Your answer {n} was:' || chr(10) || {said} || chr(10) || 'Think it over.' AS prompt FROM q{n - 1})" for n in range(1, calls)]
    return f"WITH {', '.join(ctes)} SELECT agent_id::VARCHAR AS agent_id, proposal_id, unnest({_CODES}) AS code, unnest([{', '.join(_scores_sql('prompt'))}]) AS score FROM q{calls - 1}"


ORACLES = {
    "augmented_by_neighbour": f"""WITH {_MEMBERS}, pl AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS pos FROM m), gs AS (SELECT grp, n, unnest(range(1, 6)) AS s FROM pl WHERE n > 1 AND pos = 0),
      da AS (SELECT *, CAST(floor({uniform_sql("'base'", 'grp', 's')} * n) AS BIGINT) AS a FROM gs), db AS (SELECT *, (a + 1 + CAST(floor({uniform_sql("'other'", 'grp', 's')} * (n - 1)) AS BIGINT)) % n AS b FROM da),
      x AS (SELECT db.grp, db.s, u.ord AS base, v.ord AS other, i, u.labels[i] AS one, v.labels[i] AS two FROM db JOIN pl u ON u.grp = db.grp AND u.pos = a JOIN pl v ON v.grp = db.grp AND v.pos = b, (VALUES (1), (2), (3)) k(i))
      SELECT grp, s AS "sample", base, other, string_agg(CASE WHEN {uniform_sql("'borrow'", 'grp', 's')} < {A.BORROW} AND {uniform_sql("'node'", 'grp', 's', 'i - 1')} < {A.CHANGE_NODE} AND contains(one, ' ') AND contains(two, ' ')
        THEN {_word_sql('one', "'w1'")} || ' ' || {_word_sql('two', "'w2'")} ELSE one END, '|' ORDER BY i) AS labels FROM x GROUP BY 1, 2, 3, 4""",
    "augmented_by_bootstrap": f"""WITH {_MEMBERS}, l AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos FROM (SELECT DISTINCT unnest(labels) AS label FROM m) WHERE label <> ''), f AS (SELECT grp, arg_min(labels, ord) AS labels FROM m GROUP BY grp),
      sl AS (SELECT grp, s, i, labels[i + 1] AS label, CASE WHEN {uniform_sql("'keep'", 'grp', 's', 'i')} < {A.REPLACE} THEN CAST(floor({uniform_sql("'label'", 'grp', 's', 'i')} * (SELECT count(*) FROM l)) AS BIGINT) END AS pos FROM f, range(1, 6) a(s), (VALUES (0), (1), (2)) k(i))
      SELECT grp, s AS "sample", string_agg(coalesce(l.label, sl.label), '|' ORDER BY i) AS labels FROM sl LEFT JOIN l USING (pos) GROUP BY 1, 2""",
    "model_nearest_cell": f"""WITH {_GRID}, {_AG}, dd AS (SELECT agent_id, proposal_id, height_limit AS h, row_number() OVER (PARTITION BY agent_id, proposal_id ORDER BY sqrt((lat - (north + south) / 2) ** 2 + (lng - (east + west) / 2) ** 2), cell_id) AS k FROM ag, cells)
      SELECT agent_id, proposal_id, 'rating' AS code, CASE WHEN h <= 65 THEN 8 WHEN h <= 130 THEN 5 ELSE 3 END AS score FROM dd WHERE k = 1""",
    "model_random": f"""WITH {_ASKED}, c AS (SELECT agent_id, proposal_id, unnest({_CODES}) AS code FROM ag, pr), u AS (SELECT *, {uniform_sql('agent_id', 'proposal_id', 'code')} AS u FROM c)
      SELECT agent_id, proposal_id, code, CAST(CASE WHEN code = 'rating' THEN 3 + floor(u * 7) ELSE 2 + floor(u * 3) END AS INT) AS score FROM u""",
    "model_population_shares": f"WITH {_ASKED}, u AS (SELECT agent_id, proposal_id, {uniform_sql('agent_id', 'proposal_id')} AS u FROM ag, pr) SELECT agent_id, proposal_id, 'rating' AS code, CASE WHEN u < 0.6 THEN 8 WHEN u < 0.9 THEN 3 ELSE 5 END AS score FROM u",
    "model_census_persona": _model_sql("census_persona", "profile, description"),
    "model_two_layer": _model_sql("two_layer", "profile, description", 2),
    "model_naive": _model_sql("naive", "description"),
    "model_transcript": _model_sql("transcript", "transcript, description"),
    "model_chain_of_thought": _model_sql("chain_of_thought", "profile, description, 'Think step by step.'"),
    "model_reflexion": _model_sql("reflexion", "profile, description", 3),
    "model_belief_net": _REC + _PAR + _net(_CONTINUOUS, "a", False, f"CASE WHEN i = 0 THEN 0.9::DOUBLE ELSE {PRIOR}::DOUBLE END") + " SELECT g, CAST(round_even(p * 10, 0) AS INT) AS rating FROM a JOIN (SELECT g, max(t) AS node FROM e GROUP BY g) USING (g, node)",
    "nodes_merged_by_vector": WITH + " SELECT g, node AS old, node - 1 AS new FROM n WHERE node % 3 = 2",
    "edges_merged_by_vector": WITH + " SELECT g, s AS src, t AS dst, m AS modifier FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY o DESC) AS k FROM (SELECT g, CASE WHEN s % 3 = 2 THEN s - 1 ELSE s END AS s, CASE WHEN t % 3 = 2 THEN t - 1 ELSE t END AS t, m, o FROM e) WHERE s <> t) WHERE k = 1",
    "nodes_merged_in_groups": WITH + """, q AS (SELECT g, CASE WHEN node % 3 = 2 THEN node - 1 ELSE node END AS id, node, label, unnest(['q' || (node % 4), 'q0']) AS qa FROM n)
      SELECT g, id AS node, coalesce(max(label) FILTER (node = id), min(label)) AS label, array_to_string(list_sort(list(DISTINCT qa)), ',') AS source_qa, max(node % 3 = 2) AS merged FROM q GROUP BY g, id""",
    "stance_links": WITH + f""", st AS (SELECT list_concat(list_transform(range(8), lambda i: 2.0::DOUBLE), list_transform(range(56), lambda i: 0.0::DOUBLE)) AS sv), vn AS (SELECT g, node, embedding::DOUBLE[] AS v FROM n JOIN embeddings ON vec_id = CASE WHEN node % 3 = 2 THEN node - 1 ELSE node END WHERE vec_id < 25),
      c AS (SELECT g, node, list_dot_product(v, sv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(sv, sv))) AS w FROM vn, st), nr AS (SELECT g, node, w AS weight FROM c WHERE w > 0.6),
      dg AS (SELECT g, node, count(*) AS d FROM (SELECT g, s AS node FROM e UNION ALL SELECT g, t FROM e) GROUP BY g, node), fb AS (SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY d DESC, node) AS k FROM dg WHERE g NOT IN (SELECT g FROM nr))
      SELECT g, node, round(weight, 6) AS weight FROM nr UNION ALL SELECT g, node, 1.0 FROM fb WHERE k <= 5""",
    "place_narratives": """WITH r AS (SELECT s_nationkey AS nb, 'kind' || (s_suppkey % 3) AS kind, s_name AS name, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_name) AS k FROM supplier), o AS (SELECT nb, kind, string_agg(name, ', ' ORDER BY name) AS names FROM r WHERE k <= 5 GROUP BY nb, kind),
      l AS (SELECT nb, string_agg(kind || ': ' || names, '. ' ORDER BY kind) AS ls FROM o GROUP BY nb) SELECT c_custkey AS agent_id, 'You live in ' || c_nationkey || CASE WHEN ls IS NULL THEN '' ELSE '. ' || ls END AS narrative FROM customer LEFT JOIN l ON nb = c_nationkey""",
    "library_summary": _INSTANCES.replace(WITH_BASKET, WITH, 1) + """ SELECT motif AS motif_type, count(*) AS instances, count(DISTINCT g) AS groups FROM (SELECT *, row_number() OVER (PARTITION BY g, motif ORDER BY nodes) AS rank FROM
      (SELECT *, max(len(nodes)) OVER (PARTITION BY g, motif[1:2], center) AS m FROM inst) WHERE motif = 'M1' OR len(nodes) = m) WHERE rank <= 30 GROUP BY motif""",
    "transcripts_copied": "SELECT s_suppkey AS agent_id, 'Q: Why? A: Because.' AS transcript FROM supplier",
    "demographic_stats": f"WITH {_DEMO} SELECT demographic, count(*) AS n, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM dm GROUP BY demographic",
    "demographic_scores": f"WITH {_DEMO} SELECT demographic, round(0.3 * (1 - count(*)::DOUBLE / sum(count(*)) OVER ()) + 0.7 * CASE demographic WHEN 'unknown' THEN 0 WHEN 'middle_aged' THEN 1 WHEN 'young' THEN 0.6 WHEN 'elderly' THEN 0.6 ELSE 0.2 END, 6) AS score FROM dm GROUP BY demographic",
    "augmented_summary": "WITH p AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) SELECT 'original' AS method, count(*) AS groups, CAST(sum(n) AS BIGINT) AS motifs FROM p UNION ALL SELECT 'nearest_neighbor', count(*), count(*) * 5 FROM p WHERE n > 1 UNION ALL SELECT 'bootstrapping', count(*), count(*) * 5 FROM p",
    "reconstruction_candidates": _CAND + " SELECT node, motif, \"at\", round(similarity, 6) AS similarity, round(fit, 6) AS fit, round(cover, 6) AS cover, round(forward, 6) AS forward, round(reverse, 6) AS reverse FROM c",
    "reconstruction_diverse": _CAND + """, x AS (SELECT *, motif % 6 AS grp, row_number() OVER (PARTITION BY node, motif % 6 ORDER BY similarity DESC, motif % 6, motif) AS a, row_number() OVER (PARTITION BY node, motif % 3 ORDER BY similarity DESC, motif % 6, motif) AS b FROM c),
      y AS (SELECT *, 0.7 * (0.4 * similarity + 0.2 * fit + 0.2 * cover + CASE WHEN a = 1 THEN 0.2 ELSE 0 END) + 0.3 * (0.8 * (motif % 5) / 5.0 + CASE WHEN b = 1 THEN 0.2 ELSE 0 END) AS score FROM x),
      z AS (SELECT *, row_number() OVER (PARTITION BY node, grp ORDER BY score DESC, motif) AS k FROM y) SELECT node, motif, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, grp) AS rank FROM z WHERE k = 1) WHERE rank <= 5""",
}
