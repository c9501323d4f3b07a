"""Queries over the basket graphs: edges, motifs, roles, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import hubs as H
from ..operators import motifs as M
from ..operators import reconstruction as R
from ..sources.shared import materialize
from .fixtures import BASKET, WITH_TRADE, basket_nodes, held_trade_edges, table, trade_edges
from .fixtures import basket_edges as _basket_edges

WITH = f"WITH {BASKET}"
_NEAR = "EXISTS (SELECT 1 FROM e x WHERE x.g = {g} AND ((x.s = {a} AND x.t = {b}) OR (x.s = {b} AND x.t = {a})))"


def basket_edges(spark, d):
    """The basket edges, made once for plans that read them several times."""
    return materialize(_basket_edges(spark, d), "basket-edges")


def _star_sql(k: int, reverse: bool) -> str:
    """Instances (g, center, leaves) of stars with k leaves."""
    center, leaf = ("t", "s") if reverse else ("s", "t")
    joins = " ".join(f"JOIN e a{i} ON a{i}.g = a1.g AND a{i}.{center} = a1.{center} AND a{i - 1}.{leaf} < a{i}.{leaf}" for i in range(2, k + 1))
    apart = " AND ".join("NOT " + _NEAR.format(g="a1.g", a=f"a{i}.{leaf}", b=f"a{j}.{leaf}") for i in range(1, k + 1) for j in range(i + 1, k + 1))
    leaves = " || ',' || ".join(f"a{i}.{leaf}" for i in range(1, k + 1))
    return f"SELECT a1.g, a1.{center} AS center, {leaves} AS leaves FROM e a1 {joins} WHERE {apart}"


_CHAIN_SQL = "SELECT a.g, a.t AS center, a.s AS \"first\", b.t AS \"last\" FROM e a JOIN e b ON a.g = b.g AND a.t = b.s AND a.s <> b.t WHERE NOT " + _NEAR.format(g="a.g", a="a.s", b="b.t")
_COUNTS = (
    WITH
    + ",\n"
    + ",\n".join(f"{n} AS (SELECT g, count(*) AS n FROM ({q}) GROUP BY g)" for n, q in [("m1", _CHAIN_SQL), *((f"m{f}{k - 1}", _star_sql(k, r)) for f, r in (("2", False), ("3", True)) for k in (2, 3, 4))])
    + ",\ncounts AS (SELECT g, "
    + ", ".join(f"coalesce({m}.n, 0) AS {m}" for m in ("m1", "m21", "m22", "m23", "m31", "m32", "m33"))
    + " FROM (SELECT DISTINCT g FROM e) "
    + " ".join(f"LEFT JOIN {m} USING (g)" for m in ("m1", "m21", "m22", "m23", "m31", "m32", "m33"))
    + "),\nlong AS (SELECT g, motif, n FROM (SELECT g, unnest(['M1', 'M2.1', 'M2.2', 'M2.3', 'M3.1', 'M3.2', 'M3.3']) AS motif, unnest([m1, m21, m22, m23, m31, m32, m33]) AS n FROM counts))"
)


def _stars(k: int, reverse: bool):
    return lambda spark, d: M.stars(basket_edges(spark, d), k, reverse).select("g", "center", F.array_join("leaves", ",").alias("leaves"))


def _counts(spark, d):
    return H.census(basket_edges(spark, d))


def _remap(spark, d):
    e = basket_edges(spark, d)
    mapping = e.select("g", F.explode(F.array("src", "dst")).alias("old")).distinct().select("g", "old", (F.col("old") - F.col("old") % 2).alias("new")).where("old <> new")
    return E.remap(e, mapping).select("g", "src", "dst", "modifier")


def _stance_nodes(spark, d):
    """Basket nodes, of which every seventh is called a stance."""
    return basket_nodes(spark, d).withColumn("label", F.when(F.col("node") % 7 == 3, F.concat(F.lit("upzoning stance "), "label")).otherwise(F.col("label")))


_STANCE = ", sn AS (SELECT g, node, CASE WHEN node % 7 = 3 THEN 'upzoning stance ' || label ELSE label END AS label FROM n)"
_DEG = "d AS (SELECT g, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT g, s AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT g, t, 1, 0 FROM e) GROUP BY g, node)"


def _latest(spark, d):
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return E.latest(ev.where("event_type <> 'error'"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def _segments(spark, d):
    """Market segments as demographics; every ninth customer has none."""
    c = table(spark, d, "customer").where("c_custkey % 9 <> 0")
    return c.select(F.col("c_custkey").alias("g"), F.col("c_mktsegment").alias("demographic"))


def _connected(spark, d):
    """Links of every fifth edge's target to the last nation, and of every seventh edge's source to a node that no graph has."""
    e = basket_edges(spark, d)
    link = lambda where, src, dst, far: e.where(where).select("g", F.col(src).alias("src"), F.lit(dst).alias("dst"), (F.col("ord") + far).alias("ord"), F.lit(0.5).alias("modifier"), F.lit(1.0).alias("confidence"))
    links = link("ord % 5 = 0", "dst", 24, 1000).where("src <> 24").union(link("ord % 7 = 0", "src", 99, 2000))
    return E.connect_to_stances(e, basket_nodes(spark, d), links).select("g", "src", "dst", "modifier")


def _features(spark, d):
    """How much of a part's type and size class the words of its name cover."""
    p = table(spark, d, "part")
    own, target = F.split(F.lower("p_name"), " "), F.array(F.lower("p_type"), F.lit("bolt"), F.lit("red"), F.when(F.col("p_size") > 25, "gear").otherwise("ring"))
    return p.select("p_partkey", F.round(R.feature_overlap(own, target), 6).alias("overlap"))


QUERIES = {
    "trade_edges": trade_edges,
    "basket_edges": _basket_edges,
    "motif_census": _counts,
    "motif_m1": lambda s, d: M.chains(basket_edges(s, d)),
    **{f"motif_m{f}{k - 1}": _stars(k, r) for f, r in (("2", False), ("3", True)) for k in (2, 3, 4)},
    "motif_ratios": lambda s, d: M.ratios(_counts(s, d)).select("g", "motif", "n", F.round("ratio", 6).alias("ratio")),
    "motif_complexity": lambda s, d: M.complexity(_counts(s, d)),
    "motif_families": lambda s, d: M.families(_counts(s, d)),
    "motif_family_means": lambda s, d: M.family_means(_counts(s, d), _segments(s, d)).withColumn("mean", F.round("mean", 6)),
    "edges_connected_to_stances": _connected,
    "features_overlap": lambda s, d: _features(s, d),
    "motif_heatmap": lambda s, d: M.heatmap(H.census(held_trade_edges(s, d))).groupBy("motif").pivot("g", list(range(1992, 2006))).agg(F.sum("n")).na.fill(0).select("motif", *(F.col(str(y)).alias(f"y{y}") for y in range(1992, 2006))),
    "motif_extraction": lambda s, d: H.extract(basket_edges(s, d)).select("g", "motif", "center", F.array_join("nodes", ",").alias("nodes"), "rank"),
    "motif_extraction_suppressed": lambda s, d: H.extract_by_suppression(basket_edges(s, d)).select("g", "motif", "center", F.array_join("nodes", ",").alias("nodes"), "rank"),
    "node_roles": lambda s, d: E.node_roles(basket_edges(s, d)),
    "node_positions": lambda s, d: E.degrees(basket_edges(s, d)).select("g", "node", E.position(F.col("in_degree"), F.col("out_degree")).alias("position"), E.position3(F.col("in_degree"), F.col("out_degree")).alias("position3"), E.position_weight(E.position(F.col("in_degree"), F.col("out_degree"))).alias("weight")),
    "graph_stance": lambda s, d: E.graph_stance(_stance_nodes(s, d), basket_edges(s, d)),
    "stance_members": lambda s, d: E.graph_stance(_stance_nodes(s, d), basket_edges(s, d)).select("stance", F.col("g").alias("member")),
    "graph_statistics": lambda s, d: E.statistics(basket_nodes(s, d), basket_edges(s, d)).withColumn("density", F.round("density", 6)),
    "graph_aggregate": lambda s, d: E.aggregate(basket_edges(s, d)),
    "edges_deduped": lambda s, d: E.dedupe(basket_edges(s, d).withColumn("dst", F.col("dst") - F.col("dst") % 2)).select("g", "src", "dst", "ord", "modifier"),
    "edges_low_confidence": lambda s, d: E.low_confidence(basket_edges(s, d)),
    "edges_without_dangling": lambda s, d: E.drop_dangling(basket_edges(s, d), basket_nodes(s, d).where("node % 5 <> 0")).select("g", "src", "dst"),
    "edges_without_self_loops": lambda s, d: E.drop_self_loops(basket_edges(s, d).withColumn("dst", F.col("dst") - F.col("dst") % 3)).select("g", "src", "dst", "ord"),
    "edges_clamped": lambda s, d: E.clamp_modifiers(basket_edges(s, d).withColumn("modifier", F.when(F.col("ord") % 4 != 0, F.col("modifier") * 2))).select("g", "src", "dst", F.round("modifier", 6).alias("modifier"), F.round(E.signed_weight(F.col("modifier")), 6).alias("weight")),
    "edges_labelled": lambda s, d: E.label_ends(basket_edges(s, d), basket_nodes(s, d).where("node % 6 <> 1")).select("g", "src_label", "dst_label", "modifier"),
    "edges_remapped": _remap,
    "edges_merged_stances": lambda s, d: E.merge_stance_nodes(_stance_nodes(s, d), basket_edges(s, d)).select("g", "src", "dst", "modifier"),
    "edges_without_stance_out": lambda s, d: E.drop_stance_out_edges(_stance_nodes(s, d), basket_edges(s, d)).select("g", "src", "dst"),
    "nodes_isolated": lambda s, d: E.isolated(basket_nodes(s, d), basket_edges(s, d).where("confidence > 0.9")),
    "nodes_connected": lambda s, d: E.drop_isolated(basket_nodes(s, d), basket_edges(s, d).where("confidence > 0.9")),
    "latest_row_of_key": _latest,
}

_INSTANCES = (
    _COUNTS
    + ",\ninst AS (SELECT g, 'M1' AS motif, center, [\"first\", center, \"last\"]::BIGINT[] AS nodes FROM ("
    + _CHAIN_SQL
    + ")"
    + "".join(f" UNION ALL SELECT g, 'M{f}.{k - 1}', center, list_prepend(center, string_split(leaves, ',')::BIGINT[])::BIGINT[] FROM ({_star_sql(k, r)})" for f, r in (("2", False), ("3", True)) for k in (2, 3, 4))
    + ")"
)

ORACLES = {
    "trade_edges": WITH_TRADE + " SELECT g, s AS src, t AS dst, o AS ord, m AS modifier, c AS confidence FROM e",
    "basket_edges": WITH + " SELECT g, s AS src, t AS dst, o AS ord, m AS modifier, c AS confidence FROM e",
    "motif_census": _COUNTS + " SELECT * FROM counts",
    "motif_m1": WITH + " " + _CHAIN_SQL,
    **{f"motif_m{f}{k - 1}": WITH + " " + _star_sql(k, r) for f, r in (("2", False), ("3", True)) for k in (2, 3, 4)},
    "motif_ratios": _COUNTS + " SELECT g, motif, n, round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY g), 0), 0), 6) AS ratio FROM long",
    "motif_complexity": _COUNTS + " SELECT g, m1 + m21 + 2 * m22 + 3 * m23 + m31 + 2 * m32 + 3 * m33 AS complexity FROM counts",
    "motif_families": _COUNTS + " SELECT g, m1 AS chain, m21 + m22 + m23 AS fork, m31 + m32 + m33 AS collider FROM counts",
    "motif_family_means": _COUNTS + """, d AS (SELECT coalesce(c_mktsegment, 'unknown') AS demographic, m1, m21, m22, m23, m31, m32, m33 FROM counts LEFT JOIN customer ON c_custkey = g AND c_custkey % 9 <> 0)
      SELECT demographic, f.family, round(avg(f.n), 6) AS mean FROM (SELECT demographic, unnest([{'family': 'Chain (M1)', 'n': m1::DOUBLE}, {'family': 'Basic Fork (M2.1)', 'n': m21::DOUBLE}, {'family': 'Extended Fork (M2.2+)', 'n': (m22 + m23)::DOUBLE},
        {'family': 'Basic Collider (M3.1)', 'n': m31::DOUBLE}, {'family': 'Extended Collider (M3.2+)', 'n': (m32 + m33)::DOUBLE}]) AS f FROM d) GROUP BY 1, 2""",
    "edges_connected_to_stances": WITH + """, l AS (SELECT g, s, t, o, m FROM e UNION ALL SELECT g, t, 24, o + 1000, 0.5 FROM e WHERE o % 5 = 0 AND t <> 24)
      SELECT g, s AS src, t AS dst, m AS modifier FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY o DESC) AS k FROM l) WHERE k = 1""",
    "features_overlap": "SELECT p_partkey, round(len(list_intersect(string_split(lower(p_name), ' '), t))::DOUBLE / len(t), 6) AS overlap FROM (SELECT *, [lower(p_type), 'bolt', 'red', CASE WHEN p_size > 25 THEN 'gear' ELSE 'ring' END] AS t FROM part)",
    "motif_heatmap": _COUNTS.replace(WITH, WITH_TRADE, 1) + " SELECT motif, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (g = {y}), 0) AS BIGINT) AS y{y}" for y in range(1992, 2006)) + " FROM long GROUP BY motif",
    "motif_extraction": _INSTANCES + """ SELECT g, motif, center, array_to_string(nodes, ',') AS nodes, rank FROM (SELECT *, row_number() OVER (PARTITION BY g, motif ORDER BY nodes) AS rank FROM
      (SELECT *, max(len(nodes)) OVER (PARTITION BY g, motif[1:2], center) AS m FROM inst) WHERE motif = 'M1' OR len(nodes) = m) WHERE rank <= 30""",
    "motif_extraction_suppressed": _INSTANCES + """ SELECT g, motif, center, array_to_string(nodes, ',') AS nodes, rank FROM (SELECT *, row_number() OVER (PARTITION BY g, motif, len(nodes) ORDER BY nodes) AS rank FROM
      (SELECT g, CASE WHEN motif = 'M1' THEN motif ELSE motif[1:2] || '.3' END AS motif, center, nodes FROM (SELECT *, row_number() OVER (PARTITION BY g, motif[1:2], center ORDER BY len(nodes) DESC, nodes) AS k FROM inst) WHERE k = 1 OR motif = 'M1')) WHERE rank <= 30""",
    "node_roles": WITH + ", " + _DEG + """ SELECT g, node, in_degree, out_degree, degree, rank, CASE WHEN in_degree > 0 AND out_degree > 0 THEN 'central' WHEN out_degree > 0 THEN 'influencer' ELSE 'influenced' END AS role
      FROM (SELECT *, in_degree + out_degree AS degree, row_number() OVER (PARTITION BY g ORDER BY in_degree + out_degree DESC, node) AS rank FROM d) WHERE rank <= 10""",
    "node_positions": WITH + ", " + _DEG + """, p AS (SELECT g, node, CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'source' WHEN in_degree > 0 AND out_degree = 0 THEN 'sink' WHEN in_degree > 1 THEN 'collector' WHEN out_degree > 1 THEN 'distributor' ELSE 'intermediate' END AS position,
      CASE WHEN in_degree = 0 THEN 'source' WHEN out_degree = 0 THEN 'sink' ELSE 'intermediate' END AS position3 FROM d) SELECT *, CASE WHEN position = 'intermediate' THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS weight FROM p""",
    "graph_stance": WITH + _STANCE + """ SELECT g, CASE WHEN m > 0.3 THEN 'support' WHEN m < -0.3 THEN 'oppose' ELSE 'neutral' END AS stance FROM
      (SELECT st.g, coalesce(arg_min(e.m, e.o), 0) AS m FROM (SELECT g, min(node) FILTER (contains(label, 'stance')) AS node FROM sn GROUP BY g) st LEFT JOIN e ON e.g = st.g AND e.t = st.node GROUP BY st.g)""",
    "graph_statistics": WITH + " SELECT g, n_nodes, coalesce(n_edges, 0) AS n_edges, round(coalesce(n_edges, 0)::DOUBLE / nullif(n_nodes * (n_nodes - 1), 0), 6) AS density FROM (SELECT g, count(DISTINCT node) AS n_nodes FROM n GROUP BY g) LEFT JOIN (SELECT g, count(*) AS n_edges FROM e GROUP BY g) USING (g)",
    "graph_aggregate": WITH + " SELECT s AS src, t AS dst, count(*) AS n_graphs, arg_min(m, g * 1000::BIGINT + o) AS modifier, arg_min(c, g * 1000::BIGINT + o) AS confidence FROM e GROUP BY s, t",
    "edges_deduped": WITH + " SELECT g, s AS src, t2 AS dst, o AS ord, m AS modifier FROM (SELECT *, t - t % 2 AS t2, row_number() OVER (PARTITION BY g, s, t - t % 2 ORDER BY o DESC) AS k FROM e) WHERE k = 1",
    "edges_low_confidence": WITH + " SELECT g, s AS src, t AS dst, o AS ord, m AS modifier, c AS confidence FROM e WHERE c < 0.9",
    "edges_without_dangling": WITH + " SELECT g, s AS src, t AS dst FROM e WHERE s % 5 <> 0 AND t % 5 <> 0",
    "edges_without_self_loops": WITH + " SELECT g, s AS src, t - t % 3 AS dst, o AS ord FROM e WHERE s <> t - t % 3",
    "edges_clamped": WITH + ", x AS (SELECT g, s, t, greatest(least(coalesce(CASE WHEN o % 4 <> 0 THEN m * 2 END, 0.0), 1.0), -1.0) AS m FROM e) SELECT g, s AS src, t AS dst, round(m, 6) AS modifier, round(CASE WHEN m < 0 THEN 1 + m ELSE m END, 6) AS weight FROM x",
    "edges_labelled": WITH + " SELECT e.g, coalesce(a.label, s::VARCHAR) AS src_label, coalesce(b.label, t::VARCHAR) AS dst_label, m AS modifier FROM e LEFT JOIN n a ON a.g = e.g AND a.node = s AND s % 6 <> 1 LEFT JOIN n b ON b.g = e.g AND b.node = t AND t % 6 <> 1",
    "edges_remapped": WITH + " SELECT g, s AS src, t AS dst, m AS modifier FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY o DESC) AS k FROM (SELECT g, s - s % 2 AS s, t - t % 2 AS t, m, o FROM e) WHERE s <> t) WHERE k = 1",
    "edges_merged_stances": WITH + " SELECT g, s AS src, t AS dst, m AS modifier FROM (SELECT *, row_number() OVER (PARTITION BY g, s, t ORDER BY o DESC) AS k FROM (SELECT g, CASE WHEN s % 7 = 3 THEN 3 ELSE s END AS s, CASE WHEN t % 7 = 3 THEN 3 ELSE t END AS t, m, o FROM e) WHERE s <> t) WHERE k = 1",
    "edges_without_stance_out": WITH + " SELECT g, s AS src, t AS dst FROM e WHERE s % 7 <> 3",
    "nodes_isolated": WITH + " SELECT g, node, label FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.g = n.g AND c > 0.9 AND (s = node OR t = node))",
    "nodes_connected": WITH + " SELECT g, node, label FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.g = n.g AND c > 0.9 AND (s = node OR t = node))",
    "latest_row_of_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events WHERE event_type <> 'error') WHERE k = 1",
}
ORACLES["stance_members"] = "SELECT stance, g AS member FROM (" + ORACLES["graph_stance"] + ")"
