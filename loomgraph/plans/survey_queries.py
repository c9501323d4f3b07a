"""Queries on grids, proposals, census tables, surveys and forum participants made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import uniform_sql
from ..operators import places as P
from ..operators import spatial as G
from ..operators import surveys as S
from ..sources.shared import materialize
from .fixtures import table

BOUNDS = {"north": 37.75, "south": 37.70, "east": -122.40, "west": -122.50}
CELL = 500.0
HEIGHTS = (40, 65, 85, 105, 130, 240, 300, 400)


def _cells(spark, d):
    h = F.array(*map(F.lit, HEIGHTS))
    cells = P.grid(spark, BOUNDS, CELL)
    k = F.col("row") * 7 + F.col("col") * 3
    return cells.withColumns({"height_limit": F.element_at(h, (k % 8 + 1).cast("int")), "category": F.concat(F.lit("zone_"), (k % 5).cast("string")), "proposal_id": F.format_string("proposal_%03d", (k % 4).cast("int"))})


def _agents(spark, d):
    k = F.col("c_custkey")
    lat, lng = 37.69 + (k * 37 % 997) / 997.0 * 0.07, -122.52 + (k * 61 % 991) / 991.0 * 0.14
    return table(spark, d, "customer").select(k.alias("agent_id"), lat.alias("lat"), lng.alias("lng"), (94000 + F.col("c_nationkey")).alias("zip"), "c_mktsegment", "c_acctbal")


def _zones(spark, d):
    """Rectangles made of suppliers."""
    k = F.col("s_suppkey")
    south, west = 37.70 + (k * 17 % 89) / 89.0 * 0.05, -122.50 + (k * 29 % 97) / 97.0 * 0.1
    return table(spark, d, "supplier").select(k.alias("zone_id"), south.alias("south"), (south + 0.004 + (k % 5) * 0.002).alias("north"), west.alias("west"), (west + 0.005 + (k % 7) * 0.002).alias("east"))


def _polygons(spark, d):
    """The zones as polygons: a third are rectangles, a third have a hole, a third lack their north-east quarter."""
    p = lambda x, y: F.struct((F.col("west") + x * (F.col("east") - F.col("west"))).alias("x"), (F.col("south") + y * (F.col("north") - F.col("south"))).alias("y"))
    ring = lambda *ps: F.array(*(p(x, y) for x, y in ps))
    box, hole = ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75))
    bent = ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))
    shape = F.col("zone_id") % 3
    return _zones(spark, d).select("zone_id", F.when(shape == 0, F.array(box)).when(shape == 1, F.array(box, hole)).otherwise(F.array(bent)).alias("rings"))


def _scattered(spark, d):
    """Agents as they are, and cells that stand far apart: one for each part, over some twenty degrees."""
    k = F.col("p_partkey")
    south, west = 28.0 + (k * 7919 % 2003) / 100.0, -132.0 + (k * 104729 % 1999) / 100.0
    cells = table(spark, d, "part").select(k.alias("cell_id"), south.alias("south"), (south + 0.005).alias("north"), west.alias("west"), (west + 0.005).alias("east"))
    return _agents(spark, d), cells


def _weighted(spark, d):
    """Customers weighted by their balance; those in debt weigh nothing."""
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.greatest(F.lit(0.0), F.round("c_acctbal", 2)).alias("w"))


def _census(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    z, t = F.col("c_nationkey").cast("string").alias("zipcode"), F.concat(F.lit("B0"), F.substring("o_orderpriority", 1, 1)).alias("t")
    n = materialize(o.groupBy(z, t, "o_orderstatus").agg(F.count("*").alias("n")), "census")
    subs = n.select("zipcode", F.concat(F.col("t"), F.lit("_"), F.col("o_orderstatus")).alias("k"), F.col("n").cast("string").alias("v"))
    total = n.groupBy("zipcode", "t").agg(F.sum("n").alias("n")).where("zipcode <> '3'").select("zipcode", F.concat(F.col("t"), F.lit("_001E")).alias("k"), F.col("n").cast("string").alias("v"))
    return subs.union(total).groupBy("zipcode").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("codes"))


def _wide(spark, d):
    """A survey's wide table: a row of each part."""
    k = F.col("p_partkey")
    cols = {f"Scenario {i}.{j}: text": (k * i + j) % 10 + 1 for i in (1, 2) for j in (1, 2, 3)}
    cols |= {f"Scenario {i}.1: why [{r}]": (k + n) % 5 + 1 for i in (1, 2) for n, r in enumerate(("supply", "views"))}
    return table(spark, d, "part").select(k.alias("Prolific ID"), *(F.when(k % 17 == 0, "n/a").otherwise(v.cast("string")).alias(c) for c, v in cols.items()))


def _participants(spark, d):
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("question_id"), F.col("l_shipdate").cast("date").cast("string").substr(1, 4).alias("tag")))).alias("mcqs"), F.min("l_returnflag").alias("stance"))
    o = S.split(table(spark, d, "orders").select(F.col("o_custkey").alias("username"), F.col("o_orderkey").alias("post_id")), "post_id").withColumn("split", F.when(F.col("post_id") % 10 < 7, "train").otherwise("test"))
    t = o.join(line.withColumnRenamed("l_orderkey", "post_id"), "post_id")
    return t.groupBy("username").agg(F.collect_list(F.struct("post_id", "stance", "split", "mcqs")).alias("topics"))


def _round(df, *names, n=6):
    return df.withColumns({c: F.round(c, n) for c in names})


CODES = {"supply": "A", "views": "I"}
QUERIES = {
    "grid_cells": lambda s, d: _round(P.grid(s, BOUNDS, CELL), "north", "south", "east", "west"),
    "nearest_cells": lambda s, d: _round(G.nearest_cells(_agents(s, d), _cells(s, d)), "distance"),
    "nearest_sparse_cells": lambda s, d: _round(G.nearest_cells(*_scattered(s, d)), "distance"),
    "overlap_cells": lambda s, d: P.overlap_cells(P.grid(s, BOUNDS, CELL), _zones(s, d)).withColumn("area", F.round("area", 9)),
    "overlap_polygons": lambda s, d: G.polygon_overlap(P.grid(s, BOUNDS, CELL), _polygons(s, d)).withColumn("area", F.round("area", 9)),
    "zone_summary": lambda s, d: _round(P.zone_summary(_cells(s, d), CELL), "lat", "lng", "acres", n=4),
    "proposal_texts": lambda s, d: P.proposal_text(P.zone_summary(_cells(s, d), CELL)),
    "height_patterns": lambda s, d: P.height_patterns(_cells(s, d)).select("cell_id", "height_limit", "pattern"),
    "mock_proposals": lambda s, d: P.mock_proposals(_cells(s, d)).select("scenario", "cell_id", "height_limit", "category"),
    "proposal_scenarios": lambda s, d: table(s, d, "supplier").select("s_suppkey", P.scenario_of(F.format_string("proposal_%03d", (F.col("s_suppkey") % 12).cast("int"))).alias("scenario")),
    "first_integers": lambda s, d: table(s, d, "part").select("p_partkey", P.first_integer(F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit("X/9"))).otherwise(""))).alias("height")),
    "census_long": lambda s, d: P.census_long(_census(s, d)),
    "census_ratios": lambda s, d: _round(P.census_ratios(P.census_long(_census(s, d))), "ratio"),
    "census_pivot": lambda s, d: P.census_ratio_map(P.census_ratios(P.census_long(_census(s, d)))).select("zipcode", F.explode("ratios").alias("code", "ratio")).withColumn("ratio", F.round("ratio", 6)),
    "survey_opinions": lambda s, d: S.unpivot_scenarios(_wide(s, d), "Prolific ID", CODES)[0],
    "survey_reasons": lambda s, d: S.unpivot_scenarios(_wide(s, d), "Prolific ID", CODES)[1],
    "agents_placed": lambda s, d: S.place_agents(_agents(s, d).select("agent_id", "zip"), table(s, d, "nation").where("n_nationkey % 4 <> 1").select((94000 + F.col("n_nationkey")).alias("zip"), (37 + F.col("n_nationkey") / 100.0).alias("lat"), (F.lit(-122) - F.col("n_nationkey") / 100.0).alias("lng")), (37.77, -122.42)).select("agent_id", F.round(F.round(F.col("lat") * 100) / 100, 2).alias("lat"), (F.abs(F.col("lng")) < 123).alias("near")),
    "agents_with_default": lambda s, d: S.with_default(_agents(s, d).select("agent_id", F.col("zip").alias("k")), table(s, d, "nation").where("n_nationkey < 10").select((94000 + F.col("n_nationkey")).alias("k"), F.col("n_name").alias("region")), "k", {"region": "elsewhere"}),
    "agents_named": lambda s, d: S.agent_ids(table(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("agent_id")), "s_suppkey"),
    "answers_coded": lambda s, d: _agents(s, d).select("agent_id", S.coded("income", F.when(F.col("agent_id") % 2 == 0, "0-25000").otherwise("none")).alias("income"), S.coded("education", F.when(F.col("agent_id") % 3 == 0, "doctorate").otherwise("?")).alias("education"), S.coded("occupation", F.when(F.col("agent_id") % 5 == 0, "retired").otherwise("?")).alias("occupation")),
    "role_profiles": lambda s, d: _agents(s, d).select("agent_id", S.role_profile(F.concat(F.lower("c_mktsegment"), F.when(F.col("agent_id") % 3 == 0, " elder tenant Perspective").when(F.col("agent_id") % 3 == 1, " young professional").otherwise(" artist homeowner")), F.col("agent_id")).alias("p")).select("agent_id", "p.income", "p.education", "p.occupation", "p.housing", F.when(F.col("p.age") >= 65, "old").otherwise("other").alias("band")),
    "row_batches": lambda s, d: S.batches(table(s, d, "part").select("p_partkey"), "p_partkey", 100),
    "weighted_choices": lambda s, d: table(s, d, "customer").select("c_custkey", S.weighted_choice(None, {"support": 0.6, "oppose": 0.3, "neutral": 0.1}, "c_custkey").alias("opinion")),
    "topics_flattened": lambda s, d: S.flatten_topics(_participants(s, d)),
    "topics_by_tag": lambda s, d: S.flatten_topics(_participants(s, d), "1995").select("username", "question_id"),
    "stance_distribution": lambda s, d: S.stance_distribution(_participants(s, d).select(F.explode("topics").alias("t")).select("t.stance")),
    "participant_summary": lambda s, d: S.participant_summary(_participants(s, d)),
    "comment_analysis": lambda s, d: S.comment_analysis(_participants(s, d)).select("username", "post_id", "n_mcqs", F.array_join("tags", ",").alias("tags")),
    "customers_sampled": lambda s, d: S.weighted_sample(_weighted(s, d), 100, "w", "c_custkey").select("c_custkey", "rank"),
    "customers_sampled_by_nation": lambda s, d: S.weighted_sample(_weighted(s, d), 5, "w", "c_custkey", by="c_nationkey", seed=3).select("c_nationkey", "c_custkey", "rank"),
    "agents_drawn": lambda s, d: S.drawn_agents(table(s, d, "customer").select("c_custkey"), BOUNDS, {"income": ["low", "middle", "high"], "housing": ["rent", "own"]}, "c_custkey"),
    "dataset_split": lambda s, d: S.split(table(s, d, "orders").select("o_orderkey"), "o_orderkey").groupBy("split").agg(F.count("*").alias("n")),
    "dataset_faults": lambda s, d: S.dataset_faults(table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), table(s, d, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k")), "k"),
    "unprocessed": lambda s, d: S.unprocessed(table(s, d, "orders").select(F.col("o_orderkey").alias("k")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k"),
}

_M = P.METRES_PER_DEGREE
_GRID = f"""gp AS (SELECT {BOUNDS['south']}::DOUBLE AS s0, {BOUNDS['west']}::DOUBLE AS w0, {BOUNDS['north']}::DOUBLE AS n0, {BOUNDS['east']}::DOUBLE AS e0, {_M}::DOUBLE AS m, {CELL}::DOUBLE AS c),
gq AS (SELECT *, m * cos(radians((n0 + s0) / 2)) AS pd FROM gp), gs AS (SELECT *, CAST(floor((n0 - s0) * m / c) AS INT) AS nr, CAST(floor((e0 - w0) * pd / c) AS INT) AS nc, c / m AS dy, c / pd AS dx FROM gq),
g0 AS (SELECT *, unnest(range(0, nr * nc)) AS i FROM gs),
grid AS (SELECT CAST(i // nc AS INT) AS row, CAST(i % nc AS INT) AS col, (i // nc) || '_' || (i % nc) AS cell_id, s0 + (i // nc + 1) * dy AS north, s0 + (i // nc) * dy AS south, w0 + (i % nc + 1) * dx AS east, w0 + (i % nc) * dx AS west FROM g0),
cells AS (SELECT *, [{', '.join(map(str, HEIGHTS))}][(row * 7 + col * 3) % 8 + 1] AS height_limit, 'zone_' || ((row * 7 + col * 3) % 5) AS category, 'proposal_' || lpad(((row * 7 + col * 3) % 4)::VARCHAR, 3, '0') AS proposal_id FROM grid)"""
_AG = "ag AS (SELECT c_custkey AS agent_id, 37.69::DOUBLE + (c_custkey * 37 % 997) / 997.0::DOUBLE * 0.07::DOUBLE AS lat, -122.52::DOUBLE + (c_custkey * 61 % 991) / 991.0::DOUBLE * 0.14::DOUBLE AS lng, 94000 + c_nationkey AS zip, c_mktsegment FROM customer)"
_ZN = "z0 AS (SELECT s_suppkey AS zone_id, 37.70::DOUBLE + (s_suppkey * 17 % 89) / 89.0::DOUBLE * 0.05::DOUBLE AS south, -122.50::DOUBLE + (s_suppkey * 29 % 97) / 97.0::DOUBLE * 0.1::DOUBLE AS west, s_suppkey AS k FROM supplier), zn AS (SELECT zone_id, south, south + 0.004::DOUBLE + (k % 5) * 0.002::DOUBLE AS north, west, west + 0.005::DOUBLE + (k % 7) * 0.002::DOUBLE AS east FROM z0)"
_OVER = f"WITH {_GRID}, {_ZN}, ov AS (SELECT cell_id, zone_id, greatest(0, least(c.north, z.north) - greatest(c.south, z.south)) * greatest(0, least(c.east, z.east) - greatest(c.west, z.west)) AS area FROM grid c, zn z) SELECT cell_id, zone_id, round(area, 9) AS area FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY area DESC, zone_id) AS k FROM ov WHERE area > 0) WHERE k = 1"
_ZS = f"WITH {_GRID}, zs AS (SELECT proposal_id, category, height_limit, count(*) AS n, avg((north + south) / 2) AS lat, avg((east + west) / 2) AS lng, min(row * 100000 + col) AS f FROM cells GROUP BY 1, 2, 3), zr AS (SELECT *, n * {CELL} * {CELL} * {P.ACRES_PER_SQUARE_METRE} AS acres, row_number() OVER (PARTITION BY proposal_id ORDER BY f, category, height_limit) AS rank FROM zs)"
_CEN = """WITH cb AS (SELECT c_nationkey::VARCHAR AS zipcode, 'B0' || substr(o_orderpriority, 1, 1) AS table_code, o_orderstatus AS sub_code, count(*) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
cl AS (SELECT * FROM cb UNION ALL SELECT zipcode, table_code, '001E', CAST(sum(value) AS BIGINT) FROM cb WHERE zipcode <> '3' GROUP BY 1, 2),
cr AS (SELECT *, value::DOUBLE / nullif(max(value) FILTER (sub_code = '001E') OVER (PARTITION BY zipcode, table_code), 0) AS ratio FROM cl)"""
_TOP = """WITH q AS (SELECT o_custkey AS username, o_orderkey AS post_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS question_id, substr(l_shipdate::DATE::VARCHAR, 1, 4) AS tag, CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split,
  min(l_returnflag) OVER (PARTITION BY o_orderkey) AS stance FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
_WAIT = "SELECT c_custkey, c_nationkey, -ln(1 - {u}) / w AS wait FROM (SELECT *, greatest(0, round(c_acctbal, 2)) AS w FROM customer) WHERE w > 0"
ORACLES = {
    "grid_cells": f"WITH {_GRID} SELECT row, col, cell_id, round(north, 6) AS north, round(south, 6) AS south, round(east, 6) AS east, round(west, 6) AS west FROM grid",
    "nearest_cells": f"WITH {_GRID}, {_AG}, dd AS (SELECT agent_id, cell_id, sqrt((lat - (north + south) / 2) ** 2 + (lng - (east + west) / 2) ** 2) AS distance FROM ag, grid) SELECT agent_id, cell_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY distance, cell_id) AS k FROM dd) WHERE k = 1",
    "overlap_cells": _OVER,
    "zone_summary": _ZS + " SELECT proposal_id, category, height_limit, n, round(lat, 4) AS lat, round(lng, 4) AS lng, round(acres, 4) AS acres, rank FROM zr",
    "proposal_texts": _ZS + """ SELECT proposal_id, sum(n) || ' blocks: ' || string_agg(n || ' blocks of ' || replace(category, '_', ' ') || ' up to ' || height_limit || ' feet', '; ' ORDER BY rank) FILTER (rank <= 3) || CASE WHEN count(*) > 3 THEN '; and ' || (count(*) - 3) || ' more zones' ELSE '' END AS text FROM zr GROUP BY proposal_id""",
    "height_patterns": f"WITH {_GRID} SELECT cell_id, height_limit, pattern FROM cells JOIN (VALUES (1, 65, 300), (2, 85, 300), (3, 240, 300)) p(pattern, lo, hi) ON height_limit BETWEEN lo AND hi",
    "mock_proposals": f"WITH {_GRID} SELECT pattern || '.' || variant AS scenario, cell_id, h AS height_limit, category FROM cells JOIN (VALUES (1, 65, 300), (2, 85, 300), (3, 240, 300)) p(pattern, lo, hi) ON height_limit BETWEEN lo AND hi, (VALUES (1, 80), (2, 140), (3, 300)) v(variant, h)",
    "proposal_scenarios": "SELECT s_suppkey, CASE WHEN s_suppkey % 12 < 9 THEN (s_suppkey % 12 // 3 + 1) || '.' || (s_suppkey % 12 % 3 + 1) ELSE '1.1' END AS scenario FROM supplier",
    "first_integers": "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS height FROM part",
    "census_long": _CEN + " SELECT zipcode, table_code, sub_code, value FROM cl",
    "census_ratios": _CEN + " SELECT zipcode, table_code, sub_code, value, round(ratio, 6) AS ratio FROM cr",
    "census_pivot": _CEN + " SELECT zipcode, table_code || '_' || sub_code || '_ratio' AS code, round(ratio, 6) AS ratio FROM cr WHERE sub_code <> '001E' AND ratio IS NOT NULL",
    "survey_opinions": "SELECT p_partkey AS pid, i || '.' || j AS scenario, CAST((p_partkey * i + j) % 10 + 1 AS INT) AS score FROM part, (VALUES (1), (2)) a(i), (VALUES (1), (2), (3)) b(j) WHERE p_partkey % 17 <> 0",
    "survey_reasons": "SELECT p_partkey AS pid, i || '.1' AS scenario, code, CAST((p_partkey + n) % 5 + 1 AS INT) AS score FROM part, (VALUES (1), (2)) a(i), (VALUES (0, 'A'), (1, 'I')) b(n, code) WHERE p_partkey % 17 <> 0",
    "agents_with_default": f"WITH {_AG} SELECT zip AS k, agent_id, coalesce(n_name, 'elsewhere') AS region FROM ag LEFT JOIN nation ON 94000 + n_nationkey = zip AND n_nationkey < 10",
    "agents_named": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE 'agent_' || lpad((row_number() OVER (PARTITION BY s_suppkey % 3 > 0 ORDER BY s_suppkey) - 1)::VARCHAR, 3, '0') END AS agent_id FROM supplier",
    "agents_placed": f"""WITH {_AG}, z AS (SELECT 94000 + n_nationkey AS zip, 37 + n_nationkey / 100.0::DOUBLE AS zlat, -122 - n_nationkey / 100.0::DOUBLE AS zlng FROM nation WHERE n_nationkey % 4 <> 1),
      p AS (SELECT agent_id, coalesce(zlat, 37.77) + ({uniform_sql("'lat'", "agent_id")} * 2 - 1) * {S.JITTER} AS lat, coalesce(zlng, -122.42) + ({uniform_sql("'lng'", "agent_id")} * 2 - 1) * {S.JITTER} AS lng FROM ag LEFT JOIN z USING (zip))
      SELECT agent_id, round(round(lat * 100) / 100, 2) AS lat, abs(lng) < 123 AS near FROM p""",
    "weighted_choices": f"SELECT c_custkey, CASE WHEN u < 0.6 THEN 'support' WHEN u < 0.9 THEN 'oppose' ELSE 'neutral' END AS opinion FROM (SELECT c_custkey, {uniform_sql('c_custkey')} AS u FROM customer)",
    "customers_sampled": f"SELECT c_custkey, row_number() OVER (ORDER BY wait, c_custkey) AS rank FROM ({_WAIT.format(u=uniform_sql('0', 'c_custkey'))}) QUALIFY rank <= 100",
    "customers_sampled_by_nation": f"SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY wait, c_custkey) AS rank FROM ({_WAIT.format(u=uniform_sql('3', 'c_custkey'))}) QUALIFY rank <= 5",
    "agents_drawn": f"""WITH u AS (SELECT c_custkey, {", ".join(f"{uniform_sql('0', repr(n), 'c_custkey')} AS u_{n}" for n in ("lat", "lng", "range", "age", "income", "housing"))} FROM customer)
      SELECT c_custkey, round({BOUNDS["south"]} + ({BOUNDS["north"]} - {BOUNDS["south"]})::DOUBLE * u_lat, 6) AS lat, round({BOUNDS["west"]} + ({BOUNDS["east"]} - ({BOUNDS["west"]}))::DOUBLE * u_lng, 6) AS lng,
      CAST(CASE {" ".join(f"WHEN u_range < {sum(w for *_, w in S.AGE_RANGES[: i + 1]) / sum(w for *_, w in S.AGE_RANGES)}::DOUBLE THEN {low} + floor(u_age * {high - low + 1})" for i, (low, high, _) in enumerate(S.AGE_RANGES))} END AS INT) AS age,
      ['low', 'middle', 'high'][CAST(floor(u_income * 3) AS INT) + 1] AS income, ['rent', 'own'][CAST(floor(u_housing * 2) AS INT) + 1] AS housing FROM u""",
    "dataset_split": f"SELECT CASE WHEN {uniform_sql('42', 'o_orderkey')} < 0.7 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM orders GROUP BY 1",
    "answers_coded": f"WITH {_AG} SELECT agent_id, CASE WHEN agent_id % 2 = 0 THEN 'low_income' ELSE 'middle_income' END AS income, CASE WHEN agent_id % 3 = 0 THEN 'postgraduate' ELSE 'bachelor' END AS education, CASE WHEN agent_id % 5 = 0 THEN 'retired' ELSE 'white_collar' END AS occupation FROM ag",
    "role_profiles": f"""WITH {_AG} SELECT agent_id, ['$15,000-$40,000', '$80,000-$120,000', '$40,000-$80,000'][agent_id % 3 + 1] AS income, ['high school graduate', 'master''s degree or higher', 'bachelor''s degree'][agent_id % 3 + 1] AS education,
      lower(c_mktsegment) || [' elder tenant', ' young professional', ' artist homeowner'][agent_id % 3 + 1] AS occupation, ['renter', 'mixed housing situation', 'homeowner'][agent_id % 3 + 1] AS housing, ['old', 'other', 'other'][agent_id % 3 + 1] AS band FROM ag WHERE agent_id % 3 < 3""",
    "row_batches": "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 100 AS batch FROM part",
    "topics_flattened": _TOP + " SELECT username, post_id, stance, question_id, tag FROM q",
    "topics_by_tag": _TOP + " SELECT username, question_id FROM q WHERE tag = '1995'",
    "stance_distribution": _TOP + " SELECT stance, count(*) AS n FROM (SELECT DISTINCT post_id, stance FROM q) GROUP BY stance",
    "participant_summary": _TOP + " SELECT username, count(DISTINCT post_id) AS n_topics, count(DISTINCT post_id) FILTER (split = 'train') AS n_train, count(*) AS n_mcqs, count(DISTINCT tag) AS n_tags FROM q GROUP BY username",
    "comment_analysis": _TOP + " SELECT username, post_id, CAST(count(*) AS INT) AS n_mcqs, string_agg(tag, ',' ORDER BY question_id, tag) AS tags FROM q GROUP BY username, post_id",
    "dataset_faults": "WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), ex AS (SELECT DISTINCT o_orderkey AS k, 1 AS one FROM orders WHERE o_orderkey % 9 <> 0), b AS (SELECT k, CASE WHEN n IS NULL THEN 'missing' WHEN one IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' END AS fault FROM ex FULL JOIN n USING (k)) SELECT * FROM b WHERE fault IS NOT NULL",
    "unprocessed": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
}
_PART = "greatest(0, least(c.north, z.south + {n} * z.h) - greatest(c.south, z.south + {s} * z.h)) * greatest(0, least(c.east, z.west + {e} * z.w) - greatest(c.west, z.west + {w} * z.w))"
_WHOLE, _HOLE, _CORNER = (_PART.format(s=s, n=n, w=w, e=e) for s, n, w, e in ((0, 1, 0, 1), (0.25, 0.75, 0.25, 0.75), (0.5, 1, 0.5, 1)))
ORACLES["overlap_polygons"] = f"""WITH {_GRID}, {_ZN}, zz AS (SELECT *, north - south AS h, east - west AS w FROM zn),
  ov AS (SELECT cell_id, zone_id, {_WHOLE} - CASE zone_id % 3 WHEN 1 THEN {_HOLE} WHEN 2 THEN {_CORNER} ELSE 0 END AS area FROM grid c, zz z)
  SELECT cell_id, zone_id, round(area, 9) AS area FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(area, 12) DESC, zone_id) AS k FROM ov WHERE area > 1e-15) WHERE k = 1"""
ORACLES["nearest_sparse_cells"] = f"""WITH {_AG}, ce AS (SELECT p_partkey AS cell_id, 28.0::DOUBLE + (p_partkey * 7919 % 2003) / 100.0::DOUBLE AS south, -132.0::DOUBLE + (p_partkey * 104729 % 1999) / 100.0::DOUBLE AS west FROM part),
  dd AS (SELECT agent_id, cell_id, sqrt((lat - (south + 0.005 + south) / 2) ** 2 + (lng - (west + 0.005 + west) / 2) ** 2) AS distance FROM ag, ce)
  SELECT agent_id, cell_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY distance, cell_id) AS k FROM dd) WHERE k = 1"""
