"""Evaluation queries over the survey tables made of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import opinion_score
from ..operators import evaluation as V
from ..sources.shared import materialize
from .fixtures import REASONS, SURVEY, reasons, survey, table


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _aligned(spark, d):
    truth, guess = reasons(spark, d)
    return materialize(V.align_reasons(materialize(truth, "truth"), materialize(guess, "guess")), "aligned")


def _events(spark, d):
    ev = table(spark, d, "events")
    word = F.when(F.col("event_type").isin("purchase", "signup"), "support").when(F.col("event_type") == "error", "oppose").otherwise("neutral")
    return ev.select(F.col("user_id").alias("pid"), word.alias("opinion"), F.array("event_type", F.concat(F.lit("k"), F.get_json_object("props", "$.k"))).alias("themes"), "event_id", "value")


QUERIES = {
    "survey_pairs": survey,
    "mae": lambda s, d: _r(V.mae(survey(s, d)), "mae"),
    "w1_overall": lambda s, d: _r(V.w1_overall(survey(s, d)), "w1", "similarity"),
    "w1_regions": lambda s, d: _r(V.w1_regions(survey(s, d)), "w1", "similarity"),
    "pearson": lambda s, d: _r(V.pearson(survey(s, d)), "r", "r_or_zero"),
    "regression": lambda s, d: _r(V.regression(survey(s, d)), "rmse", "r2"),
    "reasons_aligned": _aligned,
    "reason_w1": lambda s, d: _r(V.reason_w1(_aligned(s, d)), "w1", "similarity"),
    "reason_sets": lambda s, d: _r(V.reason_sets(_aligned(s, d)), "precision", "recall", "f1", "jaccard", "mean_gap"),
    "top_reasons_agree": lambda s, d: V.top_reasons_agree(_aligned(s, d)),
    "opinion_shares": lambda s, d: V.opinion_shares(_events(s, d), "opinion"),
    "opinion_scores": lambda s, d: _events(s, d).select("event_id", opinion_score(F.col("opinion")).alias("score")),
    "themes_by_opinion": lambda s, d: V.themes_by_opinion(_events(s, d), "opinion", "themes").select("opinion", F.array_join("themes", ",").alias("themes")),
    "reactions_flattened": lambda s, d: V.flatten_reactions(_events(s, d).groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 10).alias("cell"), "opinion"))).alias("comments")), "comments"),
    "processing_stats": lambda s, d: V.processing_stats(_events(s, d), F.col("opinion") != "oppose"),
}
_S, _R = f"WITH {SURVEY.strip()}", f"WITH {REASONS.strip()}"
_AL = _R + """, pr AS (SELECT DISTINCT rt.pid, rt.scenario FROM rt JOIN rp ON rt.pid = rp.pid AND rt.scenario = rp.scenario),
al AS (SELECT pid, scenario, code, coalesce(rt.score, 0) AS gt, coalesce(rp.score, 0) AS pred FROM rt FULL JOIN rp USING (pid, scenario, code) WHERE EXISTS (SELECT 1 FROM pr WHERE pr.pid = coalesce(rt.pid, rp.pid) AND pr.scenario = coalesce(rt.scenario, rp.scenario)))"""
_SETS = " GROUP BY GROUPING SETS ((), (scenario))"
_W1 = """, a AS (SELECT {k}, gt, row_number() OVER (PARTITION BY {k} ORDER BY gt) AS i FROM sv), b AS (SELECT {k}, pred, row_number() OVER (PARTITION BY {k} ORDER BY pred) AS i FROM sv)"""
_EV = "WITH ev AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'support' WHEN event_type = 'error' THEN 'oppose' ELSE 'neutral' END AS opinion FROM events)"
ORACLES = {
    "survey_pairs": _S + " SELECT * FROM sv",
    "mae": _S + " SELECT scenario, count(*) AS n, round(avg(abs(gt - pred)), 6) AS mae FROM sv" + _SETS,
    "w1_overall": _S + ", z AS (SELECT *, 1 AS one FROM sv)" + _W1.format(k="one").replace("sv)", "z)") + " SELECT count(*) AS n, round(avg(abs(gt - pred)), 6) AS w1, round(1 / (1 + avg(abs(gt - pred))), 6) AS similarity FROM a JOIN b USING (one, i)",
    "w1_regions": _S + _W1.format(k="scenario") + " SELECT scenario, count(*) AS n, round(avg(abs(gt - pred)), 6) AS w1, round(1 - least(avg(abs(gt - pred)), 1), 6) AS similarity FROM a JOIN b USING (scenario, i) GROUP BY scenario",
    "pearson": _S + ", c AS (SELECT scenario, CASE WHEN count(*) > 1 AND stddev_pop(gt) > 0 AND stddev_pop(pred) > 0 THEN corr(gt, pred) END AS r FROM sv" + _SETS + ") SELECT scenario, round(r, 6) AS r, round(coalesce(r, 0), 6) AS r_or_zero FROM c",
    "regression": _S + " SELECT scenario, count(*) AS n, round(sqrt(sum((gt - pred) * (gt - pred))::DOUBLE / count(*)), 6) AS rmse, round(CASE WHEN var_pop(gt) * count(*) > 1e-9 THEN 1 - sum((gt - pred) * (gt - pred)) / (var_pop(gt) * count(*)) END, 6) AS r2 FROM sv" + _SETS,
    "reasons_aligned": _AL + " SELECT pid, scenario, code, gt, pred FROM al",
    "reason_w1": _AL + """, p AS (SELECT pid, scenario, list_sum(list_transform(range(1, count(*) + 1), lambda i: abs(list_sort(list(gt))[i] - list_sort(list(pred))[i]))) / count(*) AS w FROM al GROUP BY pid, scenario)
      SELECT scenario, count(*) AS n, round(avg(w), 6) AS w1, round(1 / (1 + avg(w)), 6) AS similarity FROM p""" + _SETS,
    "reason_sets": _AL + """, c AS (SELECT scenario, sum((gt > 0 AND pred > 0)::INT)::DOUBLE AS b, sum((gt > 0)::INT) AS t, sum((pred > 0)::INT) AS p, avg(abs(gt - pred)) AS m FROM al""" + _SETS + """)
      SELECT scenario, round(b / p, 6) AS precision, round(b / t, 6) AS recall, round(2 * b / (t + p), 6) AS f1, round(b / (t + p - b), 6) AS jaccard, round(m, 6) AS mean_gap FROM c""",
    "top_reasons_agree": _AL + """, k AS (SELECT pid, scenario, row_number() OVER (PARTITION BY pid, scenario ORDER BY gt DESC, code) AS a, row_number() OVER (PARTITION BY pid, scenario ORDER BY pred DESC, code) AS b FROM al),
      h AS (SELECT pid, scenario, max((a <= 3 AND b <= 3)::INT) AS hit FROM k GROUP BY pid, scenario) SELECT scenario, count(*) AS n, CAST(sum(hit) AS BIGINT) AS correct FROM h GROUP BY scenario""",
    "opinion_shares": _EV + ", c AS (SELECT count(*) AS n, CAST(floor(100 * sum((opinion = 'support')::INT)::DOUBLE / count(*)) AS INT) AS support, CAST(floor(100 * sum((opinion = 'oppose')::INT)::DOUBLE / count(*)) AS INT) AS oppose FROM ev) SELECT *, 100 - support - oppose AS neutral FROM c",
    "opinion_scores": _EV + " SELECT event_id, CASE opinion WHEN 'oppose' THEN 3 WHEN 'support' THEN 8 ELSE 5 END AS score FROM ev",
    "themes_by_opinion": _EV + ", t AS (SELECT opinion, event_type AS theme FROM ev UNION SELECT opinion, 'k' || json_extract_string(props, '$.k') FROM ev) SELECT opinion, string_agg(theme, ',' ORDER BY theme) AS themes FROM t GROUP BY opinion",
    "reactions_flattened": _EV + " SELECT user_id AS pid, event_id % 10 AS cell, arg_max(opinion, event_id) AS opinion FROM ev GROUP BY 1, 2",
    "processing_stats": _EV + " SELECT count(*) AS total, CAST(sum((opinion <> 'oppose')::INT) AS BIGINT) AS successful, CAST(sum((opinion = 'oppose')::INT) AS BIGINT) AS failed FROM ev",
}
