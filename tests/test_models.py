"""Models that ask a provider: what they read of a response, and how they are planned."""

from pyspark.sql import functions as F

from loomgraph.functions.text import parse_rating, rating_scores
from loomgraph.operators import models as O

ODD = [None, "", "Rating: 7\nA: 4", "rating:12\nA: 9 of 5\nA: 2\nB x: -1\nC: 3.5\nZ: 4", " RATING: x\nRating: 3\nRating: \nL: +5\nL:", "A 4\nD:2 \n\nE: 99999999999", "Rating: 2\nRating: 8 good\nB: 1\nB: 4"]


def test_scores_of_a_response_equal_those_of_the_table(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "k long, response string")
    rows = lambda d: sorted((r.k, r.code, r.score) for r in d.collect())
    assert rows(df.select("k", F.inline(rating_scores(F.col("response"))))) == rows(parse_rating(df, "k", "response"))


def test_prompted_models_neither_sort_nor_group(spark):
    agents = spark.createDataFrame([(n, "p", "t") for n in range(5)], "agent_id long, profile string, transcript string")
    proposals = spark.createDataFrame([("x|1", "d"), ("y", "e")], "proposal_id string, description string")
    found = O.MODELS["transcript"](agents, proposals)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Aggregate", "SortMergeJoin", "Sort ["))
    assert {(r.agent_id, r.proposal_id) for r in found.collect()} == {(str(n), p) for n in range(5) for p in ("x|1", "y")} and found.count() == 10 * 13
