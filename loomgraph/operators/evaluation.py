"""Scores of predicted opinions and reasons against the truth.

Opinions are rows (pid, scenario, gt, pred), reasons (pid, scenario, code, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import safe_corr, wasserstein


def match(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairs of (pid, scenario) with a truth and a prediction that is not null."""
    p = predicted.where(F.col("score").isNotNull()).withColumnRenamed("score", "pred")
    return truth.withColumnRenamed("score", "gt").join(p, ["pid", "scenario"])


def mae(matched: DataFrame) -> DataFrame:
    """(scenario, n, mae) of every scenario, and of all with a null scenario, in one aggregation."""
    gap = F.abs(F.col("gt") - F.col("pred"))
    return matched.groupingSets([[], ["scenario"]], "scenario").agg(F.count("*").alias("n"), F.avg(gap).alias("mae"))


def _sorted_gaps(matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w1): by value counts, so that neither side is gathered or sorted as rows.

    W1 on integers is the sum of the differences between the two running counts, value by value.
    """
    sides = matched.select(*keys, F.explode(F.array(F.struct(F.col("gt").alias("v"), F.lit(1).alias("d")), F.struct(F.col("pred").alias("v"), F.lit(-1).alias("d")))).alias("x"))
    by_value = sides.groupBy(*keys, "x.v").agg(F.sum("x.d").alias("d"), F.sum(F.when(F.col("x.d") > 0, 1).otherwise(0)).alias("n"))
    w = W.partitionBy(*keys).orderBy("v") if keys else W.partitionBy(F.lit(0)).orderBy("v")
    step = by_value.withColumns({"run": F.sum("d").over(w), "next": F.lead("v").over(w)})
    total = step.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.abs("run") * (F.coalesce("next", "v") - F.col("v"))).alias("area"))
    return total.select(*keys, "n", F.try_divide(F.col("area"), F.col("n")).alias("w1"))


def w1_overall(matched: DataFrame) -> DataFrame:
    """(n, w1, similarity = 1 / (1 + w1)) of all ratings as two samples of integers."""
    return _sorted_gaps(matched, []).withColumn("similarity", 1 / (1 + F.col("w1")))


def w1_regions(matched: DataFrame) -> DataFrame:
    """(scenario, n, w1, similarity = 1 - min(w1, 1))."""
    return _sorted_gaps(matched, ["scenario"]).withColumn("similarity", 1 - F.least(F.col("w1"), F.lit(1.0)))


def pearson(matched: DataFrame) -> DataFrame:
    """(scenario, r, r_or_zero) per scenario and overall; r is null where a side has no spread, and then r_or_zero is 0."""
    r = safe_corr("gt", "pred")
    return matched.groupingSets([[], ["scenario"]], "scenario").agg(r.alias("r"), F.coalesce(r, F.lit(0.0)).alias("r_or_zero"))


def regression(matched: DataFrame) -> DataFrame:
    """(scenario, n, rmse, r2) per scenario and overall; r2 is null without spread in the truth."""
    sse = F.sum((F.col("gt") - F.col("pred")) * (F.col("gt") - F.col("pred"))).cast("double")
    sst = F.sum(F.col("gt") * F.col("gt")) - F.sum("gt") * F.sum("gt") / F.count("*")
    return matched.groupingSets([[], ["scenario"]], "scenario").agg(F.count("*").alias("n"), F.sqrt(sse / F.count("*")).alias("rmse"), F.when(sst > 1e-9, 1 - sse / sst).alias("r2"))


def align_reasons(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(pid, scenario, code, gt, pred) over the codes of either side where both have the pair; a code that one lacks is 0 there."""
    pairs = truth.select("pid", "scenario").distinct().join(predicted.select("pid", "scenario").distinct(), ["pid", "scenario"], "left_semi")
    both = truth.withColumnRenamed("score", "gt").join(predicted.withColumnRenamed("score", "pred"), ["pid", "scenario", "code"], "full").na.fill(0, ["gt", "pred"])
    return both.join(pairs, ["pid", "scenario"], "left_semi")


def reason_w1(aligned: DataFrame) -> DataFrame:
    """(scenario, n, w1, similarity): the mean over pairs of the distance of their score vectors; a pair has twelve codes at most."""
    pairs = aligned.groupBy("pid", "scenario").agg(wasserstein(F.collect_list("gt"), F.collect_list("pred")).alias("w"))
    out = pairs.groupingSets([[], ["scenario"]], "scenario").agg(F.count("*").alias("n"), F.avg("w").alias("w1"))
    return out.withColumn("similarity", 1 / (1 + F.col("w1")))


def reason_sets(aligned: DataFrame) -> DataFrame:
    """(scenario, precision, recall, f1, jaccard, mean_gap) of the codes that are present, summed over pairs."""
    both, t, p = (F.sum(F.when(c, 1).otherwise(0)) for c in ((F.col("gt") > 0) & (F.col("pred") > 0), F.col("gt") > 0, F.col("pred") > 0))
    precision, recall = F.try_divide(both, p), F.try_divide(both, t)
    return aligned.groupingSets([[], ["scenario"]], "scenario").agg(
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * both, t + p).alias("f1"),
        F.try_divide(both, t + p - both).alias("jaccard"),
        F.avg(F.abs(F.col("gt") - F.col("pred"))).alias("mean_gap"),
    )


def top_reasons_agree(aligned: DataFrame, k: int = 3) -> DataFrame:
    """(scenario, n, correct): pairs whose k best codes of either side share one at least."""
    rank = lambda c: F.row_number().over(W.partitionBy("pid", "scenario").orderBy(F.desc(c), "code"))
    ranked = aligned.withColumns({"a": rank("gt"), "b": rank("pred")})
    pairs = ranked.groupBy("pid", "scenario").agg(F.max(F.when((F.col("a") <= k) & (F.col("b") <= k), 1).otherwise(0)).alias("hit"))
    return pairs.groupBy("scenario").agg(F.count("*").alias("n"), F.sum("hit").alias("correct"))


def opinion_shares(opinions: DataFrame, opinion: str) -> DataFrame:
    """(n, support, oppose, neutral) in whole percents: the first two cut off, the last what remains."""
    share = lambda o: F.floor(F.try_divide(100 * F.sum(F.when(F.col(opinion) == o, 1).otherwise(0)), F.count("*"))).cast("int")
    return opinions.agg(F.count("*").alias("n"), share("support").alias("support"), share("oppose").alias("oppose")).withColumn("neutral", 100 - F.col("support") - F.col("oppose"))


def themes_by_opinion(opinions: DataFrame, opinion: str, themes: str) -> DataFrame:
    """(opinion, themes): the distinct themes, sorted."""
    one = opinions.select(F.col(opinion).alias("opinion"), F.explode(themes).alias("theme")).distinct()
    return one.groupBy("opinion").agg(F.array_sort(F.collect_list("theme")).alias("themes"))


def flatten_reactions(reactions: DataFrame, comments: str) -> DataFrame:
    """comments, an array of struct(cell, opinion), becomes (pid, cell, opinion); the last of a cell counts."""
    flat = reactions.select("pid", F.posexplode(comments).alias("ord", "c"))
    return flat.groupBy("pid", F.col("c.cell").alias("cell")).agg(F.max_by("c.opinion", "ord").alias("opinion"))


def processing_stats(items: DataFrame, ok: Column) -> DataFrame:
    good = F.sum(F.when(ok, 1).otherwise(0))
    return items.agg(F.count("*").alias("total"), good.alias("successful"), (F.count("*") - good).alias("failed"))
