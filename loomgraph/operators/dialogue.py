"""Operators on questions and answers: pairing, counts, follow-ups, snapshots, graphs from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .edges import dedupe

FOLLOW_UP_CHARS = 10
MERGE_EVERY = 3


def qa_pairs(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, turn, question, answer): each user turn with the assistant turn right behind."""
    w = W.partitionBy("conv_id").orderBy("turn")
    following = turns.withColumns({"__role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return following.where("role = 'user' AND __role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def category_counts(qa: DataFrame, category: str) -> DataFrame:
    return qa.groupBy(category).agg(F.count("*").alias("n"))


def ends_dialogue(question: Column) -> Column:
    """A follow-up of fewer than ten characters ends a dialogue."""
    return F.length(F.trim(F.coalesce(question, F.lit("")))) < FOLLOW_UP_CHARS


def snapshots(steps: DataFrame, key: str, order: str, every: int = MERGE_EVERY) -> DataFrame:
    """Every third step of a key, counted from 1, and its last."""
    w = W.partitionBy(key)
    numbered = steps.withColumns({"step": F.row_number().over(w.orderBy(order)), "__last": F.count("*").over(w)})
    return numbered.where((F.col("step") % every == 0) | (F.col("step") == F.col("__last"))).drop("__last")


def follow_up_queue(questions: DataFrame, key: str, k: int) -> DataFrame:
    """The k questions of a key that come first by priority, then text."""
    return questions.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("priority", "text"))).where(F.col("rank") <= k)


def merge_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct (g, cause, effect) of both, in the order in which they first stood."""
    both = old.withColumn("__at", F.lit(0)).unionByName(new.withColumn("__at", F.lit(1)))
    first = both.groupBy("g", "cause", "effect").agg(F.min(F.struct("__at", "ord")).alias("first"))
    return first.select("g", "cause", "effect", F.row_number().over(W.partitionBy("g").orderBy("first", "cause", "effect")).alias("ord"))


def factors(pairs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(g, factor, ord): causes and effects, then keywords, each once whatever its case; the first spelling stays."""
    ends = pairs.select("g", F.posexplode(F.array("cause", "effect")).alias("p", "factor"), (F.col("ord") * 2).alias("o")).select("g", "factor", F.struct(F.lit(0).alias("kind"), (F.col("o") + F.col("p")).cast("bigint").alias("at")).alias("at"))
    words = keywords.select("g", F.col("keyword").alias("factor"), F.struct(F.lit(1).alias("kind"), F.col("rank").cast("bigint").alias("at")).alias("at"))
    clean = ends.union(words).withColumn("factor", T.clean_phrase(F.col("factor"))).where("factor <> ''")
    first = clean.groupBy("g", F.lower("factor").alias("k")).agg(F.min_by("factor", "at").alias("factor"), F.min("at").alias("at"))
    return first.select("g", "factor", F.row_number().over(W.partitionBy("g").orderBy("at", "factor")).alias("ord"))


def context_graph(texts: DataFrame, stance: str) -> DataFrame:
    """texts(g, text, stance) -> (g, src, dst, relation, cue): factors contribute to the stance, causes to effects; a causal edge overrides."""
    said = texts.select("g", F.posexplode(T.sentences(F.col("text"))).alias("s", "sentence"))
    pairs = T.causal_pairs(said, "sentence").withColumn("ord", F.row_number().over(W.partitionBy("g").orderBy("s", "cue_ord")))
    nodes = factors(pairs.select("g", "cause", "effect", "ord"), T.top_keywords(texts, "g", "text"))
    to_stance = nodes.join(texts.select("g", F.concat(F.lit("stance::"), F.col(stance)).alias("dst")), "g").select("g", F.col("factor").alias("src"), "dst", "ord", F.lit("contributes").alias("relation"), F.lit(None).cast("string").alias("cue"))
    causal = pairs.select("g", F.col("cause").alias("src"), F.col("effect").alias("dst"), (F.lit(1_000_000) + F.col("ord")).alias("ord"), F.lit("causal").alias("relation"), "cue")
    return dedupe(to_stance.unionByName(causal)).select("g", "src", "dst", "relation", "cue")


def label_graph(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, cause, effect) -> nodes (g, label) and edges (g, src, dst, n): one node for each normal label, relations counted."""
    named = relations.withColumns({c: T.normal_label(F.col(c)) for c in ("cause", "effect")}).where("cause <> effect")
    nodes = named.select("g", F.explode(F.array("cause", "effect")).alias("label")).distinct()
    return nodes, named.groupBy("g", F.col("cause").alias("src"), F.col("effect").alias("dst")).agg(F.count("*").alias("n"))
