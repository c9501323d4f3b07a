"""New motifs from old ones. Draws depend on hashes of the keys, so a run repeats itself.

Members are rows (grp, ord, labels): the labels of a motif's nodes, in an order that is the same for all motifs of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import pick, uniform
from .surveys import numbered

BORROW, CHANGE_NODE, REPLACE = 0.5, 0.3, 0.8


def by_neighbour(members: DataFrame, samples: int) -> DataFrame:
    """(grp, sample, base, other, labels): a member with, half the time, a third of its labels mixed with another member's.

    Groups of one member give none. A mixed label is one word of each, where both have several.
    """
    placed = members.withColumns({"__n": F.count("*").over(W.partitionBy("grp")), "__i": F.row_number().over(W.partitionBy("grp").orderBy("ord")) - 1})
    groups = placed.where("__n > 1 AND __i = 0").select("grp", "__n", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    a = F.floor(uniform("base", F.col("grp"), F.col("sample")) * F.col("__n")).cast("int")
    # another place: some steps on, but never all the way round
    b = F.pmod(a + 1 + F.floor(uniform("other", F.col("grp"), F.col("sample")) * (F.col("__n") - 1)).cast("int"), F.col("__n")).cast("int")
    drawn = groups.select("grp", "sample", a.alias("a"), b.alias("b"))
    side = lambda at, name: placed.select("grp", F.col("__i").alias(at), F.col("ord").alias(name), F.col("labels").alias(f"{name}_labels"))
    both = drawn.join(side("a", "base"), ["grp", "a"]).join(side("b", "other"), ["grp", "b"])

    def mixed(x, i):
        one, two = F.split(x["a"], " "), F.split(x["b"], " ")
        words = F.concat_ws(" ", pick(one, F.lit("w1"), F.col("grp"), F.col("sample"), i), pick(two, F.lit("w2"), F.col("grp"), F.col("sample"), i))
        change = (uniform("borrow", F.col("grp"), F.col("sample")) < BORROW) & (uniform("node", F.col("grp"), F.col("sample"), i) < CHANGE_NODE)
        return F.when(change & (F.size(one) > 1) & (F.size(two) > 1), words).otherwise(x["a"])

    pairs = F.arrays_zip(F.col("base_labels").alias("a"), F.col("other_labels").alias("b"))
    return both.select("grp", "sample", "base", "other", F.transform(pairs, mixed).alias("labels"))


def by_bootstrap(members: DataFrame, samples: int) -> DataFrame:
    """(grp, sample, labels): the first member's shape, each label replaced, four times out of five, by any of the library's distinct labels.

    The labels are numbered and looked up by number, so they are never gathered.
    """
    labels = numbered(members.select(F.explode("labels").alias("label")).where("label <> ''").distinct(), "label").select(F.col("__at").alias("at"), F.col("label").alias("drawn"))
    n = labels.count()
    first = members.groupBy("grp").agg(F.min_by("labels", "ord").alias("labels"))
    slots = first.select("grp", F.posexplode("labels").alias("i", "label"), F.sequence(F.lit(1), F.lit(samples)).alias("s")).select("grp", "i", "label", F.explode("s").alias("sample"))
    slots = slots.withColumn("at", F.when(uniform("keep", F.col("grp"), F.col("sample"), F.col("i")) < REPLACE, F.floor(uniform("label", F.col("grp"), F.col("sample"), F.col("i")) * n).cast("bigint")))
    filled = slots.join(labels, "at", "left").select("grp", "sample", F.struct("i", F.coalesce("drawn", "label").alias("l")).alias("x"))
    return filled.groupBy("grp", "sample").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("grp", "sample", F.transform("xs", lambda x: x["l"]).alias("labels"))


def library(members: DataFrame, neighbour: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """(grp, method, labels) of the library with what was added to it."""
    own = members.select("grp", F.lit("original").alias("method"), "labels")
    added = neighbour.select(F.concat("grp", F.lit("_augmented")).alias("grp"), F.lit("nearest_neighbor").alias("method"), "labels")
    return own.union(added).union(bootstrap.select(F.concat("grp", F.lit("_bootstrapped")).alias("grp"), F.lit("bootstrapping").alias("method"), "labels"))


def summary(augmented: DataFrame) -> DataFrame:
    """(method, groups, motifs)."""
    return augmented.groupBy("method").agg(F.countDistinct("grp").alias("groups"), F.count("*").alias("motifs"))
