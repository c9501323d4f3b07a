"""Survey tables, agents, forum participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import uniform
from ..sources.shared import materialize

#: Codes that demographic answers stand for, and the one for any other.
INCOME = {"0-25000": "low_income", "25000-50000": "low_income", "50000-75000": "middle_income", "75000-100000": "middle_income", "100000+": "high_income"}
EDUCATION = {"high school": "high_school", "some college": "some_college", "bachelor's": "bachelor", "master's": "postgraduate", "doctorate": "postgraduate"}
OCCUPATION = {"student": "student", "professional": "white_collar", "service": "service", "retired": "retired", "other": "other"}
CODE_MAPS = {"income": (INCOME, "middle_income"), "education": (EDUCATION, "bachelor"), "occupation": (OCCUPATION, "white_collar")}
#: Words of a role and what they tell, the first that fits.
ROLE_AGES = ((("elder", "retiree"), 65, 85), (("young", "student", "millennial"), 18, 35), (("child",), 8, 12), (("adolescent",), 13, 17))
ROLE_AGE_DEFAULT = (30, 60)
ROLE_INCOMES = ((("low-income", "tenant", "homeless"), "$15,000-$40,000"), (("professional", "tech worker", "architect"), "$80,000-$120,000"))
ROLE_EDUCATION = ((("professional", "expert", "architect"), "master's degree or higher"), (("worker", "artist"), "bachelor's degree"))
ROLE_HOUSING = ((("homeowner",), "homeowner"), (("tenant", "renter"), "renter"), (("homeless",), "unhoused"))
#: Degrees by which an agent is moved off the centre of its ZIP code at most.
JITTER = 0.003


def coded(kind: str, answer: Column) -> Column:
    table, default = CODE_MAPS[kind]
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), answer), F.lit(default))


def role_profile(role: Column, *keys: Column) -> Column:
    """struct(age, income, education, occupation, housing) that a role's words tell; ages are drawn by the keys."""
    low = F.lower(role)
    has = lambda words: F.greatest(*(F.contains(low, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(low, F.lit(words[0]))

    def first(rules, default):
        out = None
        for words, value in rules:
            out = F.when(has(words), value) if out is None else out.when(has(words), value)
        return out.otherwise(default)

    draw = lambda lo, hi: (lo + F.floor(uniform(F.lit("age"), *keys) * (hi - lo + 1))).cast("int")
    age = first([(w, draw(lo, hi)) for w, lo, hi in ROLE_AGES], draw(*ROLE_AGE_DEFAULT))
    return F.struct(
        age.alias("age"),
        first(ROLE_INCOMES, "$40,000-$80,000").alias("income"),
        first(ROLE_EDUCATION, "high school graduate").alias("education"),
        F.trim(F.replace(role, F.lit("Perspective"), F.lit(""))).alias("occupation"),
        first(ROLE_HOUSING, "mixed housing situation").alias("housing"),
    )


def unpivot_scenarios(wide: DataFrame, pid: str, reason_codes: dict[str, str], default_code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A survey's wide table -> opinions (pid, scenario, score) and reasons (pid, scenario, code, score).

    Columns ``Scenario 1.2...`` hold ratings, those with a ``[reason]`` hold its weight. Answers that are no integers are left
    out; of several rows of a participant the one that comes first counts.
    """
    import re

    ratings, weights = {}, {}
    for c in wide.columns:
        m = re.match(r"Scenario (\d+\.\d+)", c)
        if m:
            reason = re.search(r"\[(.+?)\]", c)
            if reason is None:
                ratings[c] = m[1]
            elif code := reason_codes.get(reason[1].strip(), default_code):
                weights[c] = (m[1], code)
    rows = wide.withColumn("__ord", F.monotonically_increasing_id())
    first = rows.groupBy(F.col(f"`{pid}`").alias("pid")).agg(F.min_by(F.struct(*(F.col(f"`{c}`").cast("string").alias(f"c{n}") for n, c in enumerate([*ratings, *weights]))), "__ord").alias("x"))
    cell = lambda n: F.col(f"x.c{n}").try_cast("int")
    o = F.array(*(F.struct(F.lit(s).alias("scenario"), cell(n).alias("score")) for n, s in enumerate(ratings.values())))
    opinions = first.select("pid", F.inline(o)).where(F.col("score").isNotNull())
    w = [F.struct(F.lit(s).alias("scenario"), F.lit(code).alias("code"), cell(len(ratings) + n).alias("score")) for n, (s, code) in enumerate(weights.values())]
    reasons = first.select("pid", F.inline(F.array(*w))).where(F.col("score").isNotNull()) if w else opinions.limit(0).withColumn("code", F.lit(""))
    return opinions, reasons


def place_agents(agents: DataFrame, zips: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Adds lat and lng: the centre of the agent's ZIP code, else the default, moved by a little that the agent's id draws."""
    joined = agents.join(zips.select("zip", F.col("lat").alias("__lat"), F.col("lng").alias("__lng")), "zip", "left")
    off = lambda k: (uniform(F.lit(k), F.col("agent_id")) * 2 - 1) * JITTER
    return joined.withColumns({"lat": F.coalesce("__lat", F.lit(default[0])) + off("lat"), "lng": F.coalesce("__lng", F.lit(default[1])) + off("lng")}).drop("__lat", "__lng")


def with_default(agents: DataFrame, dim: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """agents with the columns of dim, and the given values where dim lacks the key."""
    joined = agents.join(dim.select(key, *(F.col(c).alias(f"__{c}") for c in columns)), key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", F.lit(v)) for c, v in columns.items()}).drop(*(f"__{c}" for c in columns))


def agent_ids(agents: DataFrame, order: str) -> DataFrame:
    """Agents without id are called by their place, agent_000 onwards."""
    missing = numbered(agents.where(F.col("agent_id").isNull()), order).withColumn("agent_id", F.format_string("agent_%03d", F.col("__at"))).drop("__at")
    return agents.where(F.col("agent_id").isNotNull()).unionByName(missing)


def weighted_choice(df: DataFrame, weights: dict[str, float], *keys: str) -> Column:
    """A value drawn by the keys, as often as its weight says."""
    total, run, out = sum(weights.values()), 0.0, None
    u = uniform(*map(F.col, keys))
    for value, w in weights.items():
        run += w / total
        out = F.when(u < run, value) if out is None else out.when(u < run, value)
    return out.otherwise(value)


#: Ranges of ages and how often each is drawn.
AGE_RANGES = ((18, 24, 0.15), (25, 34, 0.25), (35, 44, 0.20), (45, 54, 0.15), (55, 64, 0.15), (65, 85, 0.10))


def weighted_sample(rows: DataFrame, k: int, weight: str, *keys: str, by: str | None = None, seed: int = 0) -> DataFrame:
    """k rows drawn without replacement, each next one as likely as its weight among what is left, with rank, the order of the draws.

    A row waits -ln(u) / weight for its draw, u from the seed and its keys, and the k that wait least are drawn; such a top k of a
    part of the rows is all that the whole needs of it, so one pass does, with at most k rows (or k of each value of ``by``) from a
    task. Rows with equal keys draw alike and are told apart by nothing; rows without a positive weight are never drawn; fewer
    rows than k are all drawn.
    """
    wait = -F.log1p(-uniform(F.lit(seed), *map(F.col, keys))) / F.col(weight)
    waiting = rows.where(F.col(weight) > 0).withColumn("__wait", wait)
    if by:
        return waiting.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("__wait", *keys))).where(F.col("rank") <= k).drop("__wait")
    # no more than k rows are ranked
    return waiting.orderBy("__wait", *keys).limit(k).withColumn("rank", F.row_number().over(W.orderBy("__wait", *keys))).drop("__wait")


def uniform_points(rows: DataFrame, bounds: dict[str, float], *keys: str, seed: int = 0) -> DataFrame:
    """Adds lat and lng, drawn evenly within bounds (north, south, east, west), to six digits."""
    at = lambda name, low, high: F.round(F.lit(low) + (high - low) * uniform(F.lit(seed), F.lit(name), *map(F.col, keys)), 6)
    return rows.withColumns({"lat": at("lat", bounds["south"], bounds["north"]), "lng": at("lng", bounds["west"], bounds["east"])})


def drawn_agents(rows: DataFrame, bounds: dict[str, float], options: dict[str, list[str]], *keys: str, ages=AGE_RANGES, seed: int = 0) -> DataFrame:
    """rows with a place, an age (a range by its weight, then evenly within) and one of each attribute's options."""
    u = lambda name: uniform(F.lit(seed), F.lit(name), *map(F.col, keys))
    total, run, age = sum(w for *_, w in ages), 0.0, None
    for low, high, w in ages:
        run += w
        within = (F.lit(low) + F.floor(u("age") * (high - low + 1))).cast("int")
        age = F.when(u("range") < run / total, within) if age is None else age.when(u("range") < run / total, within)
    chosen = {a: F.element_at(F.array(*map(F.lit, values)), F.floor(u(a) * len(values)).cast("int") + 1) for a, values in options.items()}
    return uniform_points(rows, bounds, *keys, seed=seed).withColumns({"age": age.otherwise(within), **chosen})


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch: rows in their order by ``size``."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("__at") / size).cast("bigint")).drop("__at")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Adds __at, the rows' places from 0. They come from counts of ranges, so no task sees all rows."""
    held = materialize(rows.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = held.groupBy("__p").agg(F.count("*").alias("n"))
    # one row for each partition
    offsets = counts.withColumn("__off", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(W.partitionBy("__p").orderBy(order)) - 1
    return held.withColumn("__at", local).join(F.broadcast(offsets), "__p").withColumn("__at", F.col("__at") + F.col("__off")).drop("__p", "__off")


def flatten_topics(participants: DataFrame, tag: str | None = None) -> DataFrame:
    """participants(username, topics of struct(post_id, stance, mcqs of struct(question_id, tag))) -> a row for each question."""
    topics = participants.select("username", F.explode("topics").alias("t")).select("username", "t.post_id", "t.stance", F.explode("t.mcqs").alias("m"))
    rows = topics.select("username", "post_id", "stance", "m.question_id", "m.tag")
    return rows if tag is None else rows.where(F.col("tag") == tag)


def participant_summary(participants: DataFrame) -> DataFrame:
    """(username, n_topics, n_train, n_mcqs, n_tags); topics carry their split."""
    t = participants.select("username", F.explode_outer("topics").alias("t"))
    rows = t.select("username", "t.post_id", "t.split", F.explode_outer("t.mcqs").alias("m"))
    return rows.groupBy("username").agg(
        F.countDistinct("post_id").alias("n_topics"),
        F.countDistinct(F.when(F.col("split") == "train", F.col("post_id"))).alias("n_train"),
        F.count("m.question_id").alias("n_mcqs"),
        F.countDistinct("m.tag").alias("n_tags"),
    )


def comment_analysis(participants: DataFrame) -> DataFrame:
    """(username, post_id, n_mcqs, tags) of each topic."""
    t = participants.select("username", F.explode("topics").alias("t"))
    return t.select("username", "t.post_id", F.size("t.mcqs").alias("n_mcqs"), F.transform("t.mcqs", lambda m: m["tag"]).alias("tags"))


def stance_distribution(topics: DataFrame) -> DataFrame:
    return topics.where(F.coalesce(F.col("stance"), F.lit("")) != "").groupBy("stance").agg(F.count("*").alias("n"))


def split(rows: DataFrame, key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds split: train for about ``share`` of the keys, by a hash, else test."""
    return rows.withColumn("split", F.when(uniform(F.lit(seed), F.col(key)) < share, "train").otherwise("test"))


def dataset_faults(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, fault): keys that are missing, that are too many, or stand more than once."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("__e", F.lit(1)).join(n, key, "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select(key, fault.alias("fault")).where(F.col("fault").isNotNull())


def unprocessed(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key), key, "left_anti")
