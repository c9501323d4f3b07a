"""Text expressions: labels, phrases, cues, keywords, ratings. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = (
    "the", "and", "or", "if", "but", "when", "what", "which", "this", "that", "i", "me", "my", "we", "our", "you", "your", "they", "their", "it", "its", "is",
    "are", "was", "were", "be", "been", "being", "to", "of", "for", "in", "on", "at", "as", "with", "by", "from", "about", "into", "over", "after", "before",
    "so", "because", "due", "since", "therefore", "thus", "then", "also", "too", "very", "not", "no", "do", "did", "does", "have", "has", "had", "a", "an",
)
#: Cues and whether the cause stands before them.
CUES = (("because", False), ("due to", False), ("leads to", True), ("so", True), ("therefore", True))
#: Numbers that opinion words stand for, and the one for any other.
OPINION_SCORES = {"oppose": 3, "neutral": 5, "support": 8}
OPINION_DEFAULT = 5
#: The reason codes.
REASON_CODES = "ABCDEFGHIJKL"
_EDGE = r"[\s,;.:-]+"


def normal_label(label: Column) -> Column:
    return F.trim(F.lower(F.replace(label, F.lit("_"), F.lit(" "))))


def concept_name(label: Column) -> Column:
    """Quotes, backslashes and dashes become underscores, other marks go."""
    return F.regexp_replace(F.regexp_replace(label, r"['\\-]", "_"), r"[^A-Za-z0-9_\s]", "")


def mermaid_label(label: Column) -> Column:
    return F.regexp_replace(F.trim(label), r"[\[\]\"|<>{}]", "")


def slug(label: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(label, r"[^\w\s-]", ""))), r"[-\s]+", "_")


def clean_phrase(phrase: Column) -> Column:
    one = F.regexp_replace(phrase, r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(one, "^" + _EDGE, ""), _EDGE + "$", ""))


def clean_transcript(text: Column) -> Column:
    """Time stamps like [00:01:02] go, white space becomes single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[\d{1,2}:\d{2}(:\d{2})?\]", " "), r"\s+", " "))


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def label_words(label: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(label), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct elements; 0 where there are none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def label_similarity(a: Column, b: Column) -> Column:
    return jaccard(label_words(a), label_words(b))


def causal_pairs(df: DataFrame, sentence: str) -> DataFrame:
    """A row (cause, effect, cue) for each cue that a sentence holds between two phrases; the columns of df stay."""
    found = []
    for n, (cue, cause_first) in enumerate(CUES):
        # "so" counts as a word of its own anywhere, the others between blanks
        there = F.col(sentence).rlike(r"(?i)\bso\b") if cue == "so" else F.contains(F.concat(F.lit(" "), F.lower(sentence), F.lit(" ")), F.lit(f" {cue} "))
        pattern = rf"(?i)^([^\n]+?)\b{cue}\b([^\n]+)"
        left, right = (clean_phrase(F.regexp_extract(sentence, pattern, g)) for g in (1, 2))
        cause, effect = (left, right) if cause_first else (right, left)
        found.append(F.when(there, F.struct(F.lit(n).alias("cue_ord"), cause.alias("cause"), effect.alias("effect"), F.lit(cue).alias("cue"))))
    pairs = df.withColumn("__pair", F.explode(F.array_compact(F.array(*found))))
    return pairs.where((F.col("__pair.cause") != "") & (F.col("__pair.effect") != "")).select(*df.columns, "__pair.*")


def keyword_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often each keyword stands in the texts of a key."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[a-z][a-z\-'_]{2,}"), F.lit(0))
    exploded = df.select(key, F.explode(words).alias("keyword")).where(~F.col("keyword").isin(*STOP_WORDS))
    return exploded.groupBy(key, "keyword").agg(F.count("*").alias("n"))


def top_keywords(df: DataFrame, key: str, text: str, k: int = 8) -> DataFrame:
    """The k most frequent keywords of each key, ties in alphabetical order."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "keyword"))
    return keyword_counts(df, key, text).withColumn("rank", rank).where(F.col("rank") <= k)


def opinion_score(opinion: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in OPINION_SCORES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(opinion))), F.lit(OPINION_DEFAULT))


def rating_scores(response: Column) -> Column:
    """An array of (code, score) of one response, by the rules of ``parse_rating``: the rating first, then A to L."""
    # parsed once for all codes: its lines are an array of (code, value), where both are known
    line = lambda x: F.trim(x)
    rest = lambda x: F.trim(F.regexp_extract(line(x), r"^[^:]*:(.*)$", 1))
    is_rating = lambda x: F.lower(line(x)).startswith("rating:")
    code = lambda x: F.when(is_rating(x), F.lit("rating")).when(line(x).rlike(f"^[{REASON_CODES}][^:]*:"), F.substring(line(x), 1, 1))
    number = lambda x: F.when(is_rating(x), rest(x)).otherwise(F.regexp_extract(rest(x), r"^(\S+)", 1))
    value = lambda x: F.when(number(x).rlike(r"^[+-]?\d{1,9}$"), number(x).try_cast("int"))
    read = F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.struct(code(x).alias("code"), value(x).alias("value")))
    known = F.filter(read, lambda x: x["code"].isNotNull() & x["value"].isNotNull())
    # later lines overwrite earlier ones, a slot for each code
    codes = ["rating", *REASON_CODES]
    slot = lambda x: F.array_position(F.array(*map(F.lit, codes)), x["code"]) - 1
    start = F.array(*(F.lit(5 if c == "rating" else 3) for c in codes))
    last = F.aggregate(known, start, lambda found, x: F.transform(found, lambda old, n: F.when(n == slot(x), x["value"]).otherwise(old)))
    return F.transform(last, lambda v, n: F.struct(F.element_at(F.array(*map(F.lit, codes)), n + 1).alias("code"), F.greatest(F.lit(1), F.least(F.when(n == 0, F.lit(10)).otherwise(F.lit(5)), v)).alias("score")))


def parse_rating(df: DataFrame, key: str, response: str) -> DataFrame:
    """(key, code, score): the rating (code ``rating``, 1 to 10, else 5) and the reasons A to L (1 to 5, else 3); the last line wins.

    A line's number counts if it is an integer; numbers out of range move to its end.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(response, F.lit("")), "\n")).alias("ord", "line"))
    line = F.trim(F.col("line"))
    rest = F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))
    is_rating = F.lower(line).startswith("rating:")
    code = F.when(is_rating, F.lit("rating")).when(line.rlike(f"^[{REASON_CODES}][^:]*:"), F.substring(line, 1, 1))
    number = F.when(is_rating, rest).otherwise(F.regexp_extract(rest, r"^(\S+)", 1))
    value = F.when(number.rlike(r"^[+-]?\d{1,9}$"), number.try_cast("int"))
    parsed = lines.select(key, "ord", code.alias("code"), value.alias("value")).where(F.col("code").isNotNull() & F.col("value").isNotNull())
    last = parsed.groupBy(key, "code").agg(F.max_by("value", "ord").alias("value"))
    wanted = df.select(key).distinct().withColumn("code", F.explode(F.array(*map(F.lit, ["rating", *REASON_CODES]))))
    score = F.when(F.col("code") == "rating", F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("value", F.lit(5))))).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("value", F.lit(3)))))
    return wanted.join(last, [key, "code"], "left").select(key, "code", score.alias("score"))


def parse_opinion(response: Column) -> Column:
    """``opinion|comment|theme, theme``: an opinion other than the three is null."""
    part = lambda n: F.trim(F.coalesce(F.get(F.split(response, r"\|"), n), F.lit("")))
    opinion = F.lower(part(0))
    themes = F.filter(F.transform(F.split(part(2), ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.struct(F.when(opinion.isin(list(OPINION_SCORES)), opinion).alias("opinion"), part(1).alias("comment"), themes.alias("themes"))


def salvage_json(response: Column) -> Column:
    """The text from the first to the last brace, without code fences and comment lines."""
    bare = F.regexp_replace(F.regexp_replace(response, r"```[a-zA-Z]*", ""), r"(?m)^\s*//.*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def chunks(df: DataFrame, text: str, size: int = 10_000) -> DataFrame:
    """(chunk_no, chunk) of at most size characters beside the other columns; an empty text has none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    parts = df.withColumn("__at", F.explode(starts))
    return parts.select(*(c for c in df.columns if c != text), F.floor(F.col("__at") / size).cast("int").alias("chunk_no"), F.substring(F.col(text), F.col("__at") + 1, F.lit(size)).alias("chunk"))
