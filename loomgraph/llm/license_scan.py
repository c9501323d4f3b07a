"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows over a text's words, whatever its line ends: each window is two neighbouring stretches. Templates are
classed by their length, and each class has stretches of its own, of ``STRETCH`` words, or twice, four times as many and so on, so
that a place of a template's length lies in some block whole, wrapped or not; a template may have any length, and long ones change
nothing for short ones. A block and a template are sets of words; a template is found where the block holds at least ``threshold`` of its words. The words of templates are put in
order of their frequency in all texts, rarest first. Then only the first words of each side in that order can bring a pair
together (prefix filter), a block with too few of the templates' words takes no part (length filter), and a pair whose words
after the shared one are too few falls out before it is verified (positional filter). All of it is DataFrame functions.

Defined cases: a null text counts as empty; an empty text has no words and no labels; repeated rows each get their result; an
empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, ascii_lower, literal_rows, materialize, table, text_key

THRESHOLD = 0.85
#: Words of half a block at least.
STRETCH = 32
#: The index of templates is broadcast up to about so many bytes; beyond, Spark joins it by a shuffle.
BROADCAST_BYTES = 8_000_000


class Template(NamedTuple):
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(self.text.lower().split()))


#: The base phrases of the contract.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: The method's templates.
TEMPLATES = (
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def words_of(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0))


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def vocabulary_of(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def token_order(own: DataFrame, templates: Sequence[Template]) -> list[str]:
    """The templates' words, those that are rarest in all texts first, from own(own), each text's words that templates have."""
    counts = {r["word"]: r["count"] for r in own.select(F.explode("own").alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary_of(templates), key=lambda w: (counts.get(w, 0), w))


def least_shared(templates: Sequence[Template], threshold: float) -> int:
    """No block with fewer of the templates' words can hold a template."""
    return min(_needed(len(t.words), threshold) for t in templates)


def stretch_of(template: Template) -> int:
    """The words of a stretch of the template's class."""
    n = STRETCH
    while n < len(template.text.split()):
        n *= 2
    return n


def classes_of(templates: Sequence[Template]) -> list[tuple[int, list[Template]]]:
    """The templates by the words of their stretches."""
    return [(n, [t for t in templates if stretch_of(t) == n]) for n in sorted(set(map(stretch_of, templates)))]


def stretches(words: Column, templates: Sequence[Template], n: int) -> Column:
    """For each stretch of n words its distinct words that templates have."""
    vocabulary = vocabulary_of(templates)
    numbers = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / n).cast("int"))
    own = lambda k: F.array_distinct(F.filter(F.slice(words, k * n + 1, n), lambda w: w.isin(vocabulary)))
    return F.when(F.size(words) > 0, F.transform(numbers, own)).otherwise(F.array().cast("array<array<string>>"))


def candidate_blocks(halves: Column, templates: Sequence[Template], threshold: float = THRESHOLD) -> Column:
    """The stretches' words -> those of each block, two stretches, that passes the length filter."""
    least, n = least_shared(templates, threshold), F.greatest(F.size(halves) - 1, F.lit(1))
    blocks = F.zip_with(F.slice(halves, 1, n), F.slice(halves, 2, n), lambda a, b: F.array_union(a, F.coalesce(b, F.array().cast("array<string>"))))
    return F.filter(blocks, lambda block: F.size(block) >= least)


def find_templates(blocks: DataFrame, templates: Sequence[Template], order: Sequence[str], key: str, threshold: float = THRESHOLD) -> DataFrame:
    """blocks(key, blocks) -> every (key, label, containment) of a block that holds at least threshold of a template's words; the largest of each label."""
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for n, t in enumerate(templates):
        ranks = sorted(rank[w] for w in t.words)
        need = _needed(len(ranks), threshold)
        index += [{"rank": r, "at": i, "template": n, "label": t.label, "size": len(ranks), "need": need, "ranks": ranks} for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    index_df = literal_rows(blocks.sparkSession, index)
    if sum(64 + 4 * r["size"] for r in index) <= BROADCAST_BYTES:
        index_df = F.broadcast(index_df)
    least = least_shared(templates, threshold)

    ranked = F.array_sort(F.transform("block", lambda w: F.array_position(F.array(*map(F.lit, order)), w).cast("int") - 1))
    held_df = blocks.where(F.size("blocks") > 0).select(key, F.explode("blocks").alias("block")).select(key, ranked.alias("held"))
    held = F.size("held")
    first = held_df.select(key, "held", F.posexplode(F.slice("held", 1, held - least + 1)).alias("pos", "rank"))
    pairs = first.join(index_df, "rank").where((held >= F.col("need")) & (F.col("pos") <= held - F.col("need")))
    pairs = pairs.where(1 + F.least(F.col("size") - F.col("at") - 1, held - F.col("pos") - 1) >= F.col("need"))
    shared = F.size(F.array_intersect("held", "ranks"))
    found = pairs.select(key, "label", "need", shared.alias("shared"), "size").where(F.col("shared") >= F.col("need"))
    return found.groupBy(key, "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Index, from 0, of every place where the phrase's words stand consecutively."""
    parts = phrase.split()

    def at(w: Column, i: Column) -> Column:
        here = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            here &= F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(here, i.cast("long"))

    return F.filter(F.transform(words, at), lambda i: i.isNotNull())


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", text_key("doc_id", "text").alias("__key"), ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    base = docs.withColumn("words", words_of(F.col("low")))
    places = [F.when(reduce(and_, (F.contains("low", F.lit(w)) for w in p.split())), phrase_starts(F.col("words"), p)) for _, p in phrases]
    classes = classes_of(templates)
    halves = [stretches(F.col("words"), ts, n).alias(f"halves_{n}") for n, ts in classes]
    base = base.select("doc_id", "__key", "words", *halves, *(F.coalesce(x, F.array().cast("array<bigint>")).alias(f"at_{n}") for n, x in enumerate(places)))
    starts = F.flatten(F.array(*(F.col(f"at_{n}") for n in range(len(phrases)))))
    labels = F.array(*(F.when(F.size(f"at_{n}") > 0, F.lit(label)) for n, (label, _) in enumerate(phrases)))
    # a word counts once in each stretch that has it; only the order of the counts matters
    own = [F.flatten(f"halves_{n}").alias(f"own_{n}") for n, _ in classes]
    blocks = [candidate_blocks(F.col(f"halves_{n}"), ts, threshold).alias(f"blocks_{n}") for n, ts in classes]
    base = base.select("doc_id", "__key", F.size("words").cast("long").alias("n_words"), starts.alias("starts"), F.array_distinct(F.array_compact(labels)).alias("base"), *own, *blocks)
    base = materialize(base, "license-words")
    of_class = lambda n, ts: find_templates(base.select("__key", F.col(f"blocks_{n}").alias("blocks")), ts, token_order(base.select(F.col(f"own_{n}").alias("own")), ts), "__key", threshold)
    found = reduce(DataFrame.union, [of_class(n, ts) for n, ts in classes])
    found = found.groupBy("__key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    result = base.join(found, "__key", "left")
    return result.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every whole text of documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join(f"('{t.label}', {t.words!r}, {_needed(len(t.words), THRESHOLD)})" for t in TEMPLATES)
_STRETCH = max(map(stretch_of, TEMPLATES))  # the SQL is for templates of one class
_PHRASE_ROWS = ", ".join(f"('{label}', {p.split()!r})" for label, p in PHRASES)
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT k, doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
ph(label, parts) AS (VALUES {_PHRASE_ROWS}),
pos AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM w),
hits AS (SELECT k, label, i - 1 AS start FROM pos JOIN ph ON words[i] = parts[1] AND words[i:i + len(parts) - 1] = parts),
base AS (SELECT k, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labs FROM hits GROUP BY k),
win AS (SELECT k, words, unnest(CASE WHEN len(words) <= {2 * _STRETCH} THEN [0] ELSE range(0, len(words) - {_STRETCH}, {_STRETCH}) END) AS s FROM w),
blocks AS (SELECT k, list_distinct(words[s + 1:s + {2 * _STRETCH}]) AS b FROM win),
tpl(label, ws, need) AS (VALUES {_TEMPLATE_ROWS}),
found AS (SELECT k, label, len(list_intersect(b, ws)) / len(ws) AS c FROM blocks, tpl WHERE len(list_intersect(b, ws)) >= need),
m AS (SELECT k, list(DISTINCT label) AS labs, max(c) AS c FROM found GROUP BY k)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labs), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labs, []), coalesce(m.labs, [])))), ',') AS labels,
  CAST(greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(m.c, 0)) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN m USING (k)
"""
