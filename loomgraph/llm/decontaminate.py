"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans each text once.

A text is normalised to words (A-Z lower-cased; ASCII letters, digits and all non-ASCII characters make words). Each distinct
word of the items has a code of two letters from two alphabets, so the automaton's nodes have few children and a match can only
begin at a word. Patterns are the items' windows of ``WINDOW`` consecutive words; an item of fewer words is one pattern. Word
positions of matches are mapped to character offsets of the original text.

The items travel to the executors as words, and each Python worker builds the automaton once. Items of more than
``MAX_ITEM_WORDS`` words in all are split over several automata, each applied to the texts in turn, so that no automaton outgrows
its bound.

Defined cases: null texts and items have no words, so they neither hit nor are hit; an item without words is no pattern; a null
item_id counts as the text ``null``; items with the same id are one item; repeated documents each get their result; empty tables
give empty results, and without items nothing is hit; further columns of the documents pass through unless they bear the name of
an output column.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, map_texts, table

WINDOW = 10
MAX_ITEM_WORDS = 200_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Matcher:
    """The automaton over the windows of (item_id, words) pairs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        import ahocorasick

        vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        base = max(1, int(len(vocabulary) ** 0.5) + 1)
        self.code = {w: chr(0x4E00 + i // base) + chr(0x8E00 + i % base) for w, i in vocabulary.items()}
        patterns: dict[str, set[str]] = {}
        for item, ws in items:
            codes = [self.code[w] for w in ws]
            for i in range(max(1, len(ws) - window + 1)) if ws else ():
                patterns.setdefault("".join(codes[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for p, found in patterns.items():
            self.automaton.add_word(p, (len(p) // 2, tuple(sorted(found))))
        self.any = bool(patterns)
        if self.any:
            self.automaton.make_automaton()

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges (end exclusive) inside any occurrence of a pattern, and the items that the patterns are from."""
        if not self.any or not ws:
            return [], set()
        get, merged, found = self.code.get, [], set()
        for end, (n, items) in self.automaton.iter("".join([get(w, "--") for w in ws])):
            found.update(items)
            stop = end // 2 + 1
            start = stop - n
            while merged and merged[-1][1] >= start:
                start = min(start, merged.pop()[0])
            merged.append((start, stop))
        return merged, found


def _chunks(items: list[tuple[str, list[bytes]]]) -> list[list[tuple[str, list[bytes]]]]:
    chunks, size = [[]], 0
    for item in items:
        if size + len(item[1]) > MAX_ITEM_WORDS and chunks[-1]:
            chunks.append([])
            size = 0
        chunks[-1].append(item)
        size += len(item[1])
    return chunks


_BUILT: dict[tuple[str, int], Matcher] = {}


def _matcher(call: str, number: int, chunk, window: int) -> Matcher:
    """Built once in each Python worker; the automata of another call make way."""
    if (call, number) not in _BUILT:
        for other in [k for k in _BUILT if k[0] != call]:
            del _BUILT[other]
        _BUILT[call, number] = Matcher(chunk.value, window)
    return _BUILT[call, number]


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets (code points, end exclusive) of word ranges."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds n_words, n_hit, hit_items (ids, sorted as strings) and hit_spans (character ranges of the original text) to docs."""
    spark = docs.sparkSession
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").toLocalIterator()
    chunks = _chunks([(r["item"], words(r["text"])) for r in rows])
    call, broadcasts = uuid.uuid4().hex, [spark.sparkContext.broadcast(c) for c in chunks]

    def make():
        def run(texts):
            out: list[tuple] = []
            tokens = [words(t) for t in texts]
            ranges = [[] for _ in texts]
            found: list[set] = [set() for _ in texts]
            for n, b in enumerate(broadcasts):
                m = _matcher(call, n, b, window)
                for i, ws in enumerate(tokens):
                    r, f = m.match(ws)
                    ranges[i] += r
                    found[i] |= f
            for t, ws, r, f in zip(texts, tokens, ranges, found, strict=True):
                r = merge(r)
                out.append((len(ws), sum(b - a for a, b in r), sorted(f), [{"start": a, "end": b} for a, b in char_spans(t, r)]))
            return list(zip(*out, strict=True)) or [[], [], [], []]

        return run

    new = [("n_words", "bigint"), ("n_hit", "bigint"), ("hit_items", "array<string>"), ("hit_spans", "array<struct<start:int,end:int>>")]
    return map_texts(docs, make, new, text, keep_text)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text of documents that stand in a benchmark item's window."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM bi),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM dp),
hit AS (SELECT k, dw.i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.p = bw.p),
pos AS (SELECT DISTINCT k, unnest(range(i, i + n)) AS at FROM hit),
nh AS (SELECT k, count(*) AS n_hit FROM pos GROUP BY k),
ni AS (SELECT k, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (k) LEFT JOIN ni USING (k)
"""
