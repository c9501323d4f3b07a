"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation becomes the prompt.

The prefix is rendered once; what follows in either conversation becomes its completion, as segments with a mask that is 1 for
what the assistant says (with its end marker) and 0 for headers and other speakers. All of it is DataFrame functions with one
shuffle, by pair; an output row holds the pair's turns, so a pair must fit a row.

The table of conversations has no preferences of its own, so the query makes them: a conversation as it stands is chosen, and the
same conversation with the last turn of its neighbour (0 and 1, 2 and 3, ...) in the place of its own is rejected.

Defined cases: turns are in order of turn, then role, then text, so ties and repeated rows have one order; null roles and texts
count as empty; a pair that lacks a side has an empty prompt there and ``complete`` false; turns of a null pair or conversation
belong to none and are left out; texts and roles that look like a marker have a space put into it; texts of any length are
rendered whole; an empty table gives an empty result; further columns of the turns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _header(t: Column) -> Column:
    role = F.replace(F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _segments(turns: Column, speaker: str) -> Column:
    mask = lambda t: F.when(t["role"] == speaker, 1).otherwise(0)
    return F.flatten(F.transform(turns, lambda t: F.array(F.struct(_header(t).alias("text"), F.lit(0).alias("mask")), F.struct(_body(t).alias("text"), mask(t).alias("mask")))))


def turns_of(keep: Column | None = None) -> Column:
    """Aggregates turns, those where keep is true, to an array in order."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turn = F.struct("turn", empty("role"), empty("text"))
    return F.array_sort(F.collect_list(turn if keep is None else F.when(keep, turn)))


def format_pairs(pairs: DataFrame, key: str, chosen: str, rejected: str, speaker: str = "assistant") -> DataFrame:
    """pairs(key, chosen and rejected: arrays of turn, role and text without nulls), one row each, as ``format_preferences`` returns them."""
    pairs = pairs.select(F.col(key).alias("__key"), F.col(chosen).alias("__a"), F.col(rejected).alias("__b"))
    both = F.least(F.size("__a"), F.size("__b"))
    same = F.zip_with(F.slice("__a", 1, both), F.slice("__b", 1, both), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("__n", F.when(differs > 0, differs.cast("int") - 1).otherwise(both))
    rest = lambda side: F.slice(F.col(side), F.col("__n") + 1, F.size(side))
    pairs = pairs.select(
        F.col("__key").alias(key),
        ((F.size("__a") > 0) & (F.size("__b") > 0)).alias("complete"),
        F.col("__n").cast("long").alias("n_prompt_turns"),
        _render(F.slice("__a", 1, F.col("__n"))).alias("prompt"),
        _segments(rest("__a"), speaker).alias("chosen_segments"),
        _segments(rest("__b"), speaker).alias("rejected_segments"),
    )
    return pairs.withColumns({s: F.array_join(F.col(f"{s}_segments.text"), "") for s in ("chosen", "rejected")})


def format_preferences(turns: DataFrame, pair: str, chosen: Column, speaker: str = "assistant") -> DataFrame:
    """turns(pair, turn, role, text), of which those where ``chosen`` is true are the chosen side.

    Returns pair, complete, n_prompt_turns, prompt, chosen_segments and rejected_segments (arrays of text and mask), chosen and
    rejected (the segments' texts joined).
    """
    sides = turns.where(F.col(pair).isNotNull()).groupBy(F.col(pair).alias("__pair")).agg(turns_of(chosen).alias("__chosen"), turns_of(~chosen).alias("__rejected"))
    return format_pairs(sides.withColumnRenamed("__pair", pair), pair, "__chosen", "__rejected", speaker)


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last turn; masks as runs of mask:characters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    even = F.pmod("conv_id", F.lit(2)) == 0
    two = turns.groupBy(F.floor(F.col("conv_id") / 2).alias("k")).agg(turns_of(even).alias("even"), turns_of(~even).alias("odd"))
    # each of the two in turn is the chosen one; without a neighbour there is nothing to reject
    answered = lambda own, other: F.when((F.size(own) > 0) & (F.size(other) > 0), F.concat(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(other, -1, 1))).otherwise(F.col(other))
    side = lambda n, own, other: F.struct((F.col("k") * 2 + n).alias("conv_id"), F.col(own).alias("chosen"), answered(own, other).alias("rejected"))
    sides = F.filter(F.array(side(0, "even", "odd"), side(1, "odd", "even")), lambda p: F.size(p["chosen"]) > 0)
    pairs = format_pairs(two.select(F.inline(sides)), "conv_id", "chosen", "rejected")
    runs = lambda s: F.array_join(F.transform(f"{s}_segments", lambda x: F.concat(x["mask"].cast("string"), F.lit(":"), F.length(x["text"]).cast("string"))), ",")
    return pairs.select("conv_id", "complete", "n_prompt_turns", "prompt", "chosen", "rejected", runs("chosen").alias("chosen_mask"), runs("rejected").alias("rejected_mask"))


OP3_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  '<|' || replace(replace(coalesce(role, ''), '<|', '< |'), '|>', '| >') || '|>' || chr(10) AS header, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS size FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
last AS (SELECT * FROM o WHERE i = size),
pair AS (SELECT o.conv_id, any_value(o.size) AS size, any_value(l.conv_id) IS NOT NULL AS complete FROM o LEFT JOIN last l ON l.conv_id = (o.conv_id // 2) * 4 + 1 - o.conv_id GROUP BY o.conv_id),
side AS (SELECT conv_id, 0 AS side, i, role, text, header, body FROM o
  UNION ALL SELECT conv_id, 1, i, role, text, header, body FROM o JOIN pair USING (conv_id, size) WHERE complete AND i < size
  UNION ALL SELECT pair.conv_id, 1, pair.size, l.role, l.text, l.header, l.body FROM pair JOIN last l ON l.conv_id = (pair.conv_id // 2) * 4 + 1 - pair.conv_id),
x AS (SELECT a.conv_id, min(a.i) - 1 AS same FROM side a JOIN side b ON a.conv_id = b.conv_id AND a.i = b.i AND a.side = 0 AND b.side = 1 AND (a.role <> b.role OR a.text <> b.text) GROUP BY a.conv_id),
s AS (SELECT side.*, complete, CASE WHEN complete THEN coalesce(same, size) ELSE 0 END AS n FROM side JOIN pair USING (conv_id) LEFT JOIN x USING (conv_id))
SELECT conv_id, any_value(complete) AS complete, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(header || body, '' ORDER BY i) FILTER (side = 0 AND i <= n), '') AS prompt,
  coalesce(string_agg(header || body, '' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen,
  coalesce(string_agg(header || body, '' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected,
  coalesce(string_agg('0:' || length(header) || ',' || (role = 'assistant')::INT || ':' || length(body), ',' ORDER BY i) FILTER (side = 0 AND i > n), '') AS chosen_mask,
  coalesce(string_agg('0:' || length(header) || ',' || (role = 'assistant')::INT || ':' || length(body), ',' ORDER BY i) FILTER (side = 1 AND i > n), '') AS rejected_mask
FROM s GROUP BY conv_id
"""
