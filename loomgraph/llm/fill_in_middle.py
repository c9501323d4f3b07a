"""Fill-in-the-middle transformation of whole texts.

A text is cut into units by a pattern, matched left to right over code points. An Arrow-batched pandas UDF collects the units'
end offsets in a compact array; two numbers of a SHA-256 digest of a seed and the row's id choose two of the offsets, which slice
the text into prefix, middle and suffix; two more choose whether the row is transformed and in which order:

* ``plain``: the text itself, where it is empty or holds a marker already, or where the rate leaves it alone
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle

As a text with a marker stays plain and a marker can't arise where two pieces meet, ``restore`` gives the exact text back from
the output and its form. Nothing is drawn: the same id, text and seed give the same output in any task, on any retry.

Defined cases: a null text counts as empty, is plain and gives an empty output; a null id counts as the empty text in the digest;
repeated rows each get their result, the same for the same id; equal texts under other ids are cut elsewhere; a text without a
line end is one unit, and one of a single very long unit is cut at its ends only; an empty table gives an empty result; further
columns pass through, unless they bear an output's name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, table

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 7
#: Percent of texts that are transformed, and of these the percent in suffix-prefix-middle order.
RATE, SPM_RATE = 100, 50

OUTPUT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
DIGESTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def draws(seed: int, row_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def unit_ends(finditer, text: str) -> array:
    """The end offset of each unit, eight bytes each."""
    return array("q", (m.end() for m in finditer(text)))


def transform(text: str, ends: array, numbers: list[int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int | None, int | None, str]:
    """Form, code points of prefix and middle, and output."""
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= rate or any(m in text for m in MARKERS):
        return PLAIN, None, None, text
    units = len(ends) + 1
    first, last = sorted((h1 % units, h2 % units))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == PLAIN:
        return output
    opening, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, _, rest = output.removeprefix(opening).partition(second)
    other, _, middle = rest.partition(MIDDLE)
    return head + middle + other if form == PSM else other + middle + head


def _rows(texts: list, ids: list, finditer, seed: int, rate: int, spm_rate: int) -> Iterator[tuple]:
    for text, row_id in zip(texts, ids, strict=True):
        text = text or ""
        ends = unit_ends(finditer, text)
        yield len(ends), *transform(text, ends, draws(seed, row_id), rate, spm_rate)


def _udf(returns: str, finish, pattern: str, seed: int, rate: int, spm_rate: int):
    """A pandas UDF of (text, id) whose struct has the columns of returns; finish turns an output into their last values."""
    names = [part.split()[0] for part in returns.split(", ")]

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        finditer = regex.compile(pattern).finditer
        for texts, ids in batches:
            # ids as Python integers: a batch with nulls holds floats, which large ids don't fit
            numbers = [None if pd.isna(x) else int(x) for x in ids]
            for at in range(0, len(texts), SLICE_ROWS):
                cut = slice(at, at + SLICE_ROWS)
                made = [(*row[:4], *finish(row[4], row[1])) for row in _rows(texts.iloc[cut].tolist(), numbers[cut], finditer, seed, rate, spm_rate)]
                frame = pd.DataFrame(made, columns=names)
                yield frame.astype({c: "Int64" for c in ("n", "prefix_chars", "middle_chars")})

    return run


def _applied(docs: DataFrame, udf, returns: str, text: str, doc_id: str, keep_text: bool) -> DataFrame:
    new = [part.split()[0] for part in returns.split(", ")]
    passed = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    # decimal text of the id: longs with nulls would reach pandas as floats
    made = docs.withColumn("__fim", udf(F.col(text), F.col(doc_id).cast("decimal(38,0)")))
    return made.select(*passed, *(F.col(f"__fim.{c}").alias(c) for c in new))


def fill_in_middle(docs: DataFrame, pattern: str = LINES, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars and output to docs. doc_id must be of an integer type."""
    udf = _udf(OUTPUT, lambda output, _: (output,), pattern, seed, rate, spm_rate)
    return _applied(docs, udf, OUTPUT, text, doc_id, keep_text)


def digests(docs: DataFrame, pattern: str = LINES, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As ``fill_in_middle``, with digests of the output and of the text restored from it in place of the output."""

    def finish(output: str, form: str) -> tuple[str, str]:
        return tuple(hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (output, restore(output, form)))

    return _applied(docs, _udf(DIGESTS, finish, pattern, seed, rate, spm_rate), DIGESTS, text, doc_id, False)


def restore_texts(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Puts text, rebuilt from output and form, in the place of output; a null output stays null."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return made.withColumn("text", run(output, form)).drop(*({output} - {"text"}))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut points and digests of every whole text of documents."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
    ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u
), p AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
