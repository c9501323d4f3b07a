"""Language identification by compression.

Each language has a zstandard dictionary of raw content: normalised pieces of labelled texts, end to end. A text is normalised
alike (lower case, every run without letters one space) and compressed in blocks of ``BLOCK`` bytes against each dictionary; as
every block is compressed by itself, a long text can't live on what it has said before and must lean on the dictionary all the
way. The language of the smallest sum of sizes is chosen. The margin is how much smaller it is than the runner-up, as a share of
the runner-up; a choice with a narrow margin is rejected.

The classifier is fitted on a bounded sample: ``SAMPLE_TEXTS`` labelled texts for each language, on average, and of each the first
``SAMPLE_CHARS`` characters, chosen by a hash of the id, so that the driver gets no more than languages x ``SAMPLE_TEXTS`` x
``SAMPLE_CHARS`` characters. Counts by language cover all rows and thin the sample before it is ordered. Every text is classified
whole. Work is in proportion to the number of languages, and every task holds all dictionaries.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is never rejected nor learnt from; of languages
with equal sizes, as a few letters have, the one with the most labelled rows is chosen (of as many, the first by name), and
rejected, as the margin is 0; with one language only the margin is 1; without any labelled text everything is ``und``; repeated
rows each get their result; empty tables give empty results; further columns pass through, unless they bear an output's name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_training, map_texts, table

UNDETERMINED = "und"
#: Bounds of the sample: labelled texts for each language, on average, and characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 64, 1000
#: Bytes that are compressed at once, and zstandard's level.
BLOCK, LEVEL = 4096, 6
#: A choice whose margin is below is rejected; SCALE turns margins into scores.
MIN_MARGIN, SCALE = 0.02, 0.05

_NO_LETTERS = re.compile(r"[\W\d_]{2,}|[^\w ]|[\d_]").sub


def normalise(text: str | None) -> bytes:
    """Lower-cased words with single spaces between them; empty for a text without letters."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return _NO_LETTERS(" ", text.lower()).encode("utf-8", "surrogatepass")


class Compressors:
    """One compressor for each language, with its dictionary digested once. Of equal sizes the first in order wins."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK) -> None:
        import zstandard

        self.block, self.by_language = block, {}
        for language, data in dictionaries.items():
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.by_language[language] = zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, data: bytes) -> dict[str, int]:
        blocks = [data[at : at + self.block] for at in range(0, len(data), self.block)]
        return {language: sum(len(c.compress(b)) for b in blocks) for language, c in self.by_language.items()}

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and margin."""
        data = normalise(text)
        if not data or not self.by_language:
            return UNDETERMINED, 0.0
        sizes = self.sizes(data)
        first, *others = sorted(sizes, key=sizes.__getitem__)
        return first, 1 - sizes[first] / sizes[others[0]] if others else 1.0


def sample(docs: DataFrame, learns: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Pieces of labelled texts by language, the languages with the most rows first.

    With u uniform in 0 to 1 by row, the rows with u x (rows of the language) below a bound are as many for any language, so
    that one ordered limit takes about as many of each, and all of a rare one. Rows far beyond the bound go before the ordering.
    """
    labelled = docs.where(learns & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = labelled.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("__rows"))
    known = sorted(((r["__lang"], r["__rows"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    if not known:
        return {}
    rows_of = F.create_map(*(F.lit(x) for pair in known for x in pair))[F.col(lang)]
    u = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
    thinned = labelled.select(F.col(lang).alias("lang"), F.substring(text, 1, chars).alias("piece"), (u * rows_of).alias("turn")).where(F.col("turn") < 4 * texts)
    pieces: dict[str, list[str]] = {language: [] for language, _ in known}
    for r in thinned.orderBy("turn", "lang", "piece").limit(texts * len(known)).collect():
        pieces[r["lang"]].append(r["piece"])
    return pieces


def fit(docs: DataFrame, learns: Column, **where) -> dict[str, bytes]:
    """A dictionary for each language that a row of docs has with learns true; where are arguments of ``sample``."""
    found = {language: b" ".join(filter(None, map(normalise, pieces))) for language, pieces in sample(docs, learns, **where).items()}
    return {language: data for language, data in found.items() if data}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds nearest (the language of the smallest size), margin, and language, which is null where the margin is too narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        compressors = Compressors(shared.value)

        def run(texts):
            found = [compressors.classify(t) for t in texts]
            kept = [language if language == UNDETERMINED or margin >= min_margin else None for language, margin in found]
            return [[language for language, _ in found], [margin for _, margin in found], kept]

        return run

    return map_texts(docs, make, [("nearest", "string"), ("margin", "double"), ("language", "string")], text, keep_text)


def score(margin: Column) -> Column:
    """0 for a tie, near 1 for a wide margin."""
    return F.lit(1.0) - F.exp(-margin / SCALE)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all whole texts of documents, learnt from labelled rows whose crc32 modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learns = in_training(F.col("doc_id"), 4, 2)
    found = identify(docs.select("doc_id", "text"), fit(docs, learns))
    return found.select("doc_id", (~learns).alias("held_out"), F.col("nearest").alias("lang_pred"), score(F.col("margin")).alias("score"), "margin", F.col("language").isNull().alias("rejected"))
