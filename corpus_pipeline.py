"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
SQL cannot express the stages, so ``ORACLE_SQL`` is None and the tests hold the pipeline against a brute-force version.

Defined cases: a null text counts as empty in every stage and stays null; an empty text is neither toxic, contaminated nor
personal, and is a copy of other empty ones; of repeated rows, and of rows with equal texts, the near-duplicate stage keeps the
first by doc_id, null ids last, whatever the ids of the others; ties go by the text's hash and then by row; further columns of the
documents are left out before any stage sees them, so none can clash; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import byte_bpe, decontaminate, near_copies, pii, toxicity
from loomgraph.llm.common import in_training, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; it learns from the labelled rows of documents as op1 does."""
    learns = in_training(F.col("doc_id"), 3, 1)
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), learns)
    scored = toxicity.score_texts(docs.select(COLUMNS), model, keep_text=True)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links between near copies connect, the one first by doc_id, text and row stays.

    Ball hashing of SimHash fingerprints of five-word shingles finds the pairs, and a Jaccard similarity of 0.8 verifies them.
    """
    return near_copies.keep_one_of_each(docs.select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), keep_text=True)
    return found.where(F.col("n_hit") == 0).select(COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; n_chars becomes the new length."""
    docs = docs.select(COLUMNS)
    return pii.redact(docs, pii.find_personal_data(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of a round trip."""
    return byte_bpe.round_trip(docs.select(COLUMNS), with_ids=True).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{n}")
    return docs
