"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps A-Z to a-z in UTF-8 bytes and leaves all other bytes alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: As LOWER_BYTES, and turns every ASCII byte but letters and digits into a space, so that split() gives the words.
WORD_BYTES = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(128)).translate(LOWER_BYTES) + bytes(range(128, 256))
#: The same words as a Java pattern over lower-cased text.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one below the local temporary folder only where none is set and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/loomgraph-checkpoints"
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends, and lost executors lose nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_training(doc_id: Column, modulus: int, held_out: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def literal_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small fixed table made of literals; needs one row at least."""
    struct = lambda r: F.struct(*((F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).alias(k) for k, v in r.items()))
    return spark.range(1).select(F.inline(F.array(*map(struct, rows))))


def text_key(doc_id: str, text: str) -> Column:
    """Rows with the same id and text share a key, and, as results depend on the text alone, a result."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


#: Rows that a text function gets at once, so that few long texts are in memory together.
SLICE_ROWS = 256


def map_texts(df: DataFrame, make, new: list[tuple[str, str]], text: str = "text", keep_text: bool = False) -> DataFrame:
    """Runs a function over whole texts in Arrow batches; columns of df pass through, but for those that bear a new name.

    make() is called once in each task and gives a function from a list of texts (None for null) to one list for each new
    column. new has names and DDL types.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    names = {n for n, _ in new}
    kept = [f for f in df.schema.fields if f.name not in names and (keep_text or f.name != text)]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in new)).fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    passed = [f.name for f in kept]

    def run(batches):
        import pyarrow as pa

        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                made = f(batch.column(text).to_pylist())
                columns = [batch.column(n).cast(arrow.field(n).type) for n in passed]
                columns += [pa.array(v, type=arrow.field(n).type) for (n, _), v in zip(new, made, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(*dict.fromkeys([*passed, text])).mapInArrow(run, schema)
