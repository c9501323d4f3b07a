"""Nearest neighbours by additive quantisation.

A vector's direction is the sum of one codeword from each of ``BOOKS`` codebooks, all of full dimension; each codebook is fitted
to what the ones before it leave (k-means on a sample of at most ``SAMPLE`` vectors, those with the smallest hash of their id).
Encoding is a beam search over the codebooks. Codes and norms of every vector are stored in blocks beside the vectors. A query's
inner products with all codewords make a lookup table, sums of its entries times the norm score all codes of a block, and the
``RERANK`` best of each block are scored again on the original vectors in double precision. Each block gives a query no more than
the neighbours asked for, and these are merged, the best of them within each task first.

Queries and codes meet block by block: queries are packed in stripes of at most ``STRIPE`` rows, so a task holds one block of
vectors and one stripe, whatever the number of either.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components or have another than the most frequent
length take no part, and neither do rows without id; candidates with the query's own id are left out; repeated rows are rows of
their own, as queries and as candidates; ties go to the smaller id; with fewer candidates than asked for all are returned; empty
tables give empty results; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

BOOKS = 16
CODEWORDS = 256
BEAM = 4
SAMPLE = 10_000
ITERATIONS = 6
RERANK = 512
#: Rows of a block; with RERANK it says which share of the rows is scored again, whatever the cluster and the table's size.
BLOCK_ROWS = 8_192
STRIPE = 20_000
QUERY_CHUNK = 128


def _kmeans(x, k: int, iterations: int, seed: int):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(iterations):
        nearest = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        order = np.argsort(nearest, kind="stable")
        present, starts = np.unique(nearest[order], return_index=True)
        centres[present] = np.add.reduceat(x[order], starts, axis=0) / np.diff([*starts, len(x)])[:, None]
        unused = np.setdiff1d(np.arange(len(centres)), present)
        centres[unused] = x[rng.choice(len(x), len(unused))]
    return centres, np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)


def train(vectors, books: int = BOOKS, codewords: int = CODEWORDS, iterations: int = ITERATIONS):
    """Codebooks (books, codewords, dimension) for unit vectors; each is fitted to the residuals of the ones before."""
    import numpy as np

    rest, out = vectors.astype("f4").copy(), []
    for m in range(books):
        centres, nearest = _kmeans(rest, codewords, iterations, m)
        rest -= centres[nearest]
        out.append(np.concatenate([centres, np.zeros((codewords - len(centres), centres.shape[1]), "f4")]))
    return np.stack(out)


def encode(vectors, books, beam: int = BEAM):
    """Codes (rows, books) of unit vectors, by a beam search that keeps the ``beam`` best sums after each codebook."""
    import numpy as np

    n, (m, k, _) = len(vectors), books.shape
    codes = np.zeros((n, 1, 0), "u1")
    rest = vectors.astype("f4")[:, None, :]
    for j in range(m):
        width = rest.shape[1]
        # |r - c|^2 = |r|^2 - 2 r.c + |c|^2
        cost = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(n * width, -1) @ books[j].T).reshape(n, width, k) + (books[j] ** 2).sum(1)
        flat = cost.reshape(n, width * k)
        keep = min(beam, width * k) if j + 1 < m else 1
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep > 1 else flat.argmin(axis=1)[:, None]
        rows = np.arange(n)[:, None]
        from_, word = best // k, best % k
        codes = np.concatenate([codes[rows, from_], word[:, :, None].astype("u1")], axis=2)
        rest = rest[rows, from_] - books[j][word]
    return codes[:, 0, :]


def table_scores(queries, codes, norms, books):
    """Estimated inner products (queries, rows): sums of lookup-table entries, times the stored norms."""
    import numpy as np

    tables = np.einsum("mkd,qd->mkq", books, queries.astype("f4"), optimize=True)
    out = np.empty((len(codes), len(queries)), "f4")
    for at in range(0, len(codes), 2048):
        part = tables[0][codes[at : at + 2048, 0]]
        for m in range(1, len(books)):
            part += tables[m][codes[at : at + 2048, m]]
        out[at : at + 2048] = part * norms[at : at + 2048, None]
    return out.T


def search_block(q_ids, queries, ids, vectors, codes, norms, books, k: int, rerank: int):
    """For each query up to k (position of the query, id, exact inner product), the best first."""
    import numpy as np

    found = []
    for at in range(0, len(queries), QUERY_CHUNK):
        q = queries[at : at + QUERY_CHUNK]
        estimate = np.ascontiguousarray(table_scores(q, codes, norms, books))
        # the query's own row may be among them
        take = min(max(rerank, k + 1), len(ids))
        best = np.argpartition(-estimate, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
        exact = np.einsum("qd,qrd->qr", q.astype("f8"), vectors[best].astype("f8"))
        for i in range(len(q)):
            own = ids[best[i]]
            order = np.lexsort((own, -exact[i]))
            order = order[own[order] != q_ids[at + i]][:k]
            found.append((np.full(len(order), at + i), own[order], exact[i][order]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _valid(rows: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("bigint"), v.cast("array<float>").alias("v"))


def _matrix(column):
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), dtype="f4").reshape(len(flat), -1)


def _pack(rows: DataFrame, books=None, beam: int = BEAM) -> DataFrame:
    """One row for each partition: block (its number), ids, vectors and, with codebooks, codes and norms."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids, vectors = [], []
        for b in batches:
            if b.num_rows:
                ids.append(b.column("vec_id").to_numpy())
                vectors.append(_matrix(b.column("v")))
        if not ids:
            return
        x = np.concatenate(vectors)
        out = {"block": [TaskContext.get().partitionId()], "ids": [np.concatenate(ids).astype("<i8").tobytes()], "vectors": [x.tobytes()]}
        if books is not None:
            norms = np.linalg.norm(x.astype("f8"), axis=1)
            unit = (x / norms[:, None]).astype("f4")
            codes = np.concatenate([encode(unit[a : a + 1024], books.value, beam) for a in range(0, len(x), 1024)])
            out |= {"codes": [codes.tobytes()], "norms": [norms.astype("f4").tobytes()]}
        yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int32())] + [pa.array(v, pa.binary()) for k, v in out.items() if k != "block"], names=list(out))

    return rows.mapInArrow(run, "block int, ids binary, vectors binary" + (", codes binary, norms binary" if books is not None else ""))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", books: int = BOOKS, rerank: int = RERANK) -> DataFrame:
    """rows(vec_id, vector) -> query_id, rank, vec_id, score: each query's k rows of the largest inner product that are found."""
    import numpy as np

    spark = rows.sparkSession
    result = "query_id bigint, rank int, vec_id bigint, score double"
    valid = _valid(rows, vector)
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    dim, n = sizes["d"], sizes["count"]
    valid = valid.where(F.size("v") == dim)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    x = _matrix(sample).astype("f8")
    trained = spark.sparkContext.broadcast(train((x / np.linalg.norm(x, axis=1)[:, None]).astype("f4"), books))
    n_blocks = -(-n // BLOCK_ROWS)
    blocks = materialize(_pack(valid.repartition(n_blocks), trained), "codes")
    chosen = valid.where(is_query)
    n_queries = chosen.count()
    if not n_queries:
        return spark.createDataFrame([], result)
    stripes = -(-n_queries // STRIPE)
    queries = materialize(_pack(chosen.repartition(stripes)).withColumnRenamed("block", "stripe"), "queries")
    # every stripe meets every block: the query set against all rows, in blocks
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    stored = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def meet(a, b):
        import pyarrow as pa

        names = ["stripe", "at", "query_id", "vec_id", "score"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        parts = [[] for _ in names]
        if b.num_rows:
            raw = {c: b.column(c)[0].as_py() for c in ("ids", "vectors", "codes", "norms")}
            ids = np.frombuffer(raw["ids"], "<i8")
            kept = (ids, np.frombuffer(raw["vectors"], "f4").reshape(-1, dim), np.frombuffer(raw["codes"], "u1").reshape(-1, books), np.frombuffer(raw["norms"], "f4"))
            for i in range(a.num_rows):
                q_ids = np.frombuffer(a.column("ids")[i].as_py(), "<i8")
                q = np.frombuffer(a.column("vectors")[i].as_py(), "f4").reshape(-1, dim)
                at, found, score = search_block(q_ids, q, *kept, trained.value, k, rerank)
                for part, v in zip(parts, (np.full(len(at), a.column("stripe")[i].as_py()), at, q_ids[at], found, score), strict=True):
                    part.append(v)
        return pa.table([pa.array(np.concatenate(p) if p else [], t) for p, t in zip(parts, types, strict=True)], names=names)

    best = asked.groupBy("block", "stripe").cogroup(stored.groupBy("block", "stripe")).applyInArrow(meet, "stripe int, at bigint, query_id bigint, vec_id bigint, score double")
    # at most k rows of each block for a query
    # of which the best are taken before the shuffle, and again after it
    place = F.row_number().over(Window.partitionBy("stripe", "at", "query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of embeddings to every twentieth."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
