"""Similar labels, vectors and motifs, and groups made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import cosine
from ..sources.shared import materialize

LABEL_THRESHOLD = 0.4
VECTOR_THRESHOLD = 0.85
LINK_THRESHOLD = 0.6
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 20_000
#: Vectors of a tile: of pairs, and of queries and rows.
PAIR_TILE, QUERY_TILE, ROW_TILE = 1024, 4096, 8192


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a look at no more than rows + 1 of its rows shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def similar_labels(labels: DataFrame, key: str, label: str, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """Pairs (a, b, similarity) of distinct labels in one key with a word overlap of threshold or more.

    Labels are made distinct first, and only labels that share a word meet; a word that many labels have is met through the
    rarest words: by the prefix filter, a pair over the threshold shares one of the first words of each, in the order of how
    many labels have a word.
    """
    distinct = labels.select(key, label).distinct().withColumn("ws", F.array_distinct(T.label_words(F.col(label)))).where(F.size("ws") > 0)
    word = distinct.select(key, label, F.explode("ws").alias("w"))
    freq = word.groupBy("w").agg(F.count("*").alias("df"))
    ordered = word.join(freq, "w").groupBy(key, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("ws"))
    # prefix filter for the overlap that a Jaccard of threshold asks of a set of n words
    prefix = F.slice("ws", 1, F.size("ws") - F.ceil(threshold * F.size("ws") - 1e-9).cast("int") + 1)
    heads = ordered.select(key, label, "ws", F.explode(prefix).alias("w"))
    left = heads.select(key, "w", F.col(label).alias("a"), F.col("ws").alias("wa"))
    right = heads.select(key, "w", F.col(label).alias("b"), F.col("ws").alias("wb"))
    pairs = left.join(right, [key, "w"]).where("a < b").select(key, "a", "b", T.jaccard(F.col("wa"), F.col("wb")).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold).distinct()


def _matrix(vectors):
    """(values, known) of an Arrow list column: a matrix of doubles for each length that occurs, with the places of its rows; vectors with nulls are left out."""
    import numpy as np
    import pyarrow as pa

    found: dict = {}
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets, values = flat.offsets.to_numpy(), flat.values.cast(pa.float64())
    whole = flat.is_valid().to_numpy(zero_copy_only=False)
    if values.null_count:
        holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        whole = whole & (holes[offsets[1:]] == holes[offsets[:-1]])
    numbers, sizes = values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for size in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == size))
        found[int(size)] = at, numbers[offsets[at][:, None] + np.arange(size)]
    return found


def _dot(a, b):
    """Products of rows with rows, added from the first component on, as ``numeric.cosine`` adds them."""
    import numpy as np

    out = np.zeros(len(a))
    for n in range(a.shape[1]):
        out = out + a[:, n] * b[:, n]
    return out


def _tiles(rows: DataFrame, block: str, key: str, size: int) -> DataFrame:
    """rows with __t, a tile of about size rows within the block, and __n, the number of the block's tiles."""
    counts = rows.groupBy(block).agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    return rows.join(counts, block).withColumn("__t", F.pmod(F.xxhash64(key), F.col("__n")).cast("int"))


def similar_vectors(rows: DataFrame, key: str, vector: str, threshold: float = VECTOR_THRESHOLD, block: Column | None = None) -> DataFrame:
    """Pairs (a, b, cosine) of keys within a block whose vectors' cosine is threshold or more.

    A block is dealt into tiles, and a task holds two tiles at a time: their cosines come from one product of matrices, and the
    pairs that it leaves near the threshold or above are computed again component by component.
    """
    v = rows.select((block if block is not None else F.lit(0)).alias("__block"), F.col(key).alias("__key"), F.col(vector).alias("__v")).where("__block IS NOT NULL AND __key IS NOT NULL AND __v IS NOT NULL")
    kind = dict(v.dtypes)["__key"]
    tiled = _tiles(v, "__block", "__key", PAIR_TILE)
    # a tile meets itself and every other one
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    dealt = tiled.withColumn("__o", other).select("__block", F.least("__t", "__o").alias("__i"), F.greatest("__t", "__o").alias("__j"), (F.col("__t") <= F.col("__o")).alias("__left"), "__key", "__v")

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, same = table.column("__key").combine_chunks(), table.column("__i")[0] == table.column("__j")[0]
        left = table.column("__left").to_numpy()
        none = np.zeros(0, np.int64)
        ones, twos, cosines = [none], [none], [np.zeros(0)]
        with np.errstate(all="ignore"):
            for at, m in _matrix(table.column("__v")).values():
                square = _dot(m, m)
                at, m, square = (x[square != 0] for x in (at, m, square))
                norm, first = np.sqrt(square), left[at]
                a, b = (np.flatnonzero(first), np.flatnonzero(first if same else ~first))
                scaled = m / norm[:, None]
                for start in range(0, len(a), 256):
                    part = a[start : start + 256]
                    # a NaN counts as large, as it does in SQL
                    near = ~(scaled[part] @ scaled[b].T < threshold - 1e-9)
                    x, y = np.nonzero(near)
                    x, y = part[x], b[y]
                    if same:
                        x, y = x[x < y], y[x < y]
                    exact = _dot(m[x], m[y]) / (norm[x] * norm[y])
                    kept = ~(exact < threshold)
                    ones.append(at[x[kept]])
                    twos.append(at[y[kept]])
                    cosines.append(exact[kept])
        one, two = (pc.take(keys, pa.array(np.concatenate(n))) for n in (ones, twos))
        return pa.table({"one": one, "two": two, "cosine": pa.array(np.concatenate(cosines))})

    met = dealt.groupBy("__block", "__i", "__j").applyInArrow(run, f"one {kind}, two {kind}, cosine double")
    return met.where("one <> two").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "cosine")


def best_vectors(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, threshold: float | None = None) -> DataFrame:
    """(q, key, cosine, rank): each query's k best rows but itself.

    Queries and rows are dealt into tiles, and a task holds a tile of each: a product of matrices leaves each query the rows that
    may be among the tile's k best, equal vectors as their first keys; those are computed again component by component.
    Rows without a cosine (a side is zero, holds nulls, or is of another length) come last.
    """
    count = lambda df, size: max(1, -(-df.count() // size))
    side = lambda df, flag: df.select(F.lit(flag).alias("__query"), F.col(key).alias("__key"), F.col(vector).alias("__v")).where("__key IS NOT NULL")
    asked, held = side(queries, True), side(rows, False)
    kind = dict(held.dtypes)["__key"]
    n_asked, n_held = count(asked, QUERY_TILE), count(held, ROW_TILE)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda n: F.pmod(F.xxhash64("__key"), F.lit(n)).cast("int")
    dealt = asked.withColumns({"__i": tile(n_asked), "__j": spread(n_held)}).union(held.withColumns({"__i": spread(n_asked), "__j": tile(n_held)}))

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table.column("__key")))
        keys, query = table.column("__key").combine_chunks(), table.column("__query").to_numpy()
        # equal keys have equal places
        place = pc.rank(keys, tiebreaker="min").to_numpy().astype(np.int64)
        q_out, r_out, c_out, null_out = [], [], [], []
        rows_at = np.flatnonzero(~query)
        with np.errstate(all="ignore"):
            shapes = {size: (at, m, _dot(m, m)) for size, (at, m) in _matrix(table.column("__v")).items()}
            left = set(np.flatnonzero(query).tolist())
            for at, m, square in shapes.values():
                norm = np.sqrt(square)
                asks = np.flatnonzero(query[at] & (square != 0))
                left -= set(at[asks].tolist())
                has = np.flatnonzero(~query[at] & (square != 0))
                lone = np.setdiff1d(rows_at, at[has])[: k + 1]
                # distinct vectors, each with its first keys; has is in the order of keys
                _, group = np.unique(m[has], axis=0, return_inverse=True) if len(has) else (None, np.zeros(0, np.int64))
                group = group.ravel()
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0]) if len(has) else np.zeros(0, np.int64)
                ends = np.r_[starts[1:], len(order)].astype(np.int64)
                scaled = m[has[order[starts]]] / norm[has[order[starts]]][:, None]
                for start in range(0, len(asks), 256):
                    part = asks[start : start + 256]
                    if len(starts):
                        score = (m[part] / norm[part][:, None]) @ scaled.T
                        score[np.isnan(score)] = np.inf
                        # one more than k, as the query may be among them
                        bound = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)] if len(starts) > k + 1 else np.full(len(part), -np.inf)
                        x, v = np.nonzero(score >= bound[:, None] - 1e-9)
                        length = np.minimum(ends[v] - starts[v], k + 1)
                        x = np.repeat(x, length)
                        y = has[order[np.repeat(starts[v], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]]
                        x = part[x]
                        exact = _dot(m[x], m[y]) / (norm[x] * norm[y])
                        # the tile's k best of each query
                        apart = place[at[x]] != place[at[y]]
                        x, y, exact = x[apart], y[apart], exact[apart]
                        by = np.lexsort((at[y], -np.where(np.isnan(exact), np.inf, exact), x))
                        x, y, exact = x[by], y[by], exact[by]
                        new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, bool)
                        rank = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0)) if len(x) else np.zeros(0, np.int64)
                        q_out.append(at[x[rank < k]])
                        r_out.append(at[y[rank < k]])
                        c_out.append(exact[rank < k])
                        null_out.append(np.zeros((rank < k).sum(), bool))
                    if len(has) <= k and len(lone):
                        q_out.append(np.repeat(at[part], len(lone)))
                        r_out.append(np.tile(lone, len(part)))
                        c_out.append(np.zeros(len(part) * len(lone)))
                        null_out.append(np.ones(len(part) * len(lone), bool))
        # queries that have no cosine with anything
        bare, lone = np.array(sorted(left), np.int64), rows_at[: k + 1]
        q_out.append(np.repeat(bare, len(lone)))
        r_out.append(np.tile(lone, len(bare)))
        c_out.append(np.zeros(len(bare) * len(lone)))
        null_out.append(np.ones(len(bare) * len(lone), bool))
        one, two = (pc.take(keys, pa.array(np.concatenate(n).astype(np.int64))) for n in (q_out, r_out))
        return pa.table({"q": one, "r": two, "cosine": pa.array(np.concatenate(c_out), mask=np.concatenate(null_out))})

    scored = dealt.groupBy("__i", "__j").applyInArrow(run, f"q {kind}, r {kind}, cosine double").where("q <> r").withColumnRenamed("r", key)
    if threshold is not None:
        scored = scored.where(F.col("cosine") > threshold)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("cosine"), key)))
    return ranked.where(F.col("rank") <= k)


def resolve(new: DataFrame, known: DataFrame, threshold: float = VECTOR_THRESHOLD) -> DataFrame:
    """new(g, label, vector), known(g, node, label, vector, ord) -> (g, label, node): the node of the same label, else the first whose cosine is threshold or more, else null."""
    exact = new.join(known.groupBy("g", "label").agg(F.min_by("node", "ord").alias("exact")), ["g", "label"], "left")
    near = new.alias("x").join(known.alias("k"), "g").where(cosine(F.col("x.vector"), F.col("k.vector")) >= threshold)
    near = near.groupBy("g", F.col("x.label").alias("label")).agg(F.min_by("k.node", "k.ord").alias("near"))
    return exact.join(near, ["g", "label"], "left").select("g", "label", F.coalesce("exact", "near").alias("node"))


def motif_similarity(a_labels: Column, b_labels: Column, a_places: Column, b_places: Column) -> Column:
    """Nodes in the same order: label similarity, .1 more for the same place, weighted 1.5 but for places in between."""
    sims = F.zip_with(F.arrays_zip(a_labels.alias("l"), a_places.alias("p")), F.arrays_zip(b_labels.alias("l"), b_places.alias("p")), lambda x, y: F.struct(
        F.least(F.lit(1.0), T.label_similarity(x["l"], y["l"]) + F.when(x["p"] == y["p"], 0.1).otherwise(0.0)).alias("s"), F.when(x["p"] == "intermediate", 1.0).otherwise(1.5).alias("w")))
    add = lambda f: F.aggregate(sims, F.lit(0.0), lambda t, x: t + f(x))
    return F.coalesce(F.try_divide(add(lambda x: x["s"] * x["w"]), add(lambda x: x["w"])), F.lit(0.0))


def plain_motif_similarity(a_labels: Column, b_labels: Column) -> Column:
    sims = F.zip_with(a_labels, b_labels, lambda x, y: T.label_similarity(x, y))
    return F.coalesce(F.try_divide(F.aggregate(sims, F.lit(0.0), lambda t, x: t + x), F.size(sims)), F.lit(0.0))


def leader_groups(items: DataFrame, bucket: str, item: str, labels: str, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """(bucket, item, leader): in the order of items, each that no leader has taken leads, and takes later ones near enough to itself.

    Distinct label lists are grouped, not items, so that a bucket holds each list once, however many items have it. Leaders of a
    bucket are kept by its task; everything else of the bucket streams past them.
    """

    def run(table):
        import pyarrow as pa

        rows = sorted(zip(table.column("first").to_pylist(), table.column("ws").to_pylist(), strict=True))
        leaders: list = []
        holders: dict = {}
        out = []
        for first, words in rows:
            sets = [frozenset(w) for w in words]
            # only leaders that share a word somewhere can be near enough
            tried = sorted({n for i, s in enumerate(sets) for w in s for n in holders.get((i, w), ())}) if threshold > 0 else range(len(leaders))
            hit = None
            for n in tried:
                other = leaders[n][1]
                if len(other) == len(sets):
                    sim = sum(len(a & b) / len(a | b) if a | b else 0.0 for a, b in zip(sets, other, strict=True)) / max(1, len(sets))
                    if sim >= threshold:
                        hit = leaders[n][0]
                        break
            if hit is None:
                for i, s in enumerate(sets):
                    for w in s:
                        holders.setdefault((i, w), []).append(len(leaders))
                leaders.append((first, sets))
                hit = first
            out.append((table.column("bucket")[0].as_py(), first, hit))
        return pa.table({n: [r[i] for r in out] for i, n in enumerate(("bucket", "first", "leader"))}, schema=pa.schema([("bucket", pa.string()), ("first", pa.int64()), ("leader", pa.int64())]))

    keyed = items.select(F.col(bucket).cast("string").alias("bucket"), F.col(item).cast("bigint").alias("item"), F.transform(labels, lambda x: F.array_sort(F.array_distinct(T.label_words(x)))).alias("ws"))
    lists = keyed.groupBy("bucket", "ws").agg(F.min("item").alias("first"))
    led = lists.groupBy("bucket").applyInArrow(run, "bucket string, first bigint, leader bigint")
    named = lists.join(led, ["bucket", "first"]).select("bucket", "ws", "leader")
    return keyed.join(named, ["bucket", "ws"]).select(F.col("bucket").alias(bucket), F.col("item").alias(item), "leader")


def _group_sizes(grouped: DataFrame, by: str, group: str, counts: str | None) -> DataFrame:
    return grouped.groupBy(by, group).agg((F.count("*") if counts is None else F.sum(counts)).alias("n"))


def group_shares(grouped: DataFrame, graph: str, group: str, counts: str | None = None) -> DataFrame:
    """(graph, group, n, share): how a graph's motifs spread over groups; with counts a row stands for so many."""
    n = _group_sizes(grouped, graph, group, counts)
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(graph)))


def share_by(grouped: DataFrame, by: str, group: str, k: int | None = None, counts: str | None = None) -> DataFrame:
    """(by, group, share, n): shares within each value of ``by``; with k only the groups that most values have, ties by name; with counts a row stands for so many."""
    n = _group_sizes(grouped, by, group, counts)
    if k is not None:
        top = n.groupBy(group).agg(F.count("*").alias("spread")).orderBy(F.desc("spread"), group).limit(k)
        n = n.join(F.broadcast(top.select(group)), group, "left_semi")
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(by)))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as (x - mean) / population standard deviation; 0 without spread. The two statistics are one row."""
    stats = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = df.join(F.broadcast(stats)).withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))), F.lit(0.0)) for c in columns})
    return scaled.select(*df.columns)


def kmeans(df: DataFrame, columns: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """df with ``cluster``, of the standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    z = standardised(df.select("*", *(F.col(c).cast("double").alias(f"__z_{c}") for c in columns)), [f"__z_{c}" for c in columns])
    v = materialize(VectorAssembler(inputCols=[f"__z_{c}" for c in columns], outputCol="__v").transform(z), "standardised")
    found = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v).transform(v)
    return found.select(*df.columns, "cluster")
