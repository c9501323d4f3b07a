"""SimHash near-duplicates at a similarity of 0.8 or more of five-word shingles, by ball hashing of wide fingerprints.

At a Jaccard similarity of 0.8 a bit of two texts' SimHash differs with probability arccos(8/9) / pi = 0.15, which is ten of 64 bits
and beyond any ball that can be listed, and too few bits to tell 0.8 from 0.7. So a text's fingerprint has ``BITS`` = 2048 bits
here. Two texts are candidates when theirs differ in at most two deviations more bits than 0.8 makes expected (310, deviation 16; a
similarity of 0.85 has 264, one of 0.75 has 353) and the numbers of their shingles allow it. Candidates three deviations below
what is expected are links; of the others, the exact Jaccard similarity of the texts' shingles decides. Sets of ``SHORT`` shingles
or fewer always go by the texts, and as they differ in more bits at the same similarity, their bound is larger by a share of
``SHORT_SHARE``. Links make components.

The first ``TABLES`` words of 32 bits are keys, and meet-in-the-middle ball hashing runs in each table: a key emits its 33 variants
within one bit, and texts that meet in a variant have keys within two bits of each other. A table brings a pair of similarity 0.8
together with probability 0.12, all tables with 0.998 (0.85: 0.99998), and a pair of strangers with 6e-6. Colliding pairs are
verified on the fingerprints. Rows with equal sets of shingles are one node before all this, so copies cost a row each.

Nodes meet twice. First with 128 bits beside their keys, to find those that come within ``CHECK_MOST`` of anyone or stand in a large
bucket; then these alone, with whole fingerprints. Each task joins its candidates at once, closest first, so a bucket whose members
are connected costs nothing more, and returns the edges of its forest, fewer than it has nodes. Edges in doubt are verified on the
texts where the other links leave their ends apart. So a group of near copies costs its size and not its square; within a large
bucket members outside the component that most have are held against all, in numpy and without emitting. What this can lose is
a link in doubt that stood behind another candidate which the texts refuse, in every table that brings its ends together.

The variants of a table are dealt by their first bits once a table has more than ``TASK_ROWS`` nodes, so a node goes to as many
tasks as it has variants under different first bits, 1 + bits; within a task passes go by further bits.

Defined cases: a null text counts as empty; an empty text is a copy of other empty ones only, and a text of under five words of
texts with the same words; nodes and shingles are known by 64 bits of their hash; of repeated rows one stays; null ids come last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, map_texts, materialize
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BITS = 2048
TABLES = 48
#: Differing bits of 128 up to which a first meeting counts; at a similarity of 0.8 there are 19.4, deviation 4.1.
CHECK_MOST = 32
SHORT, SHORT_SHARE = 5, 0.04
#: Nodes of a task at most, and variants that a pass makes and sorts at once.
TASK_ROWS = 8_000_000
PASS_VARIANTS = 4_000_000
#: Neighbours in a bucket that are compared at once; larger buckets are compared by member.
LAGS = 8
#: Parts that the pairs of one node are split into for verification.
SALTS = 64
_SEED = 17
_ODD = 0x9E3779B97F4A7C15


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int = SHINGLE):
    """The sorted, distinct 64-bit hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []
    if not words:
        return np.empty(0, "u8")
    known = {w: xxh64_intdigest(w, _SEED) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    n = min(shingle, len(words))
    total = np.full(len(words) - n + 1, n, "u8")
    for k in range(n):
        total = total * np.uint64(_ODD) + h[k : len(h) - n + 1 + k]
    return np.unique(_mixed(total))


def wide_fingerprint(hashes):
    """BITS bits as numbers of 32 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    import numpy as np

    counts = np.zeros(BITS, "i8")
    steps = (np.arange(1, BITS // 64 + 1, dtype="u8") * np.uint64(_ODD))[None, :]
    for at in range(0, len(hashes), 255):
        part = _mixed(hashes[at : at + 255, None] + steps)
        counts += np.add.reduce(np.unpackbits(part.view("u1"), axis=1), axis=0, dtype="u1")
    return np.packbits(2 * counts > len(hashes)).view(">u4").astype("u4")


def link_bits(similarity: float = SIMILARITY, deviations: float = 0.0) -> float:
    """Differing bits to be expected at the similarity, of sets of equal sizes, and so many deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return BITS * share + deviations * math.sqrt(BITS * share * (1 - share))


def jaccard(a, b) -> float:
    """Of two sets of shingles by their hashes; two empty ones are equal."""
    import numpy as np

    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def mark(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Adds node, n_shingles and fp, the fingerprint as an array of numbers; the text stays."""

    def make():
        from xxhash import xxh64_intdigest

        def run(texts):
            sets = [shingle_hashes(t, shingle) for t in texts]
            nodes = [xxh64_intdigest(s.tobytes(), _SEED) for s in sets]
            return [n - (1 << 64) if n >> 63 else n for n in nodes], [len(s) for s in sets], [wide_fingerprint(s).view("i4").tolist() for s in sets]

        return run

    return map_texts(docs, make, [("node", "bigint"), ("n_shingles", "int"), ("fp", "array<int>")], keep_text=True)


def _passes(key, bits: int, prefix: int):
    """The buckets of variants whose first ``bits`` are ``prefix``: in each pass their sorted variants and the index of each one's owner."""
    import numpy as np

    flips = np.concatenate([[0], np.uint32(1) << np.arange(32, dtype="u4")]).astype("u4")
    more = 0
    while len(key) * (1 + bits + more) * len(flips) >> (bits + more) > PASS_VARIANTS and more < 12:
        more += 1
    shift = np.uint32(32 - bits - more)
    for sub in range(1 << more):
        rows = np.arange(len(key))
        if bits + more:
            first = np.uint32(prefix << more | sub)
            rows = np.flatnonzero(np.bitwise_count((key >> shift) ^ first) <= 1)
        z = key[rows][:, None] ^ flips
        inside = (z >> shift) == first if bits + more else np.ones(z.shape, bool)
        z = (z.astype("u8") << np.uint64(32) | rows[:, None].astype("u8"))[inside]
        z.sort()
        yield z >> np.uint64(32), (z & np.uint64(0xFFFFFFFF)).astype("i8")


def _neighbours(z, owner):
    """Distinct pairs of owners that are near each other in a bucket."""
    import numpy as np

    found = [np.empty(0, "i8")]
    for lag in range(1, LAGS + 1):
        at = np.flatnonzero(z[lag:] == z[:-lag])
        if not len(at):
            break
        i, j = owner[at], owner[at + lag]
        found.append(np.minimum(i, j) << 32 | np.maximum(i, j))
    pairs = np.unique(np.concatenate(found))
    return pairs >> 32, pairs & 0xFFFFFFFF


def _large(z):
    """Starts and ends of the buckets that _neighbours does not see whole."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate([[True], z[1:] != z[:-1]])) if len(z) else np.empty(0, "i8")
    ends = np.append(starts[1:], len(z))
    large = ends - starts > LAGS + 1
    return list(zip(starts[large].tolist(), ends[large].tolist(), strict=True))


def _distances(i, j, words, size, most, similarity: float):
    """Differing bits of the pairs' fingerprints (rows of words); -1 beyond ``most``, by size, or where the sizes rule the similarity out."""
    import numpy as np

    less, more = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    out = np.empty(len(i), "i8")
    for at in range(0, len(i), 50_000):
        part = slice(at, at + 50_000)
        out[part] = np.bitwise_count(words[i[part]] ^ words[j[part]]).sum(axis=1, dtype="i8")
    return np.where((out <= most(less)) & (less >= similarity * more - 1e-6), out, -1)


def meeting_nodes(key, words, size, bits: int, prefix: int, similarity: float):
    """Whether each node comes near another in a variant, or stands in a large bucket."""
    import numpy as np

    met = np.zeros(len(key), bool)
    for z, owner in _passes(key, bits, prefix):
        i, j = _neighbours(z, owner)
        near = _distances(i, j, words, size, lambda n: CHECK_MOST + 128 * SHORT_SHARE * (n <= SHORT), similarity) >= 0
        met[i[near]] = met[j[near]] = True
        for a, b in _large(z):
            met[owner[a:b]] = True
    return met


def _find(lab, x):
    r = lab[x]
    while True:
        s = lab[r]
        if (s == r).all():
            return r
        r = s


def _join(lab, a, b, d) -> list:
    """Joins the trees of a and b, closest first in steps of 32 bits; returns the pairs that joined two, as arrays of a, b and d.

    A root is hooked once in a round, onto a smaller one, by its closest pair.
    """
    import numpy as np

    by = np.argsort(d, kind="stable")
    a, b, d = a[by], b[by], d[by]
    cuts, used = np.searchsorted(d, np.arange(0, d[-1] + 33 if len(d) else 1, 32)), []
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        x, y, z = a[start:end], b[start:end], d[start:end]
        while len(x):
            rx, ry = _find(lab, x), _find(lab, y)
            apart = rx != ry
            x, y, z, rx, ry = x[apart], y[apart], z[apart], rx[apart], ry[apart]
            high, first = np.unique(np.maximum(rx, ry), return_index=True)
            lab[high] = np.minimum(rx, ry)[first]
            used.append(np.stack([x[first], y[first], z[first]]))
    return used


def forest(key, words, size, bits: int, prefix: int, similarity: float):
    """Rows (i, j, distance) of a forest of candidates that meet in a variant, with the components of all of them."""
    import numpy as np

    lab, edges = np.arange(len(key)), [np.empty((3, 0), "i8")]
    bound = link_bits(similarity, 2)

    def add(i, j):
        d = _distances(i, j, words, size, lambda n: bound + BITS * SHORT_SHARE * (n <= SHORT), similarity)
        edges.extend(_join(lab, i[d >= 0], j[d >= 0], d[d >= 0]))

    for z, owner in _passes(key, bits, prefix):
        add(*_neighbours(z, owner))
        for a, b in _large(z):
            members = owner[a:b]
            roots = _find(lab, members)
            values, counts = np.unique(roots, return_counts=True)
            if len(values) == 1:
                continue
            some, step = members[roots != values[counts.argmax()]], max(1, 500_000 // len(members))
            for at in range(0, len(some), step):
                part = some[at : at + step]
                i, j = np.repeat(part, len(members)), np.tile(members, len(part))
                apart = np.repeat(_find(lab, part), len(members)) != np.tile(_find(lab, members), len(part))
                add(i[apart], j[apart])
    return np.concatenate(edges, axis=1)


def meeting(nodes: DataFrame, whole: bool, similarity: float = SIMILARITY, bits: int | None = None) -> DataFrame:
    """nodes(node, n_shingles, fp) -> (u, v, sure).

    With ``whole`` the edges of each task's forest, and whether they are beyond doubt; else each node that meets another, as u.
    """
    if bits is None:
        n, bits = nodes.count(), 0
        while n * (1 + bits) >> bits > TASK_ROWS:
            bits += 1
    sent = nodes.select("node", "n_shingles", ("fp" if whole else F.slice("fp", BITS // 32 - 3, 4).alias("fp")), F.posexplode(F.slice("fp", 1, TABLES)).alias("table", "key"))
    own = F.shiftrightunsigned("key", 32 - bits) if bits else F.lit(0)
    sent = sent.withColumn("prefix", F.explode(F.array(own, *(own.bitwiseXOR(F.lit(1 << b)) for b in range(bits)))))

    def meet(key, frame):
        import numpy as np
        import pyarrow as pa

        node = frame.column("node").to_numpy()
        order = np.argsort(node)
        node, size, keys = node[order], frame.column("n_shingles").to_numpy()[order], frame.column("key").to_numpy()[order].view("u4")
        words = frame.column("fp").combine_chunks().flatten().to_numpy().reshape(len(node), -1)[order].view("u8")
        if whole:
            i, j, d = forest(keys, words, size, bits, key[1].as_py(), similarity)
            sure = (d <= link_bits(similarity, -3)) & (np.minimum(size[i], size[j]) > SHORT)
            return pa.table({"u": np.minimum(node[i], node[j]), "v": np.maximum(node[i], node[j]), "sure": sure})
        met = node[meeting_nodes(keys, words, size, bits, key[1].as_py(), similarity)]
        return pa.table({"u": met, "v": met, "sure": np.ones(len(met), bool)})

    return sent.groupBy("table", "prefix").applyInArrow(meet, "u bigint, v bigint, sure boolean")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """pairs(u, v), distinct, and texts(node, text) -> the pairs (u, v) whose texts have the similarity.

    A node with many pairs is split over SALTS parts, so that its text meets them in many tasks.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = dealt.select("u", "salt").distinct().join(texts.select(F.col("node").alias("u"), F.col("text").alias("left")), "u")
    sides = dealt.join(texts.select(F.col("node").alias("v"), F.col("text").alias("right")), "v").join(left, ["u", "salt"]).select("u", "v", "left", "right")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sides = zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True)
                keep = [jaccard(shingle_hashes(x, shingle), shingle_hashes(y, shingle)) >= similarity for x, y in sides]
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return sides.mapInArrow(run, "u bigint, v bigint")


def node_roots(marked: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """marked(node, n_shingles, fp, text) -> (u, v): each node that is linked to a smaller one, with its component's smallest."""
    nodes = materialize(marked.groupBy("node").agg(F.any_value("n_shingles").alias("n_shingles"), F.any_value("fp").alias("fp")), "nodes")
    met = meeting(nodes, False, similarity).select(F.col("u").alias("node")).distinct()
    edges = materialize(meeting(materialize(nodes.join(met, "node"), "met"), True, similarity).distinct(), "candidates")
    links = edges.where("sure").select("u", "v")
    roots = components(links)
    root = lambda end: roots.select(F.col("u").alias(end), F.col("v").alias(f"{end}_root"))
    doubt = edges.where("NOT sure").select("u", "v").join(root("u"), "u", "left").join(root("v"), "v", "left")
    doubt = materialize(doubt.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"), "doubt")
    # one row's text stands for a node; only nodes of some pair are looked up
    asked = doubt.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = marked.select("node", "text").join(asked, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    return components(roots.union(verified(doubt, texts, shingle, similarity)))


def _first(row: Column) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), row.alias("row"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with a doc_id and a text -> of the rows of each component the one first by doc_id (null last), text and row."""
    columns = docs.columns
    rows = materialize(mark(docs, shingle).withColumn("__row", F.monotonically_increasing_id()), "near-copies")
    roots = node_roots(rows, shingle, similarity).select(F.col("u").alias("node"), F.col("v").alias("root"))
    # nodes are aggregated before their components, so that copies of one text are met where they lie
    firsts = rows.groupBy("node").agg(F.min(_first(F.col("__row"))).alias("first")).join(roots, "node", "left")
    kept = firsts.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(columns)
