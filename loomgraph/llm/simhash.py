"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in ``radius`` bits or fewer share a variant within half the radius of both. Every distinct fingerprint
takes part with all its variants within half the radius (1 + 64 + 2016 for a radius of 4); fingerprints that meet in a variant
are a pair, pairs are deduplicated and verified, and links make components.

The shuffle on variants is dealt by a label of the variant: the exclusive or of the labels of its set bits. The label of a
fingerprint and of the flipped bits tell which variants fall under which label, so a row of the shuffle is a (label,
fingerprint) whose variants with this label are made where it arrives, rather than 2081 rows of a variant each. Nothing is left
out: under a label stand exactly those variants that would have been sent there. Labels have few bits while the fingerprints
under one label fit a task, and more beyond; a task makes and sorts at most ``PASS_VARIANTS`` variants at a time.

Defined cases: a null text counts as empty, an empty text has fingerprint zero and links like any other; repeated rows each get
their result; a null doc_id is no candidate for the smallest, a component without any id has a null one; empty tables give
empty results; further columns are left out by the query and untouched by ``fingerprint_texts``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, map_texts, materialize, table
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of one label up to which labels have LABEL_BITS bits.
TASK_FINGERPRINTS = 16_000_000
LABEL_BITS = 6
PASS_VARIANTS = 4_000_000
_COUNT_ROWS = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, "i8")
    for at in range(0, len(h), _COUNT_ROWS):
        counts += np.unpackbits(h[at : at + _COUNT_ROWS].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_texts(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds fp, the fingerprint as a signed long."""

    def make():
        return lambda texts: ([fingerprint(t, shingle) for t in texts],)

    return map_texts(docs, make, [("fp", "bigint")], text, keep_text)


def _label(bit: int, bits: int) -> int:
    """The bit's own number under few label bits; a mixed one (a multiple of a large odd number) under more."""
    return bit % (1 << bits) if bits <= 6 else ((bit + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)


def _flips(half: int) -> list[tuple[int, ...]]:
    return [c for n in range(half + 1) for c in combinations(range(64), n)]


def _label_masks(bits: int) -> list[int]:
    """For each bit of a label the fingerprint bits whose parity it is."""
    return [sum(1 << b for b in range(64) if _label(b, bits) >> k & 1) for k in range(bits)]


def _pairs_under(label: int, bits: int, fps, half: int):
    """Index pairs of fps that meet in a variant with this label, made in passes of about PASS_VARIANTS variants."""
    import numpy as np

    flips = _flips(half)
    more = 0
    while len(fps) * len(flips) >> (bits + more) > PASS_VARIANTS and more < 8:
        more += 1
    # a pass is one value of further label bits, numbered apart from those that dealt the rows out
    own = [_label(b, bits) | ((b * 0xC2B2AE3D27D4EB4F % (1 << 64)) >> (64 - more) << bits if more else 0) for b in range(64)]
    masks = np.array([sum(1 << b for b in range(64) if own[b] >> k & 1) for k in range(bits + more)], "u8")
    marks = np.zeros(len(fps), "i8")
    for k, m in enumerate(masks):
        marks |= (np.bitwise_count(fps & m) & 1).astype("i8") << k
    by_mark = np.argsort(marks, kind="stable")
    values, starts = np.unique(marks[by_mark], return_index=True)
    groups = dict(zip(values.tolist(), np.split(by_mark, starts[1:]), strict=True))
    ways: dict[int, list[int]] = {}
    for c in flips:
        d = 0
        for b in c:
            d ^= own[b]
        ways.setdefault(d, []).append(sum(1 << b for b in c))
    found = []
    for sub in range(1 << more):
        made, owner = [], []
        for d, variants in ways.items():
            members = groups.get((label | sub << bits) ^ d)
            if members is not None:
                made.append((fps[members][:, None] ^ np.array(variants, "u8")).ravel())
                owner.append(np.repeat(members.astype("u4"), len(variants)))
        if not made:
            continue
        z, o = np.concatenate(made), np.concatenate(owner)
        del made, owner
        order = np.argsort(z)
        z = z[order]
        met = np.flatnonzero(z[1:] == z[:-1])
        a, b = o[order[met]].astype("u8"), o[order[met + 1]].astype("u8")
        found.append(np.unique(np.minimum(a, b) << np.uint64(32) | np.maximum(a, b)))
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8")
    pairs = np.unique(np.concatenate(found))
    return (pairs >> np.uint64(32)).astype("i8"), (pairs & np.uint64(0xFFFFFFFF)).astype("i8")


def _least_labels(n: int, a, b):
    """The smallest index in the component of each of n vertices."""
    import numpy as np

    lab = np.arange(n)
    while len(a):
        ra, rb = lab[a], lab[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        # only roots are hooked, the larger onto the smaller, so that what hangs below them comes along
        np.minimum.at(lab, np.maximum(ra, rb), np.minimum(ra, rb))
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return lab


def links(fps: DataFrame, radius: int = RADIUS, label_bits: int | None = None) -> DataFrame:
    """fps(fp), distinct -> edges (u, v) with the same components as all pairs within the radius."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even, so that meeting in a variant means being within it")
    half = radius // 2
    n_ways = len(_flips(half))
    bits = label_bits
    if bits is None:
        n, bits = fps.count(), LABEL_BITS
        while n * min(n_ways, 1 << bits) >> bits > TASK_FINGERPRINTS:
            bits += 1
    reach = set()
    for c in _flips(half):
        d = 0
        for b in c:
            d ^= _label(b, bits)
        reach.add(d)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    own = F.lit(0)
    for k, m in enumerate(_label_masks(bits)):
        own = own.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(signed(m)).cast("bigint"))).bitwiseAND(F.lit(1)), k))
    sent = fps.select("fp", own.cast("int").alias("own"), F.explode(F.array(*map(F.lit, sorted(reach)))).alias("d"))
    sent = sent.select(F.col("own").bitwiseXOR(F.col("d")).alias("label"), "fp")

    def meet(key, frame):
        import numpy as np
        import pyarrow as pa

        fp = np.sort(frame.column("fp").to_numpy())
        u = fp.view("u8")
        a, b = _pairs_under(key[0].as_py(), bits, u, half)
        near = np.bitwise_count(u[a] ^ u[b]) <= radius
        lab = _least_labels(len(fp), a[near], b[near])
        linked = np.flatnonzero(lab != np.arange(len(fp)))
        return pa.table({"u": fp[linked], "v": fp[lab[linked]]})

    return sent.groupBy("label").applyInArrow(meet, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp and component_id, the smallest doc_id that links reach from the document."""
    marked = materialize(fingerprint_texts(docs.select("doc_id", "text"), shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(nodes.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp", "left")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
