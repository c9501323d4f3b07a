"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class in its context times that of the token in its class, in its context too. Classes go by
a word's last two bytes (the end of a text has a class of its own). Within a class the ``SLOTS`` - 1 words that are most frequent in the
training texts have an output of a second softmax each, and the class's other words share its last output; among those a word has
its count less a discount, and what the discounts free goes to the class's unknown token. Both softmaxes are over sums of weight rows that
hashed features pick: the word before, the word before that (a skip), both words (an n-gram), and a bias; the second one's
features are joined with the class. Weights are learnt by gradient updates: in each of ``EPOCH_PARTS`` parts of one pass over all
training texts, every learner steps through its units in sparse numpy batches from the shared weights, and the learners' weights
are averaged by the tokens they stand for; the biases begin at the logarithms of the counts' shares. The number of learners goes by the number of units, not by the cluster.

Texts are tokenised once, into units of at most ``UNIT_DOCS`` texts written to the shared folder: token numbers in the order of the text, and
the unit's distinct words. For counts, each unit sends its distinct words with their counts, dealt by a hash of the word, and
gets the corpus counts back, so that a frequent word is sent once by a unit, whatever texts hold it, and no task holds more than
its share of the vocabulary. Nothing else is shuffled but the units, once, to meet their counts. Counts have 64 bits; the corpus
decides counts, the words that have outputs and all weights, while the number of weight rows is a fixed parameter.

Defined cases: a null text counts as empty, and an empty text is the end token alone; repeated rows are counted and scored each;
without training texts every token is unknown, and the base probability of each is 1; texts of any length are read whole, and one of
over ``UNIT_CHARS`` is a unit of its own; words with equal counts have outputs in their order; an empty table gives an empty
result; further columns are left out.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, in_training, materialize, table

UNIT_DOCS = 1024
UNIT_CHARS = 4_000_000
CLASSES = 32
SLOTS = 32
ROWS_LOG2 = 15
EPOCH_PARTS = 3
RATE = 0.25
BATCH = 4096
#: Learners of a part at least, and units of each beyond that; each learner sends its weights once.
LEARNERS = 12
TASK_UNITS = 32
BLOCKS = 16
DISCOUNT = 0.75
#: Characters of text for each part of the vocabulary.
PART_CHARS = 16_000_000
END = b"\n"
_MIX = (2654435761, 2246822519, 3266489917)


def word_class(word: bytes) -> int:
    import zlib

    return 0 if word == END else 1 + zlib.crc32(word[-2:]) % (CLASSES - 1)


def word_classes(words):
    """word_class of each word, which is that of the word's last two bytes."""
    import numpy as np

    ends = [w[-2:] for w in words]
    known = {e: word_class(e) for e in set(ends)}
    return np.array([known[e] for e in ends], "i4")


def feature_rows(hashes, starts):
    """Rows (tokens, 4) of the class weights that each token's context picks, the bias last; hashes of the unit's tokens in order, starts of its texts.

    Before a text's first word stands the hash 0.
    """
    import numpy as np

    # the bits that are kept are below the 32nd, so numbers of 32 bits may overflow
    hashes = hashes.astype("u4")
    one, two = np.zeros((2, len(hashes)), "u4")
    one[1:] = hashes[:-1]
    two[2:] = hashes[:-2]
    one[starts] = 0
    two[starts] = 0
    second = starts[starts + 1 < len(hashes)] + 1
    two[np.setdiff1d(second, starts)] = 0
    mix = lambda h, n: ((h * np.uint32(_MIX[n])) >> np.uint32(16)) & np.uint32((1 << ROWS_LOG2) - 1)
    both = one * np.uint32(31) + two * np.uint32(0x9E3779B1)
    bias = np.full(len(hashes), 1 << ROWS_LOG2, "u4")
    return np.stack([mix(one + np.uint32(1), 0), mix(two + np.uint32(2), 1), mix(both + np.uint32(3), 2), bias]).view("i4").T


def slot_rows(rows, classes):
    """Rows of the slot weights: the context's rows joined with the class, and a bias of each class."""
    import numpy as np

    classes = classes.astype("u4")
    # numbers of 32 bits may overflow, as above
    joined = ((rows.T[:3].astype("u4") * np.uint32(CLASSES) + classes) * np.uint32(_MIX[0])) >> np.uint32(9)
    return np.concatenate([joined & np.uint32((1 << ROWS_LOG2) - 1), [np.uint32(1 << ROWS_LOG2) + classes]]).astype("i4").T


def empty_weights():
    """Weights of the classes and of the slots."""
    import numpy as np

    return [np.zeros(((1 << ROWS_LOG2) + 1, CLASSES), "f4"), np.zeros(((1 << ROWS_LOG2) + CLASSES, SLOTS), "f4")]


def first_weights(slots: dict[bytes, tuple[int, int]], tokens: list[int]):
    """Weights before any training: the biases are the logarithms of the counts' shares, all else 0."""
    import numpy as np

    weights, t = empty_weights(), np.array(tokens, "f8")
    shares = np.full((CLASSES, SLOTS), 1e-9)
    shares[:, -1] = t
    for w, (slot, n) in slots.items():
        c = word_class(w)
        shares[c, slot] = n
        shares[c, -1] -= n
    logs = lambda x: np.log((x + 0.5 * (x >= 0.5)) / np.maximum(x.sum(axis=-1, keepdims=True), 1)).clip(-20)
    weights[0][-1] = logs(t + 0.5)
    weights[1][1 << ROWS_LOG2 :] = logs(np.concatenate([shares[:, :-1], shares[:, -1:] + 0.5], axis=1))
    return weights


def row_scores(weights, columns):
    """Sums of the weights of the rows that stand in the columns' places, which count as 60 at most either way."""
    import numpy as np

    z = np.take(weights, columns[0], axis=0)
    for own in columns[1:]:
        z += weights[own[0]] if (own == own[0]).all() else np.take(weights, own, axis=0)
    return np.clip(z, -60, 60, out=z)


def log_probs(weights, rows, outputs=None):
    """Natural logarithms of the softmax over the sums of the rows' weights; if outputs are given, only that of each row's output."""
    import numpy as np

    z = row_scores(weights, rows.T)
    own = z if outputs is None else z[np.arange(len(z)), outputs][:, None]
    p = own - np.log(np.exp(z) @ np.ones((z.shape[1], 1), "f4"))
    return p if outputs is None else p[:, 0]


def as_items(a):
    """The rows of an array in one piece as single items, which numpy copies whole."""
    return a.view(f"V{a.shape[1] * a.itemsize}")[:, 0]


def row_sums(g, order, first):
    """Sums of the rows of g in each run of order; first has the runs' starts. g has an even number of columns.

    A run of one row is copied, and the others are added as complex numbers, two columns at a time: numpy adds a run's rows one by one,
    at a cost of its own for each.
    """
    import numpy as np

    out = np.take(g, order[first], axis=0)
    sizes = np.diff(first, append=len(order))
    many = np.flatnonzero(sizes > 1)
    if len(many):
        pairs, n = np.take(g, order[np.repeat(sizes > 1, sizes)], axis=0).view("c8"), sizes[many]
        np.put(as_items(out), many, as_items(np.add.reduceat(pairs, np.cumsum(n) - n, axis=0)))
    return out


def learn(weights, squares, rows, outputs):
    """One pass of gradient updates in batches, in place; squares are the sums of squared gradients that scale the steps."""
    import numpy as np

    width = weights.shape[1]
    weight_items, square_items = as_items(weights), as_items(squares)
    for at in range(0, len(rows), BATCH):
        columns, c = rows[at : at + BATCH].T, outputs[at : at + BATCH]
        g = row_scores(weights, columns)
        np.exp(g, out=g)
        g *= 1 / (g @ np.ones((width, 1), "f4"))
        g.ravel()[np.arange(0, g.size, width) + c] -= 1
        for own in columns:
            if (own == own[0]).all():
                used, sums = own[:1], g.sum(axis=0, keepdims=True)
            else:
                # numbers of 16 bits are sorted by radix
                order = np.argsort(own.astype("u2") if len(weights) <= 1 << 16 else own, kind="stable")
                sorted_ = own[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                used, sums = sorted_[first], row_sums(g, order, first)
            q = np.take(squares, used, axis=0)
            q += sums * sums
            np.put(square_items, used, as_items(q))
            q += 1
            np.sqrt(q, out=q)
            np.divide(sums, q, out=sums)
            sums *= -RATE
            sums += np.take(weights, used, axis=0)
            np.put(weight_items, used, as_items(sums))


def pack_tokens(tokens, kind: str = "<u4") -> bytes:
    """Numbers as planes of bytes, compressed: numbers are given out in order, so frequent words have small ones."""
    import numpy as np
    import zstandard

    numbers = np.array(tokens, kind)
    return zstandard.compress(np.ascontiguousarray(numbers.view("u1").reshape(-1, numbers.itemsize).T).tobytes(), 1)


def unpack_tokens(data: bytes, kind: str = "<u4"):
    import numpy as np
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_words(words) -> bytes:
    import zstandard

    return zstandard.compress(b" ".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    return zstandard.decompress(data).split(b" ")


_UNIT = "unit bigint, doc_ids array<bigint>, sizes binary, train binary, tokens binary, words binary, chars bigint"


def pack_units(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, learns) -> units: sizes (tokens of each text), train flags, tokens (numbers of words), words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def unit(ids, texts, learns):
            nonlocal number
            vocabulary: dict[bytes, int] = defaultdict()
            vocabulary.default_factory = vocabulary.__len__
            number_of = vocabulary.__getitem__
            number_of(END)
            sizes, tokens = [], []
            for t in texts:
                words = t.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if t else []
                tokens += map(number_of, words)
                tokens.append(0)
                sizes.append(len(words) + 1)
            number += 1
            data = {"sizes": np.array(sizes, "<u4").tobytes(), "train": np.array(learns, "u1").tobytes(), "tokens": pack_tokens(tokens), "words": pack_words(vocabulary)}
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([v], pa.binary()) for v in data.values()), pa.array([sum(len(t or "") for t in texts)], pa.int64())],
                names=["unit", "doc_ids", *data, "chars"],
            )

        for batch in batches:
            ids, learns = batch.column("doc_id").to_pylist(), batch.column("learns").to_pylist()
            held: list[int] = []
            texts, chars = [], 0
            for at in range(0, batch.num_rows, 256):
                for i, t in enumerate(batch.column("text").slice(at, 256).to_pylist(), at):
                    held.append(i)
                    texts.append(t)
                    chars += len(t or "")
                    if len(held) >= UNIT_DOCS or chars >= UNIT_CHARS:
                        yield unit([ids[j] for j in held], texts, [learns[j] for j in held])
                        held, texts, chars = [], [], 0
            if held:
                yield unit([ids[j] for j in held], texts, [learns[j] for j in held])

    return docs.mapInArrow(run, _UNIT)


def _unit_rows(batches, names):
    """Each unit of Arrow batches as a dict of numpy arrays, one at a time."""
    import numpy as np

    readers = {"sizes": lambda v: np.frombuffer(v, "<u4"), "train": lambda v: np.frombuffer(v, "u1"), "tokens": unpack_tokens, "words": unpack_words}
    for b in batches:
        for i in range(b.num_rows):
            yield {n: readers.get(n, lambda v: v)(b.column(n)[i].as_py()) for n in names}


def _starts(sizes):
    import numpy as np

    return np.concatenate([[0], np.cumsum(sizes[:-1], dtype="i8")]).astype("i8")


def ask_counts(units: DataFrame, parts: int) -> DataFrame:
    """units -> (part, unit, words, counts): the unit's distinct words of each part, with their counts in training texts."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for u in _unit_rows(batches, ("unit", "sizes", "train", "tokens", "words")):
            words = u["words"]
            counts = np.bincount(u["tokens"][np.repeat(u["train"], u["sizes"]).astype(bool)], minlength=len(words))
            part = np.array([zlib.crc32(w) for w in words], "u4") % parts
            order = np.argsort(part, kind="stable")
            numbers, first = np.unique(part[order], return_index=True)
            split = np.split(order, first[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers, pa.int32()),
                    pa.array([u["unit"]] * len(numbers), pa.int64()),
                    pa.array([pack_words([words[i] for i in s.tolist()]) for s in split], pa.binary()),
                    pa.array([counts[s].astype("<u4").tobytes() for s in split], pa.binary()),
                ],
                names=["part", "unit", "words", "counts"],
            )

    return units.mapInArrow(run, "part int, unit bigint, words binary, counts binary")


def answer_counts(asked: DataFrame) -> DataFrame:
    """(part, unit, counts, tokens, types, top): corpus counts in the order asked; one row of each part with a null unit has tokens and types of each class, and its most frequent words."""

    def run(frame):
        import numpy as np
        import pyarrow as pa

        total: dict[bytes, int] = {}
        numbers, get = [], total.setdefault
        for x in frame.column("words"):
            numbers.append(np.array([get(w, len(total)) for w in unpack_words(x.as_py())], "i8"))
        corpus = np.zeros(len(total), "i8")
        for n, c in zip(numbers, frame.column("counts"), strict=True):
            corpus[n] += np.frombuffer(c.as_py(), "<u4")
        classes = word_classes(total)
        known = corpus > 0
        tokens, types = np.bincount(classes, weights=corpus, minlength=CLASSES), np.bincount(classes[known], minlength=CLASSES)
        n, part = len(numbers), frame.column("part")[0].as_py()
        words = list(total)
        top = []
        for c in range(CLASSES):
            mine = np.flatnonzero((classes == c) & known)
            best = sorted(mine.tolist(), key=lambda i: (-corpus[i], words[i]))[: SLOTS - 1]
            top += [{"class": c, "count": int(corpus[i]), "word": words[i]} for i in best]
        kind = pa.struct([("class", pa.int32()), ("count", pa.int64()), ("word", pa.binary())])
        return pa.table(
            {
                "part": pa.array([part] * (n + 1), pa.int32()),
                "unit": pa.array([*frame.column("unit").to_pylist(), None], pa.int64()),
                "counts": pa.array([*(pack_tokens(corpus[x], "<i8") for x in numbers), None], pa.binary()),
                "tokens": pa.array([*[None] * n, tokens.astype("i8").tolist()], pa.list_(pa.int64())),
                "types": pa.array([*[None] * n, types.tolist()], pa.list_(pa.int64())),
                "top": pa.array([*[None] * n, top], pa.list_(kind)),
            }
        )

    kind_sql = "part int, unit bigint, counts binary, tokens array<bigint>, types array<bigint>, top array<struct<class:int,count:bigint,word:binary>>"
    return asked.groupBy("part").applyInArrow(run, kind_sql)


def frequent_words(answers: DataFrame) -> dict[bytes, tuple[int, int]]:
    """Slot and count of each class's most frequent words, SLOTS - 1 at most."""
    top = answers.where("unit IS NULL").select(F.inline("top")).where("count > 0")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("count"), "word"))
    return {bytes(r["word"]): (r["place"] - 1, r["count"]) for r in top.withColumn("place", place).where(F.col("place") < SLOTS).collect()}


def _context(u, slots: dict[bytes, tuple[int, int]]):
    """Feature rows of a unit's tokens; classes and slots of its words."""
    import zlib

    import numpy as np

    words = u["words"]
    hashes = np.array([zlib.crc32(w) for w in words], "u4")[u["tokens"]]
    slot = np.array([slots.get(w, (SLOTS - 1, 0))[0] for w in words], "i4")
    return feature_rows(hashes, _starts(u["sizes"])), word_classes(words), slot


#: Weight rows of both softmaxes that travel together.
_SUMS = "block int, task int, seen bigint, w binary, q binary"


def _blocks(arrays):
    """Both arrays as one run of numbers, in BLOCKS pieces of about a size."""
    import numpy as np

    return np.array_split(np.concatenate([a.ravel() for a in arrays]), BLOCKS)


def train(units: DataFrame, slots: dict[bytes, tuple[int, int]], tokens: list[int], parts: int = EPOCH_PARTS):
    """Weights of the classes and of the slots after one pass over all training texts, in parts between which learners' weights are averaged."""
    import numpy as np

    spark = units.sparkSession
    weights, squares = first_weights(slots, tokens), empty_weights()
    known = spark.sparkContext.broadcast(slots)
    learners = max(LEARNERS, units.count() // parts // TASK_UNITS)

    def row(key, task, seen, w, q):
        import pyarrow as pa

        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((key, task, seen, w, q), kinds, strict=True)], names=["block", "task", "seen", "w", "q"])

    def add(frame):
        import pyarrow as pa

        w, q, total = 0, 0, sum(frame.column("seen").to_pylist())
        for a, b, n in zip(frame.column("w"), frame.column("q"), frame.column("seen").to_pylist(), strict=True):
            # steps are averaged by tokens, squared gradients (sent as roots, which are small) are added
            w = w + np.frombuffer(a.as_py(), "f2").astype("f8") * (n / total)
            q = q + np.frombuffer(b.as_py(), "f2").astype("f8") ** 2
        return pa.Table.from_batches([row(frame.column("block")[0].as_py(), 0, total, w.astype("f2").tobytes(), np.sqrt(q).astype("f2").tobytes())])

    for part in range(parts):
        shared = spark.sparkContext.broadcast((weights, squares))

        def run(batches, shared=shared):
            from pyspark import TaskContext

            w, q, seen = None, None, 0
            for u in _unit_rows(batches, ("unit", "sizes", "train", "tokens", "words")):
                if w is None:
                    w, q = ([a.copy() for a in x] for x in shared.value)
                rows, classes, slot = _context(u, known.value)
                keep = np.repeat(u["train"], u["sizes"]).astype(bool)
                rows, own = rows.T[:, keep].T, u["tokens"][keep]
                learn(w[0], q[0], rows, classes[own])
                learn(w[1], q[1], slot_rows(rows, classes[own]), slot[own])
                seen += len(own)
            if seen:
                dw, dq = _blocks([a - b for a, b in zip(w, shared.value[0], strict=True)]), _blocks([a - b for a, b in zip(q, shared.value[1], strict=True)])
                for n in range(BLOCKS):
                    yield row(n, TaskContext.get().partitionId(), seen, dw[n].astype("f2").tobytes(), np.sqrt(np.maximum(dq[n], 0)).astype("f2").tobytes())

        own = units.where(F.pmod(F.xxhash64("unit"), F.lit(parts)) == part).coalesce(learners).mapInArrow(run, _SUMS)
        # sums in two levels, so that no task reads what all learners sent
        some = own.withColumn("task", F.col("task") % 16).groupBy("block", "task").applyInArrow(add, _SUMS)
        w, q = _blocks(weights), _blocks(squares)
        for r in some.groupBy("block").applyInArrow(add, _SUMS).collect():
            w[r["block"]] = w[r["block"]] + np.frombuffer(r["w"], "f2")
            q[r["block"]] = q[r["block"]] + np.frombuffer(r["q"], "f2").astype("f4") ** 2
        cut = weights[0].size
        weights, squares = ([x[:cut].reshape(weights[0].shape), x[cut:].reshape(weights[1].shape)] for x in (np.concatenate(w).astype("f4"), np.concatenate(q).astype("f4")))
        shared.unpersist()
    return weights


def score(units: DataFrame, answers: DataFrame, weights, slots: dict[bytes, tuple[int, int]], tokens: list[int], types: list[int], parts: int) -> DataFrame:
    """Per text: doc_id, n_tokens, n_known, base_score and score."""
    import numpy as np

    total, distinct = sum(tokens), sum(types)
    shared = units.sparkSession.sparkContext.broadcast((weights, slots))
    # tokens and types of each class that share the last slot
    t, v = np.array(tokens, "f8"), np.array(types, "f8")
    for w, (_, n) in slots.items():
        t[word_class(w)] -= n
        v[word_class(w)] -= 1
    unknown = np.where(t > 0, np.log10(np.maximum(DISCOUNT * v, 1e-300) / np.maximum(t, 1)), 0.0)

    def run(left, right):
        import zlib

        import pyarrow as pa

        weights, slots = shared.value
        u = next(_unit_rows([left], ("doc_ids", "sizes", "tokens", "words")))
        rows, of, slot = _context(u, slots)
        part = np.array([zlib.crc32(w) for w in u["words"]], "u4") % parts
        counts = np.zeros(len(part), "i8")
        for p, c in zip(right.column("part").to_pylist(), right.column("counts"), strict=True):
            counts[part == p] = unpack_tokens(c.as_py(), "<i8")
        starts, own = _starts(u["sizes"]), u["tokens"]
        base = np.log10((counts + 1) / (total + distinct + 1))
        in_slot = np.where(counts > 0, np.log10(np.maximum(counts - DISCOUNT, 1e-300)) - np.log10(np.maximum(t[of], 1)), unknown[of])
        in_slot[slot < SLOTS - 1] = 0.0
        classes, slot, context = of[own], slot[own], np.empty(len(own))
        for at in range(0, len(own), BATCH):
            r, c, n = rows[at : at + BATCH], classes[at : at + BATCH], slot[at : at + BATCH]
            context[at : at + BATCH] = (log_probs(weights[0], r, c) + log_probs(weights[1], slot_rows(r, c), n)) / np.log(10)
        sums = [np.add.reduceat(x, starts) for x in (counts[own] > 0, base[own], in_slot[own] + context)]
        return pa.table({"doc_id": pa.array(u["doc_ids"], pa.int64()), "n_tokens": pa.array(u["sizes"].astype("i8")), "n_known": pa.array(sums[0].astype("i8")), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    known = answers.where("unit IS NOT NULL").select("unit", "part", "counts")
    whole = units.select("unit", "doc_ids", "sizes", "tokens", "words")
    return whole.groupBy("unit").cogroup(known.groupBy("unit")).applyInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def score_corpus(docs: DataFrame, learns: Column) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; learns tells the training texts."""
    units = materialize(pack_units(docs.select("doc_id", "text", learns.alias("learns"))), "units")
    chars = units.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    parts = max(8, -(-chars // PART_CHARS))
    answers = materialize(answer_counts(ask_counts(units, parts)), "counts")
    sums = answers.where("unit IS NULL").select(F.posexplode(F.arrays_zip("tokens", "types")).alias("class", "x")).groupBy("class").agg(F.sum("x.tokens"), F.sum("x.types")).collect()
    tokens, types = [0] * CLASSES, [0] * CLASSES
    for c, n, v in sums:
        tokens[c], types[c] = n, v
    slots = frequent_words(answers)
    weights = train(units, slots, tokens)
    scored = score(units, answers, weights, slots, tokens, types, parts)
    return scored.withColumn("train_tokens", F.lit(sum(tokens)).cast("bigint"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of documents, learnt from those whose crc32 modulo 7 is not 2."""
    scored = score_corpus(table(spark, sf_dir, "documents"), in_training(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", (~in_training(F.col("doc_id"), 7, 2)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
