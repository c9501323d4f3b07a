"""Toxicity by a support vector machine on a gap-weighted subsequence kernel, approximated through Nyström landmarks.

The kernel compares words by the subsequences of three and four characters that they share, within a span of ``SPAN`` characters, each gap
costing a factor ``DECAY``; a word's start counts as a character. So an insult with characters put in, or with another ending,
stays near its plain form. Characters that are neither letters nor digits are taken out of words before, and a run of single
letters is read as one word. Words
are scaled to a norm of nearly 1, short ones less.

Training is by multiple instances, as labels hold for texts and not for words: witnesses of a toxic sentence are words that toxic
texts have and clean texts lack; an SVM on the Nyström map of the landmarks (some witnesses, some clean words) separates them;
then the best words of each toxic text become its witnesses, the best of clean texts further negatives, and so on. The machine's
weights on landmarks are folded into one table of weights per subsequence, which scores running text in one pass. A text's score
is a logistic function of its best words' decision values, fitted on texts that the machine was not trained on.

Training takes labelled rows only, at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean ones, those with the smallest hash of
their id; every text is scored whole, in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the lowest score; rows with a null label are not learnt from; repeated
rows each get their score; with no labelled toxic or no clean text all scores are 0; an empty table gives an empty result; words
of any length are scored whole; further columns pass through unless they bear the name of an output column.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_training, map_texts, table

MAX_TOXIC = 1000
MAX_CLEAN = 3000
SPAN = 5
DECAY = 0.6
LANDMARKS = 700
ROUNDS = 3
THRESHOLD = 0.7
#: Decision values below count as this.
FLOOR = -1.5
#: Witnesses of which forms with a character put in are learnt too.
VARIED = 200
#: Sum of the weights of errors on either side.
COST = 4000.0
#: Added to a word's squared norm, so that short words, of few subsequences, resemble nothing much.
SHORT = 1.5
SYMBOLS = 64
START = 63
#: Rows of a matrix that are worked on at once.
CHUNK = 1000
#: Offsets of a subsequence's further characters: three characters, or four, within SPAN.
_PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)] + [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
#: Weights of three characters have a place each, those of four share FOURS places by a hash.
THREES, FOURS = SYMBOLS**3, 1 << 20
_SPELLED = re.compile(r"(?<!\w)(?:\w[\W_]{1,2}){3,}\w(?!\w)")


def _symbol_table():
    """Letters a-z and digits have a symbol each; other letters share the rest by their code; 255 leaves a character out; START stands for white space."""
    import numpy as np

    t = np.full(0x10000, 255, "u1")
    for c in range(0x10000):
        ch = chr(c)
        if ch.isspace():
            t[c] = START
        elif "a" <= ch <= "z":
            t[c] = c - 97
        elif "0" <= ch <= "9":
            t[c] = 26 + c - 48
        elif ch.isalnum():
            t[c] = 36 + c % (START - 36)
    return t


_TABLE: list = []


def symbols(text: str, spelled: bool = True):
    """Symbols of the lower-cased text: each word behind a START; with ``spelled``, runs of single letters as one word."""
    import numpy as np

    if not _TABLE:
        _TABLE.append(_symbol_table())
    text = _SPELLED.sub(lambda m: re.sub(r"[\W_]", "", m[0]), text.lower()) if spelled else text.lower()
    points = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), "<u4")
    s = _TABLE[0][np.where(points < 0x10000, points, 0)]
    return s[s != 255]


def _gap(p: tuple) -> float:
    return DECAY ** (p[-1] - len(p))


def _codes(wide, p: tuple):
    """Place of the subsequence that begins at each symbol."""
    n = len(wide) - p[-1]
    code = (wide[:n] * SYMBOLS + wide[p[0] : n + p[0]]) * SYMBOLS + wide[p[1] : n + p[1]]
    return code if len(p) == 2 else THREES + (((code * SYMBOLS + wide[p[2] : n + p[2]]) * 40503 >> 4) & (FOURS - 1))


def norms(longest: int):
    """Norm before scaling, by the number of symbols of a word, its start included, for words without repeats; with repeats it is larger."""
    import numpy as np

    n = np.arange(longest + 1)
    total = sum(np.maximum(n - p[-1], 0) * _gap(p) ** 2 for p in _PATTERNS)
    return np.sqrt(np.maximum(total, 1e-9) + SHORT)


def word_values(s, weights, bias: float, refine: float = -0.25):
    """Decision value of each word of the symbols s; one that is below ``refine`` for a word without repeats is left at that."""
    import numpy as np

    starts = np.flatnonzero(s == START)
    if not len(starts):
        return np.zeros(0)
    word = np.cumsum(s == START) - 1
    total = np.zeros(len(s), "f4")
    wide = s.astype("i8")
    for p in _PATTERNS:
        if len(s) > p[-1]:
            same = word[p[-1] :] == word[: -p[-1]]
            total[: -p[-1]] += np.where(same, weights[_codes(wide, p)], 0) * np.float32(_gap(p))
    size = np.bincount(word)
    values = np.bincount(word, weights=total) / norms(int(size.max()))[size] + bias
    # repeats make the true norm larger, and so a positive sum's value smaller
    for i in np.flatnonzero(values > refine):
        c, v = _features_of(s[starts[i] : starts[i] + size[i]].tobytes())
        values[i] = float(weights[c] @ v) + bias
    return values


def features(word: str):
    """Codes and values, of norm 1, of a word's kernel features."""
    return _features_of(symbols(word).tobytes())


@lru_cache(20_000)
def _features_of(raw: bytes):
    import numpy as np

    s = np.frombuffer(raw, "u1").astype("i8")
    codes, values = [], []
    for p in _PATTERNS:
        if len(s) > p[-1]:
            codes.append(_codes(s, p))
            values.append(np.full(len(s) - p[-1], _gap(p)))
    if not codes:
        return np.zeros(0, "i4"), np.zeros(0)
    c, at = np.unique(np.concatenate(codes), return_inverse=True)
    v = np.bincount(at, weights=np.concatenate(values))
    return c, v / np.sqrt(v @ v + SHORT)


def kernel(xs: list, landmarks: list):
    """Kernel values (words, landmarks) of words' features."""
    import numpy as np

    used = np.unique(np.concatenate([c for c, _ in landmarks])) if landmarks else np.zeros(0, "i8")
    dense = np.zeros((len(used) + 1, len(landmarks)))
    for j, (c, v) in enumerate(landmarks):
        dense[np.searchsorted(used, c), j] = v
    place = np.full(THREES + FOURS, len(used), "i4")
    place[used] = np.arange(len(used))
    out = np.empty((len(xs), len(landmarks)))
    for i, (c, v) in enumerate(xs):
        out[i] = v @ dense[place[c]]
    return out


def _svm(x, y, cost, rounds: int = 25):
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin; the last column of x is ones, its weight the bias."""
    import numpy as np

    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    loss = lambda w: w @ ridge @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        curve, pull = ridge.copy(), x.T @ (cost * y * inside)
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            curve += part.T @ (part * (cost * inside)[at : at + CHUNK, None])
        step = np.linalg.solve(curve, pull) - w
        size, then = 1.0, loss(w + step)
        while then > now and size > 1e-4:
            size /= 2
            then = loss(w + size * step)
        if now - then < 1e-6 * now:
            break
        w, now = w + size * step, then
    return w


class Model(NamedTuple):
    """weights by subsequence, bias of the machine, and the logistic function's weights (the last is its level)."""

    weights: object
    bias: float
    logistic: tuple[float, ...]


def varied(word: str) -> list[str]:
    """Two forms with a character put in, which and where by the word itself."""
    h = sum(map(ord, word))
    return [word[:at] + "xzqj7"[(h + at) % 5] + word[at:] for at in {1 + h % (len(word) - 1), 1 + (h // 7) % (len(word) - 1)}] if len(word) > 3 else []


def _fit_machine(positive: list[str], negative: list[str], cost_positive, cost_negative):
    import numpy as np

    more = [(v, c / 2) for w, c in zip(positive[:VARIED], cost_positive[:VARIED], strict=True) for v in varied(w)]
    positive, cost_positive = positive + [v for v, _ in more], [*cost_positive, *(c for _, c in more)]

    # of either side those at the front, which are the most frequent or the hardest, and some of the rest
    marks = []
    for words in (positive, negative):
        front = LANDMARKS * 3 // 8
        rest = words[front:]
        marks += words[:front] + rest[:: max(1, len(rest) // (LANDMARKS // 8))][: LANDMARKS // 8]
    marks = list(dict.fromkeys(marks))
    fm = [features(w) for w in marks]
    values, vectors = np.linalg.eigh(kernel(fm, fm))
    kept = values > 1e-4 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    words = positive + negative
    x = np.ones((len(words), root.shape[1] + 1))
    for at in range(0, len(words), CHUNK):
        x[at : at + CHUNK, :-1] = kernel([features(w) for w in words[at : at + CHUNK]], fm) @ root
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    # both sides weigh the same
    cost = np.concatenate([np.asarray(c, "f8") * COST / sum(c) for c in (cost_positive, cost_negative)])
    w = _svm(x, y, cost)
    alpha = root @ w[:-1]
    table_ = np.zeros(THREES + FOURS, "f4")
    for a, (c, v) in zip(alpha, fm, strict=True):
        np.add.at(table_, c, a * v)
    return table_, float(w[-1])


def _words(text: str) -> list[str]:
    import numpy as np

    text = _SPELLED.sub(lambda m: re.sub(r"[\W_]", "", m[0]), text.lower())
    return ["".join(filter(str.isalnum, w)) for w in text.split()]


def summary(text: str | None, weights, bias: float) -> tuple[float, float, float, float]:
    """The three best decision values, and the logarithm of 1 + the number of words above 0."""
    import numpy as np

    v = np.clip(word_values(symbols(text), weights, bias), FLOOR, 1.0) if text else np.zeros(0)
    top = np.sort(np.concatenate([v, [FLOOR] * 3]))[-3:]
    return float(top[2]), float(top[1]), float(top[0]), float(np.log1p((v > 0).sum()))


def _logistic(x, y, rounds: int = 60):
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w)) * 0.05
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def train(texts: list[str], toxic: list[int]) -> Model | None:
    """None without texts of both kinds."""
    import numpy as np

    fit = [(t, y) for i, (t, y) in enumerate(zip(texts, toxic, strict=True)) if i % 3]
    held = [(t, y) for i, (t, y) in enumerate(zip(texts, toxic, strict=True)) if i % 3 == 0]
    if len({y for _, y in fit}) < 2:
        fit = held = list(zip(texts, toxic, strict=True))
    if len({y for _, y in fit}) < 2:
        return None
    # one string for each distinct word, whatever number of texts have it
    one: dict[str, str] = {}
    bags = [(sorted({one.setdefault(w, w) for w in _words(t)} - {""}), y) for t, y in fit]
    del one
    n_toxic, n_clean = sum(y for _, y in bags), sum(1 - y for _, y in bags)
    in_toxic, in_clean = Counter(w for b, y in bags if y for w in b), Counter(w for b, y in bags if not y for w in b)
    # how surprising it is that clean texts lack a word which so many toxic texts have
    share = (n_toxic + 1) / (n_toxic + n_clean + 2)
    bar = np.log(len(in_toxic) + 1)
    witnesses = {w: n for w, n in in_toxic.items() if not in_clean[w] and len(w) > 2 and -n * np.log(share) > bar + 2}
    if not witnesses:
        witnesses = dict(Counter({w: n for w, n in in_toxic.items() if not in_clean[w] and len(w) > 2}).most_common(10))
    common = [w for w, _ in in_clean.most_common(1500)]
    spread = sorted(in_clean)[:: max(1, len(in_clean) // 2500)]
    negative = list(dict.fromkeys(w for w in common + spread if w))
    hard: Counter = Counter()
    every = sorted(set(in_toxic) | set(in_clean))
    model = None
    for n in range(ROUNDS):
        ranked = sorted(witnesses, key=lambda w: (-witnesses[w], w))[:1500]
        weights, bias = _fit_machine(ranked, negative, [1 + witnesses[w] ** 0.5 for w in ranked], [1 + in_clean[w] ** 0.5 for w in negative])
        model = weights, bias
        if n + 1 == ROUNDS:
            break
        value = {}
        for at in range(0, len(every), 50_000):
            part = every[at : at + 50_000]
            value.update(zip(part, word_values(symbols(" ".join(part), False), weights, bias, np.inf).tolist(), strict=True))
        exact = lambda w: float(weights[(f := features(w))[0]] @ f[1]) + bias  # noqa: B023, E731
        found: Counter = Counter()
        for bag, y in bags:
            top = sorted(((exact(w), w) for w in heapq.nlargest(6, bag, key=value.__getitem__)), reverse=True)
            if y:
                found.update([w for v, w in top[:4] if v > 0 and not in_clean[w]] or [w for _, w in top[:1] if not in_clean[w]])
            else:
                hard.update(w for v, w in top[:3] if v > -0.7)
        witnesses = {w: c for w, c in found.items() if len(w) > 2} or witnesses
        # hard words of all rounds and common words by turns, so that the front holds both
        turns = [w for pair in zip([w for w, _ in hard.most_common(1500)], common, strict=False) for w in pair]
        negative = list(dict.fromkeys([*turns, *(w for w, _ in hard.most_common(1500)), *negative]))[:6000]
    weights, bias = model
    x = np.array([summary(t, weights, bias) for t, _ in held])
    y = np.array([y for _, y in held], "f8")
    if len(set(y)) < 2:
        return Model(weights, bias, (3.0, 3.0, 0.0, 0.0, 0.0))
    return Model(weights, bias, tuple(map(float, _logistic(x, y))))


def score_text(text: str | None, model: Model) -> float:
    import math

    x = (*summary(text, model.weights, model.bias), 1.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.logistic, strict=True))))))


def sample(docs: DataFrame, labels: DataFrame, keep: Column) -> tuple[list[str], list[int]]:
    """At most MAX_TOXIC toxic and MAX_CLEAN clean texts: the ids are chosen from the labels, by their hash, and then looked up."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    kinds = ((1, MAX_TOXIC), (0, MAX_CLEAN))
    first = [known.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(most) for y, most in kinds]
    # no more ids than the two limits, and one text for each, so that repeated ids crowd nothing out
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(first[0].union(first[1])), "doc_id")
    found = found.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    rows = {1: [], 0: []}
    for r in found.orderBy(F.desc("toxic"), "h", "doc_id", "text").limit(MAX_TOXIC + MAX_CLEAN).collect():
        rows[r["toxic"]].append(r["text"])
    texts = [t for y, most in kinds for t in rows[y][:most]]
    return texts, [y for y, most in kinds for _ in rows[y][:most]]


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds score to docs."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0)) if keep_text else docs.withColumn("score", F.lit(0.0)).drop(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: ([score_text(t, m) for t in texts],)

    return map_texts(docs, make, [("score", "double")], text, keep_text)


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> Model | None:
    """Learns from the labelled rows of docs whose doc_id keep holds for."""
    model = train(*sample(docs, labels, keep))
    _features_of.cache_clear()
    gc.collect()
    return model


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of documents, learnt from labelled rows whose crc32 modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learns = in_training(F.col("doc_id"), 3, 1)
    model = fit(docs, table(spark, sf_dir, "labels"), learns)
    scored = score_texts(docs, model)
    return scored.select("doc_id", (~in_training(F.col("doc_id"), 3, 1)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
