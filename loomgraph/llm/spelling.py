"""Spelling variants: words near each other by one edit are found in trie shards, and each word takes its frequent neighbour's form.

1. Words are counted in each task before the shuffle; the counts that stay are written to the shared folder.
2. Words in code-point order are cut into shards of at most ``SHARD_WORDS`` words and ``SHARD_CHARS`` characters. A task makes a
   compact trie of each: nodes in level order, so that a node's children are a range and take one number; where one word is left,
   its tail stays in the word and has no nodes.
3. Shards are broadcast in waves of at most ``WAVE_BYTES`` (or one shard), however many words there are. In each wave every word
   meets every shard of it: the Levenshtein automaton of distance one runs down the trie for blocks of words, whose states
   (word, position, node, edited or not) are arrays; the deepest states are expanded first, and parts of at most ``PART`` states.
   An insertion never repeats the symbol it stands before and a deletion takes the last of equal symbols, so that each neighbour is
   accepted once, at the first place where the two words differ.
4. A task reduces the neighbours of a word in a shard to their number and the best form; a sum and a minimum by word end it.
5. Forms are followed to the last by doubling; every step multiplies the count by ``RATIO`` or more, so chains are short.

The work of 3 grows with words times shards, but in a shard of another stretch of the order a word has no more than its first
symbol's edits to try. The driver holds one wave and the list of shards. Lost executors get broadcasts anew and waves are written
one by one.

Defined cases: a null text has no words, and neither have texts of short words only; a null doc_id counts as the empty text in the
hash of slips; a row that is repeated counts as often as it stands; of neighbours with equal counts the first in code-point order
is the form; a text or a word of any length is taken whole, a very long word in a shard with few others; a word without neighbours
has 0, no form and itself as root; empty tables give empty results; further columns are not looked at.
"""

from __future__ import annotations

import io
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, materialize, table

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
#: Every so-manieth occurrence, by a hash of document and word, has lost a letter.
SLIP = 31
#: A neighbour is a word's form if it is at least so many times as frequent.
RATIO = 10
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000
SHARD_WORDS, SHARD_CHARS = 1 << 17, 4_000_000
WAVE_BYTES = 64_000_000
#: Words whose states run together, states expanded together, and words of one task.
BLOCK, PART, TASK_WORDS = 4096, 1 << 18, 16_384


# Counting


def slipped(word: str, doc_id: int | None, every: int = SLIP) -> str:
    """The word, or, where ``every`` divides the hash of document and word, the word less one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, letters: str = LETTERS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int | None = SLIP) -> DataFrame:
    """word and n of the words of docs, with A-Z lower-cased, that have the length and the count; slip None takes words as they are."""
    most = COUNTED

    def run(batches):
        import pyarrow as pa
        from collections import Counter

        find = re.compile(f"[{letters}]{{{min_length},}}").findall
        counts: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                runs = Counter(find(text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).decode("utf-8", "surrogatepass")))
                for word, n in runs.items():
                    if slip and len(word := slipped(word, doc_id, slip)) < min_length:
                        continue
                    counts[word] += n
                if len(counts) >= most:
                    yield flush()
        if counts:
            yield flush()

    counted = docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# Tries


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points plus one of all words, a zero behind each, and where each word starts (one entry more than words)."""
    lengths = np.fromiter(map(len, words), "i8", len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    flat = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
    flat[starts[1:] - 1] = 0
    return flat, starts


def _smallest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class Trie:
    """A compact trie over words in code-point order.

    symbol: of the edge to each node; first: a node's children are first[v] to first[v + 1]; row: the word that ends in a node,
    or the only one below it, or -1; flat and starts: the words, as by ``coded``; n: their counts.
    """

    FIELDS = ("symbol", "first", "row", "flat", "starts", "n")

    def __init__(self, **arrays: np.ndarray) -> None:
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: list[str], n: list[int]) -> Trie:
        flat, starts = coded(words)
        rows, node = np.arange(len(words), dtype="i8"), np.zeros(len(words), "i8")
        symbols, row, children = [np.zeros(1, "u4")], [np.full(1, -1, "i8")], []
        made, depth, level = 1, 0, (0, 1)
        while len(rows):
            symbol = flat[starts[rows] + depth]
            ends = symbol == 0
            here = row[-1]
            here[node[ends] - level[0]] = rows[ends]
            rows, node, symbol = rows[~ends], node[~ends], symbol[~ends]
            new = np.ones(len(rows), bool)
            new[1:] = (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])
            child = made + np.cumsum(new) - 1
            size = np.bincount(child - made, minlength=int(new.sum()))
            children.append(np.bincount(node[new] - level[0], minlength=level[1] - level[0]))
            below = np.full(int(new.sum()), -1, "i8")
            single = size[child - made] == 1
            below[child[single] - made] = rows[single]
            symbols.append(symbol[new])
            row.append(below)
            level = (made, made + int(new.sum()))
            made = level[1]
            rows, node, depth = rows[~single], child[~single], depth + 1
        counts = np.concatenate([*children, np.zeros(made - sum(map(len, children)), "i8")])
        first = np.concatenate(([1], 1 + np.cumsum(counts)))
        return cls(symbol=_smallest(np.concatenate(symbols)), first=first.astype("i4"), row=np.concatenate(row).astype("i4"), flat=_smallest(flat), starts=starts.astype("i4"), n=np.array(n, "i8"))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Trie:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{name: found[name] for name in cls.FIELDS})

    def word(self, row: int) -> str:
        return "".join(chr(int(c) - 1) for c in self.flat[self.starts[row] : self.starts[row + 1] - 1])

    def child(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The child of each node by a symbol, or -1."""
        low, end = self.first[node], self.first[node + 1]
        high = end
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            less = (low < high) & (self.symbol[np.minimum(mid, len(self.symbol) - 1)] < symbol)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        found = low < end
        found[found] = self.symbol[low[found]] == symbol[found]
        return np.where(found, low, -1)


def _same_tails(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Which pairs of words agree from two places on."""
    same, left = np.zeros(len(at_a), bool), np.arange(len(at_a))
    while len(left):
        x = a[at_a[left]]
        equal = x == b[at_b[left]]
        same[left[equal & (x == 0)]] = True
        left = left[equal & (x != 0)]
        at_a, at_b = at_a + 1, at_b + 1
    return same


def neighbours(trie: Trie, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (number of a word as by ``coded``, row of the trie) that differ by exactly one edit, each once."""
    stop, trie_stop = starts[1:] - 1, trie.starts[1:] - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def at_leaves(w, p, v, depth, edited):
        """Settles the states whose node is the only way to one word, and gives the others back."""
        leaf = trie.first[v] == trie.first[v + 1]
        x, q, row = w[leaf], p[leaf], trie.row[v[leaf]]
        u = trie.starts[row] + depth
        more = (trie_stop[row] - u) - (stop[x] - q)
        near = more == 0 if edited else abs(more) <= 1
        x, q, row, u, more = x[near], q[near], row[near], u[near], more[near]
        if edited:
            good = _same_tails(flat, trie.flat, q, u)
        else:
            q, u, left = q.copy(), u.copy(), np.arange(len(x))
            while len(left):  # on to the first difference
                a = flat[q[left]]
                left = left[(a == trie.flat[u[left]]) & (a != 0)]
                q[left] += 1
                u[left] += 1
            good = flat[q] != trie.flat[u]
            good[good] = _same_tails(flat, trie.flat, (q + (more <= 0))[good], (u + (more >= 0))[good])
        out.append((x[good], row[good]))
        return w[~leaf], p[~leaf], v[~leaf]

    w = np.arange(len(starts) - 1)
    none = w[:0]
    stack = [(0, (w, starts[:-1].astype("i8"), np.zeros(len(w), "i8")), (none, none, none))]
    while stack:
        depth, (w, p, v), (ew, ep, ev) = stack.pop()
        if max(len(w), len(ew)) > PART:
            for at in range(0, max(len(w), len(ew)), PART):
                cut = slice(at, at + PART)
                stack.append((depth, (w[cut], p[cut], v[cut]), (ew[cut], ep[cut], ev[cut])))
            continue
        symbol = flat[p]
        # one symbol of the word left out
        drop = np.flatnonzero(symbol)
        drop = drop[flat[p[drop] + 1] != symbol[drop]]
        ew, ep, ev = np.concatenate((ew, w[drop])), np.concatenate((ep, p[drop] + 1)), np.concatenate((ev, v[drop]))
        # edited states end or go on by the word's own symbol
        wanted = flat[ep]
        end = wanted == 0
        row = trie.row[ev[end]]
        out.append((ew[end][row >= 0], row[row >= 0]))
        ew, ep, ev, wanted = ew[~end], ep[~end], ev[~end], wanted[~end]
        to = trie.child(ev, wanted)
        on = to >= 0
        ew, ep, ev = ew[on], ep[on] + 1, to[on]
        # all children of the others: by the word's symbol unedited, else as one inserted or replaced
        low, size = trie.first[v].astype("i8"), (trie.first[v + 1] - trie.first[v]).astype("i8")
        state = np.repeat(np.arange(len(v)), size)
        to = np.arange(len(state)) - np.repeat(np.cumsum(size) - size, size) + low[state]
        match = trie.symbol[to] == symbol[state]
        w, p, v, state, to, symbol = w[state[match]], p[state[match]] + 1, to[match], w[state[~match]], to[~match], (p[state[~match]], symbol[state[~match]])
        other = symbol[1] != 0
        ew = np.concatenate((ew, state, state[other]))
        ep = np.concatenate((ep, symbol[0], symbol[0][other] + 1))
        ev = np.concatenate((ev, to, to[other]))
        depth += 1
        w, p, v = at_leaves(w, p, v, depth, False)
        ew, ep, ev = at_leaves(ew, ep, ev, depth, True)
        if len(w) or len(ew):
            stack.append((depth, (w, p, v), (ew, ep, ev)))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


# Shards and waves


def trie_shards(words: DataFrame) -> DataFrame:
    """first (the first word), size in bytes and data of tries over words (word, n), each a stretch in code-point order."""
    most_words, most_chars = SHARD_WORDS, SHARD_CHARS

    def run(batches):
        import pyarrow as pa

        held: list[str] = []
        n: list[int] = []
        chars = 0

        def cut():
            data = Trie.build(held, n).dump()
            return pa.RecordBatch.from_pydict({"first": pa.array(held[:1], pa.string()), "size": pa.array([len(data)], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for word, count in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if held and (len(held) >= most_words or chars + len(word) > most_chars):
                    yield cut()
                    held, n, chars = [], [], 0
                held.append(word)
                n.append(count)
                chars += len(word)
        if held:
            yield cut()

    parts = max(1, -(-words.count() // most_words))
    ordered = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, "first string, size bigint, data binary")


def waves_of(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Shards, by their first word, in waves of at most so many bytes or of one shard."""
    waves: list[list[str]] = []
    room = 0
    for first, size in sorted(sizes):
        if not waves or size > room:
            waves.append([])
            room = most
        waves[-1].append(first)
        room -= size
    return waves


def best_neighbours(words: list[str], tries: list[Trie]) -> dict[str, list]:
    """For each word and trie with neighbours: word, n_near, form (the best neighbour) and form_n."""
    made: dict[str, list] = {"word": [], "n_near": [], "form": [], "form_n": []}
    for at in range(0, len(words), BLOCK):
        block = words[at : at + BLOCK]
        flat, starts = coded(block)
        for trie in tries:
            w, row = neighbours(trie, flat, starts)
            order = np.lexsort((row, -trie.n[row], w))
            w, row = w[order], row[order]
            firsts = np.flatnonzero(np.diff(w, prepend=-1))
            made["word"] += [block[i] for i in w[firsts].tolist()]
            made["n_near"] += np.diff(firsts, append=len(w)).tolist()
            made["form"] += [trie.word(r) for r in row[firsts].tolist()]
            made["form_n"] += trie.n[row[firsts]].tolist()
    return made


def _search(words: DataFrame, blobs: list[bytes]) -> DataFrame:
    """best_neighbours of all words in one wave of shards."""
    shared = words.sparkSession.sparkContext.broadcast(blobs)

    def run(batches):
        import pyarrow as pa

        tries = [Trie.load(b) for b in shared.value]
        for batch in batches:
            made = best_neighbours(sorted(batch.column("word").to_pylist()), tries)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("word", "form") else pa.int64()) for k, v in made.items()})

    found = materialize(words.select("word").mapInArrow(run, "word string, n_near bigint, form string, form_n bigint"), "near-words")
    shared.destroy()
    return found


def near_words(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """words (word, n; distinct words) with n_near, and form and form_n where the best neighbour is ratio times as frequent."""
    words = materialize(words.select("word", "n"), "words")
    shards = materialize(trie_shards(words), "shards")
    parts = max(1, -(-words.count() // TASK_WORDS))
    spread = words.repartition(parts)
    found = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("bigint").alias("form_n"))
    for wave in waves_of([(r["first"], r["size"]) for r in shards.select("first", "size").collect()], WAVE_BYTES):
        blobs = [bytes(r["data"]) for r in shards.where(F.col("first").between(wave[0], wave[-1])).orderBy("first").select("data").collect()]
        found = found.unionByName(_search(spread, blobs), allowMissingColumns=True)
    rank = F.when(F.col("form").isNotNull(), F.struct(-F.col("form_n"), "form"))
    best = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min_by(F.struct("form", "form_n"), rank).alias("best"))
    kept = F.col("best.form_n") >= ratio * F.col("n")
    return best.select("word", "n", "n_near", F.when(kept, F.col("best.form")).alias("form"), F.when(kept, F.col("best.form_n")).alias("form_n"))


def with_roots(near: DataFrame) -> DataFrame:
    """Adds root: the last word that forms lead to. Each round doubles the steps that a root is away."""
    near = materialize(near, "forms")
    links = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # ends: a chain of k steps needs log2(k) rounds, and counts of 64 bits allow log(2^63) / log(ratio) steps
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return near.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, slip: int | None = None, ratio: float = RATIO, letters: str = LETTERS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of docs (doc_id, text)."""
    return with_roots(near_words(count_words(docs, letters, min_length, min_count, slip), ratio))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of the words of all whole texts of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_variants(docs, SLIP).select("word", "form", "root", "n", "n_near", "form_n")
