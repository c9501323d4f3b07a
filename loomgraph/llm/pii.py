"""Personal data by bootstrapped contextual extraction.

Seeds are what the kinds' fixed forms match. The words around a seed induce lexical patterns: the last one or two before it, the
first one or two after it, and one on either side. Other spans whose shape a kind allows are candidates, whole however long: runs
of 7 to 19 digits with spaces, brackets, dots, slashes, colons and hyphens between them, addresses of machines with ports or in
hexadecimal, words around an @ or a written [at]. They stand in a graph with the patterns around them, and Spark scores the graph
in rounds: a pattern's confidence in a kind is the share of its weight that stands on instances of this kind, once ``MIN_SEEDS``
distinct instances support it; a candidate's confidence is the noisy-or of its patterns', for the kinds that its shape allows. A
candidate of ``MIN_CONFIDENCE`` supports patterns like a seed from then on, so that patterns which no seed has are found in later
rounds. Confidences only rise, and the rounds end when none moves any more (by ``SETTLED``), however many that takes. Accepted
candidates are found where a pattern of ``MIN_CONFIDENCE`` stands beside them.

All of a text is read, once. Patterns and instances are aggregated before any join, and a pattern that many instances share is
split over ``SALTS`` parts where it is joined, so frequent words gather no group.

Defined cases: a null text counts as empty and has no spans; repeated rows each get their result, and count once as evidence; an
empty table gives an empty result; very long digit runs and tokens are scanned in linear time; further columns are left out by
``find_personal_data``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_texts, materialize, table, text_key

#: The kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
#: Confidences only rise from round to round; the rounds end when all of them together have risen by no more than this.
SETTLED = 1e-6
SALTS = 32
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# an address can only begin where a run of digits does, and nothing is gained by giving digits back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_STRIP = ".,;:!?\"'()[]{}<>|*#$%&="
_RUN = re.compile(r"\(?[0-9](?:[\x20()./:-]{0,3}[0-9])*+")
_MACHINE = re.compile(r"[0-9]{1,3}(?:[.:][0-9]{1,3}){3}(?::[0-9]{1,5}|/[0-9]{1,2})?|[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){3,7}")
_WRITTEN_AT = re.compile(r"(?<!\S)[\w.+-]++ ?[\[({] ?at ?[\])}] ?[\w.-]++", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the contract's form would match, but each run before an @ is walked once."""
    out, pos = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > pos and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            out.append((at, m.end()))
            pos = m.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


class Context:
    """The words around spans of a text, without the punctuation around them."""

    def __init__(self, text: str) -> None:
        self.text = text
        spots = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts, self.ends = [a for a, _ in spots], [b for _, b in spots]

    def _words(self, numbers, cut_start: int, cut_end: int) -> list[str]:
        """The first two words that are left of the numbered tokens' parts between the cuts."""
        found: list[str] = []
        for i in numbers:
            word = self.text[max(self.starts[i], cut_start) : min(self.ends[i], cut_end)].strip(_STRIP).lower()
            if word:
                found.append(word)
            if len(found) == 2:
                break
        return found

    def patterns(self, start: int, end: int) -> list[str]:
        """Patterns before (<), after (>) and around (<>) the span."""
        left = self._words(range(bisect_left(self.starts, start) - 1, -1, -1), 0, start)
        right = self._words(range(bisect_right(self.ends, end), len(self.ends)), end, len(self.text))
        out = ["< " + " ".join(left[:n][::-1]) for n in (1, 2) if len(left) >= n] + ["> " + " ".join(right[:n]) for n in (1, 2) if len(right) >= n]
        return out + ([f"<> {left[0]} {right[0]}"] if left and right else [])


def kinds_of(span: str) -> list[str]:
    """The kinds that a candidate's shape allows."""
    digits = sum("0" <= c <= "9" for c in span)
    if "@" in span or _WRITTEN_AT.fullmatch(span):
        return ["email"]
    if _MACHINE.fullmatch(span):
        return ["ip"]
    return [k for k, fits in (("card", 13 <= digits <= 19), ("phone", 7 <= digits <= 15)) if fits]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, str, list[str]]]:
    """Spans outside the taken ones, and of each other, whose shape some kind allows: start, end, text, kinds."""
    out: list[tuple[int, int, str, list[str]]] = []
    if not re.search(r"[0-9@]|[\[({] ?at ?[\])}]", text, re.I):
        return out
    used = sorted((a, b) for _, a, b in taken)

    def add(a: int, b: int) -> bool:
        span = text[a:b]
        kinds = kinds_of(span)
        at = bisect_left(used, (b,))
        # spans in use do not overlap but for a few kinds' nested ones, so the ones just before tell
        if not kinds or any(y > a for _, y in used[max(0, at - 4) : at]):
            return False
        insort(used, (a, b))
        out.append((a, b, span, kinds))
        return True

    for m in _WRITTEN_AT.finditer(text):
        add(*m.span())
    for m in re.finditer(r"\S+", text):
        if "@" in m[0] or m[0].count(":") >= 3 or (":" in m[0] or "/" in m[0]) and m[0].count(".") == 3:
            token = m[0].strip(_STRIP)
            a = m.start() + m[0].index(token)
            if "@" in token and re.fullmatch(r"[^\s@]+@[^\s@]+", token) or _MACHINE.fullmatch(token):
                add(a, a + len(token))
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7 or add(*m.span()):
            continue
        # not one identifier: its parts between spaces
        for part in re.finditer(r"[^\x20]+", m[0]):
            if len(part[0]) >= 7:
                add(m.start() + part.start(), m.start() + part.end())
    return sorted(out)


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_OCCURRENCE = "array<struct<start:int,end:int,instance:string,kind:string,fits:array<string>,patterns:array<string>>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base (spans joined), n_<kind>, base_sha256 and found: occurrences of seeds and candidates with their patterns."""

    def make():
        def run(texts):
            base, counts, sums, found = [], {k: [] for k in KINDS}, [], []
            for t in texts:
                spans = base_spans(t or "")
                base.append(join_spans(spans))
                sums.append(hashlib.sha256(base[-1].encode()).hexdigest())
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                rows = [(a, b, t[a:b], k, [k]) for k, a, b in spans]
                rows += [(a, b, x, None, kinds) for a, b, x, kinds in candidates(t or "", spans)]
                around = Context(t) if rows else None
                found.append([{"start": a, "end": b, "instance": x, "kind": k, "fits": f, "patterns": around.patterns(a, b)} for a, b, x, k, f in rows])
            return [base, *counts.values(), sums, found]

        return run

    new = [("base", "string"), *((f"n_{k}", "bigint") for k in KINDS), ("base_sha256", "string"), ("found", _OCCURRENCE)]
    return map_texts(docs, make, new, text)


def score_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(pattern, instance, kind or null, fits, weight), distinct -> confidences p_<kind> of patterns and c_<kind> of candidates.

    There are as many rounds as it takes until no confidence moves by more than SETTLED.
    """
    known = edges.where("kind IS NOT NULL").withColumns({f"c_{k}": F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in KINDS})
    unknown = edges.where("kind IS NULL")
    own = known.unionByName(unknown.withColumns({f"c_{k}": F.lit(0.0) for k in KINDS}))
    salt = F.pmod(F.xxhash64("instance"), F.lit(SALTS))
    before = None
    for n in itertools.count():
        support = lambda k: F.count(F.when(F.col(f"c_{k}") >= MIN_CONFIDENCE, 1))
        sums = {f"p_{k}": F.when(support(k) >= MIN_SEEDS, F.sum(F.col("weight") * F.col(f"c_{k}")) / F.sum("weight")).otherwise(0.0) for k in KINDS}
        patterns = materialize(own.groupBy("pattern").agg(*(v.alias(k) for k, v in sums.items())).where(F.greatest(*sums) > 0), f"patterns-{n}")
        split = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        fit = lambda k: F.when(F.array_contains("fits", k), F.col(f"p_{k}")).otherwise(0.0)
        noisy_or = {f"c_{k}": 1 - F.exp(F.sum(F.log(1 - F.least(fit(k), F.lit(0.999))))) for k in KINDS}
        found = unknown.withColumn("salt", salt).join(split, ["pattern", "salt"]).groupBy("instance").agg(*(v.alias(k) for k, v in noisy_or.items()))
        found = materialize(found, f"instances-{n}")
        total = found.agg(F.sum(sum(F.col(f"c_{k}") for k in KINDS))).first()[0] or 0.0
        # sums of very many confidences are rounded
        if before is not None and total - before <= max(SETTLED, 1e-12 * total):
            break
        before = total
        rest = unknown.join(found, "instance", "left").select(*edges.columns, *(F.coalesce(f"c_{k}", F.lit(0.0)).alias(f"c_{k}") for k in KINDS))
        own = known.unionByName(rest)
    return patterns, found


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key (of text_key), n_<kind>, base_sha256 and spans, base ones and discovered ones joined."""
    docs = docs.select("doc_id", "text", text_key("doc_id", "text").alias("key"))
    scanned = materialize(scan(docs), "scanned")
    # a text that several rows bear counts once
    seen = scanned.where(F.size("found") > 0).groupBy("key").agg(F.any_value("found").alias("found")).select("key", F.inline("found"))
    seen = materialize(seen, "occurrences")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind", "fits").groupBy("pattern", "instance", "kind", "fits").agg(F.count("*").alias("weight"))
    patterns, instances = score_graph(materialize(edges, "edges"))
    trusted = patterns.where(F.greatest(*(F.col(f"p_{k}") for k in KINDS)) >= MIN_CONFIDENCE)
    sure = lambda k: F.array_contains("fits", k) & (F.col(f"p_{k}") >= MIN_CONFIDENCE) & (F.col(f"c_{k}") >= MIN_CONFIDENCE)
    best = F.array_max(F.array(*(F.when(sure(k), F.struct(F.col(f"c_{k}").alias("c"), F.lit(-n).alias("n"), F.lit(k).alias("kind"))) for n, k in enumerate(KINDS))))
    likely = instances.where(F.greatest(*(F.col(f"c_{k}") for k in KINDS)) >= MIN_CONFIDENCE)
    spots = seen.where("kind IS NULL").join(likely, "instance").withColumn("pattern", F.explode("patterns")).join(trusted, "pattern")
    spots = spots.withColumn("best", best).where("best IS NOT NULL").groupBy("key", "start", "end").agg(F.max("best").alias("best"))
    spots = spots.groupBy("key").agg(F.collect_list(F.concat_ws(":", "best.kind", "start", "end")).alias("more"))
    result = scanned.drop("found").join(spots, "key", "left")
    part = lambda s, i: F.split(s, ":")[i]
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), part(s, 0)).alias("k"), part(s, 1).cast("int").alias("a"), s.alias("s"))
    every = F.concat(F.filter(F.split("base", ","), lambda s: s != ""), F.coalesce("more", F.array().cast("array<string>")))
    return result.withColumn("spans", F.array_join(F.transform(F.array_sort(F.transform(every, rank)), lambda r: r["s"]), ",")).drop("base", "more")


def cut(text: str, spans: str) -> str:
    """The text with <KIND> in the place of every span; of spans that overlap the first by start names the kind."""
    ranges = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    out, at = [], 0
    for a, b, k in ranges:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Puts <KIND> in the place of every span; the columns of docs stay, n_chars becomes the new length where there is one."""
    columns = docs.columns
    keyed = docs.withColumn("__key", text_key("doc_id", "text"))
    spans = found.where("spans <> ''").groupBy(F.col("key").alias("__key")).agg(F.any_value("spans").alias("__spans"))
    joined = keyed.join(spans, "__key", "left").select(*columns, "__spans")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(at, SLICE_ROWS)
                texts = [t if s is None else cut(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), strict=True)]
                new = {"text": pa.array(texts, b.schema.field("text").type)}
                yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in columns], names=columns)

    done = joined.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    return done


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return find_personal_data(table(spark, sf_dir, "documents")).drop("key")
