"""Spelling variants, fill-in-the-middle and language identification: brute force, round trips, held-out accuracy, odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_in_middle, language_id, spelling
from loomgraph.llm.common import in_training
from loomgraph.llm.registry import QUERIES

ODD = [None, "", " \n", "123 ½", "<P> a", "a\n\nb\r\n", "x" * 70_000, "ÀÉ abcdefgh\nabcdefgh"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Spelling


def edits(word, alphabet):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    found = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in alphabet} | {a + c + b[1:] for a, b in cuts if b for c in alphabet}
    return found - {word}


def variants(rows, slip, min_length=7, ratio=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if slip and h % slip == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= 2}
    alphabet, form, near = {c for w in n for c in w}, {}, {}
    for w in n:
        found = edits(w, alphabet) & n.keys()
        near[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], near[w], form[w], n[form[w]] if form[w] else None, root)
    return out


def test_trie_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        word = lambda: "".join(rnd.choices("abÿ", k=rnd.randint(1, 8)))  # noqa: E731, B023
        words, asked = sorted({word() for _ in range(rnd.randint(1, 100))}), sorted({word() for _ in range(60)})
        trie = spelling.Trie.load(spelling.Trie.build(words, list(range(len(words)))).dump())
        assert [trie.word(i) for i in range(len(words))] == words
        a, b = spelling.neighbours(trie, *spelling.coded(asked))
        assert sorted((asked[i], words[j]) for i, j in zip(a, b, strict=True)) == sorted((w, x) for w in asked for x in edits(w, "abÿ") & set(words))


def test_states_are_expanded_in_parts(monkeypatch):
    words = sorted({"".join(random.Random(i).choices("ab", k=9)) for i in range(300)})
    trie = spelling.Trie.build(words, [1] * len(words))
    whole = sorted(zip(*(x.tolist() for x in spelling.neighbours(trie, *spelling.coded(words))), strict=True))
    monkeypatch.setattr(spelling, "PART", 50)
    assert sorted(zip(*(x.tolist() for x in spelling.neighbours(trie, *spelling.coded(words))), strict=True)) == whole


def test_very_long_words():
    long = "ab" * 3000
    words = sorted([long, long + "b", long[:4000] + long[4001:], "x" + long, long[:-1] + "ÿ", "short", "a" * 5000, "a" * 5001])
    trie = spelling.Trie.build(words, [1] * len(words))
    a, b = spelling.neighbours(trie, *spelling.coded(words))
    got = {frozenset((words[i], words[j])) for i, j in zip(a, b, strict=True)}
    near = [(long, long + "b"), (long, long[:4000] + long[4001:]), (long, "x" + long), (long, long[:-1] + "ÿ"), ("a" * 5000, "a" * 5001)]
    assert got == set(map(frozenset, near))


def spelling_rows():
    rnd = random.Random(2)
    base = ["".join(rnd.choices("abcdeéÿ", k=rnd.randint(7, 11))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "Abcdefghi abcdefghi"), (3, "Zabcdefg zabcdefg"), (3, "Zabcdefg zabcdefg")]
    for i in range(400):
        picked = rnd.choices(base, weights=[1 / (k + 1) ** 1.5 for k in range(len(base))], k=30)
        rows.append((100 + i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in picked)))
    # a chain whose counts rise by tens, and a tie of two forms
    rows += [(5000 + k, " ".join(["kettle" + "s" * (5 - k)] * 2 * 10**k)) for k in range(4)] + [(6000, " ".join(["pattern"] * 40 + ["battern"] * 40 + ["mattern"] * 3))]
    return rows


@pytest.mark.parametrize("slip", [None, 5])
def test_group_variants_equals_brute_force(spark, monkeypatch, slip):
    for name, value in {"SHARD_WORDS": 12, "SHARD_CHARS": 90, "WAVE_BYTES": 9000, "COUNTED": 7, "TASK_WORDS": 20, "BLOCK": 16}.items():
        monkeypatch.setattr(spelling, name, value)
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, word string, n string").repartition(3)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group_variants(docs, slip).collect()}
    want = variants(rows, slip)
    assert got == want and any(v[4] != v[2] is not None for v in want.values())
    if slip is None:
        assert got["mattern"][2] == "battern" and got["kettlesssss"][4] == "kettless"


def test_waves_are_bounded():
    sizes = [(f"{i:02}", size) for i, size in enumerate([5, 5, 5, 50, 1, 9, 1])]
    waves = spelling.waves_of(sizes[::-1], 10)
    assert [w for wave in waves for w in wave] == [w for w, _ in sizes]
    assert all(sum(dict(sizes)[w] for w in wave) <= 10 or len(wave) == 1 for wave in waves)


def test_spelling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0 and spelling.group_variants(docs.limit(0)).count() == 0


# Fill in the middle


def test_fill_in_middle_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = ODD + ["".join(rnd.choices("ab<S>PM\n\né", k=rnd.randint(1, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc\n"), (9, texts[9]), (9_007_199_254_740_993, "a\nb\nc\n"), (-5, "a\nb")]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, form string, __other long").repartition(3)
    for rate, spm in ((100, 50), (40, 0), (0, 50)):
        made = fill_in_middle.fill_in_middle(docs, rate=rate, spm_rate=spm, keep_text=True).collect()
        assert len(made) == len(rows) and "__other" in made[0].asDict()
        for r in made:
            text, i = r["text"] or "", "" if r["doc_id"] is None else r["doc_id"]
            h1, h2, h3, h4 = (int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24))
            units = re.findall(r"[^\n]*\n|[^\n]+", text)
            a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
            parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
            if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
                want = ("plain", None, None, text)
            elif h4 % 100 < spm:
                want = ("spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}")
            else:
                want = ("psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}")
            assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want and r["n"] == len(units)
    made = fill_in_middle.fill_in_middle(docs)
    back = {(r["doc_id"], r["text"]) for r in fill_in_middle.restore_texts(made).collect()}
    assert back == {(i, t or "") for i, t in rows}
    assert fill_in_middle.digests(docs.limit(0)).count() == 0


def test_pieces_with_halves_of_markers_come_back():
    for text in ("<\n<S\n>", ">\n<\nP>", "<M\n>\n<", "S>\n<"):
        for numbers in ((a, b, 0, c) for a in range(4) for b in range(4) for c in (0, 99)):
            ends = fill_in_middle.unit_ends(lambda t: re.finditer(fill_in_middle.LINES, t), text)
            form, _, _, output = fill_in_middle.transform(text, ends, list(numbers))
            assert form != "plain" and fill_in_middle.restore(output, form) == text


# Language identification

TONGUES = {
    "en": ["the", "of", "and", "ring", "tion", "water", "house"],
    "fr": ["les", "des", "une", "eaux", "ment", "maison", "être"],
    "de": ["der", "und", "keit", "schen", "wasser", "straße", "für"],
}


def tongue_rows(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        lang = rnd.choices(list(TONGUES), weights=[8, 2, 1])[0]
        text = " ".join("".join(rnd.choices(TONGUES[lang], k=rnd.randint(1, 2))) for _ in range(rnd.randint(8, 80)))
        yield i, text.upper() if i % 9 == 0 else text, lang


def test_languages_of_held_out_texts(spark):
    rows = list(tongue_rows(600, 3))
    docs = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(ODD)] + [rows[0]], "doc_id long, text string, lang string").withColumn("margin", F.lit("clash")).repartition(3)
    learns = in_training(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs, learns, texts=20)
    assert list(model)[0] == "en" and set(model) == set(TONGUES)
    got = language_id.identify(docs, model, keep_text=True).select("*", (~learns).alias("held")).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    held = [r for r in got if r["held"] and r["lang"]]
    assert sum(r["nearest"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(r["language"] is None or r["language"] == r["lang"] for r in held)
    for r in got:
        assert 0 <= r["margin"] <= 1
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["nearest"], r["language"], r["margin"]) == ("und", "und", 0)


def test_language_sample_is_bounded_and_even(spark):
    docs = spark.createDataFrame([(i, t * 50, lang) for i, t, lang in tongue_rows(900, 5)] + [(5000, "einziger", "xx"), (5001, "...", "yy"), (None, None, "zz")], "doc_id long, text string, lang string")
    pieces = language_id.sample(docs, F.lit(True), texts=30, chars=40)
    sizes = {k: len(v) for k, v in pieces.items()}
    assert sum(sizes.values()) <= 30 * 4 and sizes["xx"] == 1 and "yy" not in sizes and all(15 <= sizes[k] <= 60 for k in TONGUES)
    assert all(len(p) <= 40 for v in pieces.values() for p in v)


def test_languages_without_rows_or_rivals(spark):
    docs = spark.createDataFrame([(1, "ab cd", "en"), (2, "ef", None)], "doc_id long, text string, lang string")
    none = language_id.identify(docs, language_id.fit(docs, F.lit(False))).collect()
    assert {(r["nearest"], r["margin"]) for r in none} == {("und", 0.0)}
    one = language_id.identify(docs, language_id.fit(docs, F.lit(True))).collect()
    assert {(r["nearest"], r["language"], r["margin"]) for r in one} == {("en", "en", 1.0)}
    assert language_id.identify(docs.limit(0), {"en": b"abc"}).count() == 0 and language_id.fit(docs.limit(0), F.lit(True)) == {}
    tie = language_id.Compressors({"b": b"same text", "a": b"same text"}).classify("other words")
    assert tie == ("b", 0.0)


# Contracts of the queries


def contract(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return QUERIES[name](spark, str(tmp_path))


def test_contract_of_op11(spark, tmp_path):
    rows = spelling_rows()
    df = contract(spark, tmp_path, "op11_spelling_variants", rows, "doc_id long, text string")
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()} == variants(rows, 31)


def test_contract_of_op12(spark, tmp_path):
    rows = list(enumerate(ODD + ["a\nb\nc\nd"] * 20))
    df = contract(spark, tmp_path, "op12_fill_in_middle", rows, "doc_id long, text string")
    assert dict(df.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(rows) and all(got[i]["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_contract_of_op13(spark, tmp_path):
    rows = list(tongue_rows(300, 6)) + [(900, "12 34", "en"), (901, None, "fr")]
    df = contract(spark, tmp_path, "op13_language_id", rows, "doc_id long, text string, lang string")
    types = dict(df.dtypes)
    assert (types["doc_id"], types["held_out"], types["lang_pred"], types["score"]) == ("bigint", "boolean", "string", "double")
    got = {r["doc_id"]: r for r in df.collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    for i, text, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == (lang if text and i < 900 else "und")
