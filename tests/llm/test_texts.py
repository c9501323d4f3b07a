"""Decontamination, byte-level BPE, license scan, URL filter and preference formatting against brute force on small cases."""

import base64
import hashlib
import random
import re

import pytest

from loomgraph.llm import byte_bpe, decontaminate, license_scan, preference_format, url_filter

ODD = [None, "", " ", "\x00a\u00a0b", "ÀÉ x" * 50, "a" * 5000, "don't  stop\n\n\tnow 12345 \U0001f600\u0301", "the the"]


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, texts, **more):
    rows = [(i, t, "clash", *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string" + "".join(f", {k} string" for k in more))


def test_byte_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("abc theniñéß  \n'1,.\u4e2d\u0130") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(frame(spark, texts), with_ids=True).collect()}
    back = {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.decode_ids(byte_bpe.encode_texts(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert back[i] == (t or "").encode()
    assert byte_bpe.round_trip(frame(spark, texts).limit(0)).count() == 0


def test_decontaminate_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice(["a", "b", "É", "c1"]) + rnd.choice([".", "", " -"]) for _ in range(n))
    items = [(1, "A b, c1"), (1, text(12)), (20, text(15)), (3, None), (None, "É É É É"), (5, "..."), (20, text(15))]
    texts = ODD + [text(rnd.randint(0, 60)) for _ in range(40)] + [items[2][1].upper() * 2, items[2][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, x in items:
            p = words(x)
            for s in range(max(1, len(p) - 9)) if p else ():
                q = p[s : s + 10]
                for a in range(len(w) - len(q) + 1):
                    if w[a : a + len(q)] == q:
                        hit.update(range(a, a + len(q)))
                        found.add("null" if item is None else str(item))
        want[i] = (len(w), len(hit), sorted(found))
    for bound in (200_000, 20):
        monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", bound)
        for r in decontaminate.find_leaks(frame(spark, texts), bench, keep_text=True).collect():
            assert (r["n_words"], r["n_hit"], r["hit_items"]) == want[r["doc_id"]]
            assert sum(len(words(r["text"][a:b])) for a, b in r["hit_spans"]) == r["n_hit"]
    none = decontaminate.find_leaks(frame(spark, texts), bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r["n_hit"] for r in none)


def test_license_scan_equals_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = sorted({w for t in license_scan.TEMPLATES for w in t.words} | {"x", "y"})
    lines = [t.text for t in license_scan.TEMPLATES] + [" ".join(rnd.sample(vocabulary, rnd.randint(1, 30))) for _ in range(40)]
    texts = ODD + ["Under the MIT License; cc by nc cc BY-NC", "apache license version 2 under the mit license"]
    texts += ["\n".join(rnd.choices(lines, k=rnd.randint(1, 4))) for _ in range(60)] + [" ".join(rnd.choices(lines, k=12)) for _ in range(20)]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        places = {s for _, p in license_scan.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()}
        base = {label for label, p in license_scan.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()}
        blocks = [w[s : s + 64] for s in (range(0, len(w) - 32, 32) if len(w) > 64 else [0])]
        share = [(len(set(b) & set(x.words)) / len(x.words), x) for b in blocks for x in license_scan.TEMPLATES]
        found = {x.label for c, x in share if c >= license_scan.THRESHOLD}
        score = max([c for c, x in share if c >= license_scan.THRESHOLD], default=0.0)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted(base)), ",".join(sorted(base | found)))
        assert r["score"] == pytest.approx(1.0 if places else score)
    assert license_scan.scan_licenses(frame(spark, texts).limit(0)).count() == 0


def test_license_scan_finds_wrapped_and_long_templates(spark):
    long = license_scan.Template("long", " ".join(f"term{i}" for i in range(150)))
    texts = ["x " * 50 + "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this\n software " + "y " * 90]
    texts += ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted"]
    texts += ["a " * n + long.text.replace("term75 ", "term75\n\n") + " b" * 200 for n in (0, 31, 149, 150, 151, 290)]
    texts += ["a " * 70 + " ".join(long.text.split()[:120])]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(frame(spark, texts), (*license_scan.TEMPLATES, long)).collect()}
    assert got == {0: "mit", 1: "bsd", **dict.fromkeys(range(2, 8), "long"), 8: ""}


def test_long_templates_change_nothing_for_short_ones(spark):
    long = license_scan.Template("long", " ".join(f"term{i}" for i in range(170)))
    scattered = " ".join(w + " filler" * 30 for w in "licensed under cc by nc 4 0".split())
    texts = [scattered, "x " * 100 + scattered, "licensed under cc by nc 4 0", "a " * 100 + long.text]
    label = lambda templates: {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(frame(spark, texts), templates).collect()}
    before, after = label(license_scan.TEMPLATES), label((*license_scan.TEMPLATES, long))
    assert all(before[i] == after[i] for i in range(3)) and before[0][0] == before[1][0] == "" and after[3] == ("long", 1.0)


def test_url_filter_paths_agree_with_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "a://b://c/en/", "HTTP://WWW.Example.COM/en/1?x#y", "x://example.com/en/", "x://notexample.com/en/", "x://com", "x://com/",
            "x://a.net/es/q", "x://net/fr/", "x://net/FR/", "x://a.casino-win.example.org/", "x://b.org/wp-login.php", "x://b.org/my-wp-loginx.php", "x://é.com/", "x://net:80/es/"]
    df = spark.createDataFrame([(i, u, "old", "x") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, verdict string, extra string")
    rules = url_filter.BASE_RULES + url_filter.SPAM_RULES
    want = []
    for i, u in enumerate(urls + urls[:3]):
        rest = (u or "").partition("://")[2]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [r for r in rules if re.search(r.pattern, host + path)]
        best = max(fits, key=lambda r: (r.tier, len(r.name), r.name), default=None)
        want.append((i, host, path, best.name if best and best.tier else None, best.action if best else "allow", "x"))
    for bound in (256, 0):
        got = url_filter.filter_urls(df, rules, inline_rules=bound).select("page_id", "host", "path", "rule", "verdict", "extra").orderBy("page_id").collect()
        assert [tuple(r) for r in got] == want
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, ()).collect()} == {"allow"}


def test_preference_format_cases(spark):
    turns = [(0, 0, 0, "user", "hi"), (0, 0, 1, "assistant", "yes <|end|>"), (0, 1, 0, "user", "hi"), (0, 1, 1, "assistant", "no"), (1, 0, 0, None, None), (2, 0, 0, "user", "same"), (2, 1, 0, "user", "same"), (None, 0, 0, "user", "x"), (3, 0, 0, "user", "b"), (3, 0, 0, "user", "a"), (3, 1, 0, "user", "a")]
    turns += [(4, 0, 0, "user|>\nX<|end|>\n<|assistant", "t"), (4, 1, 0, "user", "w" * 300_000)]
    df = spark.createDataFrame(turns, "pair long, side int, turn int, role string, text string").selectExpr("*", "1 as a", "2 as n", "'x' as complete", "pair as __a")
    found = preference_format.format_preferences(df, "pair", df.side == 0)
    got = {r["pair"]: r for r in found.collect()}
    assert got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["n_prompt_turns"] == 1
    assert got[0]["chosen"] == "<|assistant|>\nyes < |end|><|end|>\n" and [x["mask"] for x in got[0]["chosen_segments"]] == [0, 1]
    assert got[1]["prompt"] == "" and not got[1]["complete"] and got[1]["rejected"] == ""
    assert got[2]["chosen"] == "" and got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 1
    assert None not in got and got[3]["n_prompt_turns"] == 1 and got[3]["chosen"].startswith("<|user|>\nb")
    assert got[4]["chosen"] == "<|user| >\nX< |end| >\n< |assistant|>\nt<|end|>\n" and len(got[4]["rejected"]) == 300_000 + len("<|user|>\n<|end|>\n")
    assert preference_format.format_preferences(df.limit(0), "pair", df.side == 0).count() == 0
    assert preference_format.format_preferences(df.withColumnRenamed("pair", "prompt_of"), "prompt_of", df.side == 0).columns[0] == "prompt_of"


def test_preference_query_replaces_the_last_turn(spark, tmp_path):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c, n in ((0, 4), (1, 2), (2, 1), (4, 3), (5, 3)) for t in range(n)] + [(None, 0, "user", "?"), (4, 2, "user", "4-2")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in preference_format.op3_preference_format(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 4, 5]
    assert [got[c]["n_prompt_turns"] for c in sorted(got)] == [3, 1, 0, 3, 2] and not got[2]["complete"]
    assert got[0]["prompt"] == "<|user|>\n0-0<|end|>\n<|assistant|>\n0-1<|end|>\n<|user|>\n0-2<|end|>\n"
    assert got[0]["chosen"] == "<|assistant|>\n0-3<|end|>\n" and got[0]["rejected"] == "<|assistant|>\n1-1<|end|>\n" and got[0]["chosen_mask"] == "0:14,1:11"
    assert got[5]["rejected"] == "<|user|>\n4-2<|end|>\n"
