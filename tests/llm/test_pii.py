"""Personal data against the contract's expressions, and patterns that discover what no seed form matches."""

import hashlib
import random
import re

from loomgraph.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_expressions(spark):
    rnd = random.Random(8)
    texts = [None, "", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8 256.1.1.1 007.0008.1.0001", "+1 (017) 555-7713 +12 3", "4111 1111 1111 1111 and 4111-1111-1111-1112", "é x@y.zz" * 3, "@@a@.b a.b@c..d"]
    texts += ["".join(rnd.choice("0123456789" * 3 + "4111 +-().@ab é") for _ in range(rnd.randint(0, 200))) for _ in range(150)] + ["1" * 20_000, "a" * 20_000 + "@", "1." * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x"), (None, "c@d.ef", "y")], "doc_id long, text string, spans string")
    got = pii.find_personal_data(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = ("c@d.ef" if r["doc_id"] is None else texts[r["doc_id"]]) or ""
        want = brute(t)
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest() == r["base_sha256"]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(filter(None, r["spans"].split(",")))
        for k in pii.KINDS:
            assert r[f"n_{k}"] == sum(s[0] == k for s in want)
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_patterns_discover_unseen_forms_and_leave_others_alone(spark):
    texts = [f"words here, call me at +1 (20{i}) 555-777{i} thanks" for i in range(6)] + [f"server address 10.0.0.{i} is up" for i in range(6)]
    texts += ["please call me at 555-123-4567 now", "part number 555-123-4567 in stock", "server address 10.0.0.1:8080 is up", "build 10.0.0.1:8080 failed"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_personal_data(df)
    got = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert got[12] == "phone:18:30" and got[13] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df, found).collect()}
    assert clean[12] == "please call me at <PHONE> now" and clean[13] == texts[13] and clean[6] == "server address <IP> is up"


def test_second_round_finds_what_seeds_alone_do_not(spark):
    """Seeds make "reach me at" trusted; what it finds makes "dial" trusted, which no seed stands beside; "serial" and "total" stay out."""
    texts = [f"you can reach me at +1 (20{i}) 555-777{i} any time" for i in range(8)]
    bare = [f"(20{i}) 666-888{i}" for i in range(4)]
    texts += [f"or reach me at {b} any time" for b in bare] + [f"so dial {b} tonight please" for b in bare]
    texts += ["so dial 5559876543 tonight please", "serial 5559876543 was made", *(f"total 55512{i}6543 units sold" for i in range(9))]
    texts += [f"server lists 10.1.2.{i} as up" for i in range(4)] + ["server lists 10.1.2.9:8080 as up", "write to joe [at] mail.org soon", *(f"write to a{i}@mail.org soon" for i in range(4))]
    texts.append("reach me at 212" + " 555" * 400 + " any time")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_personal_data(df)
    got = {r["doc_id"]: [tuple(x.split(":")) for x in r["spans"].split(",") if x] for r in found.collect()}
    spans = {i: [(k, texts[i][int(a) : int(b)]) for k, a, b in v] for i, v in got.items()}
    for i, b in enumerate(bare):
        assert spans[8 + i] == [("phone", b)] and spans[12 + i] == [("phone", b)]
    assert spans[16] == [("phone", "5559876543")] and spans[17] == []
    assert all(spans[i] == [] for i in range(18, 27))
    assert spans[31] == [("ip", "10.1.2.9")] or spans[31] == [("ip", "10.1.2.9:8080")]
    assert spans[32] == [("email", "joe [at] mail.org")]
    assert spans[37] == []


def brute_scores(edges):
    own = {(i, k): float(kind == k) for _, i, kind, _, _ in edges for k in pii.KINDS}
    before = None
    while True:
        p = {}
        for pat in {e[0] for e in edges}:
            rows = [e for e in edges if e[0] == pat]
            for k in pii.KINDS:
                if sum(own[e[1], k] >= pii.MIN_CONFIDENCE for e in rows) >= pii.MIN_SEEDS:
                    p[pat, k] = sum(e[4] * own[e[1], k] for e in rows) / sum(e[4] for e in rows)
        c = {}
        for inst, fits in {(e[1], tuple(e[3])) for e in edges if e[2] is None}:
            for k in pii.KINDS:
                miss = 1.0
                for e in edges:
                    if e[1] == inst and k in fits:
                        miss *= 1 - min(p.get((e[0], k), 0.0), 0.999)
                c[inst, k] = 1 - miss
        total = sum(c.values())
        if before is not None and total - before <= pii.SETTLED:
            break
        before = total
        own.update(c)
    return p, c


def test_graph_scores_equal_brute_force(spark):
    rnd = random.Random(3)
    edges = {}
    for _ in range(160):
        i = rnd.randint(0, 40)
        kind = pii.KINDS[i % 4] if i < 25 else None
        edges[f"p{rnd.randint(0, 12)}", f"i{i}"] = (kind, [kind] if kind else [pii.KINDS[i % 4], pii.KINDS[(i + 1) % 4]], rnd.randint(1, 4))
    rows = [(p, i, *v) for (p, i), v in edges.items()]
    patterns, found = pii.score_graph(spark.createDataFrame(rows, "pattern string, instance string, kind string, fits array<string>, weight long"))
    p, c = brute_scores(rows)
    got = {(r["pattern"], k): r[f"p_{k}"] for r in patterns.collect() for k in pii.KINDS}
    assert all(abs(got.get(x, 0.0) - v) < 1e-6 for x, v in p.items()) and all(abs(p.get(x, 0.0) - v) < 1e-6 for x, v in got.items())
    got = {(r["instance"], k): r[f"c_{k}"] for r in found.collect() for k in pii.KINDS}
    assert all(abs(got.get(x, 0.0) - v) < 1e-6 for x, v in c.items())


def test_discovery_goes_on_until_nothing_moves(spark):
    """Each level's patterns are found by the level before, so fifteen levels take more than fifteen rounds."""
    levels = 15
    rows = [(f"p{n}", f"i{n}-{j}", "phone" if n == 0 else None, ["phone"], 100) for n in range(levels) for j in range(3)]
    rows += [(f"p{n}", f"i{n + 1}-{j}", None, ["phone"], 1) for n in range(levels - 1) for j in range(3)]
    _, found = pii.score_graph(spark.createDataFrame(rows, "pattern string, instance string, kind string, fits array<string>, weight long"))
    got = {r["instance"]: r["c_phone"] for r in found.collect()}
    assert len(got) == 3 * (levels - 1) and all(c >= pii.MIN_CONFIDENCE for c in got.values())


def test_contexts_are_whole_words_and_spans_any_length():
    t = "x" * 500 + " Call: " + "1 " * 8 + "(now) please"
    (a, b, span, kinds), *_ = pii.candidates(t, [])
    assert span == "1 1 1 1 1 1 1 1" and kinds == ["phone"]
    assert pii.Context(t).patterns(a, b) == ["< call", "< " + "x" * 500 + " call", "> now", "> now please", "<> call now"]
    assert pii.candidates("a" * 5000 + "@b", [])[0][2] == "a" * 5000 + "@b"
    assert pii.candidates("1234567", [("card", 2, 4)]) == []
