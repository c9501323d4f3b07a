"""The pipeline against stage decisions made by brute force on a small table."""

import random

import corpus_pipeline
from loomgraph.llm import toxicity
from loomgraph.llm.common import in_training
from pyspark.sql import functions as F


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices(["th", "er", "on", "an", "re", "ing"], k=rnd.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(rnd.randint(60, 120)) for _ in range(400)]
    toxic = [int(i % 5 == 0) for i in range(400)]
    for i in range(0, 400, 5):
        ws = texts[i].split()
        for _ in range(4):
            ws.insert(rnd.randrange(len(ws)), rnd.choice(["blockhead", "numskull", "lowlife"]))
        texts[i] = " ".join(ws)
    item = text(20)
    texts += [texts[3], texts[3].upper(), texts[4] + " x", text(30) + " " + item + " " + text(30), "Mail joe.doe@example.com or " + text(40), None, ""]
    rows = [(i, t, "en", None if i % 50 == 0 else "s", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, y) for i, y in enumerate(toxic)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), in_training(F.col("doc_id"), 3, 1))
    kept = [r for r in rows if toxicity.score_text(r[1], model) < toxicity.THRESHOLD]
    assert sum(toxic[r[0]] for r in kept if r[0] < 400) <= 4 and sum(r[0] < 400 for r in kept) >= 315
    def shingles(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = {r[0]: shingles(r[1]) for r in kept}
    comp = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    kept = [r for r in kept if comp[r[0]] == r[0] and item not in (r[1] or "")]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert sorted(got) == [r[0] for r in kept]
    assert {400, 401, 403}.isdisjoint(got) and 404 in got
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.where("doc_id = 404").first()["text"].startswith("Mail <EMAIL> or ")
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
