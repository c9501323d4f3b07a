"""Pairs and best rows of vectors against brute force, over several tiles, with copies and odd vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import similarity as S


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a + b:
        return None
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else None


def odd_vectors():
    rnd = random.Random(3)
    rows = {n: [rnd.choice((-1.0, 0.0, 1.0, 0.5)) for _ in range(4)] for n in range(80)}
    rows |= {n: rows[n % 3] for n in range(80, 100)}
    return rows | {100: None, 101: [0.0] * 4, 102: [1.0, None, 0.0, 1.0], 103: [1.0, 2.0], 104: [2.0, 4.0], 105: []}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, v array<double>")


@pytest.fixture
def small_tiles(monkeypatch):
    for name in ("PAIR_TILE", "QUERY_TILE", "ROW_TILE"):
        monkeypatch.setattr(S, name, 16)


def no_cross_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "zip_with" not in plan


def test_similar_vectors_equal_brute_force(spark, small_tiles):
    rows = odd_vectors()
    found = S.similar_vectors(frame(spark, rows), "id", "v", 0.7, F.col("id") % 2)
    want = {(a, b): c for a in rows for b in rows if a < b and a % 2 == b % 2 and (c := cosine(rows[a], rows[b])) is not None and c >= 0.7}
    assert no_cross_join(found)
    got = found.collect()
    assert len(got) == len(want) and {(r.a, r.b): r.cosine for r in got} == want


@pytest.mark.parametrize("k", [3, 200])
def test_best_vectors_equal_brute_force(spark, small_tiles, k):
    rows = odd_vectors()
    asked = {n: v for n, v in rows.items() if n % 4 == 0 or n > 99}
    found = S.best_vectors(frame(spark, asked), frame(spark, rows), "id", "v", k)
    want = {}
    for q, v in asked.items():
        scored = sorted((((c := cosine(v, w)) is None, -(c or 0.0), n, c) for n, w in rows.items() if n != q))[:k]
        want |= {(q, n): (c, i + 1) for i, (*_, n, c) in enumerate(scored)}
    assert no_cross_join(found)
    got = found.collect()
    assert len(got) == len(want) and {(r.q, r.id): (r.cosine, r["rank"]) for r in got} == want


def test_texts_as_keys_and_no_rows(spark):
    rows = {f"k{n}": v for n, v in odd_vectors().items() if n < 20}
    df = spark.createDataFrame(list(rows.items()), "id string, v array<float>")
    assert {(r.a, r.b) for r in S.similar_vectors(df, "id", "v", 0.7).collect()} == {(a, b) for a in rows for b in rows if a < b and (cosine(rows[a], rows[b]) or 0) >= 0.7}
    assert S.best_vectors(df.limit(0), df, "id", "v").count() == 0 and S.best_vectors(df, df.limit(0), "id", "v").count() == 0
