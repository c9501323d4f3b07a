"""Seeded draws, weighted samples, drawn agents, and nets whose modifiers are all 0."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from loomgraph.functions.numeric import uniform, uniform_sql
from loomgraph.operators import surveys as S
from loomgraph.operators.inference import boolean_step, continuous_step


def test_draws_are_the_first_52_bits_of_md5(spark):
    rows = [("a", 1), ("", 2), (None, 3), ("é" * 5000, None)]
    got = spark.createDataFrame(rows, "k string, n int").select("k", "n", uniform(F.lit("x"), F.col("k"), F.col("n")).alias("u")).collect()
    for r in got:
        text = "\x1f".join(str(v) for v in ("x", r.k, r.n) if v is not None)
        assert r.u == int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r.u == duckdb.execute(f"SELECT {uniform_sql(chr(39) + 'x' + chr(39), 'k', 'n')} FROM (SELECT ?::VARCHAR AS k, ?::INT AS n)", [r.k, r.n]).fetchone()[0]
        assert 0 <= r.u < 1


def test_parents_without_weight_count_alike():
    assert abs(boolean_step([(1, 0.0, 0.0), (2, 0.0, 0.0)], {1: 0.2, 2: 0.6}) - 0.4) < 1e-12
    assert continuous_step([(1, 0.0, 0.0), (2, 0.0, 0.0)], {1: 0.2, 2: 0.6}) == 0.5


def test_weighted_samples_are_as_likely_as_their_weights(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0, 4.0, 8.0, 0.0, -1.0][i % 6]) for i in range(600)] + [(9000, None)], "id long, w double")
    first, second = {}, {}
    for seed in range(30):
        for r in S.weighted_sample(rows, 40, "w", "id", seed=seed).collect():
            first[r["w"]] = first.get(r["w"], 0) + 1
            second[seed] = second.get(seed, set()) | {r["rank"]}
    assert all(v == set(range(1, 41)) for v in second.values()) and set(first) == {1.0, 2.0, 4.0, 8.0}
    # 40 of 400 rows leave the shares near those of the weights
    assert all(abs(first[w] / 1200 - w / 15) < 0.05 for w in first)


def test_weighted_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumns({"w": F.col("id") % 7 + 1, "grp": F.col("id") % 3})
    pick = lambda df, **o: sorted(tuple(r) for r in S.weighted_sample(df, 9, "w", "id", **o).select("id", "rank").collect())
    assert pick(rows.repartition(7)) == pick(rows.coalesce(1)) and pick(rows.repartition(7), by="grp") == pick(rows.coalesce(1), by="grp")
    assert len(pick(rows, by="grp")) == 27 and len(pick(rows.limit(4))) == 4 and pick(rows.limit(0)) == []


def test_drawn_agents(spark):
    bounds = {"north": 2.0, "south": 1.0, "east": 4.0, "west": 3.0}
    rows = S.drawn_agents(spark.range(4000), bounds, {"job": ["a", "b"]}, "id").collect()
    assert all(1 <= r["lat"] <= 2 and 3 <= r["lng"] <= 4 and 18 <= r["age"] <= 85 for r in rows)
    for low, high, w in S.AGE_RANGES:
        assert abs(sum(low <= r["age"] <= high for r in rows) / 4000 - w) < 0.03
    assert abs(sum(r["job"] == "a" for r in rows) / 4000 - 0.5) < 0.04 and len({r["lat"] for r in rows}) > 3900
