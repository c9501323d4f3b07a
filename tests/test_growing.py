"""Graphs that grow by questions and answers: a table against a walk in Python, streams in any order against the table, gaps and late rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.streaming import growing

NAMES = ["questions", "late", "edge", "src", "dst", "src_label", "dst_label", "confidence", "modifier"]
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def normal(label):
    return " ".join(label.lower().replace("_", " ").split())


def walk(rows):
    """{chat: set of edges} by adding and merging as the questions come."""
    out = {}
    for chat in {r[0] for r in rows}:
        nodes, edges, n, number = {}, {}, 0, 0
        for _, _, _, relations in sorted((r for r in rows if r[0] == chat), key=lambda r: r[1]):
            number += 1
            for source, target, confidence, positive in relations or []:
                if source != target:
                    n += 1
                    nodes[2 * n - 1], nodes[2 * n] = source, target
                    edges[n] = (2 * n - 1, 2 * n, confidence, confidence if positive else -confidence)
            if number % 3 == 0:
                first = {}
                to = {k: first.setdefault(normal(nodes[k]), k) for k in sorted(nodes)}
                edges = {k: (to[s], to[d], c, m) for k, (s, d, c, m) in edges.items() if to[s] != to[d]}
                nodes = {k: v for k, v in nodes.items() if to[k] == k}
        out[chat] = {(number, 0, k, s, d, nodes[s], nodes[d], c, m) for k, (s, d, c, m) in edges.items()} or {(number, 0, *[None] * 7)}
    return out


def as_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["chat_id"], set()).add(tuple(r[n] for n in NAMES))
    return out


def dialogues(seed, chats=6, most=9):
    rnd = random.Random(seed)
    label = lambda: rnd.choice(["Rent", "rent", "noise_level", "Noise level", "height", "cost", "transit"])
    rows = []
    for c in range(chats):
        for turn in range(1, rnd.randint(1, most) + 1):
            relations = [(label(), label(), rnd.randint(1, 9) / 10, rnd.random() < 0.6) for _ in range(rnd.randint(0, 3))]
            rows.append((f"chat{c}", turn, START + datetime.timedelta(minutes=turn), relations))
    rows.append(("silent", 1, START, None))
    rows.append(("loops", 1, START, [("a", "a", 0.5, True)]))
    return rows


def replay(spark, tmp_path, batches, delay="10 days"):
    """Writes a file for each batch, one after the other, and lets the stream take one at a time."""
    source = tmp_path / "in"
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, growing.QA).coalesce(1).write.mode("append").parquet(str(source))
        query = growing.keep_latest(spark.readStream.schema(growing.QA).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "state"), delay)
        assert query.awaitTermination(120) and query.exception() is None
        replay.dropped = (0 if n == 0 else replay.dropped) + growing.dropped(query)
    return growing.latest(spark.read.parquet(str(tmp_path / "out")))


def test_table_equals_walk(spark):
    for seed in (1, 2, 3):
        rows = dialogues(seed)
        assert as_sets(growing.grown(spark.createDataFrame(rows, growing.QA).repartition(3))) == walk(rows)


def test_odd_rows_of_a_table(spark):
    rows = [("c", 1, START, [("a", "b", 0.5, True), (None, "b", 0.5, True), ("a", None, 0.5, True)]), ("c", 1, START + datetime.timedelta(1), [("x", "y", 0.5, True)]), (None, 1, START, None), ("d", None, START, None)]
    got = as_sets(growing.grown(spark.createDataFrame(rows, growing.QA)))
    assert got == {"c": {(1, 1, 1, 1, 2, "a", "b", 0.5, 0.5)}}
    assert growing.grown(spark.createDataFrame([], growing.QA)).count() == 0


def test_repeated_turns_are_late_and_rows_move_once(spark):
    later = START + datetime.timedelta(1)
    rows = [("c", 2, later, [("p", "q", 0.1, True)]), ("c", 2, START, [("a", "b", 0.2, False)]), ("c", 2, None, [("x", "x", 0.3, True), ("x", "y", None, True)]), ("c", 5, START, None), ("c", 9, START, [("Y", "x", 0.4, None)]), ("d", 1, START, [("a", "A_", 0.5, True)]), ("d", 2, START, None), ("d", 3, START, None), ("d", 3, START, None)]
    made = growing.grown(spark.createDataFrame(rows, growing.QA))
    assert as_sets(made) == {"c": {(3, 2, 1, 1, 2, "x", "y", None, None), (3, 2, 2, 2, 1, "y", "x", 0.4, -0.4)}, "d": {(3, 1, *[None] * 7)}}
    assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_in_any_order_equals_table(rocks, tmp_path, seed):
    rows = dialogues(4, chats=4)
    shuffled = random.Random(seed).sample(rows, len(rows))
    cut = len(rows) // 3
    got = replay(rocks, tmp_path, [shuffled[:cut], shuffled[cut : 2 * cut], shuffled[2 * cut :]])
    assert as_sets(got) == walk(rows) and replay.dropped == 0


def test_gaps_and_late_rows(rocks, tmp_path):
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    say = lambda chat, turn, minutes, a, b: (chat, turn, at(minutes), [(a, b, 0.5, True)])
    batches = [
        # turn 2 is missing, so 3 and 4 wait
        [say("c", 1, 1, "a", "b"), say("c", 3, 3, "B", "c"), say("c", 4, 4, "c", "d"), say("other", 1, 1, "x", "y")],
        # the watermark passes them; they are applied without turn 2, and the third question merges
        [say("other", 2, 120, "y", "z")],
        # too late: before the watermark, and a turn that is past
        [say("c", 2, 2, "late", "row"), say("c", 3, 200, "again", "late"), say("other", 3, 200, "z", "x")],
    ]
    got = as_sets(replay(rocks, tmp_path, batches, "10 minutes"))
    assert got["c"] == {(3, 1, 1, 1, 2, "a", "b", 0.5, 0.5), (3, 1, 2, 2, 4, "b", "c", 0.5, 0.5), (3, 1, 3, 4, 6, "c", "d", 0.5, 0.5)}
    assert replay.dropped == 1
    assert {e[2:5] for e in got["other"]} == {(1, 1, 2), (2, 2, 4), (3, 4, 1)}


def test_state_survives_a_restart_between_batches(rocks, tmp_path):
    rows = [("c", t, START + datetime.timedelta(minutes=t), [("a", f"b{t % 2}", 0.5, True)]) for t in range(1, 7)]
    got = replay(rocks, tmp_path, [[r] for r in rows])
    assert as_sets(got) == walk(rows)
    assert rocks.read.parquet(str(tmp_path / "out")).where(F.col("questions") == 3).select("src").distinct().count() == 1
