"""Belief graphs that grow by questions and answers, with similar nodes merged after every third one.

A row is a question and answer of a dialogue: chat_id, turn (1, 2, ... within the dialogue), ts, and relations, an array of
(source, target, confidence, positive). Each relation whose ends differ adds two fresh nodes and an edge, whose modifier is the
confidence, negative where the influence is. After every third question the nodes with one normal label become the first of them,
edges move along, and edges that then begin and end in one node go. The questions after the last merge keep their fresh nodes.

``grown`` makes the graphs of a whole table by joins and windows. ``growing`` makes them of a stream, in any order of arrival: a
state for each dialogue holds what came too early, and applies it in the order of the turns. A turn that is missing is given up
once the watermark has passed a later one; rows that come after that are counted in late, those that the watermark itself drops
in the query's progress (``dropped``).

Defined cases: null relations count as none, and the question still counts towards the third; a relation with a null end is left
out; of repeated turns the first to arrive counts in a stream and the smallest row in a table, the others are late; a dialogue
without edges has one row with nulls; rows without chat or turn are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import normal_label
from ..operators.dialogue import MERGE_EVERY

QA = "chat_id string, turn int, ts timestamp, relations array<struct<source:string,target:string,confidence:double,positive:boolean>>"
GRAPH = "chat_id string, questions long, late long, edge long, src long, dst long, src_label string, dst_label string, confidence double, modifier double"


def _kept(relations: Column) -> Column:
    """The relations that make an edge."""
    return F.filter(F.coalesce(relations, F.array()), lambda r: r["source"] != r["target"])


def _placed(qa: DataFrame) -> DataFrame:
    return qa.where("chat_id IS NOT NULL AND turn IS NOT NULL")


def grown(qa: DataFrame, every: int = MERGE_EVERY) -> DataFrame:
    """The graphs (columns as GRAPH) after all rows of a table.

    Every step is a window or a group within a dialogue, so rows move once, and not at all where the table is dealt by dialogue.
    """
    chat = W.partitionBy("chat_id")
    # the first row of a turn is the one that stands where the turn begins
    placed = _placed(qa).withColumn("place", F.row_number().over(chat.orderBy("turn", "ts", "relations")))
    by_turn = chat.orderBy("turn")
    ranked = placed.withColumns({"begins": F.rank().over(by_turn), "number": F.dense_rank().over(by_turn).cast("long")})
    counted = ranked.withColumns({"questions": F.max("number").over(chat), "rows": F.count("*").over(chat)}).where("place = begins")
    merged = (F.col("number") <= F.col("questions") - F.col("questions") % every).alias("merged")
    kept = _kept(F.col("relations"))
    # a null before the first question's relations, edge 0, stands for the dialogue where no edge remains
    listed = F.when(F.col("number") == 1, F.concat(F.array(F.lit(None)), kept)).otherwise(kept)
    exploded = counted.select("chat_id", "turn", "questions", (F.col("rows") - F.col("questions")).alias("late"), merged, F.posexplode(listed).alias("at", "r"))
    edges = exploded.withColumn("edge", F.row_number().over(chat.orderBy("turn", "at")).cast("long") - 1)
    sign = F.when(F.col("r.positive"), F.col("r.confidence")).otherwise(-F.col("r.confidence"))
    ends = edges.select("chat_id", "questions", "late", "edge", "merged", "r.confidence", sign.alias("modifier"), F.posexplode(F.array("r.source", "r.target")).alias("end", "label")).withColumn("node", 2 * F.col("edge") - 1 + F.col("end"))
    alike = W.partitionBy("chat_id", "merged", F.when(F.col("merged") & (F.col("edge") > 0), normal_label(F.col("label"))).otherwise(F.col("node").cast("string")))
    named = ends.withColumns({"id": F.min("node").over(alike), "name": F.min_by("label", "node").over(alike)})
    side = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c)))
    once = ("questions", "late", "confidence", "modifier")
    found = named.groupBy("chat_id", "edge").agg(*(F.max(c).alias(c) for c in once), *(side(e, c).alias(f"{name}{suffix}") for e, name in ((0, "src"), (1, "dst")) for c, suffix in (("id", ""), ("name", "_label"))))
    stays = (F.col("edge") > 0) & (F.col("src") != F.col("dst"))
    remain = found.withColumn("remain", F.count(F.when(stays, 1)).over(chat)).where(stays | ((F.col("edge") == 0) & (F.col("remain") == 0)))
    real = lambda c: F.when(F.col("edge") > 0, F.col(c)).alias(c)
    names = [x.split()[0] for x in GRAPH.split(", ")]
    return remain.select(*(c if c in ("chat_id", "questions", "late") else real(c) for c in names))


class Growth(StatefulProcessor):
    """The state of one dialogue: counters, nodes, edges, and the questions that wait for earlier ones."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # questions applied, turn expected next, late rows, edges made
        self.counters = handle.getValueState("counters", "questions long, next long, late long, edges long")
        self.nodes = handle.getMapState("nodes", "node long", "label string, alike string")
        self.edges = handle.getMapState("edges", "edge long", "src long, dst long, confidence double, modifier double")
        self.waiting = handle.getMapState("waiting", "turn long", "ts long, relations string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        questions, expected, late, made = self.counters.get() if self.counters.exists() else (0, 1, 0, 0)
        now = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for turn, ts, relations in sorted(zip(frame["turn"].tolist(), frame["ms"].tolist(), frame["body"].tolist(), strict=True)):
                if turn < expected or self.waiting.containsKey((turn,)):
                    late += 1
                    continue
                self.waiting.updateValue((turn,), (ts, relations))
        questions, expected, made = self._apply(questions, expected, made)
        for (turn,) in list(self.waiting.keys()):
            # when the watermark is past this row, nothing before it will come
            self.handle.registerTimer(max(self.waiting.getValue((turn,))[0], now) + 1)
        self.counters.update((questions, expected, late, made))
        yield self._graph(key, questions, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        questions, expected, late, made = self.counters.get()
        before = questions
        while passed := [t for (t,) in self.waiting.keys() if self.waiting.getValue((t,))[0] < expiredTimerInfo.getExpiryTimeInMs()]:
            expected = min(t for (t,) in self.waiting.keys() if t <= min(passed))
            questions, expected, made = self._apply(questions, expected, made)
        self.counters.update((questions, expected, late, made))
        if questions > before:
            yield self._graph(key, questions, late)

    def close(self) -> None:
        pass

    def _apply(self, questions: int, expected: int, made: int) -> tuple[int, int, int]:
        """Applies what waits, as far as no turn is missing."""
        while self.waiting.containsKey((expected,)):
            relations = json.loads(self.waiting.getValue((expected,))[1])
            self.waiting.removeKey((expected,))
            expected += 1
            questions += 1
            for r in relations:
                made += 1
                confidence = r.get("confidence")
                for node, label, alike in ((2 * made - 1, r["source"], r["source_key"]), (2 * made, r["target"], r["target_key"])):
                    self.nodes.updateValue((node,), (label, alike))
                modifier = None if confidence is None else confidence if r.get("positive") else -confidence
                self.edges.updateValue((made,), (2 * made - 1, 2 * made, confidence, modifier))
            if questions % self.every == 0:
                self._merge()
        return questions, expected, made

    def _merge(self) -> None:
        first: dict = {}
        moved: dict = {}
        for node, alike in sorted((k[0], v[1]) for k, v in self.nodes.iterator()):
            if first.setdefault(alike, node) != node:
                moved[node] = first[alike]
        for edge, (src, dst, *rest) in [(k, v) for k, v in self.edges.iterator()]:
            ends = moved.get(src, src), moved.get(dst, dst)
            if ends[0] == ends[1]:
                self.edges.removeKey(edge)
            elif ends != (src, dst):
                self.edges.updateValue(edge, (*ends, *rest))
        for node in moved:
            self.nodes.removeKey((node,))

    def _graph(self, key, questions: int, late: int):
        import pandas as pd

        label = {k[0]: v[0] for k, v in self.nodes.iterator()}
        rows = [(key[0], questions, late, k[0], s, d, label[s], label[d], c, m) for k, (s, d, c, m) in self.edges.iterator()]
        frame = pd.DataFrame(rows or [(key[0], questions, late, *[None] * 7)], columns=[x.split()[0] for x in GRAPH.split(", ")])
        return frame.astype({c: "Int64" for c in ("questions", "late", "edge", "src", "dst")})


def growing(stream: DataFrame, delay: str = "1 hour", every: int = MERGE_EVERY) -> DataFrame:
    """A stream of graphs: each micro-batch gives the whole graph (columns as GRAPH) of every dialogue that it changed.

    The session must keep states in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    relation = lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), normal_label(r["source"]).alias("source_key"), normal_label(r["target"]).alias("target_key"), r["confidence"].alias("confidence"), r["positive"].alias("positive"))
    body = F.to_json(F.transform(_kept(F.col("relations")), relation))
    rows = _placed(stream).withWatermark("ts", delay).select("chat_id", F.col("turn").cast("long").alias("turn"), "ts", F.unix_millis(F.coalesce("ts", F.lit(0).cast("timestamp"))).alias("ms"), body.alias("body"))
    return rows.groupBy("chat_id").transformWithStateInPandas(statefulProcessor=Growth(every), outputStructType=GRAPH, outputMode="Update", timeMode="EventTime")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", every: int = MERGE_EVERY) -> StreamingQuery:
    """Runs ``growing`` over what is there now and keeps every batch's graphs in a folder of its own, which a repeated batch overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return growing(stream, delay, every).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(batches: DataFrame) -> DataFrame:
    """Of the graphs that ``keep_latest`` has written each dialogue's last."""
    names = [x.split()[0] for x in GRAPH.split(", ")]
    newest = batches.groupBy("chat_id").agg(F.max("batch").alias("batch"))
    # one batch may hold a dialogue twice, after its rows and after a timer
    of_batch = batches.join(newest, ["chat_id", "batch"], "left_semi")
    most = of_batch.groupBy("chat_id").agg(F.max("questions").alias("questions"))
    return of_batch.join(most, ["chat_id", "questions"], "left_semi").select(*names).distinct()


def dropped(query: StreamingQuery) -> int:
    """Rows that came later than the watermark and never reached a state, as far as the query's progress reaches back."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
