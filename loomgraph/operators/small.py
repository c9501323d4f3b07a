"""Motifs of small graphs, each whole in one row: nodes are places in their order, sets of nodes the bits of an integer.

A graph of ``LOCAL_EDGES`` edges at most costs what its stars of three leaves do, and its edges are moved once. ``hubs`` sends the
graphs that are larger through joins instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .traversal import _rows

LOCAL_EDGES = 128


def split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The edges of graphs that fit a row, and those of larger ones, if there are any."""
    sizes = edges.groupBy("g").agg(F.count("*").alias("n"))
    large = materialize(sizes.where((F.col("n") > LOCAL_EDGES) & F.col("g").isNotNull()).select("g"), "large-graphs")
    if large.isEmpty():
        return edges, None
    return edges.join(large, "g", "left_anti"), edges.join(large, "g", "left_semi")


def per_small_graph(edges: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(Graph) gives rows without g; rows of a null g make a graph without edges."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"g {dict(edges.dtypes)['g']}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def call(batches):
        import pyarrow as pa

        for batch in batches:
            made = [(g, *row) for g, pairs in zip(batch.column("g").to_pylist(), _rows(batch.column("pairs")), strict=True) for row in run(Graph(pairs))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(arrow)], schema=arrow)

    known = F.col("g").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    return edges.groupBy("g").agg(F.collect_list(F.when(known, F.struct("src", "dst"))).alias("pairs")).mapInArrow(call, schema)


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Graph:
    """Its nodes in order; out and into are the simple edges by place, near all of them."""

    def __init__(self, pairs: list) -> None:
        edges = set(pairs)
        loops = {s for s, d in edges if s == d}
        self.nodes = sorted({x for e in edges for x in e})
        n, place = len(self.nodes), {x: i for i, x in enumerate(self.nodes)}
        self.out, self.into, self.near = [0] * n, [0] * n, [0] * n
        for s, d in edges:
            if s != d:
                a, b = place[s], place[d]
                self.near[a] |= 1 << b
                self.near[b] |= 1 << a
                if s not in loops and d not in loops and (d, s) not in edges:
                    self.out[a] |= 1 << b
                    self.into[b] |= 1 << a
        #: the later nodes that a node has no edge with
        self.free = [~near & (-2 << a) for a, near in enumerate(self.near)]

    def star_numbers(self, leaves: int) -> tuple[int, int, int]:
        """Sets of 2, 3 and 4 leaves without an edge among them."""
        near, free = self.near, self.free
        if not any(near[a] & leaves for a in _bits(leaves)):
            d = leaves.bit_count()
            return math.comb(d, 2), math.comb(d, 3), math.comb(d, 4)
        n2 = n3 = n4 = 0
        for a in _bits(leaves):
            second = leaves & free[a]
            n2 += second.bit_count()
            for b in _bits(second):
                third = second & free[b]
                n3 += third.bit_count()
                for c in _bits(third):
                    n4 += (third & free[c]).bit_count()
        return n2, n3, n4

    def chain_ends(self, first: int, center: int) -> int:
        return self.out[center] & ~self.near[first] & ~(1 << first)

    def numbers(self) -> Iterator[tuple]:
        """(node, counts by type in the order of TYPES) of every node that is a centre."""
        for c, node in enumerate(self.nodes):
            out, into = self.out[c], self.into[c]
            chains = sum(self.chain_ends(a, c).bit_count() for a in _bits(into)) if out else 0
            found = (chains, *self.star_numbers(out), *self.star_numbers(into))
            if any(found):
                yield node, found

    def sets(self, leaves: int, k: int) -> Iterator[tuple]:
        """Sets of k leaves without an edge among them, in order."""
        for a in _bits(leaves):
            if k == 1:
                yield (a,)
            else:
                for rest in self.sets(leaves & self.free[a], k - 1):
                    yield a, *rest

    def first(self, cap: int, each: int) -> Iterator[tuple]:
        """(motif, center, nodes, rank): the first ``cap`` of each type, of a star's centre ``each`` at most of its largest stars."""
        chains = ((a, c, b) for a in range(len(self.nodes)) for c in _bits(self.out[a]) for b in _bits(self.chain_ends(a, c)))
        for rank, (a, c, b) in enumerate(islice(chains, cap), 1):
            yield "M1", self.nodes[c], [self.nodes[i] for i in (a, c, b)], rank
        for family, sides in (("M2", self.out), ("M3", self.into)):
            had = {2: 0, 3: 0, 4: 0}
            for c, leaves in enumerate(sides):
                k = next((k for k in (4, 3, 2) if next(self.sets(leaves, k), None)), 0)
                for found in islice(self.sets(leaves, k), min(each, cap - had[k])) if k else ():
                    had[k] += 1
                    yield f"{family}.{k - 1}", self.nodes[c], [self.nodes[i] for i in (c, *found)], had[k]
