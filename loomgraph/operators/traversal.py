"""Operators that walk a graph. Graphs are small documents (at most some hundred edges), so each is walked whole by one task.

Every function groups by ``g``; a group is one graph, never a collection of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topological_order(nodes: list, parents: dict) -> list:
    """Parents before children, in the order of nodes where parents allow it; edges that close a cycle are passed over."""
    done: dict = {}
    for root in nodes:
        stack = [(root, iter(parents.get(root, ())))]
        if root in done:
            continue
        done[root] = False
        while stack:
            node, rest = stack[-1]
            for p, *_ in rest:
                if p not in done:
                    done[p] = False
                    stack.append((p, iter(parents.get(p, ()))))
                    break
            else:
                done.pop(node)
                done[node] = True
                stack.pop()
    return [n for n in done if done[n]]


_EDGE = ("ord", "src", "dst", "modifier", "confidence")


def _rows(column):
    """For each list of structs in an Arrow column its structs as tuples; nothing for a null."""
    fields = [f.to_pylist() for f in column.flatten().flatten()]
    at = 0
    for n in column.value_lengths().to_pylist():
        n = n or 0
        yield list(zip(*(f[at : at + n] for f in fields), strict=True))
        at += n


def graph_batches(edges: DataFrame, call, schema: str, more: DataFrame | None = None) -> DataFrame:
    """call(batches, arrow) goes over Arrow batches of graphs (g, __edges, __more) and gives batches of arrow, the schema in Arrow's types.

    __edges are a graph's (ord, src, dst, modifier, confidence) in their order, __more its rows of more(g, ...) without g. In schema,
    g and nodes are of the types that edges(g, src, dst, ord, modifier, confidence) has.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = dict(edges.dtypes)
    for name, kind in (("g", types["g"]), *((n, types["src"]) for n in ("node", "parent", "ancestor", "component"))):
        schema = ", ".join(f"{name} {kind}" if part == f"{name} int" else part for part in schema.split(", "))
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    grouped = edges.groupBy("g").agg(F.sort_array(F.collect_list(F.struct(*_EDGE))).alias("__edges"))
    if more is not None:
        listed = more.groupBy("g").agg(F.collect_list(F.struct(*(c for c in more.columns if c != "g"))).alias("__more"))
        grouped = grouped.join(listed, "g", "left")
    return grouped.mapInArrow(lambda batches: call(batches, arrow), schema)


def walked(edges: list) -> tuple[list, dict]:
    """A graph's nodes, sorted, and the (src, modifier, confidence) of each node's parents, in the order of the edges."""
    parents: dict = {}
    for _, s, d, m, c in edges:
        parents.setdefault(d, []).append((s, m, c))
    return sorted({x for _, s, d, *_ in edges for x in (s, d)}), parents


def rows_batch(made: list, arrow):
    """An Arrow batch of rows as tuples."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(arrow)], schema=arrow)


def per_graph(edges: DataFrame, run, schema: str, more: DataFrame | None = None) -> DataFrame:
    """run(g, nodes, parents) gives rows of schema, with the types that ``graph_batches`` gives it.

    nodes are sorted; parents has the (src, modifier, confidence) of each node, in the order of the edges. Graphs come many at a
    time to one call of Python. run gets the graph's rows of more(g, ...), as tuples without g, as a fourth argument.
    """
    with_more = more is not None

    def call(batches, arrow):
        for batch in batches:
            made = []
            extra = _rows(batch.column("__more")) if with_more else None
            for g, found in zip(batch.column("g").to_pylist(), _rows(batch.column("__edges")), strict=True):
                nodes, parents = walked(found)
                made += run(g, nodes, parents) if extra is None else run(g, nodes, parents, next(extra))
            yield rows_batch(made, arrow)

    return graph_batches(edges, call, schema, more)


def levels(edges: DataFrame) -> DataFrame:
    """(g, node, level): edges of the longest path from a root; a graph with a cycle counts its first order."""

    def run(g, nodes, parents):
        level: dict = {}
        for n in topological_order(nodes, parents):
            level[n] = max((level[p] + 1 for p, *_ in parents.get(n, ()) if p in level), default=0)
            yield g, n, level[n]

    return per_graph(edges, run, "g int, node int, level int")


def ancestors(edges: DataFrame) -> DataFrame:
    """(g, node, ancestor), a node's own row included."""

    def run(g, nodes, parents):
        above: dict = {}
        for n in nodes:
            seen, open_ = {n}, [n]
            while open_:
                for p, *_ in parents.get(open_.pop(), ()):
                    if p not in seen:
                        seen.add(p)
                        open_.append(p)
            above[n] = seen
        for n in nodes:
            for a in sorted(above[n]):
                yield g, n, a

    return per_graph(edges, run, "g int, node int, ancestor int")


def ancestor_graph(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges between ancestors of targets(g, node), the targets among them."""
    kept = ancestors(edges).join(targets, ["g", "node"], "left_semi").select("g", "ancestor").distinct()
    return edges.join(kept.withColumnRenamed("ancestor", "src"), ["g", "src"], "left_semi").join(kept.withColumnRenamed("ancestor", "dst"), ["g", "dst"], "left_semi")


def path_strength(edges: DataFrame) -> DataFrame:
    """(g, node, strength): the largest product of absolute modifiers over paths from a root; 1 for roots."""

    def run(g, nodes, parents):
        s: dict = {}
        for n in topological_order(nodes, parents):
            s[n] = max((abs(m) * s[p] for p, m, _ in parents.get(n, ()) if p in s), default=0.0 if n in parents else 1.0)
            yield g, n, s[n]

    return per_graph(edges, run, "g int, node int, strength double")


def _on_cycle(edges: list) -> list:
    """Those of (src, dst, ...) that lie on a cycle: both ends in one strongly connected component, or a loop."""
    out: dict = {}
    for e in edges:
        out.setdefault(e[0], []).append(e[1])
    reach: dict = {}

    def reachable(a):
        if a not in reach:
            seen, open_ = set(), [a]
            while open_:
                for b in out.get(open_.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        open_.append(b)
            reach[a] = seen
        return reach[a]

    return [e for e in edges if e[0] in reachable(e[1]) or e[0] == e[1]]


def break_cycles(edges: DataFrame) -> DataFrame:
    """Takes out, again and again, the edge of the least confidence (then the first) that lies on a cycle, until there is none."""

    def call(table):
        keep = list(zip(*(table.column(c).to_pylist() for c in ("src", "dst", "confidence", "ord")), range(table.num_rows), strict=True))
        while cyclic := _on_cycle(keep):
            keep.remove(min(cyclic, key=lambda e: (e[2], e[3])))
        return table.take([e[4] for e in keep])

    return edges.groupBy("g").applyInArrow(call, edges.schema)


def is_dag(edges: DataFrame) -> DataFrame:
    """(g, is_dag)."""

    def run(g, nodes, parents):
        yield g, not _on_cycle([(p, n) for n, ps in parents.items() for p, *_ in ps])

    return per_graph(edges, run, "g int, is_dag boolean")


def components(edges: DataFrame) -> DataFrame:
    """(g, node, component): the smallest node that edges of either direction reach."""

    def run(g, nodes, parents):
        root = {n: n for n in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for n, ps in parents.items():
            for p, *_ in ps:
                a, b = sorted((find(n), find(p)))
                root[b] = a
        for n in nodes:
            yield g, n, find(n)

    return per_graph(edges, run, "g int, node int, component int")


def parents_of(edges: DataFrame) -> DataFrame:
    """(g, dst, parents): the parents of each node with their modifiers, in the order of the edges; duplicates stay."""
    listed = edges.groupBy("g", "dst").agg(F.array_sort(F.collect_list(F.struct("ord", "src", "modifier"))).alias("p"))
    return listed.select("g", "dst", F.transform("p", lambda x: F.struct(x["src"].alias("src"), x["modifier"].alias("modifier"))).alias("parents"))
