"""Boolean nets on signed graphs: exact inference by variable elimination, and propagation level by level.

A node without parents is true with the prior; any other one with a probability that a rule makes of its parents' values. Two
rules are known: ``mean``, the mean of the parents' tables by strength within [.01, .99], and ``fold``, which starts at .5 and
lets each parent, in the order of the edges, move the probability by (value x weight - .5) / 2 within [.1, .9].

``exact`` and what builds on it hold whole graphs in a task. Graphs of up to STATES_OF nodes are taken many at a time: an array has
a row for each graph and a column for each state of its nodes, and whatever their structure, graphs of one size share a few
operations on arrays. A larger graph is taken by itself, as a table over each node and its parents. Nodes are eliminated in min-fill order, and a second pass back through the order gives every clique's joint distribution, so that all marginals and
all pairs of child and parent come of two passes. Cost grows with two to the power of the widest clique, not of the graph;
nothing is sampled. ``propagate`` instead passes expectations on, with a join for each level, so that a graph may be larger than a
task.

Defined cases: an intervention cuts the node off its parents; evidence of probability v is Jeffrey's rule, v parts of what follows
from true and 1 - v of false; evidence of several nodes is taken in turn, the nodes in order, and so hard values (0 and 1) give the
usual conditional whatever the order; evidence that can't be gives null; a graph with a cycle gives nulls, ``break_cycles`` before
makes it a net; repeated edges count each; rows of targets for nodes that a graph lacks are passed over.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..sources.shared import materialize
from .inference import BOOLEAN_RANGE, ROOT_PRIOR
from .traversal import _rows, graph_batches, rows_batch, walked

FOLD_RANGE, FOLD_START = (0.1, 0.9), 0.5
#: Nodes of the largest graphs whose states are all gone through, and numbers that an array of such graphs may hold.
STATES_OF, CHUNK = 12, 1 << 17


# Local tables


def _mean_table(modifiers, values):
    import numpy as np

    # as cpt, of arrays
    m = np.asarray(modifiers)
    strength = np.abs(m)
    total = strength.sum(axis=0)
    share = np.where(total > 0, strength / np.where(total > 0, total, 1), 1 / len(m))
    low, high = np.where(m > 0, 1 - m, strength), np.where(m > 0, m, 1 - strength)
    return np.clip(sum(w * np.where(v, h, o) for w, v, h, o in zip(share, values, high, low, strict=True)), *BOOLEAN_RANGE)


def _fold_table(modifiers, values):
    import numpy as np

    m, p = np.asarray(modifiers), FOLD_START
    for weight, v in zip(np.where(m < 0, 1 + m, m), values, strict=True):
        p = np.clip(p + (v * weight - 0.5) * 0.5, *FOLD_RANGE)
    return p


#: A rule gives a node's probability in each state from the modifiers of its parents, in the order of the edges, and their values, parent by parent.
RULES = {"mean": _mean_table, "fold": _fold_table}


def factor_of(node, listed: list, rule, prior: float):
    """(nodes, table): the node itself and its distinct parents, and their joint conditional table, an axis for each."""
    import numpy as np

    parents = list(dict.fromkeys(s for s, *_ in listed))
    if not parents:
        return (node,), np.array([1 - prior, prior])
    states = np.indices((2,) * len(parents)).reshape(len(parents), -1)
    p = rule([m for _, m, _ in listed], [states[parents.index(s)] for s, *_ in listed])
    return (node, *parents), np.stack([1 - p, p]).reshape((2,) * (1 + len(parents)))


# Elimination


def min_fill(scopes: list) -> list:
    """Nodes in the order of their elimination, each with the nodes that it is then connected to."""
    nodes = sorted({x for scope in scopes for x in scope})
    place = {x: i for i, x in enumerate(nodes)}
    order = _min_fill(len(nodes), tuple(sorted({tuple(sorted(place[x] for x in scope)) for scope in scopes})))
    return [(nodes[x], tuple(nodes[y] for y in around)) for x, around in order]


@functools.lru_cache(maxsize=50_000)
def _min_fill(n: int, scopes: tuple) -> list:
    """The order for nodes 0 to n - 1, whose neighbours are bits of an integer; many small graphs are of one structure."""
    near = [0] * n
    for scope in scopes:
        bits = sum(1 << x for x in scope)
        for x in scope:
            near[x] |= bits
    near = [around & ~(1 << x) for x, around in enumerate(near)]
    members = lambda bits: [y for y in range(n) if bits >> y & 1]
    score: dict = {}
    left, out = set(range(n)), []
    while left:
        for x in left - score.keys():
            score[x] = sum((near[x] & ~near[y]).bit_count() - 1 for y in members(near[x])), near[x].bit_count(), x
        x = min(left, key=score.__getitem__)
        left.discard(x)
        around = members(near[x])
        changed = near[x]
        for y in around:
            near[y] = (near[y] | near[x]) & ~(1 << x) & ~(1 << y)
            changed |= near[y]
        for y in members(changed):
            score.pop(y, None)
        out.append((x, tuple(around)))
    return out


def _aligned(scope: tuple, table, clique: tuple):
    """The table with the clique's axes, of length 1 where its scope lacks them."""
    order = sorted(range(len(scope)), key=lambda i: clique.index(scope[i]))
    return table.transpose(order).reshape([2 if x in scope else 1 for x in clique])


def _summed(clique: tuple, table, kept: tuple):
    """The table's sums over all but kept, with the axes in the order of kept."""
    out = table.sum(axis=tuple(i for i, x in enumerate(clique) if x not in kept))
    left = [x for x in clique if x in kept]
    return out.transpose([left.index(x) for x in kept])


def clique_beliefs(factors: list):
    """For each clique its nodes and their joint distribution; None where the factors allow nothing."""
    import numpy as np

    order = min_fill([scope for scope, _ in factors])
    place = {x: i for i, (x, _) in enumerate(order)}
    cliques = [(x, *around) for x, around in order]
    tables = [np.ones((2,) * len(c)) for c in cliques]
    for scope, table in factors:
        i = min(map(place.get, scope))
        tables[i] = tables[i] * _aligned(scope, table, cliques[i])
    above, sent = {}, {}
    for i, (_, around) in enumerate(order):
        total = tables[i].sum()
        if not total > 0:
            return None
        tables[i] = tables[i] / total
        if around:
            above[i] = min(map(place.get, around))
            sent[i] = _summed(cliques[i], tables[i], around)
            tables[above[i]] = tables[above[i]] * _aligned(around, sent[i], cliques[above[i]])
    for i in reversed(range(len(order))):
        if i in above:
            around = order[i][1]
            back = _summed(cliques[above[i]], tables[above[i]], around)
            tables[i] = tables[i] * _aligned(around, np.divide(back, sent[i], out=np.zeros_like(back), where=sent[i] > 0), cliques[i])
            tables[i] = tables[i] / tables[i].sum()
    return list(zip(cliques, tables, strict=True))


def joint(beliefs: list, nodes: tuple):
    """The joint distribution of nodes that stand in one clique."""
    clique, table = next((c, t) for c, t in beliefs if set(nodes) <= set(c))
    return _summed(clique, table, nodes)


def _acyclic(nodes: list, parents: dict) -> bool:
    above = {n: {s for s, *_ in parents.get(n, ())} for n in nodes}
    while free := [n for n, p in above.items() if not p]:
        for n in free:
            del above[n]
        for p in above.values():
            p.difference_update(free)
    return not above


def infer(nodes: list, parents: dict, rule, prior: float, done: dict, seen: dict):
    """Beliefs of a graph under interventions and evidence, or None."""
    import numpy as np

    cut = {n: listed for n, listed in parents.items() if n not in done}
    if not _acyclic(nodes, cut):
        return None
    factors = [factor_of(n, cut.get(n, []), rule, done.get(n, prior)) for n in nodes]
    if seen and all(v in (0, 1) for v in seen.values()):
        # hard values need no beliefs from before, so one pass takes all of them
        return clique_beliefs([*factors, *(((n,), np.array([1.0 - v, v])) for n, v in sorted(seen.items()) if n in nodes)])
    beliefs = clique_beliefs(factors)
    for n in sorted(seen.keys() & set(nodes)):
        if beliefs is None:
            return None
        now, wanted = joint(beliefs, (n,)), np.array([1 - seen[n], seen[n]])
        if (wanted[now <= 0] > 0).any():
            return None
        factors.append(((n,), np.divide(wanted, now, out=np.zeros(2), where=now > 0)))
        beliefs = clique_beliefs(factors)
    return beliefs


# Many small graphs


@dataclasses.dataclass
class Small:
    """Graphs of n nodes each. Edges have the row of their graph and their ends' places among its nodes, targets of either kind likewise."""

    n: int
    graphs: object  # place of each graph in its batch
    nodes: object  # a row for each graph, with the codes of its nodes
    edges: tuple  # row, src, dst, modifier
    done: tuple  # row, node, value
    seen: tuple

    @property
    def bits(self):
        return _bits(self.n)


@functools.cache
def _bits(n: int):
    """The value of each of n nodes, a row each, in each state."""
    import numpy as np

    return (np.arange(1 << n) >> np.arange(n)[:, None] & 1).astype(float)


def _tables(small: Small, rule, prior: float):
    """How likely each node is true in each state: graphs, nodes, states."""
    import numpy as np

    row, src, dst, modifier = small.edges
    bits, n = small.bits, small.n
    p = np.full((len(small.graphs) * n, 1 << n), float(prior))
    child = row * n + dst
    order = np.argsort(child, kind="stable")
    children, first, number = np.unique(child[order], return_index=True, return_counts=True)
    for k in np.unique(number):
        of = number == k
        edge = order[first[of] + np.arange(k)[:, None]]
        p[children[of]] = rule(modifier[edge][:, :, None], (bits[s] for s in src[edge]))
    return p.reshape(-1, n, 1 << n)


def _acyclic_rows(small: Small, cut: bool):
    """Which graphs have no cycle, with or without the edges to nodes of interventions."""
    import numpy as np

    row, src, dst, _ = small.edges
    above = np.zeros((len(small.graphs), small.n), np.int64)
    np.bitwise_or.at(above, (row, dst), 1 << src)
    if cut:
        above[small.done[:2]] = 0
    left = np.full(len(above), (1 << small.n) - 1)
    for _ in range(small.n):
        free = (above & left[:, None]) == 0
        left &= ~(free @ (1 << np.arange(small.n)))
    return left == 0


def _normal(weights):
    """Rows over their sums; NaN where these aren't above 0."""
    import numpy as np

    total = weights.sum(axis=1, keepdims=True)
    return weights / np.where(total > 0, total, np.nan)


def all_states(small: Small, tables, done: bool, seen: bool):
    """The distribution over the states of each graph, under its interventions and evidence if so wanted; NaN where there is none."""
    import numpy as np

    bits = small.bits
    if done:
        row, node, value = small.done
        tables = tables.copy()
        tables[row, node] = value[:, None]
    weights = np.ones((len(small.graphs), 1 << small.n))
    for i, b in enumerate(bits):
        weights *= np.where(b, tables[:, i], 1 - tables[:, i])
    weights = _normal(weights)
    weights[~_acyclic_rows(small, done)] = np.nan
    if seen and len(small.seen[0]):
        row, node, value = small.seen
        # evidence of a graph in turn, by nodes
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        for k in range(turn.max() + 1):
            r, v, b = row[turn == k], value[turn == k], bits[node[turn == k]]
            now = np.stack([(weights[r] * (1 - b)).sum(axis=1), (weights[r] * b).sum(axis=1)])
            wanted = np.stack([1 - v, v])
            factor = np.divide(wanted, now, out=np.zeros_like(now), where=now > 0)
            factor[(now <= 0) & (wanted > 0)] = np.nan
            weights[r] = _normal(weights[r] * np.where(b, factor[1][:, None], factor[0][:, None]))
    return weights


def _last_of(keys):
    """Places of the last of each key, by key."""
    import numpy as np

    found, at = np.unique(keys[::-1], return_index=True)
    return found, len(keys) - 1 - at


def small_graphs(batch, size: int):
    """(names, whole, parts): the codes' nodes, the places of graphs of more than size nodes, and the others as Small, by their sizes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    listed = batch.column("__edges")
    owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
    _, src, dst, modifier, _ = listed.flatten().flatten()
    ends = pa.concat_arrays([src, dst]).dictionary_encode()
    by_name = pc.sort_indices(ends.dictionary).to_numpy()
    names = ends.dictionary.take(pa.array(by_name))
    codes = np.argsort(by_name)[ends.indices.to_numpy(zero_copy_only=False)]
    # nodes of all graphs, by graph and name
    at, ends = np.unique(np.tile(owner, 2) * len(names) + codes, return_inverse=True)
    sizes = np.bincount(at // max(1, len(names)), minlength=batch.num_rows)
    first = np.cumsum(sizes) - sizes
    src, dst = (e - first[owner] for e in ends.reshape(2, -1))
    edges = owner, src, dst, modifier.to_numpy(zero_copy_only=False)
    targets = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))] * 2
    if "__more" in batch.schema.names:
        more = batch.column("__more")
        whose = np.repeat(np.arange(batch.num_rows), pc.fill_null(more.value_lengths(), 0).to_numpy(zero_copy_only=False))
        node, value, fixed = more.flatten().flatten()
        code = pc.fill_null(pc.index_in(node, value_set=names), -1).to_numpy(zero_copy_only=False)
        value, fixed = value.to_numpy(zero_copy_only=False), fixed.to_numpy(zero_copy_only=False)
        for kind in (True, False):
            of = np.flatnonzero((code >= 0) & (fixed == kind))
            key, last = _last_of(whose[of] * len(names) + code[of])
            has = np.isin(key, at)
            of, key = of[last[has]], key[has]
            targets[1 - kind] = whose[of], np.searchsorted(at, key) - first[whose[of]], value[of]

    def parts():
        for n in np.unique(sizes[sizes <= size]):
            every, step = np.flatnonzero(sizes == n), max(1, CHUNK // (int(n) << int(n)))
            for k in range(0, len(every), step):
                graphs = every[k : k + step]
                row = np.full(batch.num_rows, -1)
                row[graphs] = np.arange(len(graphs))

                def of(places, *columns):
                    has = row[places] >= 0  # noqa: B023
                    return row[places[has]], *(c[has] for c in columns)  # noqa: B023

                yield Small(int(n), graphs, at[first[graphs][:, None] + np.arange(n)] % len(names), of(*edges), of(*targets[0]), of(*targets[1]))

    return names, np.flatnonzero(sizes > size), parts()


# Operators on tables


def _targets(edges: DataFrame, do: DataFrame | None, seen: DataFrame | None) -> DataFrame | None:
    """(g, node, value, fixed) of interventions and evidence (g, node, value), nodes of the edges' type; a table that is both is read once."""
    pick = lambda t: t.select("g", F.col("node").try_cast(dict(edges.dtypes)["src"]).alias("node"), F.col("value").cast("double").alias("value")).where("node IS NOT NULL")
    if do is not None and do is seen:
        return pick(do).withColumn("fixed", F.explode(F.array(F.lit(True), F.lit(False))))
    parts = [pick(t).withColumn("fixed", F.lit(fixed)) for t, fixed in ((do, True), (seen, False)) if t is not None]
    return parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def _over_graphs(edges: DataFrame, rule: str, prior: float, do, seen, many, rows, schema: str, cases: tuple = ((True, True),)) -> DataFrame:
    """Each case says whether interventions and whether evidence count in it.

    many(small, weights) gives, for graphs taken together, the place of each row's graph and the other columns of schema, nodes as
    codes (-1: null) and NaN for null. rows(g, nodes, parents, beliefs, done) gives a larger graph's rows. weights and beliefs have an entry for each case.
    """
    table, targeted = RULES[rule], do is not None or seen is not None

    def call(batches, arrow):
        import numpy as np
        import pyarrow as pa

        def column(field, values, names):
            if field.name in ("node", "parent"):
                return names.take(pa.array(values, mask=values < 0)).cast(field.type)
            return pa.array(values, field.type, mask=np.isnan(values))

        for batch in batches:
            names, larger, parts = small_graphs(batch, STATES_OF)
            for small in parts:
                tables = _tables(small, table, prior)
                with np.errstate(invalid="ignore", divide="ignore"):
                    at, *columns = many(small, [all_states(small, tables, *case) for case in cases])
                made = [batch.column("g").take(pa.array(at)), *(column(f, c, names) for f, c in zip(list(arrow)[1:], columns, strict=True))]
                yield pa.RecordBatch.from_arrays(made, schema=arrow)
            if len(larger):
                left, made = batch.take(pa.array(larger)), []
                more = _rows(left.column("__more")) if targeted else itertools.repeat(())
                for g, found, targets in zip(left.column("g").to_pylist(), _rows(left.column("__edges")), more):
                    nodes, parents = walked(found)
                    done, given = ({n: v for n, v, f in targets if f == fixed} for fixed in (True, False))
                    beliefs = [infer(nodes, parents, table, prior, done if d else {}, given if s else {}) for d, s in cases]
                    made += rows(g, nodes, parents, beliefs, done)
                yield rows_batch(made, arrow)

    return graph_batches(edges, call, schema, _targets(edges, do, seen))


def _each_node(small: Small, weights: list):
    import numpy as np

    return np.repeat(small.graphs, small.n), small.nodes.ravel(), *((w @ small.bits.T).ravel() for w in weights)


def _node_rows(g, nodes, parents, beliefs, done):
    for n in nodes:
        yield g, n, *(None if b is None else float(joint(b, (n,))[1]) for b in beliefs)


def _each_parent(small: Small, weights: list):
    """The columns of ``given_parents``: nodes with each distinct parent, then roots."""
    import numpy as np

    (weights,), bits, n = weights, small.bits, small.n
    row, src, dst, _ = small.edges
    cut = np.zeros((len(small.graphs), n), bool)
    cut[small.done[:2]] = True
    open_ = ~cut[row, dst]
    pairs = np.unique((row[open_] * n + dst[open_]) * n + src[open_])
    roots = np.ones(len(small.graphs) * n, bool)
    roots[pairs // n] = False
    child = np.concatenate([pairs // n, np.flatnonzero(roots)])
    row, node, parent = child // n, child % n, np.concatenate([pairs % n, np.full(roots.sum(), -1)])
    p = (weights @ bits.T)[row, node]
    given = []
    for is_so in (1 - bits, bits):
        # how likely each value of the parent is, and that together with the node's being true
        alone = weights[row] * is_so[parent]
        share, both = alone.sum(axis=1), (alone * bits[node]).sum(axis=1)
        given.append(np.where((parent >= 0) & (share > 0), both / share, np.nan))
    return small.graphs[row], small.nodes[row, node], p, np.sqrt(np.maximum(0.0, p * (1 - p))), np.where(parent >= 0, small.nodes[row, parent], -1), *given


def _parent_rows(g, nodes, parents, beliefs, done):
    (beliefs,) = beliefs
    for n in nodes:
        p = None if beliefs is None else float(joint(beliefs, (n,))[1])
        std = None if p is None else max(0.0, p * (1 - p)) ** 0.5
        above = [] if n in done else list(dict.fromkeys(s for s, *_ in parents.get(n, ())))
        for parent in above:
            given = [None, None]
            if beliefs is not None:
                both = joint(beliefs, (parent, n))
                given = [float(pair[1] / pair.sum()) if pair.sum() > 0 else None for pair in both]
            yield g, n, p, std, parent, *given
        if not above:
            yield g, n, p, std, None, None, None


def exact(edges: DataFrame, rule: str = "mean", prior: float = ROOT_PRIOR, do: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(g, node, p): how likely each node is true, with interventions do(g, node, value) and evidence seen(g, node, value)."""
    return _over_graphs(edges, rule, prior, do, seen, _each_node, _node_rows, "g int, node int, p double")


def given_parents(edges: DataFrame, rule: str = "mean", prior: float = ROOT_PRIOR, do: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(g, node, p, std, parent, p_given_0, p_given_1): each node with each distinct parent, one row with a null parent for roots.

    std is that of a draw of the node. p_given_0 and p_given_1 are the node's probability where the parent is false and true, in
    the whole net, so common causes of the two count; null where the parent can't have the value. An intervention makes a root.
    """
    return _over_graphs(edges, rule, prior, do, seen, _each_parent, _parent_rows, "g int, node int, p double, std double, parent int, p_given_0 double, p_given_1 double")


def do_against_see(edges: DataFrame, targets: DataFrame, rule: str = "mean", prior: float = ROOT_PRIOR) -> DataFrame:
    """(g, node, base, done, seen, delta): without targets(g, node, value), with them as interventions, as evidence, and done - seen."""
    cases = (False, False), (True, False), (False, True)
    found = _over_graphs(edges, rule, prior, targets, targets, _each_node, _node_rows, "g int, node int, base double, done double, seen double", cases)
    return found.withColumn("delta", F.col("done") - F.col("seen"))


# Propagation


def fold_step(parents: Column) -> Column:
    """The fold over an array of (ord, p, modifier): each parent's probability stands for its value."""
    weight = lambda x: F.when(x["modifier"] < 0, 1 + x["modifier"]).otherwise(x["modifier"])
    return F.aggregate(parents, F.lit(FOLD_START), lambda p, x: clip(p + (x["p"] * weight(x) - 0.5) * 0.5, *FOLD_RANGE))


def propagate(edges: DataFrame, step=fold_step, prior: float = ROOT_PRIOR, do: DataFrame | None = None) -> DataFrame:
    """(g, node, p): parents' probabilities pass through step, level by level; do(g, node, value) fixes nodes of any level.

    Each round joins the nodes settled last to the edges that still wait, and settles the nodes that wait for no other parent; the
    open edges are dealt by source and by target, never by graph, and go to the shared folder. There are as many rounds as the
    longest path has edges. Nodes on a cycle, or behind one, are never settled and get a null.
    """
    edges = edges.select("g", "src", "dst", "ord", "modifier")
    fixed = (do if do is not None else edges.select("g", F.col("src").alias("node"), F.lit(0.0).alias("value")).limit(0)).select("g", "node", F.col("value").cast("double").alias("p"))
    targets = fixed.select("g", F.col("node").alias("dst"))
    waiting = edges.join(targets, ["g", "dst"], "left_anti").withColumn("p", F.lit(None).cast("double"))
    nodes = materialize(edges.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct(), "net-nodes")
    roots = nodes.join(waiting.select("g", F.col("dst").alias("node")), ["g", "node"], "left_anti")
    settled = [materialize(roots.join(fixed, ["g", "node"], "left").select("g", "node", F.coalesce("p", F.lit(prior)).alias("p")), "net-roots")]
    while True:
        last = settled[-1].select("g", F.col("node").alias("src"), F.col("p").alias("__p"))
        joined = waiting.join(last, ["g", "src"], "left").withColumn("p", F.coalesce("p", "__p")).drop("__p")
        unknown = F.count(F.when(F.col("p").isNull(), 1)).over(W.partitionBy("g", "dst"))
        marked = materialize(joined.withColumn("unknown", unknown), "net-open")
        ready, waiting = marked.where("unknown = 0"), marked.where("unknown > 0").drop("unknown")
        if ready.isEmpty():
            break
        listed = F.sort_array(F.collect_list(F.struct("ord", "p", "modifier")))
        settled.append(ready.groupBy("g", F.col("dst").alias("node")).agg(listed.alias("parents")).select("g", "node", step(F.col("parents")).alias("p")))
    known = functools.reduce(DataFrame.union, settled)
    return nodes.join(known, ["g", "node"], "left")
