"""Queries that walk the basket graphs or propagate probabilities on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import inference as I
from ..operators import nets as N
from ..operators import traversal as T
from ..sources.shared import materialize
from .fixtures import ORDER, basket_nodes, order_edges
from .graph_queries import WITH, basket_edges

PRIOR, DO = 0.1, 0.9


def _moved(step):
    def run(spark, d):
        e = basket_edges(spark, d)
        return I.changes(I.marginals(e, step, PRIOR), I.marginals(e, step, PRIOR, do_roots=DO))

    return run


def _first_child(edges, value=DO):
    """(g, node, value): the smallest node with parents of each graph."""
    return edges.groupBy("g").agg(F.min("dst").alias("node")).withColumn("value", F.lit(value))


def _fold(spark, d):
    """Both nets of each graph, with and without the intervention, pass through the levels together."""
    e = basket_edges(spark, d)
    net = lambda done: F.struct("g", F.lit(done).alias("done"))
    both = e.withColumn("g", F.explode(F.array(net(False), net(True))))
    p = materialize(N.propagate(both, do=_first_child(e).withColumn("g", net(True))), "folded")
    of = lambda done: p.where(F.col("g.done") == done).select("g.g", "node", "p")
    return I.changes(of(False), of(True)).select("g", "node", *map(_round, ("base", "changed", "delta")))


def _given_parents(spark, d):
    return N.given_parents(order_edges(spark, d), "mean", PRIOR).select("g", "node", F.col("parent").cast("string").alias("parent"), *map(_round, ("p", "std", "p_given_0", "p_given_1")))


def _do_against_see(spark, d):
    e = order_edges(spark, d)
    return N.do_against_see(e, _first_child(e), "fold").select("g", "node", *map(_round, ("base", "done", "seen", "delta")))


def _conditioned(spark, d):
    """Basket graphs in which the last node, where it has parents, is known to be true."""
    e = basket_edges(spark, d)
    seen = e.groupBy("g").agg(F.max("dst").alias("node")).withColumn("value", F.lit(1.0))
    return N.exact(e, "mean", PRIOR, seen=seen).select("g", "node", _round("p"))


def _cyclic(spark, d):
    """Basket edges with every fifth turned round."""
    back = F.col("ord") % 5 == 0
    return basket_edges(spark, d).withColumns({"src": F.when(back, F.col("dst")).otherwise(F.col("src")), "dst": F.when(back, F.col("src")).otherwise(F.col("dst"))})


def _rounded(name):
    return lambda df: df.withColumn(name, _round(name))


def _round(c):
    """Six digits, a half going up: sums in another order fall on either side of it by some 1e-16, and engines round it differently."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


def _contributions(spark, d):
    return I.contributions(_moved(I.continuous_step)(spark, d)).select("g", "node", F.round("contribution", 6).alias("contribution"), "rank", I.opinion(F.round("changed", 9)).alias("opinion"), I.reason(F.round("contribution", 9)).alias("reason"))


QUERIES = {
    "topological_levels": lambda s, d: T.levels(basket_edges(s, d)),
    "ancestors": lambda s, d: T.ancestors(basket_edges(s, d)),
    "ancestor_graph": lambda s, d: T.ancestor_graph(e := basket_edges(s, d), e.groupBy("g").agg(F.min("dst").alias("node"))).select("g", "src", "dst"),
    "path_strength": lambda s, d: _rounded("strength")(T.path_strength(basket_edges(s, d))),
    "cycles_broken": lambda s, d: T.break_cycles(_cyclic(s, d)).select("g", "src", "dst", "confidence"),
    "is_dag": lambda s, d: T.is_dag(_cyclic(s, d)),
    "graph_components": lambda s, d: T.components(basket_edges(s, d).where("confidence > 0.8")),
    "parents_listed": lambda s, d: T.parents_of(basket_edges(s, d)).select("g", "dst", F.array_join(F.transform("parents", lambda p: p["src"].cast("string")), ",").alias("parents")),
    "net_continuous": lambda s, d: _rounded("p")(I.marginals(basket_edges(s, d), I.continuous_step, PRIOR)),
    "net_boolean": lambda s, d: _rounded("p")(I.marginals(basket_edges(s, d), I.boolean_step, PRIOR)),
    "net_continuous_do": lambda s, d: _moved(I.continuous_step)(s, d).select("g", "node", *map(_round, ("base", "changed", "delta"))),
    "net_boolean_do": lambda s, d: _moved(I.boolean_step)(s, d).select("g", "node", *map(_round, ("base", "changed", "delta"))),
    "net_samples": lambda s, d: I.samples(basket_edges(s, d)),
    "net_conditioned": _conditioned,
    "net_given_parents": _given_parents,
    "net_do_against_see": _do_against_see,
    "net_beta": lambda s, d: I.beta_net(basket_edges(s, d)),
    "net_fold": _fold,
    "contributions": _contributions,
    "interventions_from_question": lambda s, d: I.keyword_interventions(basket_nodes(s, d), "What if trade of nation_3 or nation 12 decreases?"),
    "relation_sentences": lambda s, d: I.relation_sentences(E.label_ends(basket_edges(s, d), basket_nodes(s, d))),
}

_REC = WITH.replace("WITH", "WITH RECURSIVE", 1)
_LEVELS = """, lv(g, node, level) AS (SELECT DISTINCT g, s, 0 FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.g = x.g AND y.t = x.s) UNION SELECT lv.g, e.t, level + 1 FROM lv JOIN e ON e.g = lv.g AND e.s = lv.node)"""
_ANC = """, an(g, node, ancestor) AS (SELECT DISTINCT g, x, x FROM (SELECT g, s AS x FROM e UNION SELECT g, t FROM e) UNION SELECT an.g, node, e.s FROM an JOIN e ON e.g = an.g AND e.t = ancestor)"""
_CONTINUOUS = """CASE WHEN len(ps) = 1 THEN greatest(0.05, least(0.95, 1 / (1 + exp(-2 * (2 * state[ps[1].s + 1] - 1) * ps[1].m))))
  ELSE greatest(0.05, least(0.95, 1 / (1 + exp(-10 * list_sum(list_transform(ps, lambda x: abs(x.m) * (2 * state[x.s + 1] - 1) * x.m)) / list_sum(list_transform(ps, lambda x: abs(x.m))))))) END"""
_TABLE = "CASE WHEN x.m > 0 THEN (1 - state[x.s + 1]) * (1 - x.m) + state[x.s + 1] * x.m ELSE (1 - state[x.s + 1]) * abs(x.m) + state[x.s + 1] * (1 - abs(x.m)) END"
_TOTAL = "list_sum(list_transform(ps, lambda x: abs(x.m)))"
# parents whose modifiers are all 0 count alike
_BOOLEAN = f"greatest(0.01, least(0.99, CASE WHEN {_TOTAL} = 0 THEN list_avg(list_transform(ps, lambda x: {_TABLE})) ELSE list_sum(list_transform(ps, lambda x: abs(x.m) * {_TABLE})) / {_TOTAL} END))"


def _net(step: str, name: str, do: bool, root: str | None = None) -> str:
    """Node by node, as sources have the smaller keys; a graph's state is the list of the probabilities so far."""
    root = root or (f"CASE WHEN i = fr THEN {DO}::DOUBLE ELSE {PRIOR}::DOUBLE END" if do else f"{PRIOR}::DOUBLE")
    return f""", {name}_st(g, fr, i, state) AS (SELECT g, fr, 0, []::DOUBLE[] FROM first_root UNION ALL SELECT st.g, fr, i + 1, list_append(state, CASE WHEN ps IS NULL THEN {root} ELSE {step} END)
  FROM {name}_st st LEFT JOIN par ON par.g = st.g AND par.t = st.i WHERE i < 25),
{name} AS (SELECT st.g, node, state[node + 1] AS p FROM {name}_st st JOIN (SELECT DISTINCT g, x AS node FROM (SELECT g, s AS x FROM e UNION SELECT g, t FROM e)) v ON v.g = st.g WHERE i = 25)"""


_PAR = """, par AS (SELECT g, t, list({'s': s, 'm': m} ORDER BY o) AS ps FROM e GROUP BY g, t), first_root AS (SELECT g, min(s) AS fr FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.g = x.g AND y.t = x.s) GROUP BY g)"""
_MOVED = " SELECT a.g, a.node, round(a.p + 1e-9, 6) AS base, round(b.p + 1e-9, 6) AS changed, round(b.p - a.p + 1e-9, 6) AS delta FROM a JOIN b ON a.g = b.g AND a.node = b.node"
_WEIGHT = "CASE WHEN x.m < 0 THEN 1 + x.m ELSE x.m END"
_FOLD = "list_reduce(list_prepend(0.5::DOUBLE, list_transform(ps, lambda x: {value} * " + _WEIGHT + ")), lambda p, y: greatest(0.1, least(0.9, p + (y - 0.5) * 0.5)))"


def _fold_net(name: str, do: bool) -> str:
    """As _net, by folds, with a target of any level."""
    step = f"CASE WHEN ps IS NULL THEN 0.5::DOUBLE ELSE {_FOLD.format(value='state[x.s + 1]')} END"
    step = f"CASE WHEN i = target.node THEN {DO}::DOUBLE ELSE {step} END" if do else step
    return f""", {name}_st(g, i, state) AS (SELECT g, 0, []::DOUBLE[] FROM target UNION ALL SELECT st.g, i + 1, list_append(state, {step})
  FROM {name}_st st JOIN target ON target.g = st.g LEFT JOIN par ON par.g = st.g AND par.t = st.i WHERE i < 25),
{name} AS (SELECT st.g, v.node, state[v.node + 1] AS p FROM {name}_st st JOIN (SELECT DISTINCT g, x AS node FROM (SELECT g, s AS x FROM e UNION SELECT g, t FROM e)) v ON v.g = st.g WHERE i = 25)"""


def _all_states(rule: str, prior: float) -> str:
    """Every state of every order graph with its probability: base, and done, where the smallest node with parents is set."""
    bit = "((state >> x.i) & 1)"
    mean = f"greatest(0.01, least(0.99, CASE WHEN {_TOTAL} = 0 THEN list_avg(list_transform(ps, lambda x: {{0}})) ELSE list_sum(list_transform(ps, lambda x: abs(x.m) * {{0}})) / {_TOTAL} END))"
    table = f"(CASE WHEN x.m > 0 THEN CASE {bit} WHEN 1 THEN x.m ELSE 1 - x.m END ELSE CASE {bit} WHEN 1 THEN 1 - abs(x.m) ELSE abs(x.m) END END)"
    p = mean.format(table) if rule == "mean" else _FOLD.format(value=bit)
    return f"""WITH {ORDER}, v AS MATERIALIZED (SELECT g, node, row_number() OVER (PARTITION BY g ORDER BY node) - 1 AS i FROM (SELECT g, s AS node FROM e UNION SELECT g, t FROM e)),
par AS (SELECT e.g, e.t, list({{'i': v.i, 'm': e.m}} ORDER BY o) AS ps FROM e JOIN v ON v.g = e.g AND v.node = e.s GROUP BY e.g, e.t),
target AS (SELECT g, min(t) AS node FROM e GROUP BY g),
states AS (SELECT g, unnest(range(1 << count(*))) AS state FROM v GROUP BY g),
local AS (SELECT v.g, state, (state >> v.i) & 1 AS b, v.node = target.node AS fixed, CASE WHEN ps IS NULL THEN {prior}::DOUBLE ELSE {p} END AS p
  FROM v JOIN states ON states.g = v.g JOIN target ON target.g = v.g LEFT JOIN par ON par.g = v.g AND par.t = v.node),
joint AS MATERIALIZED (SELECT g, state, product(CASE b WHEN 1 THEN p ELSE 1 - p END) AS base, product(CASE WHEN fixed THEN CASE b WHEN 1 THEN {DO} ELSE 1 - {DO} END ELSE CASE b WHEN 1 THEN p ELSE 1 - p END END) AS done FROM local GROUP BY g, state)"""


_CLIP = "greatest(least({}, 1 - 1e-10), 1e-10)"
_KL = "(q * ln(q / r) + (1 - q) * ln((1 - q) / (1 - r)))"
ORACLES = {
    "topological_levels": _REC + _LEVELS + " SELECT g, node, max(level) AS level FROM lv GROUP BY g, node",
    "ancestors": _REC + _ANC + " SELECT * FROM an",
    "ancestor_graph": _REC + _ANC + ", k AS (SELECT DISTINCT an.g, ancestor FROM an JOIN (SELECT g, min(t) AS node FROM e GROUP BY g) m ON m.g = an.g AND m.node = an.node) SELECT e.g, s AS src, t AS dst FROM e WHERE EXISTS (SELECT 1 FROM k WHERE k.g = e.g AND ancestor = s) AND EXISTS (SELECT 1 FROM k WHERE k.g = e.g AND ancestor = t)",
    "graph_components": _REC + """, f AS (SELECT g, s, t FROM e WHERE c > 0.8), u AS (SELECT g, s AS a, t AS b FROM f UNION SELECT g, t, s FROM f), cc(g, node, other) AS (SELECT DISTINCT g, a, a FROM u UNION SELECT cc.g, node, b FROM cc JOIN u ON u.g = cc.g AND u.a = other)
      SELECT g, node, min(other) AS component FROM cc GROUP BY g, node""",
    "parents_listed": WITH + " SELECT g, t AS dst, string_agg(s, ',' ORDER BY o) AS parents FROM e GROUP BY g, t",
    "net_continuous": _REC + _PAR + _net(_CONTINUOUS, "a", False) + " SELECT g, node, round(p + 1e-9, 6) AS p FROM a",
    "net_boolean": _REC + _PAR + _net(_BOOLEAN, "a", False) + " SELECT g, node, round(p + 1e-9, 6) AS p FROM a",
    "net_continuous_do": _REC + _PAR + _net(_CONTINUOUS, "a", False) + _net(_CONTINUOUS, "b", True) + _MOVED,
    "net_boolean_do": _REC + _PAR + _net(_BOOLEAN, "a", False) + _net(_BOOLEAN, "b", True) + _MOVED,
    "net_fold": _REC + _PAR + ", target AS (SELECT g, min(t) AS node FROM e GROUP BY g)" + _fold_net("a", False) + _fold_net("b", True) + _MOVED,
    "net_given_parents": _all_states("mean", PRIOR) + """, x AS (SELECT v.g, v.node, e.s::VARCHAR AS parent, base AS w, (state >> v.i) & 1 AS b, (state >> u.i) & 1 AS a
      FROM v JOIN joint ON joint.g = v.g LEFT JOIN e ON e.g = v.g AND e.t = v.node LEFT JOIN v u ON u.g = e.g AND u.node = e.s)
      SELECT g, node, parent, round(sum(w * b) + 1e-9, 6) AS p, round(sqrt(sum(w * b) * (1 - sum(w * b))) + 1e-9, 6) AS std,
      round(sum(w * b) FILTER (WHERE a = 0) / sum(w) FILTER (WHERE a = 0) + 1e-9, 6) AS p_given_0, round(sum(w * b) FILTER (WHERE a = 1) / sum(w) FILTER (WHERE a = 1) + 1e-9, 6) AS p_given_1
      FROM x GROUP BY g, node, parent""",
    "net_do_against_see": _all_states("fold", 0.5) + f""", x AS (SELECT v.g, v.node, base, done, (state >> v.i) & 1 AS b, (state >> u.i) & 1 AS a
      FROM v JOIN joint ON joint.g = v.g JOIN target ON target.g = v.g JOIN v u ON u.g = target.g AND u.node = target.node),
      y AS (SELECT g, node, sum(base * b) AS base, sum(done * b) AS done, {DO} * sum(base * b) FILTER (WHERE a = 1) / sum(base) FILTER (WHERE a = 1) + (1 - {DO}) * sum(base * b) FILTER (WHERE a = 0) / sum(base) FILTER (WHERE a = 0) AS seen FROM x GROUP BY g, node)
      SELECT g, node, round(base + 1e-9, 6) AS base, round(done + 1e-9, 6) AS done, round(seen + 1e-9, 6) AS seen, round(done - seen + 1e-9, 6) AS delta FROM y""",
    "contributions": _REC + _PAR + _net(_CONTINUOUS, "a", False) + _net(_CONTINUOUS, "b", True) + f""", z AS (SELECT a.g, a.node, a.p AS pa, b.p AS pb, {_CLIP.format('b.p')} AS q, {_CLIP.format('a.p')} AS r FROM a JOIN b ON a.g = b.g AND a.node = b.node),
      y AS (SELECT *, 0.7 * abs(pb - pa) + 0.3 * {_KL} AS raw FROM z), x AS (SELECT *, coalesce(raw / nullif(max(raw) OVER (PARTITION BY g), 0), 0) AS con FROM y)
      SELECT g, node, round(con, 6) AS contribution, row_number() OVER (PARTITION BY g ORDER BY round(con, 9) DESC, node) AS rank, CAST(round_even(round(pb, 9) * 10, 0) AS INT) AS opinion, CAST(round_even(round(con, 9) * 4 + 1, 0) AS INT) AS reason FROM x""",
    "interventions_from_question": WITH + " SELECT g, node, 0.0::DOUBLE AS value FROM n WHERE len(list_filter(string_split(label, ' '), lambda w: NOT contains('what if trade of nation_3 or nation 12 decreases?', w))) = 0",
    "path_strength": _REC + _PAR + _net("list_max(list_transform(ps, lambda x: abs(x.m) * state[x.s + 1]))", "a", False, "1.0::DOUBLE") + " SELECT g, node, round(p + 1e-9, 6) AS strength FROM a",
    "is_dag": _REC + """, b AS (SELECT g, CASE WHEN o % 5 = 0 THEN t ELSE s END AS s, CASE WHEN o % 5 = 0 THEN s ELSE t END AS t FROM e), r(g, a, z) AS (SELECT g, s, t FROM b UNION SELECT r.g, a, t FROM r JOIN b ON b.g = r.g AND b.s = z)
      SELECT g, NOT bool_or(a = z) AS is_dag FROM r GROUP BY g""",
    "relation_sentences": WITH + " SELECT e.g, o AS ord, a.label || CASE WHEN m > 0 THEN ' increases ' ELSE ' decreases ' END || b.label AS sentence FROM e JOIN n a ON a.g = e.g AND a.node = s JOIN n b ON b.g = e.g AND b.node = t",
}
