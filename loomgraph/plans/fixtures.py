"""Canonical tables made of the driver's tables, each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import materialize

TOP_TARGETS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, node, label): every nation in every order year."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("g")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.trim(F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))).alias("label"))
    # both sides are of a fixed size: years and nations
    return years.join(F.broadcast(nations))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, src, dst, ord, modifier, confidence): of a year, each supplier nation's five largest customer nations of higher key.

    The lines are aggregated by order and supplier nation before orders and customers join, so the wide join moves few rows.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint").alias("cents"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("g"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    joined = line.join(supplier, "l_suppkey").join(orders.join(customer, "o_custkey"), "l_orderkey").where("src < dst")
    revenue = joined.groupBy("g", "src", "dst").agg(F.sum("cents").alias("revenue"))
    rank = F.row_number().over(W.partitionBy("g", "src").orderBy(F.desc("revenue"), "dst"))
    kept = revenue.withColumn("k", rank).where(F.col("k") <= TOP_TARGETS)
    of_graph = W.partitionBy("g")
    place = F.row_number().over(of_graph.orderBy("revenue", "src", "dst"))
    edges = kept.withColumn("modifier", F.round(2.0 * place / F.count("*").over(of_graph) - 1, 6))
    return edges.select("g", "src", "dst", F.row_number().over(of_graph.orderBy("src", "dst")).alias("ord"), "modifier", F.abs("modifier").alias("confidence"))


TRADE = f"""
rev AS (SELECT year(o_orderdate) AS g, s_nationkey AS s, c_nationkey AS t, sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS r
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE s_nationkey < c_nationkey GROUP BY 1, 2, 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, s ORDER BY r DESC, t) AS k FROM rev) WHERE k <= {TOP_TARGETS}),
e AS (SELECT g, s, t, m, abs(m) AS c, row_number() OVER (PARTITION BY g ORDER BY s, t) AS o FROM
  (SELECT g, s, t, round(2.0::DOUBLE * row_number() OVER (PARTITION BY g ORDER BY r, s, t) / count(*) OVER (PARTITION BY g) - 1, 6) AS m FROM top)),
n AS (SELECT g, n_nationkey AS node, trim(lower(replace(n_name, '_', ' '))) AS label FROM (SELECT DISTINCT year(o_orderdate) AS g FROM orders), nation)"""


def held_trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade edges, made once for plans that read them several times."""
    return materialize(trade_edges(spark, sf_dir), "trade-edges")


WITH_TRADE = f"WITH {TRADE}"


def basket_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, node, label): every nation for every customer with orders."""
    customers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.trim(F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))).alias("label"))
    # nations are of a fixed size
    return customers.join(F.broadcast(nations))


def _line_graphs(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """(g, src, dst, ord, modifier, confidence): of each key of the orders, the supplier nations of neighbouring lines of an order, lower key first."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint").alias("cents"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    # one shuffle by order serves both sides of the pairs and the join with orders
    placed = line.join(supplier, "l_suppkey").select("l_orderkey", F.col("l_linenumber").alias("n"), "nation", "cents")
    after = placed.select("l_orderkey", (F.col("n") - 1).alias("n"), F.col("nation").alias("next"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col(key).alias("g"))
    pairs = placed.join(after, ["l_orderkey", "n"]).where("nation <> next").join(orders, "l_orderkey")
    edges = pairs.groupBy("g", F.least("nation", "next").alias("src"), F.greatest("nation", "next").alias("dst")).agg(F.sum("cents").alias("revenue"))
    of_graph = W.partitionBy("g")
    place = F.row_number().over(of_graph.orderBy("revenue", "src", "dst"))
    edges = edges.withColumn("modifier", F.round(2.0 * place / F.count("*").over(of_graph) - 1, 6))
    return edges.select("g", "src", "dst", F.row_number().over(of_graph.orderBy("src", "dst")).alias("ord"), "modifier", F.abs("modifier").alias("confidence"))


def basket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each customer with orders, so their number grows with the tables; none of the edges is left out."""
    return _line_graphs(spark, sf_dir, "o_custkey")


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each order. An order has few lines, so a graph is small enough for SQL to go through all of its states."""
    return materialize(_line_graphs(spark, sf_dir, "o_orderkey"), "order-edges")


def _line_graphs_sql(key: str) -> str:
    return f"""
ln AS (SELECT l_orderkey, l_linenumber AS n, s_nationkey AS a, CAST(floor(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
pr AS (SELECT {key} AS g, least(x.a, y.a) AS s, greatest(x.a, y.a) AS t, sum(x.r) AS r FROM ln x JOIN ln y ON y.l_orderkey = x.l_orderkey AND y.n = x.n + 1 JOIN orders ON o_orderkey = x.l_orderkey WHERE x.a <> y.a GROUP BY 1, 2, 3),
e AS MATERIALIZED (SELECT g, s, t, m, abs(m) AS c, row_number() OVER (PARTITION BY g ORDER BY s, t) AS o FROM
  (SELECT g, s, t, round(2.0::DOUBLE * row_number() OVER (PARTITION BY g ORDER BY r, s, t) / count(*) OVER (PARTITION BY g) - 1, 6) AS m FROM pr))"""


ORDER = _line_graphs_sql("o_orderkey")
BASKET = f"""{_line_graphs_sql("o_custkey")},
n AS (SELECT g, n_nationkey AS node, trim(lower(replace(n_name, '_', ' '))) AS label FROM (SELECT DISTINCT o_custkey AS g FROM orders), nation)"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, scenario, gt, pred): one rating and one prediction of a supplier and scenario, those of its first order."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pid"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_orderkey") % 3 + 1).cast("string")).alias("scenario"),
        F.struct("l_orderkey", "l_partkey").alias("at"),
        (1 + F.col("l_quantity").cast("int") % 10).alias("gt"),
        (1 + F.col("l_partkey") % 10).cast("int").alias("pred"),
    )
    first = line.groupBy("pid", "scenario").agg(F.min(F.struct("at", "gt", "pred")).alias("x"))
    return first.select("pid", "scenario", "x.gt", "x.pred")


SURVEY = """
sv AS (SELECT pid, scenario, gt, pred FROM (SELECT l_suppkey AS pid, l_linenumber || '.' || (l_orderkey % 3 + 1) AS scenario, 1 + CAST(trunc(l_quantity) AS INT) % 10 AS gt,
  CAST(1 + l_partkey % 10 AS INT) AS pred, row_number() OVER (PARTITION BY l_suppkey, l_linenumber || '.' || (l_orderkey % 3 + 1) ORDER BY l_orderkey, l_partkey, 1 + CAST(trunc(l_quantity) AS INT) % 10) AS k FROM lineitem) WHERE k = 1)"""


def reasons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth and prediction (pid, scenario, code, score): codes by the order, scores by quantity and part; the smallest score of a code counts."""
    line = table(spark, sf_dir, "lineitem").withColumn("scenario", F.concat(F.col("l_linenumber").cast("string"), F.lit("."), (F.col("l_orderkey") % 3 + 1).cast("string")))
    letter = lambda c: F.substring(F.lit("ABCDEFGHIJKL"), (c % 12 + 1).cast("int"), F.lit(1))
    make = lambda code, score: line.groupBy(F.col("l_suppkey").alias("pid"), "scenario", code.alias("code")).agg(F.min(score).alias("score"))
    truth = make(letter(F.col("l_orderkey")), 1 + F.col("l_quantity").cast("int") % 5)
    guess = make(letter(F.col("l_orderkey") + F.col("l_partkey") % 2), (1 + F.col("l_partkey") % 5).cast("int"))
    return truth, guess


REASONS = """
rl AS (SELECT *, l_linenumber || '.' || (l_orderkey % 3 + 1) AS scenario FROM lineitem),
rt AS (SELECT l_suppkey AS pid, scenario, substr('ABCDEFGHIJKL', CAST(l_orderkey % 12 + 1 AS INT), 1) AS code, min(1 + CAST(trunc(l_quantity) AS INT) % 5) AS score FROM rl GROUP BY 1, 2, 3),
rp AS (SELECT l_suppkey AS pid, scenario, substr('ABCDEFGHIJKL', CAST((l_orderkey + l_partkey % 2) % 12 + 1 AS INT), 1) AS code, min(CAST(1 + l_partkey % 5 AS INT)) AS score FROM rl GROUP BY 1, 2, 3)"""
