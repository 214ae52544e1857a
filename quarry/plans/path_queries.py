"""Registered queries that search typed paths in the graph of customers, orders, parts, suppliers and nations; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph_paths as P
from quarry.plans.catalogue import _t, query

_EDGES_SQL = """e AS (SELECT DISTINCT 'C' || o_custkey AS source, 'places' AS relation, 'O' || o_orderkey AS target FROM orders UNION SELECT 'O' || l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'holds' ELSE 'contains' END, 'P' || l_partkey FROM lineitem
  UNION SELECT 'P' || l_partkey, 'supplied_by', 'S' || l_suppkey FROM lineitem UNION SELECT 'S' || s_suppkey, 'in', 'N' || s_nationkey FROM supplier UNION SELECT 'C' || o_custkey, 'next_step', 'C' || (o_custkey % 97 + 1) FROM orders WHERE o_orderkey % 3 = 0)"""
# Every fiftieth customer asks for a nation by four edges, a supplier by three, parts by two with some relations, and an order.
_ASKS = [("1", "concat('N', c_nationkey)", [], 4), ("2", "concat('S', c_custkey % 40 + 1)", [], 3), ("3", "concat('P', c_custkey % 100 + 1)", ["places", "holds"], 2), ("4", "concat('N', c_custkey % 25)", ["places", "contains", "supplied_by", "in", "next_step"], 4)]


def _edges(spark, d):
    orders, lines, supplier = (_t(spark, d, t) for t in ("orders", "lineitem", "supplier"))
    parts = [
        orders.selectExpr("concat('C', o_custkey) AS source", "'places' AS relation", "concat('O', o_orderkey) AS target"), lines.selectExpr("concat('O', l_orderkey) AS source", "CASE WHEN l_linenumber % 2 = 0 THEN 'holds' ELSE 'contains' END AS relation", "concat('P', l_partkey) AS target"),
        lines.selectExpr("concat('P', l_partkey) AS source", "'supplied_by' AS relation", "concat('S', l_suppkey) AS target"), supplier.selectExpr("concat('S', s_suppkey) AS source", "'in' AS relation", "concat('N', s_nationkey) AS target"),
        orders.filter("o_orderkey % 3 = 0").selectExpr("concat('C', o_custkey) AS source", "'next_step' AS relation", "concat('C', o_custkey % 97 + 1) AS target"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_LIST = lambda xs, a: (f"{a}(" if a else "[") + ", ".join(f"'{x}'" for x in xs) + (")" if a else "]")
_ASK_SQL = " UNION ALL ".join(f"SELECT c_custkey AS node, {i} AS ord, 'C' || c_custkey AS source, {t} AS target, CAST({_LIST(r, '')} AS VARCHAR[]) AS allowed, {n} AS max_depth FROM customer WHERE c_custkey % 50 = 0" for i, t, r, n in _ASKS)
_WALK = f"""{_EDGES_SQL}, asks AS ({_ASK_SQL}),
p AS (SELECT node, ord, source AS spot, target AS goal, allowed, max_depth, [source] AS nodes, CAST([] AS VARCHAR[]) AS relations FROM asks
  UNION ALL SELECT node, ord, e.target, goal, allowed, max_depth, list_append(nodes, e.target), list_append(relations, e.relation) FROM p JOIN e ON e.source = p.spot
  WHERE p.spot <> goal AND len(relations) < max_depth AND NOT list_contains(nodes, e.target) AND (len(allowed) = 0 OR list_contains(allowed, e.relation))),
f AS (SELECT *, len(relations) AS depth, row_number() OVER (PARTITION BY node, ord ORDER BY len(relations), nodes, relations) AS nth FROM p WHERE spot = goal AND len(relations) > 0)"""


def _targets(spark, d):
    asked = F.array(*[F.struct(F.lit(int(i)).alias("ord"), F.expr(t).alias("target"), F.array(*map(F.lit, r)).cast("array<string>").alias("allowed"), F.lit(n).alias("max_depth")) for i, t, r, n in _ASKS])
    return _t(spark, d, "customer").filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node"), F.inline(asked))


@query(f"WITH RECURSIVE {_WALK} SELECT node, ord, nth, depth, array_to_string(nodes, '>') AS nodes, array_to_string(relations, '>') AS relations FROM f WHERE nth <= 5")
def typed_paths(spark, d):
    asks = _targets(spark, d).select(F.struct("node", "ord").alias("ask"), F.concat(F.lit("C"), F.col("node").cast("string")).alias("source"), "target", "allowed", "max_depth")
    found = P.typed_paths(_edges(spark, d), asks, 5)
    return found.select("ask.node", "ask.ord", "nth", "depth", F.array_join("nodes", ">").alias("nodes"), F.array_join("relations", ">").alias("relations"))


_SHOWN = "nodes[1] || ' ' || array_to_string(list_transform(relations, lambda r, i: '--' || r || '--> ' || nodes[i + 1]), ' ')"


@query(f"""WITH RECURSIVE {_WALK}, s AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS nth FROM (SELECT DISTINCT source, target FROM e WHERE relation = 'next_step' AND source <> target)),
a AS (SELECT c_custkey AS node, 0 AS g, c_custkey % 3 AS ord, 0 AS nth, 'own path ' || (c_custkey % 7) AS path FROM customer WHERE c_custkey % 50 = 0
  UNION ALL SELECT c_custkey, 1, 0, nth, source || ' --next_step--> ' || target FROM customer JOIN s ON source = 'C' || c_custkey WHERE c_custkey % 50 = 0 AND nth <= 2
  UNION ALL SELECT node, 2, ord, nth, {_SHOWN} FROM f WHERE nth <= 12),
o AS (SELECT node, path, min((g, ord, nth)) AS x FROM a GROUP BY node, path)
SELECT node, nth, path FROM (SELECT node, path, row_number() OVER (PARTITION BY node ORDER BY x, path) AS nth FROM o) WHERE nth <= 12""")
def attached_paths(spark, d):
    asked = _t(spark, d, "customer").filter("c_custkey % 50 = 0")
    starts = asked.selectExpr("c_custkey AS node", "concat('C', c_custkey) AS source")
    own = asked.selectExpr("c_custkey AS node", "c_custkey % 3 AS ord", "concat('own path ', c_custkey % 7) AS path")
    return P.attached(_edges(spark, d), starts, _targets(spark, d), own, 12, 4)
