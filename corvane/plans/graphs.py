"""Queries for graph features. Every benchmark passage is a graph: distinct words, joined when they follow each other in a sentence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import fingerprints as FP, vectors as V
from corvane.operators import graphs as GR
from corvane.plans.metrics import show
from corvane.plans.registry import plan, r6, table


def word_graph(spark, sf):
    """Nodes ``(graph_id, node, kind)`` and edges ``(graph_id, src, dst, kind)``; kind single or double by how often a pair occurs."""
    strip = lambda w: F.regexp_replace(w, r"[.,]", "")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("graph_id"), FP.tokens(F.col("text")).alias("w"))
    nodes = b.select("graph_id", F.explode(F.array_distinct(F.transform("w", strip))).alias("node")).where("node <> ''")
    first = F.substring("node", 1, 1)
    nodes = nodes.withColumn("kind", F.when(first.isin(list("aeiou")), "vowel").when(first == "t", "t").otherwise("other"))
    starts = F.when(F.size("w") >= 2, F.sequence(F.lit(1), F.size("w") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    pairs = V.let(F.struct(F.col("w"), starts.alias("i")), lambda s: F.transform(
        s["i"], lambda i: F.struct(F.element_at(s["w"], i).alias("a"), F.element_at(s["w"], i + 1).alias("b"))))
    steps = b.select("graph_id", F.inline(pairs)).where(~F.col("a").endswith("."))
    steps = steps.select("graph_id", strip(F.col("a")).alias("a"), strip(F.col("b")).alias("b")).where("a <> b AND a <> '' AND b <> ''")
    edges = steps.groupBy("graph_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("n"))
    return nodes, edges.select("graph_id", "src", "dst", F.when(F.col("n") > 1, "double").otherwise("single").alias("kind"))


GRAPH_SQL = r"""
gt AS (SELECT item_id AS graph_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS w FROM benchmark),
nodes AS (SELECT graph_id, node, CASE WHEN node[1:1] IN ('a', 'e', 'i', 'o', 'u') THEN 'vowel' WHEN node[1:1] = 't' THEN 't' ELSE 'other' END AS kind
  FROM (SELECT DISTINCT graph_id, regexp_replace(unnest(w), '[.,]', '', 'g') AS node FROM gt) WHERE node <> ''),
steps AS (SELECT graph_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM gt),
clean AS (SELECT graph_id, regexp_replace(a, '[.,]', '', 'g') AS a, regexp_replace(b, '[.,]', '', 'g') AS b FROM steps WHERE NOT ends_with(a, '.')),
edges AS (SELECT graph_id, least(a, b) AS src, greatest(a, b) AS dst, CASE WHEN count(*) > 1 THEN 'double' ELSE 'single' END AS kind
  FROM clean WHERE a <> b AND a <> '' AND b <> '' GROUP BY 1, 2, 3),
adj AS (SELECT graph_id, src, dst FROM edges UNION ALL SELECT graph_id, dst, src FROM edges),
deg AS (SELECT n.graph_id, n.node, count(a.src) AS degree FROM nodes n LEFT JOIN adj a ON a.graph_id = n.graph_id AND a.src = n.node GROUP BY 1, 2)
"""

REACH_SQL = f"""{GRAPH_SQL},
walk AS (SELECT graph_id, node AS s, node AS t FROM nodes UNION SELECT walk.graph_id, s, adj.dst FROM walk JOIN adj ON adj.graph_id = walk.graph_id AND adj.src = walk.t),
comp AS (SELECT graph_id, s, min(t) AS c FROM walk GROUP BY 1, 2)"""

# Breadth-first levels: `seen` keeps a pair's distance because only unseen pairs advance.
DIST_SQL = f"""{GRAPH_SQL},
bfs AS (SELECT graph_id, node AS s, [node] AS front, [node] AS seen, 0 AS d FROM nodes
  UNION ALL SELECT b.graph_id, b.s, n.nxt, list_concat(b.seen, n.nxt), b.d + 1 FROM bfs b,
   LATERAL (SELECT list(DISTINCT adj.dst) AS nxt FROM adj WHERE adj.graph_id = b.graph_id AND list_contains(b.front, adj.src) AND NOT list_contains(b.seen, adj.dst)) n
   WHERE n.nxt IS NOT NULL AND len(n.nxt) > 0),
dist AS (SELECT graph_id, s, unnest(front) AS t, d FROM bfs WHERE d > 0)"""


@plan("G4_sizes", f"""
WITH {GRAPH_SQL} SELECT graph_id, count(*) AS n_nodes, (sum(degree) / 2)::bigint AS n_edges, max(degree) AS max_degree,
 {r6('CASE WHEN count(*) > 1 THEN sum(degree)::double / (count(*) * (count(*) - 1)) ELSE 1 END')} AS avg_degree_centrality FROM deg GROUP BY 1
""")
def g4(spark, sf):
    return show(GR.sizes(*word_graph(spark, sf)), ["graph_id"], ["n_nodes", "n_edges", "max_degree"])


@plan("G5_cycles", f"""
WITH RECURSIVE {REACH_SQL}, c AS (SELECT graph_id, count(*) AS n, count(DISTINCT c) AS n_components FROM comp GROUP BY 1), e AS (SELECT graph_id, count(*) AS e FROM edges GROUP BY 1)
SELECT graph_id, n_components, coalesce(e, 0) - n + n_components AS n_cycles, n_components = 1 AS connected FROM c LEFT JOIN e USING (graph_id)
""")
def g5(spark, sf):
    nodes, edges = word_graph(spark, sf)
    return GR.cycles(nodes, edges)


@plan("G6_clustering", f"""
WITH {GRAPH_SQL}, tri AS (SELECT a.graph_id, a.src AS node, count(*) / 2.0::double AS t FROM adj a JOIN adj b ON b.graph_id = a.graph_id AND b.src = a.src AND b.dst <> a.dst
  JOIN adj c ON c.graph_id = a.graph_id AND c.src = a.dst AND c.dst = b.dst GROUP BY 1, 2)
SELECT d.graph_id, {r6('avg(CASE WHEN degree >= 2 THEN 2 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END)')} AS clustering FROM deg d LEFT JOIN tri USING (graph_id, node) GROUP BY 1
""")
def g6(spark, sf):
    return show(GR.clustering(*word_graph(spark, sf)), ["graph_id"])


@plan("G7_path_features", f"""
WITH RECURSIVE {DIST_SQL}, n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1), per AS (SELECT graph_id, s, sum(d) AS sm, max(d) AS far, count(*) AS k FROM dist GROUP BY 1, 2),
a AS (SELECT graph_id, n, coalesce(sum(sm), 0) AS total, max(far) AS far, coalesce(sum(k), 0) AS pairs, sum((n - 1)::double / sm) AS cl FROM n LEFT JOIN per USING (graph_id) GROUP BY 1, 2)
SELECT graph_id, CASE WHEN pairs = n * (n - 1) AND n > 1 THEN far ELSE 0 END AS diameter, {r6('CASE WHEN pairs = n * (n - 1) AND n > 1 THEN total / pairs ELSE 0 END')} AS mean_path,
 CASE WHEN n = 1 THEN 0 WHEN pairs = n * (n - 1) THEN total / 2 ELSE 'Infinity'::double END AS wiener, {r6('CASE WHEN pairs = n * (n - 1) AND n > 1 THEN cl / n ELSE 0 END')} AS closeness_mean FROM a
""")
def g7(spark, sf):
    nodes, edges = word_graph(spark, sf)
    return show(GR.path_features(nodes, GR.shortest_paths(edges)), ["graph_id"], ["diameter", "wiener"])


@plan("G8_betweenness", f"""
WITH RECURSIVE {GRAPH_SQL},
bfs AS (SELECT graph_id, node AS s, [{{'v': node, 'p': 1.0::double}}] AS front, [node] AS seen, 0 AS d FROM nodes
  UNION ALL SELECT b.graph_id, b.s, n.nxt, list_concat(b.seen, list_transform(n.nxt, lambda x: x.v)), b.d + 1 FROM bfs b,
   LATERAL (SELECT list({{'v': dst, 'p': p}}) AS nxt FROM (SELECT adj.dst, sum(f.f.p) AS p FROM (SELECT unnest(b.front) AS f) f JOIN adj ON adj.graph_id = b.graph_id AND adj.src = f.f.v
     WHERE NOT list_contains(b.seen, adj.dst) GROUP BY adj.dst)) n WHERE n.nxt IS NOT NULL AND len(n.nxt) > 0),
path AS MATERIALIZED (SELECT graph_id, s, x.v AS t, x.p AS p, d FROM (SELECT graph_id, s, unnest(front) AS x, d FROM bfs)),
mid AS (SELECT a.graph_id, a.t AS node, sum(a.p * b.p / c.p) AS b FROM path a JOIN path b ON a.graph_id = b.graph_id AND a.t = b.s
  JOIN path c ON c.graph_id = a.graph_id AND c.s = a.s AND c.t = b.t WHERE a.d > 0 AND b.d > 0 AND c.d = a.d + b.d GROUP BY 1, 2),
n AS (SELECT graph_id, count(*) AS n FROM nodes GROUP BY 1),
per AS (SELECT graph_id, CASE WHEN n > 2 THEN coalesce(b, 0) / ((n - 1) * (n - 2)) ELSE 0 END AS b FROM nodes JOIN n USING (graph_id) LEFT JOIN mid USING (graph_id, node))
SELECT graph_id, {r6('avg(b)')} AS betweenness_mean, {r6('stddev_pop(b)')} AS betweenness_std FROM per GROUP BY 1
""")
def g8(spark, sf):
    nodes, edges = word_graph(spark, sf)
    return show(GR.betweenness(nodes, edges, GR.shortest_paths(edges)), ["graph_id"])


@plan("G9_spectral")
def g9(spark, sf):
    return show(GR.spectral(*word_graph(spark, sf)), ["graph_id"])


@plan("G10_kind_fractions", f"""
WITH {GRAPH_SQL}, n AS (SELECT graph_id, avg((kind <> 'other')::int) AS r, avg((kind = 'vowel')::int) AS v, avg((kind = 't')::int) AS t FROM nodes GROUP BY 1),
e AS (SELECT graph_id, avg((kind = 'single')::int) AS s, avg((kind = 'double')::int) AS d FROM edges GROUP BY 1)
SELECT graph_id, {r6('r')} AS other_ratio, {r6('v')} AS node_vowel, {r6('t')} AS node_t, {r6('coalesce(s, 0)')} AS edge_single, {r6('coalesce(d, 0)')} AS edge_double FROM n LEFT JOIN e USING (graph_id)
""")
def g10(spark, sf):
    return show(GR.kind_fractions(*word_graph(spark, sf), ["vowel", "t"], ["single", "double"], "other"), ["graph_id"])


@plan("G11_edge_list", f"""
WITH {GRAPH_SQL}, iso AS (SELECT graph_id, node FROM deg WHERE degree = 0), none AS (SELECT graph_id, min(node) AS node FROM nodes WHERE graph_id NOT IN (SELECT graph_id FROM edges) GROUP BY 1)
SELECT 'isolated' AS loops, graph_id, src, dst FROM adj UNION ALL SELECT 'isolated', graph_id, node, node FROM iso
UNION ALL SELECT 'edgeless', graph_id, src, dst FROM adj UNION ALL SELECT 'edgeless', graph_id, node, node FROM none
""")
def g11(spark, sf):
    nodes, edges = word_graph(spark, sf)
    part = lambda mode: GR.edge_list(nodes, edges, mode).withColumn("loops", F.lit(mode))
    return part("isolated").unionByName(part("edgeless"))
