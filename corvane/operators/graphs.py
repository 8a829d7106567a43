"""Per-graph features over a node table ``(graph_id, node)`` and an undirected edge table ``(graph_id, src, dst)``.

Edges are stored once. Iterative operators run until nothing changes, as
joins on ``(graph_id, node)`` and write each round to the checkpoint folder, so
a lost executor never replays the whole iteration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.session import cut_lineage

G = "graph_id"


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with the smaller node first; loops dropped."""
    return edges.where("src <> dst").select(G, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; every row is read once."""
    pair = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(G, F.inline(pair))


def edge_list(nodes: DataFrame, edges: DataFrame, loops: str = "edgeless") -> DataFrame:
    """Both directions plus self-loops: on the first node of a graph without edges, or on every isolated node."""
    if loops == "edgeless":
        alone = nodes.join(edges.select(G), G, "left_anti").groupBy(G).agg(F.min("node").alias("src"))
    else:
        touched = both_ways(edges).select(G, F.col("src").alias("node"))
        alone = nodes.join(touched, [G, "node"], "left_anti").select(G, F.col("node").alias("src"))
    return both_ways(edges).unionByName(alone.select(G, "src", F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = both_ways(edges).groupBy(G, F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(d, [G, "node"], "left").select(G, "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, largest degree and mean degree centrality (1 for a single node)."""
    d = degrees(nodes, edges).groupBy(G).agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("_d"), F.max("degree").alias("max_degree"))
    n = F.col("n_nodes")
    mean = F.when(n > 1, F.col("_d") / (n * (n - 1)).cast("double")).otherwise(1.0)
    return d.select(G, "n_nodes", (F.col("_d") / 2).cast("bigint").alias("n_edges"), "max_degree", mean.alias("avg_degree_centrality"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, node, component)`` by alternating large-star and small-star steps, which end after few rounds."""
    pairs = cut_lineage(both_ways(edges))
    last = None
    while True:
        low = pairs.groupBy(G, "src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = pairs.join(low, [G, "src"]).where("dst > src").select(G, F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        down = large.select(G, F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        low2 = down.groupBy(G, "src").agg(F.min("dst").alias("m"))
        small = down.join(low2, [G, "src"]).select(G, F.inline(F.array(
            F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct(F.col("src"), F.col("m").alias("dst"))))).where("src <> dst").distinct()
        small = cut_lineage(small)
        mark = small.agg(F.count("*"), F.bit_xor(F.xxhash64(G, "src", "dst"))).first()
        if mark == last:
            break
        last, pairs = mark, both_ways(small)
    found = small.select(G, F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.join(found, [G, "node"], "left").select(G, "node", F.coalesce("component", "node").alias("component"))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Independent cycles (edges - nodes + components) and whether the graph is connected."""
    c = components(nodes, edges).groupBy(G).agg(F.count("*").alias("_n"), F.count_distinct("component").alias("n_components"))
    e = edges.groupBy(G).agg(F.count("*").alias("_e"))
    n_cycles = F.coalesce("_e", F.lit(0)) - F.col("_n") + F.col("n_components")
    return c.join(e, G, "left").select(G, "n_components", n_cycles.alias("n_cycles"), (F.col("n_components") == 1).alias("connected"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Average clustering coefficient; nodes with fewer than two neighbours count 0.

    Each triangle is found once, from its lowest-degree corner: edges point from
    the lower to the higher degree, so no node has more than sqrt(2E) outgoing
    edges and a hub never expands into all pairs of its neighbours.
    """
    deg = degrees(nodes, edges)
    a = deg.select(G, F.col("node").alias("src"), F.col("degree").alias("_ds"))
    b = deg.select(G, F.col("node").alias("dst"), F.col("degree").alias("_dd"))
    e = edges.join(a, [G, "src"]).join(b, [G, "dst"])
    up = F.struct("_ds", "src") < F.struct("_dd", "dst")
    out = e.select(G, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedges = out.join(out.select(G, "u", F.col("v").alias("w")), [G, "u"]).where("v < w")
    closing = edges.select(G, F.col("src").alias("v"), F.col("dst").alias("w"))
    tri = wedges.join(closing, [G, "v", "w"])
    per = tri.select(G, F.explode(F.array("u", "v", "w")).alias("node")).groupBy(G, "node").agg(F.count("*").alias("_t"))
    d = F.col("degree")
    c = F.when(d >= 2, 2.0 * F.coalesce("_t", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return deg.join(per, [G, "node"], "left").groupBy(G).agg(F.avg(c).alias("clustering"))


def shortest_paths(edges: DataFrame) -> DataFrame:
    """``(graph_id, s, t, d, paths)`` for all connected ordered pairs ``s <> t``.

    Distances double per round. Once everything up to ``h`` is known, a pair at
    distance ``h + r`` has on each shortest path exactly one node at distance
    ``h`` from its start: the known rows at distance exactly ``h`` are joined
    with the known rows of length 1..h. Path counts multiply and add up the same
    way. A diameter of ``D`` needs about ``log2(D)`` rounds.
    """
    known = cut_lineage(both_ways(edges).distinct().select(
        G, F.col("src").alias("s"), F.col("dst").alias("t"), F.lit(1).alias("d"), F.lit(1.0).alias("paths")))
    h = 1
    while True:
        left = known.where(F.col("d") == h).select(G, "s", F.col("t").alias("m"), F.col("paths").alias("_p"))
        right = known.select(G, F.col("s").alias("m"), "t", F.col("d").alias("_r"), F.col("paths").alias("_q"))
        by_length = left.join(right, [G, "m"]).where("s <> t").groupBy(G, "s", "t", "_r").agg(F.sum(F.col("_p") * F.col("_q")).alias("paths"))
        best = by_length.groupBy(G, "s", "t").agg(F.min(F.struct("_r", "paths")).alias("_b"))
        new = best.join(known.select(G, "s", "t"), [G, "s", "t"], "left_anti").select(
            G, "s", "t", (F.col("_b._r") + h).alias("d"), F.col("_b.paths").alias("paths"))
        new = cut_lineage(new)
        if new.isEmpty():
            return known
        known, h = known.unionByName(new), 2 * h


def path_features(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Diameter, mean path length, Wiener index and mean closeness.

    All but the Wiener index are 0 for a disconnected graph; the Wiener index is infinite there.
    """
    n = nodes.groupBy(G).agg(F.count("*").alias("n"))
    per_node = paths.groupBy(G, "s").agg(F.sum("d").alias("_sum"), F.max("d").alias("_far"), F.count("*").alias("_reached"))
    agg = per_node.join(n, G).groupBy(G, "n").agg(
        F.sum("_sum").alias("total"), F.max("_far").alias("far"), F.sum("_reached").alias("pairs"),
        F.sum((F.col("n") - 1) / F.col("_sum")).alias("_close"))
    out = n.join(agg, [G, "n"], "left")
    whole = F.coalesce(F.col("pairs"), F.lit(0)) == F.col("n") * (F.col("n") - 1)
    real = whole & (F.col("n") > 1)
    return out.select(
        G, F.when(real, F.col("far")).otherwise(0).alias("diameter"),
        F.when(real, F.col("total") / F.col("pairs")).otherwise(0.0).alias("mean_path"),
        F.when(F.col("n") == 1, 0.0).when(whole, F.col("total") / 2.0).otherwise(float("inf")).alias("wiener"),
        F.when(real, F.col("_close") / F.col("n")).when(F.col("n") == 1, 0.0).otherwise(0.0).alias("closeness_mean"))


def betweenness(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Mean and population std of normalised betweenness.

    Dependencies flow back level by level (Brandes 2001): one round per distance,
    each touching only that level's rows, never all (s, v, t) triples.
    """
    adj = both_ways(edges).select(G, F.col("src").alias("w"), F.col("dst").alias("v"))
    far = paths.select(G, "s", F.col("t").alias("w"), F.col("d").alias("dw"), F.col("paths").alias("pw"))
    near = paths.select(G, "s", F.col("t").alias("v"), F.col("d").alias("dv"), F.col("paths").alias("pv"))
    back = far.join(adj, [G, "w"]).join(near, [G, "s", "v"]).where("dv = dw - 1").select(G, "s", "v", "w", "dw", (F.col("pv") / F.col("pw")).alias("share"))
    back = cut_lineage(back)
    level = back.agg(F.max("dw")).first()[0] or 0
    flow, layers = None, []
    while level > 1:
        here = back.where(F.col("dw") == level)
        carried = F.lit(0.0)
        if flow is not None:
            here = here.join(flow.select(G, "s", F.col("v").alias("w"), "delta"), [G, "s", "w"], "left")
            carried = F.coalesce("delta", F.lit(0.0))
        flow = cut_lineage(here.groupBy(G, "s", "v").agg(F.sum(F.col("share") * (1.0 + carried)).alias("delta")))
        layers.append(flow)
        level -= 1
    n = nodes.groupBy(G).agg(F.count("*").alias("n"))
    base = nodes.join(n, G)
    if layers:
        total = layers[0]
        for x in layers[1:]:
            total = total.unionByName(x)
        per = total.groupBy(G, F.col("v").alias("node")).agg(F.sum("delta").alias("_b"))
        base = base.join(per, [G, "node"], "left")
    else:
        base = base.withColumn("_b", F.lit(0.0))
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    b = F.coalesce("_b", F.lit(0.0)) * scale
    return base.groupBy(G).agg(F.avg(b).alias("betweenness_mean"), F.stddev_pop(b).alias("betweenness_std"))


SMALL_GRAPH = 256  # nodes: at most 256 * 255 / 2 edge rows in one group


def _small_spectral(alpha: float, beta: float, tol: float, rounds: int):
    """Both centralities of one small graph, iterated to convergence; 0 when they do not settle."""
    import numpy as np
    import pandas as pd

    def settle(start, step):
        x = start
        for _ in range(rounds):
            y = step(x)
            if np.abs(y - x).sum() < len(x) * tol:
                return y
            x = y
        return None

    def one(key, nodes: "pd.DataFrame", edges: "pd.DataFrame") -> "pd.DataFrame":
        names = np.sort(nodes["node"].to_numpy())
        n = len(names)
        a = np.zeros((n, n))
        i, j = np.searchsorted(names, edges["src"].to_numpy()), np.searchsorted(names, edges["dst"].to_numpy())
        a[i, j] = a[j, i] = 1.0

        def power(x):
            y = x + a @ x
            return y / np.linalg.norm(y)

        ev = settle(np.full(n, 1.0 / n), power)
        kz = settle(np.zeros(n), lambda x: alpha * (a @ x) + beta)
        return pd.DataFrame({G: [key[0]], "eigenvector_mean": [0.0 if ev is None else float(ev.mean())],
                             "katz_std": [0.0 if kz is None else float((kz / np.linalg.norm(kz)).std())]})

    return one


def spectral(nodes: DataFrame, edges: DataFrame, rounds: int = 1000, alpha: float = 0.1, beta: float = 1.0,
             tol: float = 1e-6, small: int = SMALL_GRAPH) -> DataFrame:
    """Mean eigenvector centrality (power iteration on I + A) and population std of Katz centrality.

    A vector is taken from the first round whose change, summed over the nodes, is below ``tol`` per node, and is 0 if ``rounds``
    pass without one. Graphs of at most ``small`` nodes are one bounded co-group each; larger ones are never brought together and
    iterate as joins on ``(graph_id, node)``. Both follow the same rounds and the same rule.
    """
    size = nodes.groupBy(G).agg(F.count("*").alias("_n"))
    few, many = size.where(F.col("_n") <= small).select(G), size.where(F.col("_n") > small).select(G, "_n")
    t = nodes.schema[G].dataType.simpleString()
    local = nodes.join(few, G, "left_semi").select(G, "node").groupBy(G).cogroup(
        edges.join(few, G, "left_semi").select(F.col(G).alias("_g"), "src", "dst").groupBy("_g")).applyInPandas(
        _small_spectral(alpha, beta, tol, rounds), f"{G} {t}, eigenvector_mean double, katz_std double")
    if many.isEmpty():
        return local
    return local.unionByName(_joined_spectral(nodes.join(many, G).select(G, "node", "_n"), edges.join(many, G, "left_semi"), rounds, alpha, beta, tol))


def _joined_spectral(nodes: DataFrame, edges: DataFrame, rounds: int, alpha: float, beta: float, tol: float) -> DataFrame:
    # a loop row per node carries its own value over, so each round reads the vectors once
    loops = nodes.select(G, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("own"))
    adj = cut_lineage(both_ways(edges).withColumn("own", F.lit(False)).unionByName(loops))
    own = F.col("own")
    x = nodes.select(G, "node", "_n", (1.0 / F.col("_n")).alias("ev"), F.lit(0.0).alias("kz"), F.lit(False).alias("ev_done"), F.lit(False).alias("kz_done"))
    for done in range(1, rounds + 1):
        v = x.select(G, F.col("node").alias("dst"), "ev", "kz")
        y = adj.join(v, [G, "dst"]).groupBy(G, F.col("src").alias("node")).agg(
            F.sum("ev").alias("ev2"), F.sum(F.when(own, beta).otherwise(F.col("kz") * alpha)).alias("kz2"))
        both = x.join(y, [G, "node"])
        unit = both.groupBy(G).agg(F.sqrt(F.sum(F.col("ev2") * F.col("ev2"))).alias("_e"))
        both = both.join(unit, G).withColumn("ev2", F.col("ev2") / F.col("_e"))
        gap = both.groupBy(G).agg(F.sum(F.abs(F.col("ev2") - F.col("ev"))).alias("_ge"), F.sum(F.abs(F.col("kz2") - F.col("kz"))).alias("_gk"))
        keep = lambda name: F.when(F.col(f"{name}_done"), F.col(name)).otherwise(F.col(f"{name}2")).alias(name)
        # a settled vector stays as it is; the other one goes on
        x = cut_lineage(both.join(gap, G).select(
            G, "node", "_n", keep("ev"), keep("kz"), (F.col("ev_done") | (F.col("_ge") < F.col("_n") * tol)).alias("ev_done"),
            (F.col("kz_done") | (F.col("_gk") < F.col("_n") * tol)).alias("kz_done")))
        if not x.where("not (ev_done and kz_done)").limit(1).count():
            break
    k = x.groupBy(G).agg(F.sqrt(F.sum(F.col("kz") * F.col("kz"))).alias("_k"))
    return x.join(k, G).groupBy(G).agg(
        F.when(F.every("ev_done"), F.avg("ev")).otherwise(0.0).alias("eigenvector_mean"),
        F.when(F.every("kz_done"), F.stddev_pop(F.col("kz") / F.col("_k"))).otherwise(0.0).alias("katz_std"))


def kind_fractions(nodes: DataFrame, edges: DataFrame, node_kinds: list[str], edge_kinds: list[str], common: str) -> DataFrame:
    """Share of each node kind, of all kinds but ``common``, and of each edge kind."""
    share = lambda c, k: F.avg((F.col(c) == k).cast("double"))
    n = nodes.groupBy(G).agg(F.avg((F.col("kind") != common).cast("double")).alias("other_ratio"), *[share("kind", k).alias(f"node_{k}") for k in node_kinds])
    e = edges.groupBy(G).agg(*[share("kind", k).alias(f"edge_{k}") for k in edge_kinds])
    return n.join(e, G, "left").fillna(0.0, [f"edge_{k}" for k in edge_kinds])
