"""Merkle manifest of a dataset, with a proof of inclusion for every row.

Each row is a leaf. Leaves of one group (source) ascend by key; every ``FAN`` consecutive nodes become one node until one is left,
the group's subroot. Subroots, ordered by group, become the root in the same way.

Every node carries the interval of leaf ranks that it covers. Nodes of a level are bucketed by the rank of the run that they fall
into, so an ancestor is found by a join on (group, level's bucket) in which its interval contains the node's; the siblings are what
the parent's interval holds beside the node's own. Ancestors are attached from the top down, one level at a time: a parent has
``FAN`` children at most, so no key of these joins is hot, and a path of siblings is joined to runs, not to rows.

Positions come from ranges of (group, key): a running count inside each range plus what earlier ranges hold, so a source with
a third of all rows is many tasks. Rows that are alike in every field are one counted row until they have their positions.

Cases: null fields hash as ``-``; a null group comes first, a null key first in its group; rows with the same key follow each other by
their leaf; repeated rows are leaves each; a group of one row is its own subroot, a single subroot is the root; an empty table gives
an empty table; columns that are not fields are neither hashed nor carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.session import cut_lineage, join_small

#: Children of a node, and copies of one row that a task puts in their positions.
FAN, COPIES = 16, 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_hash(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def node_hash(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (``_g``, ``copies`` and the order's columns) with ``at``, the rows of their group before them, and ``n``, those in all."""
    by = [F.col("_g"), *[F.col(c).asc_nulls_first() for c in order]]
    ranged = cut_lineage(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    held = ranged.groupBy("_part", "_g").agg(F.sum("copies").alias("held"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("held").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = held.select("_part", "_g", before.alias("_before"), F.sum("held").over(group).alias("n"))
    inside = Window.partitionBy("_part", "_g").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumn("_upto", F.sum("copies").over(inside))
    return join_small(counted, ranges, ["_part", "_g"]).withColumn("at", F.col("_before") + F.col("_upto") - F.col("copies")).drop("_part", "_before", "_upto")


def _spread_copies(rows: DataFrame) -> DataFrame:
    """One row per copy, with its rank."""
    few, many = rows.where(F.col("copies") <= COPIES), rows.where(F.col("copies") > COPIES)
    # a row with more copies than a task should make goes to several tasks first
    starts = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))).repartition("_g", "at", "_from")
    parts = starts.withColumns({"at": F.col("at") + F.col("_from"), "copies": F.least(F.col("copies") - F.col("_from"), F.lit(COPIES))}).drop("_from")
    return few.unionByName(parts).withColumn("rank", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("copies") - 1))).drop("at", "copies")


def _runs(nodes: DataFrame, more: list[str]) -> DataFrame:
    """Parents of nodes (``_g``, ``n`` nodes of the group, ``rank`` among them, ``lo``, ``hi``, ``digest``, more columns)."""
    members = F.sort_array(F.collect_list(F.struct("rank", "lo", "hi", "digest", *more)))
    return nodes.groupBy("_g", "n", F.expr(f"rank div {FAN}").alias("up")).agg(members.alias("children")).select(
        "_g", F.col("up").alias("rank"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("children")[0]["lo"].alias("lo"),
        F.element_at("children", -1)["hi"].alias("hi"), "children", node_hash(F.transform("children", lambda c: c["digest"])).alias("digest"))


def _levels(nodes: DataFrame, more: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, lowest first, and the node that is left of every group (``_g``, ``digest``)."""
    ends, levels = nodes.where("n = 1").select("_g", "digest"), []
    while not nodes.where("n > 1").isEmpty():
        runs = cut_lineage(_runs(nodes.where("n > 1"), more))
        levels.append(runs)
        nodes, more = runs.drop("children"), []
        ends = ends.unionByName(nodes.where("n = 1").select("_g", "digest"))
    return levels, ends


def _step(children: Column, lo: Column, hi: Column) -> Column:
    """What the run's interval holds before and after [lo, hi], as joined digests."""
    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter(children, keep), lambda c: c["digest"]), "")

    return F.struct(joined(lambda c: c["hi"] < lo).alias("before"), joined(lambda c: c["lo"] > hi).alias("after"))


def _with_paths(levels: list[DataFrame], starts: DataFrame) -> DataFrame | None:
    """The lowest runs with ``path``, the steps above each of them; ``starts`` has the steps above the groups' own last nodes."""
    above = None
    for runs in reversed(levels):
        found = join_small(runs.where("n = 1"), starts, ["_g"])
        if above is not None:
            parents = above.select("_g", F.col("rank").alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("children").alias("_held"), "path", *starts.columns[2:])
            lower = runs.where("n > 1").withColumn("_bucket", F.expr(f"rank div {FAN}"))
            contained = (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
            joined = lower.join(parents, ["_g", "_bucket"]).where(contained)
            steps = F.concat(F.array(_step(F.col("_held"), F.col("lo"), F.col("hi"))), F.col("path"))
            found = found.unionByName(joined.withColumn("path", steps).select(*found.columns))
        above = cut_lineage(found) if len(levels) > 1 and runs is not levels[0] else found
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, digest, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def manifest(df: DataFrame, fields: list[str], key: str, group: str, altered: dict[str, Column] | None = None) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (hash of all siblings up to the root), ``folded_root`` and ``verified``.

    ``altered`` maps fields to other values, as a later reader may find them: ``folded_root`` is what the altered row leads to
    with the siblings of the manifest, and ``verified`` says whether that is still the root.
    """
    leaf = field_hash([F.col(f) for f in fields])
    found = field_hash([(altered or {}).get(f, F.col(f)) for f in fields])
    digest = df.select(F.col(key).alias("_key"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_g"), leaf.alias("digest"), found.alias("_found"))
    rows = digest.select("_key", "_g", "digest", F.when(F.col("_found") != F.col("digest"), F.col("_found")).alias("found"))
    copies = rows.groupBy("_key", "_g", "digest", "found").agg(F.count("*").alias("copies"))
    leaves = _spread_copies(_placed(copies, ["_key", "digest"])).withColumns({"lo": F.col("rank"), "hi": F.col("rank")})
    leaves = cut_lineage(leaves)
    levels, ends = _levels(leaves, ["_key", "found"])

    # the tree above the subroots is built in the same way, as one group
    ends = cut_lineage(ends.withColumn("copies", F.lit(1).cast("long")))
    tops = _placed(ends.select(F.lit("").alias("_g"), F.col("_g").alias("_source"), "digest", "copies"), ["_source"])
    tops = cut_lineage(tops.withColumn("rank", F.col("at")).withColumns({"lo": F.col("rank"), "hi": F.col("rank")}).drop("at", "copies"))
    upper, root = _levels(tops, ["_source"])
    top = root.first()
    no_steps = F.expr("cast(array() as array<struct<before: string, after: string>>)")
    above = _with_paths(upper, tops.groupBy("_g").agg(F.count("*").alias("_n")).select("_g", no_steps.alias("path")))
    if above is None:
        starts = tops.select(F.col("_source").alias("_g"), no_steps.alias("path"), F.col("digest").alias("subroot"))
    else:
        starts = _children(above).select(F.col("child._source").alias("_g"), "path", F.col("child.digest").alias("subroot"))
    starts = cut_lineage(starts)

    lone = join_small(leaves.where("n = 1").select("_g", "_key", "digest", "found"), starts, ["_g"])
    placed = lone.select("_key", "digest", "found", "path", "subroot")
    runs = _with_paths(levels, starts)
    if runs is not None:
        placed = placed.unionByName(_children(runs).select("child._key", "child.digest", "child.found", "path", "subroot"))
    folded = placed.select(
        F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256).alias("proof_sha256"),
        fold(F.coalesce("found", "digest"), F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def _children(runs: DataFrame) -> DataFrame:
    """The members of runs, each with its whole path."""
    each = runs.withColumn("child", F.explode("children"))
    return each.withColumn("path", F.concat(F.array(_step(F.col("children"), F.col("child.lo"), F.col("child.hi"))), F.col("path")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
