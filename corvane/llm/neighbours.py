"""Approximate nearest neighbours by collision counting.

Vectors are projected on single random directions; per direction a block of vectors is one sorted array. A query opens a window
around its own projection in every array. Vectors inside the window collide with the query; windows widen together (virtual
rehashing: no new index for a larger radius) until enough vectors collide in a given share of the directions. Those, and only
those, are scored exactly.

Inner products are searched as distances: a vector gets one more component that brings all norms to the largest one, a query is
scaled to that norm, and the nearest vector is then the one with the largest inner product.

Every vector is indexed. Blocks and query chunks have a fixed size, each pair of them is one row of work, and a pair hands on
``k`` rows a query; nothing grows with the table in one task, and no block depends on a key.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as queries or candidates; a
shorter vector counts as padded with zeros; a query's own id is no candidate, repeated rows of other ids are each one; ties go
to the smaller id; fewer candidates than ``k`` are all returned; an empty table or no queries give an empty result; other input
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.session import cut_lineage

#: Directions, rows of a block and of a query chunk.
DIRECTIONS, BLOCK_ROWS, CHUNK_ROWS = 64, 8192, 1024
#: Share of the directions in which a vector must collide, and share of a block that must do so before windows stop widening.
COLLIDE, ENOUGH = 0.6, 0.15
#: Half width of the first window in standard deviations of the projections, and the factor of each widening.
FIRST, WIDEN = 0.7, 1.12
SEED = 20240501


def usable(vector: Column) -> Column:
    """No null, NaN or infinity inside, and not all zeros."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(width: int, count: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    """``count`` random unit directions, orthogonal within each run of ``width``."""
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < count:
        parts.append(np.linalg.qr(rng.standard_normal((width, width)))[0])
    return np.concatenate(parts, axis=1)[:, :count]


def _packed(df: DataFrame, rows: int, total: int, width: int, name: str) -> DataFrame:
    """One row per ``rows`` vectors: ids and a matrix of ``width`` columns, as bytes, with a dense number ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                matrix = np.zeros((part.num_rows, width))
                matrix[np.repeat(np.arange(part.num_rows), sizes), np.concatenate([np.arange(n) for n in sizes])] = lists.flatten().to_numpy()
                yield pa.RecordBatch.from_pydict({"ids": [part.column(0).to_numpy().astype("<i8").tobytes()], "matrix": [matrix.tobytes()]})

    packed = df.repartition(max(1, -(-total // rows))).mapInArrow(run, "ids binary, matrix binary")
    numbered = cut_lineage(packed).rdd.zipWithIndex().map(lambda x: (x[1], bytes(x[0][0]), bytes(x[0][1])))
    return df.sparkSession.createDataFrame(numbered, f"{name} long, {name}_ids binary, {name}_matrix binary")


def collisions(order: np.ndarray, values: np.ndarray, centres: np.ndarray, first: float, need: int, least: int) -> list[np.ndarray]:
    """For each query the numbers of the vectors that collide with it in at least ``least`` directions.

    ``values[j]`` is the sorted array of direction j and ``order[j]`` the vectors in that order. Windows widen from the query's
    projection outwards until ``need`` vectors collide often enough or all arrays are used up; a step counts only what it adds.
    """
    m, n = values.shape
    counts = np.zeros((len(centres), n), np.int16)
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(centres)
    pending, half = np.arange(len(centres)), first
    low = np.column_stack([np.searchsorted(values[j], centres[:, j]) for j in range(m)])
    high = low
    rows = list(order)
    while len(pending):
        at = centres[pending]
        wide_low = np.column_stack([np.searchsorted(values[j], at[:, j] - half, "left") for j in range(m)])
        wide_high = np.column_stack([np.searchsorted(values[j], at[:, j] + half, "right") for j in range(m)])
        more = []
        for i, q in enumerate(pending.tolist()):
            a, b, c, d = (x.tolist() for x in (wide_low[i], low[i], high[i], wide_high[i]))
            added = [r[s:e] for r, s, e in zip(rows, a, b) if s < e] + [r[s:e] for r, s, e in zip(rows, c, d) if s < e]
            if added:
                counts[q] += np.bincount(np.concatenate(added), minlength=n).astype(np.int16)
            hits = np.flatnonzero(counts[q] >= least)
            if len(hits) >= need or (max(a) == 0 and min(d) == n):
                found[q] = hits
            else:
                more.append(i)
        pending, low, high, half = pending[more], np.minimum(wide_low, low)[more], np.maximum(wide_high, high)[more], half * WIDEN
    return found


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: for each query row the ``k`` nearest found among all other rows."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where(
        F.col("id").isNotNull() & usable(F.col("v")))
    facts = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    total, asked, width, top = facts[0], facts[1] or 0, facts[2] or 1, float(np.sqrt(facts[3] or 1.0))
    index = _packed(rows.select("id", "v"), BLOCK_ROWS, total, width, "block")
    chunks = _packed(rows.where("q").select("id", "v"), CHUNK_ROWS, asked, width, "chunk")
    n_blocks, n_chunks = index.count(), chunks.count()
    if not n_blocks or not n_chunks:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # every pair of a block and a chunk is one row, met by an equi-join on both numbers
    pairs = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1).cast("long")))).join(
        chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1).cast("long")))), ["block", "chunk"])
    least = int(np.ceil(COLLIDE * DIRECTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = directions(width + 1)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, query_ids = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i8") for c in ("block_ids", "chunk_ids"))
                x, q = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(-1, width) for c in ("block_matrix", "chunk_matrix"))
                lift = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))
                values = (np.column_stack([x, lift]) @ axes).T
                order = np.argsort(values, axis=1)
                values = np.take_along_axis(values, order, axis=1)
                first = FIRST * float(values.std(axis=1).mean()) or 1.0
                centres = (q / np.sqrt((q * q).sum(axis=1))[:, None] * top) @ axes[:width]
                need = min(len(x), max(10 * k, int(np.ceil(ENOUGH * len(x)))))
                out: list[list] = [[], [], []]
                for i, found in enumerate(collisions(order, values, centres, first, need, least)):
                    found = found[ids[found] != query_ids[i]]
                    scores = x[found] @ q[i]
                    best = np.lexsort((ids[found], -scores))[:k]
                    for column, part in zip(out, (np.full(len(best), query_ids[i]), ids[found][best], scores[best])):
                        column.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    tasks = max(1, min(n_blocks * n_chunks, 4 * df.sparkSession.sparkContext.defaultParallelism))
    found = pairs.repartition(max(tasks, -(-n_blocks * n_chunks // 8)), "block", "chunk").mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
