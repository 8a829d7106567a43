"""Hard negatives: per anchor and positive, the best rows of other labels whose score lies below the positive's by a margin.

Scores are integer inner products of scaled vectors. A vector cut into segments is summarised by each segment's mean and deviation
(root of the summed squared differences from the mean): for one segment of m components the inner product is
``m * mean * mean'`` plus or minus at most ``deviation * deviation'``. Summaries of 1, 4 and 16 segments bound a score ever more closely;
a pair goes on to the next level only while its bounds reach what its anchor still looks for, and only the rest is scored exactly.

Anchors (a stated query set) meet the rows in blocks of bounded size: first rows of their own label, to find the positives, then the others. A
block hands on only its best rows for each anchor.

Cases: rows with a null key, label or vector, an empty vector, or a null or non-finite component take no part, nor do vectors with a scaled
component beyond 2^28, whose products an integer could not hold; vectors meet those of their own length; rows that repeat key, label
and vector count once; rows of the anchor's own key are never its partners; ties go to the smaller key; an empty table gives an
empty table; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.session import cut_lineage

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Bounds of a negative's score as percentages of the positive's.
LEAST, MOST = 50, 95
#: Rows and anchors that meet in one task, rows and pairs scored in one step, and segments by level.
BLOCK_ROWS, CHUNK_ANCHORS, STEP, PAIRS, SEGMENTS = 8_192, 4_096, 1_024, 65_536, (1, 4, 16)
_LARGEST, _EXACT = 2.0 ** 28, 2.0 ** 53


def usable(vector: Column, label: Column, key: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < _LARGEST / SCALE))
    return F.coalesce(fine & (F.size(vector) > 0) & label.isNotNull() & key.isNotNull(), F.lit(False))


def summaries(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: segment means times the root of the segment's length, and deviations, so that products need no factor."""
    out = []
    for n in SEGMENTS:
        n = min(n, v.shape[1])
        edges = np.linspace(0, v.shape[1], n + 1).astype(int)
        sizes = np.diff(edges)
        mean = np.add.reduceat(v, edges[:-1], axis=1) / sizes
        rest = v - np.repeat(mean, sizes, axis=1)
        out.append((mean * np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1))))
    return out


class Side:
    """Vectors of one side of a block with their summaries."""

    def __init__(self, table: pa.Table):
        self.n = table.num_rows
        self.key = table.column("key").to_numpy()
        self.mark = table.column("mark").to_numpy()
        self.label = table.column("label").to_numpy()
        vector = table.column("vector").combine_chunks()
        flat = (pa.concat_arrays(vector.chunks) if isinstance(vector, pa.ChunkedArray) else vector).flatten().to_numpy(zero_copy_only=False)
        self.v = np.floor(SCALE * flat.astype(np.float64).reshape(self.n, -1))

    def take(self, at: np.ndarray) -> "Side":
        out = object.__new__(Side)
        out.n, out.key, out.mark, out.label, out.v = len(at), self.key[at], self.mark[at], self.label[at], self.v[at]
        return out

    def distinct(self) -> "Side":
        seen: dict[tuple, int] = {}
        for i, name in enumerate(zip(self.key.tolist(), self.label.tolist(), self.mark.tolist())):
            seen.setdefault(name, i)
        return self if len(seen) == self.n else self.take(np.array(list(seen.values())))


def exact(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``a`` with rows ``j`` of ``x`` as integers; doubles hold them while sums stay below 2^53."""
    kind = np.float64 if a.size and x.size and np.abs(a).max() * np.abs(x).max() * a.shape[1] < _EXACT else np.int64
    if kind is np.float64 and len(i) * 4 > len(a) * len(x):
        return (a @ x.T)[i, j].astype(np.int64)
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        out[part] = np.einsum("ij,ij->i", a[i[part]].astype(kind), x[j[part]].astype(kind)).astype(np.int64)
    return out


def reaching(a: list, x: list, least: np.ndarray, most: np.ndarray, counts: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose bounds at every level meet the anchor's [least, most]."""
    rows, cols = np.arange(len(least)), np.arange(len(x[0][0]))
    pairs = None
    for (mean_a, dev_a), (mean_x, dev_x) in zip(a, x):
        if pairs is None or len(pairs[0]) * 4 > len(rows) * len(cols):
            # many are left: all at once
            middle, width = mean_a[rows] @ mean_x[cols].T, dev_a[rows] @ dev_x[cols].T
            slack = 1e-9 * (np.abs(middle) + width) + 1e-6
            keep = (middle + width + slack >= least[rows, None]) & (middle - width - slack <= most[rows, None])
            if pairs is not None:
                open_ = np.zeros(keep.shape, bool)
                open_[np.searchsorted(rows, pairs[0]), np.searchsorted(cols, pairs[1])] = True
                keep &= open_
            i, j = np.nonzero(keep)
            pairs = rows[i], cols[j]
        else:
            i, j = pairs
            middle, width = np.einsum("ij,ij->i", mean_a[i], mean_x[j]), np.einsum("ij,ij->i", dev_a[i], dev_x[j])
            slack = 1e-9 * (np.abs(middle) + width) + 1e-6
            keep = (middle + width + slack >= least[i]) & (middle - width - slack <= most[i])
            pairs = i[keep], j[keep]
        rows, cols = np.unique(pairs[0]), np.unique(pairs[1])
        if counts is not None:
            counts.append(len(pairs[0]))
        if not len(rows):
            break
    return pairs


class Best:
    """The best k rows so far of each slot: score falling, then key and mark rising."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.rows = [np.zeros(0, np.int64)] * 4  # slot, score, key, mark

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray, mark: np.ndarray) -> None:
        if not len(slot):
            return
        rows = [np.concatenate(c) for c in zip(self.rows, (slot, score, key, mark))]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [c[order] for c in rows]
        first = np.searchsorted(rows[0], rows[0])
        keep = np.arange(len(order)) - first < self.k
        self.rows = [c[keep] for c in rows]

    def worst(self) -> np.ndarray:
        """Per slot the score that a further row must reach; minus infinity while there are fewer than k."""
        out = np.full(self.slots, -np.inf)
        slot, score = self.rows[:2]
        full = np.bincount(slot, minlength=self.slots) >= self.k
        last = np.searchsorted(slot, np.arange(self.slots), "right") - 1
        out[full] = score[last[full]]
        return out


def _sides(df: DataFrame, chunks: int, blocks: int, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of every (width, chunk, block); rows of a block are there once for each chunk of anchors."""
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # columns of their own, since both sides come from one table
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("_chunk", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(chunks))).withColumn("_block", every(blocks))
    right = df.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("_chunk", every(chunks))
    return left, right


_MEET = ["_width", "_chunk", "_block"]


def _positives(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        if a.num_rows and b.num_rows:
            anchors, rows = Side(a).distinct(), Side(b).distinct()
            for label in np.unique(anchors.label):
                own, others = anchors.take(np.flatnonzero(anchors.label == label)), rows.take(np.flatnonzero(rows.label == label))
                best, summed = Best(own.n, k), summaries(own.v)
                for at in range(0, others.n, STEP):
                    x = others.take(np.arange(at, min(at + STEP, others.n)))
                    i, j = reaching(summed, summaries(x.v), best.worst(), np.full(own.n, np.inf))
                    fit = own.key[i] != x.key[j]
                    i, j = i[fit], j[fit]
                    best.add(i, exact(own.v, x.v, i, j), x.key[j], x.mark[j])
                slot, score, key, mark = best.rows
                for column, values in zip(out, (own.key[slot], own.mark[slot], own.label[slot], key, mark, score)):
                    column.append(values)
        made = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(m.astype(np.int64)) for m in made], names=["key", "mark", "label", "positive", "positive_mark", "score"])

    schema = "key bigint, mark bigint, label bigint, positive bigint, positive_mark bigint, score bigint"
    found = left.groupBy(*_MEET).cogroup(right.groupBy(*_MEET)).applyInArrow(meet, schema)
    order = Window.partitionBy("key", "mark", "label").orderBy(F.desc("score"), "positive", "positive_mark")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _negatives(left: DataFrame, right: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """``left`` has the positives of each anchor as an array, best first."""
    names = ["key", "mark", "label", "place", "positive", "positive_score", "negative", "negative_mark", "score"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if a.num_rows and b.num_rows:
            anchors, rows = Side(a), Side(b).distinct()
            given = a.column("positives").to_pylist()
            for label in np.unique(anchors.label):
                at_own = np.flatnonzero(anchors.label == label)
                own, others = anchors.take(at_own), rows.take(np.flatnonzero(rows.label != label))
                wide = max(len(given[i]) for i in at_own)
                scores, ids = np.zeros((own.n, wide), np.int64), np.zeros((own.n, wide), np.int64)
                lo, hi = np.full((own.n, wide), np.inf), np.full((own.n, wide), -np.inf)
                for r, i in enumerate(at_own.tolist()):
                    for p, one in enumerate(given[i]):
                        scores[r, p], ids[r, p] = one["score"], one["positive"]
                        # whole scores: round the bounds inwards
                        lo[r, p], hi[r, p] = -(-least * one["score"] // 100), most * one["score"] // 100
                best, summed = [Best(own.n, k) for _ in range(wide)], summaries(own.v)
                for at in range(0, others.n, STEP):
                    x = others.take(np.arange(at, min(at + STEP, others.n)))
                    wanted = np.maximum(lo, np.stack([h.worst() for h in best], 1))
                    wanted[wanted > hi] = np.inf
                    top = np.where(np.isfinite(wanted), hi, -np.inf).max(1)
                    i, j = reaching(summed, summaries(x.v), wanted.min(1), top)
                    fit = own.key[i] != x.key[j]
                    i, j = i[fit], j[fit]
                    score = exact(own.v, x.v, i, j)
                    for p in range(wide):
                        inside = (score >= wanted[i, p]) & (score <= hi[i, p])
                        best[p].add(i[inside], score[inside], x.key[j[inside]], x.mark[j[inside]])
                for p, held in enumerate(best):
                    slot, score, key, mark = held.rows
                    for column, values in zip(out, (own.key[slot], own.mark[slot], own.label[slot], np.full(len(slot), p + 1), ids[slot, p], scores[slot, p], key, mark, score)):
                        column.append(values)
        made = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.table([pa.array(m.astype(np.int64)) for m in made], names=names)

    found = left.groupBy(*_MEET).cogroup(right.groupBy(*_MEET)).applyInArrow(meet, ", ".join(f"{n} bigint" for n in names))
    order = Window.partitionBy("key", "mark", "label", "place").orderBy(F.desc("score"), "negative", "negative_mark")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
         negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block_rows: int = BLOCK_ROWS, chunk_anchors: int = CHUNK_ANCHORS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    An anchor's positives are its best ``positives`` other rows of the same label; for each, the best ``negatives`` rows of other labels with
    ``least * positive_score <= 100 * negative_score <= most * positive_score``.
    """
    rows = df.where(usable(F.col(vector), F.col(label), F.col(key))).select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"),
        F.xxhash64(F.col(vector)).alias("mark"), F.size(vector).alias("_width"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    rows = cut_lineage(rows)
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("_anchor"), 1)).alias("anchors")).first()
    blocks, chunks = max(1, -(-counted["n"] // block_rows)), max(1, -(-counted["anchors"] // chunk_anchors))
    plain = rows.drop("_anchor")
    anchors = rows.where("_anchor").drop("_anchor")
    found = cut_lineage(_positives(*_sides(plain, chunks, blocks, anchors), positives))
    lists = found.groupBy("key", "mark", "label").agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("positives"))
    with_positives = anchors.dropDuplicates(["key", "mark", "label"]).join(lists, ["key", "mark", "label"])
    left, right = _sides(plain, chunks, blocks, with_positives)
    hits = _negatives(left, right, negatives, least, most)
    return hits.select(F.col("key").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                       F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
