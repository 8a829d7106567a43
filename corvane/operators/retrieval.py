"""Exact top-k retrieval of library rows for query rows.

The reference scans the whole library for every query and keeps ``k``. The same
exhaustive, exact answer is produced here without ever materialising a pair:
two blocks of rows meet in one task, NumPy scores them and only the block's
best ``k`` per query leave it; a final ``row_number`` merges the blocks.

How the blocks meet depends on measured sizes:

* library small  -> it is broadcast, queries stream past it, no shuffle at all;
* queries small  -> they are broadcast, library partitions stream past them and
  each partition emits at most ``k`` rows per query;
* neither small  -> both sides are hashed into tiles of bounded size, every
  (query tile, library tile) pair is one co-group.

Inside a task the library rows are arranged so that most of them need no score.
For bit sets: ordered by bit count, in runs with the range of their counts and
the union of their bits; two sets share at most the query's bits in the union.
For vectors: in runs around sampled rows (pivots) with their widest angle; by
the triangle inequality a query is at least its angle to the pivot less that
width away. A run is scored only for queries whose k-th best score so far its
bound can reach, so results are those of scoring everything. Vectors are scored
in single precision first; pairs that reach the k-th best within its error are
scored again in double precision, and only those scores count. The same holds
for the hybrid once ``k`` rows are held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.hashing import md5_mod
from corvane.operators.ordered import dense_index
from corvane.session import cut_lineage

BROADCAST_BYTES = 64 * 1024 * 1024
TILE_ROWS, LIBRARY_TILE = 32_768, 4  # query rows of a tile; its library rows are so many times as many
TILE_BYTES = 128 * 1024 * 1024  # one side of one tile
SCORE_CELLS = 4_000_000  # scores held at once inside a task
SCORE_DIGITS = 12  # blocks of other shapes add up in another order; beyond these digits scores count as equal
LIBRARY_STEP = 8_192  # library rows scored at once inside a task
RUN_ROWS, RUN_QUERIES = 256, 512  # library rows and queries that share a bound
PIVOTS = 64
SCREEN_QUERIES = 1_024  # queries screened together
SCREEN_ROWS = 512  # library rows whose hybrid scores are screened at once, in a core's cache


# ---- scoring of two blocks --------------------------------------------------


def _ready(block: dict) -> dict:
    """Unit vectors and unpacked bits of a block of rows."""
    out = dict(block)
    if "vec" in block:
        v = block["vec"].astype(np.float64)
        out["vec"] = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)
    if "fp" in block:
        raw = np.ascontiguousarray(block["fp"].astype(np.int64)).view(np.uint8)
        out["fp"] = np.unpackbits(raw, axis=1).astype(np.float32)
        out["on"] = out["fp"].sum(1, dtype=np.float64)
    return out


def _rows(block: dict, part) -> dict:
    return {c: m[part] for c, m in block.items()}


def _cosine_block(q: dict, lib: dict) -> np.ndarray:
    return q["vec"] @ lib["vec"].T


def _tanimoto_block(q: dict, lib: dict) -> np.ndarray:
    both = (q["fp"] @ lib["fp"].T).astype(np.float64)
    return both / np.maximum(q["on"][:, None] + lib["on"][None, :] - both, 1.0)


def _hybrid_block(q: dict, lib: dict) -> np.ndarray:
    mean_c, std_c, mean_t, std_t = q["stats"].T
    z_cos = (_cosine_block(q, lib) - mean_c[:, None]) / (std_c[:, None] + 1e-9)
    z_tan = (_tanimoto_block(q, lib) - mean_t[:, None]) / (std_t[:, None] + 1e-9)
    return z_cos + z_tan


def _pieces(q_ids: np.ndarray, q: dict, l_ids: np.ndarray, lib: dict):
    """Both sides in pieces small enough to score: the library by id, then the queries."""
    by_id = np.argsort(l_ids, kind="stable")
    for b in range(0, len(l_ids), LIBRARY_STEP):
        here = by_id[b:b + LIBRARY_STEP]
        ids, ready = l_ids[here], _ready(_rows(lib, here))
        step = max(1, SCORE_CELLS // len(ids))
        for a in range(0, len(q_ids), step):
            part = slice(a, a + step)
            yield part, _ready(_rows(q, part)), ids, ready


# ---- per-task accumulators --------------------------------------------------


def _bit_runs(lib: dict) -> list[tuple[np.ndarray, tuple]]:
    """Rows by bit count in runs, each with its least and largest count and the union of its bits."""
    words = np.ascontiguousarray(lib["fp"].astype(np.int64)).view(np.uint64)
    on = np.bitwise_count(words).sum(1, dtype=np.int64)
    order = np.argsort(on, kind="stable")
    runs = [order[a:a + RUN_ROWS] for a in range(0, len(order), RUN_ROWS)]
    return [(r, (on[r[0]], on[r[-1]], np.bitwise_or.reduce(words[r]))) for r in runs]


def _bit_bound(q: dict, summary: tuple) -> np.ndarray:
    least, most, union = summary
    words = np.ascontiguousarray(q["fp"].astype(np.int64)).view(np.uint64)
    on = np.bitwise_count(words).sum(1, dtype=np.int64)
    shared = np.minimum(np.bitwise_count(words & union).sum(1, dtype=np.int64), most)
    return shared / np.maximum(on + np.maximum(least, shared) - shared, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12)


def _pivot_runs(unit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Rows by nearest pivot in runs, the pivots, and for each run its pivot and the widest angle to it."""
    n = len(unit)
    pivots = unit[np.linspace(0, n - 1, min(PIVOTS, max(1, n // 32))).astype(int)]
    nearest, cosine = np.empty(n, np.int64), np.empty(n)
    for a in range(0, n, LIBRARY_STEP):
        s = unit[a:a + LIBRARY_STEP] @ pivots.T
        nearest[a:a + LIBRARY_STEP], cosine[a:a + LIBRARY_STEP] = s.argmax(1), s.max(1)
    order = np.lexsort((-cosine, nearest))
    begins = np.searchsorted(nearest[order], np.arange(len(pivots) + 1))
    runs = [(p, order[a:min(a + RUN_ROWS, begins[p + 1])]) for p in range(len(pivots)) for a in range(begins[p], begins[p + 1], RUN_ROWS)]
    return [r for _, r in runs], pivots, np.array([p for p, _ in runs]), np.arccos(np.clip([cosine[r].min() for _, r in runs], -1, 1))


def _true_places(hits: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a block that is nearly all false, eight cells at a time."""
    flat = hits.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64))
    at, place = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[at] * 8 + place


_NONE = 1e-30  # bits of a row without any, where they are a divisor
_SLACK = 1e-7  # angles of nearly equal vectors are good to about half the digits of a cosine


class _Best:
    """Running best ``k`` per query; equal scores go to the lower library id."""

    def __init__(self, score, k: int, exclude_self: bool):
        self.score, self.k, self.exclude_self = score, k, exclude_self
        self.scores: np.ndarray | None = None
        self.ids: np.ndarray | None = None
        self.scored = 0  # pairs that were scored

    def absorb(self, q_ids: np.ndarray, q: dict, l_ids: np.ndarray, lib: dict) -> None:
        if self.scores is None:
            self.scores = np.full((len(q_ids), self.k), -np.inf)
            self.ids = np.full((len(q_ids), self.k), np.iinfo(np.int64).max)
        if self.score is _cosine_block and len(l_ids):
            return self._absorb_vectors(q_ids, q["vec"], l_ids, lib["vec"])
        if self.score is _tanimoto_block and len(l_ids):
            runs = [(r[np.argsort(l_ids[r], kind="stable")], summary) for r, summary in _bit_runs(lib)]
            for a in range(0, len(q_ids), RUN_QUERIES):
                part = np.arange(a, min(a + RUN_QUERIES, len(q_ids)))
                raw = _rows(q, part)
                mine = _ready(raw)
                most = np.stack([_bit_bound(raw, summary) for _, summary in runs], 1) + _SLACK
                # promising runs first: they raise what the others must reach
                for r in np.argsort(-most.mean(0), kind="stable"):
                    need = np.flatnonzero(most[:, r] >= self.scores[part, -1])
                    if len(need):
                        here = runs[r][0]  # unpacked bits are 32 times the words and made by run
                        self._take(part[need], q_ids[part[need]], _rows(mine, need) if len(need) < len(part) else mine, l_ids[here], _ready(_rows(lib, here)))
            return
        for part, q_part, ids, lib_part in _pieces(q_ids, q, l_ids, lib):
            at, begin = np.arange(len(q_ids))[part], 0
            if self.score is _hybrid_block:
                while begin < len(ids) and not np.isfinite(self.scores[at, -1]).all():
                    some = slice(begin, begin + 2 * SCREEN_ROWS)
                    self._take(at, q_ids[part], q_part, ids[some], _rows(lib_part, some))
                    begin += 2 * SCREEN_ROWS
                if begin < len(ids):
                    some = slice(begin, None)
                    self._screen_hybrid(at, q_ids, q_part, ids[some], _rows(lib_part, some))
                continue
            self._take(at, q_ids[part], q_part, ids, lib_part)

    def _screen_hybrid(self, at: np.ndarray, q_ids: np.ndarray, q: dict, ids: np.ndarray, lib: dict) -> None:
        """Hybrid scores in single precision, divided by the weight of the Tanimoto score and without what is the same for a query;
        pairs that reach the k-th best within the error are scored again."""
        mean_c, std_c, mean_t, std_t = q["stats"].T
        per_c, per_t = 1 / (std_c + 1e-9), 1 / (std_t + 1e-9)
        ratio, same = per_c / per_t, mean_c * per_c + mean_t * per_t
        # twice the error of the products and of the few sums and quotients
        off = (q["vec"].shape[1] + 16) * 2.0 ** -23 * (1 + ratio) + 10.0 ** -SCORE_DIGITS / per_t
        vec, fp, on = (q["vec"] * ratio[:, None]).astype(np.float32), q["fp"], q["on"].astype(np.float32)[:, None]
        lib_vec, lib_fp, lib_on = lib["vec"].astype(np.float32).T, lib["fp"].T, np.maximum(lib["on"], _NONE).astype(np.float32)
        room = np.empty((3, len(at) * min(SCREEN_ROWS, len(ids))), np.float32)

        def exact(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            cosine = np.einsum("ij,ij->i", q["vec"][rows], lib["vec"][cols])
            both = np.einsum("ij,ij->i", fp[rows], lib["fp"][cols]).astype(np.float64)
            tanimoto = both / np.maximum(q["on"][rows] + lib["on"][cols] - both, 1.0)
            return (cosine - mean_c[rows]) / (std_c[rows] + 1e-9) + (tanimoto - mean_t[rows]) / (std_t[rows] + 1e-9)

        rows, cols, held, floor = [], [], 0, None
        for a in range(0, len(ids), SCREEN_ROWS):
            here = slice(a, a + SCREEN_ROWS)
            if floor is None:
                floor = ((self.scores[at, -1] + same) / per_t - off).astype(np.float32)[:, None]
            n = len(lib_on[here])
            score, both, rest = (r[:len(at) * n].reshape(len(at), n) for r in room)
            np.matmul(vec, lib_vec[:, here], out=score)
            np.matmul(fp, lib_fp[:, here], out=both)
            np.add(on, lib_on[here], out=rest)
            np.subtract(rest, both, out=rest)
            np.divide(both, rest, out=both)
            np.add(score, both, out=score)
            flat = _true_places(score >= floor)
            self.scored += score.size
            if len(flat):
                row, col = np.divmod(flat, n)
                rows.append(row)
                cols.append(col + a)
                held += len(flat)
            if held and (held > 2 * self.k * len(at) or a + SCREEN_ROWS >= len(ids)):
                self._keep(at, q_ids, np.concatenate(rows), np.concatenate(cols), ids, exact)
                rows, cols, held, floor = [], [], 0, None

    def _absorb_vectors(self, q_ids: np.ndarray, q: np.ndarray, l_ids: np.ndarray, lib: np.ndarray) -> None:
        unit = _unit(lib)
        runs, pivots, pivot_of, width = _pivot_runs(unit)
        runs = [r[np.argsort(l_ids[r], kind="stable")] for r in runs]
        # the rows of a run lie side by side
        order = np.concatenate(runs)
        begins = np.cumsum([0] + [len(r) for r in runs])
        ids, unit = l_ids[order], unit[order]
        single = unit.astype(np.float32)
        # products of unit vectors in single precision are off by less than half of this
        off = (unit.shape[1] + 8) * 2.0 ** -23 + 10.0 ** -SCORE_DIGITS
        for a in range(0, len(q_ids), SCREEN_QUERIES):
            part = np.arange(a, min(a + SCREEN_QUERIES, len(q_ids)))
            mine = _unit(q[part])
            mine_single = mine.astype(np.float32)
            away = (np.arccos(np.clip(mine @ pivots.T, -1, 1))[:, pivot_of] - width).T.copy()
            kth = self.scores[part, -1]
            rows, cols, held, since, seen = [], [], 0, 0, 0  # library rows since pairs were last kept, and before
            # promising runs first: they raise what the others must reach
            for r in np.argsort(away.mean(1), kind="stable"):
                if held and (since >= seen or held > 4 * self.k * len(part)):
                    self._keep(part, q_ids, np.concatenate(rows), np.concatenate(cols), ids, lambda r, c: np.einsum("ij,ij->i", mine[r], unit[c]))
                    rows, cols, held, since, seen = [], [], 0, 0, seen + since
                    kth = self.scores[part, -1]
                near = away[r] <= np.arccos(np.clip(kth - _SLACK, -1, 1))
                n = np.count_nonzero(near)
                if not n:
                    continue
                # a few more queries cost less than picking the others
                need = np.arange(len(part)) if 4 * n > 3 * len(part) else np.flatnonzero(near)
                whole = len(need) == len(part)
                here = slice(begins[r], begins[r + 1])
                size = len(need) * (begins[r + 1] - begins[r])
                if np.isfinite(kth[need]).all():
                    floor = (kth[need] - off).astype(np.float32)
                    flat = _true_places((mine_single if whole else mine_single[need]) @ single[here].T >= floor[:, None])
                    since += begins[r + 1] - begins[r]
                    if len(flat) <= size // 16:
                        self.scored += size
                        if len(flat):
                            row, col = np.divmod(flat, begins[r + 1] - begins[r])
                            rows.append(need[row])
                            cols.append(col + begins[r])
                            held += len(flat)
                        continue
                else:
                    seen += begins[r + 1] - begins[r]
                # fewer than k are held, or many are equal
                self._take(part[need], q_ids[part[need]], {"vec": mine if whole else mine[need]}, ids[here], {"vec": unit[here]})
                kth = self.scores[part, -1]
            if held:
                self._keep(part, q_ids, np.concatenate(rows), np.concatenate(cols), ids, lambda r, c: np.einsum("ij,ij->i", mine[r], unit[c]))

    def _keep(self, part: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, exact) -> None:
        """Scores pairs of queries ``part[rows]`` and library rows ``cols`` in double precision and keeps the best ``k`` of them and those held."""
        value = np.empty(len(rows))
        for a in range(0, len(rows), LIBRARY_STEP):
            some = slice(a, a + LIBRARY_STEP)
            value[some] = exact(rows[some], cols[some])
        value = np.round(value, SCORE_DIGITS)
        good = value >= self.scores[part[rows], -1]
        if self.exclude_self:
            good &= q_ids[part[rows]] != ids[cols]
        rows, value, found = rows[good], value[good], ids[cols[good]]
        names = np.unique(rows)
        at = part[names]
        of = np.concatenate([np.repeat(np.arange(len(names)), self.k), np.searchsorted(names, rows)])
        value = np.concatenate([self.scores[at].ravel(), value])
        found = np.concatenate([self.ids[at].ravel(), found])
        order = np.lexsort((found, -value, of))
        best = order[(np.searchsorted(of[order], np.arange(len(names)))[:, None] + np.arange(self.k))]
        self.scores[at], self.ids[at] = value[best], found[best]

    def _take(self, at: np.ndarray, q_ids: np.ndarray, q: dict, ids: np.ndarray, lib: dict) -> None:
        s = self.score(q, lib)
        self.scored += s.size
        # once k are held, few scores reach the least of them: only those are rounded and sorted
        hits = s >= (self.scores[at, -1] - 10.0 ** -SCORE_DIGITS)[:, None]
        flat = np.flatnonzero(hits)
        n = np.bincount(flat // len(ids), minlength=len(s))
        some = np.flatnonzero(n)
        if not len(some):
            return
        if n.max() > 2 * self.k:
            if len(some) < len(s):
                s, at, q_ids = s[some], at[some], q_ids[some]
            s = np.round(s, SCORE_DIGITS)
            if self.exclude_self:
                s = np.where(q_ids[:, None] == ids[None, :], -np.inf, s)
            new_s, new_i = self._top(s, ids)
        else:
            row, col = np.divmod(flat, len(ids))
            value = np.round(s[row, col], SCORE_DIGITS)
            if self.exclude_self:
                value[q_ids[row] == ids[col]] = -np.inf
            place = np.arange(len(row)) - np.repeat((np.cumsum(n) - n)[some], n[some])
            row = np.searchsorted(some, row)
            at = at[some]
            new_s = np.full((len(some), n.max()), -np.inf)
            new_i = np.full(new_s.shape, np.iinfo(np.int64).max)
            new_s[row, place], new_i[row, place] = value, ids[col]
        all_s = np.hstack([self.scores[at], new_s])
        all_i = np.hstack([self.ids[at], new_i])
        order = np.lexsort((all_i, -all_s), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(all_s, order, 1)
        self.ids[at] = np.take_along_axis(all_i, order, 1)

    def _top(self, s: np.ndarray, l_ids: np.ndarray):
        if s.shape[1] <= self.k:
            return s, np.broadcast_to(l_ids, s.shape)
        kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k][:, None]
        above, ties = s > kth, s == kth
        keep = above | (ties & (np.cumsum(ties, 1) <= self.k - above.sum(1, keepdims=True)))
        cols = np.nonzero(keep)[1].reshape(len(s), self.k)
        return np.take_along_axis(s, cols, 1), l_ids[cols]

    def emit(self, q_ids: np.ndarray) -> pa.RecordBatch:
        if self.scores is None:
            return self._batch(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        real = np.isfinite(self.scores)
        rows = np.nonzero(real)[0]
        return self._batch(q_ids[rows], self.ids[real], self.scores[real])

    @staticmethod
    def _batch(q, l, s) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(l, pa.int64()), pa.array(s, pa.float64())], ["query_id", "lib_id", "score"]
        )

    schema = "query_id bigint, lib_id bigint, score double"


class _Moments:
    """Count, sums and sums of squares of the cosine and the Tanimoto score per query."""

    names = ["n", "sum_c", "sq_c", "sum_t", "sq_t"]
    schema = "query_id bigint, " + ", ".join(f"{n} double" for n in names)

    def __init__(self, exclude_self: bool):
        self.exclude_self, self.acc = exclude_self, None

    def absorb(self, q_ids, q, l_ids, lib) -> None:
        if self.acc is None:
            self.acc = np.zeros((len(q_ids), 5))
        # sums of cosines are products with sums over the library: no pair is needed
        for b in range(0, len(l_ids), LIBRARY_STEP):
            unit = _unit(lib["vec"][b:b + LIBRARY_STEP])
            total, products = unit.sum(0), unit.T @ unit
            for a in range(0, len(q_ids), LIBRARY_STEP):
                mine = _unit(q["vec"][a:a + LIBRARY_STEP])
                self.acc[a:a + LIBRARY_STEP, 1] += mine @ total
                self.acc[a:a + LIBRARY_STEP, 2] += np.einsum("ij,ij->i", mine @ products, mine)
        by_id = np.argsort(l_ids, kind="stable")
        for part, q_part, ids, lib_part in _pieces(q_ids, q, l_ids, lib):
            acc, n_queries = self.acc[part], len(q_ids[part])
            room, single = (np.empty((m, n_queries * min(SCREEN_ROWS, len(ids))), kind) for m, kind in ((2, np.float64), (1, np.float32)))
            q_on, lib_on = q_part["on"][:, None], np.maximum(lib_part["on"], _NONE)
            for a in range(0, len(ids), SCREEN_ROWS):
                here = slice(a, a + SCREEN_ROWS)
                rest, t, both = (r[:n_queries * len(ids[here])].reshape(n_queries, -1) for r in (*room, *single))
                np.matmul(q_part["fp"], lib_part["fp"][here].T, out=both)
                np.add(q_on, lib_on[here], out=rest)
                np.subtract(rest, both, out=rest)
                np.divide(both, rest, out=t)
                acc[:, 3] += t.sum(1)
                acc[:, 4] += np.einsum("ij,ij->i", t, t)
        self.acc[:, 0] += len(l_ids)
        if self.exclude_self:
            # library rows of the query's own id are taken out again
            begin, end = (np.searchsorted(l_ids[by_id], q_ids, side) for side in ("left", "right"))
            rows = np.repeat(np.arange(len(q_ids)), end - begin)
            cols = by_id[np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange(len(rows))]
            for b in range(0, len(rows), LIBRARY_STEP):
                r, own, other = rows[b:b + LIBRARY_STEP], _ready(_rows(q, rows[b:b + LIBRARY_STEP])), _ready(_rows(lib, cols[b:b + LIBRARY_STEP]))
                c = np.einsum("ij,ij->i", own["vec"], other["vec"])
                both = np.einsum("ij,ij->i", own["fp"], other["fp"]).astype(np.float64)
                t = both / np.maximum(own["on"] + other["on"] - both, 1.0)
                np.subtract.at(self.acc, r, np.stack([np.ones(len(r)), c, c * c, t, t * t], 1))

    def emit(self, q_ids) -> pa.RecordBatch:
        acc = self.acc if self.acc is not None else np.zeros((0, 5))
        ids = q_ids if self.acc is not None else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64())] + [pa.array(acc[:, i]) for i in range(5)], ["query_id", *self.names]
        )


# ---- moving the blocks ------------------------------------------------------


def _read(table, id_col: str, cols: list[str]):
    ids = np.asarray(table.column(id_col).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch)
                     else table.column(id_col).to_numpy(), dtype=np.int64)
    out = {}
    for c in cols:
        col = table.column(c)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
        flat = col.flatten().to_numpy(zero_copy_only=False)
        out[c] = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    return ids, out


def usable(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose arrays are all there and hold only finite numbers; the others have no neighbours and are none.

    Repair vectors first (``vectors.repair``) to keep such rows.
    """
    def fine(c: str) -> Column:
        if df.schema[c].dataType.elementType.typeName() in ("float", "double"):
            whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        else:
            whole = F.forall(c, lambda x: x.isNotNull()) if df.schema[c].dataType.containsNull else F.col(c).isNotNull()
        return F.coalesce(whole & (F.size(c) > 0), F.lit(False))

    return df.where(reduce(lambda a, b: a & b, [fine(c) for c in cols]))


def _measure(df: DataFrame, cols: list[str], limit_bytes: int) -> tuple[bool, int]:
    """Whether a side is known to be within ``limit_bytes``, and the bytes of one row.

    ``take`` stops as soon as it has seen one row too many, so a huge side costs
    a few input partitions, and only row widths travel, never vectors.
    """
    width = sum((F.size(c) for c in cols[1:]), F.size(cols[0]))
    widths = df.select((width * 8).alias("w"))
    first = widths.take(1)
    if not first:
        return True, 8
    row = max(8, first[0]["w"])
    most = limit_bytes // row + 1
    seen = widths.take(most)
    return len(seen) < most and sum(r["w"] for r in seen) <= limit_bytes, row


def _meet(queries: DataFrame, library: DataFrame, q_cols, l_cols, make, limit_bytes: int, tile_rows: int) -> DataFrame:
    """Runs ``make()`` accumulators over all query and library blocks."""
    spark = queries.sparkSession
    q, lib = queries.select("query_id", *q_cols), library.select("lib_id", *l_cols)
    if "fp" in l_cols:
        # fingerprints are computed once, not again for each look at a side
        q, lib = cut_lineage(q), cut_lineage(lib)
    q, lib = usable(q, q_cols), usable(lib, l_cols)
    schema = make().schema

    small, row_bytes = _measure(lib, l_cols, limit_bytes)
    if small:
        held = spark.sparkContext.broadcast(_read(lib.toArrow(), "lib_id", l_cols))

        def past_library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            l_ids, l_mat = held.value
            for batch in batches:
                if batch.num_rows and len(l_ids):
                    ids, mat = _read(batch, "query_id", q_cols)
                    acc = make()
                    acc.absorb(ids, mat, l_ids, l_mat)
                    yield acc.emit(ids)

        # a query costs a pass over the library: a table read in a few pieces would leave most cores idle
        return q.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(past_library, schema)

    small, _ = _measure(q, q_cols, limit_bytes)
    if small:
        held = spark.sparkContext.broadcast(_read(q.toArrow(), "query_id", q_cols))

        def past_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, mat = held.value
            acc = make()
            for batch in batches:
                if batch.num_rows and len(ids):
                    acc.absorb(ids, mat, *_read(batch, "lib_id", l_cols))
            yield acc.emit(ids)

        return lib.mapInArrow(past_queries, schema)

    # a library tile gives k rows per query, so there are few of them; queries are in more tiles, some four a core
    most = max(1, TILE_BYTES // row_bytes)
    l_tiles = max(1, math.ceil(lib.count() / min(LIBRARY_TILE * tile_rows, most)))
    n_queries = q.count()
    few = math.ceil(4 * spark.sparkContext.defaultParallelism / l_tiles)
    q_tiles = max(1, math.ceil(n_queries / min(tile_rows, most)), min(few, math.ceil(n_queries / SCREEN_QUERIES)))
    # their cost is in scores, not in bytes: a given number of partitions is not put together by size
    parts = 4 * q_tiles * l_tiles

    def spread(side: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint")))
        ).repartition(parts, "q_tile", "l_tile")

    left = spread(q, "query_id", "q_tile", q_tiles, "l_tile", l_tiles)
    right = spread(lib, "lib_id", "l_tile", l_tiles, "q_tile", q_tiles)

    def one_tile(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, mat = _read(a, "query_id", q_cols)
        acc = make()
        if len(ids) and b.num_rows:
            acc.absorb(ids, mat, *_read(b, "lib_id", l_cols))
        return pa.Table.from_batches([acc.emit(ids)])

    return left.groupBy("q_tile", "l_tile").cogroup(right.groupBy("q_tile", "l_tile")).applyInArrow(one_tile, schema)


def _merge(partial: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "lib_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# ---- public operators -------------------------------------------------------


def topk_cosine(queries: DataFrame, library: DataFrame, k: int = 20, exclude_self: bool = False,
                limit_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(query_id, rank, lib_id, sim)``: the ``k`` library rows of highest cosine, ties to the lower id.

    ``queries(query_id, vec)``, ``library(lib_id, vec)``; ids are unique bigints.
    """
    hits = _meet(queries, library, ["vec"], ["vec"],
                 lambda: _Best(_cosine_block, k, exclude_self), limit_bytes, tile_rows)
    return _merge(hits, k).select("query_id", "rank", "lib_id", F.col("score").alias("sim"))


def topk_tanimoto(queries: DataFrame, library: DataFrame, k: int = 20, exclude_self: bool = False,
                  limit_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Same over packed bit fingerprints ``fp``."""
    hits = _meet(queries, library, ["fp"], ["fp"],
                 lambda: _Best(_tanimoto_block, k, exclude_self), limit_bytes, tile_rows)
    return _merge(hits, k).select("query_id", "rank", "lib_id", F.col("score").alias("sim"))


def topk_hybrid(queries: DataFrame, library: DataFrame, k: int = 20, exclude_self: bool = False,
                limit_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Top-k by z-scored cosine plus z-scored Tanimoto, z-scores over the whole library per query (sample std)."""
    cols = ["vec", "fp"]
    sums = _meet(queries, library, cols, cols, lambda: _Moments(exclude_self), limit_bytes, tile_rows)
    total = sums.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in _Moments.names])

    def mean_std(s: str, sq: str) -> list[Column]:
        mean = F.col(s) / F.col("n")
        var = (F.col(sq) - F.col("n") * mean * mean) / (F.col("n") - 1)
        return [mean, F.sqrt(F.greatest(var, F.lit(0.0)))]

    stats = total.select("query_id", F.array(*mean_std("sum_c", "sq_c"), *mean_std("sum_t", "sq_t")).alias("stats"))
    hits = _meet(queries.join(stats, "query_id"), library, [*cols, "stats"], cols,
                 lambda: _Best(_hybrid_block, k, exclude_self), limit_bytes, tile_rows)
    return _merge(hits, k).select("query_id", "rank", "lib_id", F.col("score").alias("sim"))


def topk_random(queries: DataFrame, library: DataFrame, k: int = 20, seed: int = 0) -> DataFrame:
    """Seeded control: ``k`` different library rows per query, drawn without replacement.

    The positions are drawn inside the query's own row (for ``j`` in the last
    ``k`` positions: a random position up to ``j``, or ``j`` itself if taken), so
    no query meets the whole library; one equi-join turns positions into ids.
    """
    place = dense_index(library.select("lib_id"), [], "lib_id", name="idx")
    size = library.select(F.count("*")).scalar()
    first = F.greatest(F.col("_size") - k, F.lit(0))
    slots = F.sequence(first, F.col("_size") - 1)
    empty = F.expr("cast(array() as array<bigint>)")

    def take(acc: Column, j: Column) -> Column:
        at = md5_mod(j + 1, F.lit(seed), F.col("query_id"), j)
        return F.array_append(acc, F.when(F.array_contains(acc, at), j).otherwise(at))

    drawn = queries.select("query_id").withColumn("_size", size).withColumn("_at", F.aggregate(slots, empty, take))
    long = drawn.select("query_id", F.posexplode("_at").alias("_pos", "idx"))
    return long.join(place, "idx").select("query_id", (F.col("_pos") + 1).alias("rank"), "lib_id")


def gather(neighbours: DataFrame, library: DataFrame, cols: list[str], key: str = "lib_id") -> DataFrame:
    """Attributes of each neighbour, by library id."""
    return neighbours.join(library.select(key, *cols), key)


def coverage(queries: DataFrame, library: DataFrame, k: int = 5, **sizes) -> DataFrame:
    """Per query: best similarity, mean of the best ``k`` and the nearest id."""
    hits = topk_tanimoto(queries, library, k, **sizes)
    return hits.groupBy("query_id").agg(
        F.max("sim").alias("max_sim"),
        F.avg("sim").alias("topk_mean_sim"),
        F.min_by("lib_id", "rank").alias("nearest_id"),
    )
