"""Bootstrap intervals and paired tests over prediction tables.

Metrics that are functions of counts never see rows: rows with the same truth and the same predictions of all arms are one
*cell*. A draw picks as many positions as its stratum has rows; positions are numbered cell by cell, so a pick is a search in
the running cell sizes, inside the task that owns the draw. Only confusion counts per draw leave a task. Too many cells for a task
stay in Spark: ``cell_draws`` makes the same picks there and joins the drawn positions.

``draws`` gives the drawn rows themselves. There a draw is fixed by md5 of (seed, draw, stratum, slot), every row is one slot, and a
task owns whole draws over the ids it holds; a table beyond ``MOST_CELLS`` meets its slots in an equi-join on
``(stratum, position)``, which is uniform and cannot skew. Both recipes agree on any cluster layout.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corvane.functions.hashing import md5_mod
from corvane.operators import metrics as M
from corvane.operators.ordered import average_ranks, dense_index
from corvane.session import cut_lineage, default_buckets

Z_95 = 1.959963984540054  # fixed value: 97.5 % point of the normal distribution


def _strata(rows: DataFrame, row_id: str, strata: str | None, *values: str) -> DataFrame:
    s = F.col(strata).cast("string") if strata else F.lit("all")
    return rows.select(F.col(row_id), s.alias("stratum"), *values).where(F.col("stratum").isNotNull())


def draws(rows: DataFrame, row_id: str, n_draws: int, seed: int = 42, strata: str | None = None) -> DataFrame:
    """``(draw, row_id, times)``: each draw has as many rows as the table, per stratum, with replacement."""
    base = cut_lineage(_strata(rows, row_id, strata))
    if not _fits(base):
        return _joined_draws(base, row_id, n_draws, seed)
    schema = T.StructType([T.StructField("draw", T.IntegerType()), rows.schema[row_id], T.StructField("times", T.LongType())])

    def run(held: pa.Table, mine: range):
        from pyspark.sql.pandas.types import to_arrow_schema

        held, spans = _in_order(held, row_id)
        coded = held[row_id].combine_chunks().dictionary_encode(null_encoding="encode")
        place, ids = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        arrow = to_arrow_schema(schema)
        for draw in mine:
            times = _md5_times(spans, seed, draw)
            if len(ids) < len(place):  # an id on several rows
                times = np.bincount(place, times, len(ids)).astype(np.int64)
            drawn = np.flatnonzero(times)
            for at in range(0, len(drawn), SLOTS_AT_ONCE):
                some = drawn[at:at + SLOTS_AT_ONCE]
                values = [np.full(len(some), draw, np.int32), ids.take(pa.array(some)), times[some]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) if isinstance(v, np.ndarray) else v.cast(f.type) for v, f in zip(values, arrow)], schema=arrow)

    return _holding(base, n_draws, run, schema)


def _joined_draws(base: DataFrame, row_id: str, n_draws: int, seed: int) -> DataFrame:
    """The same draws of a table too large for a task: slots and positions meet in a join."""
    placed = dense_index(base, ["stratum"], row_id, name="idx", total="_n")
    slots = placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    drawn = slots.select("draw", "stratum", md5_mod(F.col("_n"), F.lit(seed), F.col("draw"), F.col("stratum"), F.col("idx")).alias("idx"))
    counted = drawn.groupBy("stratum", "idx", "draw").agg(F.count("*").alias("times"))
    return counted.join(placed.drop("_n"), ["stratum", "idx"]).groupBy("draw", row_id).agg(F.sum("times").alias("times"))


def _in_order(held: pa.Table, row_id: str) -> tuple[pa.Table, dict[str, tuple[int, int]]]:
    """The rows by stratum and id, and the first row and the number of rows of each stratum."""
    held = held.sort_by([("stratum", "ascending"), (row_id, "ascending")])
    sizes = held.group_by("stratum", use_threads=False).aggregate([([], "count_all")]).sort_by("stratum")
    names, n = sizes["stratum"].to_pylist(), sizes["count_all"].to_numpy()
    return held, {name: (int(end - k), int(k)) for name, end, k in zip(names, np.cumsum(n), n)}


def md5_picks(seed: int, draw: int, stratum: str, slots: range, n: int) -> np.ndarray:
    """What ``md5_mod`` makes of (seed, draw, stratum, slot)."""
    head, md5 = f"{seed}:{draw}:{stratum}:".encode(), hashlib.md5
    found = b"".join([md5(b"%b%d" % (head, i)).digest() for i in slots])
    return ((np.frombuffer(found, ">u8")[::2] >> 4) % n).astype(np.int64)


def _md5_times(spans: dict[str, tuple[int, int]], seed: int, draw: int) -> np.ndarray:
    """How often each row, in the order of ``_in_order``, is in a draw."""
    times = np.zeros(sum(n for _, n in spans.values()), np.int64)
    for stratum, (first, n) in spans.items():
        for at in range(0, n, SLOTS_AT_ONCE):
            times[first:first + n] += np.bincount(md5_picks(seed, draw, stratum, range(at, min(n, at + SLOTS_AT_ONCE)), n), minlength=n)
    return times


def _fits(table: DataFrame) -> bool:
    return table.count() * len(table.columns) <= NUMBERS_A_CELL * MOST_CELLS


def _holding(table: DataFrame, n_draws: int, run, schema) -> DataFrame:
    """``run(rows, draws)`` in tasks that hold all rows of ``table`` and own some of the draws each.

    The copies are columns of numbers and go through a shuffle, so their volume is that of the table times a few tasks a core;
    the driver gets none of them.
    """
    tasks = max(1, min(n_draws, 2 * max(8, table.sparkSession.sparkContext.defaultParallelism)))
    copies = table.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("_task"))

    def work(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        del got
        owners = rows["_task"].unique().to_pylist()
        for own in owners:
            part = rows.filter(pc.equal(rows["_task"], own)) if len(owners) > 1 else rows
            yield from run(part.drop_columns("_task"), range(own, n_draws, tasks))

    return copies.mapInArrow(work, schema)


#: Distinct cells up to which their table is sent to every task (their keys are a few bytes per arm).
MOST_CELLS = 2_000_000
#: Numbers a cell of that many may have in a task that holds them as arrays (400 MB in all).
NUMBERS_A_CELL = 25
#: Positions up to which a draw counts each of them before adding up cells.
MOST_POSITIONS = 1 << 24
#: Positions picked in one go inside a task.
SLOTS_AT_ONCE = 1_000_000
# two primes whose residues together number some 2^62 starts: slots of one draw do not meet, and every position stays in reach
_PRIME, _SECOND = 2_147_483_647, 2_147_483_629
_STEPS, _SECOND_STEPS = (11, 101, 1009, 10007), (13, 1013)


def picks(draw: int, slots: np.ndarray, seed: int, stratum: int, n: int) -> np.ndarray:
    """Positions in ``[0, n)``: squaring steps modulo two primes, in integers that SQL has too. Slots may number some 8e13."""
    out = np.empty(len(slots), np.int64)
    for at in range(0, len(slots), 1 << 14):  # pieces that stay in a core's cache
        some = slots[at:at + (1 << 14)]
        x = (draw * 7919 + some * 104729 + seed * 1299709 + stratum * 15485863 + 1) % _PRIME
        for c in _STEPS:
            x = x * x + c
            for _ in range(2):  # 2^31 is 1 modulo the first prime
                x = (x & _PRIME) + (x >> 31)
        x[x == _PRIME] = 0
        y = (draw * 104723 + some * 7907 + seed * 1299721 + stratum * 15485867 + 1) % _SECOND
        for c in _SECOND_STEPS:
            y = (y * y + c) % _SECOND
        out[at:at + (1 << 14)] = (x * _SECOND + y) % n
    return out


def _keyed(pred: DataFrame, by: list[str], row_id: str, value: str = "pred") -> DataFrame:
    """Rows with ``y``, ``arms`` (sorted structs of the ``by`` values and the prediction) and the ``key`` of their cell."""
    arms = F.sort_array(F.collect_list(F.struct(*by, F.col(value).alias("pred"))))
    rows = pred.groupBy(row_id).agg(F.first("y").alias("y"), arms.alias("arms"))
    name = lambda a: F.concat_ws("=", F.concat_ws(":", *[a[c].cast("string") for c in by]), a["pred"].cast("string"))
    key = F.concat_ws("|", F.col("y").cast("string"), F.array_join(F.transform("arms", name), ","))
    return rows.withColumn("key", key)


def _cells(keyed: DataFrame) -> DataFrame:
    """``key``, ``y``, ``arms``, ``n`` rows."""
    return keyed.groupBy("key").agg(F.first("y").alias("y"), F.first("arms").alias("arms"), F.count("*").alias("n"))


def cell_draws(keyed: DataFrame, row_id: str, n_draws: int, seed: int, stratified: bool) -> DataFrame:
    """``(draw, row_id, times)`` by the recipe of ``picks``: positions in the order of the cells' keys, joined to what is drawn."""
    rows = keyed.select(F.col(row_id), "key", (F.col("y").cast("string") if stratified else F.lit("all")).alias("stratum"))
    spread = rows.repartitionByRange(default_buckets(rows.sparkSession), "stratum", "key", row_id)
    ranged = cut_lineage(spread.withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("stratum", "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("stratum")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut_lineage(counts.select("stratum", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"), F.sum("_n").over(whole).alias("_n")))
    strata = sorted(r["stratum"] for r in carried.select("stratum").distinct().collect())
    inside = Window.partitionBy("stratum", "_part").orderBy("key", row_id)
    placed = cut_lineage(ranged.withColumn("_r", F.row_number().over(inside)).join(F.broadcast(carried), ["stratum", "_part"]).select(
        row_id, "stratum", (F.col("_r") - 1 + F.col("_c")).alias("idx"), "_n"))
    k = F.array_position(F.array(*[F.lit(s) for s in strata]), F.col("stratum")) - 1
    big = lambda v: F.lit(v).cast("bigint")
    x = (F.col("draw") * big(7919) + F.col("idx") * big(104729) + big(seed * 1299709) + k * big(15485863) + 1) % _PRIME
    y = (F.col("draw") * big(104723) + F.col("idx") * big(7907) + big(seed * 1299721) + k * big(15485867) + 1) % _SECOND
    slots = placed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).select("stratum", "draw", "_n", x.alias("_x"), y.alias("_y"))
    for c in _STEPS:
        slots = slots.withColumn("_x", (F.col("_x") * F.col("_x") + c) % _PRIME)
    for c in _SECOND_STEPS:
        slots = slots.withColumn("_y", (F.col("_y") * F.col("_y") + c) % _SECOND)
    counted = slots.groupBy("stratum", ((F.col("_x") * big(_SECOND) + F.col("_y")) % F.col("_n")).alias("idx"), "draw").agg(F.count("*").alias("times"))
    return counted.join(placed.drop("_n"), ["stratum", "idx"]).select("draw", row_id, "times")


def _drawer(of: np.ndarray, size: np.ndarray, seed: int):
    """A function of the draw: how often each cell (in the order of the keys) is drawn; ``of`` numbers the strata, ``size`` has rows."""
    mine_of = {int(k): np.flatnonzero(of == k) for k in np.unique(of)}
    ends_of = {k: np.cumsum(size[mine]) for k, mine in mine_of.items()}

    def times_of(draw: int) -> np.ndarray:
        times = np.zeros(len(size), np.int64)
        for k, mine in mine_of.items():
            ends = ends_of[k]
            n = int(ends[-1])
            by_position = np.zeros(n, np.int64) if n <= MOST_POSITIONS else None
            for at in range(0, n, SLOTS_AT_ONCE):
                drawn = picks(draw, np.arange(at, min(n, at + SLOTS_AT_ONCE)), seed, k, n)
                if by_position is None:
                    times[mine] += np.bincount(np.searchsorted(ends, drawn, "right"), minlength=len(mine))
                else:
                    by_position += np.bincount(drawn, minlength=n)
            if by_position is not None:
                times[mine] = by_position if n == len(mine) else np.add.reduceat(by_position, np.concatenate([[0], ends[:-1]]))
        return times

    return times_of


def _strata_of(table: list, stratified: bool) -> tuple[np.ndarray, np.ndarray]:
    strata = sorted({str(r["y"]) for r in table})
    return np.array([strata.index(str(r["y"])) if stratified else 0 for r in table], np.int64), np.array([r["n"] for r in table], np.int64)


def _cell_numbers(cells: DataFrame, by: list[str], arms: list) -> DataFrame:
    """Cells as numbers: place in the order of the keys (``at``), rows (``n``), truth, and the prediction of each arm (null: none)."""
    def of(arm) -> Column:
        mine = F.filter("arms", lambda a: reduce(lambda p, q: p & q, [a[c].eqNullSafe(F.lit(arm[c])) for c in by], F.lit(True)))
        return F.try_element_at(mine, F.lit(-1))["pred"].cast("double")

    return cells.orderBy("key").select(
        F.monotonically_increasing_id().alias("at"), "n", F.col("y").cast("double").alias("y"), *[of(a).alias(f"a{i}") for i, a in enumerate(arms)])


def _held_values(held: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a value, and their values."""
    values = held[column].combine_chunks()
    rows = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    return rows, values.drop_null().to_numpy(zero_copy_only=False)


def _over_draws(spark, n_draws: int, run, schema) -> DataFrame:
    parts = max(1, min(n_draws, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n_draws, 1, parts).mapInArrow(run, schema)


def drawn_confusion(pred: DataFrame, by: list[str], n_draws: int, seed: int, stratified: bool, row_id: str = "row_id") -> DataFrame:
    """``by``, ``draw``, ``y``, ``pred``, ``n``: confusion counts of every arm in every draw; arms share the draws."""
    spark = pred.sparkSession
    keyed = _keyed(pred, by, row_id)
    cells = cut_lineage(_cells(keyed))
    if cells.count() > MOST_CELLS:  # nearly every row is its own cell: the same picks, joined in Spark
        d = cell_draws(keyed, row_id, n_draws, seed, stratified)
        return M.confusion(pred.join(d, row_id), [*by, "draw"], weight="times")
    table = cells.orderBy("key").collect()
    times_of = _drawer(*_strata_of(table, stratified), seed)
    # one column of the indicator per (arm, truth, prediction)
    columns: dict[tuple, int] = {}
    pairs = [(i, columns.setdefault((*[a[c] for c in by], r["y"], a["pred"]), len(columns))) for i, r in enumerate(table) for a in r["arms"]]
    cell, column = np.array(pairs, np.int64).T if pairs else np.zeros((2, 0), np.int64)
    names = list(columns)
    schema = T.StructType([*[pred.schema[c] for c in by], T.StructField("draw", T.IntegerType()), T.StructField("y", pred.schema["y"].dataType),
                           T.StructField("pred", pred.schema["pred"].dataType), T.StructField("n", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for draw in batch.column(0).to_pylist():
                counts = np.bincount(column, times_of(draw)[cell], len(names)).astype(np.int64)
                keep = np.flatnonzero(counts)
                values = [[names[i][j] for i in keep] for j in range(len(by))]
                values += [[draw] * len(keep), [names[i][-2] for i in keep], [names[i][-1] for i in keep], counts[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    return _over_draws(spark, n_draws if table else 0, run, schema)


def class_draws(pred: DataFrame, by: list[str], n_draws: int, seed: int, stratified: bool, row_id: str = "row_id") -> DataFrame:
    """Classification metrics of every arm in every draw; arms share the draws. Draws of a single class are left out."""
    conf = drawn_confusion(pred, by, n_draws, seed, stratified, row_id)
    return M.class_metrics_from(conf, [*by, "draw"]).where("n_classes > 1").drop("n_classes")


def _long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))


def bootstrap_normal(pred: DataFrame, by: list[str], names: list[str], n_draws: int = 10_000, seed: int = 42) -> DataFrame:
    """``point``, ``se`` (population sd of the draws) and point +- 1.96 se, all to 4 digits."""
    point = _long(M.class_metrics(pred, by), by, names).withColumnRenamed("value", "point")
    per = _long(class_draws(pred, by, n_draws, seed, True), by, names)
    se = per.groupBy(*by, "metric").agg(F.stddev_pop("value").alias("se"))
    j = point.join(se, [*by, "metric"])
    half = F.col("se") * Z_95
    return j.select(*by, "metric", *[F.round(c, 4).alias(n) for n, c in (
        ("point", F.col("point")), ("se", F.col("se")), ("ci_lo", F.col("point") - half), ("ci_hi", F.col("point") + half))])


def bootstrap_percentile(pred: DataFrame, by: list[str], names: list[str], n_draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Observed value, mean, sample sd and percentile interval of the draws, with the number of usable draws.

    ``percentile`` holds one group's draws, whose number is the parameter ``n_draws``.
    """
    observed = _long(M.class_metrics(pred, by), by, names).withColumnRenamed("value", "observed")
    per = _long(class_draws(pred, by, n_draws, seed, True), by, names)
    agg = per.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("se"),
        F.percentile("value", F.lit(alpha / 2)).alias("ci_lo"), F.percentile("value", F.lit(1 - alpha / 2)).alias("ci_hi"),
        F.count("value").alias("n_valid"))
    return observed.join(agg, [*by, "metric"])


def _arms_of(table: list, by: list[str]) -> list[tuple]:
    """Per arm its ``by`` values, the numbers of the cells it holds and its predictions there."""
    arms: dict[tuple, dict[int, float]] = {}
    for i, r in enumerate(table):
        for a in r["arms"]:
            arms.setdefault(tuple(a[c] for c in by), {})[i] = a["pred"]
    return [(name, np.array(list(of), np.int64), np.array(list(of.values()), float)) for name, of in arms.items()]


def _places(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    return np.unique(values, return_inverse=True)[1]


def auc_draws(pred: DataFrame, by: list[str], n_draws: int, seed: int = 42, stratified: bool = True, row_id: str = "row_id", score: str = "score") -> DataFrame:
    """``by``, ``draw``, ``auc``: tie-aware AUC of every arm in every draw; null in draws of one class. Cells are rows with equal scores."""
    spark = pred.sparkSession
    keyed = _keyed(pred, by, row_id, score)
    cells = cut_lineage(_cells(keyed))
    if cells.count() > MOST_CELLS:
        d = cell_draws(keyed, row_id, n_draws, seed, stratified)
        return M.auc_from(M.score_counts(pred.join(d, row_id), [*by, "draw"], weight="times"), [*by, "draw"])
    table = cells.orderBy("key").collect()
    times_of = _drawer(*_strata_of(table, stratified), seed)
    truth = np.array([r["y"] for r in table])
    arms = [(name, held, _places(scores)) for name, held, scores in _arms_of(table, by)]
    schema = T.StructType([*[pred.schema[c] for c in by], T.StructField("draw", T.IntegerType()), T.StructField("auc", T.DoubleType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for draw in batch.column(0).to_pylist():
                times, found = times_of(draw), []
                for _, held, place in arms:
                    up = np.bincount(place, times[held] * (truth[held] == 1))
                    down = np.bincount(place, times[held] * (truth[held] == 0), len(up))
                    pairs = up.sum() * down.sum()
                    found.append(float((up * (np.cumsum(down) - down / 2)).sum() / pairs) if pairs else None)
                values = [[name[j] for name, *_ in arms] for j in range(len(by))] + [[draw] * len(arms), found]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    return _over_draws(spark, n_draws if table else 0, run, schema)


def middle_ranks(places: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Average rank of each entry when entry i occurs ``times[i]`` times; ``places`` come from one sort for all draws."""
    n = np.bincount(places, times)
    return (np.cumsum(n) - (n - 1) / 2)[places]


def _rank_corr(w: np.ndarray, truth: np.ndarray, arms: list[np.ndarray]) -> list[float | None]:
    """Rank correlation of entries of weight ``w``, given by their places, with each of ``arms``; null without spread."""
    found, mid = [], (w.sum() + 1) / 2
    x = middle_ranks(truth, w) - mid
    wx = w * x
    xx = (wx * x).sum()
    for places in arms:
        n = np.bincount(places, w)
        z = np.cumsum(n) - (n - 1) / 2 - mid
        root = np.sqrt(xx * (n * z * z).sum())
        found.append(float((np.bincount(places, wx) * z).sum() / root) if root > 0 else None)
    return found


def corr_draws(pred: DataFrame, by: list[str], n_draws: int, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """``by``, ``draw``, ``spearman``: rank correlation of truth and prediction of every arm in every plain draw; arms share the draws.

    Values are sorted once per task; a draw only adds up its counts along that order. Null without spread. Rows without a truth or without any
    prediction are not drawn; an arm that lacks the prediction of a row is judged by its other rows.
    """
    pred = pred.where(F.col("y").isNotNull() & F.col("pred").isNotNull())
    arms = pred.select(*by).distinct().collect()
    keyed = _keyed(pred, by, row_id)
    cells = cut_lineage(_cell_numbers(_cells(keyed), by, arms))
    if not _fits(cells):
        d = cell_draws(keyed, row_id, n_draws, seed, False)
        return M.spearman(pred.join(d, row_id), "y", "pred", [*by, "draw"], weight="times").withColumnRenamed("rho", "spearman")
    schema = T.StructType([*[pred.schema[c] for c in by], T.StructField("draw", T.IntegerType()), T.StructField("spearman", T.DoubleType())])

    def run(held: pa.Table, mine: range):
        from pyspark.sql.pandas.types import to_arrow_schema

        held = held.sort_by("at")
        times_of = _drawer(np.zeros(len(held), np.int64), held["n"].to_numpy(), seed)
        truth = held["y"].to_numpy()
        shared: dict[bytes, tuple] = {}  # arms over the same cells share the ranks of the truth
        for i in range(len(arms)):
            rows, values = _held_values(held, f"a{i}")
            of = shared.setdefault(rows.tobytes(), (rows, _places(truth[rows]), [], []))
            of[2].append(i)
            of[3].append(_places(values))
        del held
        arrow = to_arrow_schema(schema)
        for draw in mine:
            times, found = times_of(draw).astype(float), [None] * len(arms)
            for rows, places, numbers, others in shared.values():
                for i, rho in zip(numbers, _rank_corr(times if len(rows) == len(times) else times[rows], places, others)):
                    found[i] = rho
            values = [[a[c] for a in arms] for c in by] + [[draw] * len(arms), found]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    return _holding(cells, n_draws, run, schema)


def bootstrap_corr_normal(pred: DataFrame, by: list[str], n_draws: int = 10_000, seed: int = 42) -> DataFrame:
    """As ``bootstrap_normal`` for the rank correlation of truth and prediction; draws are plain, as there are no classes."""
    point = M.spearman(pred, "y", "pred", by).withColumnRenamed("rho", "point")
    se = corr_draws(pred, by, n_draws, seed).groupBy(*by).agg(F.stddev_pop("spearman").alias("se"))
    half = F.col("se") * Z_95
    return point.join(se, by).select(*by, F.lit("spearman").alias("metric"), *[F.round(c, 4).alias(n) for n, c in (
        ("point", F.col("point")), ("se", F.col("se")), ("ci_lo", F.col("point") - half), ("ci_hi", F.col("point") + half))])


def bootstrap_auc(pred: DataFrame, by: list[str], n_draws: int = 10_000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Observed AUC, mean, sample sd and percentile interval of its draws, with the number of usable draws."""
    per = auc_draws(pred, by, n_draws, seed)
    agg = per.groupBy(*by).agg(
        F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("se"), F.percentile("auc", F.lit(alpha / 2)).alias("ci_lo"),
        F.percentile("auc", F.lit(1 - alpha / 2)).alias("ci_hi"), F.count("auc").alias("n_valid"))
    observed = M.auc(pred, by).select(*by, F.col("auc").alias("observed"))
    return observed.join(agg, by).withColumn("metric", F.lit("auc"))


def _arm_deltas(pred: DataFrame, arm: str, a, b, by: list[str], metric: str, n_draws: int, seed: int, stratified: bool):
    """Observed and per-draw difference of a metric between two arms over the same rows and draws.

    ``spearman`` compares real-valued predictions; its draws are plain, and those without spread in either arm have no difference.
    """
    two = pred.where(F.col(arm).isin([a, b]))
    gap = lambda: (F.max(F.when(F.col(arm) == a, F.col(metric))) - F.max(F.when(F.col(arm) == b, F.col(metric))))
    if metric == "spearman":
        obs = M.spearman(two, "y", "pred", [arm, *by]).withColumnRenamed("rho", metric).groupBy(*by).agg(gap().alias("obs"))
        per = corr_draws(two, [arm, *by], n_draws, seed).groupBy(*by, "draw").agg(gap().alias("delta"))
        return obs, per.where("delta IS NOT NULL")
    obs = M.class_metrics(two, [arm, *by]).groupBy(*by).agg(gap().alias("obs"))
    per = class_draws(two, [arm, *by], n_draws, seed, stratified).groupBy(*by, "draw").agg(gap().alias("delta"))
    return obs, per


def _join_obs(per: DataFrame, obs: DataFrame, by: list[str]) -> DataFrame:
    return per.join(obs, by) if by else per.withColumn("obs", obs.select("obs").scalar())


def _summary(per: DataFrame, by: list[str]) -> list[Column]:
    return [F.first("obs").alias("obs"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("se"),
            F.percentile("delta", F.lit(0.025)).alias("ci_lo"), F.percentile("delta", F.lit(0.975)).alias("ci_hi"), F.count("delta").alias("n_draws")]


def paired_test(pred: DataFrame, arm: str, a, b, by: list[str], metric: str = "mcc", n_draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Difference a - b with interval and two-sided p: the share of draws, shifted to mean 0, at least as far out as observed."""
    obs, per = _arm_deltas(pred, arm, a, b, by, metric, n_draws, seed, True)
    all_draws = _join_obs(per, obs, by).withColumn("_m", F.avg("delta").over(Window.partitionBy(*by)))
    extreme = F.abs(F.col("delta") - F.col("_m")) >= F.abs(F.col("obs"))
    out = all_draws.groupBy(*by).agg(*_summary(per, by), F.avg(extreme.cast("double")).alias("p_value"))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def paired_sign(pred: DataFrame, arm: str, a, b, by: list[str], metric: str = "mcc", n_draws: int = 10_000, seed: int = 0) -> DataFrame:
    """Plain paired draws; p is the share of draws on the other side of zero."""
    obs, per = _arm_deltas(pred, arm, a, b, by, metric, n_draws, seed, False)
    against = F.when(F.col("obs") > 0, F.col("delta") <= 0).otherwise(F.col("delta") >= 0)
    return _join_obs(per, obs, by).groupBy(*by).agg(*_summary(per, by), F.avg(against.cast("double")).alias("p_one_sided"))


def paired_pooled(pred: DataFrame, arm: str, a, b, seed_col: str, by: list[str], metric: str = "mcc", n_draws: int = 3_000, seed: int = 0) -> DataFrame:
    """Rows are drawn once per draw; the difference is averaged over model seeds before the interval is taken."""
    obs, per = _arm_deltas(pred, arm, a, b, [*by, seed_col], metric, n_draws, seed, False)
    pooled_obs = obs.groupBy(*by).agg(F.avg("obs").alias("obs"), F.count("*").alias("n_seeds"))
    pooled = per.groupBy(*by, "draw").agg(F.avg("delta").alias("delta"))
    j = pooled.join(pooled_obs, by) if by else pooled.withColumns({c: pooled_obs.select(c).scalar() for c in ("obs", "n_seeds")})
    out = j.groupBy(*by).agg(*_summary(pooled, by), F.first("n_seeds").alias("n_seeds"))
    return ci_flags(out)


def approx_ci(df: DataFrame, value: str, n: str) -> DataFrame:
    """Interval of a summary metric in [0, 1] from its size alone."""
    v = F.col(value)
    se = F.sqrt(F.greatest(v * (1 - v), F.lit(1e-6)) / F.col(n))
    return df.withColumns({"se": se, "ci_lo": F.greatest(F.lit(0.0), v - 1.96 * se), "ci_hi": F.least(F.lit(1.0), v + 1.96 * se)})


def ci_flags(df: DataFrame, lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    return df.withColumns({"excludes_0": (F.col(lo) > 0) | (F.col(hi) < 0), "better": F.col(lo) > 0, "worse": F.col(hi) < 0})


def bootstrap_corr(df: DataFrame, a: str, b: str, row_id: str, n_draws: int = 2_000, seed: int = 0) -> DataFrame:
    """Interval of the rank correlation of two columns; draws without spread are skipped."""
    df = cut_lineage(df.select(row_id, a, b))
    if not _fits(df):
        d = df.join(draws(df, row_id, n_draws, seed), row_id)
        per = M.spearman(d, a, b, ["draw"], weight="times")
    else:
        def run(held: pa.Table, mine: range):
            held, spans = _in_order(held, row_id)
            rows = np.flatnonzero(pc.and_(held["a"].is_valid(), held["b"].is_valid()).to_numpy())
            one, other = (_places(held[c].to_numpy()[rows]) for c in ("a", "b"))
            for draw in mine:
                rho = _rank_corr(_md5_times(spans, seed, draw)[rows].astype(float), one, [other])
                yield pa.record_batch({"draw": pa.array([draw], pa.int32()), "rho": pa.array(rho, pa.float64())})

        numbers = _strata(df.select(row_id, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")), row_id, None, "a", "b")
        per = _holding(numbers, n_draws, run, "draw int, rho double")
    out = per.agg(F.percentile("rho", F.lit(0.025)).alias("ci_lo"), F.percentile("rho", F.lit(0.975)).alias("ci_hi"), F.count("rho").alias("n_draws"))
    return out.withColumn("rho", M.spearman(df.withColumn("_g", F.lit(1)), a, b, ["_g"]).select("rho").scalar())


def bootstrap_mean(df: DataFrame, value: str, row_id: str, by: str | None = None, n_draws: int = 2_000, seed: int = 0) -> DataFrame:
    """Interval of a mean, per group when ``by`` is given (each group is resampled by itself). Nulls are drawn but count for nothing."""
    keys = [by] if by else []
    df = cut_lineage(df.select(row_id, *keys, value))
    rows = _strata(df.withColumn("_v", F.col(value).cast("double")), row_id, by, "_v")
    if not _fits(df):
        d = rows.join(draws(rows, row_id, n_draws, seed, "stratum"), row_id).where("_v IS NOT NULL")
        per = d.groupBy("stratum", "draw").agg((F.sum(F.col("_v") * F.col("times")) / F.sum("times")).alias("m"))
    else:
        def run(held: pa.Table, mine: range):
            held, spans = _in_order(held, row_id)
            there = held["_v"].is_valid().to_numpy().astype(np.int64)
            values = pc.fill_null(held["_v"], 0.0).to_numpy()
            firsts = [first for first, _ in spans.values()]
            for draw in mine:
                times = _md5_times(spans, seed, draw) * there
                n, total = np.add.reduceat(times, firsts), np.add.reduceat(times * values, firsts)
                m = [t / k if k else None for t, k in zip(total.tolist(), n.tolist())]
                yield pa.record_batch({"stratum": pa.array(list(spans), pa.string()), "draw": pa.array([draw] * len(m), pa.int32()), "m": pa.array(m, pa.float64())})

        per = _holding(rows, n_draws, run, "stratum string, draw int, m double")
    ci = per.groupBy("stratum").agg(F.percentile("m", F.lit(0.025)).alias("ci_lo"), F.percentile("m", F.lit(0.975)).alias("ci_hi"))
    obs = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    if not keys:
        return obs.withColumns({c: ci.select(c).scalar() for c in ("ci_lo", "ci_hi")})
    return obs.withColumn("stratum", F.col(by).cast("string")).join(ci, "stratum").drop("stratum")


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0 (Abramowitz & Stegun 26.2.17, error below 7.5e-8)."""
    # fixed values of the published approximation
    c = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = 1.0 / (1.0 + 0.2316419 * z)
    poly = t * (c[0] + t * (c[1] + t * (c[2] + t * (c[3] + t * c[4]))))
    return F.exp(-z * z / 2.0) * 0.3989422804014327 * poly


EXACT_PAIRS = 50


def exact_tail(n: Column, w: Column) -> Column:
    """P(W <= w) for ``n`` untied differences: subsets of 1..n by their sum, each sum's count from those without the last rank."""
    def add(ways: Column, rank: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ways) + rank - 1),
                           lambda s: F.coalesce(F.get(ways, s), F.lit(0.0)) + F.coalesce(F.get(ways, s - rank), F.lit(0.0)))

    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), add)
    below = F.aggregate(F.slice(ways, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, b: a + b)
    return below / F.pow(F.lit(2.0), n)


def wilcoxon(df: DataFrame, diff: str, by: list[str]) -> DataFrame:
    """Signed-rank test on differences: zeros dropped, average ranks.

    p is exact for up to ``EXACT_PAIRS`` differences without ties or zeros, else the normal approximation with tie correction.
    """
    d = df.where(F.col(diff) != 0).withColumn("_abs", F.abs(diff))
    counts = d.groupBy(*by, "_abs").agg(F.count_if(F.col(diff) > 0).alias("_up"), F.count("*").alias("_w"))
    ranked = counts.join(average_ranks(counts, by, "_abs", name="_r"), [*by, "_abs"])
    s = ranked.groupBy(*by).agg(
        F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum((F.col("_w") - F.col("_up")) * F.col("_r")).alias("w_minus"),
        F.sum("_w").cast("double").alias("_n"), F.sum(F.col("_w") * F.col("_w") * F.col("_w") - F.col("_w")).cast("double").alias("_ties"))
    n = F.col("_n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    z = F.abs(F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / F.sqrt(var)
    about = df.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg(diff).alias("mean_diff"),
                                F.avg((F.col(diff) > 0).cast("double")).alias("share_better"))
    w = F.least("w_plus", "w_minus")
    untied = (n <= EXACT_PAIRS) & (F.col("_ties") == 0) & (F.col("n_pairs") == n)
    tail = F.when(untied, exact_tail(F.when(untied, n).otherwise(1.0), w)).otherwise(normal_tail(z))
    tests = s.join(about.select(*by, "n_pairs"), by).select(*by, w.alias("w"), F.least(F.lit(1.0), 2.0 * tail).alias("p"))
    medians = M.exact_quantiles(df, by, diff, {"median_diff": 0.5})
    return about.join(medians, by).join(tests, by, "left")
