"""Shared plumbing: Arrow passes over text columns and packed exchanges between NumPy tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.plans.registry import text_table

#: Text handled at once inside a task; longer single texts are handled alone.
CHUNK_CHARS = 4_000_000
#: What separates words in every contract here: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents")


def remembered(key: str, make: Callable[[], object]):
    """What ``make`` builds, kept for the life of a Python worker.

    Task functions are pickled by value, so their module's globals last for one task only; a module of its own outlives them.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_corvane_worker", types.ModuleType("_corvane_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget(start: str) -> None:
    """Drops what the worker remembers under keys with this start, where an operator needs the room."""
    import gc
    import sys

    kept = getattr(sys.modules.get("_corvane_worker"), "__dict__", {})
    for key in [k for k in kept if k.startswith(start)]:
        del kept[key]
    gc.collect()


def give_back() -> None:
    """Returns freed memory of this worker to the system, at the end of a task that held large arrays."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns that a result column of the same name (in any case) will replace."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def text_pieces(batches: Iterator[pa.RecordBatch], text: str | None = "text", limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts record batches between rows so that a piece holds about ``limit`` bytes of ``text``."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_text(df: DataFrame, fn: Callable[[list], dict[str, list]], fields: list[tuple[str, T.DataType]], text: str = "text",
             replace_text: bool = False) -> DataFrame:
    """Appends columns computed from the text column, batch by batch, without a shuffle.

    ``fn`` gets the texts of a piece (None for null) and returns a list per field. An input column whose name equals a
    field's (in any case) is replaced. With ``replace_text`` the field named like ``text`` is the new text.
    """
    names = [n for n, _ in fields]
    rest = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    types = [(n, to_arrow_type(t)) for n, t in fields]
    if text not in df.columns or (text in names) != replace_text:
        raise ValueError(f"text column {text!r} is missing or would be replaced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("encoder")  # a tokenizer and its words, if the worker packed documents before
        for piece in text_pieces(batches, text):
            made = fn(piece.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in rest] + [pa.array(made[n], t) for n, t in types], names=rest + names)
        give_back()

    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, t) for n, t in fields])
    return df.mapInArrow(run, schema)
