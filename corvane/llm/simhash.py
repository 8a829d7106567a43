"""SimHash fingerprints of documents, and a search for fingerprints within a Hamming radius.

The terms of a text are its runs of five words (a shorter text is one run), each with its number of occurrences as weight. Every term's
128-bit hash votes on every bit with its weight, for 1 or for 0; the signs of the sums are the fingerprint, 32 hex digits.
Texts that share a part p of their terms differ in about ``arccos(p) / pi`` of the bits.

Search: two fingerprints within ``radius`` bits agree in at least one of ``radius + 1`` blocks. One table per block, permuted so that
this block leads, holds every distinct fingerprint; a query meets what shares its leading block. Blocks are 16 bits, so the counts of
all leading values are a table of bounded size; values with many fingerprints are cut into parts that each meet the query on their own.

Cases: a null or empty text, or one without words, has the fingerprint of zeros; a tied vote is 0; A-Z count as a-z; very long texts count
whole; rows with the same key follow each other by a hash of their text; rows with a null key come last; a table's only row has itself as
the next one; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.llm.common import text_pieces
from corvane.session import cut_lineage, join_small

BITS, BLOCK, RUN = 128, 16, 5
#: Hamming radius of the search: one block fewer than there are.
RADIUS = BITS // BLOCK - 1
#: Fingerprints that one part of a table holds, and pairs compared at once.
PART_ROWS, CELLS = 50_000, 2_000_000
_ODD, _LANES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x0101010101010101)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit hashes (the published MurmurHash3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts in a row, and how many each text has."""
    import xxhash

    docs = [t.lower().split() for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*docs)}
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    flat = np.fromiter((known[w] for d in docs for w in d), np.uint64, int(sizes.sum()))
    counts = np.where(sizes >= RUN, sizes - RUN + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    # position of every term's first word
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    width = np.repeat(np.minimum(sizes, RUN), counts)
    h = width.astype(np.uint64)
    for k in range(RUN):
        inside = width > k
        word = flat[np.where(inside, at + k, 0)] if len(at) else flat[:0]
        h = np.where(inside, mixed(h * _ODD + word), h)
    return h, counts


def ones(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Votes for 1 on each of 64 bits by text; eight byte-wide counters are added up at once, for at most 255 terms at a time."""
    parts = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = (np.cumsum(counts) - counts)[owner] + 255 * number
    out = np.zeros((len(counts), 64), np.int64)
    if not len(begins):
        return out
    has = np.flatnonzero(counts)
    first_part = (np.cumsum(parts) - parts)[has]
    for s in range(8):
        lanes = np.add.reduceat((h >> np.uint64(s)) & _LANES, begins).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[has, s::8] = np.add.reduceat(lanes, first_part, axis=0)
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Two 64-bit words per text."""
    h, counts = terms(texts)
    words = []
    for half in range(BITS // 64):
        votes = ones(h if half == 0 else mixed(h ^ (_ODD * np.uint64(half))), counts)
        words.append(np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0])
    return np.stack(words, 1) if len(texts) else np.zeros((0, BITS // 64), np.uint64)


def as_text(words: np.ndarray) -> list[str]:
    return [w.tobytes().hex() for w in words.astype(">u8")]


def from_text(texts: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(texts)), ">u8").reshape(-1, BITS // 64).astype(np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


# ---- a document and its neighbour in key order ------------------------------------------------

_ROW = "_key {key}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, follower: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + follower[:half]


def _compared(texts: list[str], followers: list[str], prints: np.ndarray, next_prints: np.ndarray) -> list:
    """Columns of ``_ROW`` after the key."""
    edited = [_edited(t, f).encode() for t, f in zip(texts, followers)]
    edited_prints = fingerprints(edited)
    return [[len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], as_text(prints), as_text(edited_prints),
            1 - distance(prints, edited_prints) / BITS, 1 - distance(prints, next_prints) / BITS]


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its fingerprint, and its likeness to the next row (descending key; the last row's next is the first) and to an edited
    text: the last half of its code points replaced by as many of the next row's first ones.

    Texts are dealt once, to ranges of the key. Inside a range the next row is at hand; only the ends of ranges are joined.
    """
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    by = [F.col("_key").desc_nulls_last(), F.xxhash64("_text"), F.col("_row")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_part", F.spark_partition_id())
    key_type = rows.schema["_key"].dataType.simpleString()
    row = _ROW.format(key=key_type)

    names = [c.split(" ")[0] for c in row.split(", ")] + ["_end", "_part", "_text"]
    types = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row of a piece waits for the next piece, which brings its next row
        keys: list = []
        texts: list[str] = []
        kind = part = None

        def finished() -> pa.RecordBatch:
            n = len(texts) - 1
            prints = fingerprints([t.encode() for t in texts])
            made = _compared(texts[:n], texts[1:], prints[:n], prints[1:])
            columns = [pa.array(keys[:n], kind), *map(pa.array, made, types), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def end(which: str, i: int) -> pa.RecordBatch:
            columns = [pa.array([keys[i]], kind), *[pa.nulls(1, t) for t in types], pa.array([which]), pa.array([part], pa.int32()), pa.array([texts[i]])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for piece in text_pieces(batches, "_text"):
            first = part is None
            kind, part = piece.schema.field("_key").type, piece.column("_part")[0].as_py()
            keys += piece.column("_key").to_pylist()
            texts += piece.column("_text").to_pylist()
            if first:
                yield end("head", 0)
            if len(texts) > 1:
                yield finished()
                del keys[:-1], texts[:-1]
        if part is not None:
            yield end("tail", 0)

    made = cut_lineage(ranged.mapInArrow(run, f"{row}, _end string, _part int, _text string"))

    # ends of ranges: one row each, however many rows a range has
    ends = made.where("_end is not null").select("_key", "_end", "_part", "_text")
    heads = ends.where("_end = 'head'")
    order = Window.orderBy("_part")
    nexts = heads.select("_part", F.coalesce(F.lead("_part").over(order), F.first("_part").over(order)).alias("_after"))
    followers = heads.select(F.col("_part").alias("_after"), F.col("_text").alias("_next"))
    pairs = ends.where("_end = 'tail'").join(nexts, "_part").join(followers, "_after").select("_key", "_text", "_next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                own, after = one.column("_text").to_pylist(), one.column("_next").to_pylist()
                prints = fingerprints([own[0].encode(), after[0].encode()])
                yield pa.RecordBatch.from_arrays([one.column("_key"), *[pa.array(c, t) for c, t in zip(_compared(own, after, prints[:1], prints[1:]), types)]], names=names[:7])

    return made.where("_end is null").drop("_end", "_part", "_text").unionByName(pairs.mapInArrow(finish, row)).withColumnRenamed("_key", key)


# ---- search -----------------------------------------------------------------------------------


def _tables(prints: DataFrame) -> DataFrame:
    """One row per fingerprint and table; ``lead`` is the table's number and its leading block."""
    step = BLOCK // 4
    blocks = [F.concat(F.lit(f"{t:02d}"), F.substring("fingerprint", t * step + 1, step)) for t in range(BITS // BLOCK)]
    return prints.withColumn("lead", F.explode(F.array(*blocks)))


def count_within(df: DataFrame, is_query: Column, radius: int = RADIUS, fingerprint: str = "fingerprint", name: str = "n_near") -> DataFrame:
    """Adds ``name``: how many other rows have a fingerprint within ``radius`` bits; null for rows that are not queries."""
    if radius > RADIUS:
        raise ValueError(f"the tables find a radius of {RADIUS} at most")
    asked = df.withColumn("_asked", F.coalesce(is_query, F.lit(False)))
    prints = cut_lineage(asked.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.count("*").alias("n"), F.max("_asked").alias("asked")))
    rows = _tables(prints)
    # leading values with more fingerprints than a part holds; there are at most tables x 2^16 values
    cells = rows.groupBy("lead").agg(F.count("*").alias("_cell")).where(F.col("_cell") > PART_ROWS)
    parts = max(1, -(-prints.count() * (BITS // BLOCK) // PART_ROWS))
    known = F.broadcast(cut_lineage(cells.select("lead", F.expr(f"(_cell + {PART_ROWS - 1}) div {PART_ROWS}").alias("_cuts"))))
    rows = rows.join(known, "lead", "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1).cast("long")))

    def bucket(cut: Column) -> Column:
        return F.pmod(F.xxhash64("lead", cut), F.lit(parts).cast("long"))

    held = rows.withColumn("_bucket", bucket(F.pmod(F.xxhash64("fingerprint"), F.col("_cuts")))).select("_bucket", "lead", "fingerprint", "n")
    # a query goes to the bucket of every part, once where two parts share one
    places = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1), bucket))
    queries = rows.where("asked").withColumn("_bucket", F.explode(places)).select(
        F.col("_bucket").alias("_place"), F.col("lead").alias("_lead"), F.col("fingerprint").alias("_print"))
    schema = "fingerprint string, n_near bigint"

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(left.num_rows, np.int64)
        if left.num_rows and right.num_rows:
            own, other = np.array(left.column("_lead").to_pylist()), np.array(right.column("lead").to_pylist())
            order = np.argsort(other, kind="stable")
            other = other[order]
            prints_a, prints_b = from_text(left.column("_print").to_pylist()), from_text(right.column("fingerprint").to_pylist())[order]
            weight = right.column("n").to_numpy()[order]
            lo, hi = np.searchsorted(other, own, "left"), np.searchsorted(other, own, "right")
            for i in range(left.num_rows):
                table = int(own[i][:2])
                for at in range(lo[i], hi[i], CELLS):
                    stop = min(hi[i], at + CELLS)
                    differs = prints_b[at:stop] ^ prints_a[i]
                    near = np.bitwise_count(differs).sum(1) <= radius
                    # a pair counts in the first table whose block agrees
                    blocks = np.ascontiguousarray(differs[near].astype(">u8")).view(">u2")[:, :table]
                    found[i] += weight[at:stop][near][(blocks != 0).all(1)].sum()
        return pa.table([left.column("_print"), pa.array(found)], names=["fingerprint", "n_near"])

    counts = queries.groupBy("_place").cogroup(held.groupBy("_bucket")).applyInArrow(compare, schema)
    total = counts.groupBy("fingerprint").agg((F.sum("n_near") - 1).alias(name)).withColumnRenamed("fingerprint", fingerprint)
    out = join_small(asked, total, [fingerprint], "left")
    return out.withColumn(name, F.when(F.col("_asked"), F.col(name))).drop("_asked")
