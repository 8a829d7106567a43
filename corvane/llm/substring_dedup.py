"""Exact removal of repeated byte strings with a distributed suffix sort.

A byte goes if some ``LENGTH``-byte string that covers it also starts in a document with a smaller key.

A suffix per byte would be shipped dozens of times over, so suffixes are taken at *tokens*: places that the bytes themselves
choose. In every window of ``LENGTH`` bytes the ``GRAM``-byte string with the smallest hash marks a token, so equal windows choose
the same one and neighbouring windows mostly share it. The windows of a token lie in one short context around it.

1. *Screen*: hashes of the tokens' grams meet in hash buckets; a gram of one document only cannot repeat and drops out. The
   answer is one bit per gram.
2. *Sort*: contexts of the remaining tokens are range-partitioned by their leading bytes with sampled splitters. A bucket sorts its
   suffixes by multikey quicksort, eight bytes at a time; contexts that are equal in full fall together, and only where a gram has
   several contexts are its single windows sorted as well. The smallest key of each run decides.
3. *Boundaries*: a gram is never split by a splitter, so equal suffixes always meet. A gram so common that one bucket could not
   hold it shows up as repeats among the sampled splitters; its windows are spread by their full bytes instead and compared across all
   buckets. Every task first settles what repeats within its own documents and sends the smallest key only.

Everything is compared by bytes; hashes only choose and route.

Exact copies of a whole text are found first and never enter the sort. Texts are shuffled once, into a compressed table bucketed by
chunk; later steps read their bucket beside what the buckets answered.

Cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; a row with a null key keeps its text and is no source; rows
that repeat a key do not count as smaller than each other; very long texts are treated whole; an empty table gives an empty table;
other input columns are not carried.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm.common import text_pieces
from corvane.llm.jaccard_join import mixed
from corvane.session import cut_lineage, new_path

LENGTH, GRAM = 50, 18
#: Grams in a window; a token's windows start at most SPREAD - 1 bytes before it.
SPREAD = LENGTH - GRAM + 1
#: Documents of a chunk, sampled documents per range and at most, and sampled sightings from which a gram is spread by windows.
CHUNK_DOCS, SAMPLE_DOCS, MOST_SAMPLED, HEAVY = 2048, 3, 40_000, 24
#: Bytes, about, whose tokens are chosen, and whose windows are sorted, in one go (a single longer text or gram is taken whole).
TOKEN_BYTES, SORT_BYTES = 2_000_000, 16_000_000
LEVEL = 3


def tokens(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, gram hash) of every token of texts laid end to end in ``data`` (uint8).

    Windows never reach across texts; a token of equal grams in one window is the leftmost.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.empty(len(data), np.uint64)
    for k in range(8):
        part = padded[k:k + (len(padded) - k) // 8 * 8].view("<u8")
        words[k::8] = part[:len(words[k::8])]
    n = len(data) - GRAM + 1
    h = mixed(mixed(words[:n]) + words[8:8 + n] * np.uint64(0x9E3779B97F4A7C15))
    h = mixed(h + words[GRAM - 8:GRAM - 8 + n])
    low, at = h, np.arange(n)
    span = 1
    while span < SPREAD:  # smallest hash of each run of ``span`` grams, the leftmost of equal ones
        step = min(span, SPREAD - span)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    # windows that lie inside one text
    inside = np.zeros(len(data) + 1, np.int64)
    long = sizes >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[:len(at)] > 0)
    if not len(windows):
        return none, none, none, none.astype(np.uint64)
    place = at[windows]
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    last = windows[np.append(cut[1:], len(windows)) - 1]
    return place[cut], windows[cut], last, h[place[cut]]


def tokens_in_parts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``tokens`` of a few texts at a time, so that working space does not grow with the chunk."""
    parts, at = [], 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + TOKEN_BYTES)))
        begin, end = starts[at], starts[stop - 1] + sizes[stop - 1]
        place, low, high, gram = tokens(data[begin:end], starts[at:stop] - begin, sizes[at:stop])
        parts.append((place + begin, low + begin, high + begin, gram))
        at = stop
    if not parts:
        return list(tokens(data, starts, sizes))
    return [np.concatenate(c) for c in zip(*parts)]


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``keys`` (big-endian words as columns) and, in that order, the column in which each row first differs
    from the one before; rows equal to it have the number of columns. Later columns are read only where rows still tie."""
    n, width = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    differs = np.full(n, width, np.int64)
    if n:
        differs[0] = 0
    first = keys[order, 0]
    differs[1:][first[1:] != first[:-1]] = 0
    for c in range(1, width):
        tied = differs == width
        tied[:-1] |= tied[1:]  # the head of a run of ties belongs to it
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        run = np.cumsum(differs[rows] != width)
        words = keys[order[rows], c]
        inner = np.lexsort((words, run))
        order[rows] = order[rows[inner]]
        words, run = words[inner], run[inner]
        fresh = np.concatenate([[False], (words[1:] != words[:-1]) & (run[1:] == run[:-1])])
        differs[rows[fresh]] = c
    return order, differs


def packed_words(rows: np.ndarray) -> np.ndarray:
    """Byte rows as big-endian 64-bit words, padded with zeros."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, :rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def smallest_of_runs(differs: np.ndarray, width: int, order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For every row the smallest of ``values`` among rows equal to it."""
    heads = np.flatnonzero(differs < width)
    out = np.empty(len(values), values.dtype)
    if len(heads):
        least = np.minimum.reduceat(values[order], heads)
        out[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out


def _zip(*arrays: np.ndarray) -> list[bytes]:
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    return [press.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unzip(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _planes(values: np.ndarray) -> np.ndarray:
    """Sorted 48-bit numbers as byte planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)


def _from_planes(data: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(data) // 6, 8), np.uint8)
    whole[:, :6] = data.reshape(6, -1).T
    return np.cumsum(whole.view("<u8").ravel(), dtype=np.uint64)


class _Chunk:
    """Texts of one chunk, less whole copies, laid end to end in the order of their keys, with their tokens."""

    def __init__(self, texts: pa.Table, copies: set[int]):
        import zstandard

        reader = zstandard.ZstdDecompressor()
        rows = [(d, b) for d, b in zip(texts.column("doc").to_pylist(), texts.column("blob").to_pylist()) if d is not None and d not in copies]
        rows.sort()
        parts = [reader.decompress(b) for _, b in rows]
        self.docs = np.array([d for d, _ in rows], np.int64)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.place, self.low, self.high, hashes = tokens_in_parts(self.data, self.starts, self.sizes)
        self.text = np.searchsorted(self.starts, self.place, "right") - 1
        # texts without bytes share a start with the next one; the last of them is the one that holds the place
        self.grams, self.gram = np.unique(hashes >> np.uint64(16), return_inverse=True)

    def repeated(self) -> np.ndarray:
        """Whether a gram lies in two documents of the chunk."""
        doc = self.docs[self.text]
        low, high = np.full(len(self.grams), np.iinfo(np.int64).max), np.full(len(self.grams), np.iinfo(np.int64).min)
        np.minimum.at(low, self.gram, doc)
        np.maximum.at(high, self.gram, doc)
        return low < high


def _copies(side: pa.Table) -> set[int]:
    return {d for d in _column(side, "doc") if d is not None}


def _column(side: pa.Table, name: str) -> list:
    """A column's values; the missing side of a cogroup has no columns."""
    return side.column(name).to_pylist() if name in side.column_names else []


SIDE = "chunk long, part int, data binary, doc long"


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", chunk_docs: int = CHUNK_DOCS, heavy: int = HEAVY) -> DataFrame:
    """The key, ``n_bytes``, ``removed`` (maximal spans of bytes, end exclusive) and ``kept`` (the other bytes) of every row."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc"), text)
    total = rows.count()
    chunks = max(1, -(-total // chunk_docs))
    ranges = 2 * chunks
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        for piece in text_pieces(batches, text):
            blobs = [(t or "").encode() for t in piece.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), pa.array([packer.compress(b) for b in blobs], pa.binary()), pa.array([xxhash.xxh3_128_digest(b) for b in blobs], pa.binary()),
                 pa.array([len(b) for b in blobs], pa.int64())], names=["doc", "blob", "digest", "n_bytes"])

    # 1. texts, once, in buckets of chunks; rows with a null key are spread by their text
    table = f"chunks_{uuid.uuid4().hex}"
    chunk = F.pmod(F.xxhash64("doc", F.when(F.col("doc").isNull(), F.col("digest"))), F.lit(chunks)).cast("long")
    rows.mapInArrow(press, "doc long, blob binary, digest binary, n_bytes long").withColumn("chunk", chunk).repartition(partitions, "chunk").write.option(
        "path", new_path(spark, table)).option("compression", "none").bucketBy(partitions, "chunk").saveAsTable(table)
    stored = spark.table(table)
    texts = stored.select("chunk", "doc", "blob").groupBy("chunk")

    # 2. copies of whole texts: all but the smallest document of a digest
    whole = stored.where(F.col("doc").isNotNull() & (F.col("n_bytes") >= LENGTH)).select("chunk", "doc", "digest", "n_bytes")
    first = whole.groupBy("digest", "n_bytes").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last"))
    copies = cut_lineage(whole.join(first, ["digest", "n_bytes"]).where(F.col("doc") > F.col("first")).select(
        "chunk", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("data"), "doc"))
    by_chunk = copies.groupBy("chunk")

    # 3. screen
    def grams(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"chunk": [], "bucket": [], "grams": [], "twice": []}
        if left.num_rows:
            c = _Chunk(left, _copies(right))
            twice = c.repeated()
            cuts = np.searchsorted(c.grams, (np.arange(chunks + 1, dtype=object) * (1 << 48) // chunks).astype(np.uint64))
            for b in range(chunks):
                here = slice(cuts[b], cuts[b + 1])
                if cuts[b] < cuts[b + 1]:
                    for column, value in zip(out.values(), (left.column("chunk")[0].as_py(), b, *_zip(_planes(c.grams[here]), np.packbits(twice[here])))):
                        column.append(value)
        return pa.Table.from_pydict(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("twice", pa.binary())]))

    def answer(group: pa.Table) -> pa.Table:
        sent = [_from_planes(_unzip(g, "u1")) for g in group.column("grams").to_pylist()]
        twice = [np.unpackbits(_unzip(t, "u1"))[:len(g)].astype(bool) for t, g in zip(group.column("twice").to_pylist(), sent)]
        values, where, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        again = times > 1
        again[where[np.concatenate(twice)]] = True
        flags = np.split(again[where], np.cumsum([len(s) for s in sent])[:-1])
        n = group.num_rows
        return pa.table({"chunk": group.column("chunk"), "part": group.column("bucket"), "data": pa.array([_zip(np.packbits(f))[0] for f in flags], pa.binary()),
                         "doc": pa.nulls(n, pa.int64())})

    screened = texts.cogroup(by_chunk).applyInArrow(grams, "chunk long, bucket int, grams binary, twice binary")
    flags = screened.groupBy("bucket").applyInArrow(answer, SIDE)

    # 4. splitters from the tokens of sampled documents; they decide balance only
    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_pieces(batches, text):
            for t in piece.column(text).to_pylist():
                data = np.frombuffer((t or "").encode(), np.uint8)
                place = tokens(data, np.zeros(1, np.int64), np.array([len(data)]))[0]
                found = sorted({data[p:p + GRAM].tobytes() for p in place})[::7]
                yield pa.RecordBatch.from_pydict({"gram": found}, schema=pa.schema([("gram", pa.binary())]))

    share = min(1.0, min(SAMPLE_DOCS * ranges, MOST_SAMPLED) / max(total, 1))
    sampled = sorted(bytes(r[0]) for r in rows.sample(share, seed=11).mapInArrow(leading, "gram binary").collect())
    splitters = [sampled[i * len(sampled) // ranges] for i in range(1, ranges)] if sampled else []
    seen: dict[bytes, int] = {}
    for g in sampled:
        seen[g] = seen.get(g, 0) + 1
    common = frozenset(g for g, k in seen.items() if k >= heavy)

    # 5. contexts of repeated grams to their ranges; what repeats inside the chunk is settled here
    packed = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("bytes", pa.binary()), ("numbers", pa.binary())])

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in packed}
        if left.num_rows:
            own = left.column("chunk")[0].as_py()
            c = _Chunk(left, _copies(right))
            cuts = np.searchsorted(c.grams, (np.arange(chunks + 1, dtype=object) * (1 << 48) // chunks).astype(np.uint64))
            again = np.zeros(len(c.grams), bool)
            for part, data in zip(_column(right, "part"), _column(right, "data")):
                if part >= 0:
                    n = cuts[part + 1] - cuts[part]
                    again[cuts[part]:cuts[part + 1]] = np.unpackbits(_unzip(data, "u1"))[:n]
            kept: dict[tuple, int] = {}
            items: dict[int, list] = {}
            settled: list[tuple] = []
            raw = c.data.tobytes()
            picked = np.flatnonzero(again[c.gram]) if len(c.grams) else []
            for place, low, high, text_no in zip(*[a[picked].tolist() for a in (c.place, c.low, c.high, c.text)]) if len(picked) else ():
                doc, start = int(c.docs[text_no]), int(c.starts[text_no])
                gram = raw[place:place + GRAM]
                # a common gram's windows go their own ways, all others stay together as one context
                cut_up = gram in common
                for a, b in ((p, p) for p in range(low, high + 1)) if cut_up else ((low, high),):
                    mark = (place - a, raw[a:b + LENGTH])
                    smallest = kept.setdefault(mark, doc)  # texts come in the order of their keys
                    if smallest < doc:
                        settled.append((doc, a - start, b - a + LENGTH))
                        continue
                    target = ranges + hash_range(mark[1], ranges) if cut_up else bisect_right(splitters, gram)
                    items.setdefault(target, []).append((gram, mark[1], place - a, doc, a - start))
            for target, found in items.items():
                found.sort()
                numbers = np.array([(len(ctx), before, doc, at) for _, ctx, before, doc, at in found], "<i8").T
                for column, value in zip(out.values(), (target, own, int(target >= ranges), *_zip(np.frombuffer(b"".join(ctx for _, ctx, *_ in found), np.uint8), numbers))):
                    column.append(value)
            if settled:
                for column, value in zip(out.values(), (own % ranges, own, 2, b"", _zip(np.array(settled, "<i8").T)[0])):
                    column.append(value)
        return pa.Table.from_pydict(out, schema=packed)

    def hash_range(window: bytes, n: int) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(window) % n

    # 6. a range sorts its suffixes
    def sort_range(group: pa.Table) -> pa.Table:
        chunk_of, out = [], []
        data, numbers, owner = [], [], []
        windows_only = False
        for own, kind, blob, nums in zip(*[group.column(k).to_pylist() for k in ("chunk", "kind", "bytes", "numbers")]):
            if kind == 2:
                chunk_of.append(own)
                out.append(nums)
                continue
            windows_only = kind == 1
            numbers.append(_unzip(nums, "<i8").reshape(4, -1))
            data.append(_unzip(blob, "u1"))
            owner.append(np.full(numbers[-1].shape[1], own))
        if numbers:
            owners, sizes_before = np.concatenate(owner), np.concatenate(numbers, axis=1)
            gone = settle(np.concatenate(data), sizes_before, windows_only)
            order = np.argsort(owners[gone[0]], kind="stable")
            item, offset, length = (g[order] for g in gone)
            spans = np.stack([sizes_before[2][item], sizes_before[3][item] + offset, length])
            heads = np.flatnonzero(np.concatenate([[True], owners[item][1:] != owners[item][:-1]])) if len(item) else []
            for a, b in zip(heads, np.append(heads[1:], len(item)) if len(item) else []):
                chunk_of.append(int(owners[item[a]]))
                out.append(_zip(spans[:, a:b].astype("<i8"))[0])
        n = len(out)
        return pa.table({"chunk": pa.array(chunk_of, pa.int64()), "part": pa.array([0] * n, pa.int32()), "data": pa.array(out, pa.binary()), "doc": pa.nulls(n, pa.int64())})

    spans = texts.cogroup(copies.unionByName(flags).groupBy("chunk")).applyInArrow(contexts, "range int, chunk long, kind int, bytes binary, numbers binary")
    spans = spans.groupBy("range").applyInArrow(sort_range, SIDE)

    # 7. removal
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    result = T.StructType([T.StructField(key, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.BinaryType())])
    arrow = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        reader, gone = zstandard.ZstdDecompressor(), _copies(right)
        marked = [_unzip(d, "<i8").reshape(3, -1) for d in _column(right, "data") if d is not None]
        by_doc: dict[int, np.ndarray] = {}
        if marked:
            cuts = np.concatenate(marked, axis=1)
            cuts = cuts[:, np.argsort(cuts[0], kind="stable")]
            docs, heads = np.unique(cuts[0], return_index=True)
            by_doc = {int(d): c[1:] for d, c in zip(docs, np.split(cuts, heads[1:], axis=1))}
        out: dict[str, list] = {f.name: [] for f in arrow}
        for doc, blob in zip(_column(left, "doc"), _column(left, "blob")):
            data = reader.decompress(blob)
            runs: list[tuple[int, int]] = []
            if doc in gone:
                runs = [(0, len(data))]
            elif doc in by_doc:
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, by_doc[doc][0], 1)
                np.add.at(edge, by_doc[doc][0] + by_doc[doc][1], -1)
                inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                change = np.flatnonzero(inside[1:] != inside[:-1])
                runs = list(zip(change[::2].tolist(), change[1::2].tolist()))
            kept, at = [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            for column, value in zip(out.values(), (doc, len(data), [{"start": a, "end": b} for a, b in runs], b"".join([*kept, data[at:]]))):
                column.append(value)
        return pa.Table.from_pydict(out, schema=arrow)

    return texts.cogroup(copies.unionByName(spans).groupBy("chunk")).applyInArrow(remove, result)


def settle(data: np.ndarray, numbers: np.ndarray, windows_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, offset in its context, length) of what repeats with a smaller key, among contexts laid end to end in ``data``.

    ``numbers`` has, per item, the context's length, the bytes before the token, and the key.
    """
    length, before, doc = numbers[0], numbers[1], numbers[2]
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    n, width = len(length), LENGTH + SPREAD - 1
    # suffix from the token on, then what stands before it, then both lengths
    place = np.arange(width)
    rows = np.zeros((n, width + SPREAD + 1), np.uint8)
    ends = length - before
    suffix = place[None, :] < ends[:, None]
    rows[:, :width][suffix] = data[(begin + before)[:, None].repeat(width, 1)[suffix] + np.broadcast_to(place, (n, width))[suffix]]
    back = np.arange(SPREAD - 1)
    prefix = back[None, :] < before[:, None]
    rows[:, width:width + SPREAD - 1][prefix] = data[begin[:, None].repeat(SPREAD - 1, 1)[prefix] + np.broadcast_to(back, (n, SPREAD - 1))[prefix]]
    rows[:, -2], rows[:, -1] = before, ends
    words = packed_words(rows)
    order, differs = multikey_sort(words)
    smallest = smallest_of_runs(differs, words.shape[1], order, doc)
    whole = np.flatnonzero(smallest < doc)
    found = [(whole, np.zeros(len(whole), np.int64), length[whole])]
    if windows_only:
        return found[0]
    # one item of each different context; grams with several contexts have their windows compared
    heads = order[differs < words.shape[1]]
    gram = rows[heads, :GRAM]
    group = np.cumsum(np.concatenate([[True], (gram[1:] != gram[:-1]).any(axis=1)])) - 1 if len(heads) else np.zeros(0, np.int64)
    several = np.bincount(group)[group] > 1 if len(heads) else np.zeros(0, bool)
    run_of = np.empty(n, np.int64)
    run_of[order] = np.cumsum(differs < words.shape[1]) - 1
    open_items = np.flatnonzero((smallest == doc) & several[run_of]) if n else np.zeros(0, np.int64)
    # all open items of a run have the same key and windows; the run's head speaks for it
    speaks = np.full(len(heads), -1)
    speaks[run_of[open_items][::-1]] = open_items[::-1]
    members = np.split(open_items[np.argsort(run_of[open_items], kind="stable")], np.flatnonzero(np.diff(np.sort(run_of[open_items]))) + 1) if len(open_items) else []
    member_of = {int(run_of[m[0]]): m for m in members}
    chosen = np.flatnonzero(several)
    at = 0
    while at < len(chosen):
        stop, held = at, 0
        while stop < len(chosen) and (held < SORT_BYTES or group[chosen[stop]] == group[chosen[stop - 1]]):
            held += int(length[speaks[chosen[stop]]] - LENGTH + 1) * LENGTH
            stop += 1
        runs = chosen[at:stop]
        at = stop
        items = speaks[runs]
        count = length[items] - LENGTH + 1
        which = np.repeat(np.arange(len(items)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        windows = data[(begin[items][which] + offset)[:, None] + np.arange(LENGTH)]
        keys = packed_words(windows)
        order_w, differs_w = multikey_sort(keys)
        own = doc[items][which]
        hit = np.flatnonzero(smallest_of_runs(differs_w, keys.shape[1], order_w, own) < own)
        for k in np.unique(which[hit]).tolist():
            offsets = offset[hit[which[hit] == k]] if len(hit) < 1000 else offset[hit[np.searchsorted(which[hit], k):np.searchsorted(which[hit], k, "right")]]
            for item in member_of[int(runs[k])].tolist():
                found.append((np.full(len(offsets), item), offsets, np.full(len(offsets), LENGTH)))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))
