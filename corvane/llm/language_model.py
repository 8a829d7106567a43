"""Document scores by a hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class softmax is a maximum-entropy model over hashed features of the
history: the previous word itself, its class (n-grams), the last frequent word at any distance (skip), and the latter two together,
hashed into a fixed number of rows. Two classes stand for "the previous word again" and "the word before it again". Inside a class a
word has the share (count + 1) / (sum of counts + 1 over the class, and 1 for all unseen words); with ``word_pairs`` this is where a
second softmax starts from, whose features are the pairs of the previous word and the word.

Training has two stages, and a third with ``word_pairs``. (1) Without the previous word the history is (previous class, last frequent word), so all training tokens
add up to a table of contexts by classes of fixed size; every step is a full-batch gradient step over all training tokens, computed
in distributed tasks. (2) Every word that training holds ``MIN_COUNT`` times or more gets weights of its own, a row of classes
under the 64-bit hash of the word; their number grows with the corpus. A row's gradient depends on nothing but the tokens that
follow its word, so chunks send what followed each word and in which contexts, sums are made in two levels, and rows take their
gradient steps (with a Gaussian prior) next to each other, in as many tasks as there are words. Rows are never collected: like the
word counts they are joined by word to the chunks that hold the word. (3) Inside a class the softmax has a weight for every pair of
a previous word and a word that training holds, however rare; pairs without one leave the share as it is, so the normaliser is 1 and
what the pairs of this previous word and class add to it. Weights of a previous word and class depend on no others: chunks send their
pairs to tasks by a hash of these two, all pairs of the corpus take full-batch gradient steps there (with the same prior), and each
chunk gets its own pairs' weights and normalisers back, in the order in which it sent them. Weights are rounded before use, so that
the softmax that scores is normalised exactly.

Words are looked up once: a chunk is laid out as numbers of its words, with their counts, classes and hashes, and kept that way.

Cases: a null or empty text is the end token alone; a null key counts as empty text for the held-out rule; repeated rows are
scored each and count each; very long texts are read whole; without training documents every token is unseen; an empty table
gives an empty table; other input columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm.common import give_back, remembered, text_pieces
from corvane.session import cut_lineage, new_path, release

#: Documents in a chunk; a chunk's texts and its different words are held by one task.
CHUNK_DOCS = 4096
#: Frequent words that are a class of their own, classes of the other words (by hashed ending), rows for hashed feature pairs.
FREQUENT, ENDINGS, PAIR_ROWS = 40, 48, 4096
END, AGAIN, BEFORE_AGAIN, FIRST = 0, 1, 2, 3
CLASSES = FIRST + FREQUENT + ENDINGS
CONTEXTS = CLASSES * (FREQUENT + 1)
#: Gradient steps and their size (Adam with the usual decay rates), and the weight decay.
STEPS, RATE, DECAY = 40, 0.25, 1e-7


#: Training count from which a word has weights of its own; words a task trains together; steps, prior and rounding of these weights.
MIN_COUNT, WORDS_AT_ONCE = 300, 500
WORD_STEPS, PRIOR, ROUNDED = 8, 2.0, 1 / 16
#: What a sum over a word is kept for: classes that followed it, then contexts in which something followed it.
SLOTS = CLASSES + CONTEXTS
SUMS = "part int, salt int, key long, slots array<int>, counts array<bigint>"
#: Training tokens whose pairs of words a task trains together; steps and rounding of these weights.
TOKENS_AT_ONCE, PAIR_STEPS, PAIR_ROUNDED = 2_000_000, 12, 1 / 256
#: Pairs of a chunk for one part: per group (a previous word and a class) its hash (less that before it) and size, per pair the word's hash, its count and the pair's.
PAIRS = "part int, chunk long, groups binary, sizes binary, words binary, counts binary, n binary"


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 7 == 2


def word_class(word: bytes, frequent: dict[bytes, int]) -> int:
    """The class of a word: its own if it is frequent, else one by its last two letters and closing punctuation."""
    if not word:
        return END
    own = frequent.get(word)
    if own is not None:
        return FIRST + own
    stem = word.rstrip(b".,;:!?")
    return FIRST + FREQUENT + crc32(stem[-2:] + (b"." if len(stem) < len(word) else b"")) % ENDINGS


def _endings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of endings by (closing punctuation, letters), for endings of none, one and two bytes."""
    def of(stem: bytes, closed: int) -> int:
        return FIRST + FREQUENT + crc32(stem + b"." * closed) % ENDINGS

    pairs = [[of(bytes((a, b)), closed) for a in range(256) for b in range(256)] for closed in (0, 1)]
    return np.array([of(b"", 0), of(b"", 1)]), np.array([[of(bytes((a,)), closed) for a in range(256)] for closed in (0, 1)]), np.array(pairs)


_CLOSING = np.isin(np.arange(256), list(b".,;:!?"))


def word_classes(words: pa.Array, frequent: dict[bytes, int]) -> np.ndarray:
    """``word_class`` of each word of an array."""
    words = words.cast(pa.large_binary())
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
        words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    starts, ends = offsets[:-1], offsets[1:]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[:ends[-1]]
    # the last byte that does not close a word, at or before each byte
    letter = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data)))) if len(data) else np.zeros(1, np.int64)
    stop = np.where(ends > starts, np.maximum(letter[np.maximum(ends, 1) - 1] + 1, starts), starts)
    closed, size = (stop < ends).astype(np.int64), stop - starts
    byte = lambda back: data[np.maximum(stop - back, 0)].astype(np.int64) if len(data) else np.zeros(len(words), np.int64)
    none, one, two = remembered("op9_endings", _endings)
    out = np.where(size >= 2, two[closed, byte(2) * 256 + byte(1)], np.where(size == 1, one[closed, byte(1)], none[closed]))
    own = pc.index_in(words, value_set=pa.array(list(frequent), pa.large_binary())).fill_null(-1).to_numpy()
    numbers = np.array([*frequent.values(), 0], np.int64)
    return np.where(ends == starts, END, np.where(own >= 0, FIRST + numbers[own], out))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of text whose words are laid out in one go; the arrays of a piece take some 40 times as much.
TEXT_AT_ONCE = 2_000_000


def pieces_of(blobs: list[bytes]) -> Iterator[list[bytes]]:
    """The texts of compressed ``blobs``, some ``TEXT_AT_ONCE`` bytes at a time."""
    import zstandard

    reader, texts, held = zstandard.ZstdDecompressor(), [], 0
    for blob in blobs:
        texts.append(reader.decompress(blob))
        held += len(texts[-1])
        if held >= TEXT_AT_ONCE:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


def encoded(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words (A-Z lower-cased), the number of each word of all texts in a row, and the words of each text."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~space])])
    found = words.dictionary_encode()
    after = np.cumsum([len(t) + 1 for t in texts])
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(starts, np.append(0, after), "right"))


def places_in(words: pa.Array, table: pa.ChunkedArray) -> np.ndarray:
    """The row of ``table`` that holds each word, -1 without one."""
    at = pc.index_in(words, value_set=table.cast(pa.large_binary()).combine_chunks())
    return at.fill_null(-1).to_numpy().astype(np.int64)


def laid_out(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in a row, each document closed by its end token: word numbers, ends -1, -2, ...; and the ends' places."""
    ends = np.cumsum(sizes + 1) - 1
    ids = np.empty(len(codes) + len(sizes), np.int64)
    inside = np.ones(len(ids), bool)
    inside[ends] = False
    ids[inside] = codes
    ids[ends] = -1 - np.arange(len(sizes))
    return ids, ends


def histories(ids: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context number and class, repeats included, of each token; ``classes`` are those of the words themselves."""
    at = np.arange(len(ids))
    out = classes.copy()
    is_end = np.zeros(len(ids), bool)
    is_end[ends] = True
    again, before = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    before[2:] = (ids[2:] == ids[:-2]) & ~is_end[1:-1]
    out[before] = BEFORE_AGAIN
    out[again] = AGAIN
    previous = np.concatenate([[END], out[:-1]])
    # place of the last frequent word or end before each token; an end means none
    marked = np.where(is_end | ((classes >= FIRST) & (classes < FIRST + FREQUENT)), at, -1)
    last = np.concatenate([[-1], np.maximum.accumulate(marked)[:-1]])
    seen = np.where((last >= 0) & ~is_end[np.maximum(last, 0)], classes[np.maximum(last, 0)] - FIRST + 1, 0)
    return previous * (FREQUENT + 1) + seen, out


def feature_rows(contexts: np.ndarray) -> np.ndarray:
    """The rows of the weight table that are on in each context: bias, n-gram, skip, and the hashed pair."""
    previous, seen = contexts // (FREQUENT + 1), contexts % (FREQUENT + 1)
    pair = (contexts * 2654435761 % (1 << 32)) % PAIR_ROWS
    return np.column_stack([np.zeros_like(contexts), 1 + previous, 1 + CLASSES + seen, 2 + CLASSES + FREQUENT + pair])


N_ROWS = 2 + CLASSES + FREQUENT + PAIR_ROWS


def class_log_probabilities(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    scores = weights[feature_rows(contexts)].sum(axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def folded(part: int, salt: int, keys: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Rows of ``SUMS``, one per different key, from single (key, slot, count) entries."""
    names, at = np.unique(keys, return_inverse=True)
    cells, where = np.unique(at * SLOTS + slots, return_inverse=True)
    total = np.bincount(where, counts, len(cells)).astype(np.int64)
    offsets = pa.array(np.searchsorted(cells // SLOTS, np.arange(len(names) + 1)).astype(np.int32))
    return pa.table({"part": pa.array(np.full(len(names), part, np.int32)), "salt": pa.array(np.full(len(names), salt, np.int32)), "key": pa.array(names),
                     "slots": pa.ListArray.from_arrays(offsets, pa.array((cells % SLOTS).astype(np.int32))),
                     "counts": pa.ListArray.from_arrays(offsets, pa.array(total))})


def entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (key, slot, count) entries of rows of ``SUMS``."""
    slots = rows.column("slots").combine_chunks()
    sizes = np.diff(slots.offsets.to_numpy())
    return (np.repeat(rows.column("key").to_numpy(), sizes), slots.flatten().to_numpy().astype(np.int64),
            rows.column("counts").combine_chunks().flatten().to_numpy())


@dataclass
class Words:
    """The different words of a chunk, those of a class side by side: class, training count and hash; and the place of the end token."""

    kinds: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    @property
    def end(self) -> int:
        return int(np.flatnonzero(self.kinds == END)[0])


#: A chunk is a row for its words (piece -1, ``codes`` has all of ``Words``) and rows for pieces of its texts, in this order.
LAYOUT = "chunk long, piece int, held_out array<boolean>, sizes binary, codes binary"


def pressed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def opened(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def words_of(row: dict) -> Words:
    values = opened(row["codes"], np.int64).reshape(3, -1)
    return Words(*values)


def laid_out_chunk(left: pa.Table, right: pa.Table, key: str, frequent: dict[bytes, int], schema: pa.Schema) -> pa.Table:
    """Rows of ``LAYOUT`` with the documents' keys, from the texts of a chunk and its words."""
    kinds, counts = word_classes(right.column("word"), frequent), right.column("c").to_numpy()
    order = np.lexsort((-counts, kinds))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    chunk, at, keys = left.column("chunk")[0].as_py(), 0, left.column(key)
    words = np.stack([kinds[order], counts[order], right.column("h").to_numpy()[order]])
    tables = [pa.Table.from_pydict({"_keys": [None], "chunk": [chunk], "piece": [-1], "held_out": [None], "sizes": [None], "codes": [pressed(words)]}, schema)]
    for i, texts in enumerate(pieces_of(left.column("blob").to_pylist())):
        found, codes, sizes = encoded(texts)
        here = slice(at, at + len(texts))
        at += len(texts)
        tables.append(pa.Table.from_pydict({
            "_keys": pa.ListArray.from_arrays([0, len(texts)], keys[here].combine_chunks().cast(schema.field("_keys").type.value_type)), "chunk": [chunk], "piece": [i], "held_out": [left.column("held_out")[here].to_pylist()],
            "sizes": [sizes.astype(np.int64).tobytes()], "codes": [pressed(place[places_in(found, right.column("word"))][codes].astype(np.int32))]}, schema))
    return pa.concat_tables(tables)


@dataclass
class Tokens:
    """The tokens of a piece in a row: word, the word before, context, class (repeats included), whether training has them; and the ends."""

    words: np.ndarray
    before: np.ndarray
    contexts: np.ndarray
    kinds: np.ndarray
    learnt: np.ndarray
    ends: np.ndarray


def tokens_of(row: dict, words: Words) -> Tokens:
    sizes = np.frombuffer(row["sizes"], np.int64)
    ids, ends = laid_out(opened(row["codes"], np.int32).astype(np.int64), sizes)
    which = np.where(ids < 0, words.end, ids)
    contexts, kinds = histories(ids, ends, words.kinds[which])
    return Tokens(which, np.append(words.end, which[:-1]), contexts, kinds, np.repeat(~np.array(row["held_out"], bool), sizes + 1), ends)


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Words, list[dict]]]:
    """The chunks of a task's rows of ``LAYOUT``."""
    chunk, words, pieces = None, None, []
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in ("chunk", "piece", "held_out", "sizes", "codes")}
            if row["piece"] >= 0:
                pieces.append(row)
                continue
            if words is not None:
                yield chunk, words, pieces
            chunk, words, pieces = row["chunk"], words_of(row), []
    if words is not None:
        yield chunk, words, pieces


def history_sums(layout: DataFrame, min_count: int, parts: int, salts: int) -> DataFrame:
    """Rows of ``SUMS`` over the training texts: contexts by class (part -1), and per word held ``min_count`` times what followed it.

    Chunks are summed in ``salts`` groups per part first, so that no task gets a row of every chunk for a word.
    """
    sums = T.StructType.fromDDL(SUMS)
    sums_schema = to_arrow_schema(sums)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, pieces in chunks_of(batches):
            give_back()
            table, found = np.zeros(CONTEXTS * CLASSES, np.int64), []
            common = words.counts >= min_count
            for piece in pieces:
                t = tokens_of(piece, words)
                table += np.bincount((t.contexts * CLASSES + t.kinds)[t.learnt], minlength=len(table))
                mine = t.learnt & common[t.before]
                before = t.before[mine] * SLOTS
                for cells in (before + t.kinds[mine], before + CLASSES + t.contexts[mine]):
                    where, names = pd.factorize(cells)
                    found.append((names, np.bincount(where, minlength=len(names))))
            used = np.flatnonzero(table)
            whole = [folded(-1, chunk % salts, used // CLASSES, used % CLASSES, table[used])]
            cells, n = (np.concatenate(c) for c in zip(*found))
            if len(cells):
                rows = folded(0, chunk % salts, words.hashes[cells // SLOTS], cells % SLOTS, n)
                whole.append(rows.set_column(0, "part", pa.array((rows.column("key").to_numpy() % parts).astype(np.int32))))
            yield from pa.concat_tables(whole).cast(sums_schema).to_batches()

    def add(rows: pa.Table) -> pa.Table:
        return folded(rows.column("part")[0].as_py(), rows.column("salt")[0].as_py(), *entries(rows))

    def add_all(rows: pa.Table) -> pa.Table:
        return folded(rows.column("part")[0].as_py(), 0, *entries(rows))

    chunks = layout.mapInArrow(follow, SUMS)
    return chunks.groupBy("part", "salt").applyInArrow(add, SUMS).groupBy("part").applyInArrow(add_all, SUMS)


# ---- pairs of words, inside a class ---------------------------------------------------------


@dataclass
class Pairs:
    """The different pairs of a previous word and a word of a chunk, as ``before * words + word`` in order, with their training counts.

    Pairs of a previous word and a class are a group; ``starts`` and ``sizes`` are those of the groups, ``groups`` their hashes
    (40 bits, then the class in 7), and ``order`` the groups by hash. Words that are a class of their own have no pairs.
    """

    names: np.ndarray
    n: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    groups: np.ndarray
    order: np.ndarray

    def sent(self) -> np.ndarray:
        """The pairs in the order of their groups' hashes."""
        sizes = self.sizes[self.order]
        return np.repeat(self.starts[self.order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(self.names))


def paired(t: Tokens) -> np.ndarray:
    """Tokens whose word is one of several in its class, and no repeat."""
    return t.kinds >= FIRST + FREQUENT


def pairs_of(words: Words, pieces: Iterator[Tokens]) -> Pairs:
    many, found = len(words.kinds), [np.zeros(0, np.int64)]
    for t in pieces:
        mine = paired(t)
        found.append((t.before[mine] * many + t.words[mine]) * 2 + t.learnt[mine])
    keys = np.sort(np.concatenate(found))
    names = keys >> 1
    first = np.flatnonzero(np.diff(names, prepend=-1))
    n = np.add.reduceat(keys & 1, first) if len(first) else keys
    names = names[first]
    before, kinds = names // many, words.kinds[names % many]
    starts = np.flatnonzero(np.diff(before * 128 + kinds, prepend=-1))
    x = words.hashes[before[starts]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + kinds[starts].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    groups = ((x ^ (x >> np.uint64(29))) >> np.uint64(24) << np.uint64(7)) | kinds[starts].astype(np.uint64)
    return Pairs(names, n, starts, np.diff(np.append(starts, len(names))), groups, np.argsort(groups, kind="stable"))


def pair_steps(group: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int = PAIR_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of pairs in multiples of ``PAIR_ROUNDED``, and the normaliser of each group (numbers 0, 1, ... in order), in logs.

    Pairs that training does not hold have no weight.
    """
    n_groups = int(group[-1]) + 1 if len(group) else 0
    out, here = np.zeros(len(n), np.int16), np.flatnonzero(n)
    g, times, s = group[here], n[here].astype(float), share[here]
    total = np.bincount(g, times, n_groups)[g]
    weights = np.log((times + PRIOR) / (total * s + PRIOR))

    def normalised(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = s * np.exp(weights)
        return part, 1 + np.bincount(g, part - s, n_groups)

    for _ in range(steps):
        part, z = normalised(weights)
        expected = total * part / z[g]
        # a gradient step per weight, scaled by a bound of its curvature and kept short
        weights += np.clip((times - expected - PRIOR * weights) / (expected + PRIOR), -1, 1)
    out[here] = np.clip(np.round(weights / PAIR_ROUNDED), -32000, 32000)
    return out, np.log(normalised(out[here] * PAIR_ROUNDED)[1])


def pair_weights(layout: DataFrame, totals: np.ndarray, parts: int) -> DataFrame:
    """``chunk``, ``part``, ``weights`` and ``norms`` of the pairs and groups that each chunk sent to each part, in its order."""
    pairs_schema = to_arrow_schema(T.StructType.fromDDL(PAIRS))
    answer = "chunk long, part int, weights binary, norms binary"
    answer_schema = to_arrow_schema(T.StructType.fromDDL(answer))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, words, pieces in chunks_of(batches):
            give_back()
            p = pairs_of(words, (tokens_of(piece, words) for piece in pieces))
            sent = p.sent()
            word = p.names[sent] % len(words.kinds)
            hashes, counts, n = (words.hashes[word] & 0xFFFFFFFF).astype(np.uint32), words.counts[word], p.n[sent]
            groups, sizes = p.groups[p.order], p.sizes[p.order]
            after = np.append(0, np.cumsum(sizes))
            # parts are ranges of hashes
            bounds = np.searchsorted((groups >> np.uint64(23)) * np.uint64(parts) >> np.uint64(24), np.arange(parts + 1).astype(np.uint64))
            rows = []
            for part in range(parts):
                a, b = bounds[part], bounds[part + 1]
                if a < b:
                    mine = slice(after[a], after[b])
                    rows.append((part, chunk, pressed(np.diff(groups[a:b], prepend=np.uint64(0))), pressed(sizes[a:b].astype(np.uint32)), hashes[mine].tobytes(), pressed(counts[mine]), pressed(n[mine])))
            yield pa.RecordBatch.from_pydict(dict(zip(pairs_schema.names, zip(*rows))) if rows else {c: [] for c in pairs_schema.names}, pairs_schema)

    def train_part(rows: pa.Table) -> pa.Table:
        give_back()
        column = lambda name, kind, open_=opened: [open_(v, kind) for v in rows.column(name).to_pylist()]
        groups, hashes = [np.cumsum(steps) for steps in column("groups", np.uint64)], column("words", np.uint32, np.frombuffer)
        sizes, counts, n = column("sizes", np.uint32), np.concatenate(column("counts", np.int64)), np.concatenate(column("n", np.int64))
        of_rows, of_groups = [len(h) for h in hashes], [len(g) for g in groups]
        names, group = np.unique(np.concatenate(groups), return_inverse=True)
        hashes = np.concatenate(hashes).astype(np.uint64)
        # a word is told from others of its group by 32 bits of its hash and by its count
        shift = 63 - max(1, int(len(names)).bit_length())
        x = (hashes << np.uint64(32) ^ counts.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (np.repeat(group, np.concatenate(sizes)).astype(np.int64) << shift) | (x >> np.uint64(64 - shift)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        g = key[first] >> shift
        share = (counts[order[first]] + 1.0) / totals[(names & np.uint64(127)).astype(np.int64)][g]
        weights, norms = pair_steps(g, np.add.reduceat(n[order], first), share)
        back = np.empty(len(order), np.int16)
        back[order] = np.repeat(weights, np.diff(np.append(first, len(order))))
        norms = norms[group].astype(np.float32)
        cut = lambda values, lengths: [pressed(v) for v in np.split(values, np.cumsum(lengths)[:-1])]
        return pa.Table.from_pydict({"chunk": rows.column("chunk"), "part": rows.column("part"), "weights": cut(back, of_rows), "norms": cut(norms, of_groups)}, answer_schema)

    return layout.mapInArrow(send, PAIRS).groupBy("part").applyInArrow(train_part, answer)


def context_table(sums: DataFrame) -> DataFrame:
    """``context``, ``counts`` (per class) of the contexts among ``sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, slots, counts = entries(pa.Table.from_batches([b]))
            contexts, where = np.unique(keys, return_inverse=True)
            table = np.zeros((len(contexts), CLASSES), np.int64)
            table[where, slots] = counts
            yield pa.RecordBatch.from_arrays([pa.array(contexts.astype(np.int32)), pa.array(list(table), pa.list_(pa.int64()))], names=["context", "counts"])

    return sums.where("part = -1").mapInArrow(run, "context int, counts array<bigint>")


def word_rows(keys: np.ndarray, slots: np.ndarray, counts: np.ndarray, base: np.ndarray, steps: int = WORD_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words among the entries and their weights per class; ``base`` is the class softmax without words (logs)."""
    names, at = np.unique(keys, return_inverse=True)
    seen, chances = np.zeros((len(names), CLASSES)), np.exp(base).astype(float)
    followed = slots < CLASSES
    seen[at[followed], slots[followed]] = counts[followed]
    at, context, n = at[~followed], slots[~followed] - CLASSES, counts[~followed].astype(float)
    order = np.argsort(at, kind="stable")
    context, n = context[order], n[order]
    starts = np.searchsorted(at[order], np.arange(len(names) + 1))
    weights = np.zeros_like(seen)
    for i, (begin, stop) in enumerate(zip(starts, starts[1:])):
        here, times, row = chances[context[begin:stop]], n[begin:stop], weights[i]
        squares = here * here
        for _ in range(steps):
            factor = np.exp(row)
            total = here @ factor
            share = times / total
            expected = factor * (share @ here)
            spread = expected - factor * factor * ((share / total) @ squares)
            # a gradient step per weight, scaled by its own curvature and kept short
            row += np.clip((seen[i] - expected - PRIOR * row) / (spread + PRIOR), -1, 1)
    return names, weights


def word_weights(sums: DataFrame, base: np.ndarray) -> DataFrame:
    """``h`` and ``weights`` (one rounded byte per class) of every word among ``sums``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, WORDS_AT_ONCE):
                names, rows = word_rows(*entries(pa.Table.from_batches([b.slice(at, WORDS_AT_ONCE)])), base)
                bytes_of = np.clip(np.round(rows / ROUNDED), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([r.tobytes() for r in bytes_of], pa.binary())], names=["h", "weights"])

    return sums.where("part >= 0").mapInArrow(run, "h long, weights binary")


def normalisers(chances: np.ndarray, factors: np.ndarray, contexts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum over the classes of chance times factor for pairs of a context and a word's row, 8,192 pairs at a time."""
    out = np.empty(len(contexts))
    for at in range(0, len(contexts), 8192):
        mine = slice(at, at + 8192)
        out[mine] = np.einsum("ij,ij->i", chances[contexts[mine]], factors[rows[mine]])
    return out


def train(counts: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights of the class softmax. A step sums, over the tasks, the gradients of their contexts; tables have a fixed size."""
    counts = cut_lineage(counts.coalesce(8))

    def gradient_of(weights: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, seen = np.zeros((N_ROWS, CLASSES)), 0
            for b in batches:
                contexts = b.column("context").to_numpy().astype(np.int64)
                table = b.column("counts").flatten().to_numpy().reshape(-1, CLASSES).astype(float)
                total = table.sum(axis=1, keepdims=True)
                miss = table - total * np.exp(class_log_probabilities(weights, contexts))
                for rows in feature_rows(contexts).T:
                    np.add.at(gradient, rows, miss)
                seen += int(total.sum())
            used = np.flatnonzero(gradient.any(axis=1)).astype("<i4")
            yield pa.RecordBatch.from_pydict({"used": [used.tobytes()], "gradient": [gradient[used].astype("<f4").tobytes()], "seen": [seen]})

        return run

    weights, mean, square = np.zeros((N_ROWS, CLASSES)), 0.0, 0.0
    for step in range(1, steps + 1):
        total, n = np.zeros_like(weights), 0
        for used, part, seen in counts.mapInArrow(gradient_of(weights), "used binary, gradient binary, seen long").collect():
            total[np.frombuffer(used, "<i4")] += np.frombuffer(part, "<f4").reshape(-1, CLASSES)
            n += seen
        if not n:
            return weights
        if step == 1:  # from the class shares on; one smoothed count each
            shares = total[0] + n / CLASSES + 1
            weights[0] = np.log(np.maximum(shares, 1) / np.maximum(shares, 1).sum())
            continue
        slope = total / n - DECAY * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights + RATE * (mean / (1 - 0.9 ** (step - 1))) / (np.sqrt(square / (1 - 0.99 ** (step - 1))) + 1e-6) * min(1.0, 12 / step)
    return weights


def score_documents(df: DataFrame, text: str = "text", key: str = "doc_id", chunk_docs: int = CHUNK_DOCS, steps: int = STEPS,
                    min_count: int = MIN_COUNT, word_pairs: bool = False) -> DataFrame:
    """The key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10) of every document.

    With ``word_pairs`` the softmax inside a class is trained too; without, words have their shares there.
    """
    spark = df.sparkSession
    docs = df.select(key, text, held_out(F.col(key)).alias("held_out"))
    chunks = max(1, -(-docs.count() // chunk_docs))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for piece in text_pieces(batches, text):
            blobs = [packer.compress((t or "").encode()) for t in piece.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(key), pa.array(blobs, pa.binary()), piece.column("held_out")], names=[key, "blob", "held_out"])

    packed = docs.mapInArrow(press, T.StructType([df.schema[key], T.StructField("blob", T.BinaryType()), T.StructField("held_out", T.BooleanType())]))
    packed = packed.withColumn("chunk", F.pmod(F.xxhash64(key, "blob"), F.lit(chunks)))

    def count_words(rows: pa.Table) -> pa.Table:
        give_back()
        learnt = np.array([not out for out in rows.column("held_out").to_pylist()], np.int64)
        tables, at = [pa.table({"word": pa.array([b""], pa.large_binary()), "n": pa.array([learnt.sum()])})], 0
        for texts in pieces_of(rows.column("blob").to_pylist()):
            words, codes, sizes = encoded(texts)
            n = np.bincount(codes, np.repeat(learnt[at:at + len(texts)], sizes), len(words)).astype(np.int64)
            tables.append(pa.table({"word": words, "n": n}))
            at += len(texts)
        table = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
        return pa.table({"chunk": pa.array(np.full(len(table), rows.column("chunk")[0].as_py())), "word": table.column("word").cast(pa.binary()), "n": table.column("n_sum")})

    by_word = Window.partitionBy("word")
    words = packed.groupBy("chunk").applyInArrow(count_words, "chunk long, word binary, n long")
    path = new_path(spark, "words")
    words.select("chunk", "word", F.sum("n").over(by_word).alias("c"), (F.min("chunk").over(by_word) == F.col("chunk")).alias("first")).write.parquet(path, compression="zstd")
    words = spark.read.parquet(path).withColumn("h", F.xxhash64("word"))
    vocabulary = words.where("first and c > 0").select("word", "c")
    facts = vocabulary.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") >= min_count)).first()
    n_train, n_words, n_common = int(facts[0] or 0), int(facts[1]), int(facts[2])
    common = words.where(F.col("c") >= min_count)
    ranked = vocabulary.where(F.length("word") > 0).orderBy(F.col("c").desc(), "word").limit(FREQUENT).collect()
    frequent = {bytes(r["word"]): k for k, r in enumerate(ranked)}

    def add_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES, np.int64)
        for b in batches:
            kinds = word_classes(b.column("word"), frequent)
            sums += np.bincount(kinds, b.column("c").to_numpy() + 1, CLASSES).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"class": np.arange(CLASSES, dtype=np.int32), "total": sums})

    class_sums = vocabulary.mapInArrow(add_classes, "class int, total long").groupBy("class").agg(F.sum("total").alias("total")).collect()
    totals = np.ones(CLASSES)
    for r in class_sums:
        totals[r["class"]] += r["total"]
    layout_type = T.StructType([T.StructField("_keys", T.ArrayType(df.schema[key].dataType)), *T.StructType.fromDDL(LAYOUT).fields])
    layout_schema = to_arrow_schema(layout_type)

    def lay_out(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return layout_schema.empty_table()
        give_back()
        return laid_out_chunk(left, right, key, frequent, layout_schema)

    layout = cut_lineage(packed.groupBy("chunk").cogroup(words.select("chunk", "word", "c", "h").groupBy("chunk")).applyInArrow(lay_out, layout_type))
    release(spark)
    sums = cut_lineage(history_sums(layout, min_count, max(1, -(-n_common // WORDS_AT_ONCE)), max(1, isqrt(chunks))))
    base = class_log_probabilities(train(context_table(sums), steps), np.arange(CONTEXTS)).astype(np.float32)
    rows_of = cut_lineage(word_weights(sums, base))
    release(spark)
    learnt = common.join(rows_of, "h", "left").select("chunk", "h", F.lit(None).cast("int").alias("part"), "weights", F.lit(None).cast("binary").alias("norms"))
    if word_pairs:
        answers = cut_lineage(pair_weights(layout, totals, max(1, -(-n_train // TOKENS_AT_ONCE))))
        release(spark)
        learnt = learnt.unionByName(answers.withColumn("h", F.lit(None).cast("long")))
    table = base / np.float32(np.log(10))
    log_totals = np.log10(totals)
    result = T.StructType([df.schema[key], T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    result_schema = to_arrow_schema(result)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return result_schema.empty_table()
        give_back()
        left = left.sort_by("piece")
        words, *pieces = (left.slice(i, 1) for i in range(left.num_rows))
        words = words_of({"codes": words.column("codes")[0].as_py()})
        counts, ones = words.counts, np.log10(words.counts + 1.0)
        class_rows, answers = (right.filter(pc.is_valid(right.column(c))) for c in ("h", "part"))
        class_rows = class_rows.filter(pc.is_valid(class_rows.column("weights")))
        row_of = np.full(len(counts), -1, np.int64)
        at = pc.index_in(pa.array(words.hashes), value_set=class_rows.column("h").combine_chunks()).fill_null(-1).to_numpy()
        common = counts >= min_count
        row_of[common] = at[common]
        rows = np.frombuffer(b"".join(class_rows.column("weights").to_pylist()), np.int8).reshape(-1, CLASSES).astype(np.float32) * np.float32(ROUNDED)
        chances, factors = np.exp(base), np.exp(rows)
        row = lambda piece: {c: piece.column(c)[0].as_py() for c in ("held_out", "sizes", "codes")}
        if word_pairs:
            p = pairs_of(words, (tokens_of(row(piece), words) for piece in pieces))
            answers = answers.sort_by("part")
            whole = lambda name, kind: np.concatenate([np.zeros(0, kind), *[opened(v, kind) for v in answers.column(name).to_pylist()]])
            given = np.empty(len(p.names))
            given[p.sent()] = (whole("weights", np.int16) * PAIR_ROUNDED - np.repeat(whole("norms", np.float32).astype(float), p.sizes[p.order])) / np.log(10)
        out = [[], [], [], []]
        for piece in pieces:
            t = tokens_of(row(piece), words)
            which, ends, contexts, kind = t.words, t.ends, t.contexts, t.kinds
            inside = np.where((kind == AGAIN) | (kind == BEFORE_AGAIN), 0.0, ones[which] - log_totals[kind])
            if word_pairs:
                mine = np.flatnonzero(paired(t))
                inside[mine] += given[np.searchsorted(p.names, t.before[mine] * len(counts) + which[mine])]
            chosen = table[contexts, kind].astype(float)
            before = row_of[t.before]
            mine = np.flatnonzero(before >= 0)
            where, pairs = pd.factorize(contexts[mine] * max(len(rows), 1) + before[mine])
            sums_of = normalisers(chances, factors, pairs // max(len(rows), 1), pairs % max(len(rows), 1))
            chosen[mine] += rows[before[mine], kind[mine]] / np.log(10) - np.log10(sums_of)[where]
            starts = np.concatenate([[0], ends[:-1] + 1])
            out[0].append(np.diff(np.append(starts, len(which))))
            out[1].append(np.add.reduceat((counts[which] > 0).astype(np.int64), starts))
            out[2].append(np.add.reduceat(ones[which], starts) - out[0][-1] * np.log10(n_train + n_words + 1.0))
            out[3].append(np.add.reduceat(chosen + inside, starts))
        n = sum(len(c) for c in out[0])
        joined = [np.concatenate(c) if c else np.zeros(0) for c in out]
        keys, held = (pa.chunked_array([piece.column(c).combine_chunks().flatten() for piece in pieces]) for c in ("_keys", "held_out"))
        return pa.table([keys, held, pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)),
                         pa.array(np.full(n, n_train, np.int64)), pa.array(joined[2].astype(float)), pa.array(joined[3].astype(float))], names=[f.name for f in result])

    return layout.groupBy("chunk").cogroup(learnt.groupBy("chunk")).applyInArrow(score, result)
