"""Best-fit packing by sums of squares.

Documents become pieces of at most ``capacity`` tokens; a piece goes where the sum over residual gaps of (open sequences with
that gap) squared becomes smallest. Keeping the counts of all gaps level leaves some open sequence that any later piece fills.

What few different lengths leave half-empty is put together afterwards, whole sequences into gaps.

Pieces are dealt to shards, repeated rows like any others, and each shard packs on its own; sequences that a shard leaves emptier
than its average are taken apart again and their pieces packed together in the next level, so shards cost next to nothing in fill.
A shard hands on half of its pieces at most, so every level is at most half as large as the one before it, whatever the lengths.

Cases: a null text counts as empty, an empty one is one piece of one closing token; only documents longer than ``capacity``
are cut; repeated rows are packed each; an empty table gives an empty table; other columns of the input are not carried.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corvane.llm.common import give_back, remembered, text_pieces
from corvane.session import cut_lineage

CAPACITY = 4096
END = 1
#: Pieces packed in one task (about 40 bytes each) and open sequences a shard hands on.
SHARD_PIECES, HANDED_ON = 20_000, 64
#: Different words a Python worker remembers the ids of (some 400 bytes each), and their longest length: longer ones are encoded each time.
CACHED_WORDS, CACHED_LENGTH = 200_000, 64
#: Words replaced by their ids in one go.
WORDS_AT_ONCE = 500_000


def _marked(values: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(values))


_SPACE, _CLOSING, _LETTER = _marked(b" \t\n\r\x0b\x0c"), _marked(b".,;:!?"), _marked(bytes(range(97, 123)))


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words, the number of each word of all texts in a row, and the words of each text.

    Words are lower-cased in A-Z, with closing punctuation after a letter on its own: the tokenizer does both as well, and fewer
    different words are left. A text that may spell a special token keeps its case, since those are matched as written.
    """
    data = np.frombuffer(b"\n".join([b"", *(t if b"<|" in t else t.lower() for t in texts), b""]), np.uint8)
    space, marks = _SPACE[data], _CLOSING[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    # words that end in marks, and where that run of marks begins
    closed = np.flatnonzero(marks[ends - 1])
    runs = np.flatnonzero(~marks[:-1] & marks[1:]) + 1
    bare = runs[np.searchsorted(runs, ends[closed] - 1, "right") - 1]
    after_letter = _LETTER[data[bare - 1]]
    closed, bare = closed[after_letter], bare[after_letter]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    offsets = np.insert(offsets, closed + 1, offsets[closed] + bare - starts[closed])
    starts = np.insert(starts, closed + 1, bare)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~space])])
    found = words.dictionary_encode()
    after = np.cumsum([len(t) + 1 for t in texts])
    held, cuts = found.dictionary.buffers()[2].to_pybytes(), np.frombuffer(found.dictionary.buffers()[1], np.int64)[:len(found.dictionary) + 1].tolist()
    return [held[a:b] for a, b in zip(cuts, cuts[1:])], found.indices.to_numpy(), np.diff(np.searchsorted(starts, np.append(0, after), "right"))


#: The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class WordEncoder:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a row (cut at ASCII
    white space). Words repeat, so most are looked up; new ones are encoded together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.again: set[bytes] = set()  # known words that later texts had as well, since the cache was three quarters full

    def encode(self, texts: list) -> list[np.ndarray]:
        words, codes, sizes = _words([(t or "").encode() for t in texts])
        ids = [*map(self.known.get, words)]
        fresh = [w for w, i in zip(words, ids) if i is None]
        here = (w for w, i in zip(words, ids) if i is not None)
        if 4 * len(self.known) > 3 * CACHED_WORDS:
            self.again.update(here)
        if len(self.known) + len(fresh) > CACHED_WORDS:
            # most words of a corpus come once: those that came again are kept, or if they are too many, none
            self.known = {w: self.known[w] for w in self.again} if 2 * len(self.again) < CACHED_WORDS else {}
            self.again = set()
        made = self._ids(fresh)
        self.known.update((w, i) for w, i in zip(fresh, made) if len(w) <= CACHED_LENGTH)
        made = iter(made)
        ids = [next(made) if i is None else i for i in ids] + [np.array([END], "<u4").tobytes()]
        # each text's words with the closing token behind them, replaced by their ids
        closes = np.cumsum(sizes + 1) - 1
        row = np.full(len(codes) + len(sizes), len(words), np.int32)
        inside = np.ones(len(row), bool)
        inside[closes] = False
        row[inside] = codes
        table, lengths = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(lengths) - lengths
        parts, n = [], []
        for at in range(0, len(row), WORDS_AT_ONCE):
            some = row[at:at + WORDS_AT_ONCE]
            n.append(lengths[some])
            ends = np.cumsum(n[-1])
            parts.append(table[np.arange(ends[-1]) + np.repeat(begins[some] - ends + n[-1], n[-1])])
        return np.split(np.concatenate(parts), np.cumsum(np.concatenate(n))[closes[:-1]]) if parts else []

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the tokenizer gives them."""
        out, whole = [], []
        for w in words:
            word = w.decode()
            # one run of letters that normalisation leaves alone goes straight to the tokenizer's model
            if w.isalpha() and w.islower():
                out.append(array("I", [t.id for t in self.model.tokenize(word)]).tobytes())
            elif word.isalpha() and word == word.lower() and is_normalized("NFC", word):
                out.append(array("I", [t.id for t in self.model.tokenize(w.decode("latin-1").translate(_BYTE_LETTERS))]).tobytes())
            else:
                out.append(b"")
                whole.append((len(out) - 1, word))
        for (k, _), e in zip(whole, self.tokenizer.encode_batch_fast([word for _, word in whole], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out


def pieces(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, payload: str = "ids") -> DataFrame:
    """One row per piece: the key, ``piece``, ``start``, ``length`` and the ids
    (``payload="ids"``, array<int>) or only their CRC-32 (``payload="crc32"``). ``tokenizer`` is a file name of the public
    tokenizers or a path that every executor can read."""
    import os

    extra = T.StructField("ids", T.ArrayType(T.IntegerType())) if payload == "ids" else T.StructField("ids_crc32", T.LongType())
    schema = T.StructType([df.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        # one thread per worker: Spark has a task for every core, and each thread of the tokenizer keeps memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        give_back()
        encoder = remembered(f"encoder {tokenizer}", lambda: WordEncoder(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)))
        for batch in text_pieces(batches, text, 1_000_000):
            rows: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(encoder.encode(batch.column(text).to_pylist())):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    for column, value in zip(rows, (i, k, at, len(part), part.astype("<i4") if payload == "ids" else zlib.crc32(part.tobytes()))):
                        column.append(value)
            kind = pa.list_(pa.int32()) if payload == "ids" else pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
                 pa.array(rows[3], pa.int64()), pa.array(rows[4], kind)], names=[f.name for f in schema])
        give_back()

    return df.select(key, text).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset for each length, longest first, and the gap that each sequence is left with."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap; gap 0 is closed and not counted
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[int] = []
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        a = int(lengths[i])
        # taking gap g turns N[g] into N[g] - 1 and N[g - a] into N[g - a] + 1
        change = 2 * (counts[:capacity - a] - counts[a:capacity]) + 2
        change[counts[a:capacity] == 0] = never
        if len(change) and counts[a]:
            change[0] = 1 - 2 * counts[a]
        best = int(change.argmin()) if len(change) else -1
        opened = 2 * int(counts[capacity - a]) + 1 if a < capacity else 0
        if best >= 0 and change[best] != never and change[best] <= opened:
            gap = best + a
            s = waiting[gap].pop()
            counts[gap] -= 1
        else:
            gap, s = capacity, len(gaps)
            gaps.append(capacity)
        sequence[i], offset[i] = s, capacity - gap
        gaps[s] = gap - a
        if gap > a:
            counts[gap - a] += 1
            waiting[gap - a].append(s)
    return sequence, offset, np.array(gaps, np.int64)


def merged(sequence: np.ndarray, offset: np.ndarray, gaps: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole sequences put into the gaps of others, fullest first, each where the least is left.

    Level gap counts mean many half-empty sequences when there are few different lengths; here they become full ones.
    """
    fills = capacity - gaps
    if not len(gaps) or fills.min() > gaps.max():
        return sequence, offset, gaps
    open_ = np.zeros(capacity + 1, np.int64)  # sequences by gap
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    into, shift, kept = np.arange(len(gaps)), np.zeros(len(gaps), np.int64), gaps.copy()
    for s in np.argsort(-fills, kind="stable").tolist():
        fit = open_[fills[s]:] > 0
        least = int(fit.argmax())
        least = least if fit[least] else -1
        if least >= 0:
            gap = least + int(fills[s])
            t = waiting[gap].pop()
            open_[gap] -= 1
            into[s], shift[s] = t, capacity - gap
            kept[t] = gap - fills[s]
        else:
            t = s
        if kept[t]:
            open_[kept[t]] += 1
            waiting[kept[t]].append(t)
    names = np.cumsum(into == np.arange(len(gaps))) - 1
    return names[into[sequence]], offset + shift[sequence], kept[into == np.arange(len(gaps))]


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. Columns of the input with these names are replaced."""
    names = ["sequence_id", "offset", "_shard", "_open"]
    base = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in names])
    schema = T.StructType([*base.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_open", T.BooleanType())])
    level, done = 0, None
    todo = cut_lineage(base)
    while True:
        n = todo.count()
        shards = max(1, -(-n // SHARD_PIECES))
        number, last = level, shards == 1

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            shard = int(key[0])
            sequence, offset, gaps = merged(*sum_of_squares(rows[length].to_numpy(np.int64), capacity), capacity)
            out = rows.drop(columns="_shard")
            again = np.zeros(len(gaps), bool)
            if not last:
                emptiest = np.argsort(-gaps, kind="stable")[:HANDED_ON]
                emptiest = emptiest[gaps[emptiest] > gaps.mean()]
                held = np.cumsum(np.bincount(sequence, minlength=len(gaps))[emptiest])
                again[emptiest[2 * held <= len(sequence)]] = True
            out["sequence_id"] = number << 56 | shard << 24 | sequence
            out["offset"], out["_open"] = offset, again[sequence]
            return out

        # numbered as they lie in the checkpoint, so that a row that repeats a million times is many shards' work
        spread = todo.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(shards)))
        packed = spread.groupBy("_shard").applyInPandas(run, schema)
        if last:
            packed = packed.drop("_open")
            return packed if done is None else done.unionByName(packed)
        packed = cut_lineage(packed)
        closed = packed.where("not _open").drop("_open")
        done = closed if done is None else done.unionByName(closed)
        todo = cut_lineage(packed.where("_open").select(*base.columns))
        level += 1


def pack_documents(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, payload: str = "ids") -> DataFrame:
    return pack(pieces(df, tokenizer, text, key, capacity, payload), "length", capacity)
