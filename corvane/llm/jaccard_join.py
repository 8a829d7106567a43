"""N-gram Jaccard join with token-combination prefixes, exact.

A document is its set of word shingles ("tokens"). Two sets with a Jaccard similarity of t share at least ``ceil(t * n)`` tokens,
n being the size of either, so in any common order of tokens their first ``n - ceil(t * n) + k`` ones share at least k.

1. *Order*: tokens that many documents share come last, others first by hash. What "many" means only decides cost.
2. *Prefixes*, extended by one token (k = 2), are indexed. Tokens of one document drop out at once.
3. *Stars*: every token's documents are compared with one of them only, first the smallest, then others chosen by hash. Groups of
   near copies become one component without pairs among their members.
4. *The rest*: documents of different components. A token found in few components (rare class) is an index key of its own; of tokens
   in more components (frequent class) only combinations of two are keys. Two linked documents share two prefix tokens: two rare
   ones, a rare and a frequent one, or two frequent ones, so no link is lost. Keys pair components, not documents, and only the
   documents of pairs that remain are compared.
5. *Verification*: sizes and parity bitmaps (a lower bound of the symmetric difference) rule pairs out exactly, and the whole texts
   of what is left are compared.

Documents with equal sets are one class from the start: one row per distinct set, copies are never paired.

Cases: a null or empty text has no shingle and links with nothing; fewer words than a shingle's make one shingle of the whole
sequence; very long texts count whole; repeated rows are copies (a key stands for one text); an empty table gives an empty table; input
columns other than key and text are not carried. Documents with a null key get component null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corvane.llm.common import forget, give_back, text_pieces
from corvane.llm.components import components, relabelled
from corvane.session import cut_lineage, join_small, new_path

#: Documents of one task that must share a token for it to be reported as common, and reports for it to be ordered last.
COMMON_IN_TASK, COMMON = 3, 6
#: Common tokens that are remembered (8 bytes each, in every task); the most common ones, if there are more.
REMEMBERED = 2_000_000
#: Components up to which a token is rare, documents that are compared with each other in one go, and further rounds of stars.
RARE, BLOCK, ROUNDS = 32, 1024, 1
#: Bytes of text, about, whose sets a task holds at once.
TASK_BYTES = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit hashes (the published MurmurHash3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes. A-Z are lower-cased; words are cut at ASCII white space."""
    import xxhash

    docs = [t.lower().split() for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*docs)}
    lengths = [len(d) for d in docs]
    flat = np.fromiter((known[w] for d in docs for w in d), np.uint64, sum(lengths))
    out, at = [], 0
    for n in lengths:
        w = flat[at:at + n]
        at += n
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        m = max(1, n - size + 1)
        h = np.full(m, min(n, size), np.uint64)
        for k in range(min(n, size)):
            h = mixed(h * _ODD + w[k:k + m])
        out.append(np.unique(h))
    return out


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens that fall on each of b bits; b is the power of two at or above the set's size, 64 at least."""
    bits = max(64, 1 << max(len(tokens) - 1, 1).bit_length())
    parity = np.bincount((mixed(tokens ^ _ODD) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def far_apart(a: bytes, b: bytes) -> int:
    """Tokens, at least, that are in one set only: differing bits, the longer bitmap folded to the shorter one's length."""
    if len(a) < len(b):
        a, b = b, a
    x = np.frombuffer(a, np.uint8)
    while len(x) > len(b):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ np.frombuffer(b, np.uint8)).sum())


def may_link(n_a: int, n_b: int, map_a: bytes, map_b: bytes, percent: int) -> bool:
    """False only if the sets cannot reach the similarity."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    return (100 + percent) * far_apart(map_a, map_b) <= (100 - percent) * (n_a + n_b)


def _by_length(bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    of: dict[int, list[int]] = {}
    for i, b in enumerate(bits):
        of.setdefault(len(b), []).append(i)
    return {n: (np.array(at), np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)) for n, at in of.items()}


def allowed(n_a: np.ndarray, bits_a: list[bytes], n_b: np.ndarray, bits_b: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``may_link`` for all of ``a`` with all of ``b``: the index pairs that may."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at_a, map_a in _by_length(bits_a).values():
        for at_b, map_b in _by_length(bits_b).values():
            x, y = map_a, map_b
            while x.shape[1] > y.shape[1]:
                x = x[:, :x.shape[1] // 2] ^ x[:, x.shape[1] // 2:]
            while y.shape[1] > x.shape[1]:
                y = y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
            step = max(1, 2_000_000 // y.size)
            for at in range(0, len(at_a), step):
                one, other = n_a[at_a[at:at + step], None], n_b[None, at_b]
                apart = np.bitwise_count(x[at:at + step, None] ^ y[None]).sum(2, dtype=np.int64)
                i, j = np.nonzero((100 * np.minimum(one, other) >= percent * np.maximum(one, other)) & ((100 + percent) * apart <= (100 - percent) * (one + other)))
                left.append(at_a[at + i])
                right.append(at_b[j])
    return np.concatenate(left), np.concatenate(right)


def _profiles(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``doc``, ``n``, ``digest`` and ``bits`` per document, and on one row per piece the tokens that its documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget("encoder")  # a tokenizer and its words, if the worker packed documents before
        for piece in text_pieces(batches, text, TASK_BYTES):
            keys = piece.column(key)
            kept: dict[bytes, np.ndarray] = {}
            rows: list[list] = [[], [], [], []]
            for part in text_pieces(iter([piece]), text):
                for s in shingle_sets([(t or "").encode() for t in part.column(text).to_pylist()], size):
                    digest = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                    if len(s):
                        kept[digest] = s
                    rows[0].append(len(s))
                    rows[1].append(digest)
                    rows[2].append(bitmap(s) if len(s) else None)
            common = []
            if kept:
                tokens, copies = np.unique(np.concatenate(list(kept.values())), return_counts=True)
                many = copies >= COMMON_IN_TASK
                common = np.stack([tokens[many].view(np.int64), copies[many]], axis=1)
            rows[3] = [None] * piece.num_rows
            rows[3][0] = np.ascontiguousarray(common, "<i8").tobytes() if len(common) else None
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
                names=["doc", "n", "digest", "bits", "common"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "doc long, n long, digest binary, bits binary, common binary")


def _common_tokens(profiles: DataFrame) -> np.ndarray:
    """Tokens to order last, sorted. Reports come from all documents; they are added up before anything is collected."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                table = np.frombuffer(blob, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"token": table[:, 0], "docs": table[:, 1]})

    seen = profiles.where("common is not null").select("common").mapInArrow(spread, "token long, docs long")
    seen = cut_lineage(seen.groupBy("token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= COMMON))
    least = COMMON
    while seen.where(F.col("docs") >= least).count() > REMEMBERED:
        least *= 2
    return np.sort(seen.where(F.col("docs") >= least).select("token").toArrow().column("token").to_numpy())


def _prefixes(df: DataFrame, key: str, text: str, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """``token``, ``doc``, ``n``: the extended prefix of every document, once per distinct set and piece."""
    shared = df.sparkSession.sparkContext.broadcast(common)  # 8 bytes a token, REMEMBERED at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value.view(np.uint64) if len(shared.value) else np.zeros(0, np.uint64)
        last = np.sort(last)
        forget("encoder")
        for piece in text_pieces(batches, text, TASK_BYTES):
            smallest: dict[bytes, tuple[int, np.ndarray]] = {}
            for part in text_pieces(iter([piece]), text):
                for doc, s in zip(part.column(key).to_pylist(), shingle_sets([(t or "").encode() for t in part.column(text).to_pylist()], size)):
                    mark = s.tobytes()
                    if len(s) > 1 and doc is not None and (mark not in smallest or doc < smallest[mark][0]):
                        smallest[mark] = (doc, s)
            docs, sizes, tokens = [], [], []
            for doc, s in smallest.values():
                n = len(s)
                take = min(n, n - -(-percent * n // 100) + 2)
                is_common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(n, bool)
                order = np.concatenate([s[~is_common], s[is_common]])[:take]
                tokens.append(order)
                docs.append(np.full(len(order), doc, np.int64))
                sizes.append(np.full(len(order), n, np.int32))
            if tokens:
                flat, owners, counts = np.concatenate(tokens).view(np.int64), np.concatenate(docs), np.concatenate(sizes)
                for at in range(0, len(flat), 200_000):
                    cut = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_pydict({"token": flat[cut], "doc": owners[cut], "n": counts[cut]})
        give_back()

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, "token long, doc long, n int")


class _Texts:
    """Compressed texts in a table bucketed by document, so that they are shuffled once and joined often.

    Nearly every document shares some shingle with another one, so all texts are kept.
    """

    def __init__(self, df: DataFrame, key: str, text: str):
        self.spark, self.name = df.sparkSession, f"texts_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            packer = zstandard.ZstdCompressor(level=3)
            forget("encoder")
            for piece in text_pieces(batches, text):
                blobs = [packer.compress((t or "").encode()) for t in piece.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(key), pa.array(blobs, pa.binary())], names=["doc", "blob"])
            give_back()

        texts = df.select(F.col(key).cast("long").alias(key), text).mapInArrow(press, "doc long, blob binary")
        texts.where("doc is not null").repartition(buckets, "doc").write.option("path", new_path(self.spark, self.name)).option("compression", "none").bucketBy(buckets, "doc").saveAsTable(self.name)

    def verified(self, pairs: DataFrame, size: int, percent: int) -> DataFrame:
        """Those of the distinct pairs ``a``, ``b`` whose whole texts reach the similarity."""
        texts = self.spark.table(self.name)
        rows = pairs.join(texts.select(F.col("doc").alias("b"), F.col("blob").alias("text_b")), "b").join(
            texts.select(F.col("doc").alias("a"), F.col("blob").alias("text_a")), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard

            reader, last, hub = zstandard.ZstdDecompressor(), None, None
            forget("encoder")
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    b = batch.slice(at, 256)
                    names, others, keep = b.column("a").to_pylist(), b.column("b").to_pylist(), []
                    sets = shingle_sets([reader.decompress(t) for t in b.column("text_b").to_pylist()], size)
                    for i, s in enumerate(sets):
                        if names[i] != last:
                            last, hub = names[i], shingle_sets([reader.decompress(b.column("text_a")[i].as_py())], size)[0]
                        both = len(np.intersect1d(hub, s, assume_unique=True))
                        keep.append(100 * both >= percent * (len(hub) + len(s) - both))
                    yield pa.RecordBatch.from_pydict({"a": [x for x, k in zip(names, keep) if k], "b": [x for x, k in zip(others, keep) if k]},
                                                     schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            give_back()

        return cut_lineage(rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def _not_ruled_out(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` that sizes and bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_link(*r, percent) for r in zip(*[b.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b")])]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: sets.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _stars(rows: DataFrame, salt: int, percent: int) -> DataFrame:
    """Candidate pairs ``a`` < ``b``: the documents of each token with one of them, its ``hub``: the smallest as found by ``_prefixes``
    (``salt`` 0), or one chosen by hash that lies in another component.

    A pair counts only if two tokens name it; pairs that are missed here are left to the exact step.
    """
    if salt:
        hub = F.min(F.struct(F.xxhash64("doc", F.lit(salt)).alias("order"), "doc", "n", "comp")).over(Window.partitionBy("token"))
        rows = rows.withColumn("hub", hub).where(F.col("comp") != F.col("hub.comp"))
    pairs = rows.where((F.col("doc") != F.col("hub.doc")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    a, b = F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b")
    return pairs.groupBy(a, b).agg(F.count("*").alias("tokens")).where("tokens > 1").select("a", "b")


def _near_components(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``one`` < ``other`` of components in which two documents may share a rare and another prefix token, and the rows of frequent tokens.

    ``rows`` has ``token``, ``doc``, ``comp``. Rare tokens pair their few components; a pair that has a single rare token needs a
    frequent one as well.
    """
    # one row per token and component; tokens of a single component have nothing left to find
    spark, by_token = rows.sparkSession, Window.partitionBy("token")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = new_path(spark, "tokens")
    rows.select("token", "comp").repartition(parts, "token").distinct().withColumn("comps", F.count("*").over(by_token)).where("comps > 1").write.parquet(path)
    held = spark.read.parquet(path)
    few = held.where(F.col("comps") <= RARE).groupBy("token").agg(F.sort_array(F.collect_list("comp")).alias("comps"))
    every = F.expr("flatten(transform(comps, (x, i) -> transform(slice(comps, i + 2, size(comps)), y -> struct(x as one, y as other))))")
    shared = cut_lineage(few.select(F.inline(every)).groupBy("one", "other").agg(F.count("*").alias("tokens")))
    several = shared.where("tokens > 1").select("one", "other")
    frequent = held.where(F.col("comps") > RARE).select("token").distinct()
    if frequent.isEmpty():
        return several, None
    often = rows.join(frequent, "token")
    own = often.groupBy("comp").agg(F.collect_set("token").alias("frequent"))
    mixed_pairs = shared.where("tokens = 1").join(own.select(F.col("comp").alias("one"), F.col("frequent").alias("f_one")), "one").join(
        own.select(F.col("comp").alias("other"), F.col("frequent").alias("f_other")), "other").where(F.arrays_overlap("f_one", "f_other"))
    return several.union(mixed_pairs.select("one", "other")).distinct(), often


def _frequent_pairs(often: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Document pairs ``a`` < ``b`` of different components that share two frequent tokens and that sizes and bitmaps allow.

    Documents are indexed by combinations of two tokens: by one of them, and where many documents have it also by the remainder
    of the other one. What is still large is cut into blocks. A task compares the documents of two blocks and gives out only what
    may link, and that only under the pair's first combination.
    """
    docs = often.groupBy("doc", "comp").agg(F.sort_array(F.collect_set("token")).alias("tokens")).where(F.size("tokens") > 1).join(sets, "doc")
    firsts = cut_lineage(docs.withColumn("x", F.explode(F.expr("slice(tokens, 1, size(tokens) - 1)"))))
    parts_of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    cuts = firsts.groupBy("x").agg(parts_of(F.count("*")).alias("cuts")).where("cuts > 1")
    cut = join_small(firsts, cuts, ["x"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("long")))
    cut = cut.withColumn("r", F.explode(F.expr("array_distinct(transform(filter(tokens, y -> y > x), y -> pmod(y, cuts)))")))
    blocks = cut.groupBy("x", "r").agg(parts_of(F.count("*")).alias("blocks")).where("blocks > 1")
    spread = join_small(cut, blocks, ["x", "r"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    spread = spread.select("x", "r", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cuts", "doc", "comp", "n", "bits", "tokens")
    parts = max(int(often.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spread = spread.repartition(parts, "x", "r", "i", "j").sortWithinPartitions("x", "r", "i", "j")

    def compare(key: tuple, rows: list[tuple]) -> tuple[list, list]:
        x, r, i, j = key
        left, right = [], []
        here = [m for m in rows if m[0] == i]
        there = [m for m in rows if m[0] == j]
        if len({m[3] for m in here} | {m[3] for m in there}) < 2:
            return left, right
        one, other = allowed(np.array([m[4] for m in here]), [m[5] for m in here], np.array([m[4] for m in there]), [m[5] for m in there], percent)
        for p, q in zip(one.tolist(), other.tolist()):
            a, b = here[p], there[q]
            if a[3] != b[3] and (i != j or a[2] < b[2]):
                both = sorted(set(a[6]).intersection(b[6]))
                if len(both) > 1 and both[0] == x and both[1] % a[1] == r:
                    left.append(min(a[2], b[2]))
                    right.append(max(a[2], b[2]))
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[tuple] = []
        mark = None
        for batch in batches:
            for x, r, i, j, *row in zip(*[batch.column(c).to_pylist() for c in ("x", "r", "i", "j", "block", "cuts", "doc", "comp", "n", "bits", "tokens")]):
                if (x, r, i, j) != mark:
                    if len(held) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in compare(mark, held)], schema=schema)
                    held, mark = [], (x, r, i, j)
                held.append(tuple(row))
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in compare(mark, held)], schema=schema)

    return spread.mapInArrow(run, "a long, b long")


def _across(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Document pairs ``a`` < ``b`` across each pair of components that sizes and bitmaps allow.

    ``members`` has ``comp``, ``doc``, ``n``, ``bits``. Of two components the larger one is the hub; all partners of a hub meet its
    documents together, so that those are sent once and not once per partner. Both sides are cut into blocks of ``BLOCK``; a task
    compares two blocks and gives out only what may link.
    """
    counted = cut_lineage(members.groupBy("comp").agg(F.count("*").alias("docs")))
    sized = pairs.join(counted.select(F.col("comp").alias("one"), F.col("docs").alias("n_one")), "one").join(
        counted.select(F.col("comp").alias("other"), F.col("docs").alias("n_other")), "other")
    larger = F.col("n_one") >= F.col("n_other")
    met = sized.select(F.when(larger, F.col("one")).otherwise(F.col("other")).alias("hub"), F.when(larger, F.col("other")).otherwise(F.col("one")).alias("comp"))
    partners = cut_lineage(met.join(members, "comp").select("hub", "doc", "n", "bits"))
    blocks_of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    hubs = partners.groupBy("hub").agg(blocks_of(F.count("*")).alias("n_there")).join(
        counted.select(F.col("comp").alias("hub"), blocks_of(F.col("docs")).alias("n_here")), "hub")
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = members.withColumnRenamed("comp", "hub").join(hubs, "hub").select(
        "hub", block("n_here").alias("b_here"), every("n_there").alias("b_there"), F.lit(True).alias("first"), "doc", "n", "bits")
    there = partners.join(hubs, "hub").select(
        "hub", every("n_here").alias("b_here"), block("n_there").alias("b_there"), F.lit(False).alias("first"), "doc", "n", "bits")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = here.unionByName(there).repartition(parts, "hub", "b_here", "b_there").sortWithinPartitions("hub", "b_here", "b_there")

    def compare(group: list[tuple]) -> tuple[list, list]:
        here, there = [r for r in group if r[0]], [r for r in group if not r[0]]
        if not here or not there:
            return [], []
        one, other = allowed(np.array([r[2] for r in here]), [r[3] for r in here], np.array([r[2] for r in there]), [r[3] for r in there], percent)
        a, b = np.array([r[1] for r in here])[one], np.array([r[1] for r in there])[other]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: list[tuple] = []
        mark = None
        for b in batches:
            for *key, first, doc, n, bits in zip(*[b.column(c).to_pylist() for c in ("hub", "b_here", "b_there", "first", "doc", "n", "bits")]):
                if key != mark:
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in compare(held)], schema=schema)
                    held, mark = [], key
                held.append((first, doc, n, bits))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in compare(held)], schema=schema)

    return rows.select("hub", "b_here", "b_there", "first", "doc", "n", "bits").mapInArrow(run, "a long, b long")


def _with_components(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``comp``: the document's component, itself where it has no link."""
    return rows.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (smallest key reachable by links, itself included) for every row.

    Documents link when 100 * |intersection| >= ``percent`` * |union| of their sets of ``size``-word shingles. ``percent`` is above
    50, so that linked sets of two and more tokens share two.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must lie above 50 and be 100 at most")
    spark = df.sparkSession
    path = new_path(spark, "profiles")
    _profiles(df, key, text, size).write.parquet(path)
    profiles = spark.read.parquet(path)
    whole = profiles.select("doc", "n", "digest", "bits")
    # one class per distinct set; copies only ever meet their class's smallest document
    classes = cut_lineage(whole.where("n > 0 and doc is not null").groupBy("digest").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    sets = classes.select("doc", "n", "bits")

    # tokens of one document drop out; of copies only the smallest document goes on, and a token's smallest document is one of those
    shared_path = new_path(spark, "shared")
    prefixes = _prefixes(df, key, text, size, percent, _common_tokens(profiles))
    by_token = Window.partitionBy("token")
    several = prefixes.withColumns({"hub": F.min(F.struct("doc", "n")).over(by_token), "most": F.max("doc").over(by_token)}).where("hub.doc < most").drop("most")
    several.join(classes.select("doc"), "doc", "left_semi").write.parquet(shared_path)
    shared = spark.read.parquet(shared_path)
    first = cut_lineage(_stars(shared, 0, percent))
    texts = _Texts(df, key, text)
    labels = components(texts.verified(_not_ruled_out(first, sets, percent), size, percent))

    # more stars around other documents, for members of a group that the first one missed by a little
    near = cut_lineage(shared.drop("hub").join(first.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "doc", "left_semi"))
    for salt in range(1, ROUNDS + 1):
        labels = relabelled(labels, texts.verified(_not_ruled_out(_stars(_with_components(near, labels), salt, percent), sets, percent), size, percent))

    # exact: whatever may still link across components
    rest, often = _near_components(_with_components(shared.select("token", "doc"), labels))
    open_ = _across(cut_lineage(rest), _with_components(sets, labels), percent)
    if often is not None:
        open_ = open_.unionByName(_frequent_pairs(often, sets, percent))
    labels = relabelled(labels, texts.verified(open_.distinct(), size, percent))
    texts.drop()

    named = _with_components(sets.select("doc"), labels).select("doc", "comp")
    by_digest = classes.select("digest", "doc").join(named, "doc").select("digest", "comp")
    return whole.join(by_digest, "digest", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"))
