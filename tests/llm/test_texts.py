"""Secret scan, quality rules, substring dedup, packing, mixing: hand-made cases and brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql.types import BooleanType

from corvane.llm import common, mixing, packing, quality, secret_scan, substring_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, kept string, offset string, size string, n_words string"
LONG = "word " * 30_000 + "\nend"
PROSE = ("The river bent twice before the mill, and nobody in the village could say which of the two bends was older. "
         "Children named them after birds; the miller kept a ledger of floods instead, since floods at least had dates. ")
TEXTS = [None, "", " \t\n", "a", "password = 'abcdef12' end", "é password: geheim99, AKIA" + "A1B2C3D4E5F6G7H8" + " x", "deadbeef" * 4,
         "password=token:abcdefgh", "secret=ab token = \"longenough\"", PROSE * 3, PROSE * 3, LONG, "日本語 " * 80]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", "k", "o", "z", "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= n]
    return [(PATTERNS[k][0], s, e) for s, k, e in sorted(found)]


def scanned(text):
    scan = secret_scan.scanner(secret_scan.RULES)
    data = text.encode()
    return [(secret_scan.RULES[k].kind, s, e) for s, k, e in secret_scan._code_points(data, scan.spans(data))]


PIECES = st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABC123", "deadbeef", "0f", "é", "\n", "x", "-", "ghp_"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_spans_are_those_of_the_patterns(text):
    assert [s for s in scanned(text) if s[0] in ("assign", "access", "hex")] == plain_spans(text)


def test_further_rules():
    assert [s[0] for s in scanned("x ghp_" + "aB3" * 12)] == ["forge"]
    assert ("pem", 1, 32) in scanned("\n-----BEGIN RSA PRIVATE KEY-----\n")
    assert not scanned("ghp_" + "a?" * 30)


def test_scan_keeps_rows_and_redacts(docs, nothing):
    out = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs, redact=True).collect()}
    assert len(out) == len(TEXTS) and out[0]["text"] is None and out[0]["secret_spans"] == []
    assert out[4]["text"] == "[SECRET]' end"
    assert out[5]["text"] == "é [SECRET], [SECRET] x"
    assert out[11]["text"] == LONG
    assert secret_scan.scan_secrets(nothing).count() == 0


def test_quality_counts(docs, nothing):
    out = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = brute.words(t)
        lines = [x for x in (t or "").encode().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(w) < 2000 else set(range(len(w) - 1))
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(out[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert out[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert not out[0]["kept"] and not out[11]["kept"]
    assert quality.quality_rules(nothing).count() == 0


def test_compression_bands(spark):
    import base64
    import random

    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    prose = " ".join(rnd.choice(vocabulary) for _ in range(4000))
    noise = " ".join(base64.b64encode(rnd.randbytes(60)).decode() for _ in range(300))
    # every window differs, yet the text is one pattern with a counter
    loop = " ".join(f"row{i:05d} of the long and empty table" for i in range(2000))
    half = prose[:9000] + " " + noise * 3
    got = {r["doc_id"]: r["reason"] for r in quality.quality_rules(spark.createDataFrame([(0, prose), (1, noise), (2, loop), (3, half)], "doc_id int, text string")).collect()}
    assert got[0] is None and got[1] == "incompressible"
    assert got[2] in ("repetitive", "base") and got[3] in ("incompressible", "incompressible chunks")


def test_repeats_match_brute_force(spark, nothing):
    import random

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line = prose(40), prose(12)
    texts = [prose(rnd.randint(0, 120)) for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] = prose(rnd.randint(0, 5)) + passage + prose(rnd.randint(0, 5))
    for i in range(1, 60, 4):
        texts[i] = texts[i] + line + texts[i][:80] + line
    texts += [texts[7], texts[7], None, "", "x" * 49, "x" * 50, "x" * 200, "é" * 60, prose(3000)]
    rows = list(enumerate(texts))
    for heavy in (3, 1000):
        out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_docs=16, heavy=heavy).collect()
        want = brute.repeats(rows)
        got = {r["doc_id"]: (r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out}
        assert got == want
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_repeats_of_a_key_and_null_keys(spark):
    rows = [(1, PROSE), (1, PROSE), (None, PROSE), (2, PROSE + "x")]
    out = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode(), len(r["removed"])) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(0, PROSE, 0), (1, PROSE, 0), (1, PROSE, 0), (2, "x", 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=11, max_size=11), min_size=1, max_size=40), st.integers(0, 3))
def test_multikey_sort(rows, shared):
    rows = [r[:8 + shared] + b"\0" * (3 - shared) for r in rows] + rows[:5]
    keys = substring_dedup.packed_words(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1))
    order, differs = substring_dedup.multikey_sort(keys)
    assert [rows[i] for i in order] == sorted(rows)
    assert all((differs[k] == keys.shape[1]) == (rows[order[k]] == rows[order[k - 1]]) for k in range(1, len(rows)))


def test_packing_round_trip(spark, docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack_documents(docs, "word_bpe_49k.json", capacity=256).collect()
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids
        assert all(r["length"] == 256 for r in mine[:-1]) and [r["start"] for r in mine] == [256 * k for k in range(len(mine))]
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    crc = packing.pack_documents(docs, "word_bpe_49k.json", capacity=256, payload="crc32").collect()
    want = {(r["doc_id"], r["piece"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in crc} == want
    assert packing.pack_documents(nothing, "word_bpe_49k.json").count() == 0


def test_sum_of_squares_rule():
    sequence, offset, gaps = packing.sum_of_squares(np.array([6, 5, 4, 4, 3, 2, 1, 5]), 10)
    used = {}
    for s, o, n in zip(sequence, offset, [6, 5, 4, 4, 3, 2, 1, 5]):
        used.setdefault(int(s), []).append((int(o), n))
    assert len(gaps) == 3 == -(-30 // 10) and (gaps == 0).all()
    assert all(sorted(v)[0][0] == 0 for v in used.values())


def test_words_that_came_again_outlive_a_full_cache(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.CACHED_WORDS <= 300_000  # some 400 bytes each, in every worker
    plain = packing.WordEncoder(path)
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    small = packing.WordEncoder(path)
    for k in range(12):
        texts = ["" if k == 9 else "river mill"] * (k < 10) + [" ".join(f"w{k}x{i}" for i in range(9))]
        for a, b in zip(small.encode(texts), plain.encode(texts)):
            assert a.tolist() == b.tolist()
        assert len(small.known) <= 40
    assert b"river" in small.known


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBzé.,;:!?<|>\u00a0\u2028 \t\n\r\x0b1_'"), max_size=40), min_size=1, max_size=5))
def test_words_give_the_ids_of_whole_texts(texts):
    import public_tokenizers

    encoder = packing.remembered("test encoder", lambda: packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")))
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_repeated_words_are_looked_up_once(monkeypatch):
    import public_tokenizers

    class Counted(dict):
        asked = 0

        def get(self, word, other=None):
            self.asked += 1
            return super().get(word, other)

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    once = [x.tolist() for x in encoder.encode(["river mill.", ""])]
    encoder.known = Counted(encoder.known)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 7, raising=False)
    many = encoder.encode(["river mill. " * 500, ""])
    assert [x.tolist() for x in many] == [once[0][:-1] * 500 + [1], [1]]
    assert encoder.known.asked <= 10


def test_other_operators_drop_the_tokenizer(spark, docs):
    def holds(texts):
        import sys

        kept = vars(sys.modules["_corvane_worker"]) if "_corvane_worker" in sys.modules else {}
        return {"holds": [any(k.startswith("encoder") for k in kept) for _ in texts]}

    assert packing.pieces(docs.repartition(8), "word_bpe_49k.json").count()
    seen = common.map_text(docs.repartition(8), holds, [("holds", BooleanType())]).collect()
    assert len(seen) == len(TEXTS) and not any(r["holds"] for r in seen)


def test_packing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 300)
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 100, 2000))]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), capacity=100).collect()
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert len(out) == 2000 and max(fill.values()) <= 100
    assert len(fill) <= 1.03 * -(-sum(n for _, n in rows) // 100) + 1


def test_whole_keys_are_masked(spark):
    body = "\n".join("MIIEowIBAAKCAQEA" * 4 for _ in range(5))
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    whole = f"{begin}\nProc-Type: 4,ENCRYPTED\n\n{body}\nshort==\n{end}"
    texts = [f"a {whole} b", f"a {whole.replace(chr(10), chr(92) + 'n')} b", f"a {begin}\n{body}\nshort prose\nmore of it", f"{begin}\nplain words only", f"{whole}\n{whole}", begin + "\n" * 50_000 + " " * 50_000]
    out = [r["text"] for r in secret_scan.scan_secrets(spark.createDataFrame([(t,) for t in texts], "text string"), redact=True).collect()]
    assert out[:5] == ["a [SECRET] b", "a [SECRET] b", "a [SECRET]\nshort prose\nmore of it", "[SECRET]\nplain words only", "[SECRET]\n[SECRET]"]
    assert out[5].strip() == "[SECRET]"


def test_junk_behind_prose_is_rejected():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(1500)]
    weights = 1 / np.arange(1, 1501)
    prose = lambda n: " ".join(rng.choice(words, n // 4, p=weights / weights.sum()))[:n]
    noise = lambda n: __import__("base64").b64encode(rng.bytes(n)).decode()[:n]
    good = [prose(n) for n in (600, 3000, 4097, 4200, 9000, 40_000)]
    bad = [prose(4096) + noise(4096), prose(20_000) + noise(19_000), prose(120_000) + noise(16_384), prose(4096) + " " + noise(2500)]
    got = quality.assess(good + bad)
    assert [r for r in got["reason"][:6] if r not in (None, "base")] == []
    assert all(r == "incompressible chunks" or r == "incompressible" for r in got["reason"][6:]) and not any(got["kept"][6:])


@pytest.mark.parametrize("length", [1, 3, 7, 12, 50, 100])
def test_packing_many_equal_pieces_ends(spark, monkeypatch, length):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    levels = []
    cut = packing.cut_lineage
    monkeypatch.setattr(packing, "cut_lineage", lambda df: levels.append(1) or cut(df))
    # repeated rows: all alike in every column
    out = packing.pack(spark.createDataFrame([(7, length)] * 300, "doc_id long, length long"), capacity=100).collect()
    fill, shards = {}, {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        shards[r["sequence_id"] >> 24] = shards.get(r["sequence_id"] >> 24, 0) + 1
    assert len(out) == 300 and max(fill.values()) <= 100
    assert len(levels) <= 7 and max(shards.values()) < 200
    assert len(fill) <= -(-300 // (100 // length)) + 3


def test_merged_sequences_stay_gapless():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 30, 500), np.full(20_000, 3), rng.integers(20, 100, 300), np.array([1]), np.zeros(0, int)):
        before = packing.sum_of_squares(lengths, 100 if len(lengths) < 20_000 else 4096)
        capacity = 100 if len(lengths) < 20_000 else 4096
        sequence, offset, gaps = packing.merged(*before, capacity)
        assert len(gaps) <= len(before[2]) and len(gaps) <= 1.02 * lengths.sum() / capacity + 2 + (lengths.max(initial=0) > 30) * 40
        at = np.zeros(len(gaps), int)
        for i in np.lexsort((offset, sequence)):
            assert offset[i] == at[sequence[i]]
            at[sequence[i]] += lengths[i]
        assert (capacity - at == gaps).all()


def test_mixing(spark, nothing):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "b", "a", "c"][min(3, int(rng.exponential(1.0)))]) for i in range(800)] + [(900, None, "a"), (7, "w w", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, passes int, bound int")
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(3)).collect()), key=str)
    size, target, taken, biggest = {}, {}, {}, {}
    for r in out:
        s = r["source"]
        size[s] = size.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s], biggest[s] = r["target"], max(biggest.get(s, 0), r["size"])
        assert r["size"] == len(brute.words(r["text"])) and 0 <= r["taken"] <= 2 * r["size"]
    order = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(order, [5.0, 2.0, 1.0, 5.0]))
    # the targets by resharing step by step
    want, free, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * size[s]}
        if not over:
            want.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            want[s] = 2.0 * size[s]
        left, free = left - sum(want[s] for s in over), free - over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= target[s] - taken[s] < biggest[s] + 1
    assert mixing.mix_sources(nothing).count() == 0
