"""The language model's score against a plain token-by-token computation, and what its word weights gain."""

import math
import random
import zlib

import numpy as np

from corvane.llm import language_model as L

DOCS = "doc_id long, text string"


def is_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def steps_of(text, frequent):
    """(previous word, context, kind, word) of every token of one text, by a walk over its words."""
    words, out, previous, seen = (text or "").lower().encode().split() + [b""], [], L.END, 0
    for i, w in enumerate(words):
        kind = L.word_class(w, frequent)
        if w and i >= 1 and w == words[i - 1]:
            kind = L.AGAIN
        elif w and i >= 2 and w == words[i - 2]:
            kind = L.BEFORE_AGAIN
        out.append((words[i - 1] if i else b"", previous * (L.FREQUENT + 1) + seen, kind, w))
        previous = kind
        if w in frequent:
            seen = frequent[w] + 1
    return out


def brute_scores(rows, weights, min_count):
    texts = [t for d, t in rows if not is_out(d)]
    counts = {}
    for t in texts:
        for w in (t or "").lower().encode().split() + [b""]:
            counts[w] = counts.get(w, 0) + 1
    ranked = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: L.FREQUENT]
    frequent = {w: k for k, w in enumerate(ranked)}

    def chances(context):
        previous, seen = divmod(context, L.FREQUENT + 1)
        pair = (context * 2654435761 % 2**32) % L.PAIR_ROWS
        s = weights[0] + weights[1 + previous] + weights[1 + L.CLASSES + seen] + weights[2 + L.CLASSES + L.FREQUENT + pair]
        return np.exp(s) / np.exp(s).sum()

    after = {}
    for t in texts:
        for before, context, kind, _ in steps_of(t, frequent):
            after.setdefault(before, []).append((context, kind))
    rows_of = {}
    for w, n in counts.items():
        if n >= min_count:
            row = np.zeros(L.CLASSES)
            for _ in range(L.WORD_STEPS):
                slope, spread = -L.PRIOR * row, np.full(L.CLASSES, L.PRIOR)
                for context, kind in after.get(w, []):
                    p = chances(context) * np.exp(row)
                    p /= p.sum()
                    slope = slope - p
                    slope[kind] += 1
                    spread += p * (1 - p)
                row = row + np.clip(slope / spread, -1, 1)
            rows_of[w] = np.clip(np.round(row / L.ROUNDED), -127, 127) * L.ROUNDED
    totals = np.ones(L.CLASSES)
    for w, n in counts.items():
        totals[L.word_class(w, frequent)] += n + 1
    scores = []
    for d, t in rows:
        score = 0.0
        for before, context, kind, w in steps_of(t, frequent):
            p = chances(context) * np.exp(rows_of.get(before, 0.0))
            score += math.log10(p[kind] / p.sum())
            if kind not in (L.AGAIN, L.BEFORE_AGAIN):
                score += math.log10((counts.get(w, 0) + 1) / totals[kind])
        scores.append((-1 if d is None else d, round(score, 2)))
    return sorted(scores), len(rows_of)


def test_score_equals_a_walk_over_the_tokens(spark, monkeypatch):
    rnd, rng = random.Random(3), np.random.default_rng(3)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeio" for c in ("n", "st", "r.", "m,")]
    texts = [None, "", "  \n ", "Lone", "the the the of the of the", "x" * 5000 + " end"]
    texts += [" ".join(vocabulary[min(int(rnd.expovariate(0.06)), len(vocabulary) - 1)] for _ in range(rnd.randint(1, 60))) for _ in range(90)]
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(1500))]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, "ban den")]
    weights = rng.normal(size=(L.N_ROWS, L.CLASSES)) * 0.5
    monkeypatch.setattr(L, "train", lambda counts, steps: weights)
    want, n_rows = brute_scores(rows, weights, 25)
    assert n_rows > 20
    # extra columns, also such that clash with the names used inside
    df = spark.createDataFrame([(d, t, 1, "x", 0.5) for d, t in rows], DOCS + ", chunk int, word string, score double")
    for chunk_docs in (1000, 9):
        got = L.score_documents(df, chunk_docs=chunk_docs, min_count=25).collect()
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in got)
        assert [d for d, _ in got] == [d for d, _ in want]
        # rounding to whole bytes may fall the other way for a weight at the edge
        assert all(abs(a - b) < 0.05 + 2e-4 * abs(b) for (_, a), (_, b) in zip(got, want))


def test_word_weights_are_at_the_top_of_their_objective():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(L.CONTEXTS, L.CLASSES)) * 0.3
    base -= np.log(np.exp(base).sum(axis=1, keepdims=True))
    contexts, n = rng.choice(L.CONTEXTS, 12, False), rng.integers(50, 400, 12)
    followed = rng.multinomial(n.sum(), rng.dirichlet(np.full(L.CLASSES, 0.3)))
    slots = np.concatenate([np.flatnonzero(followed), L.CLASSES + contexts])
    counts = np.concatenate([followed[followed > 0], n])
    names, rows = L.word_rows(np.full(len(slots), 9), slots, counts, base, steps=1000)
    p = np.exp(base[contexts] + rows[0])
    p /= p.sum(axis=1, keepdims=True)
    assert names.tolist() == [9]
    assert np.abs(followed - (n[:, None] * p).sum(axis=0) - L.PRIOR * rows[0]).max() < 1e-3


def test_words_of_one_class_foretell_different_words(spark):
    rnd = random.Random(5)
    # words of one ending are one class; only the word itself tells what follows
    first, second = [f"{c}{i}ol" for i in range(30) for c in "pq"], [[f"x{i}am" for i in range(30)], [f"y{i}ek" for i in range(30)]]
    fill = [f"f{i}un" for i in range(60)]
    texts = []
    for _ in range(700):
        words = []
        for _ in range(15):
            w = rnd.choice(first)
            words += [w, rnd.choice(second[w[0] == "q"]), rnd.choice(fill)]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    held = lambda least: sum(r["score"] for r in L.score_documents(df, chunk_docs=200, steps=25, min_count=least).where("held_out").collect())
    with_words, without = held(40), held(10**9)
    tokens = sum(len(t.split()) + 1 for d, t in enumerate(texts) if is_out(d))
    assert with_words > without
    assert (with_words - without) / tokens > 0.03


def test_scores_do_not_depend_on_the_text_laid_out_at_once(spark, monkeypatch):
    assert L.TEXT_AT_ONCE <= 2_000_000  # a task held some 40 times as much
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30))) for i in range(60)], DOCS)
    whole = sorted(map(tuple, L.score_documents(df, steps=5, min_count=20).collect()))
    monkeypatch.setattr(L, "TEXT_AT_ONCE", 100)
    for a, b in zip(whole, sorted(map(tuple, L.score_documents(df, steps=5, min_count=20).collect())), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_words_get_the_classes_of_the_rule():
    import pyarrow as pa

    rnd = random.Random(6)
    words = [b"", b".", b"..!", b"a", b"a.", b"ab", b"ab?!", b"\xc3\xa9", b"\xc3\xa9t\xc3\xa9,", b"the", b"the.", b".a", b"a.b"]
    words += ["".join(rnd.choice("abé.,;x") for _ in range(rnd.randint(1, 6))).encode() for _ in range(500)]
    frequent = {b"the": 0, b"ab": 1, b"..!": 2}
    for array in (pa.array(words, pa.binary()), pa.array([b"zz.", *words], pa.large_binary()).slice(1), pa.chunked_array([words[:7], words[7:]], pa.binary())):
        assert L.word_classes(array, frequent).tolist() == [L.word_class(w, frequent) for w in words]
    assert L.word_classes(pa.array([], pa.binary()), {}).tolist() == []
    assert L.word_classes(pa.array([b"", b""]), {}).tolist() == [L.END, L.END]


def test_pairs_of_words_are_trained_inside_a_class(spark, monkeypatch):
    rnd = random.Random(7)
    vocabulary = [a + b + "on" for a in "bdfgkmpt" for b in "aeiou"] + [a + b + "im" for a in "bdfgkmpt" for b in "aeiou"]
    texts = [" ".join(rnd.choice(vocabulary[max(0, i - 8):i + 9]) for i in [rnd.randrange(len(vocabulary))] for _ in range(rnd.randint(0, 40))) for _ in range(160)]
    rows = [*enumerate(texts), (3, texts[3]), (None, "never seen"), (500, None)]
    df = spark.createDataFrame(rows, DOCS)
    weights = np.zeros((L.N_ROWS, L.CLASSES))
    monkeypatch.setattr(L, "train", lambda counts, steps: weights)

    counts, after = {}, {}
    for d, t in rows:
        if not is_out(d):
            for w in (t or "").encode().split() + [b""]:
                counts[w] = counts.get(w, 0) + 1
    ranked = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: L.FREQUENT]
    frequent = {w: k for k, w in enumerate(ranked)}
    totals = np.ones(L.CLASSES)
    for w, n in counts.items():
        totals[L.word_class(w, frequent)] += n + 1
    for d, t in rows:
        if not is_out(d):
            for before, _, kind, w in steps_of(t, frequent):
                if kind >= L.FIRST + L.FREQUENT:
                    of = after.setdefault((before, kind), {})
                    of[w] = of.get(w, 0) + 1
    trained = {}
    for (before, kind), of in after.items():
        names = list(of)
        n, s = np.array([of[w] for w in names]), np.array([(counts[w] + 1) / totals[kind] for w in names])
        x = np.zeros(len(names))
        for _ in range(3000):
            z = 1 + (s * (np.exp(x) - 1)).sum()
            x += 0.1 * (n - n.sum() * s * np.exp(x) / z - L.PRIOR * x)
        assert np.abs(n - n.sum() * s * np.exp(x) / z - L.PRIOR * x).max() < 1e-6
        # all words of the class, those without a pair and the unseen ones add up to 1
        trained[before, kind] = dict(zip(names, x)), math.log(1 + (s * (np.exp(x) - 1)).sum())
    assert len(trained) > 60

    plain = {}
    for r in L.score_documents(df, min_count=10**9).collect():
        plain.setdefault((r["doc_id"]), r["score"])
    for chunk_docs, at_once in ((1000, 10**6), (20, 500)):
        monkeypatch.setattr(L, "TOKENS_AT_ONCE", at_once)  # one part, and several
        got = L.score_documents(df, min_count=10**9, chunk_docs=chunk_docs, word_pairs=True).collect()
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got) == sorted(-1 if d is None else d for d, _ in rows)
        text_of = dict(rows)
        for r in got:
            gain = 0.0
            for before, _, kind, w in steps_of(text_of[r["doc_id"]], frequent):
                weights_of, norm = trained.get((before, kind), ({}, 0.0))
                gain += (weights_of.get(w, 0.0) - norm) / math.log(10)
            assert abs(r["score"] - plain[r["doc_id"]] - gain) < 0.01 + 0.005 * abs(gain)
    held = [(r["score"] - plain[r["doc_id"]], r["n_tokens"]) for r in got if r["held_out"]]
    assert sum(g for g, _ in held) / sum(n for _, n in held) > 0.01
