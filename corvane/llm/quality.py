"""Quality rules with compression bands.

A text is compressed whole and in fixed chunks, the last one as long as it happens to be; a zstandard ratio above the band of its
length is repetitive, one below it is incompressible. Bands depend on length because short inputs carry the format's overhead and
have little to refer back to. Chunks reject a text if those of one kind are a share of its bytes or follow each other for a stretch.

Cases: a null text has no words and fails the base rule, as an empty one does; repeated rows and ties give equal rows; very
long texts are judged whole; an empty table gives an empty table; input columns named like a result are replaced.
"""

from __future__ import annotations

from itertools import count, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

from corvane.llm.common import map_text

LEVEL = 3
CHUNK_BYTES = 4096
#: Share of a text's bytes in chunks outside the band, on one side, and chunks outside in a row, from which chunks reject it.
BAD_SHARE, BAD_RUN = 0.3, 3
#: (from bytes, least ratio, most ratio); below the first entry no band applies. Prose has a ratio of about 1.5 at 500 bytes
#: and 2 to 3 from 4 KB on, encoded noise about 1.3 or less, word and line loops far above 6.
BANDS = ((256, 1.0, 4.5), (512, 1.2, 5.0), (1024, 1.3, 5.5), (4096, 1.4, 6.0), (16384, 1.5, 8.0))

FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("zstd_ratio", T.DoubleType()), ("chunks_repetitive", T.LongType()), ("chunks_incompressible", T.LongType()), ("n_chunks", T.LongType()),
    ("reason", T.StringType()),
]
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


def band(n_bytes: int) -> tuple[float, float] | None:
    """The least and the most ratio for an input of so many bytes."""
    fit = [b for b in BANDS if b[0] <= n_bytes]
    return fit[-1][1:] if fit else None


def outside(n_bytes: int, packed: int) -> str | None:
    """``repetitive``, ``incompressible`` or None for an input compressed to ``packed`` bytes."""
    limits = band(n_bytes)
    if limits is None:
        return None
    ratio = n_bytes / packed
    return "repetitive" if ratio > limits[1] else "incompressible" if ratio < limits[0] else None


def rejected_by(kinds: list[str | None], sizes: list[int], kind: str) -> bool:
    """Whether chunks of ``kind`` are too large a share of the bytes, or too many in a row."""
    if sum(n for k, n in zip(kinds, sizes) if k == kind) >= BAD_SHARE * sum(sizes) and kind in kinds:
        return True
    return any(k == kind and len(list(run)) >= BAD_RUN for k, run in groupby(kinds))


def repeated_words(docs: list[list[bytes]]) -> np.ndarray:
    """Per document: words that stand in a 3-word window found at least twice in that document."""
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    if total < 3:
        return np.zeros(len(docs), np.int64)
    number, parts = count(), []
    for words in docs:  # one numbering for each document, so that equal numbers mean the same word of the same document
        parts.append(np.fromiter(map({}.setdefault, words, number), np.int64, len(words)))
    ids, doc = np.concatenate(parts), np.repeat(np.arange(len(docs)), sizes)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    if total <= 1 << 21:
        window = ids[at] << 42 | ids[at + 1] << 21 | ids[at + 2]
    else:
        pair = pd.factorize(ids[:-1] * total + ids[1:])[0].astype(np.int64)
        window = pair[at] * total + ids[at + 2]
    twice = at[pd.Series(window).duplicated(keep=False).to_numpy()]
    covered = np.zeros(total, bool)
    for k in range(3):
        covered[twice + k] = True
    return np.bincount(doc[covered], minlength=len(docs))


def assess(texts: list) -> dict[str, list]:
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    blobs = [(t or "").encode() for t in texts]
    docs = [b.split() for b in blobs]
    out: dict[str, list] = {n: [] for n, _ in FIELDS}
    out["n_repeat_words"] = repeated_words(docs).tolist()
    for i, (text, blob, words) in enumerate(zip(texts, blobs, docs)):
        chars = len(text or "") - (len(blob) - len(blob.translate(None, _SPACE)))
        lines = [x for x in blob.split(b"\n") if x.strip(_SPACE)]
        failed = len(words) < 50 or 100 * out["n_repeat_words"][i] > 50 * len(words)
        whole = len(press.compress(blob)) if blob else 0
        reason = outside(len(blob), whole) if blob else None
        chunks = [blob[k:k + CHUNK_BYTES] for k in range(0, len(blob), CHUNK_BYTES)]
        kinds = [outside(len(c), len(press.compress(c))) for c in chunks]
        sizes = [len(c) for c in chunks]
        if reason is None and len(chunks) > 1:
            reason = next((f"{k} chunks" for k in ("repetitive", "incompressible") if rejected_by(kinds, sizes, k)), None)
        for name, value in (
            ("n_words", len(words)), ("word_chars", chars), ("n_symbols", len(blob) - len(blob.translate(None, _SYMBOLS))),
            ("n_dup_lines", len(lines) - len(set(lines))), ("base_failed", failed), ("kept", not failed and reason is None),
            ("zstd_ratio", len(blob) / whole if whole else None), ("chunks_repetitive", kinds.count("repetitive")), ("chunks_incompressible", kinds.count("incompressible")),
            ("n_chunks", len(chunks)), ("reason", "base" if failed else reason),
        ):
            out[name].append(value)
    return out


def quality_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts, ratios, ``base_failed``, ``kept`` and ``reason`` to every row. No shuffle."""
    return map_text(df, assess, FIELDS, text)
