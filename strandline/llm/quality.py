"""Quality rules on repetition: how much of a text stands in n-grams and lines that it repeats.

Words are hashed to 64 bits; n-grams of several lengths get a rolling hash over their words' hashes, in numpy over
many texts at once. Two n-grams of a text count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._common import pieces

SYMBOLS = b"#*$%&|<>"
#: The largest share of the characters in a text's words that may stand in repeated n-grams of n words, and in repeated lines.
GRAMS = ((5, 0.30), (7, 0.25), (10, 0.20))
LINES = 0.30
LEAST_WORDS, REPEAT_PERCENT = 50, 50
ODD = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _repeats(key: np.ndarray, first: bool) -> np.ndarray:
    """Which items' keys occur more than once; the first of them only if asked."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def _points(x: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(x) if x.isascii() else len(x.decode(errors="replace"))


def measure(texts: list[bytes | None], grams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """For each text the COUNTS, and the shares of characters of words in repeated n-grams (gram_n) and of lines in repeated lines (lines)."""
    words = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    total = int(n.sum())
    h = np.fromiter((hash(x) for w in words for x in w), dtype=np.int64, count=total).view(np.uint64)
    plain = [not t or t.isascii() for t in texts]
    size = np.fromiter((len(x) if p else _points(x) for w, p in zip(words, plain, strict=True) for x in w), dtype=np.int64, count=total)
    doc = np.repeat(np.arange(len(texts)), n)
    salt = _mixed((doc + 1).astype(np.uint64) * ODD)
    place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    left = n[doc] - place
    out = {"n_words": n}
    out["word_chars"] = np.bincount(doc, size, len(texts)).astype(np.int64)
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts], dtype=np.int64)

    def covered(k: int) -> np.ndarray:
        """Which words stand in a k-gram that the text holds more than once."""
        held = np.zeros(total, dtype=bool)
        if total < k:
            return held
        rolled = h[: total - k + 1].copy()
        for j in range(1, k):
            rolled = rolled * ODD + h[j : total - k + 1 + j]
        whole = np.flatnonzero(left[: total - k + 1] >= k)
        twice = whole[_repeats(_mixed(rolled[whole]) ^ salt[whole], True)]
        for j in range(k):
            held[twice + j] = True
        return held

    out["n_repeat_words"] = np.bincount(doc[covered(3)], minlength=len(texts)).astype(np.int64)
    for k in grams:
        out[f"gram_{k}"] = np.bincount(doc, size * covered(k), len(texts)) / np.maximum(out["word_chars"], 1)
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] if t else [] for t in texts]
    n = np.array([len(x) for x in lines], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    h = np.fromiter((hash(x) for w in lines for x in w), dtype=np.int64, count=int(n.sum())).view(np.uint64)
    size = np.fromiter((len(x) if p else _points(x) for w, p in zip(lines, plain, strict=True) for x in w), dtype=np.int64, count=int(n.sum()))
    again = _repeats(_mixed(h) ^ _mixed((doc + 1).astype(np.uint64) * ODD), False)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=len(texts)).astype(np.int64)
    out["lines"] = np.bincount(doc, size * again, len(texts)) / np.maximum(np.bincount(doc, size, len(texts)), 1)
    return out


def judge(docs: DataFrame, grams: tuple[tuple[int, float], ...] = GRAMS, lines: float = LINES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, COUNTS, gram_<n> shares, line share, base_failed, kept): a row for each row of docs.

    base_failed: under LEAST_WORDS words, or over REPEAT_PERCENT percent of them in repeated 3-word windows. kept: not
    base_failed, and no share over its limit. A null or empty text has no words and so fails. Null keys and repeated
    rows stay, each judged by itself; an empty table gives an empty result; other columns are not read.
    """
    shares = [*(f"gram_{k}" for k, _ in grams), "lines"]
    limits = [*(most for _, most in grams), lines]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "_text"):
            got = measure(texts, tuple(k for k, _ in grams))
            failed = (got["n_words"] < LEAST_WORDS) | (100 * got["n_repeat_words"] > REPEAT_PERCENT * got["n_words"])
            kept = ~failed
            for name, most in zip(shares, limits, strict=True):
                kept &= got[name] <= most
            columns = [batch.column(0), *(pa.array(got[c], pa.int64()) for c in COUNTS), *(pa.array(got[c], pa.float64()) for c in shares), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *COUNTS, *shares, "base_failed", "kept"])

    kind = dict(docs.dtypes)[key]
    schema = ", ".join([f"`{key}` {kind}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in shares), "base_failed boolean", "kept boolean"])
    return docs.select(F.col(key).alias(key), F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
