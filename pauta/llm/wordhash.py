"""Words and word n-grams of whole batches of texts as flat hash arrays.

*Words* are the maximal runs of ``a-z0-9`` of the lower-cased, NFKD-decomposed text
without combining marks. A batch of texts is folded as one string, turned into one byte
array, and every word gets a 64-bit hash from prefix sums of a polynomial, so the cost
per word is a few numpy operations and no Python object is made for it.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np

_SEP = "\x00"
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: dict[str, np.ndarray] = {}


_marks: np.ndarray | None = None


def fold_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased, NFKD-decomposed text without combining marks."""
    global _marks
    text = text.lower()
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    if _marks is None:
        _marks = np.fromiter((bool(unicodedata.combining(chr(c))) for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    codes = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = codes[~_marks[codes]]
    return np.where(codes < 128, codes, 32).astype(np.uint8)  # any other character ends a word as a blank does


def words(text: str | None) -> list[str]:
    """The words of one text, in order (for tests and short texts)."""
    return re.findall("[a-z0-9]+", fold_codes(text or "").tobytes().decode("ascii"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n."""
    if not _powers or len(_powers["up"]) <= n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _hash_chunk(raw: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and digit marks of the words of ``rows`` folded texts joined by the separator."""
    good = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57))
    edge = np.diff(np.concatenate(([0], good.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * up[: len(raw)], dtype=np.uint64)))
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(np.flatnonzero(raw == 0), start) if rows > 1 else np.zeros(len(start), np.int64)
    digit = np.concatenate((np.zeros(1, np.int64), np.cumsum(raw < 58) - np.cumsum(raw < 48)))
    return h, row, digit[end] > digit[start]


def word_hashes(texts, with_digits: bool = False) -> tuple[np.ndarray, ...]:
    """Flat word hashes of all texts, and offsets: row i has hashes[offsets[i]:offsets[i+1]].

    With ``with_digits`` also whether each word holds a digit. Null texts have no words. Texts of any length are handled whole.
    """
    parts, counts, marks, chunk, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal chunk, size
        if chunk:
            h, row, digit = _hash_chunk(fold_codes(_SEP.join(chunk)), len(chunk))
            parts.append(h)
            marks.append(digit)
            counts.append(np.bincount(row, minlength=len(chunk)))
            chunk, size = [], 0

    for t in texts:
        t = "" if t is None else (t.replace(_SEP, " ") if _SEP in t else t)
        chunk.append(t)
        size += len(t) + 1
        if size > _CHUNK:
            flush()
    flush()
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
    if with_digits:
        return hashes, offsets, np.concatenate(marks) if marks else np.zeros(0, bool)
    return hashes, offsets


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the row of each, and its first word's place in ``hashes``."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            g = (g + hashes[k : total - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
            g ^= g >> np.uint64(32)
        g = mix(g)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: total - n + 1] == row[n - 1 :]
    at = np.flatnonzero(inside)
    return g[at], row[at], at


ROW_BITS = 20


def distinct_per_row(grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set of n-grams of each row, as flat arrays ordered by row.

    Row and the upper 44 bits of the hash share one 64-bit key, so one fast sort does; the
    hashes come back with their lower bits cleared, the same for every batch of rows.
    """
    if not len(grams):
        return grams, row
    shift, cut = np.uint64(64 - ROW_BITS), np.uint64(ROW_BITS)
    if int(row[-1]) >> ROW_BITS or int(row.max()) >> ROW_BITS:
        half = int(row.max()) // 2
        parts = [distinct_per_row(grams[m], row[m] - low) for m, low in ((row <= half, 0), (row > half, half + 1))]
        return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1] + half + 1])
    key = (row.astype(np.uint64) << shift) | (grams >> cut)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key << cut, (key >> shift).astype(np.int64)
