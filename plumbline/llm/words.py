"""Vectorised word and shingle hashing of UTF-8 texts, shared by the document operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. A text's bytes are hashed in one pass with a polynomial
modulo 2**64 over a random value per byte, so that the cost per text is a few array operations.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
_BYTES = np.random.default_rng(20240521).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits: for words without punctuation.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(12, n.bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.empty(size, U)
            p[0] = 1
            done = 1
            while done < size:
                step = U(pow(base, done, 1 << 64))
                p[done : 2 * done] = p[:done] * step
                done *= 2
            _POWERS[k] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def word_spans(raw: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words in an array of bytes; between tells which bytes separate words."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.concatenate([[False], ~between[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte offset of UTF-8 data, its end included, how many code points begin before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def word_hashes(text: str | None, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte starts, byte ends) of a text's words; A-Z count as a-z. None is an empty text."""
    raw = utf8(text)
    return hash_words(LOWER[raw], *word_spans(raw, between))


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U)), start, end


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence if it is shorter; none without words."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, U)
    out = np.zeros(len(words) - k + 1, U)
    for i in range(k):
        out = (out + words[i : len(words) - k + 1 + i]) * U(_BASE) + U(k)
        out ^= out >> U(29)
    return mix(out)
