"""Sets of word sequences as 52-bit hashes, computed for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

from tessera.llm.packing64 import U, mix

BITS = 52
_word_char: np.ndarray | None = None
_power = np.ones(1, U)
_inverse = np.ones(1, U)
_BASE = 0x9E3779B97F4A7C15


def word_chars() -> np.ndarray:
    """For every code point, whether it is a letter or digit."""
    global _word_char
    if _word_char is None:
        _word_char = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _word_char


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        size = 1 << int(n).bit_length()
        one = np.full(size, U(_BASE))
        one[0] = U(1)
        _power = np.cumprod(one)
        one = np.full(size, U(pow(_BASE, -1, 2**64)))
        one[0] = U(1)
        _inverse = np.cumprod(one)
    return _power[:n], _inverse[:n]


def shingle_sets(texts: list[str], width: int = 3, min_words: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """``(text index, shingle hash)``, ascending and distinct, of all texts with at least ``min_words`` words.

    Words are the maximal runs of letters and digits of the text in lower case; a shingle is ``width`` words in a row.
    Hashes have 52 bits: equal shingles are equal hashes, and different ones differ but for one in 2**52.
    """
    low = [(t or "").lower() for t in texts]
    none = np.zeros(0, np.int64), np.zeros(0, U)
    if not low:
        return none
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    edge = np.flatnonzero(np.diff(word_chars()[codes].view(np.int8), prepend=np.int8(0)))
    start, stop = edge[0::2], edge[1::2]
    owner = np.searchsorted(ends, start, "right")
    enough = np.bincount(owner, minlength=len(low)) >= max(min_words, width)
    use = enough[owner]
    if not use.any():
        return none
    power, inverse = _powers(len(codes))
    total = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * power, out=total[1:])
    start, stop, owner = start[use], stop[use], owner[use]
    word = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(U))
    at = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
    value = np.zeros(len(at), U)
    for k in range(width):
        value = mix(value * U(5) + word[at + k] + U(k))
    if len(low) > 1 << (64 - BITS):
        raise ValueError("at most 4,096 texts at a time")
    key = np.sort((owner[at].astype(U) << U(BITS)) | (value >> U(64 - BITS)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> U(BITS)).astype(np.int64), key & U((1 << BITS) - 1)


def slices(lengths: list[int], most_texts: int = 2048, most_chars: int = 2_000_000):
    """Ranges of a batch that stay under both bounds (one text may exceed the second alone)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= most_texts or total + n > most_chars):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
