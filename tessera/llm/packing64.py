"""Hashing and compact encoding of 64-bit arrays, shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import zstandard

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, all first bytes together and so on, so that constant bytes compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype, n: int, at: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    cut = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(cut.T).reshape(-1).view(dtype)


def pack(*arrays: np.ndarray, ascending: int = 0) -> bytes:
    """Arrays of any integer type in one compressed value; the first ``ascending`` of them are stored as differences."""
    head = np.array([len(arrays), ascending] + [y for a in arrays for y in (len(a), ord(a.dtype.char))], np.int64)
    body = [planes(np.diff(a, prepend=a.dtype.type(0))) if k < ascending else planes(a) for k, a in enumerate(arrays)]
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head.tobytes() + b"".join(body))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    size = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, np.int64, size, 4)
    at, out = 4 + 8 * size, []
    for k in range(head[0]):
        n, kind = int(head[2 + 2 * k]), np.dtype(chr(head[3 + 2 * k]))
        x = unplanes(raw, kind, n, at)
        at += n * kind.itemsize
        out.append(np.cumsum(x, dtype=kind) if k < head[1] else x)
    return out


def ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of every integer in the half-open ranges."""
    n = stop - start
    owner = np.repeat(np.arange(len(n)), n)
    first = np.repeat(start - (np.cumsum(n) - n), n)
    return owner, first + np.arange(len(owner))
