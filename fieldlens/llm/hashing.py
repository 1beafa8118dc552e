"""Vectorised hashes of the words of many texts at once (numpy, inside tasks).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its hash is a polynomial over randomly
mapped bytes, taken from prefix sums modulo 2^64 and then mixed, so no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
CHUNK_BYTES = 1 << 20


def process_state(name: str) -> dict:
    """A dict that a reused worker finds again in its next task. One is kept: asking for another frees it."""
    import sys
    import types
    kept = vars(sys.modules.setdefault("fieldlens_state", types.ModuleType("fieldlens_state")))
    if kept.get("name") != name:
        kept.update(name=name, state={})
    return kept["state"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lane(lane: int) -> tuple[int, np.ndarray]:
    """Base (odd) and byte table of a lane, from the finaliser itself."""
    seed = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(lane * 1_000_003))
    return int(seed[256]) | 1, seed[:256]


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a lane's base and of its inverse modulo 2^64, kept between calls."""
    known = process_state("powers")
    if lane not in known or len(known[lane][0]) < n:
        base, _ = _lane(lane)
        size = max(n, CHUNK_BYTES * 2)
        factors = np.ones((2, size), np.uint64)
        factors[0, 1:], factors[1, 1:] = base, pow(base, -1, 1 << 64)
        known[lane] = tuple(np.cumprod(factors, axis=1, dtype=np.uint64))
    return known[lane][0][:n], known[lane][1][:n]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes], lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``: (one array per lane, first word of each text plus the end,
    start byte of each word in the joined texts, end byte)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends_of_text = np.cumsum(sizes)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    gap = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    first = np.concatenate(([0], np.searchsorted(start, ends_of_text)))
    out = []
    for lane in range(lanes):
        fwd, inv = powers(lane, len(buf))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_lane(lane)[1][buf] * fwd)))
        out.append(mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64)))
    return out, first, start, end


def chunks(values: list[bytes], limit: int = CHUNK_BYTES):
    """Runs (lo, hi) of ``values`` of about ``limit`` bytes; a longer value stands alone."""
    lo = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(v)
    if lo < len(values):
        yield lo, len(values)


def rolling(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries of ``h``."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    fwd, inv = powers(lane + 8, len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * fwd[: len(h)])))
    return mix((sums[k:] - sums[:-k]) * inv[: len(h) - k + 1])


def spans(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the entries lo..hi-1 of ``h`` for each pair of bounds."""
    fwd, inv = powers(lane + 8, len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * fwd[: len(h)])))
    return mix((sums[hi] - sums[lo]) * inv[lo] + (hi - lo).astype(np.uint64))


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
