"""Hashed word shingles of whole texts, worked out in arrays of bounded size."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.full(n, _BASE)])
    down = np.concatenate([one, np.full(n, inverse)])
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(_PIECE)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of data, in order: polynomials of their bytes, mixed.
    Long data is taken in pieces that end at white space."""
    global _UP, _DOWN
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and data[end - 1] not in b" \t\n\v\f\r":
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        if len(b) >= len(_UP):
            _UP, _DOWN = _powers(2 * len(b))
        white = _WHITE[b]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        edge = np.concatenate([[0] if not white[0] else [], edge, [len(b)] if not white[-1] else []]).astype(np.int64)
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * _UP[: len(b)], dtype=np.uint64)])
        out.append(_mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def joined_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many words; of the whole sequence if there are fewer, but some."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, np.uint64(width))
    for k in range(width):
        h = h * _BASE + words[k : k + n]
        h ^= h >> np.uint64(29)
    return _mixed(h)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        # short texts share one pass over their bytes
        if not group:
            return
        words = word_hashes(b" ".join(group))
        at = 0
        for g in group:
            n = len(g.split())
            out.append(np.unique(joined_hashes(words[at : at + n], width)))
            at += n
        group.clear()

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").lower()
        if size + len(data) > _PIECE // 2:
            flush()
            size = 0
        if len(data) > _PIECE // 2:
            out.append(np.unique(joined_hashes(word_hashes(data), width)))
        else:
            group.append(data)
            size += len(data) + 1
    flush()
    return out


def fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
