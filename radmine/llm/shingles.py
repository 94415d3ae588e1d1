"""Word shingles of texts as 64-bit hashes, many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = pow(int(BASE), -1, 1 << 64)
#: Bytes of text that are hashed at once (a longer text is hashed by itself).
BLOCK = 1 << 18
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: a run of ASCII letters, digits, _ or non-ASCII characters."""
    x = np.frombuffer(data, np.uint8)
    inside = WORD_BYTE[x]
    turn = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(x), BASE))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    inverse = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(x), np.uint64(_INV)))])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def shingle_arrays(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text, in order, the hashes of its shingles in text order: runs of `width` lower-cased words; of a text
    with fewer words, the one shingle of all of them; nothing for null and for texts without words."""
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i < len(texts) and (not parts or size < BLOCK):
            parts.append((texts[i] or "").lower().encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            i += 1
        words, starts = _word_hashes(b"\n".join(parts))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = min(width, b - a)
            if n == 0:
                yield np.zeros(0, np.uint64)
                continue
            h = np.full(b - a - n + 1, np.uint64(n))
            for j in range(n):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[a + j : b - n + 1 + j])
            yield h
