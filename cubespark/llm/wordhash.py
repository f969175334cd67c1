"""64-bit hashes of all words of a block of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Longer words are hashed by themselves.
LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A fixed random code of each byte value at each place in a word.
_CODE = np.random.default_rng(20240101).integers(0, 1 << 63, (LONG, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def hash_words(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of other than ASCII white space, A-Z lower-cased) and the number of words of each text.

    Texts are taken about chunk bytes at a time: the arrays by byte are many times as large as the text.
    """
    parts, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= chunk):
            size += len(texts[to])
            to += 1
        parts.append(_hash_words(texts[at:to]))
        at = to
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts).lower() + b"\n"
    c = np.frombuffer(joined, np.uint8)
    space = _SPACE[c]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(start, begins))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    size = end - start
    inside = np.flatnonzero(~space)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    h = np.add.reduceat(_CODE[place & (LONG - 1), c[inside]], np.cumsum(size) - size)
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(joined[start[k] : end[k]])
    return h, counts
