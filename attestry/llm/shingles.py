"""Hashes of runs of words, for a whole batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Fixed value: an odd multiplier that spreads 64-bit hashes.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(texts: list[str], k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of many texts, as values and offsets: a 64-bit hash of each run of k words, A-Z in lower case.

    A text of fewer words has none, or with whole one token of all its words.
    Each different word of the batch is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    words = split.flatten().dictionary_encode()
    different = words.dictionary.to_pylist()
    hashed = np.array([xxhash.xxh64_intdigest(w, 42) for w in different], np.uint64)
    which, offsets = words.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    if "" in different:  # white space at an end leaves an empty word there
        real = which != different.index("")
        which, offsets = which[real], np.concatenate([[0], np.cumsum(real)])[offsets]
    word = hashed[which] if len(hashed) else np.zeros(0, np.uint64)
    size = np.diff(offsets)
    n = np.maximum(size - (k - 1), np.minimum(size, 1) if whole else 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    starts = np.repeat(offsets[:-1] - ends[:-1], n) + np.arange(ends[-1])
    short = np.flatnonzero(np.repeat(size, n) < k)
    with np.errstate(over="ignore"):
        out = np.zeros(len(starts), np.uint64)
        for j in range(k):
            at = np.minimum(starts + j, len(word) - 1)
            part = word[at] if len(word) else out
            if len(short):
                past = short[j >= np.repeat(size, n)[short]]
                part[past] = np.uint64(j)  # there is no such word: what stands here tells how many there are
            out = (out ^ part) * SPREAD
            out ^= out >> np.uint64(32)
    return out, ends
