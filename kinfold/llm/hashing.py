"""Word and shingle hashes over whole Arrow batches of texts.

A word is a run of bytes other than space and 9 to 13; A-Z count as a-z where asked. All words of a batch
are hashed at once, byte by byte of their length, so the cost is a few array steps per byte.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PRIME, START = U(1099511628211), U(14695981039346656037)
LONG_WORD = 64
PIECE_BYTES = 8 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch and the offsets of its texts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, one text at least."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: 64-bit hashes of all words, and per text the index of its first one (and the end).

    ``table`` replaces each byte first; by default A-Z by a-z.
    """
    raw = table[raw]
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sizes = ends - begins
    got = np.full(len(begins), START)
    at = np.arange(len(begins))
    for k in range(int(min(sizes.max(initial=0), LONG_WORD))):
        at = at[sizes[at] > k]
        got[at] = (got[at] ^ raw[begins[at] + k].astype(U)) * PRIME
    for i in np.flatnonzero(sizes > LONG_WORD):
        got[i] = int.from_bytes(hashlib.blake2b(raw[begins[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mixed(got), np.searchsorted(begins, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)`` of all runs of ``size`` words; a text with fewer words has its whole sequence as one."""
    counts = np.diff(first)
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(per)))
    doc = np.repeat(np.arange(len(counts)), per)
    at = np.arange(begin[-1]) - begin[doc] + first[doc]
    left = np.minimum(counts[doc], size)
    got = np.full(len(at), START)
    for k in range(size):
        on = slice(None) if k == 0 or not len(left) or left.min() > k else np.flatnonzero(left > k)
        got[on] = mixed((got[on] ^ words[at[on] + k]) * PRIME)
    return got, begin
