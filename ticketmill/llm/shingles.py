"""Words and word shingles of whole batches of texts as numpy arrays.

A word is a run of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased, on the UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

from ticketmill.llm.rows import SLAB_BYTES

#: Words of a shingle.
WIDTH = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def random_words(seed: int, n: int) -> np.ndarray:
    """Fixed 64-bit constants: equal on every worker and in every run."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64)


_BYTE = random_words(11, 256)[_LOWER] | np.uint64(1)
_PLACE = random_words(12, 4096) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _block_words(data: np.ndarray, starts_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of a block; ``starts_doc`` marks bytes that begin a document."""
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | starts_doc[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)  # bytes of words
    begins = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    # Words longer than the table wrap around in it, with their block of 4096 bytes mixed in.
    value = _BYTE[data[at]] * (_PLACE[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return starts, mix(np.add.reduceat(value, begins) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that lie end to end in ``data``, and the offset of each text's first word.

    The work goes by blocks that end between words, so that its arrays stay small for a text of any length.
    """
    doc_start = np.zeros(len(data) + 1, bool)
    doc_start[offsets[:-1]] = True
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + SLAB_BYTES, len(data))
        while end < len(data):
            gap = np.flatnonzero(~_IS_WORD[data[end : end + 65536]])
            end += int(gap[0]) if len(gap) else min(65536, len(data) - end)
            if len(gap):
                break
        found, values = _block_words(data[at:end], doc_start[at:end])
        starts.append(found + at)
        hashes.append(values)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words of each text, in order, and the offsets by text.

    A text of fewer words, but not none, is one shingle.
    """
    counts = np.diff(offsets)
    ends = np.repeat(offsets[1:], counts)
    at = np.arange(offsets[0], offsets[-1])
    total = np.zeros(len(at), np.uint64)
    padded = np.append(words, np.zeros(width, np.uint64))
    for k, factor in enumerate((random_words(13, width) | np.uint64(1)).tolist()):
        part = padded[k : k + len(at)] * np.uint64(factor)
        part[at + k >= ends] = 0
        total += part
    kept = (at + width <= ends) | (at == np.repeat(offsets[:-1], counts))
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    return mix(total[kept]), np.append(0, np.cumsum(n))
