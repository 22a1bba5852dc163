"""Many phrases at once as flat arrays: a trie to find all of them at all places, and a Bloom filter of them.

Texts are arrays of code points. Both work on whole batches: the trie goes down one character at a time with all places that still
have a match, the filter hashes all stretches of one length with a few operations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Stands between texts of a batch; no character.
GAP = 0x1FFFFF
_CHAR_BITS = 21
#: Places that are looked at together.
SLAB = 1 << 18
#: Places whose hashes are looked up together: they stay in the processor's cache.
STRETCH = 1 << 14


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def code_string(codes: np.ndarray) -> str:
    return codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def lined_up(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts with a gap after each, and where each text begins (one more than texts)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.append(0, np.cumsum(lengths + 1))
    codes = np.full(int(starts[-1]), GAP, np.uint32)
    inside = np.ones(len(codes), bool)
    inside[starts[1:] - 1] = False
    codes[inside] = code_points("".join(texts))
    return codes, starts


class Trie:
    """Phrases by their characters. ``edges`` (node and character, sorted) leads edge k to node k + 1; ``phrase`` is the number of the
    phrase that ends at a node, or -1."""

    def __init__(self, phrases: list[str]):
        """``phrases``: different and not empty; their numbers are their places in the list."""
        lengths = np.array([len(p) for p in phrases], np.int64)
        flat, begin = code_points("".join(phrases)).astype(np.int64), np.append(0, np.cumsum(lengths))[:-1]
        alive, node = np.arange(len(phrases)), np.zeros(len(phrases), np.int64)
        edges, ends, known, depth = [], [np.full(1, -1, np.int32)], 0, 0
        while len(alive):
            keys, child = np.unique(node << _CHAR_BITS | flat[begin[alive] + depth], return_inverse=True)
            node = known + 1 + child
            edges.append(keys)
            depth += 1
            done = lengths[alive] == depth
            own = np.full(len(keys), -1, np.int32)
            own[child[done]] = alive[done]
            ends.append(own)
            alive, node, known = alive[~done], node[~done], known + len(keys)
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.phrase = np.concatenate(ends)
        first = edges[0] if edges else np.zeros(0, np.int64)
        self.root = np.zeros(GAP + 1 if len(first) > 64 else int(first[-1]) + 2 if len(first) else 1, np.int32)
        self.root[first] = np.arange(1, len(first) + 1)

    @property
    def nbytes(self) -> int:
        return self.edges.nbytes + self.phrase.nbytes + self.root.nbytes

    def find(self, codes: np.ndarray, ordered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and numbers of all phrases, by place, then length, or in any order."""
        found = [self._find(codes, at, min(at + SLAB, len(codes)), ordered) for at in range(0, len(codes), SLAB)]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def _find(self, codes: np.ndarray, begin: int, end: int, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node = self.root[np.minimum(codes[begin:end], len(self.root) - 1)]
        at = np.flatnonzero(node)
        node, at, depth, out = node[at].astype(np.int64), at + begin, 1, []
        while len(at):
            ended = self.phrase[node]
            hit = ended >= 0
            if hit.any():
                out.append((at[hit], np.full(int(hit.sum()), depth), ended[hit]))
            going = at + depth < len(codes)
            at, node = at[going], node[going]
            keys = node << _CHAR_BITS | codes[at + depth]
            edge = np.searchsorted(self.edges, keys)
            there = np.append(self.edges, -1)[edge] == keys if len(self.edges) < 1024 else self.edges[np.minimum(edge, len(self.edges) - 1)] == keys
            at, node, depth = at[there], edge[there] + 1, depth + 1
        if not out:
            return (np.zeros(0, np.int64),) * 3
        place, length, number = (np.concatenate(x).astype(np.int64) for x in zip(*out))
        if not ordered:
            return place, length, number
        order = np.argsort(place, kind="stable")  # lengths come in their order
        return place[order], length[order], number[order]


def leftmost_longest(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the phrases found (by place, then length) are taken: from the left, the longest, none over another."""
    if not len(place):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(np.append(place[1:] != place[:-1], True))  # the longest at each place
    out, end = [], -1
    for k, a, n in zip(last.tolist(), place[last].tolist(), length[last].tolist()):
        if a >= end:
            out.append(k)
            end = a + n
    return np.array(out, np.int64)


class Stretches:
    """The different stretches among many of one length: short ones as numbers, by the places of their characters in the text's own alphabet."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.alphabet, self.letters = np.unique(codes, return_inverse=True)
        self.width = max(len(self.alphabet) - 1, 1).bit_length()

    def counted(self, at: np.ndarray, n: int) -> dict[str, int]:
        """The stretches of ``n`` characters at the places, and how often each is there."""
        if n * self.width > 63:
            own = [code_string(self.codes[p : p + n]) for p in at.tolist()]
            return Counter(own)
        key = np.zeros(len(at), np.int64)
        for k in range(n):
            key = key << self.width | self.letters.take(at + k)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else at
        times = np.diff(np.append(first, len(key)))
        shifts = self.width * np.arange(n - 1, -1, -1)
        text = code_string(self.alphabet[key[first][:, None] >> shifts & (1 << self.width) - 1])
        return dict(zip((text[k : k + n] for k in range(0, len(text), n)), times.tolist()))


# Hashes of stretches of text.

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class Hashed:
    """Sums over the code points from which the hash of any stretch follows at once."""

    def __init__(self, codes: np.ndarray):
        value = _spread(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        self.total = np.append(np.uint64(0), np.cumsum(value * _powers(_BASE, len(codes)), dtype=np.uint64))
        self.back = _powers(_INVERSE, len(codes) + 1)

    def at(self, place: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        whole = (self.total[place + length] - self.total[place]) * self.back[place]
        return _spread(whole + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


    def stretch(self, begin: int, end: int, length: int) -> np.ndarray:
        """The hashes of one length at the places from ``begin`` to ``end``."""
        whole = (self.total[begin + length : end + length] - self.total[begin:end]) * self.back[begin:end]
        return _spread(whole + np.uint64(length * 0xD6E8FEB86659FD93 & _MASK))


class Bloom:
    """A blocked Bloom filter: a hash sets four bits of one 64-bit block."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    @staticmethod
    def size(rows: int, most_bytes: int) -> int:
        """Blocks for so many rows: about 16 bits a row, a power of two, within ``most_bytes``."""
        return min(1 << max(rows * 16 // 64, 1).bit_length(), 1 << (max(most_bytes // 8, 1).bit_length() - 1))

    @staticmethod
    def places(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of each hash."""
        bits = np.zeros(len(hashes), np.uint64)
        for k in range(4):
            bits |= np.uint64(1) << (hashes >> np.uint64(6 * k) & np.uint64(63))
        return (hashes >> np.uint64(24) & np.uint64(n - 1)).astype(np.int64), bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self.places(hashes, len(self.blocks))
        return self.blocks[block] & bits == bits

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are in it; most others are told by their first bit."""
        block = self.blocks.take((hashes >> np.uint64(24) & np.uint64(len(self.blocks) - 1)).view(np.int64))
        at = np.flatnonzero(block & np.uint64(1) << (hashes & np.uint64(63)) != 0)
        return at[self.has(hashes.take(at))]


def word_hashes(words: list[str]) -> np.ndarray:
    codes, starts = lined_up(words)
    return Hashed(codes).at(starts[:-1], np.diff(starts) - 1)


def probable(codes: np.ndarray, bloom: Bloom, lengths: list[int], head: int) -> Iterator[tuple[np.ndarray, int]]:
    """Places where a word of a length may stand, by length. ``bloom`` holds the words and, of those longer than ``head``, the first
    ``head`` characters: only places that begin like a long word are looked at for all the long lengths."""
    hashed = Hashed(codes)
    gaps = np.flatnonzero(codes == GAP)
    ends = np.append(gaps, len(codes))[np.searchsorted(gaps, np.arange(len(codes)))]  # where the text of each place ends
    room = ends - np.arange(len(codes))
    short = [n for n in lengths if n <= head]
    for n in short:
        at = [begin + bloom.among(hashed.stretch(begin, min(begin + STRETCH, len(codes) - n + 1), n)) for begin in range(0, len(codes) - n + 1, STRETCH)]
        at = np.concatenate([np.zeros(0, np.int64), *at])
        yield at[room.take(at) >= n], n
    if len(short) < len(lengths):
        begins = np.flatnonzero(room > head)
        begins = begins[bloom.has(hashed.at(begins, head))]
        for n in lengths[len(short) :]:
            at = begins[room[begins] >= n]
            yield at[bloom.has(hashed.at(at, n))], n
