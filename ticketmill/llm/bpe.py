"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a state machine over bytes.

A merge can only be undone from the right by a chain of merges of falling rank, each starting in a right constituent of the
one before. The longest chain of the merge list, in symbols, is a sufficient lookahead: a token that ends at least
that far before the end of what was read stays. Long words are therefore encoded through a window of constant size.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ticketmill.llm.rows import Shared, extended, map_batches, prepare_session

#: Encoded chunks of text that a worker remembers before it starts afresh, and the longest of them.
MEMO_CHUNKS = 400_000
MEMO_LENGTH = 48
#: Symbols that the transducer reads beyond its lookahead before it merges; characters of a text that are read at once.
WINDOW = 512
BLOCK_CHARS = 1 << 20

# Fixed value: white space to the file's pre-tokenizer (Unicode's White_Space property).
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Characters that str.split() takes for white space and the pre-tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")

# Letters and numbers that the regex module knows and the library's pre-tokenizer does not.
NEWER_LETTERS = """0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: The first of them: text below takes the file's own pattern.
OLD = "\u0530"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@dataclass
class Tables:
    """The merge list by token ids."""

    tokens: list[str]  # by id
    merges: dict[int, tuple[int, int]]  # left << 32 | right -> (rank, merged id)
    inner: list[int]  # id of a byte inside a word
    last: list[int]  # id of a byte that ends a word
    special: dict[str, int]
    pattern: str
    older_pattern: str
    suffix: str
    lookahead: int = 0
    window: int = field(default=0)


def load(path: str) -> Tables:
    """Read a word-level BPE file of the ``tokenizers`` library (lower-casing, word-end suffix)."""
    with open(path, encoding="utf-8") as f:
        tables = parse(json.load(f), path)
    tables.lookahead = sufficient_lookahead(tables.merges)
    tables.window = tables.lookahead + WINDOW
    return tables


def parse(spec: dict, path: str = "this") -> Tables:
    """The tables of such a file, without its lookahead."""
    model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
    if model["type"] != "BPE" or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or not suffix:
        raise ValueError(f"{path} is not a word-level BPE file with word-end suffix")
    ids = model["vocab"]
    tokens = [""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token, i in [*ids.items(), *special.items()]:
        tokens[i] = token
    merges = {}
    for rank, (left, right) in enumerate(model["merges"]):
        merges.setdefault(ids[left] << 32 | ids[right], (rank, ids[left + right]))
    alphabet = byte_alphabet()
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return Tables(tokens, merges, [ids[c] for c in alphabet], [ids[c + suffix] for c in alphabet], special, pattern, _older(pattern), suffix)


def _older(pattern: str) -> str:
    """The pattern without the letters and numbers that are newer than the library's tables."""
    for kind, ranges in ((r"\p{L}", NEWER_LETTERS), (r"\p{N}", NEWER_NUMBERS)):
        listed = "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in ranges.split())
        pattern = pattern.replace(kind, f"[{kind}--[{listed}]]")
    return "(?V1)" + pattern


def _lower_newer() -> dict[int, int]:
    """Lower case of letters that Python's tables don't have yet."""
    pairs = dict(zip((0x1C89, 0xA7CB, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA, 0xA7DC), (0x1C8A, 0x264, 0xA7CD, 0xA7CF, 0xA7D3, 0xA7D5, 0xA7DB, 0x19B)))
    pairs |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    return pairs | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def sufficient_lookahead(merges: dict[int, tuple[int, int]]) -> int:
    """Symbols to the right of a token's end after which no merge can change the token.

    ``reach(r)`` of a rule r = (u, v) is the length of v plus the longest reach of a rule that starts with v, or with a
    right constituent of v, and comes before the merge that would take that constituent up. Rules are visited by rank, so
    all that may follow are known.
    """
    rules = sorted((rank, key >> 32, key & 0xFFFFFFFF, new) for key, (rank, new) in merges.items())
    made: dict[int, tuple[int, int, int]] = {}  # token -> rank, left, right of the rule that makes it first
    for rank, left, right, new in rules:
        made.setdefault(new, (rank, left, right))
    length: dict[int, int] = {}

    def size(token: int) -> int:
        if token not in length:
            length[token] = size(made[token][1]) + size(made[token][2]) if token in made else 1
        return length[token]

    best: dict[int, tuple[list[int], list[int]]] = {}  # left token -> ranks, longest reach up to each
    longest = 1
    for rank, left, right, _ in rules:
        follow, part, before = 0, right, rank
        while True:
            if part in best:
                ranks, reaches = best[part]
                if i := bisect.bisect_left(ranks, before):
                    follow = max(follow, reaches[i - 1])
            if part not in made:
                break
            before, part = made[part][0], made[part][2]
        reach = size(right) + follow
        ranks, reaches = best.setdefault(left, ([], []))
        ranks.append(rank)
        reaches.append(max(reach, reaches[-1]) if reaches else reach)
        longest = max(longest, reach)
    return longest


_NO_MERGE = (1 << 62, -1)


def merge(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Apply the merge list to a short run of symbols: lowest rank first, leftmost among equals."""
    if len(symbols) > 48:
        return _merge_long(symbols, merges)
    symbols, get = list(symbols), merges.get
    pairs = [get(a << 32 | b, _NO_MERGE) for a, b in zip(symbols, symbols[1:])]
    while pairs:
        best = min(pairs)
        if best is _NO_MERGE:
            break
        at = pairs.index(best)
        symbols[at : at + 2] = [best[1]]
        del pairs[at]
        if at:
            pairs[at - 1] = get(symbols[at - 1] << 32 | symbols[at], _NO_MERGE)
        if at < len(pairs):
            pairs[at] = get(symbols[at] << 32 | symbols[at + 1], _NO_MERGE)
    return symbols


def _merge_long(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """The same through a queue of pairs over a linked list."""
    n = len(symbols)
    token, after, before = list(symbols), [*range(1, n), -1], list(range(-1, n - 1))
    queue = [(m[0], i, token[i], token[i + 1], m[1]) for i in range(n - 1) if (m := merges.get(token[i] << 32 | token[i + 1]))]
    heapq.heapify(queue)
    while queue:
        _, i, left, right, new = heapq.heappop(queue)
        j = after[i]
        if token[i] != left or j < 0 or token[j] != right:
            continue
        token[i], token[j], after[i] = new, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (m := merges.get(token[a] << 32 | token[b])):
                heapq.heappush(queue, (m[0], a, token[a], token[b], m[1]))
    return [t for t in token if t >= 0]


def transduce(symbols: Iterable[int], tables: Tables, sizes: dict[int, int]) -> Iterator[int]:
    """Token ids of one word, from its symbols in order; holds at most ``tables.window`` symbols.

    ``sizes``: symbols of each token, filled as tokens are met.
    """
    held: list[int] = []
    for symbol in symbols:
        held.append(symbol)
        if len(held) < tables.window:
            continue
        done, stable = 0, len(held) - tables.lookahead
        for token in merge(held, tables.merges):
            size = sizes.get(token)
            if size is None:
                size = sizes[token] = len(tables.tokens[token].removesuffix(tables.suffix)) or 1
            if done + size > stable:
                break
            yield token
            done += size
        del held[:done]
    yield from merge(held, tables.merges)


class Encoder(dict):
    """Ids of chunks of text between white space, as little-endian 32-bit integers; remembers short chunks."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables
        self.words, self.older_words = regex.compile(tables.pattern), regex.compile(tables.older_pattern)
        self.lower_newer = _lower_newer()
        self.specials = re.compile("|".join(map(re.escape, sorted(tables.special, key=len, reverse=True)))) if tables.special else None
        self.sizes: dict[int, int] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        # NFC, then lower case character by character (no final sigma).
        plain = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        plain, words = plain.lower(), self.words
        if not plain.isascii() and max(plain) >= OLD:
            plain, words = plain.translate(self.lower_newer), self.older_words
        for found in words.finditer(plain):
            data = found.group().encode()
            if len(data) < self.tables.window:
                ids += merge([*map(self.tables.inner.__getitem__, data[:-1]), self.tables.last[data[-1]]], self.tables.merges)
            else:
                ids += transduce(self.symbols(data), self.tables, self.sizes)
        out = np.array(ids, "<u4").tobytes()
        if len(chunk) <= MEMO_LENGTH:
            if len(self) >= MEMO_CHUNKS:
                self.clear()
            self[chunk] = out
        return out

    def symbols(self, data: bytes) -> Iterator[int]:
        yield from map(self.tables.inner.__getitem__, data[:-1])
        yield self.tables.last[data[-1]]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, block by block. A special token's string in a text is that token."""
        at = 0
        if self.specials and "<|" in text:
            for found in self.specials.finditer(text):
                yield from self._plain(text[at : found.start()])
                yield np.array([self.tables.special[found.group()]], "<u4").tobytes()
                at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = at + BLOCK_CHARS
            if end < len(text):
                space = _SPACE.search(text, end)
                end = space.end() if space else len(text)
            block = text[at:end] if at or end < len(text) else text
            chunks = _SPACE.split(block) if _ODD.search(block) else block.split()
            yield b"".join(map(self.__getitem__, chunks))
            at = end


class Decoder:
    """Ids to text, a block at a time. The state is the bytes of an unfinished character, and whether a token went before.

    ``joined`` gives the library's text for a file without decoder: the tokens' strings with a blank between. Otherwise
    tokens become the bytes they stand for, word ends become blanks, and bytes become text as characters end.
    """

    def __init__(self, tables: Tables, joined: bool = True):
        self.joined, self.started = joined, False
        self.strings = tables.tokens
        if not joined:
            byte = {c: b for b, c in enumerate(byte_alphabet())}
            special = set(tables.special.values())
            self.bytes = [
                t.encode() if i in special else bytes(byte[c] for c in t.removesuffix(tables.suffix)) + b" " * t.endswith(tables.suffix)
                for i, t in enumerate(tables.tokens)
            ]
            self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if not numbers:
            return ""
        if not self.joined:
            return self.state.decode(b"".join(map(self.bytes.__getitem__, numbers)))
        text = " ".join(map(self.strings.__getitem__, numbers))
        if self.started:
            text = " " + text
        self.started = True
        return text

    def finish(self) -> str:
        return "" if self.joined else self.state.decode(b"", final=True)


def encode_documents(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` to every row, and ``ids`` (32-bit little-endian) if asked for.

    A null text counts as empty: no tokens, the digests of nothing. Repeated rows get the same result each. Columns of these
    names are replaced; all others pass through.
    """
    prepare_session(documents.sparkSession)
    shared = Shared(documents.sparkSession, load(path), Encoder)  # its size is that of the tokenizer file
    documents = documents.drop("n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = shared.get()
        tables = encoder.tables
        counts, digests, decoded, kept = [], [], [], []
        for text in batch["text"].to_pylist():
            n, ids_hash, text_hash, decoder, all_ids = 0, hashlib.sha256(), hashlib.sha256(), Decoder(tables), []
            for ids in encoder.encode(text or ""):
                n += len(ids) // 4
                ids_hash.update(ids)
                text_hash.update(decoder.feed(ids).encode())
                if with_ids:
                    all_ids.append(ids)
            counts.append(n)
            digests.append(ids_hash.hexdigest())
            decoded.append(text_hash.hexdigest())
            kept.append(b"".join(all_ids))
        batch = batch.append_column("n_tokens", pa.array(counts, pa.int64()))
        batch = batch.append_column("ids_sha256", pa.array(digests)).append_column("decoded_sha256", pa.array(decoded))
        return batch.append_column("ids", pa.array(kept, pa.binary())) if with_ids else batch

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_batches(documents, run, extended(documents, added), shared)
