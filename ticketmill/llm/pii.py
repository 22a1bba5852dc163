"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field over the numbers around them.

The patterns drop what they cannot match whole, such as a phone number that runs into a card number. The field looks at *islands* of
digits and the marks that numbers are written with. It scores whole candidate spans (shape, digits, checksum, borders) and
dynamic programming over spans of bounded length chooses boundaries and kinds together. It is trained on a bounded sample
of islands, with the patterns' spans as labels; spans of the patterns always stay.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.llm.rows import Shared, extended, map_batches, prepare_session

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
#: Documents and islands that the field is trained on, at most about.
SAMPLE_DOCUMENTS = 20_000
SAMPLE_ISLANDS = 400
EPOCHS = 25
#: Digits of the longest span; with it, the tokens of a span are bounded.
MOST_DIGITS = 19
MOST_TOKENS = 2 * MOST_DIGITS + 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that starts inside a run of digits would also have started at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_ISLAND = re.compile(r"[+(]*[0-9][0-9 ().+-]*")
_TOKEN = re.compile(r"[0-9]+|[^0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdecimal())


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = _digits(s)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, by kind, then start; each kind leftmost and non-overlapping, in time linear in the text."""
    if not _ANY.search(text):
        return []
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            found.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for kind, pattern, holds in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if holds(m.group())]
    return found


def _legal(kind: int, s: str) -> bool:
    if kind == 1:
        return "." in s and bool(_IP.fullmatch(s)) and _is_ip(s)
    if kind == 2:
        return len(s) >= 16 and bool(_CARD.fullmatch(s)) and _is_card(s)
    return kind == 3 and s[0] == "+" and bool(_PHONE.fullmatch(s)) and _is_phone(s)


class Island:
    """Tokens of a run of digits and marks, and its candidate spans with their features."""

    def __init__(self, text: str, start: int, end: int, legal_only: bool = False):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        # by last token: (first token, kind, legal, features)
        self.ending: list[list[tuple[int, int, bool, tuple]]] = [[(i, OUTSIDE, True, (("o", text[a].isdecimal()),))] for i, (a, _) in enumerate(self.tokens)]
        for i, (a, first) in enumerate(self.tokens):
            if not (text[a].isdecimal() or text[a] == "+"):
                continue
            digits = 0
            for j in range(i, min(i + MOST_TOKENS, len(self.tokens))):
                _, b = self.tokens[j]
                if not text[self.tokens[j][0]].isdecimal():
                    continue
                digits += b - self.tokens[j][0]
                if digits > MOST_DIGITS:
                    break
                if digits >= 4:
                    s = text[a:b]
                    for kind in range(1, OUTSIDE):
                        legal = _legal(kind, s)
                        if legal or not legal_only:
                            self.ending[j].append((i, kind, legal, self._features(text, a, b, s, kind, digits)))

    @staticmethod
    def _features(text: str, a: int, b: int, s: str, kind: int, digits: int) -> tuple:
        """Of the whole span: is it of the kind's form, its digits, its groups, its marks, its borders."""
        left, right = text[a - 1 : a], text[b : b + 1]
        groups = tuple(min(len(g), 5) for g in re.findall("[0-9]+", s))
        return (
            (kind, "legal", _legal(kind, s)),
            (kind, "digits", digits // 4),
            (kind, "groups", groups if len(groups) < 6 else "many"),
            (kind, "marks", "".join(sorted(set(s) - set("0123456789")))),
            (kind, "plus", s[0] == "+"),
            (kind, "left", left.isalnum()),
            (kind, "right", right.isalnum()),
        )


def islands(text: str) -> list[tuple[int, int]]:
    """Places of all islands with four digits or more."""
    out = []
    for m in _ISLAND.finditer(text):
        s = m.group().rstrip(" ().+-")
        if len(_digits(s)) >= 4:
            out.append((m.start(), m.start() + len(s)))
    return out


class Field:
    """Weights of span features and of pairs of neighbouring kinds."""

    def __init__(self):
        # The prior's mean: a span of the kind's form is likely, any other is not.
        self.weights: dict = defaultdict(float)
        for kind in range(1, OUTSIDE):
            self.weights[kind, "legal", True], self.weights[kind, "legal", False] = 4.0, -4.0
        self.mean = dict(self.weights)

    def score(self, features: tuple) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def _pair(self, before: int, kind: int) -> float:
        return self.weights.get(("pair", before, kind), 0.0)

    def best(self, island: Island, first: int, last: int) -> list[Span]:
        """The best segmentation of the tokens ``first`` to ``last`` (exclusive): its spans that have a kind's form.

        Spans of another form cannot be a result, so decoding leaves them out; training needs them as alternatives.
        """
        table: list[dict[int, tuple]] = [{OUTSIDE: (0.0, None)}]  # by tokens done: kind of the last span -> score, span
        for j in range(first, last):
            here: dict[int, tuple] = {}
            for i, kind, legal, features in island.ending[j]:
                if i < first:
                    continue
                own = self.score(features)
                for before, (total, _) in table[i - first].items():
                    value = total + own + self._pair(before, kind)
                    if kind not in here or value > here[kind][0]:
                        here[kind] = (value, (i, kind, legal, before))
            table.append(here)
        out, at = [], last - first
        kind = max(table[at], key=lambda k: table[at][k][0])
        while at:
            i, kind_here, legal, before = table[at][kind][1]
            if kind_here != OUTSIDE and legal:
                out.append((kind_here, island.tokens[i][0], island.tokens[first + at - 1][1]))
            at, kind = i - first, before
        return out

    def _expected(self, island: Island) -> dict:
        """Feature counts expected under the field: forward and backward sums over all segmentations."""
        n = len(island.tokens)
        scored = [[(i, kind, features, self.score(features)) for i, kind, _, features in ending] for ending in island.ending]
        forward = [[-math.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
        forward[0][OUTSIDE] = 0.0
        for j in range(n):
            sums = defaultdict(list)
            for i, kind, _, own in scored[j]:
                sums[kind] += [v + own + self._pair(before, kind) for before, v in enumerate(forward[i]) if v > -math.inf]
            for kind, values in sums.items():
                forward[j + 1][kind] = float(np.logaddexp.reduce(values))
        backward = [[-math.inf] * (OUTSIDE + 1) for _ in range(n + 1)]
        backward[n] = [0.0] * (OUTSIDE + 1)
        sums = [defaultdict(list) for _ in range(n + 1)]
        for at in range(n, 0, -1):
            for before, values in sums[at].items():
                backward[at][before] = float(np.logaddexp.reduce(values))
            for i, kind, _, own in scored[at - 1]:
                if backward[at][kind] > -math.inf:
                    for before in range(OUTSIDE + 1):
                        sums[i][before].append(backward[at][kind] + own + self._pair(before, kind))
        total = float(np.logaddexp.reduce([v for v in forward[n] if v > -math.inf]))
        counts: dict = defaultdict(float)
        for j in range(n):
            for i, kind, features, own in scored[j]:
                for before, v in enumerate(forward[i]):
                    if v == -math.inf or backward[j + 1][kind] == -math.inf:
                        continue
                    p = math.exp(v + own + self._pair(before, kind) + backward[j + 1][kind] - total)
                    counts["pair", before, kind] += p
                    for f in features:
                        counts[f] += p
        return counts

    @staticmethod
    def _observed(island: Island, spans: set[Span]) -> dict:
        counts: dict = defaultdict(float)
        at, before = len(island.tokens), None
        while at:
            ends = island.ending[at - 1]
            i, kind, features = next(
                ((i, k, f) for i, k, _, f in ends if (k, island.tokens[i][0], island.tokens[at - 1][1]) in spans), (ends[0][0], OUTSIDE, ends[0][3])
            )
            for f in features:
                counts[f] += 1
            if before is not None:
                counts["pair", kind, before] += 1
            at, before = i, kind
        counts["pair", OUTSIDE, before] += 1
        return counts

    def train(self, examples: list[tuple[Island, set[Span]]], epochs: int = EPOCHS, rate: float = 0.2, shrink: float = 0.01) -> Field:
        """Ascend the conditional likelihood with a Gaussian prior, one island after the other."""
        for epoch in range(epochs):
            step = rate / (1 + epoch / 5)
            for island, spans in examples:
                gradient = self._expected(island)
                for f, n in self._observed(island, spans).items():
                    gradient[f] -= n
                for f, g in gradient.items():
                    self.weights[f] -= step * (g + shrink * (self.weights[f] - self.mean.get(f, 0.0)))
        self.weights = dict(self.weights)
        return self


def find_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """The base spans and those that the field adds between them, by kind, then start."""
    added: list[Span] = []
    taken, first = sorted((a, b) for _, a, b in base), 0
    for start, end in islands(text):
        while first < len(taken) and taken[first][1] <= start:
            first += 1
        island = Island(text, start, end, legal_only=True)
        inside = list(itertools.takewhile(lambda s: s[0] < end, taken[first:]))
        free = [True] * len(island.tokens)
        at = 0
        for a, b in inside:  # by start, as the tokens are
            while at < len(free) and island.tokens[at][1] <= a:
                at += 1
            k = at
            while k < len(free) and island.tokens[k][0] < b:
                free[k] = False
                k += 1
        i = 0
        while i < len(free):
            j = i
            while j < len(free) and free[j]:
                j += 1
            if j > i and any(len(e) > 1 for e in island.ending[i:j]):
                added += field.best(island, i, j)
            i = j + 1
    return sorted(base + added)


def sample_islands(documents: DataFrame) -> list[tuple[str, int, int]]:
    """Islands with some text around them, from documents that a hash of doc_id picks, within the two bounds."""
    n = documents.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch["text"].to_pylist():
            for a, b in islands(text) if text and _ANY.search(text) else []:
                if b - a <= 200:  # training needs no longer ones
                    rows.append((text[max(0, a - 60) : b + 60], min(a, 60), min(a, 60) + b - a))
        return pa.record_batch([[r[0] for r in rows], pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["t", "a", "b"])

    found = map_batches(documents.filter(place < share).select("text"), run, "t string, a long, b long")
    # A top-k by hash: a bounded sample of islands in an order of its own.
    return [(r.t, r.a, r.b) for r in found.orderBy(F.xxhash64("t", "a"), "t", "a").limit(SAMPLE_ISLANDS).collect()]


def fit(documents: DataFrame) -> Field:
    """Train on islands whose spans the patterns find; an island that they leave in doubt (a span of a kind's form
    that they dropped) teaches nothing. Without any island the field is its prior."""
    prepare_session(documents.sparkSession)
    examples = []
    for text, a, b in sample_islands(documents):
        island, spans = Island(text, a, b), {s for s in base_spans(text) if s[0] and a <= s[1] and s[2] <= b}
        covered = [x for _, s, e in spans for x in range(s, e)]
        legal = {(k, island.tokens[i][0], island.tokens[j][1]) for j, ends in enumerate(island.ending) for i, k, ok, _ in ends if ok and k != OUTSIDE}
        if all(any(x in covered for x in range(s, e)) for _, s, e in legal):
            examples.append((island, spans))
    return Field().train(examples)


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(documents: DataFrame, field: Field) -> DataFrame:
    """Add counts of base spans by kind, ``base_sha256`` of them and ``spans`` (all, ``kind:start:end`` in code points).

    A null text counts as empty: no spans. Repeated rows get the same result each. Columns of these names are replaced.
    """
    prepare_session(documents.sparkSession)
    shared = Shared(documents.sparkSession, field)  # a few hundred weights
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    documents = documents.drop(*names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch["text"].to_pylist():
            base = base_spans(text) if text else []
            spans = find_spans(shared.get(), text, base) if text and _ANY.search(text) else base
            counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
            found.append((*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)))
        for i, name in enumerate(names):
            batch = batch.append_column(name, pa.array([f[i] for f in found], pa.int64() if i < len(KINDS) else pa.string()))
        return batch

    added = ", ".join([*(f"{n} long" for n in names[:4]), "base_sha256 string, spans string"])
    return map_batches(documents, run, extended(documents, added), shared)
