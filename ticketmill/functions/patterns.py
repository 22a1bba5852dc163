"""Regular expressions over a word list."""

from __future__ import annotations

from collections.abc import Iterable

# Branches tried one after the other before a range check halves them.
FAN_OUT = 16


def _literal(char: str) -> str:
    return char if char.isalnum() else f"\\x{{{ord(char):x}}}"


def _choice(tree: dict, chars: list[str]) -> str:
    if len(chars) <= FAN_OUT:
        return "|".join(_branch(tree, c) for c in chars)
    half = len(chars) // 2
    left, right = chars[:half], chars[half:]
    return (
        f"(?=[\\x{{0}}-\\x{{{ord(left[-1]):x}}}])(?:{_choice(tree, left)})"
        f"|(?=[\\x{{{ord(right[0]):x}}}-\\x{{10ffff}}])(?:{_choice(tree, right)})"
    )


def _branch(tree: dict, char: str) -> str:
    """``char`` and what follows it. Stretches without a fork are written out, so nesting grows with forks only."""
    out = [_literal(char)]
    node = tree[char]
    while len(node) == 1 and "" not in node:
        (char, node), = node.items()
        out.append(_literal(char))
    chars = sorted(c for c in node if c)
    if chars:
        body = _choice(node, chars)
        out.append(f"(?:{body}|)" if "" in node else f"(?:{body})")
    return "".join(out)


def word_pattern(words: Iterable[str]) -> str:
    """Pattern matching the longest word at a position.

    A plain alternation tries every word at every character. Sharing prefixes and halving wide branches with
    range checks makes the cost per character grow with the logarithm of the list instead.
    """
    tree: dict = {}
    for word in words:
        if not word:
            continue
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}
    if not tree:
        return "(?!)"
    return f"(?:{_choice(tree, sorted(tree))})"


def forks(words: Iterable[str]) -> int:
    """The most groups that :func:`word_pattern` nests: at each word that is a prefix and each parting of two words."""
    listed = sorted({w for w in words if w})
    shared = [_common(a, b) for a, b in zip(listed, listed[1:])]
    deepest, open_at = 0, []
    for n in shared:
        while open_at and open_at[-1] > n:
            open_at.pop()
        if not open_at or open_at[-1] < n:
            open_at.append(n)
        deepest = max(deepest, len(open_at))
    return deepest


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def prefix_layers(words: Iterable[str]) -> list[list[str]]:
    """Words grouped by how many other listed words are their proper prefixes.

    The words that start at one position of a text form a chain of prefixes, so each layer matches there at
    most once.
    """
    layers: dict[int, list[str]] = {}
    chain: list[str] = []
    for word in sorted({w for w in words if w}):  # a word's prefixes sort before it, the nearest last
        while chain and not word.startswith(chain[-1]):
            chain.pop()
        layers.setdefault(len(chain), []).append(word)
        chain.append(word)
    return [layers[d] for d in sorted(layers)]
