"""Merkle manifest, packing and token alignment against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from tokenizers import Tokenizer

from ticketmill.llm import alignment, merkle, packing

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, i int, g string, rank int, pairs string"
CLASH = ("x", 7, "y", 8, "z")
ODD_TEXTS = [
    None, "", " ", "\n\n", "A", "Hello  world, it's\t3 o'clock", "<|endoftext|> and <s> or <unk> here", "日本語のテキスト と mixed", "é" * 300, "é ﬁ    x", "x" * 2000 + " y",
    " " * 900 + "tail", "a\x1cb\x00c", "▁word ▁", "ΣΑΣ ẞ ǅ", "tab\there\r\n", "🙂🙂 ok", "don't DON'T we'll", "1234567 12 1,000.50", "\x85next", "ﬀ ½ ②",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Manifest


def brute_manifest(rows):
    """Rows of (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        fields = [doc_id, source, lang, n_chars, text]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def climb(nodes):
        """The root, and for each node its (left, right) siblings by level."""
        paths = [[] for _ in nodes]
        members = [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            above, joined = [], []
            for at in range(0, len(nodes), 8):
                run = nodes[at : at + 8]
                for j in range(len(run)):
                    for k in members[at + j]:
                        paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
                above.append(sha("".join(run)))
                joined.append([k for j in range(len(run)) for k in members[at + j]])
            nodes, members = above, joined
        return nodes[0], paths

    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        listed = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = listed, climb([leaf(*r) for r in listed])
    root, tops = climb([trees[x][1][0] for x in order])
    out = []
    for lang, top in zip(order, tops):
        listed, (subroot, paths) = trees[lang]
        for r, path in zip(listed, paths):
            steps = path + top
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            node = leaf(r[0], text, *r[2:])
            for a, b in steps:
                node = sha(a + node + b)
            out.append((r[0], leaf(*r), subroot, root, sha("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


def check_manifest(spark, rows):
    table = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(4)
    found = merkle.manifest(table).drop("lang", "place").collect()
    assert sorted(map(tuple, found), key=str) == brute_manifest(rows)


def test_manifest(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-400, 4000) if i % 9 else rng.randrange(1 << 40), rng.choice(ODD_TEXTS), rng.choice(["en", "en", "de", "", "é"]), rng.choice(["s", None]), i % 5) for i in range(320)]
    rows += [(5, "Two", "xx", None, None), (64, "Three", "xx", None, None), (63, "One", "xx", "s", 1), (-(1 << 63), "Low", "xx", "s", 1), ((1 << 63) - 1, "High", "xx", "s", 1)]
    rows += [(None, None, None, None, None), (None, "b", None, None, None), (None, "B", "en", None, 1), (7, "Lone", "solo", None, 1)]
    rows += [rows[0], rows[0], rows[3], (None, "B", "en", None, 1)]  # repeated rows
    check_manifest(spark, rows)


@pytest.mark.parametrize("n", [1, 9, 65])
def test_manifest_of_one_language(spark, n):
    check_manifest(spark, [(3 * i, f"Text {i}", "en", "s", i) for i in range(n)])


def test_manifest_of_many_languages_and_of_none(spark):
    check_manifest(spark, [(i, "T", f"l{i % 70}", "s", i) for i in range(150)])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_totals_over_many_tasks(spark):
    rows = spark.range(0, 5000, 1, 9).selectExpr("id % 7 AS k", "id", "id % 11 AS v")
    found = {(r.k, r.id): r.out for r in merkle.running_totals(rows, ["k", "id"], "v", "out").collect()}
    total = 0
    for k, i in sorted((i % 7, i) for i in range(5000)):
        assert found[k, i] == total
        total += i % 11


# Packing


def library_ids(texts):
    return [x.ids + [0] for x in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def check_packing(found, rows, capacity):
    want = collections.Counter()
    for (doc_id, text), ids in zip(rows, library_ids([t or "" for _, t in rows])):
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[str(doc_id), piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert collections.Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [2048, 7])
def test_packing(spark, capacity, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_CHARS", 5000)
    rng = random.Random(2)
    rows = list(enumerate(ODD_TEXTS)) + [(100 + i, " ".join(rng.choices(["one", "Two,", "three", "zzyzx"], k=rng.randrange(900)))) for i in range(60)]
    rows += [(None, "no id"), (3, "again"), (3, "again"), (500, "word salad, " * 9000), (501, "x1y2" * 4000 + " end")]
    table = spark.createDataFrame([(*r, "en", "s", 1, *CLASH) for r in rows], SCHEMA).repartition(3)
    found = packing.pack(table, WORD, capacity, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in found)
    n, total = check_packing(found, rows, capacity), sum(r.length for r in found)
    assert n <= total / capacity * 1.03 + 1
    assert packing.pack(table.limit(0), WORD).count() == 0


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_CHUNKS", 10)
    with open(WORD, "rb") as f:
        chunks = packing.ChunkIds(f.read())
    texts = [" ".join(f"w{i * j}" for i in range(6)) for j in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in chunks.encode([t])] == [x[:-1] for x in library_ids(texts)]
    assert len(chunks) <= 10


def test_plan_holds_every_piece_and_fits_tightly():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([5, 20, 100, 2048])
        counts = {rng.randrange(1, capacity + 1): rng.choice([1, 2, 7, 1000]) for _ in range(rng.randrange(1, 30))}
        runs, used = packing.plan(counts, capacity), collections.Counter()
        for run in runs:
            assert run.times > 0 and sum(n * length for length, n in run.pieces) <= capacity
            for length, n in run.pieces:
                used[length] += run.times * n
        assert used == collections.Counter(counts)
        places = packing.Places(runs)
        if sum(counts.values()) < 3000:
            at = collections.defaultdict(list)
            for length, n in counts.items():
                for s, o in zip(*places.find(np.full(n, length), np.arange(n))):
                    at[int(s)].append((int(o), length))
            assert len(at) == places.bins
            for pieces in at.values():
                assert [o for o, _ in sorted(pieces)] == np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1].tolist()


def test_smallest_gives_way_to_the_tightest_pair():
    # 60 and 30 leave 10; 21 and 19 fill the gap of 40 in the place of 30.
    assert packing.fill([19, 21, 30, 60], {19: 1, 21: 1, 30: 1, 60: 1}, 100) == {60: 1, 21: 1, 19: 1}
    rng = random.Random(4)
    for _ in range(2000):
        left = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 9))}
        lengths, least, room = sorted(left), rng.randrange(1, 30), rng.randrange(1, 60)
        used = {x: 1 for x in lengths if rng.random() < 0.3}
        free = [x for x in lengths for _ in range(left[x] - used.get(x, 0))]
        sums = [a + b for i, a in enumerate(free) for b in free[:i] if least < a + b <= room]
        found = packing.tightest_pair(lengths, left, used, least, room)
        assert (sum(found) if found else None) == max(sums, default=None)


# Alignment


def brute_alignment(texts):
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    codes = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(c): c for c in codes} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in codes)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, counts = [], collections.Counter()
    for text in texts:
        sides = [], []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            sides = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids_a], [(i, piece(i)) for i in ids_b]
            if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
                sides = [], []
        ends = []
        for side in sides:
            at, found = 0, {}
            for k, (_, x) in enumerate(side):
                at += len(x)
                found[at] = k
            ends.append(found)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(sides[0][ends[0][e]][0], sides[1][ends[1][e]][0]) for e in shared]
        groups, i, j = [], 0, 0
        for e in shared:
            x, y = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(str(t) for t, _ in sides[0][i:x]) + "|" + ",".join(str(t) for t, _ in sides[1][j:y]))
            i, j = x, y
        counts.update(links)
        docs.append((len(sides[0]), len(sides[1]), groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(n_a, n_b, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), sha(";".join(g)) if g else "") for n_a, n_b, g, x in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("held, slab", [(1_000_000, 1 << 20), (40, 300)])
def test_alignment(spark, held, slab, monkeypatch):
    rng = random.Random(5)
    own = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(25).collect()]
    letters = "aAbBeth 's\n\t,.-1209éßж漢🙂́"
    texts = ODD_TEXTS + own + ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(60)] + [own[0], own[0]]
    rows = [(i if i != 4 else None, t, "en", "s", 1, *CLASH) for i, t in enumerate(texts)] + [(0, None, None, None, None, *CLASH)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = alignment.link_weights(table, BYTE, PIECE, held_pairs=held).collect()
    want = collections.Counter((str(r[0]), *w) for r, w in zip(rows, brute_alignment([r[1] for r in rows])))
    assert collections.Counter((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in found) == want
    assert alignment.link_weights(table.limit(0), BYTE, PIECE).count() == 0
    # Long texts go in parts, and give the same.
    monkeypatch.setattr(alignment, "SLAB_CHARS", slab)
    files = open(BYTE, "rb").read(), open(PIECE, "rb").read()
    got = [(n_a, n_b, n, n, d) for n_a, n_b, n, d, _, _ in alignment.Aligner(files).align(texts)]
    assert got == [(w[0], w[1], w[2], w[3], w[6]) for w in brute_alignment(texts)]


def test_ranks_are_those_of_the_file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f, open(PIECE, "rb") as g:
        aligner = alignment.Aligner((f.read(), g.read()))
    plain = "It's 12 o'clock -- they'll  say\n\n \tÉtat, naïve ½"
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choices(plain, k=60))
        assert aligner.tokenize([text])[0][0] == aligner.library.encode(" " + text, add_special_tokens=False).ids
