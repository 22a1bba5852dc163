"""Fingerprints, near duplicates, lines and repeated bytes against brute force; the pipeline against its stages' definitions."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
from conftest import DATA

import corpus_pipeline
from ticketmill.llm import fingerprints, grouping, language, line_dedup, order_minhash, repeats, shingles
from ticketmill.llm.components import components, contract

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, th int, stays string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], SCHEMA).repartition(6)


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1, 1])] = [rng.choice(WORDS)] * rng.choice([0, 1, 1])
        words = words or ["x"]
    return words


@pytest.fixture(scope="module")
def corpus():
    """Originals, exact and near copies in groups of several sizes, shared passages, odd texts, repeated rows."""
    rng = random.Random(11)
    rows, doc_id = [], 0
    passage = " ".join(rng.choices(WORDS, k=60))
    for size in (1, 1, 2, 3, 40):
        base = rng.choices(WORDS, k=rng.choice([60, 150, 300]))
        for k in range(size):
            text = base if k % 3 == 0 else edited(rng, base, 3)
            rows.append((doc_id, "\n".join(" ".join(text[i : i + 12]) for i in range(0, len(text), 12))))
            doc_id += 1
    for _ in range(10):
        rows.append((doc_id, " ".join(rng.choices(WORDS, k=150)) + "\n" + passage + "\n" + " ".join(rng.choices(WORDS, k=90))))
        doc_id += 1
    rows += [(200, ""), (201, None), (202, "..."), (203, "one"), (204, "One!"), (205, "be " * 900), (206, "be " * 880), (207, "é" * 260), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(208, "a b c d e f g h i j\n" * 6), (209, " ".join(rng.choices(WORDS, k=30_000)))]
    return rows


# Shingles and fingerprints


def test_words_and_shingles_match_python():
    texts = ["", "One, two  THREE", "a" * 9000 + " b", "x y z", "é É e", "a b c d e f g", "--", "tail"]
    raw = [t.encode() for t in texts]
    hashes, offsets = shingles.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    seen = {}
    for i, t in enumerate(texts):
        own = words_of(t)
        assert offsets[i + 1] - offsets[i] == len(own)
        for w, h in zip(own, hashes[offsets[i] : offsets[i + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    found, by_text = shingles.shingle_hashes(hashes, offsets)
    assert np.diff(by_text).tolist() == [max(len(words_of(t)) - 4, 1) if words_of(t) else 0 for t in texts]
    grams = {}
    for i, t in enumerate(texts):
        own = words_of(t)
        for k, h in enumerate(found[by_text[i] : by_text[i + 1]].tolist()):
            assert grams.setdefault(tuple(own[k : k + 5]), h) == h
    assert len(set(grams.values())) == len(grams)


def test_blocks_do_not_change_words(monkeypatch):
    text = (" ".join(WORDS) + "é" * 300 + " z").encode()
    data, offsets = np.frombuffer(text * 3, np.uint8), np.array([0, len(text), 3 * len(text)])
    want = shingles.word_hashes(data, offsets)
    monkeypatch.setattr(shingles, "SLAB_BYTES", 37)
    got = shingles.word_hashes(data, offsets)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        a = rng.choices(WORDS, k=800)
        b = a[: int(800 * share)] + rng.choices(WORDS, k=800 - int(800 * share))
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        s = fingerprints.signatures([" ".join(x).encode() for x in (a, b)])
        assert abs(fingerprints.likeness(s[:1], s[1:])[0] - true) < 0.15


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_every_text_meets_the_next(spark, corpus, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = fingerprints.compare_with_next(frame(spark, corpus)).collect()
        one = fingerprints.compare_with_next(frame(spark, [(1, "abcd")])).collect()
        none = fingerprints.compare_with_next(frame(spark, [])).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((i, t or "") for i, t in corpus), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = collections.Counter()
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        want[str(i), len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == want
    by_text = {}
    for r in rows:
        text = dict(corpus)[r.doc_id]
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(one) == 1 and one[0].near_next == 1 and none == 0


# Near duplicates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_distance_is_exact_within_the_band():
    rng = random.Random(2)
    for _ in range(3000):
        letters = rng.choice([2, 4, 30])
        a = [rng.randrange(letters) for _ in range(rng.randrange(30))]
        b = [rng.randrange(letters) if rng.random() < 0.2 else x for x in a if rng.random() > 0.1] + [0] * rng.randrange(3)
        true, band = distance(a, b), rng.randrange(1, 12)
        assert order_minhash.banded_distance(a, b, band) == (true if true <= band else None), (a, b, band)
        longer = max(len(a), len(b))
        similarity = 1 - true / longer if longer else 1.0
        got = order_minhash.edit_similarity(np.array(a, np.uint32), np.array(b, np.uint32))
        assert got == pytest.approx(similarity if true <= int(0.2 * longer + 1e-9) else 0.0)


def test_repeats_and_order_count_in_sketches():
    a, b = "one two three four five six " * 3, "six five four three two one " * 3
    raw = [a.encode(), b.encode(), a.upper().encode()]
    words, offsets = shingles.word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    grams, by_text = shingles.shingle_hashes(words, offsets)
    labels = order_minhash.label_occurrences(grams, by_text)
    first = labels[by_text[0] : by_text[1]]
    assert len(set(first.tolist())) == len(first) > len(set(grams[by_text[0] : by_text[1]].tolist()))
    rows = order_minhash.sketches(labels, by_text)
    assert (rows[0] == rows[2]).all() and (rows[0] != rows[1]).any()


def edit_alike(a, b):
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)):
        return False
    codes = {w: k for k, w in enumerate(set(a) | set(b))}
    return order_minhash.edit_similarity(*(np.array([codes[w] for w in z], np.uint32) for z in (a, b))) >= 0.8


def jaccard_alike(a, b):
    x, y = ({tuple(z[i : i + 5]) for i in range(max(len(z) - 4, 1))} for z in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


@pytest.mark.parametrize("operator, alike", [(order_minhash, edit_alike), (fingerprints, jaccard_alike)])
def test_classes_are_components_of_alike_texts(spark, corpus, operator, alike):
    found = operator.near_duplicates(frame(spark, corpus)).collect()
    assert len(found) == len(corpus)
    texts = [(i, words_of(t) or (t or "").encode()) for i, t in corpus]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            a, b = texts[x][1], texts[y][1]
            if a == b or isinstance(a, list) and isinstance(b, list) and alike(a, b):
                parent[root(x)] = root(y)
    groups = collections.defaultdict(list)
    for x, (i, _) in enumerate(texts):
        groups[root(x)].append(i)
    want = collections.Counter()
    for ids in groups.values():
        low = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[str(i), str(low), len(ids)] += 1
    assert collections.Counter((str(r.doc_id), str(r.class_id), r.class_size) for r in found) == want
    assert sum(r.stays for r in found) == len(groups)
    assert operator.near_duplicates(frame(spark, [])).count() == 0
    if operator is order_minhash:
        kept = order_minhash.drop_near_duplicates(frame(spark, corpus))
        assert kept.columns == ["doc_id", "text", "th", "stays"]
        rows = kept.collect()
        assert len(rows) == len(groups) and {r.stays for r in rows} == {"clash"}


ANYTHING = grouping.Bound(lambda body: np.zeros(1, np.uint64), lambda longer: np.full(longer.shape, 1 << 40))


@pytest.mark.parametrize("block", [1024, 2])
def test_texts_of_a_bucket_meet_each_other(spark, monkeypatch, block):
    """Like texts are found where the first text of their only bucket is like none of them, or like one of them."""
    monkeypatch.setattr(grouping, "BLOCK", block)
    bodies = {0: b"first", 1: b"x", 2: b"other", 3: b"xy", 4: b"xyz", 5: b"far", 6: b"x" * 90, 7: b"firs"}
    rows = spark.createDataFrame([(i, i, 0, i) for i in bodies], "rid long, doc_id long, th long, node long")
    nodes = spark.createDataFrame([(i, [1] if i < 7 else [1, 2]) for i in bodies], "node long, keys array<long>")
    texts = spark.createDataFrame([(i, len(b), b) for i, b in bodies.items()], "node long, size long, body binary")
    found = grouping.classes(rows, nodes, lambda wanted: texts, lambda a, b: a.startswith(b) and len(a) <= len(b) + 1 or b.startswith(a) and len(b) <= len(a) + 1, ANYTHING)
    assert {r.doc_id: r.class_id for r in found.collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 6, 7: 0}


def test_bitmaps_never_rule_out_alike_texts():
    """Of random pairs of all likenesses, those that are alike pass the bound; most unlike ones with a common passage do not."""
    rng = random.Random(12)
    bound = order_minhash.distance_bound(0.8)
    kept = 0
    for k in range(300):
        n = rng.choice([1, 2, 7, 60, 200, 700])
        a = [rng.randrange(50 if k % 3 else 5000) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(int(0.4 * n) + 2)):
            at = rng.randrange(len(b))
            b[at : at + rng.choice([0, 1])] = [rng.randrange(5000)] * rng.choice([0, 1]) or [b[at]]
        x, y = np.array(a, "<u4"), np.array(b, "<u4")
        rows = [(1, 1, len(a), order_minhash.pair_bits(x).tobytes()), (2, 2, len(b), order_minhash.pair_bits(y).tobytes())]
        pairs = grouping.compare_cell(rows, None, bound)
        assert pairs == grouping.compare_cell(rows[:1], rows[1:], bound)
        if order_minhash.edit_similarity(x, y) >= 0.8:
            assert pairs == [(1, 2)]
    passage = [rng.randrange(5000) for _ in range(60)]
    texts = [[rng.randrange(5000) for _ in range(140)] + passage for _ in range(40)]
    rows = [(i, i, 200, order_minhash.pair_bits(np.array(t, "<u4")).tobytes()) for i, t in enumerate(texts)]
    kept = len(grouping.compare_cell(rows, None, bound))
    assert kept < 0.05 * 40 * 39 / 2
    assert grouping.missing_bits(np.array([[5, 1]], np.uint64), np.array([[4, 0], [7, 1]], np.uint64)).tolist() == [[2, 1]]


def test_words_part_texts_just_below_the_threshold():
    """Copies of one text with other words at random places: the finer bitmaps rule out most pairs below the threshold, and none above."""
    rng = random.Random(14)
    bound = order_minhash.distance_bound(0.8)
    text = [rng.randrange(5000) for _ in range(700)] + [7] * 50
    texts = []
    for k in range(60):
        copy = list(text)
        for at in rng.sample(range(750), 75 if k < 6 else 93):
            copy[at] = rng.randrange(5000, 50_000)
        texts.append(np.array(copy[: 750 - k % 3], "<u4"))
    rows = [(i, i, len(t), order_minhash.pair_bits(t).tobytes(), order_minhash.word_bits(t).tobytes()) for i, t in enumerate(texts)]
    pairs = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    alike = {(i, j) for i, j in pairs if order_minhash.edit_similarity(texts[i], texts[j]) >= 0.8}
    kept = grouping.compare_cell(rows, None, bound)
    assert alike and alike <= set(kept) and len(kept) < 0.5 * len(pairs)
    assert set(kept) <= set(grouping.compare_cell([r[:4] for r in rows], None, bound))
    assert sorted(kept) == sorted({*grouping.compare_cell(rows[:20], None, bound), *grouping.compare_cell(rows[20:], None, bound), *grouping.compare_cell(rows[:20], rows[20:], bound)})


def test_pairs_at_the_threshold_are_found(spark):
    """Pairs with an edit similarity of 0.80 to 0.85, changed at random places: nine of ten are found at the least."""
    rng = random.Random(13)
    rows, planted = [], {}
    for s in (0.80, 0.82, 0.85):
        for _ in range(150):
            n = rng.choice([100, 200, 300])
            a = [f"v{rng.randrange(20_000)}" for _ in range(n)]
            b = list(a)
            for at in rng.sample(range(n), round((1 - s) * n)):
                b[at] = f"u{rng.randrange(20_000)}"
            planted.setdefault(s, []).append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, rows)).collect()}
    for s, pairs in planted.items():
        assert sum(classes[a] == classes[b] for a, b in pairs) >= 0.9 * len(pairs), s
    assert len(set(classes.values())) >= len(rows) // 2


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 301), (301, 300), (302, 301)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    labels = {r.node: r.label for r in found}
    assert labels == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_contracted_classes_are_those_of_all_links(spark):
    rng = random.Random(14)
    first, second = ([(rng.randrange(60), rng.randrange(60)) for _ in range(25)] for _ in range(2))
    links = [spark.createDataFrame(x, "u long, v long") for x in (first, second)]
    got = {r.node: r.label for r in contract(components(links[0]), links[1]).collect()}
    want = {r.node: r.label for r in components(links[0].union(links[1])).collect()}
    assert got == want
    assert {r.node: r.label for r in contract(components(links[0]), links[1].limit(0)).collect()} == {r.node: r.label for r in components(links[0]).collect()}


# Lines


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a = [rng.randrange(8) for _ in range(rng.randrange(15))]
        b = [rng.randrange(8) for _ in range(rng.randrange(15))]
        pairs = line_dedup.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert line_dedup.align(list("abcde"), list("abcde")) == [(i, i) for i in range(5)]
    # Unique lines anchor the alignment, whatever repeats around them.
    assert (3, 1) in line_dedup.align(list("xxxUxx"), list("xUx"))
    assert line_dedup.common_blocks(list("abcXde"), list("YabcZdeW"), [4] * 8, 10) == [(1, 4)]


def brute_lines(rows):
    lines = {k: [x.strip(" ") or None for x in (t or "").split("\n")] for k, t in rows}
    order = sorted(lines, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    first = {}
    for k in order:
        for x in lines[k]:
            if x:
                first.setdefault(x, k)
    out = {}
    for k, text in rows:
        gone, earlier = set(), set()
        for f in {first[x] for x in lines[k] if x} - {k}:
            for a, b in line_dedup.common_blocks(lines[f], lines[k], [len(x.split()) if x else 0 for x in lines[k]]):
                gone |= set(range(a, b))
                earlier.add(f[0])
        out[k] = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone), len(gone), sorted(earlier)
    return out


def test_common_lines_go_from_later_documents(spark, corpus):
    # Equal rows are one document; the order of rows with one id is that of their hashes, so ids differ here but for those.
    want = brute_lines(list({(i, t or ""): ((i, t or ""), t) for i, t in corpus}.values()))
    found = line_dedup.drop_common_lines(frame(spark, corpus).withColumnRenamed("th", "n_lines")).collect()
    assert len(found) == len(corpus)
    removed = 0
    for r in found:
        options = [v for (i, t), v in want.items() if i == r.doc_id and (v[0] or None) == (r.text or None)]
        assert options and options[0][1:] == (r.n_removed, r.earlier), r.doc_id
        removed += r.n_removed
    assert removed > 50 and {r.text for r in found if r.doc_id == 201} == {None}
    assert line_dedup.drop_common_lines(frame(spark, [])).count() == 0


def common_runs(a, b, words):
    """Lines of b in some run of at least ten words that a has, by looking at all runs of all lengths."""
    gone = set()
    for i in range(len(b)):
        for j in range(i + 1, len(b) + 1):
            if sum(words[i:j]) >= 10 and any(a[k : k + j - i] == b[i:j] for k in range(len(a))):
                gone |= set(range(i, j))
    return gone


def test_every_shared_block_goes(spark):
    """What goes is all that is in some run of ten words of any earlier document."""
    x, y, z = "one two three four five six", "seven eight nine ten eleven twelve", "thirteen fourteen fifteen sixteen"
    rows = [(1, x + "\nalone"), (2, y + "\nother"), (3, f"{x}\n{y}"), (4, f"head\n{x}\n{y}\ntail"), (5, f"{y}\n\n{z}"), (6, f"{z}\n{y}\n\n{z}\nend"), (7, f"{x}\n{z}")]
    rng = random.Random(6)
    pool = [x, y, z, "short", "a b", "", "c d e f"]
    rows += [(10 + k, "\n".join([f"own {k}"] + rng.choices(pool, k=rng.randrange(1, 9)))) for k in range(40)]
    found = {r.doc_id: r for r in line_dedup.drop_common_lines(frame(spark, rows)).collect()}
    lines = {i: [v or None for v in t.split("\n")] for i, t in rows}
    for i, text in rows:
        own = lines[i]
        gone = set().union(*(common_runs(lines[k], own, [len(v.split()) if v else 0 for v in own]) for k in lines if k < i))
        assert found[i].n_removed == len(gone), i
        assert found[i].text == "\n".join(v for k, v in enumerate(text.split("\n")) if k not in gone), i
    assert found[4].text == "head\ntail"


def test_many_blank_lines_take_no_long():
    a, b = ["p", "q", *[None] * 100_000, "r", "s"], ["s", *[None] * 100_000, "p", "q", "r"]
    words = [4 if x else 0 for x in b]
    start = time.perf_counter()
    line_dedup.common_blocks(a, b, words, 10)
    assert time.perf_counter() - start < 10


def test_repeated_and_moved_passages_are_common():
    passage = ["p", "q", "r"]
    for a, b in (
        (["u", *passage, "v"], ["s", *passage, "t", *passage, "w"]),
        (["u", *passage, "v", *passage, "x"], ["s", *passage, "w"]),
        (["u", *passage, "v", "x", "y", "z"], ["x", "y", "z", "s", *passage]),
    ):
        blocks = line_dedup.common_blocks(a, b, [4] * len(b), 10)
        assert {k for low, high in blocks for k in range(low, high)} == common_runs(a, b, [4] * len(b)) != set()
    rng = random.Random(4)
    words = {k: rng.randrange(1, 12) for k in range(6)} | {None: 0}
    for _ in range(2000):
        a, b = (rng.choices([*range(6), None], k=rng.randrange(14)) for _ in range(2))
        counts = [words[x] for x in b]
        got = {k for low, high in line_dedup.common_blocks(a, b, counts, 10) for k in range(low, high)}
        assert got == common_runs(a, b, counts), (a, b)


# Repeated bytes


def brute_repeats(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + 200] for _, b in raw for s in range(len(b) - 199))
    out = []
    for i, b in raw:
        covered = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                covered[s : s + 200] = True
        runs = int((np.diff(np.append(0, covered.astype(int))) == 1).sum())
        out.append((str(i), len(b), int(covered.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~covered[:-1]])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("split_above", [1000, 1])
def test_repeated_windows_go(spark, corpus, monkeypatch, split_above):
    monkeypatch.setattr(repeats, "SPLIT_ABOVE", split_above)
    rng = random.Random(8)
    shared = "".join(rng.choices("abcdefgh", k=230))
    rows = [r for r in corpus if len(r[1] or "") < 20_000]
    rows += [(300 + k, "".join(rng.choices("xyz", k=rng.randrange(300))) + shared[: rng.choice([199, 200, 230])] + "".join(rng.choices("xyz", k=50))) for k in range(12)]
    rows += [(400, shared + shared), (401, "ab" * 300), (402, "q" * 199), (403, "q" * 200), (404, "r" * 201), (405, shared[1:200] + "é" * 150)]
    found = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_repeats(rows)


def test_pieces_of_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghijklmnop", k=9 << 20))
    rows = [(1, long), (2, long[(4 << 20) - 300 : (4 << 20) + 300]), (3, None)]
    found = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows)).collect()}
    assert [(found[i].n_removed, found[i].n_spans) for i in (1, 2, 3)] == [(600, 1), (600, 1), (0, 0)]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


# Pipeline


def test_stages_have_their_effect(spark):
    """Every stage over its predecessor's result, against a plain definition of what it keeps."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, results = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], DATA).cache())
    tables = [{r.doc_id: r for r in x.collect()} for x in results]
    assert all(x.columns == columns for x in results[1:-1])
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "decontamination", "tokens"]
    assert set(tables[1]) == {i for i, r in tables[0].items() if re.search(r"[^\W\d_]", r.text or "")}

    want = brute_lines([((i, r.text), r.text) for i, r in tables[1].items()])
    kept = {k[0]: v[0] for k, v in want.items() if not v[1] or v[0].strip()}
    assert {i: r.text for i, r in tables[2].items()} == kept
    assert all(r.n_chars == len(r.text) for r in tables[2].values())

    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(results[2]).collect()}
    assert set(tables[3]) == {i for i, c in classes.items() if i == c}

    items = [words_of(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items for i in range(max(len(w) - 12, 1))}
    for i, r in tables[3].items():
        own = words_of(r.text)
        hit = {k for n in {len(w) for w in windows} for s in range(len(own) - n + 1) if tuple(own[s : s + n]) in windows for k in range(s, s + n)}
        assert (i in tables[4]) == (not hit or 20 * len(hit) < len(own)), i
    assert set(tables[5]) == set(tables[4]) and all(4 * r.n_tokens == len(r.ids) for r in tables[5].values())
    run = corpus_pipeline.run(spark, DATA).select("doc_id", "text", "ids_sha256").collect()
    assert sorted(map(tuple, run)) == sorted((i, r.text, r.ids_sha256) for i, r in tables[5].items())


def test_stages_take_odd_tables(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, earlier int, own_th long, ids string"
    rows = [(1, "a cat sat", "en", None, 9, "s", 1, 2, "x"), (1, "a cat sat", "en", None, 9, "s", 1, 2, "x"), (None, None, None, None, None, None, None, None, None), (3, "", None, "y", 0, "", 0, 0, "")]
    docs = spark.createDataFrame(rows, names)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
    languages, lines, copies, clean = (stage(spark, docs, DATA) for _, stage in corpus_pipeline.STAGES[:-1])
    assert (languages.count(), lines.count(), copies.count(), clean.count()) == (2, 4, 2, 4)
    assert {r.score for r in languages.collect()} == {"s"}
    encode = corpus_pipeline.STAGES[-1][1]
    tokens = encode(spark, docs, DATA)
    assert tokens.columns == [*(c for c in docs.columns if c != "ids"), "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(r.n_tokens for r in tokens.collect()) == [0, 0, 3, 3] and encode(spark, docs.limit(0), DATA).count() == 0


def test_rejection_follows_the_number_of_languages():
    assert [round(language.least_score(n), 2) for n in (0, 1, 2, 4, 12)] == [0, 0, 0.6, 0.3, 0.1]
