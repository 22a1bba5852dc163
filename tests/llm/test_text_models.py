"""Language identification, byte-pair encoding, personal data and scores: brute force, round trips, held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from ticketmill.llm import bpe, language, pii, ppm
from ticketmill.llm import rows as rows_module
from ticketmill.llm.queries import hash_remainder, op3_language, op9_pii

BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


# Language


def test_language_of_held_out_documents(spark):
    truth = documents(spark)
    rows = op3_language(spark, DATA).collect()
    assert len(rows) == len(truth) and {r.doc_id for r in rows} == set(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_come_before_grams():
    model = language.Model(["x", "y"], [{"ab": 0}, {"a": 1, "b": 2}, {"ab": 3}, {}, {}, {}], np.array([[-1.0, -9], [-5, -1], [-5, -1], [-2, -8]]))
    scorer = language.Scorer(model)
    assert list(scorer.sums(["ab"])) == [-1, -9]
    assert list(scorer.sums(["aab"])) == [-2, -8]  # the known pair, not the letters
    assert list(scorer.sums(["ba"])) == [-5, -1]  # single letters
    assert list(scorer.sums(["zz"])) == [0, 0]
    assert language.predict_text(scorer, "ab ab")[0] == "x"
    for text in (None, "", " 12 3. ", "²"):
        assert language.predict_text(scorer, text) == ("und", 0.0)


def test_memory_of_unknown_words_is_bounded(monkeypatch):
    monkeypatch.setattr(language, "MEMO_WORDS", 8)
    model = language.Model(["x", "y"], [{}, {"a": 0, "b": 1}, {}, {}, {}, {}], np.array([[-1.0, -2], [-3, -1]]))
    scorer = language.Scorer(model)
    words = ["".join(p) for p in (random.Random(1).choices("ab", k=7) for _ in range(100))]
    want = sum(np.mean([[-1.0, -2] if c == "a" else [-3, -1] for c in w], axis=0) for w in words)
    assert np.allclose(scorer.sums(words), want) and len(scorer) <= 8


def test_language_of_odd_tables(spark):
    rows = [(1, "the cat", "en", 1.0), (1, "the cat", "en", 1.0), (None, "der hund", "de", 2.0), (3, None, None, None), (4, "der " * 50_000, None, 0.0), (5, "", "de", 0.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.fit(table)
    found = language.predict(table, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in found] == [(1, "en"), (1, "en"), (None, "de"), (3, "und"), (4, "de"), (5, "und")]
    nothing = language.fit(table.limit(0))
    assert {r.lang_pred for r in language.predict(table, nothing).collect()} == {"und"}
    assert language.predict(table.limit(0), model).count() == 0


# Byte-pair encoding


@pytest.fixture(scope="module")
def tables():
    return bpe.load(BPE)


def encoded(tables, text):
    return np.frombuffer(b"".join(bpe.Encoder(tables).encode(text)), "<u4").tolist()


def test_tokens_are_the_librarys(tables):
    library, rng = Tokenizer.from_file(BPE), random.Random(4)
    texts = ["", " ", "Foo's BAR'll 12 x1", "ΣΑΣ é e\u0301 \u00a0\u2003 \x1c\x85", "<|endoftext|>a<|startoftext|><|EndOfText|>", "日本語 ＡＢ ² ½", "a" * 30_000, "!" * 5000]
    texts += ["".join(rng.choice(rng.choice(["abcdehiot", "thean ", "éàü'st ", "😀 .x", "\u0130İßǅ ᾳ"])) for _ in range(rng.choice([5, 50, 900]))) for _ in range(200)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert encoded(tables, text) == want.ids, text[:80]
        assert bpe.Decoder(tables).feed(np.array(want.ids, "<u4").tobytes()) == library.decode(want.ids, skip_special_tokens=False)


def test_window_is_enough(tables):
    """Streaming through a window of constant size gives the tokens of the whole word."""
    rng = random.Random(5)
    assert 20 < tables.lookahead < 1000
    small = bpe.Tables(**{**tables.__dict__, "window": tables.lookahead + 1})
    for letters in ("ab", "thein", "aeiounst", "ha", "!?-", "e"):
        data = "".join(rng.choice(letters) for _ in range(3000)).encode()
        symbols = [*map(tables.inner.__getitem__, data[:-1]), tables.last[data[-1]]]
        assert list(bpe.transduce(symbols, small, {})) == bpe.merge(symbols, tables.merges)


def test_lookahead_of_a_small_list():
    # ab < bc < cd by rank of use: a b c d ... a later merge takes the right part away.
    ids = {c: i for i, c in enumerate("abcd")}
    pair = lambda x, y: ids[x] << 32 | ids[y]
    merges = {pair("c", "d"): (0, 10), pair("b", "c"): (1, 11), pair("a", "b"): (2, 12)}
    assert bpe.sufficient_lookahead(merges) == 3
    assert bpe.merge([0, 1, 2, 3], merges) == [12, 10] and bpe.merge([0, 1, 2], merges) == [0, 11]


def test_decoding_keeps_characters_whole(tables):
    text = "héllo wörld 日本"
    ids = encoded(tables, text)
    decoder = bpe.Decoder(tables, joined=False)
    pieces = [decoder.feed(np.array([i], "<u4").tobytes()) for i in ids] + [decoder.finish()]
    assert "".join(pieces).split() == text.split() and "\ufffd" not in "".join(pieces)


def test_encoded_table(spark, monkeypatch):
    library = Tokenizer.from_file(BPE)
    rows = [(1, "It's a Test", 7), (1, "It's a Test", 7), (None, None, None), (2, "", 0), (3, "word " * 40_000, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = bpe.encode_documents(table, BPE, with_ids=True).collect()
    for (doc_id, text, _), r in zip(rows, found):
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256) == (doc_id, len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(table.limit(0), BPE).count() == 0
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 64)
    text = "some words and more " * 50
    assert encoded(bpe.load(BPE), text) == library.encode(text, add_special_tokens=False).ids


# Personal data

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            holds = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and doubled % 10 == 0, 8 <= len(digits) <= 15]
            if holds[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789.@+- ()ab%é") for _ in range(rng.choice([6, 30, 60])))
        assert sorted(pii.base_spans(text)) == sorted(brute_spans(text)), text


def test_field_separates_what_runs_together():
    field = pii.Field()
    found = lambda text: pii.join_spans(pii.find_spans(field, text, pii.base_spans(text)))
    assert found("call +1 (269) 555-3296 4524132264652876 now") == "card:23:39,phone:5:22"
    assert found("4524132264652876 4524132264652876") == "card:0:16,card:17:33"
    assert found("4451718024887799 27.65.93.188") == "ip:17:29,card:0:16"
    for clean in ("", "version 2.0, page 12 of 300", "2024-10-11 12:30:59 555-3296", "0641917ea4e9feb9cda83477b57ac2654884f485", "1 2 3 4 5 6 7 8 9"):
        assert found(clean) == ""


def test_long_digit_runs_take_linear_time():
    for text in ("1" * 300_000, "12 " * 100_000, "+1" + "(" * 300_000, "a" * 300_000 + "@", "1." * 100_000):
        assert [s for s in pii.find_spans(pii.Field(), text, pii.base_spans(text)) if s[0] == 3] == []


def test_training_moves_the_field_and_sums_are_right():
    text = "x 4303 6245 6212 1775 y"
    island = pii.Island(text, 2, 21)
    field = pii.Field()
    expected = field._expected(island)
    total = sum(v for k, v in expected.items() if k[0] == "pair")
    assert total > 0 and all(v > -1e-9 for v in expected.values())
    # The expected number of outside tokens by enumeration of all segmentations.
    n = len(island.tokens)

    def walk(at, before, score):
        if at == n:
            yield score, 0
            return
        for j in range(at, n):
            for i, kind, _, features in island.ending[j]:
                if i == at:
                    for s, outside in walk(j + 1, kind, score + field.score(features) + field._pair(before, kind)):
                        yield s, outside + (kind == pii.OUTSIDE)

    runs = list(walk(0, pii.OUTSIDE, 0.0))
    z = sum(math.exp(s) for s, _ in runs)
    want = sum(math.exp(s) * k for s, k in runs) / z
    assert sum(v for k, v in expected.items() if k[0] == "o") == pytest.approx(want)
    before = field.score((("o", True),))
    field.train([(island, {(2, 2, 21)})], epochs=2)
    assert field.score((("o", True),)) < before


def test_private_data_of_the_documents(spark):
    truth = documents(spark)
    for r in op9_pii(spark, DATA).collect():
        base = sorted(brute_spans(truth[r.doc_id].text))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.join_spans(base).encode()).hexdigest()
        assert set(filter(None, pii.join_spans(base).split(","))) <= set(filter(None, r.spans.split(",")))


def test_private_data_of_odd_tables(spark):
    rows = [(1, "a@b.c", "clash"), (1, "a@b.c", "clash"), (None, None, None), (2, "", "x"), (3, "é +1 234 567 89", "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = pii.find(table, pii.fit(table)).collect()
    assert [r.spans for r in found] == ["email:0:5", "email:0:5", "", "", "phone:2:15"]
    assert pii.find(table.limit(0), pii.fit(table.limit(0))).count() == 0


# Scores


def test_scores_of_the_documents(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_SHARE", 1 / 3000)  # so that rare tokens take the join
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(None, None), (900_001, ""), (5, "twice"), (5, "twice"), (900_002, "long " * 60_000)], "doc_id long, text string")
    table = table.select("doc_id", "text").unionByName(extra)
    rows = [(r.doc_id, (r.text or "").encode()) for r in table.collect()]
    out = zlib.crc32
    held = lambda i: out(b"" if i is None else str(i).encode()) % 7 == 2
    counts = collections.Counter()
    tokens = lambda b: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", b)] + [None]
    for i, b in rows:
        if not held(i):
            counts.update(tokens(b))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held(i), len(t := tokens(b)), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4)) for i, b in rows
    )
    found = ppm.score_documents(table, hash_remainder(7) == 2).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(r.score < 0 for r in found)


def small_trie(texts, order, monkeypatch):
    monkeypatch.setattr(ppm, "ORDER", order)
    trie = ppm.Trie([], [], [], [])
    framed = [bytes([ppm.EDGE]) * order + t + bytes([ppm.EDGE]) for t in texts]
    for k in range(order + 1):
        rows = collections.Counter((int.from_bytes(f[i - k : i], "big"), f[i]) for f in framed for i in range(order, len(f)))
        keys = sorted(rows)
        listed, begins = np.unique([c for c, _ in keys], return_index=True)
        trie.contexts.append(listed.astype(np.int64))
        trie.begins.append(np.append(begins, len(keys)))
        trie.symbols.append(np.array([s for _, s in keys], np.uint8))
        trie.counts.append(np.array([rows[k] for k in keys]))
    return trie, framed


def test_escapes_and_exclusion_match_the_definition(monkeypatch):
    texts = [b"abracadabra", b"abra", b"cab", b"", b"a rare b"]
    trie, framed = small_trie(texts, 3, monkeypatch)

    def probability(context, symbol):
        excluded, left = set(), 1.0
        for k in range(3, -1, -1):
            seen = collections.Counter(f[i] for f in framed for i in range(3, len(f)) if f[i - k : i] == context[3 - k :])
            seen = {s: n for s, n in seen.items() if s not in excluded}
            if not seen:
                continue
            if symbol in seen:
                return left * (seen[symbol] - 0.5) / sum(seen.values())
            left *= 0.5 * len(seen) / sum(seen.values())
            excluded |= set(seen)
        return left / (256 - len(excluded))

    coder = ppm.Coder(trie)
    for text in (b"abracadabra", b"cabbage", b"", b"zzz", b"arare"):
        f = bytes([ppm.EDGE]) * 3 + text + bytes([ppm.EDGE])
        want = sum(math.log10(probability(f[i - 3 : i], f[i])) for i in range(3, len(f)))
        got = coder.score(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert got == pytest.approx(want, rel=1e-5), text


def test_distributions_sum_to_one():
    rng = np.random.default_rng(1)
    chain = [rng.integers(0, 3, (50, 256)) * (rng.random((50, 256)) < p) for p in (0.02, 0.2, 0.9)]
    chain.append(np.ones((50, 256)))
    assert np.allclose(ppm.distributions([c.astype(float) for c in chain]).sum(axis=1), 1)
    assert np.allclose(ppm.distributions([np.zeros((2, 256))]), 1 / 256)


def test_scores_without_rows(spark):
    table = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ppm.score_documents(table.limit(0), hash_remainder(7) == 2).count() == 0
    row = ppm.score_documents(table, hash_remainder(1) == 0).first()  # all held out
    assert (row.n_known, row.train_tokens) == (0, 0) and row.score == pytest.approx(-4 * math.log10(256))


@pytest.mark.parametrize("hot_bytes", [0, 16 * 300, 64 << 20])
def test_rare_contexts_count_in_scores(spark, monkeypatch, hot_bytes):
    """The scores are those of the whole model in one process, however large the corpus is beside a context, and whatever is held by the workers."""
    monkeypatch.setattr(ppm, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(ppm, "FLUSH_GRAMS", 3000)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["zug", "rare", "the", "é", "QX7"], k=rng.randrange(12)))) for i in range(60)]
    rows += [(100, "a" * 150_000), (101, "once upon"), (None, None), (102, "")]  # contexts seen once are below one place in 100,000
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    rows += [(i, "once upon rare \x00 text") for i in range(200, 220)]
    train = [(t or "").encode() for i, t in rows if not held(i)]
    coder = ppm.Coder(small_trie(train, ppm.ORDER, monkeypatch)[0])
    found = ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hash_remainder(7) == 2).collect()
    texts = dict(rows)
    assert len(found) == len(rows) and any(r.held_out for r in found)
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        want = coder.score(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert r.score == pytest.approx(want, rel=1e-4), r.doc_id


def test_held_tokens_are_bounded_by_bytes(spark, monkeypatch):
    rows = [(i, "字" * 500 + str(i)) for i in range(200)] + [(300, "a b a")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ppm.score_documents(table, hash_remainder(7) == 2).collect()))
    held = []
    monkeypatch.setattr(ppm, "HOT_BYTES", 20_000)
    monkeypatch.setattr(ppm, "Shared", lambda spark, value, *make: held.append(value) or rows_module.Shared(spark, value, *make))
    found = sorted(map(tuple, ppm.score_documents(table, hash_remainder(7) == 2).collect()))
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want])
    hot = held[-1][0]
    assert sum(len(t) for t in hot) <= 20_000


def test_grams_are_sorted_with_their_texts_and_looked_up_once():
    """256 texts, empty and equal ones among them: places, texts and logs are those of a plain walk."""
    rng = random.Random(15)
    texts = [bytes(rng.choice(b"ab\xc3\xff") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(256)]
    offsets = np.cumsum([0, *map(len, texts)])
    keys, of = ppm.sorted_grams(np.frombuffer(b"".join(texts), np.uint8), offsets)
    edge = bytes([ppm.EDGE])
    want = []
    for t, text in enumerate(texts):
        framed = edge * ppm.ORDER + text + edge
        for i in range(len(text) + 1):
            want.append((int.from_bytes(framed[i : i + ppm.ORDER][::-1] + framed[i + ppm.ORDER : i + ppm.ORDER + 1], "big"), t))
    assert list(zip(keys.tolist(), of.tolist())) == sorted(want)
    hot = np.unique(keys)[::3]
    logs = -np.arange(1, len(hot) + 1, dtype=np.float32)
    known, found = ppm.known_logs(keys, hot, logs)
    table = dict(zip(hot.tolist(), logs.tolist()))
    assert known.tolist() == [k in table for k in keys.tolist()] and found.tolist() == [table.get(k, 0) for k in keys.tolist()]
    for no_keys, no_hot in ((keys[:0], hot), (keys, hot[:0])):
        known, found = ppm.known_logs(no_keys, no_hot, logs[: len(no_hot)])
        assert len(known) == len(found) == len(no_keys) and not known.any() and not found.any()
    summed = ppm._summed(np.array([5, 7, 5, 6]), np.array([1, 2, 3, 4]), np.array([0, 1, 1, 0]))
    assert [x.tolist() for x in summed] == [[5, 6, 7], [4, 4, 2], [1, 0, 1]]
