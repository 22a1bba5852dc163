"""Segmentation against goldens, brute force and its own second plan."""

import math
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketmill.functions import tries
from ticketmill.functions.patterns import forks, prefix_layers, word_pattern
from ticketmill.functions.segmentation import in_run
from ticketmill.functions.tries import Bloom, Trie, code_points, lined_up, probable, word_hashes
from ticketmill.operators import spans
from ticketmill.operators.segment import remove_words, segment, stop_natures
from ticketmill.operators.spans import learn_scores, probable_words

# Words that overlap each other in one text of a greenhouse log.
GOLDEN_WORDS = ["滴灌", "滴灌管", "管接头", "头", "漏水", "水泵", "泵7号"]
TEXT = "查滴灌管接头漏水泵7号"


# The plans: one expression, words held by the workers, words joined with positions.
PLANS = [{"limit": 1000}, {"limit": 0}, {"limit": 0, "held_rows": 0}]
# Phrases in the expression, held, and joined.
PHRASE_PLANS = [{}, {"phrase_limit": 0}, {"limit": 0, "phrase_limit": 0, "held_rows": 0}]


def one(spark, text, words, mode, **options):
    df = spark.createDataFrame([(1, text)], "doc_id long, t string")
    return segment(df, "t", "tokens", words, mode, **options).first()["tokens"]


def word_table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def brute_finest(text, words, keep=False):
    """All spans by position, longest first, from the definition."""
    text = text.lower()
    spans = {(i, w) for w in words for i in range(len(text)) if text.startswith(w, i)}
    covered = {p for i, w in spans for p in range(i, i + len(w))}
    for match in re.finditer(r"\S", text):
        i, c = match.start(), match.group()
        if in_run(c):
            if i == 0 or not in_run(text[i - 1]):
                end = next((j for j in range(i, len(text)) if not in_run(text[j])), len(text))
                spans.add((i, text[i:end]))
        elif i not in covered and (keep or c.isalnum()):
            spans.add((i, c))
    return [w for i, w in sorted(spans, key=lambda s: (s[0], -len(s[1])))]


def brute_longest(text, words, keep=False):
    text, i, out = text.lower(), 0, []
    while i < len(text):
        best = max((w for w in words if text.startswith(w, i)), key=len, default="")
        if not best and in_run(text[i]):
            best = text[i : next((j for j in range(i, len(text)) if not in_run(text[j])), len(text))]
        if best:
            out.append(best)
        elif not text[i].isspace() and (keep or text[i].isalnum()):
            out.append(text[i])
        i += max(len(best), 1)
    return out


@pytest.mark.parametrize("plan", PLANS)
def test_goldens(spark, plan):
    words = word_table(spark, GOLDEN_WORDS)
    assert one(spark, TEXT, words, "longest", **plan) == ["查", "滴灌管", "接", "头", "漏水", "泵7号"]
    assert one(spark, TEXT, words, "longest", **plan, protected=["接头漏"]) == ["查", "滴灌管", "接头漏", "水泵", "7", "号"]
    assert one(spark, TEXT, words, "finest", **plan) == [
        "查", "滴灌管", "滴灌", "管接头", "头", "漏水", "水泵", "泵7号", "7",
    ]


@pytest.mark.parametrize("alphabet", ["滴灌管接头漏uqé5 。z", "uqé5z 。"])
@pytest.mark.parametrize("keep", [False, True])
def test_random_texts_match_brute_force(spark, alphabet, keep):
    rng = random.Random(7)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    letters = alphabet.replace(" ", "")
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(30)})
    if "滴" not in alphabet:
        words = [w for w in words if all(map(in_run, w))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").repartition(3).cache()
    for mode, brute in (("finest", brute_finest), ("longest", brute_longest)):
        for plan in PLANS:
            result = segment(
                df, "t", "tokens", word_table(spark, words), mode, keep_punctuation=keep, **plan
            ).collect()
            assert len(result) == len(texts)
            for row in result:
                assert row["tokens"] == brute(row["t"], words, keep), (mode, plan, row["t"], words)


@pytest.mark.parametrize("mode", ["finest", "longest"])
@pytest.mark.parametrize("plan", PLANS + PHRASE_PLANS[1:])
def test_rules_replace_phrases(spark, mode, plan):
    words = word_table(spark, ["苗", "育苗盘"])
    rules = {"春育苗": ["春", "育苗"], "QQ": []}
    assert one(spark, "春育苗盘qq苗", words, mode, **plan, rules=rules, protected=["盘"]) == ["春", "育苗", "盘", "苗"]
    finest = ["育苗盘", "苗"] if mode == "finest" else ["育苗盘"]
    assert one(spark, "育苗盘Qq春", words, mode, **plan, rules=rules) == [*finest, "春"]


def test_longest_tokens_give_back_the_text(spark, tickets):
    result = segment(tickets, "orgtext", "tokens", GOLDEN_WORDS, "longest", keep_punctuation=True).collect()
    for row in result:
        assert "".join(row["tokens"]) == re.sub(r"\s", "", row["orgtext"].lower())


def test_null_empty_and_control_text(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\u0001b"), (4, "𠀀漏水")], "doc_id long, t string")
    for mode in ("finest", "longest"):
        for plan in PLANS:
            words = word_table(spark, ["漏水", "ab"])
            rows = segment(df, "t", "tokens", words, mode, protected=["zz"], **plan).orderBy("doc_id").collect()
            assert [r["tokens"] for r in rows] == [[], [], ["a", "b"], ["𠀀", "漏水"]]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("mode", ["finest", "longest"])
def test_case_and_private_characters(spark, mode, plan):
    """Characters for private use and control characters are text like any other."""
    words = word_table(spark, ["\ue0aa", "棚\ue0ab膜", "QR码", "\u0003\u0004"])
    text = "\u0003\u0004 棚\ue0ab膜 qr码\ue0aaIn\u0004"
    tokens = one(spark, text, words, mode, **plan, protected=["iN"], keep_punctuation=True)
    code = ["qr码", "qr"] if mode == "finest" else ["qr码"]
    assert tokens == ["\u0003\u0004", "棚\ue0ab膜", *code, "\ue0aa", "in", "\u0004"]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("mode", ["finest", "longest"])
def test_long_words_and_long_texts(spark, mode, plan):
    rng = random.Random(5)
    long_word = "".join(rng.choice("滴灌苗xy") for _ in range(10_000))
    words = [long_word, long_word[:40], "滴灌"]
    text = "灌" + long_word + " " + long_word[:60] + "苗苗"
    assert one(spark, text, word_table(spark, words), mode, keep_punctuation=True, **plan) == (
        brute_finest if mode == "finest" else brute_longest
    )(text, words, True)
    prefixes = ["a" * n for n in range(1, 300)]
    assert one(spark, "a" * 120, word_table(spark, prefixes), mode, **plan) == (
        brute_finest if mode == "finest" else brute_longest
    )("a" * 120, prefixes)


LONG_RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from ticketmill.operators.segment import segment
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "2").getOrCreate()
)
df = spark.createDataFrame([(1, "k" * 1_000_000), (2, "kb" * 500 + "漏水" * 500)], "doc_id long, t string")
words = spark.createDataFrame([("漏水",), ("kq",), ("x",)], "word string")
for plan in ({"limit": 100}, {"limit": 0}, {"limit": 0, "held_rows": 0}):
    for mode in ("longest", "finest"):
        rows = segment(df, "t", "tokens", words, mode, protected=["zz"], **plan).select("doc_id", F.size("tokens").alias("n")).collect()
        assert {r.doc_id: r.n for r in rows} == {1: 1, 2: 501}, (plan, mode, rows)
print("all plans done")
"""


def test_a_million_letters_in_a_fresh_jvm(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", LONG_RUN, root, str(tmp_path)], capture_output=True, text=True, timeout=600)
    assert "all plans done" in done.stdout, done.stderr[-2000:]


def test_pattern_prefers_the_longest_word():
    words = ["a", "ab", "abc", "b.c", "".join(map(chr, range(0x4E00, 0x4E20)))]
    words += [chr(c) + "x" for c in range(0x5000, 0x5040)]
    pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), word_pattern(words))
    for word in words:
        assert re.match(pattern, word + "!").group() == word
    assert re.match(pattern, "bxc") is None
    assert [sorted(x) for x in prefix_layers(["a", "ab", "abc", "b"])] == [["a", "b"], ["ab"], ["abc"]]
    assert re.match(word_pattern(["y" * 20_000, "z"]), "y" * 20_000)
    assert forks(["a" * n for n in range(1, 50)]) == 48 and forks(["abc", "abd", "x", "y"]) == 1


@pytest.mark.parametrize("limit", [100, 0])
def test_stop_words_keep_order_repeats_and_case(spark, limit):
    """Rows stay rows, whatever their ids; the same on either plan."""
    rows = [(7, ["z", "y", "Z", "z", "x"]), (7, ["y", "w"]), (None, ["x", None, "y"]), (None, []), (2, None), (2, ["w", "w"])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, t array<string>, k int").repartition(3)
    stop = word_table(spark, ["z", "x", "z", None])
    found = remove_words(df, "t", stop, limit=limit).orderBy("k").collect()
    assert [r["t"] for r in found] == [["y", "Z"], ["y", "w"], ["y"], [], None, ["w", "w"]]
    assert [r["doc_id"] for r in found] == [i for i, _ in rows] and found[0].__fields__ == ["doc_id", "t", "k"]


def test_natures_to_drop(spark):
    dictionary = spark.createDataFrame([("老曹", "nr"), ("浇透", "v"), ("；", "w")], "word string, nature string")
    assert sorted(r[0] for r in stop_natures(dictionary).collect()) == sorted(["；", "老曹"])


def test_in_row_plan_has_no_shuffle(spark, tickets):
    segmented = segment(tickets, "orgtext", "tokens", GOLDEN_WORDS, "finest")
    plan = remove_words(segmented, "tokens", ["了"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_split_tokens_do_not_depend_on_partitions(spark, tickets):
    def tokens(df):
        return sorted((r["doc_id"], r["tokens"]) for r in segment(df, "orgtext", "tokens", GOLDEN_WORDS).collect())

    assert tokens(tickets.repartition(7)) == tokens(tickets.coalesce(1))


def test_hot_word_texts(spark):
    """One text of a single repeated word: linear work, exact result."""
    df = spark.createDataFrame([(1, "浇灌" * 30_000)], "doc_id long, t string")
    for mode in ("finest", "longest"):
        size = segment(df, "t", "tokens", ["浇灌", "灌浇"], mode).select(F.size("tokens")).first()[0]
        assert size == (59_999 if mode == "finest" else 30_000)


@pytest.mark.parametrize("mode", ["finest", "longest", "likeliest"])
def test_rows_of_any_ids_on_every_plan(spark, mode):
    """Repeated ids, null ids and gaps: each row has the tokens of its own text, the same on every plan."""
    rng = random.Random(9)
    texts = ["".join(rng.choices("滴灌管接头漏水k 4", k=rng.randrange(30))) for _ in range(40)] + ["滴灌管", "滴灌管", None]
    rows = [(rng.choice([None, 5, 5, 80, k]), t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, t string, k int").repartition(4)
    words, phrases = word_table(spark, GOLDEN_WORDS), word_table(spark, ["头漏", "4"])
    rules = spark.createDataFrame([("灌管", ["灌", "管"])], "phrase string, parts array<string>")
    want = None
    for plan in [*PLANS, *PHRASE_PLANS]:
        found = segment(df, "t", "tokens", words, mode, protected=phrases, rules=rules, **plan).orderBy("k").collect()
        assert [(r["doc_id"], r["t"], r["k"]) for r in found] == rows
        tokens = [r["tokens"] for r in found]
        want = want or tokens
        assert tokens == want, plan
    assert {"头漏", "灌"} <= {w for t in want for w in t}


def test_large_phrase_lists(spark):
    """A hundred thousand phrases and rules, as a table; against the phrases' own definition."""
    rng = random.Random(3)
    phrases = sorted({"".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(100_000)})
    rules = {p: [p[:1], p[1:]] for p in phrases[::3]}
    texts = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    rule_table = spark.createDataFrame(list(rules.items()), "phrase string, parts array<string>")
    listed, longest = set(phrases), max(map(len, phrases))

    def brute(text):
        out, i, run = [], 0, ""
        while i < len(text):
            n = next((n for n in range(longest, 0, -1) if text[i : i + n] in listed), 0)
            if run and (n or text[i] == " "):
                out, run = [*out, run], ""
            if n:
                out += rules.get(text[i : i + n], [text[i : i + n]])
            elif text[i] != " ":
                run += text[i]
            i += n or 1
        return out + [run] * bool(run)

    for held in (1 << 20, 0):
        found = segment(df, "t", "tokens", ["zzz"], "longest", protected=word_table(spark, phrases), rules=rule_table, held_rows=held).orderBy("k")
        assert [r["tokens"] for r in found.collect()] == [brute(t) for t in texts]


def test_trie_finds_all_phrases():
    rng = random.Random(4)
    for letters in ("ab", "abcd𠀀é"):
        phrases = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(40)})
        texts = ["".join(rng.choices(letters + "x", k=rng.randrange(40))) for _ in range(30)]
        codes, starts = lined_up(texts)
        place, length, number = Trie(phrases).find(codes)
        got = sorted(zip(place.tolist(), length.tolist(), [phrases[k] for k in number]))
        want = [(int(starts[k]) + i, len(p), p) for k, t in enumerate(texts) for p in phrases for i in range(len(t)) if t.startswith(p, i)]
        assert got == sorted(want)
    assert Trie([]).find(code_points("abc"))[0].size == 0


@pytest.mark.parametrize("head", [2, 24])
def test_filter_lets_every_word_through(head):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghij", k=rng.randrange(1, 9))) for _ in range(3000)})
    n = Bloom.size(2 * len(words), 1 << 20)
    blocks = np.zeros(n, np.uint64)
    np.bitwise_or.at(blocks, *Bloom.places(word_hashes(words + [w[:head] for w in words if len(w) > head]), n))
    bloom, lengths = Bloom(blocks), sorted({len(w) for w in words})
    texts = ["".join(rng.choices("abcdefghij", k=rng.randrange(200))) for _ in range(30)]
    codes, starts = lined_up(texts)
    found = {(int(p), size) for at, size in probable(codes, bloom, lengths, head) for p in at}
    listed = set(words)
    true = {(int(starts[k]) + i, size) for k, t in enumerate(texts) for i in range(len(t)) for size in lengths if t[i : i + size] in listed and i + size <= len(t)}
    assert true <= found
    others = ["".join(rng.choices("klmnopqrst", k=8)) for _ in range(20_000)]
    assert bloom.has(word_hashes(others)).mean() < 0.02
    assert bloom.has(word_hashes(words)).all()


def all_paths(text, kinds, scores, unknown):
    """Every way through the lattice: (sum, tokens)."""
    if not text:
        return [(0, [])]
    out = []
    for word, score in scores.items():
        if text.startswith(word):
            out += [(score + s, [(word, "word"), *rest]) for s, rest in all_paths(text[len(word) :], kinds, scores, unknown)]
    cost = 0 if kinds(text[0]) == "other" else unknown
    return out + [(cost + s, [(text[0], kinds(text[0])), *rest]) for s, rest in all_paths(text[1:], kinds, scores, unknown)]


def test_likeliest_path_is_the_best_of_all(spark):
    rng = random.Random(6)
    words = ["ab", "abc", "bcd", "cd", "水泵", "泵 a", "d"]
    texts = ["".join(rng.choices("abcd水泵 ", k=rng.randrange(1, 11))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    counts = {w: sum(t.startswith(w, i) for t in texts for i in range(len(t))) for w in words}
    whole = sum(counts.values()) + len(words) + 1
    scores, unknown = {w: round(math.log((n + 1) / whole) * 1e6) for w, n in counts.items()}, round(math.log(1 / whole) * 1e6)

    def kinds(c):
        return "run" if in_run(c) else "alone" if c.isalnum() else "other"

    def joined(path):
        out = []
        for token, kind in path:
            if kind == "run" and out and out[-1][1] == "run":
                out[-1] = (out[-1][0] + token, "run")
            else:
                out.append((token, kind))
        return [t for t, kind in out if kind != "other"]

    for held in (1000, 0):
        table, found_unknown = learn_scores(df, "t", word_table(spark, words), held)
        assert {r["word"]: (r["n"], r["score"]) for r in table.collect()} == {w: (counts[w], scores[w]) for w in words} and found_unknown == unknown
        for row in segment(df, "t", "tokens", words, "likeliest", held_rows=held).collect():
            paths = all_paths(row["t"], kinds, scores, unknown)
            best = max(s for s, _ in paths)
            # Of equal paths the one with a word, then the longer word, from the left.
            path = max((p for s, p in paths if s == best), key=lambda p: [(kind == "word", len(t) if kind == "word" else 0) for t, kind in p])
            assert row["tokens"] == joined(path), row["t"]


def test_many_words_outside_runs_are_held_by_the_workers(spark, tickets):
    """For all matches the one expression tries every place against every layer of such a list; same tokens as by definition."""
    words = GOLDEN_WORDS + [chr(0x4E00 + k) + " x" for k in range(200)]
    found = segment(tickets, "orgtext", "tokens", words, "finest")
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert all(r["tokens"] == brute_finest(r["orgtext"], words) for r in found.collect())
    for mode, listed in (("longest", words), ("finest", [f"w{k}" for k in range(200)])):
        assert "MapInArrow" not in segment(tickets, "orgtext", "tokens", listed, mode)._jdf.queryExecution().executedPlan().toString()


WORKER_MEMORY = """
import resource, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from ticketmill.operators.segment import segment
spark = (
    SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "1").getOrCreate()
)
df = spark.range(1500, numPartitions=1).select("id", F.expr("repeat('abcd ', 300)").alias("t"))
words = spark.createDataFrame([(w,) for w in ("ab", "a", "b", "c", "bc", "cd", "d")], "word string")
n = segment(df, "t", "tokens", words, "finest", limit=0, held_rows=int(sys.argv[3])).agg(F.sum(F.size("tokens"))).first()[0]
assert n == 1500 * 300 * 8, n

def peak(batches):
    for _ in batches:
        pass
    yield pa.record_batch([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], ["kb"])

print("peak", spark.range(1, numPartitions=1).mapInArrow(peak, "kb long").first()[0])
"""


@pytest.mark.parametrize("held", [1000, 0])
def test_workers_hold_the_tokens_of_a_slab_only(tmp_path, held):
    """Millions of tokens in one batch of rows."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", WORKER_MEMORY, root, str(tmp_path), str(held)], capture_output=True, text=True, timeout=600)
    assert "peak" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split("peak ")[1]) < 350_000, done.stdout


def test_a_word_leaves_its_block_once(spark):
    """However often a word stands in neighbouring texts, one row of it is joined with the list."""
    texts = spark.range(200, numPartitions=1).select((F.col("id") % 2).alias("_block"), F.lit("滴灌管 " * 50).alias("t")).orderBy("_block").coalesce(1)
    found = probable_words(texts, "t", word_table(spark, ["滴灌", "滴灌管"])).where("word in ('滴灌', '滴灌管')").collect()
    assert sorted((r["_block"], r["word"], r["n"]) for r in found) == [(b, w, 5000) for b in (0, 1) for w in ("滴灌", "滴灌管")]


def test_all_matches_of_a_slab_are_found_at_once(monkeypatch):
    """The texts of a slab share their steps: no token reaches over a text's end, and stretches of one length are put together first."""
    listed = ["ab", "abc", "b", "bé", "é", "\U00020000", "c\U00020000", "longerthanthehead"]
    texts = ["abcbé", "", "c\U00020000ab", "xlongerthanthehead longerthan", "é", "\0ab \0", "a", "b" * 40]
    kinds = np.zeros(0x110000, np.uint8)
    for char in {*"".join(texts)} - {" ", "\0"}:
        kinds[ord(char)] = spans.IN_RUN if char < "က" else spans.ALONE

    def brute(text):
        hits = [(i, i + len(w)) for w in listed for i in range(len(text)) if text.startswith(w, i)]
        runs = [m.span() for m in re.finditer("[a-zé]+", text)]
        alone = [(i, i + 1) for i, char in enumerate(text) if char == "\U00020000" and not any(a <= i < b for a, b in hits)]
        return [text[a:b] for a, b in sorted({*hits, *runs, *alone}, key=lambda s: (s[0], -s[1]))]

    calls = []
    work = spans.finest_spans
    monkeypatch.setattr(spans, "finest_spans", lambda *a: (calls.append(a), work(*a))[1])
    assert spans.finest_tokens(texts, tries.Trie(listed), kinds).to_pylist() == [brute(t) for t in texts]
    assert len(calls) == 1 and spans.finest_tokens([], tries.Trie(listed), kinds).to_pylist() == []
    codes, _ = tries.lined_up(texts)
    line = "\0".join(texts) + "\0"
    words = sorted(listed, key=len)
    bloom = tries.Bloom(np.full(512, 2**64 - 1, np.uint64))  # lets everything through
    for n in (1, 2, 5, 30):
        (at, _), *_ = tries.probable(codes, bloom, [n], 40)
        want = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        assert tries.Stretches(codes).counted(at, n) == want
    blocks = np.zeros(512, np.uint64)
    place, bits = tries.Bloom.places(tries.word_hashes(words + ["longer"]), 512)
    np.bitwise_or.at(blocks, place, bits)
    found = {line[p : p + n] for at, n in tries.probable(codes, tries.Bloom(blocks), sorted({len(w) for w in words}), 6) for p in at}
    assert {w for w in words if any(w in t for t in texts)} <= found
