"""Class filter, numbering, splits, indices, profile."""

import pytest
from conftest import TICKETS, WORDS
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ticketmill import PrepConfig, prepare, profile
from ticketmill.functions.tokens import first_positions, token_counts, whitespace_tokens
from ticketmill.operators import corpus, labels
from ticketmill.operators.numbering import number_rows
from ticketmill.plans.lexicon import Lexicon, make_lexicon
from ticketmill.session import fits_broadcast, join_lookup


def test_numbers_follow_the_order_over_many_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(13)
    rows = number_rows(df, [F.col("k").desc()], "n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: -r["k"])] == list(range(1, 1001))


def test_numbers_with_a_third_of_rows_on_one_value(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    rows = number_rows(df.repartition(5), [F.col("k"), F.col("id")], "n", start=0).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: (r["k"], r["id"]))] == list(range(900))


@pytest.mark.parametrize("max_rows", [100, 0])
def test_singleton_classes_go_on_both_plans(spark, max_rows):
    """Repeated and null ids change nothing: rows stay or go by their class alone."""
    rows = [(i, "hot") for i in range(40)] + [(100, "one"), (101, "two"), (102, "two"), (103, None), (100, "hot"), (None, "two"), (None, "three")]
    df = spark.createDataFrame(rows, "doc_id long, group string").repartition(5)
    kept = corpus.drop_singleton_classes(df, "group", "doc_id", max_rows)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [*range(40), 101, 102, 100, None]))


def test_numbers_with_and_without_gaps_in_the_ids(spark):
    rows = [(i, "a" if i % 2 else "b", "t") for i in range(30)]
    for ids in (lambda i: i, lambda i: i + 7, lambda i: 3 * i, lambda i: i * i):
        df = spark.createDataFrame([(ids(i), g, t) for i, g, t in rows], "doc_id long, group string, t string").repartition(4)
        split = corpus.with_parts(df, "doc_id", "group", 4).orderBy("doc_id").collect()
        assert [r["row_num"] for r in split] == list(range(1, 31))
        assert [r["part"] == "test" for r in split] == [n % 4 == 0 for n in range(1, 31)]


def test_parts_of_repeated_null_and_missing_ids(spark):
    """Every row is numbered once, whatever its id; the rows of dense ids get the same numbers on either way."""
    ids = [4, None, 4, 9, 1, None, 9, 30, 4]
    df = spark.createDataFrame([(i, "g", f"t{k}") for k, i in enumerate(ids)], "doc_id long, group string, t string").repartition(3)
    rows = corpus.with_parts(df, "doc_id", "group", 4).collect()
    assert sorted(r["t"] for r in rows) == [f"t{k}" for k in range(9)]
    by_number = sorted(rows, key=lambda r: r["row_num"])
    assert [r["row_num"] for r in by_number] == list(range(1, 10))
    assert [r["doc_id"] for r in by_number] == [1, 4, 4, 4, 9, 9, 30, None, None]
    assert [r["part"] == "test" for r in by_number] == [n % 4 == 0 for n in range(1, 10)]


def test_dropped_rows_use_up_numbers(spark, tickets):
    rows = corpus.modulo_split(tickets, "doc_id", "group", 5).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert [r["doc_id"] for r in rows if r["part"] == "test"] == [5, 10]


@pytest.mark.parametrize("max_rows", [100, 0])
def test_lookup_joins_agree_with_and_without_broadcast(spark, tickets, max_rows):
    index = labels.label_index(tickets, "group", "j")
    lookup = index.select("group", "label")
    assert fits_broadcast(lookup, 4) and not fits_broadcast(lookup, 3) and not fits_broadcast(lookup, 4, 10)
    joined = join_lookup(tickets, lookup, "group", "left", max_rows)
    assert joined.where("label = 0").count() == 4


def test_label_index_is_the_order_of_string_indexer(spark, tickets):
    names = StringIndexer(inputCol="group", outputCol="l").fit(tickets).labels
    rows = labels.label_index(tickets, "group", "j").orderBy("label").collect()
    assert [r["group"] for r in rows] == list(names)
    assert [r["label"] for r in rows] == [float(i) for i in range(len(names))]
    categories = spark.createDataFrame([(c,) for c in "abcaac0"], "group string")
    assert [r["group"] for r in labels.label_index(categories, "group", "j").orderBy("label").collect()] == [
        "a", "c", "0", "b",
    ]


def test_encode_and_decode_are_inverse(spark, tickets):
    index = labels.label_index(tickets, "group", "j")
    back = labels.decode(labels.encode(tickets, index, "group"), index, "label", "name")
    assert back.where("name = group").count() == len(TICKETS)
    unknown = spark.createDataFrame([("x",)], "group string")
    assert labels.encode(unknown, index, "group").first()["label"] is None


def test_hash_split_depends_on_the_key_alone(spark):
    def part(df):
        return {r["id"]: r["part"] for r in corpus.hash_split(df, "id", 0.7).collect()}

    df = spark.range(500)
    parts = part(df.repartition(9))
    assert parts == part(df.coalesce(1))
    assert 300 < sum(p == "train" for p in parts.values()) < 400
    with pytest.raises(ValueError):
        corpus.hash_split(df, "id", 1.0)


def test_in_row_counts_and_positions(spark):
    df = spark.createDataFrame([(1, "b a  b\nC c"), (2, ""), (3, "  ")], "id long, t string")
    tokens = whitespace_tokens(F.col("t"))
    rows = df.select("id", token_counts(tokens).alias("c"), first_positions(tokens).alias("f")).orderBy("id").collect()
    assert [(e["word"], e["n"]) for e in rows[0]["c"]] == [("a", 1), ("b", 2), ("c", 2)]
    assert [(e["word"], e["pos"]) for e in rows[0]["f"]] == [("a", 1), ("b", 0), ("c", 3)]
    assert rows[1]["c"] == rows[2]["c"] == rows[1]["f"] == []
    marks = spark.createDataFrame([("-- a, ... ,b +=! 。c。 " + "-" * 50_000,)], "t string")
    assert marks.select(whitespace_tokens(F.col("t"), keep_punctuation=False)).first()[0] == ["a,", ",b", "。c。"]


def test_vocabulary_and_documents_by_first_occurrence(spark):
    df = spark.createDataFrame([(5, "b a b"), (7, "a c"), (9, "B A b")], "doc_id long, t string").repartition(3)
    tokens = whitespace_tokens(F.col("t"))
    words = {r["word"]: r["idx"] for r in corpus.vocab_index(df, "doc_id", tokens).collect()}
    assert words == {"b": 0, "a": 1, "c": 2}
    docs = {r["doc_id"]: r["idx"] for r in corpus.distinct_doc_index(df, "doc_id", tokens).collect()}
    assert docs == {5: 0, 7: 1}


def test_prepare_splits_kept_rows_once(spark, tickets):
    config = PrepConfig(mod=5, mode="longest")
    lexicon = make_lexicon(WORDS, ["了"], ["管接头"])
    for df in (tickets, tickets.repartition(6)):
        train, test = prepare(df, lexicon, config)
        assert sorted(r["doc_id"] for r in train.collect()) == [1, 2, 3, 4, 6, 8, 9, 11]
        assert sorted(r["doc_id"] for r in test.collect()) == [5, 10]
        assert train.columns == ["doc_id", "group", "text", "orgtext"]
        assert train.where("doc_id = 6").first()["text"] == "滴灌 管接头 漏水 换 过 两 回 照 样 漏"
        assert not any("了" in r["text"].split(" ") for r in train.union(test).collect())


def test_prepare_drops_words_by_nature(spark, tickets):
    natures = {"番茄": "nr", "箱": "q"}
    dictionary = spark.createDataFrame([("，", "w"), *((w, natures.get(w)) for w in WORDS)], "word string, nature string")
    config = PrepConfig(mod=100, mode="longest", keep_punctuation=True)
    rules = spark.createDataFrame([("草莓箱", [("草莓", "n"), ("箱", "nr")]), ("黄瓜藤", [("黄瓜", None)])], "phrase string, parts array<struct<word:string,nature:string>>")
    for stop in (["了"], spark.createDataFrame([("了",)], "word string")):
        train, _ = prepare(tickets, make_lexicon(dictionary, stop, rules=rules), config)
        texts = {r["doc_id"]: r["text"].split(" ") for r in train.collect()}
        assert texts[11] == ["草莓", "少", "贴", "标签"] and texts[5][:2] == ["黄瓜", "上"] and texts[4][-1] == "箱"
        assert not {w for t in texts.values() for w in t} & {"番茄", "，", "了", "草莓箱"}


def test_prepare_counts_unusable_rows(spark):
    from ticketmill.plans.prepare import dropped_rows

    df = spark.createDataFrame(
        [(1, "a", "x"), (2, None, "x"), (3, "a", None), (4, "a", "y")], "doc_id long, group string, orgtext string"
    )
    train, test = prepare(df, Lexicon(), PrepConfig(mod=4))
    assert [r["doc_id"] for r in train.collect()] == [1] and [r["doc_id"] for r in test.collect()] == [4]
    counts = dropped_rows(df, PrepConfig()).first()
    assert (counts["n_rows"], counts["n_without_group"], counts["n_without_text"]) == (4, 1, 1)


def test_profile_counts(spark, tickets):
    result = profile(tickets, Lexicon(WORDS), PrepConfig(mode="longest"))
    counts = {r["kind"]: r for r in result["counts"].collect()}
    assert (counts["class"]["n_distinct"], counts["class"]["n_repeated"], counts["class"]["n_rows"]) == (4, 3, 11)
    assert counts["class"]["n_chars"] == sum(len(g) + len(t) for g, t in TICKETS)
    assert counts["word"]["n_distinct"] == result["vocabulary"].count()
    assert counts["text"]["n_distinct"] == result["documents"].count() == 11
    assert {r["group"] for r in result["classes"].collect()} == {"浇水", "虫害", "采收"}
