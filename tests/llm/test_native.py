"""URL rules and decontamination against brute force, on small tables with odd rows."""

import hashlib
import random
import re

import pytest

from ticketmill.llm import decontaminate
from ticketmill.llm.queries import URL_RULES
from ticketmill.llm.url_filter import match_rules

URLS = [
    "https://a.example.org/en/12", "http://example.org/es/x?y#z", "HTTP://Example.ORG/es/", "x://org", "x://org/", "ftp://b.com/fr/", "ftp://b.com/fr",
    "ftp://xcom/de/1", "a://com/de/?q", "no scheme", "", None, "://", "a://b://c.org/", "s://h.org?p/es/", "s://..org/", "s://a.org:80/", "s://example.org/en/1",
    "s://example.org/en/2", "s://example.org/en/1" + "x" * 5000, "s://" + "a." * 500 + "com/de/", "s://bücher.org/é", "s://h\n.org/\n", "https://a.example.org/en/12",
]


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_urls(spark):
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "kept", "clash") for i, u in enumerate(URLS)], "page_id long, url string, other string, rule string").repartition(3)
    rows = match_rules(pages, rules).collect()
    assert len(rows) == len(URLS) and all(r.other == "kept" for r in rows)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute_url(r.url), r.url


def test_rule_order_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "s://a.b.c/x/y")], "page_id long, url string")
    rules = [("c", "/x/y", "allow"), ("b.c", "/x/", "block"), ("b.c", "/x/", "allow"), ("a.b.c", "", "allow")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert tuple(match_rules(pages, table).first())[4:] == ("b.c/x/", "block")
    assert match_rules(pages, table.limit(0), default="block").first().verdict == "block"
    assert match_rules(pages.limit(0), table).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_contamination(text, items):
    words, hit, named = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        places = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in windows]
        hit |= {k for i in places for k in range(i, i + n)}
        if places and item_id is not None:
            named.add(str(item_id))
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Cc", "dé", "É", "x1", "the", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ". ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for i in range(12)] + [(50, None), (None, text(20)), (3, text(15))]
    docs = [(i, text(rng.choice([0, 1, 13, 40, 200]))) for i in range(30)]
    docs += [(100 + i, text(20) + t + text(200)) for i, t in items if t and i is not None]
    docs += [(None, items[0][1]), (7, None), (7, None), docs[3], docs[3], (8, "word " * 30_000 + (items[6][1] or ""))]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, w string").repartition(5)
    found = decontaminate.find_contamination(table, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert got == sorted((str(i), *brute_contamination(t, items)) for i, t in docs)


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four " * 10, 5), (2, "five six seven eight nine " * 3, 6), (2, None, 7)], "doc_id long, text string, th int")
    items = spark.createDataFrame([(9, "six seven eight nine five six seven eight nine five six seven eight"), (8, "absent")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.th) for r in kept.collect()) == [(1, 5), (2, 7)]
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 3
    assert decontaminate.drop_contaminated(docs.limit(0), items).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
