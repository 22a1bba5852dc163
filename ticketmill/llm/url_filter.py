"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

Every URL is expanded into the expressions a rule could have (each host suffix with as many labels as some rule's
host, with each path prefix as long as some rule's path). A short prefix of the expression's SHA-256 is the key of
an equi-join with the rules; full digests confirm it, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketmill.session import join_lookup

#: Hexadecimal digits of the digest that are joined: 32 bits, as in published hash-prefix lists.
PREFIX_DIGITS = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and ``path``
    (from there up to ``?``, ``#`` or the end). Null or no ``://``: both are empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), pattern, i), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def _expression(host, path):
    # A host holds no "/", and a path is empty or starts with one: the join of both is unambiguous.
    return F.concat(host, path)


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules``: (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's;
    the longest expression wins, then the longer host, then ``block`` over ``allow``. Without a rule, ``rule`` is
    null and the verdict is ``default``. Rows are kept as they are: repeated pages, null and malformed URLs and clashing columns
    other than the four added (which are replaced) pass through. An empty rule table leaves every page at the default; rules without
    host or path as null are ignored.

    Distinct (host, path) pairs are matched once, so a hot host or a page repeated many times costs one row.
    """
    urls = split_url(pages.drop("rule", "verdict", "host", "path"), url)
    digest = F.sha2(_expression(F.col("rule_host"), F.col("rule_path")), 256)
    listed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # "block" sorts after "allow"
        .withColumns({"digest": digest, "key": F.substring(digest, 1, PREFIX_DIGITS)})
    )
    # Which expressions can match at all: numbers of labels and lengths of paths among the rules. Both sets are
    # bounded by the longest host and path of a rule, not by the number of rules or pages.
    shapes = listed.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths")
    ).first()
    labels, lengths = sorted(shapes.labels), sorted(shapes.lengths)
    distinct = urls.select("host", "path").distinct()
    if not labels:
        matched = distinct.limit(0).select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    else:
        n_labels = F.size(F.split("host", r"\."))
        suffixes = F.array_compact(F.array(*[F.when(n_labels >= k, F.substring_index("host", ".", -k)) for k in labels]))
        prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]))
        expanded = (
            distinct.filter("host != ''")
            .withColumn("suffix", F.explode(suffixes))
            .withColumn("prefix", F.explode(prefixes))
            .withColumn("url_digest", F.sha2(_expression(F.col("suffix"), F.col("prefix")), 256))
            .withColumn("key", F.substring("url_digest", 1, PREFIX_DIGITS))
        )
        confirmed = join_lookup(expanded, listed, "key", "inner").filter(F.col("digest") == F.col("url_digest"))
        rank = F.struct(
            F.length(_expression(F.col("rule_host"), F.col("rule_path"))).alias("n"),
            F.length("rule_host").alias("h"),
            F.col("rule_verdict").alias("verdict"),
            _expression(F.col("rule_host"), F.col("rule_path")).alias("rule"),
        )
        matched = (
            confirmed.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
        )
    kept = [c for c in urls.columns if c not in ("host", "path")]
    return urls.join(matched, ["host", "path"], "left").select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
