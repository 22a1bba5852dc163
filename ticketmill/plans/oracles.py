"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from ticketmill.plans.fixed import JOB, MOD, NATURES, PROTECTED, RULES, STOP_WORDS, WORDS


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _longest_first(words) -> str:
    escaped = {w: "".join(f"\\{c}" if c in ".|,*+?()[]" else c for c in w) for w in words}
    return "|".join(escaped[w] for w in sorted(words, key=lambda w: (-len(w), w)))


RUN = r"[\p{Latin}\p{M}0-9]"
LETTER = r"[\p{L}\p{N}]"
TOKEN = f"{_longest_first(WORDS)}|{RUN}+|{LETTER}"
MARK = "chr(1)"
DROPPED = [w for w, nature in NATURES if nature in ("w", "nr")]
BUCKET = "('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % 10"

TOKENS = r"SELECT doc_id, lang, source, text, regexp_extract_all(lower(text), '\S+') AS tokens FROM documents"


def _around(phrases, whole: str) -> str:
    """Token list of a text cut at phrases: even parts are phrases."""
    return f"""
    SELECT doc_id, flatten(list_transform(
        string_split(regexp_replace(replace(lower(text), {MARK}, ' '), '({_longest_first(phrases)})',
                                    {MARK} || '\\1' || {MARK}, 'g'), {MARK}),
        lambda p, i: CASE WHEN i % 2 = 0 THEN {whole} ELSE regexp_extract_all(p, '{TOKEN}') END)) AS tokens
    FROM documents"""


def _joined(tokens_sql: str) -> str:
    return f"""
    SELECT doc_id, len(tokens) AS n_tokens, coalesce(array_to_string(tokens, ' '), '') AS text
    FROM ({tokens_sql})"""


_RULE_PARTS = "CASE " + " ".join(f"WHEN p = '{k}' THEN [{_list(v)}]" for k, v in RULES.items()) + " ELSE [p] END"

# Every dictionary word at every position, runs of Latin letters and digits, and uncovered letters.
_LITERAL_WORDS = f"SELECT unnest([{_list(WORDS)}]) AS word"
_LETTER_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}]+ [\p{L}]+')) AS word FROM benchmark"
_TABLE_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{RUN}+')) AS word FROM benchmark"


def _spans(words: str) -> str:
    return f"""
    words AS ({words}),
    chars AS (
        SELECT doc_id, unnest(list) AS c, generate_subscripts(list, 1) AS pos
        FROM (SELECT doc_id, string_split(lower(text), '') AS list FROM documents)),
    ahead AS (
        SELECT *, regexp_matches(c, '{RUN}') AS in_run,
               string_agg(c, '') OVER (PARTITION BY doc_id ORDER BY pos
                                       ROWS BETWEEN CURRENT ROW AND far FOLLOWING) AS win
        FROM chars, (SELECT max(length(word)) - 1 AS far FROM words)),
    hits AS (
        SELECT doc_id, pos, length(word) AS len, word AS tok
        FROM ahead JOIN words ON win[1] = word[1] AND starts_with(win, word)),
    islands AS (
        SELECT *, sum(CASE WHEN in_run THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM ahead),
    runs AS (
        SELECT doc_id, min(pos) AS pos, count(*) AS len, string_agg(c, '' ORDER BY pos) AS tok
        FROM islands WHERE in_run GROUP BY doc_id, g),
    covered AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + len - 1)) AS pos FROM hits),
    alone AS (
        SELECT doc_id, pos, 1 AS len, c AS tok FROM ahead ANTI JOIN covered USING (doc_id, pos)
        WHERE NOT in_run AND regexp_matches(c, '{LETTER}')),
    spans AS (FROM hits UNION FROM runs UNION FROM alone)"""


def _all_matches(words: str) -> str:
    return f"""
    WITH {_spans(words)}
    SELECT doc_id, count(tok) AS n_tokens, coalesce(string_agg(tok, ' ' ORDER BY pos, -len), '') AS text
    FROM documents LEFT JOIN (SELECT doc_id, pos, len, tok FROM spans) USING (doc_id) GROUP BY doc_id"""


_TABLE_LONGEST = f"""
            SELECT doc_id, regexp_extract_all(lower(text), p.pattern) AS tokens
            FROM documents, (SELECT string_agg(word, '|' ORDER BY length(word) DESC, word) || '|{RUN}+|{LETTER}'
                                    AS pattern FROM ({_TABLE_WORDS})) p"""

_PHRASES_KEPT = f"""
            SELECT doc_id, flatten(list_transform(
                string_split(regexp_replace(replace(lower(text), {MARK}, ' '), p.pattern, {MARK} || '\\1' || {MARK}, 'g'), {MARK}),
                lambda part, i: CASE WHEN i % 2 = 0 THEN [part] ELSE regexp_extract_all(part, '{TOKEN}') END)) AS tokens
            FROM documents, (SELECT '(' || string_agg(word, '|' ORDER BY length(word) DESC, word) || ')' AS pattern
                             FROM ({_LETTER_WORDS})) p"""

# The likeliest path: words stand inside runs, so that each different run is looked at once, from its end; then its tokens from its start.
_BEST_PATH = f"""
    WITH RECURSIVE words AS ({_TABLE_WORDS}),
    pieces AS (
        SELECT doc_id, unnest(list) AS run, generate_subscripts(list, 1) AS k
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '{RUN}+|{LETTER}') AS list FROM documents)),
    runs AS (SELECT run, count(*) AS times FROM pieces GROUP BY run),
    places AS (SELECT run, times, unnest(range(0, length(run))) AS i FROM runs),
    hits AS (
        SELECT run, times, i, len, word
        FROM (SELECT *, substr(run, i + 1, len) AS cut FROM places, (SELECT DISTINCT length(word) AS len FROM words)
              WHERE i + len <= length(run)) JOIN words ON cut = word),
    counts AS (SELECT word, coalesce(sum(times), 0) AS n FROM words LEFT JOIN hits USING (word) GROUP BY word),
    whole AS (SELECT (sum(n) + count(*) + 1)::DOUBLE AS z FROM counts),
    edges AS (
        SELECT run, i, len, true AS is_word, round(ln((n + 1) / z) * 1e6)::BIGINT AS s FROM hits JOIN counts USING (word), whole
        UNION ALL SELECT run, i, 1, false, round(ln(1 / z) * 1e6)::BIGINT FROM places, whole),
    dp AS (
        SELECT run, length(run) AS i, [0::BIGINT] AS best, []::BIGINT[] AS size FROM runs
        UNION ALL
        SELECT run, i, list_prepend(top.total, best), list_prepend(CASE WHEN top.is_word THEN top.len ELSE 0 END, size)
        FROM (SELECT d.run, d.i - 1 AS i, d.best, d.size, max({{'total': e.s + d.best[e.len], 'is_word': e.is_word, 'len': e.len}}) AS top
              FROM dp d JOIN edges e ON e.run = d.run AND e.i = d.i - 1 GROUP BY d.run, d.i, d.best, d.size)),
    walk AS (
        SELECT run, 0::BIGINT AS i, '' AS open, []::VARCHAR[] AS done, size FROM dp WHERE i = 0
        UNION ALL
        SELECT run, i + greatest(size[i + 1], 1), CASE WHEN size[i + 1] = 0 THEN open || substr(run, i + 1, 1) ELSE '' END,
               CASE WHEN size[i + 1] = 0 THEN done
                    ELSE list_append(CASE WHEN open <> '' THEN list_append(done, open) ELSE done END, substr(run, i + 1, size[i + 1])) END, size
        FROM walk WHERE i < length(run)),
    cut AS (SELECT run, CASE WHEN open <> '' THEN list_append(done, open) ELSE done END AS tokens FROM walk WHERE i = length(run)),
    listed AS (SELECT doc_id, flatten(list(tokens ORDER BY k)) AS tokens FROM pieces JOIN cut USING (run) GROUP BY doc_id)
    SELECT doc_id, coalesce(len(tokens), 0) AS n_tokens, coalesce(array_to_string(tokens, ' '), '') AS text
    FROM documents LEFT JOIN listed USING (doc_id)"""

_PREPARED = f"""
            WITH {_spans(_LITERAL_WORDS)}
            SELECT doc_id, any_value(lang) AS "group",
                   coalesce(string_agg(tok, ' ' ORDER BY pos, -len), '') AS text, any_value(text) AS orgtext
            FROM documents
            LEFT JOIN (SELECT doc_id, pos, len, tok FROM spans WHERE tok NOT IN ({_list(STOP_WORDS)})) USING (doc_id)
            GROUP BY doc_id"""

# Labels by the order of the classes in the training part.
_TRAINED = f"""
    prepared AS ({_PREPARED}),
    parted AS (SELECT *, {BUCKET.format(key="doc_id")} < 8 AS training FROM prepared),
    labels_of AS (
        SELECT "group", (row_number() OVER (ORDER BY count(*) DESC, "group") - 1)::DOUBLE AS label
        FROM parted WHERE training AND "group" IS NOT NULL GROUP BY "group")"""

# MurmurHash3 (32 bits, seed 42) of a word's UTF-8 bytes, step by step on lists of 4-byte blocks.
_MASK = "4294967295::UBIGINT"


def _mixed(blocks: str) -> str:
    """Blocks times the first constant, rotated by 15 bits, times the second."""
    step = f"list_transform({blocks}, lambda k: (k * 3432918353::UBIGINT) & {_MASK})"
    step = f"list_transform({step}, lambda k: ((k << 15) | (k >> 17)) & {_MASK})"
    return f"list_transform({step}, lambda k: (k * 461845907::UBIGINT) & {_MASK})"


def _bytes(first: str, n: str) -> str:
    """The number in ``n`` bytes of the hexadecimal string ``h`` from byte ``first`` on, lowest byte first."""
    digits = " || ".join(f"CASE WHEN {n} > {i} THEN substr(h, 2 * ({first}) + {2 * i + 1}, 2) ELSE '' END" for i in (3, 2, 1, 0))
    return f"('0x' || CASE WHEN {n} = 0 THEN '0' ELSE {digits} END)::UBIGINT"


_BUCKETS = f"""
    words AS (SELECT word, hex(encode(word)) AS h, (strlen(word))::BIGINT AS len FROM (SELECT DISTINCT word FROM tokens)),
    bodies AS (
        SELECT word, len, list_reduce(
            list_concat([42::UBIGINT], {_mixed("list_transform(range(0, len // 4), lambda i: " + _bytes("4 * i", "4") + ")")}),
            lambda a, k: ((((xor(a, k) << 13) | (xor(a, k) >> 19)) & {_MASK}) * 5 + 3864292196::UBIGINT) & {_MASK}) AS body,
            {_mixed("[" + _bytes("len - len % 4", "(len % 4)") + "]")}[1] AS tail
        FROM words),
    f0 AS (SELECT word, xor(xor(body, tail), len::UBIGINT) AS x FROM bodies),
    f1 AS (SELECT word, (xor(x, x >> 16) * 2246822507::UBIGINT) & {_MASK} AS x FROM f0),
    f2 AS (SELECT word, (xor(x, x >> 13) * 3266489909::UBIGINT) & {_MASK} AS x FROM f1),
    f3 AS (SELECT word, xor(x, x >> 16)::BIGINT AS x FROM f2),
    hashed AS (
        SELECT word, ((CASE WHEN x >= 2147483648 THEN x - 4294967296 ELSE x END) % 6900 + 6900) % 6900 AS bucket FROM f3)"""

_INDEX = """
    SELECT {column} AS "group", count(*) AS n,
           (row_number() OVER (ORDER BY count(*) DESC, {column}) - 1)::DOUBLE AS label
    FROM documents WHERE {column} IS NOT NULL GROUP BY {column}"""

_JUDGED = "SELECT quality::DOUBLE AS label, toxic::DOUBLE AS prediction FROM labels"


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize": f"""
            SELECT doc_id, len(tokens) AS n_tokens, coalesce(array_to_string(tokens, ' '), '') AS text
            FROM ({TOKENS})""",
        "term_frequency": f"""
            SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS word FROM ({TOKENS}))
            GROUP BY ALL""",
        "tf_total": f"SELECT doc_id, len(tokens)::DOUBLE AS total FROM ({TOKENS})",
        "stopword_removal": f"""
            SELECT doc_id, len(kept) AS n_tokens, coalesce(array_to_string(kept, ' '), '') AS text
            FROM (SELECT doc_id, list_filter(tokens, lambda t: t NOT IN ({_list(STOP_WORDS)})) AS kept
                  FROM ({TOKENS}))""",
        "stopword_table_removal": f"""
            WITH t AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM ({TOKENS})),
            stop AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM benchmark),
            kept AS (SELECT * FROM t ANTI JOIN stop USING (word))
            SELECT doc_id, count(word) AS n_tokens, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS text
            FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY doc_id""",
        "drop_by_nature": f"""
            SELECT doc_id, len(kept) AS n_tokens, coalesce(array_to_string(kept, ' '), '') AS text
            FROM (SELECT doc_id, list_filter(tokens, lambda t:
                      t NOT IN ({_list(DROPPED)})
                      AND NOT regexp_full_match(t, '[\\p{{P}}\\p{{S}}]+')) AS kept
                  FROM ({TOKENS}))""",
        "segment_max_match": _joined(
            f"SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS tokens FROM documents"
        ),
        "segment_protected": _joined(_around(PROTECTED, "[p]")),
        "segment_ambiguity": _joined(_around([*PROTECTED, *RULES], _RULE_PARTS)),
        "segment_phrase_table": _joined(_PHRASES_KEPT),
        "segment_best_path": _BEST_PATH,
        "segment_all_matches": _all_matches(_LITERAL_WORDS),
        "segment_all_matches_join": _all_matches(_TABLE_WORDS),
        "segment_max_match_join": _joined(_TABLE_LONGEST),
        "segment_max_match_shuffled": _joined(_TABLE_LONGEST),
        "segment_all_matches_shuffled": _all_matches(_TABLE_WORDS),
        "segment_all_matches_any": _all_matches(_LETTER_WORDS),
        "prepare_text": _PREPARED,
        "prepare_split": f"""
            WITH numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS row_num FROM documents),
            cut AS (
                SELECT *, list_filter(
                    regexp_extract_all(lower(text), '{_longest_first([*WORDS, *[w for w, _ in NATURES]])}|{RUN}+|{LETTER}'),
                    lambda t: t NOT IN ({_list([*STOP_WORDS, *DROPPED])})) AS kept
                FROM numbered
                WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 1) AND text IS NOT NULL)
            SELECT doc_id, source AS "group", coalesce(array_to_string(kept, ' '), '') AS text,
                   CASE WHEN row_num % {MOD} = 0 THEN 'test' ELSE 'train' END AS part
            FROM cut""",
        "hashing_tf": f"""
            WITH tokens AS (SELECT doc_id, unnest(tokens) AS word FROM ({TOKENS})), {_BUCKETS}
            SELECT doc_id, bucket::INTEGER AS bucket, count(*)::DOUBLE AS tf
            FROM tokens JOIN hashed USING (word) GROUP BY ALL""",
        "feature_words": f"""
            WITH tokens AS (SELECT doc_id, unnest(tokens) AS word FROM ({TOKENS})), {_BUCKETS},
            n AS (SELECT bucket::INTEGER AS feature, word, count(*) AS n FROM tokens JOIN hashed USING (word) GROUP BY ALL),
            ranked AS (
                SELECT *, n / sum(n) OVER (PARTITION BY feature) AS share,
                       row_number() OVER (PARTITION BY feature ORDER BY n DESC, word)::INTEGER AS place FROM n)
            SELECT feature, place, word, n, share FROM ranked WHERE place <= 3""",
        "evaluated_rows": f"""
            WITH {_TRAINED}
            SELECT "group", text, orgtext, label, '{JOB}' AS job_id FROM parted JOIN labels_of USING ("group")
            WHERE NOT training""",
        "score_job": f"""
            WITH {_TRAINED}
            SELECT '{JOB}' AS job_id, text, orgtext, label FROM parted JOIN labels_of USING ("group")""",
        "stream_rows": f"SELECT doc_id, '{JOB}' AS job_id, text, orgtext FROM ({_PREPARED})",
        "model_roundtrip": f"""
            SELECT true AS same, count(*) AS n FROM documents WHERE {BUCKET.format(key="doc_id")} >= 8""",
        "numeric_labels": f"""
            WITH i AS (
                SELECT name, (row_number() OVER (ORDER BY k DESC, name) - 1)::DOUBLE AS n
                FROM (SELECT label::VARCHAR AS name, count(*) AS k FROM embeddings GROUP BY label))
            SELECT vec_id, name AS label, n AS indexed_label FROM embeddings e JOIN i ON e.label::VARCHAR = i.name
            WHERE {BUCKET.format(key="vec_id")} >= 8""",
        "label_index": f"""
            SELECT 'lang' AS field, '{JOB}' AS job_id, label, "group", n FROM ({_INDEX.format(column="lang")})
            UNION ALL
            SELECT 'source', '{JOB}', label, "group", n FROM ({_INDEX.format(column="source")})""",
        "label_decode": f"""
            SELECT doc_id, label, i."group" AS decoded
            FROM documents d JOIN ({_INDEX.format(column="source")}) i ON d.source = i."group" """,
        "class_profile": "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1",
        "corpus_profile": f"""
            WITH t AS ({TOKENS}),
            items AS (
                SELECT 'class' AS kind, source AS value, length(source) + length(text) AS chars FROM t
                UNION ALL
                SELECT 'text', array_to_string(tokens, ' '), length(coalesce(array_to_string(tokens, ' '), ''))
                FROM t
                UNION ALL
                SELECT 'word', word, length(word) FROM (SELECT unnest(list_distinct(tokens)) AS word FROM t)),
            per_value AS (SELECT kind, value, count(*) AS n, sum(chars) AS chars FROM items GROUP BY ALL)
            SELECT kind, count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated, sum(n)::BIGINT AS n_rows,
                   sum(chars)::BIGINT AS n_chars
            FROM per_value GROUP BY kind""",
        "corpus_profile_sketched": f"""
            WITH t AS ({TOKENS}),
            items AS (
                SELECT 'class' AS kind, source AS value, length(source) + length(text) AS chars FROM t
                UNION ALL
                SELECT 'text', array_to_string(tokens, ' '), length(coalesce(array_to_string(tokens, ' '), ''))
                FROM t
                UNION ALL
                SELECT 'word', word, length(word) FROM (SELECT unnest(list_distinct(tokens)) AS word FROM t)),
            per_value AS (SELECT kind, value, count(*) AS n, sum(chars) AS chars FROM items GROUP BY ALL)
            SELECT kind, sum(n)::BIGINT AS n_rows, sum(chars)::BIGINT AS n_chars, true AS is_close
            FROM per_value GROUP BY kind""",
        "quoted_records": """
            SELECT row_number() OVER (ORDER BY doc_id) AS row_num, coalesce(lang, '') AS "group", coalesce(text, '') AS orgtext
            FROM documents""",
        "drop_singleton_classes": """
            SELECT doc_id, n_chars FROM documents
            WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) > 1)""",
        "modulo_split": f"""
            WITH numbered AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS row_num FROM documents)
            SELECT doc_id, n_chars, row_num, CASE WHEN row_num % {MOD} = 0 THEN 'test' ELSE 'train' END AS part
            FROM numbered
            WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) > 1)""",
        "hash_split": """
            WITH b AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS bucket
                       FROM documents)
            SELECT doc_id, bucket, CASE WHEN bucket < 8 THEN 'train' ELSE 'test' END AS part FROM b""",
        "vocab_index": f"""
            WITH w AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM ({TOKENS})),
            f AS (SELECT word, min((doc_id, pos)) AS place FROM w GROUP BY word)
            SELECT word, row_number() OVER (ORDER BY place) - 1 AS idx FROM f""",
        "vocab_index_grown": f"""
            WITH w AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM ({TOKENS})),
            f AS (SELECT word, min((doc_id, pos)) AS place FROM w GROUP BY word)
            SELECT word, row_number() OVER (ORDER BY place) - 1 AS idx FROM f""",
        "distinct_doc_index": f"""
            WITH f AS (SELECT min(doc_id) AS doc_id FROM ({TOKENS}) GROUP BY tokens)
            SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM f""",
        "eval_accuracy": f"""
            SELECT count(*) AS n, count(*) FILTER (label = prediction) AS n_correct,
                   avg((label = prediction)::INT) AS accuracy FROM ({_JUDGED})""",
        "test_error": f"""
            SELECT count(*) AS n, count(*) FILTER (label <> prediction) AS n_wrong,
                   avg((label <> prediction)::INT) AS test_error FROM ({_JUDGED})""",
        "misclassified": """
            SELECT doc_id, quality::DOUBLE AS label, toxic::DOUBLE AS prediction FROM labels
            WHERE quality <> toxic""",
        "eval_confusion": f"SELECT label, prediction, count(*) AS n FROM ({_JUDGED}) GROUP BY ALL",
        "eval_per_class": f"""
            WITH j AS ({_JUDGED}),
            a AS (SELECT label AS class, count(*) AS n FROM j GROUP BY ALL),
            p AS (SELECT prediction AS class, count(*) AS n FROM j GROUP BY ALL),
            c AS (SELECT label AS class, count(*) AS n FROM j WHERE label = prediction GROUP BY ALL),
            s AS (SELECT class, coalesce(a.n, 0) AS n_actual, coalesce(p.n, 0) AS n_predicted,
                         coalesce(c.n, 0) AS n_correct
                  FROM a FULL JOIN p USING (class) LEFT JOIN c USING (class))
            SELECT *, CASE WHEN n_predicted > 0 THEN n_correct / n_predicted ELSE 0.0 END::DOUBLE AS precision,
                   CASE WHEN n_actual > 0 THEN n_correct / n_actual ELSE 0.0 END::DOUBLE AS recall,
                   2 * n_correct / (n_actual + n_predicted) AS f1
            FROM s""",
        "closed_windows": """
            SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
            WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
        "windowed_counts": """
            SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""",
    }
