"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import bpe, chat_format, fingerprints, hashing_search, lexical_search, line_dedup, ngram_join, packing, secret_scan, structure_repair, token_counts, toxicity, url_filter
from tesserine.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(turns.unionByName(planted)).drop("n_tokens", "loss_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), window=4096, end_id=2, with_ids=False)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op7_hashing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_search.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, line_words=line_dedup.LINE_WORDS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure_repair.report(conversations, structure_repair.damage(conversations))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_join": op3_ngram_join,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_secret_scan": op6_secret_scan,
    "op7_hashing_search": op7_hashing_search,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_structure_repair": op12_structure_repair,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized AS (
            SELECT *, length(x) + len(regexp_extract_all(x, '<(?:/?turn>|body>)')) AS n
            FROM (SELECT *, replace(role || chr(0) || text, '\', '\\') AS x FROM turns))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(n - 1 + 6 + 6 + 7 + 1) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op3_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        grams AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        edges AS (
            SELECT x, y FROM links JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
            WHERE 100 * k >= 75 * (p.n + q.n - k)),
        reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
        SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN sizes s USING (doc_id)
        JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""",
    "op11_lexical_search": r"""
        WITH words AS (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        items AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark WHERE item_id IS NOT NULL),
        total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM words),
        found AS (
            SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM words)
            WHERE term IN (SELECT term FROM items) GROUP BY d, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM found, total GROUP BY term, big_n),
        sized AS (SELECT d, doc_id, 100 - 50 + ((50 * len(w) * big_n) // big_l) AS m FROM words, total WHERE len(w) > 0),
        scores AS (
            SELECT item_id, d, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
            FROM items JOIN found USING (term) JOIN weights USING (term) JOIN sized USING (d) WHERE doc_id IS NOT NULL GROUP BY item_id, d, doc_id),
        ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
        SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50""",
    "op12_structure_repair": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f
            FROM conversations, crc_table),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS again
            FROM keyed WHERE f <> 0),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
        said AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again_said, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM numbered),
        marked AS (
            SELECT conv_id, n, turn, role, text, left(role, 1) AS i, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal,
                CASE WHEN s = '' THEN 'blank' WHEN again_said THEN 'duplicate' WHEN right(s, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM said),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(n) AS last
            FROM marked GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        chart AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': 0, 'a': '', 't': ''} AS z, {'c': 1000000000, 'a': '', 't': ''} AS y,
                {'c': 2, 'a': 'I', 't': chr(10) || 'user:'} AS u, {'c': 4, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS p FROM ids
            UNION ALL
            SELECT conv_id, n, z1, y1, u2, least(p1, {'c': u2.c + 2, 'a': u2.a || 'I', 't': u2.t || chr(10) || 'assistant:'})
            FROM (
                SELECT *, least(u1, {'c': z1.c + 2, 'a': z1.a || 'I', 't': z1.t || chr(10) || 'user:'}, {'c': y1.c + 2, 'a': y1.a || 'I', 't': y1.t || chr(10) || 'user:'}, {'c': p1.c + 2, 'a': p1.a || 'I', 't': p1.t || chr(10) || 'user:'}) AS u2
                FROM (
                    SELECT m.conv_id, m.n, {'c': z.c + 3, 'a': z.a || 'D', 't': z.t} AS z1,
                        list_min([{'c': y.c + 3, 'a': y.a || 'D', 't': y.t}, {'c': CASE WHEN i = 's' AND fault NOT IN ('blank', 'duplicate') THEN z.c + e ELSE 1000000000 END, 'a': z.a || 'K', 't': z.t || chr(10) || role || ':' || text}]) AS y1,
                        list_min(list_concat([{'c': u.c + 3, 'a': u.a || 'D', 't': u.t}],
                            list_transform([z, y, p], lambda x: {'c': CASE WHEN i = 'u' AND fault NOT IN ('blank', 'duplicate') THEN x.c + e ELSE 1000000000 END, 'a': x.a || 'K', 't': x.t || chr(10) || role || ':' || text}),
                            list_transform([z, y, p], lambda x: {'c': CASE WHEN fault NOT IN ('blank', 'duplicate') THEN x.c + 2 + e ELSE 1000000000 END, 'a': x.a || 'R', 't': x.t || chr(10) || 'user:' || text}))) AS u1,
                        list_min([{'c': p.c + 3, 'a': p.a || 'D', 't': p.t}, {'c': CASE WHEN i = 'a' AND fault NOT IN ('blank', 'duplicate') THEN u.c + e ELSE 1000000000 END, 'a': u.a || 'K', 't': u.t || chr(10) || role || ':' || text},
                            {'c': CASE WHEN fault NOT IN ('blank', 'duplicate') THEN u.c + 2 + e ELSE 1000000000 END, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text}]) AS p1
                    FROM chart c JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS e FROM marked) m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.n = c.n + 1))),
        done AS (SELECT c.conv_id, least(z, p) AS best FROM chart c JOIN ids k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN counted o ON o.conv_id IS NOT DISTINCT FROM c.conv_id WHERE c.n = coalesce(o.last, 0))
        SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
        FROM done d LEFT JOIN counted o ON o.conv_id IS NOT DISTINCT FROM d.conv_id""",
    "op13_url_filter": r"""
        WITH parts AS (
            SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
        rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        numbered AS (SELECT *, row_number() OVER () AS k FROM parts),
        met AS (
            SELECT k, max_by(struct_pack(rule := h || p, verdict := v), length(h || p)) AS best
            FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM numbered LEFT JOIN met USING (k)""",
}
