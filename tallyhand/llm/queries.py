"""One registered query for each operator of this package, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhand.llm import bpe, cross_entropy, decomposition, exact_dedup, fill_in_middle, fingerprints, html_text, language, near_dup, packing, prefix_trie, sharding, warc
from tallyhand.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"), fingerprints.content_digests)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy.exact_cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    return resolved.select(
        "record_id",
        "url",
        F.unix_seconds("date").alias("date_s"),
        "outcome",
        "refers_to",
        F.unix_seconds("refers_to_date").alias("refers_to_s"),
        warc.header_text(F.col("headers")).alias("headers"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decomposition.digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_near_dup, op3_sharding, op4_lm_scoring, op5_packing, op6_language_id, op7_bpe, op8_warc_revisits, op9_exact_dedup, op10_html_text, op11_power_of_two_packing, op12_prefix_trie, op13_fill_in_middle)}

ORACLES = {
    "op12_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base,
                   xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda crc, x: list_reduce(list_concat([xor(crc, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda a, bit: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END))) % 4 AS h
            FROM t GROUP BY conv_id
        ), r AS (
            SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
            UNION ALL
            SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
        ), d AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, sha256(length(role) || ':' || role || text) AS said,
                   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
            FROM r
        ), p AS (
            SELECT conv_id, depth, words, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM d
            UNION ALL
            SELECT conv_id, 0, 0, '' FROM c
        ), q AS (
            SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
        ), n AS (
            SELECT prefix, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
            FROM q GROUP BY prefix
        ), k AS (
            SELECT left(prefix, length(prefix) - 64) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
        ), v AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)
        ), s AS (
            SELECT p.prefix, sum((v.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens
            FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.prefix
        )
        SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
        FROM v JOIN s USING (prefix) LEFT JOIN v up ON v.depth > 0 AND up.prefix = left(v.prefix, length(v.prefix) - 64)
    """,
    "op13_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
            FROM documents
        ), n AS (
            SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                   ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM d
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM n
        ), p AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
            FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM n
    """,
    "op8_warc_revisits": r"""
        WITH p AS (
            SELECT page_id, url, html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, page_id * 60 + 1600000000 AS s,
                   'day ' || (page_id // 1440) AS day, page_id % 3 = 0 AS dated,
                   regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare
            FROM pages
        ), c AS (
            SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                                            lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS params
            FROM p
        ), k AS (
            SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:80$|:443$', '', 'g')
                      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
                      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canon
            FROM c
        ), full_ AS (
            SELECT canon, page_id * 2 AS id, s, CASE WHEN NOT dated THEN tag END AS etag, day AS modified, strlen(coalesce(html, '')) AS size FROM k
        ), revisits AS (
            SELECT page_id * 2 + 1 AS id, canon, s + CASE WHEN page_id % 13 = 0 THEN -86400 ELSE 86400 END AS s,
                   CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 5 = 0 THEN 'W/' || tag ELSE tag END AS etag,
                   CASE WHEN dated AND page_id % 11 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN 'another day' ELSE day END END AS modified
            FROM k
        ), j AS (
            SELECT r.*, f.id AS f_id, f.s AS f_s, f.etag AS f_etag, f.modified AS f_modified, f.size AS f_size,
                   row_number() OVER (PARTITION BY r.id ORDER BY f.s DESC, f.id DESC) AS nth
            FROM revisits r LEFT JOIN full_ f ON f.canon = r.canon AND f.s < r.s
        ), o AS (
            SELECT *, CASE WHEN f_id IS NULL THEN 'no earlier response'
                           WHEN etag IS NOT NULL AND f_etag IS NOT NULL
                               THEN CASE WHEN regexp_replace(etag, '^W/', '') = f_etag THEN 'resolved' ELSE 'validators differ' END
                           WHEN modified IS NOT NULL AND f_modified IS NOT NULL
                               THEN CASE WHEN modified = f_modified THEN 'resolved' ELSE 'validators differ' END
                           ELSE 'no validators' END AS outcome
            FROM j WHERE nth = 1
        )
        SELECT id AS record_id, canon AS url, s AS date_s, outcome, CASE WHEN outcome = 'resolved' THEN f_id END AS refers_to,
               CASE WHEN outcome = 'resolved' THEN f_s END AS refers_to_s,
               concat_ws(chr(10), 'cache-control: max-age=600',
                   'content-length: ' || CASE WHEN outcome = 'resolved' THEN f_size ELSE 0 END,
                   CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' END,
                   'date: ' || s,
                   CASE WHEN outcome = 'resolved' THEN 'etag: ' || coalesce(etag, f_etag) ELSE 'etag: ' || etag END,
                   CASE WHEN outcome = 'resolved' THEN 'last-modified: ' || coalesce(modified, f_modified) ELSE 'last-modified: ' || modified END) AS headers
        FROM o
    """,
}
