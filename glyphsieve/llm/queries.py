"""The queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, html_extract, language_id, line_dedup, mixing, quality, simhash, suffix_dedup, warc
from .common import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_of_kept(read_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spark, sf_dir)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.report(read_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS k FROM lines),
        common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, strlen(html) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    # Windows of 200 bytes by their hexadecimal digits, cut out of pieces of 2,000 bytes so that no long text is read once per window.
    "op5_suffix_dedup": """
        WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        piece AS (SELECT r, c, substr(h, 2 * c + 1, 4398) AS p FROM (SELECT r, h, unnest(range(0, length(h) // 2, 2000)) AS c FROM b)),
        win AS (SELECT r, c + i AS k, md5(substr(p, 2 * i + 1, 400)) AS m FROM (SELECT r, c, p, unnest(range(least(2000, greatest(0, length(p) // 2 - 199)))) AS i FROM piece)),
        hit AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY m) AS n FROM win) WHERE n > 1),
        run AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS s FROM (SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
        span AS (SELECT r, min(k) AS a, max(k) + 200 AS z FROM run GROUP BY r, s),
        part AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM span),
        cut AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front, max(z) AS z, sum(z - a) AS n_removed, count(*) AS n_spans FROM part JOIN b USING (r) GROUP BY r)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans > 0 THEN front || substr(h, 2 * z + 1) ELSE h END)) AS kept_sha256
        FROM b LEFT JOIN cut USING (r)""",
    "op9_decontamination": rf"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS w FROM documents),
        iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, 10 AS k, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM iw WHERE len(w) >= 10)
                UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM iw WHERE len(w) BETWEEN 1 AND 9),
        grams AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hits AS (SELECT doc_id, p, k, item_id FROM grams JOIN win USING (k, g)),
        words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
