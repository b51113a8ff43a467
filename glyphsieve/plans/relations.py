"""Queries over events, orders and documents: joins by order and range, set operations, cubes, merged counts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import tokens
from glyphsieve.operators import ngrams, relational

from .common import quoted, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("""WITH r AS (SELECT user_id, ts, max(event_id) AS last_id FROM events WHERE event_id % 3 = 0 GROUP BY ALL)
    SELECT e.event_id, r.last_id FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts WHERE e.event_id % 3 <> 0""")
def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of two thirds with its user's last one of the other third."""
    e = table(spark, sf_dir, "events")
    right = e.where("event_id % 3 = 0").select("user_id", "ts", F.col("event_id").alias("last_id"))
    return relational.asof_join(e.where("event_id % 3 <> 0").select("event_id", "user_id", "ts"), right, "user_id", "ts", ["last_id"]).select("event_id", "last_id")


@query("""WITH r AS (SELECT event_id, ts AS low, ts + INTERVAL 3 HOUR AS high FROM events WHERE event_id % 10 = 0)
    SELECT r.event_id, count(*) AS n, round(sum(p.value), 4) AS total FROM r JOIN events p ON p.ts >= r.low AND p.ts < r.high GROUP BY r.event_id""")
def events_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens in the three hours from each tenth event on."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    points = e.select(at.alias("at"), "value")
    ranges = e.where("event_id % 10 = 0").select("event_id", at.alias("low"), (at + 3 * 3_600_000_000).alias("high"))
    found = relational.range_totals(points, ranges, "at", "low", "high", "value", 3_600_000_000)
    return found.groupBy("event_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


_PAIRS_SQL = f"SELECT DISTINCT w[k] AS ctx, w[k + 1] AS tok FROM (SELECT w, unnest(range(1, len(w))) AS k FROM (SELECT regexp_extract_all(lower(coalesce(text, '')), {quoted(tokens.WORD_OR_SIGN)}) AS w FROM documents WHERE lang = '%s'))"


@query(f"""WITH a AS ({_PAIRS_SQL % 'en'}), b AS ({_PAIRS_SQL % 'fr'}), s AS (SELECT 'both' AS side, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'first', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'second', count(*) FROM (FROM b EXCEPT FROM a)) SELECT * FROM s WHERE n > 0""")
def shared_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many word pairs two languages share, and how many each has alone."""
    d = table(spark, sf_dir, "documents")
    of = lambda lang: ngrams.pairs(d.where(F.col("lang") == lang), tokens.words_and_signs(F.coalesce("text", F.lit("")))).distinct()
    return relational.shared_rows(of("en"), of("fr")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, grouping_id(lang, source)::BIGINT AS level, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def document_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.counts_cube(table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")


@query("""WITH c AS (SELECT doc_id // 10 AS k, source, count(*) FILTER (WHERE doc_id % 2 = 0) AS x, count(*) FILTER (WHERE doc_id % 2 = 1) AS y FROM documents WHERE source IS NOT NULL GROUP BY ALL)
    SELECT k, string_agg(source || '=' || (x + y), ',' ORDER BY source) AS counts FROM c GROUP BY k""")
def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source of even and odd documents, as maps that are added up."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").withColumn("k", F.floor(F.col("doc_id") / 10))
    each = d.groupBy("k", "source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("x"), F.count_if(F.col("doc_id") % 2 == 1).alias("y"))
    of = lambda c: F.map_from_entries(F.filter(F.collect_list(F.struct("source", c)), lambda e: e[c] > 0))
    m = each.groupBy("k").agg(of("x").alias("a"), of("y").alias("b")).select("k", relational.merged_counts(F.col("a"), F.col("b")).alias("m"))
    return m.select("k", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%S+00''00''') AS pdf, epoch(o_orderdate)::BIGINT AS at, epoch(o_orderdate)::BIGINT - 19800 AS east, epoch(date_trunc('month', o_orderdate))::BIGINT AS month FROM orders""")
def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as PDF has them and read back, also with another offset and with the day left out."""
    pdf = relational.pdf_date(F.col("o_orderdate"))
    seconds = lambda text: F.unix_seconds(relational.from_pdf_date(text))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pdf.alias("pdf"))
    return rows.select("o_orderkey", "pdf", seconds(F.col("pdf")).alias("at"), seconds(F.concat(F.substring("pdf", 1, 16), F.lit("+05'30'"))).alias("east"), seconds(F.substring("pdf", 1, 8)).alias("month"))
