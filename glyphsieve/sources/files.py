"""Files, corpora and sitemaps as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import routing

MAX_INPUT_BYTES = 256 << 20
MAX_SEED_BYTES = 64 << 10


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_INPUT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files to read ``(path, length, content)`` and skipped ones ``(path, reason)``. The limit is pushed into the scan, so large files aren't read."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.concat(F.lit("/"), F.substring_index("path", root.split("://")[-1].strip("/"), -1))
    used = every.where(~F.regexp_like(below, F.lit(routing.SKIPPED_DIRS)))
    return used.where(F.col("length") <= max_bytes).select("path", "length", "content"), used.where(F.col("length") > max_bytes).select("path", F.lit("too large").alias("reason"))


def seeds(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """``(doc, prompt)`` from ``*.txt`` files, without empty and long ones, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(root).where((F.col("length") > 0) & (F.col("length") <= MAX_SEED_BYTES))
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc"), F.make_valid_utf8(F.col("content").cast("string")).alias("prompt")).where(F.trim("prompt") != "")
    return rows.orderBy("doc").limit(limit) if limit else rows


def json_lines(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """``(text)``: the field of each JSON line; lines that are no JSON stay as they are, blank ones go."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.coalesce(F.get_json_object("value", f"$.{field}"), F.when(~F.trim("value").startswith("{"), F.col("value")), F.col("value")).alias("text"))


def stats_json(log: Column) -> Column:
    """The JSON object that ends a program's messages, from its first brace; null if it is none."""
    at = F.instr(log, "{")
    text = F.when(at > 0, F.substring(log, at, F.length(log)))
    return F.when(F.try_parse_json(text).isNotNull(), text)


def rows_pages(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``(row)``: the rows of paged JSON replies ``{"rows": [{"row": {...}}, ...]}``, as JSON."""
    cells = F.from_json(F.get_json_object(reply, "$.rows"), "array<struct<row:string>>")
    return replies.select(F.explode(cells).alias("r")).select(F.col("r.row").alias("row"))


def sitemap(xml: Column) -> Column:
    """``struct<kind,urls>`` of a sitemap's text; null for documents with a DTD or of another kind."""
    root = F.regexp_extract(xml, r"<(?:[A-Za-z0-9_]+:)?(urlset|sitemapindex)\b", 1)
    safe = ~F.regexp_like(xml, F.lit(r"(?i)<!(doctype|entity)"))
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"<(?:[A-Za-z0-9_]+:)?loc>\s*([^<]*?)\s*</"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.when(safe & (root != ""), F.struct(root.alias("kind"), locs.alias("urls")))


def collect_urls(files: DataFrame, start: str, limit: int | None = None, depth: int = 8) -> DataFrame:
    """``(url)``: the addresses that the sitemaps below ``start`` list, each once, of its origin only.

    ``files`` are fetched sitemaps ``(url, xml)``. Indexes are followed level by level, ``depth`` of them at most, through the files at hand; a
    sitemap is read once however often it is listed. ``limit`` is a crawl's bound on addresses, taken in their order.
    """
    read = files.withColumn("s", sitemap(F.col("xml"))).where("s IS NOT NULL").select(F.col("url").alias("at"), "s.kind", "s.urls")
    home = routing.url_origin(F.lit(start))
    seen = files.sparkSession.createDataFrame([(start,)], "at string")
    level, found = seen, None
    for _ in range(depth):
        here = level.join(read, "at").select("kind", F.explode("urls").alias("url")).where(routing.url_origin(F.col("url")) == home)
        pages = here.where("kind = 'urlset'").select("url")
        found = pages if found is None else found.unionByName(pages)
        level = here.where("kind = 'sitemapindex'").select(F.col("url").alias("at")).distinct().join(seen, "at", "left_anti")
        if not level.take(1):
            break
        seen = seen.unionByName(level)
    urls = found.distinct()
    return urls.orderBy("url").limit(limit) if limit else urls


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines at a new path; an existing one is never overwritten."""
    report.write.mode("errorifexists").json(path)
