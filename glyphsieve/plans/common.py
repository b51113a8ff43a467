"""What queries share: tables, texts with planted carriers, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import codepoints, tokens

PLANTED = " It is important to note that we delve into the rich tapestry of ideas in order to utilize it. In conclusion, this plays a pivotal role."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One in fewer files than there are cores is dealt out to all of them; a large one is never shuffled for that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _first(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + 1, F.length(text)))).otherwise(text)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, text)``: documents with invisible signs or phrases put in, by ``doc_id % 7``."""
    t, n = F.col("text"), F.col("doc_id") % 7
    part = lambda a, b=1 << 30: F.substring(t, a, b)
    text = (
        F.when(n == 0, F.concat(part(1, 5), F.lit("​"), part(6)))
        .when(n == 1, _first(t, " ", " "))
        .when(n == 2, F.concat(part(1, 3), F.lit("­⁠"), part(4)))
        .when(n == 3, F.concat(t, F.lit(PLANTED)))
        .when(n == 4, F.concat(part(1, 1), F.lit("‮"), part(2, 5), F.lit("‬"), part(7)))
        .when(n == 5, _first(t, "a", "а"))
        .otherwise(t)
    )
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.alias("text"))


PLANTED_SQL = f"""planted AS (SELECT doc_id, lang, source, CASE doc_id % 7
    WHEN 0 THEN substr(text, 1, 5) || chr(8203) || substr(text, 6)
    WHEN 1 THEN regexp_replace(text, ' ', chr(160))
    WHEN 2 THEN substr(text, 1, 3) || chr(173) || chr(8288) || substr(text, 4)
    WHEN 3 THEN text || {quoted(PLANTED)}
    WHEN 4 THEN substr(text, 1, 1) || chr(8238) || substr(text, 2, 5) || chr(8236) || substr(text, 7)
    WHEN 5 THEN regexp_replace(text, 'a', chr(1072))
    ELSE text END AS text FROM documents)"""

#: Pages get one of five marks behind ``<head>``, by ``page_id % 5``.
MARKS = [
    '<meta name="generator" content="Midjourney 6">',
    '<meta name="generator" content="WordPress 6.5">',
    '<script type="application/ld+json">{"digitalSourceType": "trainedAlgorithmicMedia"}</script>',
    "<!-- generated by ChatGPT, see contentcredentials -->",
    '<meta name="description" content="A page with data."><i data-ai-model="none"></i>',
]


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.pmod("page_id", F.lit(5)) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), mark)).alias("html"))


MARKED_SQL = "marked AS (SELECT page_id, url, regexp_replace(html, '<head>', '<head>' || [" + ", ".join(quoted(m) for m in MARKS) + "][page_id % 5 + 1], 'g') AS html FROM pages)"
WORD_SQL, PLAIN_SQL = quoted(tokens.WORD), quoted(tokens.PLAIN_WORD)


def words_sql(text: str = "coalesce(text, '')") -> str:
    return f"regexp_extract_all(lower({text}), {WORD_SQL})"


def sentences_sql(text: str = "coalesce(text, '')") -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+|\n+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '')"


def class_sql(kind: str) -> str:
    return quoted({"stripped": codepoints.STRIPPED, "suspect": codepoints.SUSPECT}.get(kind) or codepoints.CLASSES[kind])


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
