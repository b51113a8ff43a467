"""Queries about the texts of documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import codepoints, compare, fixed, stylometry, tokens
from glyphsieve.operators import detect, ngrams

from .common import PLAIN_SQL, PLANTED_SQL, class_sql, planted, quoted, rounded, sentences_sql, table, words_sql

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _count_sql(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


_WEIGHT_SQL = " + ".join(f"{w} * {_count_sql(p, chr(116))}" for _, w, p in stylometry.PHRASES)
_STYLE_SQL = f"""{PLANTED_SQL},
    base AS (SELECT doc_id, lang, coalesce(text, '') AS t, {words_sql()} AS w, {sentences_sql()} AS s FROM planted),
    lens AS (SELECT *, len(w) AS n, list_filter(list_transform(s, lambda x: len({words_sql("x")})), lambda k: k > 0) AS k FROM base),
    stat AS (SELECT doc_id, lang, n AS n_words, len(s) AS n_sentences, coalesce(list_avg(k), 0) AS mean_sentence,
        CASE WHEN len(k) > 1 THEN list_aggregate(k, 'stddev_samp') / list_avg(k) END AS sentence_cv,
        CASE WHEN n = 0 THEN 0 WHEN n <= 50 THEN len(list_distinct(w)) / n ELSE list_sum(list_transform(range(1, n - 48), lambda i: len(list_distinct(w[i:i + 49])))) / 50.0 / (n - 49) END AS mattr,
        CASE WHEN n >= 30 THEN ({_WEIGHT_SQL}) / (n / 100) ELSE 0 END AS phrase_density FROM lens),
    raw AS (SELECT *, CASE WHEN phrase_density <= 0 THEN 0 WHEN phrase_density >= 2 THEN 1 WHEN phrase_density >= 1 THEN 0.75 WHEN phrase_density >= 0.5 THEN 0.45 ELSE 0.2 END::DOUBLE AS f,
        CASE WHEN mattr BETWEEN 0.68 AND 0.76 THEN 0.4 ELSE 0.1 END::DOUBLE AS d, CASE WHEN sentence_cv < 0.25 THEN 0.95 WHEN sentence_cv < 0.35 THEN 0.8 WHEN sentence_cv < 0.45 THEN 0.5 WHEN sentence_cv < 0.55 THEN 0.25 ELSE 0.05 END::DOUBLE AS u FROM stat),
    scored AS (SELECT *, CASE WHEN n_words >= 30 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CASE WHEN sentence_cv IS NULL THEN (0.45::DOUBLE * f + 0.1::DOUBLE * d) / 0.55::DOUBLE ELSE 0.45::DOUBLE * u + 0.45::DOUBLE * f + 0.1::DOUBLE * d END)
        * CASE WHEN n_words < 100 THEN 0.4::DOUBLE + 0.6::DOUBLE * (n_words - 30) / 70 ELSE 1.0::DOUBLE END)) END AS score FROM raw),
    tiered AS (SELECT *, CASE WHEN score IS NULL THEN 'uncalibrated' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM scored)"""


@query(f"WITH {_STYLE_SQL} SELECT doc_id, n_words, n_sentences, mean_sentence, round(sentence_cv, 6) AS sentence_cv, mattr, round(phrase_density, 6) AS phrase_density, round(score, 6) AS score, tier FROM tiered")
def stylometry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stylometry.with_stylometry(planted(spark, sf_dir))
    numbers = [rounded(F.col(c)).alias(c) for c in ("sentence_cv", "phrase_density", "score")]
    return out.select("doc_id", "n_words", "n_sentences", "mean_sentence", "mattr", *numbers, "tier")


@query(f"WITH {_STYLE_SQL} SELECT lang, tier, count(*) AS n FROM tiered GROUP BY ALL")
def density_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stylometry.with_stylometry(planted(spark, sf_dir)).groupBy("lang", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, coalesce(length(text), 0) AS n_signs FROM (SELECT doc_id, text, {words_sql()} AS w FROM documents)")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t"), tokens.words(t).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.length("t").cast("long").alias("n_signs"))


@query(f"""WITH k AS (SELECT doc_id, list_filter(list_transform({sentences_sql()}, lambda x: len({words_sql("x")})), lambda k: k > 0) AS k FROM documents)
    SELECT doc_id, len(k) AS n_sentences, round(coalesce(list_avg(k), 0), 6) AS mean, round(CASE WHEN len(k) > 1 THEN list_aggregate(k, 'stddev_samp') ELSE 0 END, 6) AS deviation, round(CASE WHEN len(k) > 1 THEN list_aggregate(k, 'stddev_samp') / list_avg(k) END, 6) AS cv FROM k""")
def burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "documents").select("doc_id", stylometry.sentence_lengths(tokens.sentences(F.coalesce("text", F.lit("")))).alias("k")).withColumn("c", stylometry.cadence(F.col("k")))
    return k.select("doc_id", F.size("k").cast("long").alias("n_sentences"), rounded(F.col("c.mean")).alias("mean"), rounded(F.col("c.deviation")).alias("deviation"), rounded(F.col("c.cv")).alias("cv"))


@query(f"WITH {PLANTED_SQL} " + " UNION ALL ".join(f"SELECT {quoted(label)} AS phrase, {w}::DOUBLE AS weight, sum({_count_sql(p)})::BIGINT AS n, count(*) FILTER (WHERE {_count_sql(p)} > 0) AS n_docs FROM planted HAVING sum({_count_sql(p)}) > 0" for label, w, p in stylometry.PHRASES))
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = planted(spark, sf_dir).select(F.explode(stylometry.phrase_hits(F.coalesce("text", F.lit("")))).alias("h"))
    return hits.groupBy("h.phrase", "h.weight").agg(F.sum("h.count").alias("n"), F.count(F.lit(1)).alias("n_docs"))


_KINDS = list(codepoints.CLASSES)


@query(f"WITH {PLANTED_SQL} " + " UNION ALL ".join(f"SELECT {quoted(k)} AS kind, sum(len(regexp_extract_all(text, {class_sql(k)})))::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(text, {class_sql(k)})) AS n_docs FROM planted HAVING n > 0" for k in _KINDS))
def layer_a_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = planted(spark, sf_dir).select(F.explode(codepoints.native_counts(F.col("text"))).alias("kind", "n"))
    return hits.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"""WITH {PLANTED_SQL}, hit AS (SELECT unnest(regexp_extract_all(text, {class_sql("suspect")})) AS c FROM planted)
    SELECT printf('U+%04X', unicode(c)) AS codepoint, count(*) AS n FROM hit GROUP BY c""")
def layer_a_by_codepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = planted(spark, sf_dir).select(F.explode(codepoints.suspects(F.col("text"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return hit.select(F.concat(F.lit("U+"), F.lpad(F.ltrim(F.hex(F.encode("c", "utf-32")), F.lit("0")), 4, "0")).alias("codepoint"), "n")


@query(f"""WITH {PLANTED_SQL}, c AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, {class_sql("stripped")}, '', 'g'), {class_sql("space")}, ' ', 'g') AS clean FROM planted)
    SELECT doc_id, len(regexp_extract_all(text, {class_sql("suspect")})) AS suspicious, length(clean) AS clean_length, sha256(clean) AS clean_sha256, text IS DISTINCT FROM clean AS changed FROM c""")
def layer_a_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = planted(spark, sf_dir).withColumn("clean", codepoints.native_clean(F.col("text")))
    return c.select("doc_id", codepoints.suspicious_total(F.col("text")).alias("suspicious"), F.length("clean").cast("long").alias("clean_length"), F.sha2("clean", 256).alias("clean_sha256"), (~F.col("text").eqNullSafe(F.col("clean"))).alias("changed"))


@query()
def layer_a_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the rules that look at neighbours; texts without any carrier don't reach Python."""
    docs = planted(spark, sf_dir).select("doc_id", "text")
    some = codepoints.is_suspect(F.col("text"))
    hit = docs.where(some).select("doc_id", codepoints.cleaner()("text").alias("c")).select("doc_id", "c.removed_count", "c.replaced_count", F.sha2("c.text", 256).alias("clean_sha256"))
    return hit.unionByName(docs.where(~some).select("doc_id", F.lit(0).alias("removed_count"), F.lit(0).alias("replaced_count"), F.sha2("text", 256).alias("clean_sha256")))


@query(f"WITH {PLANTED_SQL} SELECT doc_id, sha256(translate(text, {quoted(''.join(codepoints.CONFUSABLES))}, {quoted(''.join(codepoints.CONFUSABLES.values()))})) AS folded_sha256, translate(text, {quoted(''.join(codepoints.CONFUSABLES))}, {quoted(''.join(codepoints.CONFUSABLES.values()))}) <> text AS changed FROM planted")
def confusable_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = planted(spark, sf_dir).withColumn("f", codepoints.fold_confusables(F.col("text")))
    return d.select("doc_id", F.sha2("f", 256).alias("folded_sha256"), (F.col("f") != F.col("text")).alias("changed"))


@query(f"WITH {PLANTED_SQL} SELECT doc_id, sha256(regexp_replace(text, {class_sql('space')}, ' ', 'g')) AS plain_sha256 FROM planted")
def space_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.sha2(codepoints.normalize_spaces(F.col("text")), 256).alias("plain_sha256"))


def _swap_sql(text: str) -> str:
    for phrase, short in (fixed.PHRASE_SWAPS | fixed.WORD_SWAPS).items():
        for old, new in ((phrase.upper(), short.upper()), (phrase[0].upper() + phrase[1:], short[0].upper() + short[1:]), (phrase, short)):
            text = rf"regexp_replace({text}, '\b{old}\b', '{new}', 'g')"
    return text


@query(f"WITH {PLANTED_SQL} SELECT doc_id, sha256({_swap_sql('text')}) AS swapped_sha256 FROM planted")
def humanize_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("doc_id", F.sha2(compare.swap_phrases(F.col("text")), 256).alias("swapped_sha256"))


_BIGRAM_SQL = f"list_distinct(list_transform(range(1, len(regexp_extract_all(lower(%s), {PLAIN_SQL}))), lambda i: regexp_extract_all(lower(%s), {PLAIN_SQL})[i] || ' ' || regexp_extract_all(lower(%s), {PLAIN_SQL})[i + 1]))"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS a, b.text AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
    g AS (SELECT *, {_BIGRAM_SQL % ("a", "a", "a")} AS x, {_BIGRAM_SQL % ("b", "b", "b")} AS y, list_distinct(regexp_extract_all(a, '[0-9]+')) AS na, list_distinct(regexp_extract_all(b, '[0-9]+')) AS nb, list_distinct(regexp_extract_all(a, 'https?://\\S+')) AS ua, list_distinct(regexp_extract_all(b, 'https?://\\S+')) AS ub FROM p)
    SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0 WHEN len(x) = 0 OR len(y) = 0 THEN 1 ELSE 1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS divergence,
    round(CASE WHEN len(na) = 0 THEN 1 ELSE len(list_intersect(na, nb)) / len(na) END, 6) AS numbers, round(CASE WHEN len(ua) = 0 THEN 1 ELSE len(list_intersect(ua, ub)) / len(ua) END, 6) AS urls, round(length(b) / nullif(length(a), 0), 6) AS length_ratio FROM g""")
def turn_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the next one of its conversation."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    a, b = c.select("conv_id", "turn", F.col("text").alias("a")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    p, x, y = a.join(b, ["conv_id", "turn"]), F.col("a"), F.col("b")
    p = p.withColumn("x", tokens.bigrams(tokens.plain_words(x))).withColumn("y", tokens.bigrams(tokens.plain_words(y)))
    return p.select("conv_id", "turn", rounded(compare.set_divergence(F.col("x"), F.col("y"))).alias("divergence"), rounded(compare.numbers_preserved(x, y)).alias("numbers"), rounded(compare.urls_preserved(x, y)).alias("urls"), rounded(F.try_divide(F.length(y), F.length(x))).alias("length_ratio"))


@query(rf"""WITH s AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(30), 'g'), chr(30)) AS u FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(list_filter(u, lambda x: x <> '')) AS n_units, greatest(1, floor(length(text) / 4))::BIGINT AS about_tokens FROM s""")
def unit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.size(F.filter(tokens.units(F.col("text")), lambda u: u["unit"] != "")).cast("long").alias("n_units"), tokens.estimate_tokens(F.col("text")).alias("about_tokens"))


_IDS_SQL = "list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: ('0x' || sha256(t)[1:16])::UBIGINT)"


@query(f"""WITH i AS (SELECT doc_id, {_IDS_SQL} AS ids FROM documents),
    w AS (SELECT doc_id, len(ids) AS n, CASE WHEN len(ids) >= 4 THEN list_transform(range(1, len(ids) - 2), lambda k: ids[k:k + 3]) ELSE [] END AS spans FROM i)
    SELECT doc_id, n AS tokens_total, least(n, 3) AS skipped_no_context, len(spans) - len(list_distinct(spans)) AS skipped_repeated, len(list_distinct(spans)) AS counted FROM w""")
def gumbel_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokens.simple_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", detect.token_counters(F.col("t")).alias("c")).select("doc_id", "c.*")


@query()
def gumbel_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokens.simple_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", detect.keyed_tokens("a key")("t").alias("r")).select("doc_id", "r.*")


@query(f"""WITH {_STYLE_SQL} SELECT doc_id, 'stylometry' AS detector, true AS available, score >= 0.65 AS is_watermarked, round(score, 6) AS score FROM tiered
    UNION ALL SELECT doc_id, unnest(['keyed-gumbel', 'proprietary']), false, NULL, NULL FROM documents""")
def detector_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.run_detectors(planted(spark, sf_dir), "doc_id").select("doc_id", "detector", "available", "is_watermarked", rounded(F.col("score")).alias("score"))


_PAIR_SQL = f"SELECT doc_id, lang, w[k] AS ctx, w[k + 1] AS tok FROM (SELECT doc_id, lang, w, unnest(range(1, len(w))) AS k FROM (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), {quoted(tokens.WORD_OR_SIGN)}) AS w FROM documents))"
_TABLE_SQL = f"""WITH pair AS ({_PAIR_SQL}),
    tok AS (SELECT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), {quoted(tokens.WORD_OR_SIGN)})) AS tok FROM documents WHERE lang IN ('en', 'fr')),
    m AS (SELECT ctx, tok, count(*) AS n FROM pair WHERE lang = 'en' GROUP BY ALL), b AS (SELECT ctx, tok, count(*) AS bn FROM pair WHERE lang = 'fr' GROUP BY ALL),
    mc AS (SELECT ctx, sum(n) AS mn FROM m GROUP BY ctx HAVING sum(n) >= 2), bc AS (SELECT ctx, sum(bn) AS bcn FROM b GROUP BY ctx), u AS (SELECT tok, count(*) AS u FROM tok WHERE lang = 'fr' GROUP BY tok),
    v AS (SELECT count(DISTINCT tok) AS v, count(*) FILTER (WHERE lang = 'fr') AS every FROM tok),
    ratio AS (SELECT m.ctx, m.tok, n, ln(((n + 0.4::DOUBLE) / (mn + 0.4::DOUBLE * v) + 1e-6::DOUBLE) / (CASE WHEN bcn IS NOT NULL THEN (coalesce(bn, 0) + 0.4::DOUBLE) / (bcn + 0.4::DOUBLE * v) ELSE (coalesce(u, 0) + 0.4::DOUBLE) / (every + 0.4::DOUBLE * v) END + 1e-6::DOUBLE)) AS score
        FROM m JOIN mc USING (ctx) LEFT JOIN bc USING (ctx) LEFT JOIN b ON b.ctx = m.ctx AND b.tok = m.tok LEFT JOIN u ON u.tok = m.tok, v)"""


def _ratios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return d, ngrams.log_ratios(d.where("lang = 'en'"), d.where("lang = 'fr'"), tokens.words_and_signs(F.col("text")))


@query(f"WITH pair AS ({_PAIR_SQL}) SELECT ctx, tok, count(*) AS n FROM pair GROUP BY ALL")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.counts(table(spark, sf_dir, "documents"), tokens.words_and_signs(F.coalesce("text", F.lit(""))))


@query(f"{_TABLE_SQL} SELECT ctx, n_tok, n_all, round(best, 5) AS best FROM (SELECT ctx, count(*) AS n_tok, sum(n)::BIGINT AS n_all, max(score) AS best FROM ratio GROUP BY ctx)")
def ngram_log_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratios(spark, sf_dir)[1].groupBy("ctx").agg(F.count(F.lit(1)).alias("n_tok"), F.sum("n").alias("n_all"), F.max("score").alias("best")).withColumn("best", F.round("best", 5))


@query(f"{_TABLE_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(score, 9) DESC, tok) AS rank FROM ratio) SELECT ctx, tok, rank, round(score, 5) AS score FROM top WHERE rank <= 3")
def ngram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: three tokens of each context."""
    best = ngrams.top(_ratios(spark, sf_dir)[1].withColumn("raw", F.col("score")).withColumn("score", F.round("score", 9)), 3)
    return best.select("ctx", "tok", "rank", F.round("raw", 5).alias("score"))


@query(f"""{_TABLE_SQL}, hit AS (SELECT doc_id, count(*) AS hits, sum(score) AS total FROM pair JOIN ratio USING (ctx, tok) GROUP BY doc_id)
    SELECT doc_id, coalesce(hits, 0) AS hits, round(total, 4) AS total FROM documents LEFT JOIN hit USING (doc_id)""")
def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, ratio = _ratios(spark, sf_dir)
    return ngrams.sequence_scores(d, ratio, tokens.words_and_signs(F.col("text")), "doc_id").select("doc_id", "hits", F.round("total", 4).alias("total"))
