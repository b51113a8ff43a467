"""Queries that evaluate: AUROC, variants, levels, frontiers, ranks, holdouts, verdicts, and vectors.

Rows of an evaluation are made from documents: scores from word counts, seeds and levels from ids, so that SQL makes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsieve.functions import compare, tokens
from glyphsieve.operators import evaluation, reports

from .common import WORD_SQL, quoted, rounded, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_N_SQL = f"len(regexp_extract_all(coalesce(text, ''), {WORD_SQL}))"


@query(f"""WITH r AS (SELECT source, quality = 1 AS pos, {_N_SQL} AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    k AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2 AS mid FROM r),
    g AS (SELECT source, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(mid) FILTER (WHERE pos) AS ranks FROM k GROUP BY source)
    SELECT source, n_pos, n_neg, round(CASE WHEN n_pos * n_neg > 0 THEN (ranks - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END, 6) AS auroc FROM g""")
def auroc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", tokens.word_count(F.coalesce("text", F.lit(""))).alias("s")).join(table(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id")
    out = evaluation.auroc(rows.withColumn("pos", F.col("quality") == 1), "source", "s", "pos")
    return out.withColumn("auroc", rounded(F.col("auroc")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("n"), F.col("doc_id")
    words = F.explode(F.array(tokens.word_count(F.coalesce("text", F.lit("")))))  # not inlined into each column that is made of it
    before, after = F.pmod(n, F.lit(100)) / 100.0, F.pmod(n * 7 + d, F.lit(100)) / 100.0
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("n")).select(F.concat(F.lit("v"), F.pmod(d, F.lit(5)).cast("string")).alias("variant"), "doc_id", "source", before.alias("score_before"), F.when(d % 11 != 0, after).alias("score_after"))
    return rows.withColumn("before_pos", F.col("score_before") >= 0.5).withColumn("after_pos", F.coalesce(F.col("score_after") >= 0.5, F.lit(False))).withColumn("cleared", F.col("score_after") < 0.5).withColumn("margin", 0.5 - F.col("score_after")).withColumn("noop", F.col("score_after") == F.col("score_before"))


_ROWS_SQL = f"""n AS (SELECT doc_id, source, {_N_SQL} AS n FROM documents),
    s AS (SELECT 'v' || (doc_id % 5) AS variant, doc_id, source, (n % 100) / 100.0::DOUBLE AS score_before, CASE WHEN doc_id % 11 <> 0 THEN ((n * 7 + doc_id) % 100) / 100.0::DOUBLE END AS score_after FROM n),
    r AS (SELECT *, score_before >= 0.5 AS before_pos, coalesce(score_after >= 0.5, false) AS after_pos, score_after < 0.5 AS cleared, 0.5::DOUBLE - score_after AS margin, score_after = score_before AS noop FROM s)"""


@query(f"""WITH {_ROWS_SQL}, a AS (SELECT variant, count(*) AS n, count(*) FILTER (WHERE before_pos) AS before_pos, count(*) FILTER (WHERE after_pos) AS after_pos, count(*) FILTER (WHERE before_pos AND cleared) AS cleared, count(*) FILTER (WHERE noop) AS noop_n,
    avg(score_before) AS mean_before, avg(score_after) AS mean_after, avg(margin) AS mean_margin, list_sort(list(score_before - score_after) FILTER (WHERE score_after IS NOT NULL)) AS deltas FROM r GROUP BY variant)
    SELECT variant, n, before_pos, after_pos, cleared, noop_n, round(mean_before, 6) AS mean_before, round(mean_after, 6) AS mean_after, round(mean_margin, 6) AS mean_margin, round(deltas[len(deltas) // 2 + 1], 6) AS median_delta, round(CASE WHEN before_pos > 0 THEN cleared / before_pos END, 6) AS clear_rate FROM a""")
def variant_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.variant_summary(_rows(spark, sf_dir))
    return out.withColumns({c: rounded(F.col(c)) for c in ("mean_before", "mean_after", "mean_margin", "median_delta", "clear_rate")})


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("n"), F.col("doc_id")
    base = table(spark, sf_dir, "documents").select("doc_id", tokens.word_count(F.coalesce("text", F.lit(""))).alias("n"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("attempt"))
    return base.select((d / 3).cast("long").alias("doc"), F.pmod(d, F.lit(3)).alias("seed"), F.pmod(n + F.col("attempt") * 3, F.lit(5)).alias("level"), "attempt", (F.pmod(n * F.col("attempt"), F.lit(37)) / 37.0).alias("divergence"), (F.pmod(n + d * F.col("attempt"), F.lit(4)) == 0).alias("cleared"))


@query(f"""WITH n AS (SELECT doc_id, {_N_SQL} AS n, unnest(range(1, 7)) AS attempt FROM documents),
    t AS (SELECT doc_id // 3 AS doc, doc_id % 3 AS seed, (n + attempt * 3) % 5 AS level, attempt, (n * attempt % 37) / 37.0::DOUBLE AS divergence, (n + doc_id * attempt) % 4 = 0 AS cleared FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc, seed ORDER BY level, divergence, attempt) AS k FROM t WHERE cleared)
    SELECT g.doc, g.seed, g.attempts, k.level AS min_level, k.attempt, round(k.divergence, 6) AS divergence FROM (SELECT doc, seed, count(*) AS attempts FROM t GROUP BY ALL) g LEFT JOIN k ON g.doc = k.doc AND g.seed = k.seed AND k.k = 1""")
def minimal_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.minimal_levels(_attempts(spark, sf_dir)).withColumn("attempt", F.col("attempt").cast("long")).withColumn("divergence", rounded(F.col("divergence")))


@query(f"""WITH n AS (SELECT doc_id, {_N_SQL} AS n, unnest(range(1, 7)) AS attempt FROM documents),
    t AS (SELECT doc_id // 3 AS doc, doc_id % 3 AS seed, (n + attempt * 3) % 5 AS level, (n + doc_id * attempt) % 4 = 0 AS cleared FROM n),
    g AS (SELECT doc, seed, min(level) FILTER (WHERE cleared) AS level FROM t GROUP BY ALL)
    SELECT level AS min_level, count(*) AS n FROM g GROUP BY level""")
def level_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.minimal_levels(_attempts(spark, sf_dir)).groupBy("min_level").agg(F.count(F.lit(1)).alias("n"))


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir).groupBy("source").agg(rounded(F.avg(F.col("cleared").cast("double"))).alias("robust_rate"), rounded(F.avg("score_before")).alias("semantic"), rounded(F.avg("score_after")).alias("human"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("removal", F.col("n") % 2 == 0)


_STRATEGY_SQL = f"{_ROWS_SQL}, c AS (SELECT source, round(avg(cleared::INT), 6) AS robust_rate, round(avg(score_before), 6) AS semantic, round(avg(score_after), 6) AS human, count(*) AS n, count(*) % 2 = 0 AS removal FROM r GROUP BY source)"


@query(f"""WITH {_STRATEGY_SQL}, u AS (SELECT * FROM c WHERE robust_rate IS NOT NULL AND semantic IS NOT NULL AND human IS NOT NULL)
    SELECT source, robust_rate, human, semantic FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.robust_rate >= a.robust_rate AND b.semantic <= a.semantic AND b.human >= a.human AND (b.robust_rate > a.robust_rate OR b.semantic < a.semantic OR b.human > a.human))""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pareto_frontier(_strategies(spark, sf_dir), "source", ["robust_rate", "human"], ["semantic"])


@query(f"WITH {_STRATEGY_SQL}, w AS (SELECT source, round(0.5::DOUBLE * robust_rate + 0.3::DOUBLE * (1 - semantic) + 0.2::DOUBLE * human, 6) AS score FROM c WHERE robust_rate >= 0.4 - 1e-9) SELECT source, score, row_number() OVER (ORDER BY score DESC, source) AS rank FROM w WHERE score IS NOT NULL")
def weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = rounded(evaluation.weighted_score(F.col("robust_rate"), F.col("semantic"), F.col("human"), (0.5, 0.3, 0.2)))
    return evaluation.ranked(_strategies(spark, sf_dir), score, "source", F.col("robust_rate"), 0.4).select("source", "score", "rank")


@query(f"WITH {_STRATEGY_SQL}, b AS (SELECT max(robust_rate) FILTER (WHERE removal) AS best FROM c) SELECT best, CASE WHEN best IS NULL THEN 'undetermined' WHEN best <= 0 THEN 'resists' WHEN best < 1 THEN 'partial' ELSE 'removable' END AS verdict FROM b")
def strategy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.strategy_verdict(_strategies(spark, sf_dir))


@query("WITH d AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), k AS (SELECT source, row_number() OVER (ORDER BY source) <= greatest(1, round_even((SELECT count(*) FROM d) * 0.7, 0)) AS train FROM d) SELECT doc_id, train FROM documents LEFT JOIN k USING (source)")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.holdout_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.7).select("doc_id", "train")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source, sha256(coalesce(text, '')) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def repeated_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.repeated_generations(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text").select("doc_id", "duplicate")


@query("""SELECT a.vec_id, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS divergence, a.label = b.label AS same_label
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def semantic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next one."""
    e = table(spark, sf_dir, "embeddings")
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label")), "vec_id")
    return pair.select("vec_id", rounded(compare.cosine_distance(F.col("embedding"), F.col("other"))).alias("divergence"), (F.col("label") == F.col("other_label")).alias("same_label"))


_SEARCH_SQL = f"""n AS (SELECT doc_id, {_N_SQL} AS n FROM documents),
    t AS (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN n % 4 > 0 END AS cleared, (n % 10) / 10.0::DOUBLE AS level, (n % 37) / 37.0::DOUBLE AS semantic_divergence, (n % 41) / 41.0::DOUBLE AS lexical_divergence, (n % 7) / 7.0::DOUBLE AS margin, CASE WHEN doc_id % 9 > 0 THEN 3 ELSE 0 END AS attempts,
        CASE WHEN doc_id % 9 = 0 THEN ['reason ' || (doc_id % 2)] WHEN doc_id % 10 = 1 THEN ['identical watermarked generation of ' || doc_id] ELSE [] END AS notes FROM n)"""


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("n"), F.col("doc_id")
    of = lambda k, by: F.pmod(n, F.lit(k)) / float(by)
    base = table(spark, sf_dir, "documents").select("doc_id", tokens.word_count(F.coalesce("text", F.lit(""))).alias("n"))
    notes = F.when(d % 9 == 0, F.array(F.concat(F.lit("reason "), (d % 2).cast("string")))).when(d % 10 == 1, F.array(F.concat(F.lit("identical watermarked generation of "), d.cast("string")))).otherwise(F.array().cast("array<string>"))
    return base.select("doc_id", F.when(d % 9 > 0, n % 4 > 0).alias("cleared"), of(10, 10).alias("level"), of(37, 37).alias("semantic_divergence"), of(41, 41).alias("lexical_divergence"), of(7, 7).alias("margin"), F.when(d % 9 > 0, 3).otherwise(0).alias("attempts"), notes.alias("notes"))


@query(f"""WITH {_SEARCH_SQL} SELECT count(cleared) AS n_samples, count(*) FILTER (WHERE cleared) AS n_cleared, count(*) FILTER (WHERE cleared IS NULL AND attempts = 0) AS n_excluded, count(*) FILTER (WHERE len(notes) > 0 AND notes[1] LIKE 'identical watermarked generation%') AS n_duplicate_generations,
    round(avg(level) FILTER (WHERE cleared), 4) AS mean_min_level, round(median(level) FILTER (WHERE cleared), 4) AS median_min_level, round(avg(semantic_divergence) FILTER (WHERE cleared), 4) AS mean_min_semantic_divergence, round(median(semantic_divergence) FILTER (WHERE cleared), 4) AS median_min_semantic_divergence,
    round(avg(lexical_divergence) FILTER (WHERE cleared), 4) AS mean_min_lexical_divergence, round(avg(margin) FILTER (WHERE cleared), 4) AS mean_min_margin, round(count(*) FILTER (WHERE cleared) / count(cleared), 4) AS clear_rate FROM t""")
def minimal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.minimal_summary(_search(spark, sf_dir))
    return out.withColumns({c: rounded(F.col(c), 4) for c in out.columns if c.startswith(("mean", "median", "clear"))})


@query(f"WITH {_SEARCH_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(notes) AS reason FROM t WHERE cleared IS NULL AND attempts = 0) GROUP BY reason")
def excluded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.excluded_reasons(_search(spark, sf_dir))


_VARIANTS = [("control", "control"), ("layer-a", "layer-a"), ("rewrite-0.5", "rewrite"), ("restamp", "restamp")]


@query(f"""WITH v(variant, kind) AS (VALUES {', '.join(f"('{v}', '{k}')" for v, k in _VARIANTS)}), s AS (SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 50 THEN 'too short' WHEN doc_id % 8 = 0 THEN 'not detected' END AS reason FROM documents)
    SELECT doc_id, variant, kind, coalesce(reason, '') AS note FROM s, v""")
def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts and those that a gate doesn't pass stay in the table, excluded."""
    short = F.length(F.trim(F.coalesce("text", F.lit("")))) < 50
    samples = table(spark, sf_dir, "documents").select("doc_id", F.when(short, "too short").when(F.col("doc_id") % 8 == 0, "not detected").alias("excluded_reason"))
    return evaluation.variant_rows(samples, _VARIANTS).select("doc_id", "variant", "kind", F.array_join("notes", "; ").alias("note"))


@query(f"""WITH {_ROWS_SQL} SELECT variant AS strategy, count(*) AS n, round(avg(cleared::INT), 6) AS clear_rate, round(avg((cleared AND margin >= 0.1)::INT), 6) AS robust_clear_rate, round(avg(score_before), 6) AS sem_div, round(avg(score_after), 6) AS human_like
    FROM r WHERE before_pos AND score_after IS NOT NULL GROUP BY variant""")
def strategy_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumns({"strategy": F.col("variant"), "robust_cleared": F.col("cleared") & (F.col("margin") >= 0.1), "sem_div": F.col("score_before"), "human_like": F.col("score_after")})
    out = evaluation.strategy_axes(rows)
    return out.withColumns({c: rounded(F.col(c)) for c in ("clear_rate", "robust_clear_rate", "sem_div", "human_like")})


@query(f"""WITH {_ROWS_SQL}, p AS (SELECT doc_id, score_after AS s, CASE doc_id % 3 WHEN 0 THEN 1e-6 WHEN 1 THEN 0.5 END::DOUBLE AS th, CASE WHEN doc_id % 11 <> 0 THEN score_after >= 0.5 END AS v FROM r), m AS (SELECT *, th - s AS raw, CASE WHEN NOT (NOT v AND th - s < 0) THEN th - s END AS margin FROM p)
    SELECT doc_id, CASE WHEN v IS NULL THEN NULL WHEN v THEN false WHEN margin IS NULL OR margin >= 0.2 THEN true END AS passed, round(margin, 4) AS margin FROM m""")
def candidate_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p-value as threshold for a third of the rows, none for another."""
    d = F.col("doc_id")
    threshold = F.when(d % 3 == 0, 1e-6).when(d % 3 == 1, 0.5)
    verdict = F.when(d % 11 != 0, F.col("score_after") >= 0.5)
    return _rows(spark, sf_dir).select("doc_id", evaluation.candidate_pass(verdict, F.col("score_after"), threshold, 0.2).alias("c")).select("doc_id", "c.*")


@query(f"""WITH {_ROWS_SQL}, g AS (SELECT source, doc_id, length(coalesce(text, '')) AS n, max(length(coalesce(text, ''))) OVER (PARTITION BY source) AS longest FROM documents),
    c AS (SELECT source, doc_id, (n % 100) / 100.0::DOUBLE - CASE WHEN longest > 0 AND (n / longest > 2 OR n / longest < 0.5) THEN 0.15::DOUBLE ELSE 0 END AS score FROM g)
    SELECT source, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS k FROM c) WHERE k = 1""")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's texts as rewrites of its longest one; the score is made from lengths."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    longest = docs.groupBy(F.col("source").alias("of")).agg(F.max(F.length("text")).alias("longest"))
    both = docs.join(longest, docs["source"].eqNullSafe(longest["of"])).withColumn("original", F.repeat(F.lit("x"), F.col("longest")))
    divergence = F.round(F.pmod(F.length("text"), F.lit(100)) / 100.0, 9)
    out = evaluation.select_candidate(both, ["source"], "original", "text", "doc_id", divergence)
    return out.select("source", "doc_id", rounded(F.col("score")).alias("score"))


@query(f"""WITH {_ROWS_SQL}, a AS (SELECT variant, count(*) AS n, avg(score_before) / 3 AS b, avg(score_after) FILTER (WHERE variant <> 'v2') / 3 AS m, bool_or(noop) AS noop FROM r GROUP BY variant)
    SELECT '| ' || variant || ' | ' || n || ' | ' || format('{{:.4f}}', b) || ' | ' || coalesce(format('{{:.4f}}', m), '—') || ' |' AS markdown, variant || ',' || n || ',' || noop::INT || ',' || CASE WHEN m IS NULL THEN '' ELSE {quoted('"a, ""b""' + '"')} END AS csv FROM a""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant table's lines, with a missing value and a text that needs quotes."""
    # Means near the middle of two shown values turn on the order of a sum's terms: it is that of the ids, however rows are dealt out.
    so_far = Window.partitionBy("variant").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = _rows(spark, sf_dir).withColumns({c: F.sum(f"score_{c}").over(so_far) for c in ("before", "after")})
    mean = lambda c: F.max(F.struct("doc_id", c))[c] / F.count(f"score_{c}") / 3
    a = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), mean("before").alias("b"), F.when(F.col("variant") != "v2", mean("after")).alias("m"), F.bool_or("noop").alias("noop"))
    a = a.withColumn("note", F.when(F.col("m").isNotNull(), 'a, "b"'))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[reports.markdown_value(a, c) for c in ("variant", "n", "b", "m")]), F.lit(" |"))
    return a.select(line.alias("markdown"), F.concat_ws(",", *[reports.csv_cell(a, c) for c in ("variant", "n", "noop", "note")]).alias("csv"))
