"""N-gram tables of two corpora, log ratios between them, and scores of texts by these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.functions.tokens import let

ALPHA, EPSILON, TOP_K = 0.4, 1e-6, 50


def _cut(words: Column, context: int) -> Column:
    """An array of ``(ctx, tok)``, made in one go: rows of single tokens would each carry or look into the whole text's words."""

    def rows(w: Column) -> Column:
        rest = F.greatest(F.size(w) - context, F.lit(0))
        before = F.slice(w, 1, rest) if context == 1 else F.transform(F.when(rest > 0, F.sequence(F.lit(1), F.greatest(rest, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(w, k, F.lit(context)), " "))
        return F.arrays_zip(before.alias("ctx"), F.slice(w, context + 1, rest).alias("tok"))

    return let(words, rows)


def pairs(docs: DataFrame, tokens: Column, context: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(ctx, tok)``: each token with the ``context`` tokens before it, joined by spaces."""
    return docs.select(*keep, F.explode(_cut(tokens, context)).alias("p")).select(*keep, F.col("p.ctx").alias("ctx"), F.col("p.tok").alias("tok"))


def counts(docs: DataFrame, tokens: Column, context: int = 1) -> DataFrame:
    """``(ctx, tok, n)``. Partial counts are made before the shuffle."""
    return pairs(docs, tokens, context).groupBy("ctx", "tok").agg(F.count(F.lit(1)).alias("n"))


def _all_counts(docs: DataFrame, tokens: Column, context: int) -> DataFrame:
    """``(ctx, tok, n)`` with an empty context for tokens at the beginning, so that every token is counted once. No column is nullable: joins ask for no more."""
    first = lambda w: F.transform(F.slice(w, 1, F.lit(context)), lambda t: F.struct(F.lit("").alias("ctx"), t.alias("tok")))
    cut = docs.select(F.explode(let(tokens, lambda w: F.concat(first(w), _cut(w, context)))).alias("p"))
    return cut.groupBy(F.coalesce("p.ctx", F.lit("")).alias("ctx"), F.coalesce("p.tok", F.lit("")).alias("tok")).agg(F.count(F.lit(1)).alias("n"))


def log_ratios(marked: DataFrame, base: DataFrame, tokens: Column, context: int = 1, alpha: float = ALPHA, min_context: int = 2) -> DataFrame:
    """``(ctx, tok, n, score)``: smoothed log probability in ``marked`` less that in ``base``.

    Contexts that ``marked`` has less than ``min_context`` times are left out. Where ``base`` never has a context, its unigrams stand in. Each
    corpus is split into tokens once; words, contexts and the vocabulary come from the counted pairs, whose exchange is reused. For that every
    use asks for the same columns and rows of it: conditions and constants below are worded such that they can't move behind the counts.
    """
    m_all, b_all = _all_counts(marked, tokens, context), _all_counts(base, tokens, context)
    held = F.when(F.col("n") > 0, F.col("ctx")) != ""
    m, b = m_all.where(held), b_all.where(held)
    unigrams = b_all.groupBy("tok").agg(F.sum("n").alias("u"))
    m_ctx = m.groupBy("ctx").agg(F.sum("n").alias("m_ctx")).where(F.col("m_ctx") >= min_context)
    b_ctx = b.groupBy("ctx").agg(F.sum("n").alias("b_ctx"))
    vocabulary = m_all.select("tok", (F.col("n") - F.col("n")).alias("n")).unionByName(b_all.select("tok", "n")).groupBy("tok").agg(F.sum("n").alias("n"))
    sizes = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("every"))  # one row
    rows = m.join(m_ctx, "ctx").join(b_ctx, "ctx", "left").join(b.withColumnRenamed("n", "b_n"), ["ctx", "tok"], "left").join(unigrams, "tok", "left").join(F.broadcast(sizes))
    smooth = lambda n, of: (F.coalesce(n, F.lit(0)) + alpha) / (of + alpha * F.col("v"))
    p, q = smooth(F.col("n"), F.col("m_ctx")), F.when(F.col("b_ctx").isNotNull(), smooth(F.col("b_n"), F.col("b_ctx"))).otherwise(smooth(F.col("u"), F.col("every")))
    return rows.select("ctx", "tok", "n", F.log((p + EPSILON) / (q + EPSILON)).alias("score"))


def top(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best tokens of each context, ties by token. A row limit by rank is pushed below the shuffle."""
    order = Window.partitionBy("ctx").orderBy(F.desc("score"), "tok")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def sequence_scores(docs: DataFrame, table: DataFrame, tokens: Column, id_col: str, context: int = 1) -> DataFrame:
    """``(id, hits, total, mean)`` of each document over the pairs that the table holds; documents without hits have nulls and 0."""
    seen = pairs(docs, tokens, context, (id_col,))
    found = seen.join(table.select("ctx", "tok", "score"), ["ctx", "tok"]).groupBy(id_col).agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("total"))
    return docs.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("hits", F.lit(0)).alias("hits"), "total", (F.col("total") / F.col("hits")).alias("mean"))
