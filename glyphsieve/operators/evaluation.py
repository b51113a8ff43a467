"""Evaluation of detectors and rewrites: AUROC, variant tables, least levels, frontiers, holdouts and verdicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS = 4096


def running(rows: DataFrame, group: str, key: str, value: str, name: str = "below") -> DataFrame:
    """``rows``, whose ``(group, key)`` don't repeat, with the sum of ``value`` over the group's smaller keys.

    Sums go in two levels: keys fall into ``BUCKETS`` equal ranges between the group's least and largest, sums of ranges are added
    up per group, those of keys per range. So a task holds the keys of one range, not of a group.
    """
    of = rows.groupBy(F.col(group).alias("__g")).agg(F.min(key).cast("double").alias("__low"), F.max(key).cast("double").alias("__high"))
    part = F.coalesce(F.least(F.lit(BUCKETS - 1), F.floor(F.try_divide(F.col(key).cast("double") - F.col("__low"), F.col("__high") - F.col("__low")) * BUCKETS)), F.lit(0)).cast("int")
    dealt = rows.join(of, rows[group].eqNullSafe(of["__g"])).withColumn("__part", part).drop("__g", "__low", "__high")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before("__g").orderBy("__p")), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(value).over(before(group, "__part").orderBy(key)), F.lit(0))
    both = dealt.withColumn("__inside", inside).join(sums, dealt[group].eqNullSafe(sums["__g"]) & (F.col("__part") == F.col("__p")))
    return both.withColumn(name, F.col("__base") + F.col("__inside")).drop("__part", "__p", "__g", "__base", "__inside")


def auroc(rows: DataFrame, group: str, score: str, positive: str) -> DataFrame:
    """``(group, n_pos, n_neg, auroc)``: Mann-Whitney with mid-ranks for ties; null where one side is empty.

    Rows with a null score or label don't count. Equal scores are added up first, so sums run over distinct scores.
    """
    used = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    ties = used.groupBy(group, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    out = running(ties, group, score, "n").withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2)).groupBy(group).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum("won").alias("won"))
    return out.select(group, "n_pos", "n_neg", F.try_divide("won", F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def upper_median(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``(group, name)``: the middle of the group's sorted values, the upper one of two; groups without values are left out."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("k"))
    total = counted.groupBy(F.col(group).alias("__t")).agg(F.floor(F.sum("k") / 2).alias("half"))
    found = running(counted, group, value, "k").join(total, F.col(group).eqNullSafe(F.col("__t"))).where("below <= half AND half < below + k")
    return found.select(group, F.col(value).alias(name))


def variant_summary(rows: DataFrame) -> DataFrame:
    """A row per ``variant`` of ``(variant, before_pos, after_pos, cleared, noop, score_before, score_after, margin)``."""
    measured = F.when(F.col("score_before").isNotNull() & F.col("score_after").isNotNull(), F.col("score_before") - F.col("score_after"))
    rows = rows.withColumn("delta", measured)
    out = rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("before_pos").alias("before_pos"), F.count_if("after_pos").alias("after_pos"), F.count_if(F.col("before_pos") & F.col("cleared")).alias("cleared"), F.count_if("noop").alias("noop_n"),
        F.avg("score_before").alias("mean_before"), F.avg("score_after").alias("mean_after"), F.avg("margin").alias("mean_margin"),
    )
    out = out.join(upper_median(rows, "variant", "delta", "median_delta"), "variant", "left")
    return out.withColumn("clear_rate", F.try_divide(F.col("cleared"), F.col("before_pos")))


def minimal_levels(attempts: DataFrame) -> DataFrame:
    """``(doc, seed, min_level, attempt, divergence)``: the least level that clears, and of its clearing attempts the one that diverges least."""
    clear = attempts.where("cleared").groupBy("doc", "seed", "level").agg(F.min(F.struct("divergence", "attempt")).alias("best"))
    least = clear.groupBy("doc", "seed").agg(F.min(F.struct("level", "best")).alias("x"))
    every = attempts.groupBy("doc", "seed").agg(F.count(F.lit(1)).alias("attempts"))
    return every.join(least, ["doc", "seed"], "left").select("doc", "seed", "attempts", F.col("x.level").alias("min_level"), F.col("x.best.attempt").alias("attempt"), F.col("x.best.divergence").alias("divergence"))


def minimal_summary(rows: DataFrame) -> DataFrame:
    """One row over ``(level, cleared, semantic_divergence, lexical_divergence, margin, attempts, notes)`` of a search for the least level.

    Rows with a verdict are evaluated ones, those without any attempt excluded ones. Medians are true ones; without values they are null.
    """
    done = lambda c: F.when(F.col("cleared"), F.col(c))
    repeated = F.sum(F.size(F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda x: x.startswith("identical watermarked generation"))))
    out = rows.agg(
        F.count("cleared").alias("n_samples"), F.count_if("cleared").alias("n_cleared"), F.count_if(F.col("cleared").isNull() & (F.coalesce("attempts", F.lit(0)) == 0)).alias("n_excluded"), F.coalesce(repeated, F.lit(0)).cast("long").alias("n_duplicate_generations"),
        F.avg(done("level")).alias("mean_min_level"), F.percentile(done("level"), F.lit(0.5)).alias("median_min_level"), F.avg(done("semantic_divergence")).alias("mean_min_semantic_divergence"), F.percentile(done("semantic_divergence"), F.lit(0.5)).alias("median_min_semantic_divergence"),
        F.avg(done("lexical_divergence")).alias("mean_min_lexical_divergence"), F.avg(done("margin")).alias("mean_min_margin"),
    )
    return out.withColumn("clear_rate", F.try_divide(F.col("n_cleared"), F.col("n_samples")))


def excluded_reasons(rows: DataFrame) -> DataFrame:
    """``(reason, n)`` of the notes of excluded rows."""
    return rows.where("cleared IS NULL AND coalesce(attempts, 0) = 0").select(F.explode("notes").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def variant_rows(samples: DataFrame, variants: list[tuple[str, str]]) -> DataFrame:
    """A row per sample and ``(variant, kind)``; excluded samples (``excluded_reason``) keep their rows, with the reason as a note."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("kind")) for v, k in variants])).alias("v")
    note = F.when(F.col("excluded_reason").isNotNull(), F.array("excluded_reason")).otherwise(F.array().cast("array<string>"))
    return samples.select("*", each).select(*[c for c in samples.columns if c != "excluded_reason"], "v.variant", "v.kind", note.alias("notes"))


def strategy_axes(rows: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Per strategy over samples that were positive before and have a report after: rates of clearing and of clearing with a margin, and mean distances."""
    used = rows.where("before_pos AND cleared IS NOT NULL")
    return used.groupBy(strategy).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("cleared").cast("double")).alias("clear_rate"), F.avg(F.coalesce("robust_cleared", F.lit(False)).cast("double")).alias("robust_clear_rate"), F.avg("sem_div").alias("sem_div"), F.avg("human_like").alias("human_like"))


def candidate_pass(verdict: Column, score: Column, threshold: Column, target: float) -> Column:
    """``struct<passed,margin>``: passed if the text isn't marked and its margin is ``target`` at least, or can't be measured because the threshold
    is a p-value below the score; false if marked; null without a verdict or with too small a margin."""
    raw = threshold.cast("double") - score.cast("double")
    scaled = F.when(raw.isNotNull() & ~(~verdict & (raw < 0)), raw)
    passed = F.when(verdict.isNull(), F.lit(None)).when(verdict, False).when(scaled.isNull() | (scaled >= target), True)
    return F.struct(passed.cast("boolean").alias("passed"), F.round(scaled, 4).alias("margin"))


def select_candidate(rows: DataFrame, by: list[str], original: str, text: str, position: str, divergence: Column) -> DataFrame:
    """Of the rewrites of a text the one that diverges most, less 0.15 where its length is over twice or under half; the first of equal ones."""
    ratio = F.try_divide(F.length(text), F.length(original))
    score = divergence - F.when((F.length(original) > 0) & ((ratio > 2) | (ratio < 0.5)), 0.15).otherwise(0.0)
    best = rows.withColumn("score", score).groupBy(*by).agg(F.max(F.struct("score", (-F.col(position)).alias("late"), F.col(text).alias("text"))).alias("best"))
    return best.select(*by, F.col("best.text").alias(text), F.col("best.score").alias("score"), (-F.col("best.late")).alias(position))


def pareto_frontier(candidates: DataFrame, name: str, up: list[str], down: list[str]) -> DataFrame:
    """The candidates that none beats on all axes; those with a null axis are left out.

    Each task keeps its own frontier; only these rows meet, behind an exchange, in the task that takes the frontier of all.
    """
    signs = {c: 1 for c in up} | {c: -1 for c in down}
    axes = list(signs)

    def skyline(frames):
        kept: pd.DataFrame | None = None
        for frame in frames:
            both = frame if kept is None else pd.concat([kept, frame], ignore_index=True)
            points = both[axes].to_numpy(float) * [signs[c] for c in axes]
            order = (-points.sum(axis=1)).argsort(kind="stable")
            alive = np.empty((0, len(axes)))
            rows: list[int] = []
            for k in order:  # whoever beats a point has a larger sum
                if not ((alive >= points[k]).all(axis=1) & (alive > points[k]).any(axis=1)).any():
                    alive = np.vstack([alive, points[k]])
                    rows.append(int(k))
            kept = both.iloc[sorted(rows)]
        if kept is not None:
            yield kept

    used = candidates.select(name, *axes).where(" AND ".join(f"{c} IS NOT NULL" for c in axes))
    return used.mapInPandas(skyline, used.schema).repartition(1).mapInPandas(skyline, used.schema)


def weighted_score(robust: Column, semantic: Column, human: Column, weights: tuple[float, float, float]) -> Column:
    """Null if any axis is."""
    return weights[0] * robust + weights[1] * (1 - semantic) + weights[2] * human


def ranked(candidates: DataFrame, score: Column, order: str, least: Column | None = None, floor: float = 0.0) -> DataFrame:
    """Candidates of enough coverage with their rank by score, ties in ``order``. One row per strategy: a report, not a table."""
    used = candidates if least is None else candidates.where(least >= floor - 1e-9)
    return used.withColumn("score", score).where("score IS NOT NULL").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), order)).cast("long"))


def nth_smallest(names: DataFrame, name: str, k: int) -> str | None:
    """The ``k``-th of the distinct strings in code point order, from counts by prefix: nothing is sorted but the prefixes' next two signs."""
    prefix = ""
    while True:
        below = names.where(F.col(name).startswith(prefix)) if prefix else names
        counted = below.groupBy(F.substring(name, len(prefix) + 1, 2).alias("next")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("least"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.orderBy("next")))
        found = upto.where(F.col("upto") >= k).orderBy("next").first()
        if not found or not found["next"] or found["n"] == 1:
            return found and found["least"]
        prefix, k = prefix + found["next"], k - (found["upto"] - found["n"])


def holdout_split(samples: DataFrame, doc: str, fraction: float) -> DataFrame:
    """``samples`` with ``train``: true for the first share of the documents (strings) in order, one at least; null for null."""
    docs = samples.select(doc).where(F.col(doc).isNotNull()).distinct()
    cut = nth_smallest(docs, doc, max(1, round(docs.count() * fraction)))
    return samples.withColumn("train", F.col(doc) <= F.lit(cut))


def strategy_verdict(strategies: DataFrame) -> DataFrame:
    """One row: the best robust rate over strategies with a removal step, and what it says."""
    best = strategies.where("removal").agg(F.max("robust_rate").alias("best"))
    return best.select("best", F.when(F.col("best").isNull(), "undetermined").when(F.col("best") <= 0, "resists").when(F.col("best") < 1, "partial").otherwise("removable").alias("verdict"))


def repeated_generations(rows: DataFrame, doc: str, seed: str, text: str) -> DataFrame:
    """``rows`` with ``duplicate``: the same text came from a smaller seed of the document; a null seed is the least. Rows that repeat
    the least seed are no duplicates."""
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    at = F.struct(F.col(seed).isNotNull(), F.col(seed))
    least = rows.groupBy(F.col(doc).alias("__d"), key.alias("__k")).agg(F.min(at).alias("__least"))
    return rows.join(least, rows[doc].eqNullSafe(F.col("__d")) & (key == F.col("__k"))).withColumn("duplicate", at > F.col("__least")).drop("__d", "__k", "__least")
