"""Stylometry: cadence, diversity and formulaic phrases of a text, and the score made of them."""

from __future__ import annotations

from functools import reduce
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import fixed, tokens

HIGH, MEDIUM = 0.65, 0.40
LEAST_WORDS, FULL_WORDS, WINDOW = 30, 100, 50

#: ``(label, weight, regular expression)``; ``\\w`` is spelled out, as Java's is ASCII only.
PHRASES = [(label, weight, "(?i)" + pattern.replace(r"\w", r"\p{L}\p{N}_")) for pattern, label, weight in fixed.PHRASES]


def anchors(pattern: str) -> list[str]:
    """Literals of which every match holds one, in lower case: the longest that the pattern asks for."""

    def walk(tree) -> list[str] | None:
        found, run = [], ""
        for op, arg in [*tree, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(arg).lower()
                continue
            if run:
                found.append([run])
                run = ""
            if op is _parser.SUBPATTERN:
                found.append(walk(arg[3]))
            elif op is _parser.MAX_REPEAT and arg[0] > 0:
                found.append(walk(arg[2]))
            elif op is _parser.BRANCH:
                every = [walk(x) for x in arg[1]]
                found.append([a for x in every for a in x] if all(every) else None)
        return max((x for x in found if x), key=lambda x: min(map(len, x)), default=None)

    return walk(_parser.parse(pattern)) or [""]


def counted(text: Column, low: Column, pattern: str) -> Column:
    """Matches of a phrase; the regular expression runs only on texts that hold one of its literals."""
    plain = pattern.removeprefix("(?i)").replace(r"\p{L}\p{N}_", r"\w")
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in anchors(plain)]), F.regexp_count(text, F.lit(pattern))).otherwise(0)


def found(text: Column, low: Column, pattern: str) -> Column:
    """The matches of a phrase, null if none of its literals occurs."""
    plain = pattern.removeprefix("(?i)").replace(r"\p{L}\p{N}_", r"\w")
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in anchors(plain)]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def phrase_hits(text: Column) -> Column:
    """``array<struct<phrase,weight,count,samples>>`` of the phrases that occur."""

    def row(label: str, weight: float, matches: Column) -> Column:
        held = lambda m: F.struct(F.lit(label).alias("phrase"), F.lit(float(weight)).alias("weight"), F.coalesce(F.size(m), F.lit(0)).cast("long").alias("count"), F.slice(m, 1, 3).alias("samples"))
        return tokens.let(matches, lambda m: held(m))

    def rows(t: Column) -> Column:
        return F.array(*[row(label, weight, found(t["text"], t["low"], pattern)) for label, weight, pattern in PHRASES])

    return F.filter(tokens.let(F.struct(text.alias("text"), F.lower(text).alias("low")), rows), lambda r: r["count"] > 0)


def phrase_weight(text: Column) -> Column:
    """Sum of count times weight: one expression, no arrays."""

    def total(t: Column) -> Column:
        out = F.lit(0.0)
        for _, weight, pattern in PHRASES:
            out = out + counted(t["text"], t["low"], pattern) * F.lit(float(weight))
        return out

    return tokens.let(F.struct(text.alias("text"), F.lower(text).alias("low")), total)


def sentence_lengths(sentences: Column) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(sentences, tokens.word_count), lambda n: n > 0)


def _mean(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n) / F.size(numbers)).otherwise(F.lit(0.0))


def cadence(lengths: Column) -> Column:
    """``struct<mean,deviation,cv>``; the coefficient of variation is null below two sentences."""
    mean = _mean(lengths)
    squares = tokens.let(F.struct(lengths.alias("n"), mean.alias("mean")), lambda x: F.aggregate(x["n"], F.lit(0.0), lambda a, n: a + (n - x["mean"]) * (n - x["mean"])))
    deviation = F.when(F.size(lengths) > 1, F.sqrt(squares / (F.size(lengths) - 1))).otherwise(F.lit(0.0))
    return F.struct(mean.alias("mean"), deviation.alias("deviation"), F.when(F.size(lengths) > 1, deviation / mean).alias("cv"))


@F.arrow_udf(DoubleType())
def mattr(words: pa.Array) -> pa.Array:
    """Mean share of distinct words over all windows of fifty words; of a shorter text, the share in all of it.

    A word at ``i`` that last stood at ``p`` is new in the windows that start after ``p`` and hold ``i``; adding up how many these are takes
    one pass, whatever the window's size.
    """
    flat, out = pc.dictionary_encode(words.flatten()), []
    codes = flat.indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    at = 0
    for n, valid in zip(pc.list_value_length(words).to_pylist(), words.is_valid().to_pylist(), strict=True):
        if not valid:
            out.append(None)
            continue
        ids = codes[at : at + n].astype(np.int64)
        at += n
        if n <= WINDOW:
            out.append(len(np.unique(ids)) / n if n else 0.0)
            continue
        order = np.argsort(ids, kind="stable")
        before = np.full(n, -1)
        same = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        i = np.arange(n)
        new = np.minimum(i, n - WINDOW) - np.maximum(np.maximum(before + 1, i - WINDOW + 1), 0) + 1
        out.append(float(np.maximum(new, 0).sum()) / WINDOW / (n - WINDOW + 1))
    return pa.array(out, pa.float64())


def _bands(value: Column, bands: list[tuple[float, float]], rest: float, up: bool = False) -> Column:
    out = F.when(F.lit(False), 0.0)
    for edge, score in bands:
        out = out.when(value >= edge if up else value < edge, score)
    return out.otherwise(rest)


def tier(score: Column) -> Column:
    return F.when(score.isNull(), "uncalibrated").when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def confidence(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(None).cast("string")).when(score >= 0.75, "HIGH").when(score >= 0.5, "MEDIUM").when(score >= 0.25, "LOW").otherwise("CLEAN")


def with_stylometry(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_sentences, mean_sentence, sentence_cv, mattr, phrase_density, score, tier, confidence``.

    Texts of fewer than 30 words have a null score (``uncalibrated``) and phrase density 0; a null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("__w", tokens.words(text)).withColumn("__s", tokens.sentences(text)).withColumn("__c", tokens.let(sentence_lengths(F.col("__s")), cadence))
    base = base.withColumn("n_words", F.size("__w").cast("long")).withColumn("n_sentences", F.size("__s").cast("long"))
    enough = F.col("n_words") >= LEAST_WORDS
    base = base.withColumn("mattr", mattr("__w")).withColumn("phrase_density", F.when(enough, phrase_weight(text) / (F.col("n_words") / 100)).otherwise(0.0))
    cv, density = F.col("__c.cv"), F.col("phrase_density")
    uniform = _bands(cv, [(0.25, 0.95), (0.35, 0.80), (0.45, 0.50), (0.55, 0.25)], 0.05)
    formulaic = F.when(density <= 0, 0.0).otherwise(_bands(density, [(2.0, 1.0), (1.0, 0.75), (0.5, 0.45)], 0.20, up=True))
    flat = F.when(F.col("mattr").between(0.68, 0.76), 0.4).otherwise(0.1)
    raw = F.when(cv.isNull(), (0.45 * formulaic + 0.10 * flat) / 0.55).otherwise(0.45 * uniform + 0.45 * formulaic + 0.10 * flat)
    damped = raw * F.when(F.col("n_words") < FULL_WORDS, 0.4 + 0.6 * (F.col("n_words") - LEAST_WORDS) / (FULL_WORDS - LEAST_WORDS)).otherwise(1.0)
    score = F.when(enough, F.least(F.lit(1.0), F.greatest(F.lit(0.0), damped)))
    out = base.withColumn("mean_sentence", F.col("__c.mean")).withColumn("sentence_cv", cv).withColumn("score", score)
    return out.withColumn("tier", tier(F.col("score"))).withColumn("confidence", confidence(F.col("score"))).drop("__w", "__s", "__c")


def human_likeness(score: Column) -> Column:
    """What is left of 1 by the style's score; null for texts too short to score. Other scorers may take the place of ``score``."""
    return 1.0 - score
