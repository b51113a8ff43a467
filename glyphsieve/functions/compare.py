"""How far two texts or vectors are from each other, and what a rewrite preserves, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, tokens


def set_divergence(x: Column, y: Column) -> Column:
    """One less the Jaccard similarity of two sets; 0 if neither has any member, 1 if one has none."""
    both, any_ = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 0.0).when((F.size(x) == 0) | (F.size(y) == 0), 1.0).otherwise(1.0 - both / any_)


def lexical_divergence(a: Column, b: Column) -> Column:
    """The divergence of the texts' sets of word pairs."""
    return set_divergence(tokens.bigrams(tokens.plain_words(a)), tokens.bigrams(tokens.plain_words(b)))


def preserved(a: Column, b: Column, pattern: str) -> Column:
    """Share of the distinct matches in ``a`` that ``b`` has, too; 1 if ``a`` has none."""
    of = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    return F.when(F.size(of(a)) == 0, 1.0).otherwise(F.size(F.array_intersect(of(a), of(b))) / F.size(of(a)))


def numbers_preserved(a: Column, b: Column) -> Column:
    return preserved(a, b, "[0-9]+")


def urls_preserved(a: Column, b: Column) -> Column:
    return preserved(a, b, r"https?://\S+")


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine of two arrays of numbers; null if either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1.0 - dot(a, b) / norm)


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’“”", "''\"\"")


def swap_phrases(text: Column) -> Column:
    """Wordy phrases by short ones; the first letter's case stays, and a phrase in capitals gives one in capitals.

    A regular expression runs only on texts that hold its phrase.
    """

    def swap(old: str, new: str):
        return lambda t: F.when(F.contains(t, F.lit(old)), F.regexp_replace(t, F.lit(rf"\b{old}\b"), F.lit(new))).otherwise(t)

    for phrase, short in (fixed.PHRASE_SWAPS | fixed.WORD_SWAPS).items():
        for old, new in ((phrase.upper(), short.upper()), (phrase[0].upper() + phrase[1:], short[0].upper() + short[1:]), (phrase, short)):
            text = tokens.let(text, swap(old, new))
    return text


def plain_dashes(text: Column) -> Column:
    """Dashes between words become commas; ranges of numbers and options of commands keep theirs."""
    held = F.regexp_replace(text, r"(?<=[0-9])(\s*)[–—](\s*)(?=[0-9])", "$1\u0001$2")
    held = F.regexp_replace(held, r"\s*[–—]\s*", ", ")
    return F.translate(F.regexp_replace(held, r"(?<=\w)\s*--\s*(?=\w)(?<!\s--)|(?<=\w) -- (?=\w)", ", "), "\u0001", "–")


def humanize(text: Column) -> Column:
    """Straight quotes, plain dashes, short phrases."""
    return swap_phrases(plain_dashes(straight_quotes(text)))


def spread_indices(total: Column, k: Column) -> Column:
    """``k`` indices spread evenly over ``total``, first and last among them."""
    one = F.sequence(F.lit(0), F.greatest(F.least(k, total), F.lit(1)) - 1)
    return F.when((total < 1) | (k < 1), F.array().cast("array<int>")).when(k == 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(one, lambda i: F.bround(i * (total - 1) / (F.least(k, total) - 1)).cast("int"))))


def frame_plan(total: Column, threshold: float = 0.5, fraction: float = 1.0) -> Column:
    """``struct<n,indices>``: how many of ``total`` frames leave less than ``threshold`` of them as they were, ``fraction`` at least, and which."""
    least = F.floor(total * (1 - threshold)) + 1
    n = F.least(total, F.greatest(least, F.ceil(total * min(1.0, fraction)))).cast("int")
    return F.struct(n.alias("n"), spread_indices(total, n).alias("indices"))


def threshold_of(config: Column) -> Column:
    """The first number among a JSON configuration's ``threshold`` and ``z_threshold``; texts and booleans are none."""
    number = lambda k: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(config), k, "variant")).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), F.try_variant_get(F.try_parse_json(config), k, "double"))
    return F.coalesce(number("$.threshold"), number("$.z_threshold"))


def pixel_verdict(reply: Column) -> Column:
    """Whether a scorer's JSON reply calls a picture marked: it must be available, and say so or be half sure at least."""
    v = lambda k, t: F.try_variant_get(F.try_parse_json(reply), k, t)
    sure = F.when(F.schema_of_variant(v("$.confidence", "variant")).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT"), v("$.confidence", "double"))
    flag = lambda k: F.coalesce(F.get_json_object(reply, k) == "true", F.lit(False))
    return flag("$.available") & (flag("$.is_watermarked") | F.coalesce(sure >= 0.5, F.lit(False)))


def pitch_factor(semitones: Column) -> Column:
    return F.pow(F.lit(2.0), semitones / 12.0)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
