r"""Words, sentences and token ids as columns.

``WORD`` gives the tokens of Python's ``\b[\w'-]+\b`` in Java, RE2 and Python alike: letters, numbers and the underscore, with
apostrophes and hyphens inside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
PLAIN_WORD = r"[\p{L}\p{N}_]+"
WORD_OR_SIGN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
_FENCED = r"(?m)^[ \t]*```[^\n]*\n(?s:.*?)(?:^[ \t]*```[^\n]*$|\z)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once; elsewhere a lambda evaluates what it refers to for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.transform(_all(text, WORD), F.lower)


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters, numbers and underscores."""
    return F.transform(_all(text, PLAIN_WORD), F.lower)


def words_and_signs(text: Column) -> Column:
    """Lower-case words, and each other sign by itself."""
    return F.transform(_all(text, WORD_OR_SIGN), F.lower)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sentences(text: Column) -> Column:
    """Sentences by end marks and line breaks, without fenced code and blank lines."""
    open_text = F.regexp_replace(text, _FENCED, "")
    return F.filter(F.transform(F.split(open_text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)  # a bare F.trim would take the place for the signs to trim


def units(text: Column) -> Column:
    """``array<struct<unit,separator>>``: the text cut at sentence ends and line breaks; both parts concatenated give it back."""
    pieces = _all(text, r"(?s).+?(?:(?<=[.!?])\s+|\n+|\z)")
    return F.transform(pieces, lambda p: F.struct(F.regexp_replace(p, r"((?<=[.!?])\s+|\n+)\z", "").alias("unit"), F.regexp_extract(p, r"((?<=[.!?])\s+|\n+)\z", 1).alias("separator")))


def bigrams(tokens: Column) -> Column:
    """The set of adjacent pairs."""
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at(w, i), F.try_element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(let(tokens, pairs))


def token_id(token: Column) -> Column:
    """The first eight bytes of a token's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def simple_tokens(text: Column) -> Column:
    """The runs of ASCII letters and digits."""
    return _all(F.lower(text), "[a-z0-9]+")


def simple_token_ids(text: Column) -> Column:
    """Ids of the runs of ASCII letters and digits."""
    return F.transform(simple_tokens(text), token_id)


def load_token_ids(raw: Column) -> Column:
    """Ids from a JSON array of numbers or from one number per line, ``0x`` ones included; null where one is out of range."""
    lines = F.filter(F.transform(F.split(raw, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda x: F.when(F.lower(x).startswith("0x"), F.conv(F.substring(x, 3, 100), 16, 10)).otherwise(x).try_cast("decimal(20,0)")
    ids = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<decimal(20,0)>")).otherwise(F.transform(lines, number))
    return F.when(F.forall(ids, lambda x: x.isNotNull() & (x >= 0) & (x <= F.lit("18446744073709551615").cast("decimal(20,0)"))), ids)


def estimate_tokens(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / F.lit(max(chars_per_token, 1.0))))
