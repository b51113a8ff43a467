"""Keyed detection of statistical marks, and the registry of detectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions import stylometry, tokens

WINDOW, THRESHOLD = 4, 1e-6
RESULT = "struct<tokens_total:bigint,skipped_no_context:bigint,skipped_repeated:bigint,counted:bigint,statistic:double,p_value:double,score:double,is_watermarked:boolean>"
_RESULT = pa.struct([("tokens_total", pa.int64()), ("skipped_no_context", pa.int64()), ("skipped_repeated", pa.int64()), ("counted", pa.int64()), ("statistic", pa.float64()), ("p_value", pa.float64()), ("score", pa.float64()), ("is_watermarked", pa.bool_())])


def key_bytes(raw: str) -> bytes:
    """``0x`` and an even number of hexadecimal digits, or else the text's UTF-8."""
    digits = raw[2:] if raw[:2].lower() == "0x" else ""
    try:
        return bytes.fromhex(digits) if digits and len(digits) % 2 == 0 else raw.encode()
    except ValueError:
        return raw.encode()


#: ``lgamma(k + 1)`` by ``k``, as far as it was needed.
_LGAMMA: list[float] = []


def gamma_tail(n: int, s: float) -> float:
    """P(Gamma(n, 1) >= s), as a Poisson sum in logarithms."""
    if n <= 0 or s <= 0:
        return 1.0
    while len(_LGAMMA) < n:
        _LGAMMA.append(math.lgamma(len(_LGAMMA) + 1))
    log = math.log(s)
    terms = [k * log - s - g for k, g in zip(range(n), _LGAMMA)]
    top = max(terms)
    return min(1.0, max(0.0, math.exp(top + math.log(math.fsum(math.exp(t - top) for t in terms)))))


#: HMAC is written out over SHA-256, whose set-up is the cheaper one.
_INNER, _OUTER = bytes(x ^ 0x36 for x in range(256)), bytes(x ^ 0x5C for x in range(256))
_REST_INNER, _REST_OUTER = b"\x36" * 32, b"\x5c" * 32


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return block.translate(_INNER), block.translate(_OUTER)


def statistic(ids: list[int], key: bytes, window: int = WINDOW, threshold: float = THRESHOLD, mask_repeated: bool = True) -> dict:
    """Each window's uniform number comes from the key, the ids before, and the last id; marked texts have high ones."""
    octets, seen, total, counted, repeated = b"".join([int(i).to_bytes(8, "big") for i in ids]), set(), 0.0, 0, 0
    inner, outer = _pads(key)
    sha, log1p, number, before = hashlib.sha256, math.log1p, int.from_bytes, 8 * (window - 1)
    for k in range(window - 1, len(ids)):
        span = octets[8 * k - before : 8 * k + 8]
        if mask_repeated and span in seen:
            repeated += 1
            continue
        seen.add(span)
        seed = sha(outer + sha(inner + span[:-8]).digest()).digest()
        said = sha(seed.translate(_OUTER) + _REST_OUTER + sha(seed.translate(_INNER) + _REST_INNER + span[-8:]).digest()).digest()
        u = (number(said[:8], "big") + 0.5) / 2**64
        total -= log1p(-u) if u < 1 else -745.0
        counted += 1
    p = gamma_tail(counted, total)
    return {"tokens_total": len(ids), "skipped_no_context": min(len(ids), window - 1), "skipped_repeated": repeated, "counted": counted, "statistic": total, "p_value": p, "score": round(-math.log10(p), 6) if p > 0 else 300.0, "is_watermarked": p < threshold}


def _ids(lists: pa.Array) -> tuple[np.ndarray, list[int]]:
    """A code per token of all lists, and the id of each code."""
    flat = pc.dictionary_encode(lists.flatten())
    return flat.indices.to_numpy(zero_copy_only=False), [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in flat.dictionary.to_pylist()]


def keyed_tokens(key: str, window: int = WINDOW, threshold: float = THRESHOLD):
    """``keyed`` over arrays of tokens: the ids are made here, each distinct token hashed once a batch."""
    secret = key_bytes(key)

    @F.arrow_udf(RESULT)
    def of(lists: pa.Array) -> pa.Array:
        codes, ids = _ids(lists)
        out, at = [], 0
        for n in pc.list_value_length(lists).to_pylist():
            out.append(None if n is None else statistic([ids[k] for k in codes[at : at + n].tolist()], secret, window, threshold))
            at += n or 0
        return pa.array(out, _RESULT)

    return of


def keyed(key: str, window: int = WINDOW, threshold: float = THRESHOLD):
    """An Arrow function from arrays of token ids to results; null for null."""
    secret = key_bytes(key)

    @F.arrow_udf(RESULT)
    def of(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else statistic(x, secret, window, threshold) for x in ids.to_pylist()], _RESULT)

    return of


#: Tokens that are counted at a time: arrays over them are what a worker holds.
TOKENS = 1 << 20


def _counted(lists: pa.ListArray, window: int) -> np.ndarray:
    """``(tokens, windows, distinct windows)`` of each list of tokens; equal ids count as equal tokens."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, ids = _ids(lists)
    codes = np.unique(np.array(ids, np.uint64), return_inverse=True)[1][codes] if len(codes) else codes
    spans = np.maximum(sizes - window + 1, 0)
    of = np.repeat(np.arange(len(sizes)), spans)
    ends = np.cumsum(sizes)
    at = np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(ends - sizes, spans)
    keys = of
    for k in range(window):  # equal so far, and equal here
        keys = np.unique(keys * (len(ids) + 1) + codes[at + k], return_inverse=True)[1] if len(at) else keys
    first = np.unique(keys, return_index=True)[1]
    return np.stack([sizes, spans, np.bincount(of[first], minlength=len(sizes))], axis=1)


def token_counts(lists: pa.Array, window: int) -> pa.Array:
    upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(upto // TOKENS)) + 1).tolist(), len(lists)]
    n = np.concatenate([_counted(lists[a:b], window) for a, b in zip(cuts, cuts[1:])]) if len(lists) else np.zeros((0, 3), np.int64)
    columns = {"tokens_total": n[:, 0], "skipped_no_context": np.minimum(n[:, 0], window - 1), "skipped_repeated": n[:, 1] - n[:, 2], "counted": n[:, 2]}
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns), mask=pc.is_null(lists))


def token_counters(words: Column, window: int = WINDOW) -> Column:
    """``counters`` of the ids of arrays of tokens: each distinct token is hashed once a batch, and windows are numbered by sorting."""

    @F.arrow_udf("struct<tokens_total:bigint,skipped_no_context:bigint,skipped_repeated:bigint,counted:bigint>")
    def of(lists: pa.Array) -> pa.Array:
        return token_counts(lists, window)

    return of(words)


def counters(ids: Column, window: int = WINDOW) -> Column:
    """What ``keyed`` counts, by built-in functions: ``struct<tokens_total,skipped_no_context,skipped_repeated,counted>``."""
    return tokens.let(ids, lambda x: _counters(x, window))


def _counters(ids: Column, window: int) -> Column:
    n = F.size(ids)
    spans = F.when(n >= window, F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda k: F.array_join(F.slice(ids, k, F.lit(window)).cast("array<string>"), " "))).otherwise(F.array().cast("array<string>"))
    distinct = F.size(F.array_distinct(spans))
    return F.struct(n.cast("long").alias("tokens_total"), F.least(n, F.lit(window - 1)).cast("long").alias("skipped_no_context"), (F.size(spans) - distinct).cast("long").alias("skipped_repeated"), distinct.cast("long").alias("counted"))


#: Name to a function from (docs, id column, text column) to ``(id, detector, available, is_watermarked, score, error)``.
DETECTORS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}


def detector(name: str):
    def add(f):
        DETECTORS[name] = f
        return f

    return add


def _row(id_col: str, name: str, available: bool, marked: Column, score: Column, error: str | None) -> list[Column]:
    return [F.col(id_col), F.lit(name).alias("detector"), F.lit(available).alias("available"), marked.alias("is_watermarked"), score.alias("score"), F.lit(error).cast("string").alias("error")]


@detector("stylometry")
def _stylometry(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    scored = stylometry.with_stylometry(docs.select(id_col, F.col(text_col).alias("text")))
    return scored.select(*_row(id_col, "stylometry", True, F.col("score") >= stylometry.HIGH, F.col("score"), None))


@detector("keyed-gumbel")
def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = docs.sparkSession.conf.get("spark.glyphsieve.gumbel.key", None)
    if not key:
        return docs.select(*_row(id_col, "keyed-gumbel", False, F.lit(None).cast("boolean"), F.lit(None).cast("double"), "no key"))
    found = docs.select(id_col, keyed_tokens(key)(tokens.simple_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("r"))
    return found.select(*_row(id_col, "keyed-gumbel", True, F.col("r.is_watermarked"), F.col("r.score"), None))


@detector("proprietary")
def _none(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_row(id_col, "proprietary", False, F.lit(None).cast("boolean"), F.lit(None).cast("double"), "no public detector"))


def run_detectors(docs: DataFrame, id_col: str, text_col: str = "text", only_available: bool = False) -> DataFrame:
    """All detectors' rows one below the other; unavailable ones can be left out."""
    parts = [f(docs, id_col, text_col) for f in DETECTORS.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("available") if only_available else out
