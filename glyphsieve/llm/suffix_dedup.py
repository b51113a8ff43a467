r"""Removal of repeated byte strings by prefix-free parsing.

Two strings of ``length`` bytes are equal where two neighbours in the corpus order of suffixes share their first ``length``
bytes. That order is had from a parse:

1. *Parse.* A rolling hash over ``TRIGGER`` bytes picks triggers: in each window of ``length`` bytes the first position
   with the least hash. Every window holds a trigger, and equal windows hold theirs at the same place. Windows that
   share a trigger follow each other; together they read one *phrase* (they start at ``s..e``, the phrase ends at
   ``e + length``), so phrases overlap by ``length - 1`` bytes and no window is cut. Corpus order within ``length`` bytes hence
   never looks past a phrase: it is the order of the dictionary's suffixes, each standing for all of its phrase's occurrences.
2. *Dictionary.* Phrases are counted by (trigger, phrase) hashes, 128 bits: the parse's part of the order. All windows of a
   phrase that occurs twice are repeated. Inside a long repeated passage that settles every window with a row per trigger.
3. *Suffix array of the dictionary.* At the ends of passages phrases differ in part. Where a trigger has several phrases
   and one of them occurs once, the phrases meet by trigger, a suffix array to depth ``length`` is made of them, and windows that are
   equal to a neighbour in it are repeated. Suffixes under different triggers are never equal, so each trigger has an array of
   its own. Triggers with more than ``GROUP_LIMIT`` phrases spread their suffixes over all tasks, by hash.
4. The windows found are joined by document, their union is cut out.

Counting combines map-side first, so a passage in a third of all documents is a few rows per task. Texts are shuffled
only for documents that hold open phrases (step 3) or repeats (step 4); a broadcast filter of bounded size passes
all others by.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .filters import Filter

TRIGGER = 32
AT_ONCE = 1 << 20
#: Phrases of one trigger that a task compares by itself, 20 MB of them or so; beyond it their windows are counted over all tasks.
GROUP_LIMIT = 65_536
_INDEX = 24
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the ``TRIGGER`` bytes from each position on, by doubling."""
    h, n = _TABLE[data], 1
    with np.errstate(over="ignore"):
        while n < TRIGGER:
            h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
            n *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on, by doubling."""
    n, low = 1, key
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    return np.minimum(low[: len(key) - width + 1], low[width - n :]) if n < width else low


def _runs(data: np.ndarray, valid: np.ndarray | None, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, trigger position and trigger hash of each phrase in ``data``."""
    h = rolling(data)
    low = least((h & np.uint64(~((1 << _INDEX) - 1) & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), length - TRIGGER + 1)
    at = (low & np.uint64((1 << _INDEX) - 1)).astype(np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    if valid is not None:
        new[1:] |= valid[1:] & ~valid[:-1]
        end_of = ~valid
    starts = np.flatnonzero(new if valid is None else new & valid)
    stops = np.append(starts[1:], len(at)) - 1
    if valid is not None and len(starts):  # a run ends where windows stop being valid
        bad = np.append(np.flatnonzero(end_of), len(at))
        stops = np.minimum(stops, bad[np.searchsorted(bad, starts)] - 1)
    return starts, stops, at[starts], h[at[starts]].view(np.int64)


def phrases(texts: list[bytes], length: int):
    """For each text ``(s, e, trigger hash, phrase hash, trigger's place in the phrase)`` arrays; empty ones for texts shorter than ``length``."""
    none = (np.zeros(0, np.int64),) * 5
    out: list[tuple] = [none] * len(texts)
    group: list[int] = []

    def finish() -> None:
        sizes = [len(texts[k]) for k in group]
        joined = b"".join(texts[k] for k in group)
        edges = np.cumsum([0, *sizes])
        valid = np.ones(len(joined) - length + 1, bool)
        for edge in edges[1:-1]:
            valid[max(0, edge - length + 1) : edge] = False
        s, e, at, ah = _runs(np.frombuffer(joined, np.uint8), valid, length)
        seg = _digests(joined, s, e, length)
        cut = np.searchsorted(s, edges)
        for k, base, a, b in zip(group, edges.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=False):
            out[k] = (s[a:b] - base, e[a:b] - base, ah[a:b], seg[a:b], (at - s)[a:b])
        group.clear()

    held = 0
    for k, raw in enumerate(texts):
        if len(raw) < length:
            continue
        if len(raw) > AT_ONCE:
            out[k] = _long(raw, length)
            continue
        if held + len(raw) > AT_ONCE and group:
            finish()
            held = 0
        group.append(k)
        held += len(raw)
    if group:
        finish()
    return out


def _digests(raw: bytes, s: np.ndarray, e: np.ndarray, length: int) -> np.ndarray:
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(s.tolist(), (e + length).tolist(), strict=True)), np.uint64, len(s)).view(np.int64)


def _long(raw: bytes, length: int) -> tuple:
    """A long text in pieces of ``AT_ONCE`` windows; a phrase that a piece's end cuts is put together again."""
    found: list[list[int]] = []
    for at in range(0, len(raw) - length + 1, AT_ONCE):
        s, e, a, ah = _runs(np.frombuffer(raw, np.uint8, min(AT_ONCE + length - 1, len(raw) - at), at), None, length)
        rows = [list(x) for x in zip((s + at).tolist(), (e + at).tolist(), (a + at).tolist(), ah.tolist(), strict=True)]
        if found and rows and found[-1][2] == rows[0][2]:
            found[-1][1] = rows.pop(0)[1]
        found += rows
    s, e, a, ah = (np.array(x, np.int64) for x in zip(*found, strict=True))
    return s, e, ah, _digests(raw, s, e, length), a - s


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_OPEN = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("t", pa.int64()), ("p", pa.int64()), ("s", pa.int64()), ("known", pa.bool_()), ("phrase", pa.binary()), ("place", pa.int64())])


def _hashes(phrase: bytes, length: int) -> list[int]:
    view = memoryview(phrase)
    return [xxhash.xxh3_64_intdigest(view[x : x + length]) for x in range(len(phrase) - length + 1)]


def _window_hashes(length: int):
    @F.arrow_udf("array<bigint>")
    def of(column: pa.Array) -> pa.Array:
        lists = [_hashes(x, length) for x in column.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.array([h for x in lists for h in x], np.uint64).view(np.int64)))

    return of


def shared_windows(dictionary: list[tuple[bytes, int]], length: int) -> list[bytearray]:
    """For each phrase, one flag per window: whether another phrase of the trigger holds it, too.

    The dictionary's suffixes are put into the order of their first ``length`` bytes; neighbours with a common prefix of that
    length are equal windows. Equal windows hold the trigger at one place, so the suffix array is made place by place,
    and a task holds no more than one suffix of each phrase at a time.
    """
    counts = [max(0, len(phrase) - length + 1) for phrase, _ in dictionary]
    flags = [bytearray(n) for n in counts]
    for back in range(max((place for _, place in dictionary), default=-1) + 1):
        array = sorted((phrase[place - back : place - back + length], k) for k, (phrase, place) in enumerate(dictionary) if 0 <= place - back < counts[k])
        for (head, i), (other, j) in zip(array, array[1:], strict=False):
            if head == other:
                flags[i][dictionary[i][1] - back] = flags[j][dictionary[j][1] - back] = 1
    return flags


def _shared(batches, length: int):
    """Rows come by trigger: for each phrase that occurs once, the ranges of its windows that another phrase of the trigger has."""
    held: list[tuple] = []

    def settle() -> list[tuple]:
        by_phrase = {r[3]: r for r in held}
        if len(by_phrase) < 2:
            return []
        out = []
        for (k1, k2, _, _, s, known, *_), flags in zip(by_phrase.values(), shared_windows([r[6:] for r in by_phrase.values()], length), strict=True):
            if known:
                continue
            x = flags.find(1)
            while x >= 0:
                end = flags.find(0, x)
                end = len(flags) if end < 0 else end
                out.append((k1, k2, s + x, s + end - 1))
                x = flags.find(1, end)
        return out

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][2] != row[2]:
                out += settle()
                held = []
            held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], ["k1", "k2", "a", "b"])
    if held:
        out = settle()
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], ["k1", "k2", "a", "b"])


def _slices(batch: pa.RecordBatch, rows: int = 512):
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Removes each byte that a string of ``length`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes, matches don't cross documents; the same document may hold both, overlaps count, and strings are
    judged on the input. Returns ``id_col, n_bytes, n_removed, spans, kept`` with ``spans`` the maximal removed
    runs ``[start, end)`` and ``kept`` the other bytes, which need not be valid UTF-8. A null text is an empty one. Rows
    that repeat an id and text are each a document, so all of them lose what is long enough. Ids may be null. An
    empty table gives an empty result. ``length`` is at least 64.
    """
    if length < 2 * TRIGGER:
        raise ValueError(f"length must be {2 * TRIGGER} at least")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k1", F.xxhash64(F.col("id").cast("string"))).withColumn("k2", F.xxhash64("text"))
    rows = rows.withColumn("k", F.xxhash64("k1", "k2"))

    def parse(batches):
        for batch in batches:
            for part in _slices(batch):
                k1, k2 = (part.column(j).to_numpy() for j in (0, 1))
                out = []
                for i, (_, _, ah, seg, _) in enumerate(phrases(_texts(part.column(2)), length)):
                    if len(ah):
                        pair, n = np.unique(np.stack([ah, seg], 1), axis=0, return_counts=True) if len(np.unique(ah)) < len(ah) else (np.stack([ah, seg], 1), np.ones(len(ah), np.int64))
                        out.append((np.full(len(pair), k1[i]), np.full(len(pair), k2[i]), pair[:, 0], pair[:, 1], n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["k1", "k2", "t", "p", "n"])

    parsed = rows.where(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(parse, "k1 long, k2 long, t long, p long, n long")
    twice = written(parsed.groupBy("t").agg(F.sum("n").alias("n")).where("n > 1").select("t"), "triggers")
    held = written(parsed.join(twice, "t"), "phrases")
    # The dictionary: each phrase under a repeated trigger, how often it occurs, and one document that holds it.
    words = written(held.groupBy("t", "p").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2")).alias("at")), "dictionary")
    # Triggers with several phrases of which one occurs once: their phrases' suffixes are compared.
    mixed = written(words.groupBy("t").agg(F.count(F.lit(1)).alias("phrases"), F.min("n").alias("least")).where("phrases > 1 AND least = 1").select("t", "phrases"), "mixed-triggers")
    word = F.col("t").bitwiseXOR(F.col("p"))
    asked = words.join(mixed, "t").select("at.k1", "at.k2", word.alias("w"), (F.col("n") > 1).alias("known"), (F.col("phrases") > group_limit).alias("large"))
    asked = written(asked.groupBy("k1", "k2", "large").agg(F.collect_list("w").alias("w"), F.collect_list("known").alias("known")), "open-phrases")

    def suffixes(batches):
        for batch in batches:
            for part in _slices(batch):
                k1, k2 = (part.column(j).to_pylist() for j in (0, 1))
                texts, wanted = _texts(part.column(2)), [dict(zip(w, k, strict=True)) for w, k in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                out = []
                for i, (s, e, ah, seg, at) in enumerate(phrases(texts, length)):
                    for a, b, t, p, place in zip(s.tolist(), e.tolist(), ah.tolist(), seg.tolist(), at.tolist(), strict=True):
                        if (known := wanted[i].pop(t ^ p, None)) is not None:
                            out.append((k1[i], k2[i], t, p, a, known, texts[i][a : b + length], place))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(_OPEN)], schema=_OPEN)

    def opened(rows_of: DataFrame) -> DataFrame:
        near = Filter(rows_of.select(F.xxhash64("k1", "k2").alias("k")), "k").mark(rows, "k").where("__gs_maybe")
        return near.select("k1", "k2", "text").join(rows_of, ["k1", "k2"]).select("k1", "k2", "text", "w", "known").mapInArrow(suffixes, "k1 long, k2 long, t long, p long, s long, known boolean, phrase binary, place long")

    shared = opened(asked.where("NOT large")).repartition("t").sortWithinPartitions("t").mapInArrow(lambda b: _shared(b, length), "k1 long, k2 long, a long, b long")
    many = asked.where("large")
    if many.take(1):  # a trigger's phrases may be any number: their windows are counted one by one
        windows = written(opened(many).dropDuplicates(["t", "p"]).select("k1", "k2", "t", "s", "known", _window_hashes(length)("phrase").alias("h")), "suffixes")
        twice_seen = written(windows.select("t", F.explode("h").alias("h")).groupBy("t", "h").count().where("count > 1").select("t", "h"), "shared-suffixes")
        single = windows.where("NOT known").select("k1", "k2", "t", F.posexplode("h").alias("j", "h"), "s").join(twice_seen, ["t", "h"])
        start = F.col("s") + F.col("j")
        shared = shared.unionByName(single.select("k1", "k2", start.alias("a"), start.alias("b")))
    starts = shared.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    full = held.join(words.where("n > 1").select("t", "p"), ["t", "p"]).select("k1", "k2", word.alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("w"))
    found = written(full.join(starts, ["k1", "k2"], "full"), "repeats")

    kind = pa.struct([("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    @F.arrow_udf("struct<n_removed:bigint,spans:array<struct<start:bigint,end:bigint>>,kept:binary>")
    def cut(texts: pa.Array, whole: pa.Array, some: pa.Array) -> pa.Array:
        out, raws = [], _texts(texts)
        whole, some = whole.to_pylist(), some.to_pylist()
        for at in range(0, len(raws), 512):
            part = [raw if whole[at + k] or some[at + k] else b"" for k, raw in enumerate(raws[at : at + 512])]
            for k, (s, e, ah, seg, _) in enumerate(phrases(part, length), at):
                hit = np.isin(ah ^ seg, np.array(whole[k] or [], np.int64))
                first = np.concatenate([s[hit], np.array([x["a"] for x in some[k] or ()], np.int64)])
                last = np.concatenate([e[hit], np.array([x["b"] for x in some[k] or ()], np.int64)])
                order = np.argsort(first, kind="stable")
                spans: list[list[int]] = []
                for a, b in zip(first[order].tolist(), (last[order] + length).tolist(), strict=True):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                raw, kept, end = raws[k], [], 0
                for a, b in spans:
                    kept.append(raw[end:a])
                    end = b
                kept.append(raw[end:])
                out.append({"n_removed": sum(b - a for a, b in spans), "spans": [{"start": a, "end": b} for a, b in spans], "kept": b"".join(kept)})
        return pa.array(out, kind)

    marked = Filter(found.select(F.xxhash64("k1", "k2").alias("k")), "k").mark(rows, "k")
    size = F.octet_length("text").cast("long").alias("n_bytes")
    empty = "array<struct<start:bigint,end:bigint>>"
    clean = marked.where("NOT __gs_maybe").select("id", size, F.lit(0).cast("long").alias("n_removed"), F.array().cast(empty).alias("spans"), F.col("text").cast("binary").alias("kept"))
    touched = marked.where("__gs_maybe").select("id", "k1", "k2", "text").join(found, ["k1", "k2"], "left").select("id", size, cut("text", "w", "starts").alias("c")).select("id", "n_bytes", "c.n_removed", "c.spans", "c.kept")
    return clean.unionByName(touched).withColumnRenamed("id", id_col)


def report(docs: DataFrame, length: int = 200) -> DataFrame:
    """The result that the query returns."""
    return remove_repeats(docs, length=length).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], length: int = 200) -> list[tuple]:
    """The same by a table of all strings of ``length`` bytes, for tests."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts: dict[bytes, int] = {}
    for _, raw in raws:
        for k in range(len(raw) - length + 1):
            counts[raw[k : k + length]] = counts.get(raw[k : k + length], 0) + 1
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if counts[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out
