r"""Near copies by exact Jaccard similarity: 0.8 or more over the sets of five-word shingles.

First simhash: fingerprints of 64 bits over the sets, pigeonhole blocks, and the pairs that these link within ``DISTANCE`` bits compared by
their whole sets. That joins most copies, but no distance finds all that are alike, so an exact join finds the rest.

A prefix-filtered set join. Each set is sorted in one order that all sets share, shingles that a sample found in many
texts last. Two sets of ``n`` and ``m`` shingles are alike if they share ``4 (n + m) / 9`` or more, and then their first
common shingle is among the first ``n // 5 + 1`` of one and ``m // 5 + 1`` of the other: pairs that share none there
can't be alike, and each pair that does, within the bounds on size and position, is compared by its whole sets. The sample
sets the price only; any order finds every pair.

Sets of more than ``PART`` shingles are cut into 4, 16, ... parts by the first bits of the hashes, so that a part has 64 to ``PART``
shingles or so. Two sets are alike if they differ in a ninth of both sizes at most, so if they are, they are alike in one part at least: were
each part's difference more than a ninth of its sizes, so were the sum. Each part is joined as a set of its own. A set whose alike ones
may have fewer parts is cut both ways.

Each part has a sketch of ``BITS`` bits, bit k the parity of how many shingles fall on it. Sketches differ in no more bits than
their sets do in shingles, so sketches that differ in more than a ninth of both sizes rule a pair out for certain, before it is
written anywhere. Over whole sets of a thousand shingles they would rule out nothing, as they can't differ in more than ``BITS`` bits.

Rows that share a prefix shingle are compared in rounds, from the components that simhash found: ``CHAINS`` times at most, and while that links many, each with the nearest by sketch of the ``LAGS`` rows that follow
it by size and are not joined to it yet, then every pair that the components so far don't join. A pair inside one component
can't change it; the first rounds join most of a large group of copies with a pair per row, so that the last one meets few pairs of it.
"""

from __future__ import annotations

from itertools import chain as chain_of

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, new_path, scratch, shuffles_freed, written
from .filters import Filter
from .simhash import SHINGLES_AT_ONCE, components, links, rooted, stay

WORDS = 5
CHAINS = 3
LAGS = 16
BITS = 256
DISTANCE = 3
PART = 256
SAMPLE = 16_384
COMMON = 3
MOST_COMMON = 1 << 18
SMALL = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    words = raw.translate(LOWER).split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, out = len(words) - WORDS + 1, each[: len(words) - WORDS + 1].copy()
    for k in range(1, WORDS):
        out *= _STEP
        out += each[k : k + n]
    return np.unique(out)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets have a Jaccard similarity of 0.8 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def prefix(s: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first ``len(s) // 5 + 1`` of a set: those not in ``common`` first, then by ``ranks``."""
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, ranks[at], 0)))]
    return s[: len(s) // 5 + 1]


def fingerprint(s: np.ndarray) -> int:
    """The simhash of a set, as a signed long: a bit is 1 if set in over half the shingles' hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(s), SHINGLES_AT_ONCE):
        ones += np.unpackbits(s[k : k + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.int64)[0])


def level(n: int) -> int:
    """A set of ``n`` shingles is cut into ``4 ** level`` parts."""
    return (((n - 1) // PART).bit_length() + 1) // 2


def parts(s: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """``(level, part)``: the parts of an ascending set that aren't empty, at its level and at the one of the smallest set alike."""
    found = []
    for k in range(level((4 * len(s) + 4) // 5), level(len(s)) + 1):
        edges = np.arange(1, 4**k, dtype=np.uint64) << np.uint64(64 - 2 * k) if k else []
        found += [(k, p) for p in np.split(s, np.searchsorted(s, edges)) if len(p)]
    return found


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _sets(text: str) -> Column:
    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return _lists([shingles(raw or b"") for raw in texts.cast(pa.binary()).to_pylist()])

    return of(text)


def _common(texts: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``COMMON`` texts of a sample hold, ascending, and how many hold them."""
    share = min(1.0, sample / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("th"), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["th"])
    counted = some.select(F.explode(_sets("text")).alias("tok")).groupBy("tok").count().where(F.col("count") >= COMMON)
    rows = sorted(counted.orderBy(F.desc("count"), "tok").limit(MOST_COMMON).collect(), key=lambda r: r["tok"] % (1 << 64))
    return np.array([r["tok"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of a part, as ``BITS // 64`` longs."""
    return np.packbits(np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).view(np.int64)


def near_pairs(first: np.ndarray, last: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, bits: np.ndarray, chain: bool, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows to compare; runs ``first..last`` of rows share a shingle and ascend by size. ``at`` is its place in the row's set."""
    left, us, vs = n - at, [], []
    bits = bits.view(np.uint64)  # bits of a negative number are counted in its absolute value
    apart = lambda i, j: np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)

    def fits(i, j) -> np.ndarray:
        """Places where the pair may be alike and isn't joined yet."""
        ok = np.flatnonzero((5 * n[i] >= 4 * n[j]) & (9 * np.minimum(left[i], left[j]) >= 4 * (n[i] + n[j])) & (root[i] != root[j]))
        one, two = (np.broadcast_to(x, np.broadcast_shapes(np.shape(i), np.shape(j)))[ok] for x in (i, j))
        return ok[9 * apart(one, two) <= n[one] + n[two]]

    ends = np.repeat(last, last - first + 1)
    rows = np.arange(len(n)) if chain else np.flatnonzero(np.repeat(last - first < small, last - first + 1))
    best, near = np.full(len(n), BITS + 1), np.full(len(n), -1)
    for lag in range(1, 1 + LAGS if chain else small):
        rows = rows[rows + lag <= ends[rows]]
        rows = rows[5 * n[rows] >= 4 * n[rows + lag]]
        if not len(rows):
            break
        found = rows[fits(rows, rows + lag)]
        if chain:
            gap = apart(found, found + lag)
            found, gap = found[gap < best[found]], gap[gap < best[found]]
            best[found], near[found] = gap, found + lag
        else:
            us.append(found)
            vs.append(found + lag)
    if chain:
        us, vs = [np.flatnonzero(near >= 0)], [near[near >= 0]]
    for a, b in [] if chain else [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b - a >= small]:
        _, which, sizes = np.unique(root[a : b + 1], return_inverse=True, return_counts=True)
        # Each row outside the largest component meets all behind it, and the largest component's rows before it.
        main = which == sizes.argmax()
        for i in (a + np.flatnonzero(~main)).tolist():
            behind, before = np.arange(i + 1, b + 1), a + np.flatnonzero(main[: i - a])
            found = np.concatenate([before[fits(before, i)], behind[fits(i, behind)]])
            us.append(np.full(len(found), i))
            vs.append(found)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(us or none), np.concatenate(vs or none)


_WORDS_OF_BITS = [f"b{k}" for k in range(BITS // 64)]


def _candidates(rows: DataFrame, chain: bool, small: int) -> DataFrame:
    """``(u, v)``, ``u > v``, of ``(tok, n, fp, at, root)`` and sketches; for a chain, of each ``u`` the ``v`` that it meets most often."""

    def meet(batches):
        held = [np.zeros(0, np.int64)] * (5 + len(_WORDS_OF_BITS))
        for batch in chain_of(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            tok = held[0]
            cut = len(tok) if batch is None else int(np.searchsorted(tok, tok[-1])) if len(tok) else 0
            if not cut:
                continue
            starts = np.flatnonzero(np.diff(tok[:cut], prepend=tok[0] - 1))
            now, held = [h[:cut] for h in held], [h[cut:] for h in held]
            u, v = near_pairs(starts, np.append(starts[1:], cut) - 1, now[1], now[3], now[4], np.stack(now[5:], axis=1), chain, small)
            fp = now[2]
            both = np.unique(np.stack([np.maximum(fp[u], fp[v]), np.minimum(fp[u], fp[v])]), axis=1)
            for k in range(0, both.shape[1], 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(both[0, k : k + (1 << 16)]), pa.array(both[1, k : k + (1 << 16)])], ["u", "v"])

    met = rows.select("tok", "n", "fp", "at", "root", *_WORDS_OF_BITS).repartition("tok").sortWithinPartitions("tok", "n", "fp")
    found = met.mapInArrow(meet, "u long, v long").groupBy("u", "v").count()
    return found.groupBy("u").agg(F.max_by("v", F.struct("count", "v")).alias("v")) if chain else found.select("u", "v")


def _close(firsts: DataFrame) -> DataFrame:
    """``(u, v)``, ``u > v``: sets to compare as their fingerprints are equal or linked; a pair per set and per link of blocks at most."""
    heads = written(firsts.groupBy("sim").agg(F.min("fp").alias("head")), "near-fingerprints")
    equal = firsts.join(heads, "sim").where("fp <> head").select("fp", "head")
    near = links(heads.select(F.col("sim").alias("fp")), DISTANCE)
    for side in ("u", "v"):
        near = near.join(heads.select(F.col("sim").alias(side), F.col("head").alias(f"{side}_head")), side)
    both = equal.unionByName(near.select(F.col("u_head").alias("fp"), F.col("v_head").alias("head")))
    return both.select(F.greatest("fp", "head").alias("u"), F.least("fp", "head").alias("v")).distinct()


def _put(df: DataFrame, path: str) -> DataFrame:
    """``df`` from a path that outlives the scratch it is made of."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _links(pairs: DataFrame, firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are alike. Only the texts that are in a pair meet; texts take less room than sets."""

    @F.arrow_udf("boolean")
    def judge(a: pa.Array, b: pa.Array) -> pa.Array:
        sets = [[shingles(raw or b"") for raw in x.cast(pa.binary()).to_pylist()] for x in (a, b)]
        return pa.array([alike(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())

    spark, path = pairs.sparkSession, new_path(pairs.sparkSession, "near-links")
    with scratch(spark):
        asked = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
        asked = written(asked.join(firsts.select("fp", "th"), "fp"), "near-asked")
        found = Filter(asked.select(F.col("th").alias("key"))).mark(texts, "th").where("__gs_maybe").select("th", "text").dropDuplicates(["th"])
        whole = written(found.join(asked, "th").select("fp", "text"), "near-texts")
        both = pairs.join(whole.select(F.col("fp").alias("u"), F.col("text").alias("a")), "u").join(whole.select(F.col("fp").alias("v"), F.col("text").alias("b")), "v")
        return _put(both.where(judge("a", "b")).select("u", "v"), path)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, small: int = SMALL) -> DataFrame:
    """``(id, th, fp, root, component_id)`` for each row: the component of its text under links between texts that are alike.

    Words and lower case are as in ``simhash``. ``fp`` hashes the text's set, ``th`` its text; ``component_id`` is the
    least id of the component. A null text is one without words; those are alike. Shingles are told apart by 64 bits.
    """
    with shuffles_freed(docs.sparkSession):
        return _groups(docs, id_col, text_col, sample, small)


def _groups(docs: DataFrame, id_col: str, text_col: str, sample: int, small: int) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    known = docs.sparkSession.sparkContext.broadcast(_common(texts, sample))

    @F.arrow_udf(f"struct<fp:bigint,sim:bigint,parts:array<struct<n:bigint,toks:array<bigint>,{','.join(f'{b}:bigint' for b in _WORDS_OF_BITS)}>>>")
    def of(column: pa.Array) -> pa.Array:
        fps, sims, ends, sizes, heads, bits = [], [], [0], [], [], []
        for raw in column.cast(pa.binary()).to_pylist():
            s = shingles(raw or b"")
            fps.append(xxhash.xxh64_intdigest(s.tobytes()))
            sims.append(fingerprint(s))
            for k, part in parts(s):
                sizes.append(len(part))
                heads.append(prefix(part, *known.value) ^ np.uint64(k * int(_STEP) % (1 << 64)))
                bits.append(sketch(part))
            ends.append(len(sizes))
        words = np.array(bits, np.int64).reshape(-1, len(_WORDS_OF_BITS))
        each = pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), _lists(heads), *map(pa.array, words.T.copy())], ["n", "toks", *_WORDS_OF_BITS])
        return pa.StructArray.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sims, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["fp", "sim", "parts"])

    spark = docs.sparkSession
    prints_at, shared_at = new_path(spark, "near-prints"), new_path(spark, "near-shared")
    with scratch(spark):
        cut_at = new_path(spark, "near-parts")
        with scratch(spark):
            whole = written(texts.withColumn("x", of("text")).select("id", "th", "x.fp", "x.sim", "x.parts"), "near-whole")
            prints = _put(whole.select("id", "th", "fp", "sim"), prints_at)
            cut = _put(whole.groupBy("fp").agg(F.first("parts").alias("parts")).select("fp", F.posexplode("parts").alias("part", "p")).select("fp", "part", "p.*"), cut_at)
        tokens = cut.select("fp", "part", "n", F.posexplode("toks").alias("at", "tok")).withColumn("at", F.col("at").cast("bigint"))
        met = written(tokens.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("tok"))).where("of > 1").drop("of"), "near-met")
        # Sketches go to the rows that meet others only, so that they aren't shuffled with every shingle.
        shared = _put(met.join(cut.select("fp", "part", *_WORDS_OF_BITS), ["fp", "part"]).drop("part"), shared_at)
    firsts = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.min("th").alias("th"), F.first("sim").alias("sim")), "near-firsts")
    boss, pays = shared.select(F.col("fp").alias("linked"), F.col("fp").alias("boss")).limit(0), True
    judged = alike_pairs = None
    for how in ["simhash"] + ["chain"] * CHAINS + ["all"]:
        if how == "chain" and not pays:
            continue
        if how == "simhash":
            pairs = _close(firsts)
        else:
            rows = shared.join(boss, F.col("fp") == F.col("linked"), "left").withColumn("root", F.coalesce("boss", "fp"))
            pairs = _candidates(rows, how == "chain", small).join(judged, ["u", "v"], "left_anti")
        pairs = written(pairs, "near-candidates")
        found = _links(pairs, firsts, texts)
        alike_pairs, judged = (found, pairs) if judged is None else (alike_pairs.unionByName(found), judged.unionByName(pairs))
        # A round that links less than a quarter of its pairs has met other texts than copies: the last one settles the rest.
        n = found.count()
        pays = how == "simhash" or 0 < pairs.count() <= 4 * n
        if n:
            boss = components(alike_pairs).select(F.col("u").alias("linked"), F.col("v").alias("boss"))
    return rooted(prints.select("id", "th", "fp"), firsts.select("fp", "first"), boss.select(F.col("linked").alias("u"), F.col("boss").alias("v")))


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row that ``simhash.keep_firsts`` keeps."""
    return stay(docs, near_groups(docs, id_col, text_col, small=small), id_col, text_col)
