r"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut into ``c`` blocks; two fingerprints within ``d`` bits agree on ``c - d`` blocks at least. Each
choice of ``c - d`` blocks is a table, the bits of those blocks its key. Distinct fingerprints meet others of their key
there and are verified by Hamming distance. More fingerprints call for more blocks, that is longer keys (16 bits of
64 with four blocks, 25 with five, 32 with six), so that buckets stay small; any choice finds every link.

Equal texts are one fingerprint before anything is joined. A bucket gives the tree of its components, a link per
fingerprint at most, never all its pairs. Buckets of more than ``BUCKET`` fingerprints are compared in pairs of parts,
each part pair a group by itself. Components come from alternating large-star and small-star steps over these links.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, OWN, new_path, remove, scratch, written
from .filters import Filter

BUCKET = 4096
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(raw: bytes, size: int = 3) -> int:
    """The fingerprint of a text, unsigned."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else iter([b" ".join(words)])
    n, left, ones = max(1, len(words) - size + 1), max(1, len(words) - size + 1), np.zeros(64, np.int64)
    hashed = (xxhash.xxh64_intdigest(s, 42) for s in shingles)
    while left:
        part = np.fromiter(hashed, np.uint64, min(left, SHINGLES_AT_ONCE))
        left -= len(part)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(id, th, fp)`` of ``(id, text)``: a hash of the text, and the fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(raw or b"", size) for raw in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))

    return docs.select("id", F.xxhash64("text").alias("th"), of("text").alias("fp"))


def blocks_for(n: int, distance: int = 3) -> int:
    """The least number of blocks whose keys leave eight random fingerprints in a bucket."""
    c = distance + 1
    while c < 12 and n / 2 ** (64 // c * (c - distance)) > 8:
        c += 1
    return c


def masks(c: int, distance: int) -> list[int]:
    """One mask per choice of the blocks that agree."""
    edges = [64 * k // c for k in range(c + 1)]
    one = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(c)]
    out = [sum(one[k] for k in chosen) for chosen in combinations(range(c), c - distance)]
    assert len(out) == comb(c, distance)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_in(groups: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Within each run of equal ``groups``: a link from each fingerprint to the least one it is connected to."""
    n = len(fps)
    boss = np.arange(n)
    bits = fps.view(np.uint64)

    def top(k: int) -> int:
        while boss[k] != k:
            boss[k] = boss[boss[k]]
            k = boss[k]
        return k

    ends = np.append(np.flatnonzero(groups[1:] != groups[:-1]), n - 1) if n else np.zeros(0, np.int64)
    last = np.repeat(ends, np.diff(ends, prepend=-1))
    at = np.arange(n)
    for lag in range(1, n):
        at = at[at + lag <= last[at]]
        if not len(at):
            break
        close = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= distance]
        close = close[boss[close] != boss[close + lag]]
        for k in close.tolist():
            a, b = top(k), top(k + lag)
            if a != b:
                boss[max(a, b)] = min(a, b)
        if len(close) > 64:
            while (up := boss[boss] != boss).any():
                boss[up] = boss[boss[up]]
    root = np.array([top(k) for k in range(n)], np.int64)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def links(fps: DataFrame, distance: int = 3, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """``(u, v)``, ``u > v``: links that connect all of the distinct ``fp`` that chains of close pairs connect."""
    fps = written(fps, "fingerprints")
    found = masks(blocks or blocks_for(fps.count(), distance), distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(found)])).alias("x")).select("x.t", "x.key", "fp")
    keyed = written(keyed, "blocks")
    # Parts of large buckets: a row of part r goes to the part pairs (r, j), so that each pair of rows meets.
    large = written(keyed.groupBy("t", "key").count().where(F.col("count") > bucket).select("t", "key", F.ceil(F.col("count") / bucket).cast("int").alias("parts")), "large-buckets")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    dealt = dealt.select("t", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("a"), F.greatest(j, F.col("part")).alias("b")))).alias("p"))
    dealt = dealt.select(F.xxhash64("t", "key", "p.a", "p.b").alias("g"), "t", "key", "p.a", "p.b", "fp")

    def link(batches):
        held: tuple | None = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            ids = np.cumsum(np.any([np.diff(c, prepend=c[:1]) != 0 for c in cols[:5]], axis=0)) if len(cols[0]) else np.zeros(0, int)
            cut = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
            u, v = links_in(ids[:cut], cols[5][:cut], distance)
            held = tuple(c[cut:] for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if held is not None:
            u, v = links_in(np.zeros(len(held[5]), np.int64), held[5], distance)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    near = dealt.repartition("g").sortWithinPartitions("g", "t", "key", "a", "b", "fp").mapInArrow(link, "u long, v long")
    return near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u, v)``: each linked node and the least node of its component, by large-star and small-star steps."""

    def step(rows: DataFrame, out) -> DataFrame:
        least = written(rows.groupBy("u").agg(F.min("v").alias("m")), "least")
        return out(rows.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")), least)

    def large(e: DataFrame) -> DataFrame:
        both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both-ways")
        return step(both, lambda j, _: j.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())

    def small(e: DataFrame) -> DataFrame:
        return step(e, lambda j, least: j.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())

    state = lambda e: e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    spark, path = edges.sparkSession, None
    edges = written(edges, "links")
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        last, path = path, new_path(spark, "small-star")
        with scratch(spark):
            small(written(large(edges), "large-star")).write.parquet(path)
        if last:
            remove(spark, last)
        edges = spark.read.schema(edges.schema).parquet(path)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges


def rooted(prints: DataFrame, firsts: DataFrame, stars: DataFrame) -> DataFrame:
    """``prints`` with ``root`` and ``component_id``, from ``firsts`` (a row per fingerprint) and the components of linked ones."""
    roots = written(firsts.join(stars, firsts["fp"] == stars["u"], "left").select("fp", "first", F.coalesce("v", "fp").alias("root")), "roots")
    named = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = written(roots.join(named, "root").select("fp", "root", "component_id"), "components")
    return prints.join(of_print, "fp")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, distance: int, blocks: int | None, bucket: int) -> DataFrame:
    """``(id, th, fp, root, component_id)`` for each row; ``th`` hashes its text, ``root`` is the component's least fingerprint."""
    prints = written(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size), "simhash")
    firsts = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "first-of-fingerprint")
    stars = components(links(firsts.select("fp"), distance, blocks, bucket))
    return rooted(prints, firsts, stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    r"""The component of each document under links between close fingerprints.

    Words are ``[^\x20\x09-\x0D]+`` after A-Z are lower-cased; shingles are ``size`` words, repeats included; a text of
    fewer words is one shingle, a null text or one without words has fingerprint zero. Returns ``id_col, fingerprint``
    (16 hex digits) ``, component_id`` (the least id of the component). Repeated rows are returned as often. Null
    ids are never a component's id unless it has no other. Other columns are not read. An empty table gives an empty result.
    """
    of = _grouped(docs, id_col, text_col, size, distance, blocks, bucket)
    return of.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the least id.

    Of rows that share that id the one whose text has the least hash stays, and one of those that repeat it. Null ids
    are last. What goes is a set of (id, text hash); rows that miss a filter over it stay without a shuffle.
    """
    return stay(docs, _grouped(docs, id_col, text_col, size, distance, None, BUCKET), id_col, text_col)


def stay(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What ``keep_firsts`` says, for rows ``(id, th, root)`` of ``docs`` grouped by ``root``."""
    of = written(grouped.select("root", F.col("id").isNull().alias("no_id"), "id", "th"), "grouped")
    key = F.xxhash64(F.col("id").cast("string"), F.col("th"))
    best = of.groupBy("root").agg(F.min(F.struct("no_id", "id", "th")).alias("best")).select("best.*").withColumn("key", key).select("key")
    counted = written(of.groupBy(key.alias("key")).count(), "row-keys")
    gone = written(counted.join(best, "key", "left_anti").select("key"), "gone")
    again = written(counted.where("count > 1").join(gone, "key", "left_anti").select("key"), "repeated-rows")
    own = f"{OWN}key"
    keyed = docs.withColumn(own, F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_col)))
    marked = Filter(gone.unionByName(again)).mark(keyed, own)
    sure, asked = marked.where("NOT __gs_maybe").select(*docs.columns), marked.where("__gs_maybe")
    left = asked.join(gone, F.col(own) == gone["key"], "left_anti")
    many = left.join(again, F.col(own) == again["key"], "left_semi").withColumn(f"{OWN}k", F.row_number().over(Window.partitionBy(own).orderBy(own))).where(f"{OWN}k = 1")
    few = left.join(again, F.col(own) == again["key"], "left_anti")
    return sure.unionByName(few.select(*docs.columns)).unionByName(many.select(*docs.columns))
