r"""Mixing sources to target weights, by blocks and index permutations.

1. Words are counted; sources get targets (weights 3, 1, 2 in turn, bounded by a number of epochs).
2. Each source's words, documents in the order of a hash of their id, are packed into blocks of ``block_words``.
   Offsets come from a two-level prefix sum: within buckets of the hash, then across buckets. No task sees a source.
3. Each output shard draws multinomial counts per source, given what is left of each source's slots, so that totals
   meet the targets exactly.
4. A source's slots are numbered through. Slot ``k`` takes block ``P(k mod B)`` of epoch ``k div B``, where ``P`` is a
   Feistel permutation of the block indexes keyed by seed, source and epoch. A block is hence taken once per epoch.
5. Slots meet blocks by (source, block index): keys that are near unique, whatever a source's share.

The driver holds one row per source and the counts per shard and source; nothing per document. There are ``MAX_SHARDS`` shards at
most: a mix of more slots than these hold at ``slots_per_shard`` each has larger ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
BLOCK_WORDS = 2048
SLOTS_PER_SHARD = 8192
MAX_SHARDS = 10_000
DOCS_PER_BUCKET = 4096


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> list[float]:
    """Splits ``share`` of all sizes by weight; what is above ``epochs`` times a source's size is shared anew."""
    w = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[k] for k in sorted(open_))
        full = [k for k in sorted(open_) if left * w[k] / total > epochs * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * w[k] / total
            break
        for k in full:
            out[k] = float(epochs * sizes[k])
            open_.remove(k)
        left -= sum(out[k] for k in full)
    return out


class Feistel:
    """A pseudorandom permutation of ``range(n)``, both ways, on arrays."""

    def __init__(self, n: int, key: tuple[int, ...]):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, 6, dtype=np.uint64)

    def _round(self, x: np.ndarray, key) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64).copy()
        todo = np.arange(len(x))
        while len(todo):  # cycle walking: the domain is less than four times too large
            a, b = x[todo] >> np.uint64(self.half), x[todo] & self.mask
            for key in self.keys[::-1] if back else self.keys:
                a, b = (b ^ self._round(a, key), a) if back else (b, a ^ self._round(b, key))
            x[todo] = (a << np.uint64(self.half)) | b
            todo = todo[x[todo] >= self.n]
        return x.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def slots_for(size: int, words: int, block: int, key: tuple[int, ...]) -> tuple[int, int]:
    """How many slots take ``words`` of a source of ``size`` words, and how many words the last slot takes."""
    if not words:
        return 0, 0
    blocks, short = -(-size // block), (size - 1) % block + 1
    epochs, rest = divmod(words, size)
    if not rest:
        last = int(Feistel(blocks, (*key, epochs - 1)).forward(np.array([blocks - 1]))[0])
        return epochs * blocks, short if last == blocks - 1 else block
    at = int(Feistel(blocks, (*key, epochs)).backward(np.array([blocks - 1]))[0])  # where the short block stands
    n = -(-rest // block)
    if n > at:
        n = max(at + 1, -(-(rest - short) // block) + 1)
    before = (n - 1) * block if n - 1 <= at else (n - 2) * block + short
    return epochs * blocks + n, rest - before


def shard_counts(slots: np.ndarray, shards: int, seed: int) -> list[np.ndarray]:
    """Counts per source for each shard: multinomial draws by what is left, so that all slots are dealt out."""
    left, out = slots.astype(np.int64).copy(), []
    total = int(left.sum())
    for shard in range(shards):
        rng = np.random.default_rng((seed, shard))
        want = total * (shard + 1) // shards - total * shard // shards
        got = np.zeros(len(left), np.int64)
        while (need := want - int(got.sum())) > 0:
            open_ = left - got
            got += np.minimum(rng.multinomial(need, open_ / open_.sum()), open_)
        left -= got
        out.append(got)
    return out


def word_counts(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(id, source, size)``; a null text has no words."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))


class Mix:
    """A mix of ``docs``: ``documents`` (with targets), ``pieces`` (documents cut into blocks) and ``slots``.

    Sources stand by code point, null last, and weigh 3, 1, 2, repeating. Ids may be null or repeat: rows with equal
    id and size can't be told apart, but each is a document of its own. Empty and null texts have size 0 and take nothing. A
    text of any length is cut into as many pieces as it needs. An empty table gives empty results. Reruns agree.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = BLOCK_WORDS, seed: int = 42, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, docs_per_bucket: int = DOCS_PER_BUCKET, slots_per_shard: int = SLOTS_PER_SHARD):
        self.spark, self.block, self.seed, self.per_shard = docs.sparkSession, block_words, seed, slots_per_shard
        sized = written(word_counts(docs, id_col, source_col, text_col), "mix-sizes")
        rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in rows]
        goals = targets(sizes, weights, share, epochs)
        self.sources = [{"s": k, "source": r["source"], "source_size": n, "target": t, "words": min(math.floor(t + 0.5), epochs * n)} for k, (r, n, t) in enumerate(zip(rows, sizes, goals, strict=True))]
        for x in self.sources:
            x["slots"], x["last"] = slots_for(x["source_size"], x["words"], block_words, (seed, x["s"]))
        about = self.spark.createDataFrame(self.sources, "s int, source string, source_size long, target double, words long, slots long, last long")
        bits = max(0, math.ceil(math.log2(max(1, sum(r["n"] for r in rows) / docs_per_bucket))))
        hashed = F.xxhash64(F.col("id").cast("string"), F.lit(seed))
        keyed = sized.join(about.select("s", F.col("source").alias("of"), "source_size", "target"), sized["source"].eqNullSafe(F.col("of"))).drop("of").withColumn("h", hashed)
        keyed = keyed.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
        sums = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("sum"))
        sums = sums.select("s", "bucket", (F.sum("sum").over(Window.partitionBy("s").orderBy("bucket")) - F.col("sum")).alias("base"))
        inside = Window.partitionBy("s", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = keyed.withColumn("upto", F.sum("size").over(inside)).join(sums, ["s", "bucket"])
        self.documents = written(placed.select("id", "source", "s", "size", "source_size", "target", (F.col("base") + F.col("upto") - F.col("size")).alias("offset")), "mix-documents")

    @property
    def pieces(self) -> DataFrame:
        """``(s, block, id, size, offset, at, start, n)``: words ``[start, start + n)`` of a document lie at word ``at`` of the block."""
        n = self.block
        cut = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / n), F.floor((F.col("offset") + F.col("size") - 1) / n))))
        first = F.greatest(F.col("offset"), F.col("block") * n)
        return cut.select("s", "block", "id", "source", "size", "source_size", "target", "offset", (first - F.col("block") * n).alias("at"), (first - F.col("offset")).alias("start"), (F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * n) - first).alias("n"))

    @property
    def slots(self) -> DataFrame:
        """``(shard, slot, s, epoch, block, words)``: each slot takes the first ``words`` words of a block."""
        total = sum(x["slots"] for x in self.sources)
        shards = min(MAX_SHARDS, max(1, -(-total // self.per_shard)))
        counts = shard_counts(np.array([x["slots"] for x in self.sources], np.int64), shards, self.seed)
        begun, rows = [0] * len(self.sources), []
        for shard, row in enumerate(counts):
            for s, n in enumerate(row):
                x = self.sources[s]
                if n:
                    rows.append((shard, s, begun[s], int(n), x["source_size"], x["slots"], x["last"]))
                begun[s] += int(n)
        block, seed = self.block, self.seed

        def deal(frames):
            for frame in frames:
                for r in frame.itertuples(index=False):
                    k, blocks = np.arange(r.first, r.first + r.n), -(-r.size // block)
                    out = pd.DataFrame({"shard": r.shard, "s": r.s, "k": k, "epoch": k // blocks})
                    out["block"] = np.concatenate([Feistel(blocks, (seed, r.s, int(e))).forward(k[k // blocks == e] % blocks) for e in np.unique(k // blocks)])
                    out["words"] = np.where(k == r.slots - 1, r.last, np.minimum(block, r.size - out["block"] * block))
                    yield out

        # The driver has a row per source of a shard; runs of slots are cut from it by the tasks.
        plan = self.spark.createDataFrame(rows, "shard int, s int, first long, n long, size long, slots long, last long")
        step = F.lit(SLOTS_PER_SHARD).cast("long")
        plan = plan.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)))
        plan = plan.select("shard", "s", (F.col("first") + F.col("skip")).alias("first"), F.least(step, F.col("n") - F.col("skip")).alias("n"), "size", "slots", "last")
        return plan.mapInPandas(deal, "shard int, s int, k long, epoch long, block long, words long")

    def spans(self) -> DataFrame:
        """The mix itself: ``(shard, s, k, epoch, block, id, offset, start, n)``, ``n`` words of a document from word ``start``."""
        p = self.pieces
        return self.slots.join(p, ["s", "block"]).withColumn("n", F.least(F.col("n"), F.col("words") - F.col("at"))).where("n > 0")

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(shard, s, k, text)``: the blocks to train on, words between single spaces. Ids must not repeat."""
        words = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("all"))
        parts = self.spans().join(words, "id").select("shard", "s", "k", F.struct("at", F.array_join(F.slice("all", F.col("start").cast("int") + 1, F.col("n").cast("int")), " ").alias("text")).alias("part"))
        return parts.groupBy("shard", "s", "k").agg(F.array_join(F.array_sort(F.collect_list("part"))["text"], " ").alias("text"))

    def taken(self) -> DataFrame:
        """``(id, size, source_size, target, taken)`` for each document."""
        with_words = self.pieces.join(self.slots.select("s", "block", "words"), ["s", "block"], "left")
        none = F.lit(0).cast("long")
        got = F.when(F.col("words").isNull(), none).otherwise(F.greatest(none, F.least(F.col("n"), F.col("words") - F.col("at"))))  # least() skips nulls
        held = with_words.groupBy("s", "offset", "id", "size", "source_size", "target").agg(F.sum(got).alias("taken"))
        columns = ["id", "size", "source_size", "target"]
        return held.select(*columns, "taken").unionByName(self.documents.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result that the query returns."""
    return Mix(docs, id_col).taken().withColumnRenamed("id", id_col)
