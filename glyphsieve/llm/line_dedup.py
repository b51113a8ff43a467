r"""Line dedup through sharded minimal perfect hashes.

Lines that occur in two documents or more are the keys of an index. The index is cut into shards by hash; a shard
holds a minimal perfect hash (levels of bit sets, each key owning one set bit whose rank is its slot) and, slot by
slot, three compact arrays: a 64-bit fingerprint, the number of documents, and the document that keeps the line.
Documents send the 16-byte hashes of their long lines to the shards and get back those to drop. The lines themselves
never move, and each document sends a hash once.

A line in a third of all documents costs a third of all probes to its shard. So shards are probed in slices: a shard
gets as many slices as its probes need (they are counted first), a document's probes go to the slice its id hashes
to, and the shard's arrays, which are small, are sent to each of its slices.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import BLANKS, LOWER, OWN, written
from .filters import Filter

KEYS_PER_SHARD = 1 << 17
PROBES_PER_SLICE = 200_000
LEVELS = 32
GAMMA = 2.0
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys. Keys equal to each other go to ``rest``, which is searched."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + at)
            at += int(bits.sum())
        self.n_ranked = at

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the slot of each key."""
        slots = np.full(len(keys), -1, np.int64)
        left, levels, at = np.arange(len(keys)), [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            place = (_mix(keys[left], level) % np.uint64(max(1, math.ceil(GAMMA * len(left))))).astype(np.int64)
            bits = np.bincount(place, minlength=max(1, math.ceil(GAMMA * len(left)))) == 1
            alone = bits[place]
            rank = np.cumsum(bits) - 1 + at
            slots[left[alone]] = rank[place[alone]]
            levels.append(bits)
            at += int(bits.sum())
            left = left[~alone]
        order = left[np.argsort(keys[left], kind="stable")]
        slots[order] = at + np.arange(len(order))
        return cls(levels, keys[order]), slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, some slot or -1 for foreign keys. Keys of ``rest`` give the first equal one's."""
        slots = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            place = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            slots[left[hit]] = ranks[place[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.searchsorted(self.rest, keys[left])
            ok = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[left])
            slots[left[ok]] = self.n_ranked + at[ok]
        return slots

    def dump(self) -> tuple[bytes, list[int], bytes]:
        return b"".join(np.packbits(b).tobytes() for b in self.levels), [len(b) for b in self.levels], self.rest.tobytes()

    @classmethod
    def load(cls, bits: bytes, sizes: list[int], rest: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels, np.frombuffer(rest, np.uint64))


def line_keys(raw: bytes, min_chars: int) -> list[bytes | None]:
    """The hash of each line's key; None for keys that are too short."""
    out: list[bytes | None] = []
    for line in raw.translate(LOWER).split(b"\n"):
        line = line.strip(BLANKS)
        out.append(xxhash.xxh3_128_digest(line) if len(line) >= min_chars and (line.isascii() or len(line.decode("utf-8", "replace")) >= min_chars) else None)
    return out


def _halves(keys) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def long_line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(id, key)``: each long line of a row once."""
    kind = docs.schema["id"]

    def hashes(batches):
        for batch in batches:
            keys = [list({k for k in line_keys(raw, min_chars) if k}) for raw in _bytes_of(batch.column(1))]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([k for ks in keys for k in ks], pa.binary())], ["id", "key"])

    return docs.select("id", "text").mapInArrow(hashes, StructType([kind, StructField("key", BinaryType())]))


def build_index(counts: DataFrame) -> DataFrame:
    """Shards ``(shard, bits, sizes, rest, fingerprints, n_docs, keepers)`` over ``(shard, key, n_docs, keeper)``."""

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = _halves(frame["key"])
        mph, slots = PerfectHash.build(low)
        order = np.argsort(slots)
        bits, sizes, rest = mph.dump()
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "bits": [bits], "sizes": [sizes], "rest": [rest], "fingerprints": [high[order].tobytes()], "n_docs": [frame["n_docs"].to_numpy(np.int64)[order].tobytes()], "keepers": [list(frame["keeper"].to_numpy()[order])]})

    kind = counts.schema["keeper"].dataType.simpleString()
    return counts.groupBy("shard").applyInPandas(shard, f"shard int, bits binary, sizes array<int>, rest binary, fingerprints binary, n_docs binary, keepers array<{kind}>")


def probe(probes: pd.DataFrame, index: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """The probes ``(id, key)`` whose line is in ``min_docs`` documents or more and stays in another one."""
    if not len(probes) or not len(index):
        return probes[["id", "key"]].iloc[:0]
    one = index.iloc[0]
    mph = PerfectHash.load(one["bits"], list(one["sizes"]), one["rest"])
    prints, counts = np.frombuffer(one["fingerprints"], np.uint64), np.frombuffer(one["n_docs"], np.int64)
    keepers = pd.Series(list(one["keepers"]), dtype=object).to_numpy()
    low, high = _halves(probes["key"])
    slots = mph.find(low)
    for k in np.flatnonzero(slots >= mph.n_ranked):  # equal keys stand side by side
        while slots[k] + 1 < len(prints) and prints[slots[k]] != high[k] and mph.rest[slots[k] + 1 - mph.n_ranked] == low[k]:
            slots[k] += 1
    found = slots >= 0
    found[found] = prints[slots[found]] == high[found]
    found[found] = counts[slots[found]] >= min_docs
    hits = probes[found]
    return hits[[a != b for a, b in zip(hits["id"].tolist(), keepers[slots[found]], strict=True)]][["id", "key"]]


def lines_to_drop(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keys_per_shard: int = KEYS_PER_SHARD, probes_per_slice: int = PROBES_PER_SLICE) -> DataFrame:
    """``(id, keys)``: for each document that loses lines, the hashes of those lines' keys."""
    spark = docs.sparkSession
    lines = written(long_line_hashes(docs, min_chars), "line-hashes")
    counts = written(lines.dropDuplicates(["key", "id"]).groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper")).where("n_docs > 1"), "line-counts")
    shards = max(1, math.ceil(counts.count() / keys_per_shard))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    index = build_index(counts.select(shard, "key", "n_docs", "keeper"))
    # One small row per shard.
    slices = lines.groupBy(shard).count().select("shard", F.ceil(F.col("count") / probes_per_slice).cast("int").alias("slices"))
    probes = lines.select(shard, "id", "key").join(F.broadcast(slices), "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "key")
    index = index.join(F.broadcast(slices), "shard").select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).drop("slices")
    dropped = probes.groupBy("shard", "slice").cogroup(index.groupBy("shard", "slice")).applyInPandas(lambda p, x: probe(p, x, min_docs), StructType([docs.schema["id"], StructField("key", BinaryType())]))
    return dropped.groupBy("id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, **sizes) -> DataFrame:
    r"""Drops lines that many documents hold, except from the document with the largest id that holds them.

    Texts split at ``\n``; a null or empty text is one empty line. A line's key is the line without ``[\x20\x09-\x0D]``
    at its ends, A-Z lower-cased. All lines whose key has ``min_chars`` code points or more and occurs in ``min_docs``
    documents or more go, except in the largest ``id_col`` that holds the key.

    Returns the rows of ``docs`` with all their columns, ``text_col`` replaced by what is left (never null), plus
    ``__gs_n_lines`` and ``__gs_n_dropped``. Rows that share an id are one document: they count once and all keep
    their lines if theirs is the largest id. Rows whose id is null are one document as well, and never the keeper of
    a line that another document holds. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drops = lines_to_drop(base, min_chars, min_docs, **sizes).select(F.col("id").alias(f"{OWN}id"), F.col("keys").alias(f"{OWN}keys"))

    @F.arrow_udf("struct<text:string,n_lines:bigint,n_dropped:bigint>")
    def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out, lines, dropped = [], [], []
        for raw, bad in zip(_bytes_of(texts), keys.to_pylist(), strict=True):
            parts = raw.split(b"\n")
            lines.append(len(parts))
            if bad:
                bad = set(bad)
                parts = [p for p, k in zip(parts, line_keys(raw, min_chars), strict=True) if k not in bad]
            dropped.append(lines[-1] - len(parts))
            out.append(b"\n".join(parts))
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    # Documents that miss a filter over those which lose lines pass by the join, which is the same one at every size.
    drops = written(drops, "lines-to-drop")
    key = f"{OWN}key"
    marked = Filter(drops.select(F.xxhash64(f"{OWN}id").alias(key)), key).mark(docs.withColumn(key, F.xxhash64(id_col)), key)
    sure, asked = marked.where("NOT __gs_maybe"), marked.where("__gs_maybe")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = (F.regexp_count(whole, F.lit("\n")) + 1).cast("long").alias(f"{OWN}n_lines")
    sure = sure.select(*[whole.alias(c) if c == text_col else F.col(c) for c in docs.columns], n_lines, F.lit(0).cast("long").alias(f"{OWN}n_dropped"))
    joined = asked.join(drops.hint("merge"), F.col(id_col).eqNullSafe(F.col(f"{OWN}id")), "left").withColumn(f"{OWN}cut", cut(F.col(text_col), F.col(f"{OWN}keys")))
    own = F.col(f"{OWN}cut")
    return sure.unionByName(joined.select(*[own["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns], own["n_lines"].alias(f"{OWN}n_lines"), own["n_dropped"].alias(f"{OWN}n_dropped")))


def digest_of_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result that the query returns: counts, and the SHA-256 of what each document keeps."""
    out = dedup_lines(docs.select(id_col, text_col), id_col, text_col)
    return out.select(id_col, F.col(f"{OWN}n_lines").alias("n_lines"), F.col(f"{OWN}n_dropped").alias("n_dropped"), F.sha2(F.col(text_col), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], min_chars: int = 40, min_docs: int = 5) -> list[tuple]:
    """The same by plain Python over ``(id, text)`` rows, for tests."""
    holders: dict[str, set] = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(k := key(line)) >= min_chars:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(h := holders.get(key(x), set())) < min_docs or i == max(v for v in h if v is not None)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out
