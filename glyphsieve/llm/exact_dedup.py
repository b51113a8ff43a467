"""Exact dedup through a log-structured merge index of digests (DataFrame functions only).

1. *Memtable flush.* A batch of documents becomes sorted runs. A run takes the documents whose id hashes to it; there are
   as many runs as keep a run's part of a bucket within ``MEMTABLE_ROWS`` entries. Map-side aggregation leaves one entry
   per digest. Runs are bucketed and sorted by digest and carry Parquet's Bloom filters, which lookups of single
   digests read.
2. *Compaction.* A level of ``FANOUT`` batches is merged into one batch of the next level: an entry per digest with the
   surviving identifier and the number of rows. Identifiers are compared in keep order, so the survivor is the smallest
   one in that order (``keep="largest"`` orders identifiers downwards). All runs have the same buckets, so a merge reads,
   aggregates and writes bucket by bucket without an exchange.
3. *Probe and verification.* Digests seen twice or more set bits in a blocked filter of bounded size, which is broadcast.
   Rows that miss it are unique and leave without any shuffle. Rows that hit it receive byte verification: their
   texts are grouped by their bytes, map-side first, and never by digest alone.

A text's digest is computed once and written with its identifier; the rows of a verified group are found by digest among
those, so the texts of copies are not shuffled. Only where two texts share a digest are their rows joined by text.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, remove, written
from .filters import Filter

#: Entries of one run in one bucket.
MEMTABLE_ROWS = 1 << 17
#: Batches of a level that are merged into the next one.
FANOUT = 4
MIN_BUCKETS, MAX_BUCKETS = 16, 4096
#: Parquet's own filters, as small as each file allows (by default each takes a megabyte).
BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


class Index:
    """``(digest, survivor, n)`` in a bucketed table below the shared folder, with a partition per level, batch and run.

    ``rows`` is how many the index is made for: it sets the number of buckets. More rows than that give more runs, not
    larger ones.
    """

    def __init__(self, spark: SparkSession, rows: int, keep: str = "largest", memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.spark, self.best, self.memtable_rows, self.fanout = spark, F.max if keep == "largest" else F.min, memtable_rows, fanout
        self.buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << max(0, math.ceil(rows / memtable_rows) - 1).bit_length()))
        self.name, self.path = f"gs_index_{uuid.uuid4().hex}", new_path(spark, "lsm")
        self.levels: list[list[int]] = []
        self.batches = 0

    def _store(self, entries: DataFrame, level: int) -> None:
        placed = entries.repartition(self.buckets, "digest").select("digest", "survivor", "n", F.lit(level).alias("level"), F.lit(self.batches).alias("batch"), "run")
        placed.write.mode("append").format("parquet").options(**BLOOM).option("path", self.path).partitionBy("level", "batch", "run").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.batches)
        self.batches += 1

    def _merged(self, level: int | None = None) -> DataFrame:
        rows = self.spark.table(self.name)
        rows = rows if level is None else rows.where(F.col("level") == level)
        return rows.groupBy("digest").agg(self.best("survivor").alias("survivor"), F.sum("n").alias("n"))

    def flush(self, digests: DataFrame, rows: int) -> None:
        """A batch ``(digest, id)`` of ``rows`` rows; merges levels that have become full."""
        runs = max(1, math.ceil(rows / (self.buckets * self.memtable_rows)))
        run = F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run")
        self._store(digests.groupBy(run, "digest").agg(self.best("id").alias("survivor"), F.count(F.lit(1)).alias("n")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the batches of a level into one of the next."""
        gone = self.levels[level]
        self._store(self._merged(level).withColumn("run", F.lit(0)), level + 1)
        self.levels[level] = []
        for batch in gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (level = {level}, batch = {batch})")
            remove(self.spark, f"{self.path}/level={level}/batch={batch}")
        self.spark.catalog.refreshTable(self.name)

    def entries(self) -> DataFrame:
        """An entry per digest, over all levels."""
        return self._merged()

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """The entries of some digests; parts of runs whose filters don't know them are not read."""
        known = F.col("digest").isin([bytearray(d) for d in digests])
        return self.spark.table(self.name).where(known).groupBy("digest").agg(self.best("survivor").alias("survivor"), F.sum("n").alias("n"))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Groups rows of equal text and marks the one that stays.

    Returns one row per input row: ``id_col, keep_id, group_size, kept, text_sha256``. Other columns of ``docs``
    are not read, so their names can't clash. Null texts count as empty. ``keep`` is ``largest`` or ``smallest``
    identifier. Ties: rows that repeat the surviving identifier are all kept and all count in ``group_size``. A null
    identifier survives only in a group without any other. An empty table gives an empty result.
    ``digest_bytes`` shortens the digest that the index uses (tests force collisions with it); results don't change.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    short = F.substring("sha", 1, digest_bytes).alias("digest")
    digests = written(texts.select("id", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "digests").select("id", "key", "sha", short)
    n = digests.count()
    index = Index(spark, n, keep, memtable_rows)
    index.flush(digests.select("digest", "id"), n)
    index.compact(0)
    twice = written(index.entries().where("n > 1").select(F.xxhash64("digest").alias("key")), "repeated-digests")
    index.close()
    # By digest among the written rows, then by a cheaper hash of the text, so that the probe computes no digest again.
    seen = Filter(twice).mark(digests.withColumn("of", F.xxhash64("digest")), "of").where("__gs_maybe")
    probe = Filter(written(seen.select("key").distinct(), "repeated-texts"))
    marked = probe.mark(digests, "key")
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    sole = marked.where("NOT __gs_maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    hits = probe.mark(texts, "key").where("__gs_maybe").select("id", "text")
    groups = hits.groupBy("text").agg(index.best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    groups = written(groups, "groups").withColumn("digest", short)
    named = written(groups.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")), "verified")
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    copies = marked.where("__gs_maybe").join(named.where("texts = 1"), "digest").select("id", "keep_id", "group_size", kept, sha)
    found = sole.unionByName(copies)
    shared = named.where("texts > 1").select("digest")
    if shared.take(1):
        several = groups.join(shared, "digest").select("text", "keep_id", "group_size", "sha")
        found = found.unionByName(hits.join(several, "text").select("id", "keep_id", "group_size", kept, sha))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")
