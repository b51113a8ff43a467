"""A membership filter of bounded size, as DataFrame functions: blocks of bits that are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one block: what ``bitmap_construct_agg`` holds.
BLOCK_BITS = 32768
#: Bound of a broadcast filter: 4096 blocks of 4 KiB, 16 MiB.
MAX_BLOCKS = 4096
BITS_PER_KEY = 16


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    at = F.pmod(key, F.lit(blocks * BLOCK_BITS))
    return F.floor(at / BLOCK_BITS).cast("int"), F.pmod(at, F.lit(BLOCK_BITS))


class Filter:
    """Over the longs of the column ``key``. Beyond its bound it lets more rows pass, never fewer."""

    def __init__(self, keys: DataFrame, key: str = "key"):
        need = keys.count() * BITS_PER_KEY // BLOCK_BITS + 1
        self.blocks = min(MAX_BLOCKS, 1 << (need - 1).bit_length())
        block, bit = _place(F.col(key), self.blocks)
        self.bits = keys.select(block.alias("__gs_block"), bit.alias("__gs_bit")).groupBy("__gs_block").agg(F.bitmap_construct_agg("__gs_bit").alias("__gs_bits"))

    def mark(self, rows: DataFrame, key: str, name: str = "__gs_maybe") -> DataFrame:
        """``rows`` with a boolean: false means that ``key`` is not among the keys."""
        block, bit = _place(F.col(key), self.blocks)
        byte = F.conv(F.hex(F.substring("__gs_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
        return rows.withColumn("__gs_block", block).join(F.broadcast(self.bits), "__gs_block", "left").withColumn(name, hit).drop("__gs_block", "__gs_bits")
