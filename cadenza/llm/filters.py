"""A Bloom filter in DataFrame functions, for dropping rows before a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import stored


class KeyFilter:
    """A Bloom filter over a one-column table: one row with one array of longs.

    It has 12 to 24 bits a key, up to 2^26 bits (8 MB) in all; with more keys it lets more rows pass. What follows it has to be
    exact. An empty table lets nothing pass.
    """

    def __init__(self, keys: DataFrame, most_log_bits: int = 26, hashes: int = 3):
        self.log_bits, self.hashes = min(most_log_bits, max(12, math.ceil(math.log2(12 * keys.count() + 1)))), hashes
        spark = keys.sparkSession
        slots = keys.select(F.explode(F.array(*self._slots(F.col(keys.columns[0])))).alias("slot"))
        bits = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        filled = spark.range(1 << (self.log_bits - 6)).withColumnRenamed("id", "word").join(bits, "word", "left")
        rows = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        self.table = stored(filled.agg(F.transform(rows, lambda x: x["bits"]).alias("words")), "filter")

    def _slots(self, key: Column) -> list[Column]:
        mask = (1 << self.log_bits) - 1
        return [F.xxhash64(F.lit(j), key).bitwiseAND(F.lit(mask)) for j in range(self.hashes)]

    def might_hold(self, key: Column) -> Column:
        words, found = self.table.scalar(), F.lit(True)
        for slot in self._slots(key):
            bit = F.call_function("shiftright", F.get(words, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int"))
            found = found & (bit.bitwiseAND(F.lit(1)) == 1)
        return found
