"""Bloom filters of bounded size: what may be in a table, broadcast to tasks.

A filter only spares work. When a table outgrows it, false positives grow and with
them the rows that come through, never the result.
"""

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits: ten for each value, within these bounds. At most 32 MB are broadcast.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
BLOCK_BITS = 20


class Bloom:
    """A set of 64-bit hashes with false positives, as bits in blocks."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.mask = np.uint64(bits - 1)
        self.bits = np.zeros(bits >> 3, np.uint8)
        size = 1 << (BLOCK_BITS - 3)
        for number, block in blocks.items():
            self.bits[number * size : (number + 1) * size] = np.frombuffer(block, np.uint8)

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for shift in (np.uint64(0), np.uint64(32)):
            place = (values >> shift) & self.mask
            out &= (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def bloom_of(hashes: DataFrame) -> Broadcast:
    """A :class:`Bloom` of the column ``hash`` of a stored table, as a broadcast."""
    spark = hashes.sparkSession
    bits = 1 << max(0, (10 * hashes.count() - 1).bit_length())
    bits = min(MOST_BITS, max(LEAST_BITS, bits))
    places = hashes.select(
        F.explode(
            F.array(
                F.col("hash").bitwiseAND(F.lit(bits - 1)),
                F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1)),
            )
        ).alias("place")
    ).distinct()

    def pack(key, group):
        flags = np.zeros(1 << BLOCK_BITS, np.uint8)
        flags[group.column("place").to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        packed_bits = np.packbits(flags, bitorder="little").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([packed_bits], pa.binary())})

    blocks = (
        places.withColumn("block", F.shiftright("place", BLOCK_BITS)).groupBy("block").applyInArrow(pack, "block long, bits binary")
    )
    return spark.sparkContext.broadcast(Bloom(bits, {r.block: bytes(r.bits) for r in blocks.toLocalIterator()}))
