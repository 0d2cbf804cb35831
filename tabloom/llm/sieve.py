"""A bitmap of hashed ids in a fixed number of bytes, broadcast to tasks so that they leave out most of what cannot matter.

It never misses an id that was put in.  Beyond ``SIEVE_BYTES`` it fills up and lets more through, so only work grows, and results, which
are always counted or compared again behind it, stay the same.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SIEVE_BYTES = 32 << 20
CHUNKS = 64
SPARE = 16  # bits for an id, while there is room


class Sieve(NamedTuple):
    bits: np.ndarray  # packed, low bit first
    shift: int

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id (uint64, spread over all its bits) may have been put in."""
        at = ids >> np.uint64(self.shift)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def build(ids: DataFrame, most: int = SIEVE_BYTES) -> Sieve:
    """The sieve of the long column ``id``; its chunks are made in tasks, the driver joins ``most`` bytes at the most."""
    width = min((8 * most).bit_length() - 1, max(16, (SPARE * ids.count()).bit_length()))
    per = (1 << width) // CHUNKS

    def chunk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros(per, bool)
        bits[table["at"].combine_chunks().to_numpy() % per] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    places = ids.select(F.shiftrightunsigned("id", 64 - width).alias("at")).withColumn("chunk", F.expr(f"cast(at div {per} as int)"))
    rows = places.repartition("chunk").distinct().groupBy("chunk").applyInArrow(chunk, "chunk int, bits binary").collect()
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in rows:
        out[r.chunk * per // 8 : (r.chunk + 1) * per // 8] = np.frombuffer(r.bits, np.uint8)
    return Sieve(out, 64 - width)
