"""A Bloom filter of fixed size that Spark builds and tasks ask: it prunes, exact counts decide later.

Its keys are 64-bit hashes made in tasks. The bits are gathered by Spark's bitmap aggregate, 32,768
to a row, so the driver gets ``2 ** BITS / 8`` bytes at most whatever the input is. A filter that
fills up lets more keys through and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import in_batches

BITS = 24  # 2 MB
PROBES = 2
ROW_BITS = 15  # bits of one row of Spark's bitmap aggregate


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of it."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a sequence that goes on with a word."""
    return mixed(h * np.uint64(0x9E3779B97F4A7C15) + word)


def places(h: np.ndarray) -> list[np.ndarray]:
    """The bit that each probe sets, by the hash."""
    return [(mixed(h + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64) for i in range(PROBES)]


def build(keyed: DataFrame, hashes) -> bytes:
    """The filter of the keys that ``hashes(batch)`` gives for Arrow batches of ``keyed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(np.concatenate(places(hashes(batch))))
                columns = [pa.array(at >> ROW_BITS), pa.array(at & ((1 << ROW_BITS) - 1))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "bit"])

    rows = in_batches(keyed, run, "row long, bit long").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filled = bytearray(1 << BITS - 3)
    width = 1 << ROW_BITS - 3
    for row, bits in rows.collect():  # at most 2 ** (BITS - ROW_BITS) rows
        filled[row * width : (row + 1) * width] = bits
    return bytes(filled)


def holds(bits: bytes, h: np.ndarray) -> np.ndarray:
    """False only for hashes that were never put in."""
    table = np.frombuffer(bits, dtype=np.uint8)
    found = np.ones(len(h), dtype=bool)
    for at in places(h):
        found &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found
