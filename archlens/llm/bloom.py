"""A blocked Bloom filter of 64-bit hashes, built on executors and small enough to be sent to all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits a block, bits a key sets, bits of the filter for each key, and the most blocks a filter may have (64 MB). Beyond that it lets
#: more pass, which whoever asks it must bear.
BLOCK_BITS, PROBES, BITS_PER_KEY, MOST_BLOCKS = 512, 8, 16, 1 << 20


class BlockedBloom:
    """Bits of each key lie in one block: one cache line for each test."""

    def __init__(self, keys: int):
        import numpy as np

        self.blocks = min(MOST_BLOCKS, max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS)))
        self.words = np.zeros((self.blocks, BLOCK_BITS // 64), np.uint64)

    def _places(self, hashes):
        import numpy as np

        h = np.asarray(hashes).astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        odd = (h & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        for _ in range(PROBES):
            odd = odd * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
            bit = odd >> np.uint64(55)
            yield block.astype(np.int64), (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def add(self, hashes) -> None:
        import numpy as np

        for block, word, bit in self._places(hashes):
            np.bitwise_or.at(self.words, (block, word), bit)

    def __contains__(self, hashes):
        return bool(self.test([hashes])[0])

    def test(self, hashes):
        import numpy as np

        hit = np.ones(len(hashes), bool)
        for block, word, bit in self._places(hashes):
            hit &= (self.words[block, word] & bit) != 0
        return hit


def build_filter(hashes: DataFrame) -> BlockedBloom:
    """The filter of a column of hashes. Parts are built on executors and joined there by blocks; the driver gets one row a block, of
    which there are at most ``MOST_BLOCKS``."""
    import numpy as np

    bloom = BlockedBloom(hashes.count())
    blocks, words = bloom.blocks, [f"w{i}" for i in range(bloom.words.shape[1])]

    def part(batches):
        import pyarrow as pa

        own = BlockedBloom(0)
        own.blocks, own.words = blocks, np.zeros((blocks, len(words)), np.uint64)
        for batch in batches:
            own.add(batch.column(0).to_numpy())
        at = np.flatnonzero(own.words.any(axis=1))
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            bits = own.words[some].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(bits[:, j]) for j in range(len(words))]], names=["block", *words])

    schema = "block long, " + ", ".join(f"{w} long" for w in words)
    told = hashes.mapInArrow(part, schema).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).toArrow()
    if told.num_rows:
        bloom.words[told.column("block").to_numpy()] = np.stack([told.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
    return bloom
