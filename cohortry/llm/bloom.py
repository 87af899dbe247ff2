"""Bloom filters built by Spark aggregations and probed with numpy inside tasks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import ship_by_value

ship_by_value(__name__)

WORD = 64


@dataclass
class Bloom:
    """A filter of keys hashed with its seed: size in bits, number of probes, bits in 64-bit words."""

    seed: int
    bits: int
    probes: int
    words: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """For hashes by ``key_hash`` with this filter's seed: False only for keys that were not put in."""
        h = hashes.view(np.uint64)
        high, low, out = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF), np.ones(len(h), bool)
        for i in range(self.probes):
            at = (high + np.uint64(i) * low) % np.uint64(self.bits)
            out &= (self.words[at // np.uint64(WORD)] >> (at % np.uint64(WORD))) & np.uint64(1) == 1
        return out


def key_hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def bits_for(n: int, rate: float) -> int:
    """Bits for n keys at a rate of false positives, a multiple of the word."""
    probes = max(1, round(-math.log2(rate)))
    return max(WORD, -(-int(n * probes / math.log(2)) // WORD) * WORD)


def build(keys: DataFrame, n: int, rate: float, seed: int, most_bits: int) -> Bloom:
    """A filter of the column ``key`` with about n keys, of ``most_bits`` bits at most.

    Beyond that size the rate of false positives rises. Bits are set by an aggregation; only words with a bit set reach the
    driver, at most ``most_bits`` / 64 of them.
    """
    probes, bits = max(1, round(-math.log2(rate))), min(most_bits, bits_for(n, rate))
    h = key_hash(F.col("key"), seed)
    high, low = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
    at = F.explode(F.array(*[(high + i * low) % bits for i in range(probes)]))
    placed = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / WORD).alias("word"))
    rows = placed.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask")).toArrow()
    words = np.zeros(bits // WORD, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    return Bloom(seed, bits, probes, words)
