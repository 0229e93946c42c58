"""Pigeonhole block joins on 64-bit fingerprints.

Split 64 bits into `blocks` pieces. Two fingerprints that differ in at most d bits agree on at
least blocks - d of them, so they share the key made of some choice of blocks - d pieces. A key is
formed for every choice; rows that share one are candidates, and only candidates are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_masks(blocks: int) -> list[int]:
    """Bit masks of `blocks` nearly equal pieces of 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def signed(x: int) -> int:
    """The same 64 bits as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def key_masks(distance: int, blocks: int) -> list[int]:
    if not 0 <= distance < blocks <= 64:
        raise ValueError("need 0 <= distance < blocks <= 64")
    return [signed(sum(c)) for c in combinations(block_masks(blocks), blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """Blocks such that a key's random neighbours stay few among n distinct fingerprints."""
    for blocks in range(distance + 2, distance + 5):
        if n / 2 ** (64 * (blocks - distance) / blocks) <= 8:
            return blocks
    return distance + 5


def tiled(rows: DataFrame, key: str, tile: int, by: str) -> DataFrame:
    """Split groups larger than `tile` rows so that none is ever gathered whole.

    rows has columns `key`, cnt (rows of its group) and `by`. Each row is dealt to one of
    T = ceil(cnt / tile) tiles and copied to the T tile pairs that hold its tile; every two rows of
    a group meet in some pair (ti <= tj). A group of at most `tile` rows is one pair, with no copy."""
    t = F.ceil(F.col("cnt") / tile).cast("int")
    mine = F.pmod(F.hash(F.col(by), F.lit(7)), t)
    out = rows.withColumn("_t", t).withColumn("_m", mine)
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    return out.withColumn("ti", F.least("_m", "_o")).withColumn("tj", F.greatest("_m", "_o")).drop("_t", "_m", "_o")


_MIXERS = np.random.default_rng(6).integers(0, 1 << 64, 128, np.uint64) | np.uint64(1)


def min_keys(h: np.ndarray, starts: np.ndarray, keys: int, minima: int) -> np.ndarray:
    """MinHash keys (uint64, one row a key) of groups of hashes h that begin at `starts`, none empty: each from
    the least of `minima` mixings."""
    out = np.empty((keys, starts.size), np.uint64)
    mixed = np.empty_like(h)
    for c in range(keys):
        key = np.full(starts.size, c + 1000 * minima, np.uint64)
        for j in range(c * minima, (c + 1) * minima):
            np.multiply(h, _MIXERS[j], out=mixed)
            key = (key ^ np.minimum.reduceat(mixed, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[c] = key
    return out


BITMAP_WORDS = 1 << 20


def bitmap(keys: DataFrame):
    """A broadcast filter of fixed size (8 MB) over keys (h long); a hit may be false, a miss is not."""
    word = F.pmod(F.shiftrightunsigned("h", 6), F.lit(BITMAP_WORDS))
    rows = keys.groupBy(word.alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("b")).toArrow()
    bits = np.zeros(BITMAP_WORDS, np.uint64)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def wanted(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (uint64) the filter may hold."""
    return (bits[(keys >> np.uint64(6)) % np.uint64(bits.size)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)
