"""Operator 5: approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is scaled to length 1, turned by one random rotation and reduced to the signs of its
coordinates (packed bits) and a correction scalar. Queries are quantised to four bits a coordinate,
so that population counts of four bit planes estimate inner products without bias; the scalar and
the dimension bound the error. Only vectors whose upper bound reaches the k-th best lower bound
are compared exactly.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.runtime import cut, ship_code, table

SEED = 2024
PLANES = 4
BLOCK_ROWS = 65_536
QUERY_ROWS = 8_192


@functools.lru_cache(8)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """(n, dim) booleans -> (n, words) uint64."""
    words = -(-bits.shape[1] // 64)
    padded = np.zeros((len(bits), words * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, correction scalars) of vectors: the scalar is the inner product of a vector's unit form with its code's."""
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    turned = unit @ rotation(vectors.shape[1])
    return _packed(turned > 0), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def estimate(queries: np.ndarray, codes: np.ndarray, scalars: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines, error bounds), both queries x codes."""
    dim = queries.shape[1]
    turned = (queries / np.sqrt((queries * queries).sum(1, keepdims=True))) @ rotation(dim)
    low = turned.min(1, keepdims=True)
    step = np.maximum((turned.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
    levels = np.rint((turned - low) / step).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    sums = np.zeros((len(queries), len(codes)))
    for p in range(PLANES):
        plane = _packed(levels >> p & 1)
        for w in range(codes.shape[1]):
            sums += float(1 << p) * np.bitwise_count(plane[:, w, None] & codes[None, :, w])
    total = dim * low + step * levels.sum(1, keepdims=True, dtype=np.float64)
    inner = (2 * (low * ones + step * sums) - total) / np.sqrt(dim) / scalars
    noise = np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / np.sqrt(max(1, dim - 1)) + step * 0.3 / scalars
    return inner, spread * noise


def search_block(query_ids, queries, ids, vectors, codes, scalars, k: int, spread: float):
    """(query ids, ids, cosines) of each query's best k of the block: largest cosine, ties to the smaller id."""
    norms = np.sqrt((vectors * vectors).sum(1))
    out_q, out_i, out_s = [], [], []
    rows = max(1, 4_000_000 // max(1, len(ids)))
    for a in range(0, len(queries), rows):
        inner, bound = estimate(queries[a : a + rows], codes, scalars, spread)
        lower, upper = inner - bound, inner + bound
        for j in range(len(inner)):
            other = ids != query_ids[a + j]
            if not (n := int(other.sum())):
                continue
            least = np.partition(lower[j][other], max(0, n - k))[max(0, n - k)]
            near = np.flatnonzero(other & (upper[j] >= least))
            q = queries[a + j]
            cosine = (vectors[near] * q).sum(1) / (norms[near] * np.sqrt((q * q).sum()))
            best = np.lexsort((ids[near], -cosine))[:k]
            out_q += [query_ids[a + j]] * len(best)
            out_i += ids[near[best]].tolist()
            out_s += cosine[best].tolist()
    return out_q, out_i, out_s


def _matrix(column, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _index(batches):
    for b in batches:
        kept = []
        for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if v and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    # A power of two takes no digit away, and squares neither overflow nor vanish.
                    kept.append((vec_id, np.ldexp(x, -np.frexp(np.abs(x).max())[1])))
        found: dict[int, list] = {}
        for vec_id, x in kept:
            found.setdefault(len(x), []).append((vec_id, x))
        for dim, rows in found.items():
            x = np.array([r[1] for r in rows])
            codes, scalars = encode(x)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([dim] * len(rows), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(scalars)], ["vec_id", "dim", "vec", "code", "scalar"])


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, spread: float = 3.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every`, the k nearest
    others (all, if fewer) by cosine in double precision on the original vectors, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows without an id; an empty table gives no rows; of rows that repeat an id, the smallest array counts. Vectors of different
    length are never compared. Other columns are ignored. `spread` times the standard error bounds
    the estimates: at 3, about one in a thousand true neighbours may be missed.
    Every row is indexed; queries meet rows in blocks of bounded size, dealt by hash.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    index = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(_index, "vec_id long, dim int, vec binary, code binary, scalar double"))
    size = index.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    # At least some blocks to share the work, at most BLOCK_ROWS rows in one.
    blocks = max(-(-size.n // BLOCK_ROWS), min(64, -(-size.n // 256)), 1)
    query_blocks = max(-(-size.q // QUERY_ROWS), 1)
    queries = index.filter(F.col("vec_id") % every == 0).select("dim", F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).alias("qb"))
    queries = queries.withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    data = index.withColumn("db", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))

    def block(q: pa.Table, d: pa.Table) -> pa.Table:
        found = ([], [], [])
        if q.num_rows and d.num_rows:
            dim = q.column("dim")[0].as_py()
            found = search_block(
                q.column("query_id").to_numpy(), _matrix(q.column("query"), dim, "<f8"), d.column("vec_id").to_numpy(), _matrix(d.column("vec"), dim, "<f8"),
                _matrix(d.column("code"), -(-dim // 64), "<u8"), d.column("scalar").to_numpy(), k, spread,
            )
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    keys = ("dim", "qb", "db")
    hits = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(block, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_one_bit_codes(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
