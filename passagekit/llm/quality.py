"""Operator 3: quality classifier, logistic regression on hashed word n-grams.

Words and runs of punctuation are hashed, alone and in pairs, beside runs of up to three word shapes
(case, digits, which punctuation), which carry over to unseen vocabulary. The weights are learned
by follow-the-regularised-leader updates, and a document's score is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.runtime import ship_code, table

_TOKENS = re.compile(r"\w+|[^\w\s]+")
_M = np.uint64(0x9E3779B97F4A7C15)


class _Tokens(dict):
    """Token -> hash of its lower case << 8 | its shape, remembered up to a bound."""

    def __missing__(self, t):
        if len(self) >= 200_000:
            self.clear()
        if t.isalpha():
            shape = 1 + t.isupper() + 2 * t.istitle() + 4 * (len(t) > 2)
        elif t.isdigit():
            shape = 9 + min(3, len(t))
        else:
            shape = 16 + zlib.crc32((t[0] + str(min(len(t), 4))).encode("utf-8", "replace")) % 200
        v = self[t] = zlib.crc32(t.lower().encode("utf-8", "replace")) << 8 | shape
        return v


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _M
    return (x ^ x >> np.uint64(29)) * _M >> np.uint64(40)


def hashed_features(text: str, bits: int, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers ascending, values): logarithmic counts, scaled to length 1; none for a text without tokens."""
    t = np.fromiter(map(tokens.__getitem__, _TOKENS.findall(text)), np.uint64)
    if not t.size:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    w, s = t >> np.uint64(8), t & np.uint64(255)
    parts = [_mix(w, 1), _mix(s, 2)]
    if t.size > 1:
        parts += [_mix(w[:-1] * np.uint64(31) + w[1:] * np.uint64(0x10001) * _M, 3), _mix(s[:-1] << np.uint64(8) | s[1:], 4)]
    if t.size > 2:
        parts.append(_mix(s[:-2] << np.uint64(16) | s[1:-1] << np.uint64(8) | s[2:], 5))
    idx, counts = np.unique((np.concatenate(parts) & np.uint64((1 << bits) - 1)).astype(np.int32), return_counts=True)
    values = np.log1p(counts).astype(np.float32)
    return idx, values / np.sqrt((values * values).sum())


def ftrl(rows, bits: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """FTRL-proximal logistic regression over (indices, values, label) rows, in the order given; the last weight is the bias."""
    n, z = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = np.array([1 << bits], np.int32)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for idx, values, label in rows:
            i, v = np.concatenate([idx, bias]), np.concatenate([values, [1.0]])
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip((w * v).sum(), -30, 30))) - label) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, most: int, bits: int) -> list:
    """Features of at most `most` labelled rows whose crc32(doc_id) mod 3 is not 1: those of the
    smallest hashed ids, so the choice is random, repeatable and independent of partitions."""
    ids = labels.filter("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 3 != 1")
    ids = ids.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)

    def run(batches):
        tokens = _Tokens()
        for b in batches:
            made = [hashed_features((x or b"").decode("utf-8", "replace"), bits, tokens) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["doc_id", "quality", "i", "v"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    rows = chosen.select("doc_id", F.col("quality").cast("int"), "t").mapInArrow(run, "doc_id long, quality int, i binary, v binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(b"%d order" % r.doc_id), r.doc_id))
    return [(np.frombuffer(r.i, np.int32), np.frombuffer(r.v, np.float32), r.quality) for r in rows]


def score_quality(docs: DataFrame, labels: DataFrame, most: int = 2500, bits: int = 18) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    Learns from at most `most` labelled rows that are not held out (crc32 of the doc_id as text, mod
    3, is not 1); nothing but the text enters a score. Null and empty texts, and those without a
    token, get the bias alone; without labels of both kinds every score is the share of label 1
    (0.5 without any). A null doc_id is not held out. Labels that repeat a doc_id count as the
    highest of them. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = training_rows(docs, labels, most, bits)
    share = sum(r[2] for r in rows) / len(rows) if rows else 0.5
    if 0 < share < 1:
        weights = ftrl(rows, bits)
    else:
        weights = np.zeros((1 << bits) + 1, np.float32)
        weights[-1] = 0.0 if not rows else 30.0 * (2 * share - 1)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        w, tokens = shared.value, _Tokens()
        for b in batches:
            sums = np.empty(b.num_rows)
            for k, x in enumerate(b.column(2).to_pylist()):
                i, v = hashed_features((x or b"").decode("utf-8", "replace"), bits, tokens)
                sums[k] = float(w[i] @ v) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_ftrl_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
