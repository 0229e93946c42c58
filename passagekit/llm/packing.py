"""Operator 10: packing token sequences by length patterns.

Only the histogram of piece lengths (at most `capacity` bins, whatever the corpus) is planned on
the driver: few-document patterns that fill a sequence are enumerated, non-negative least squares
fits how often each is repeated to the whole histogram, the repeats are rounded down, and the residual histogram is
packed best-fit, many equal sequences at a time. Pieces get their places by rank within a length.

Pairs and triples are enumerated outright; of the many patterns of up to `MOST` documents those are added that a pursuit
meets: again and again the fullest pattern of the commonest lengths left over, found by dynamic programming.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekit.llm.bpe import Vocabulary, load_vocabulary, texts_of
from passagekit.runtime import cut, ship_code, table


#: The most documents in a pattern, and the most patterns that the pursuit adds.
MOST, PURSUED = 4, 1000


def enumerate_patterns(hist: dict[int, int], capacity: int, rows: int = 4096) -> list[tuple[int, ...]]:
    """Patterns of two to MOST lengths that fill a sequence exactly: every pair, the `rows` triples of the commonest
    lengths, and what the pursuit finds."""
    have = sorted(hist)
    found = {(a, capacity - a) for a in have if a <= capacity - a and capacity - a in hist}
    n = np.zeros(capacity + 1)
    n[have] = [hist[x] for x in have]
    triples = []
    for a in have:
        b = np.array([x for x in have if a <= x <= (capacity - a) // 2], np.int64)
        if b.size:
            least = np.minimum(np.minimum(n[a], n[b]), n[capacity - a - b])
            triples += [(-m, a, int(x), capacity - a - int(x)) for m, x in zip(least.tolist(), b.tolist()) if m > 0]
    found |= {t[1:] for t in heapq.nsmallest(rows, triples)}
    return sorted(found | set(pursued(hist, capacity)))


def pursued(hist: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns that fill a sequence exactly with at most MOST documents, one after the other: that of the greatest sum
    of counts still left, as often as its lengths last. Every one uses up a length."""
    left = np.zeros(capacity + 1)
    for n, c in hist.items():
        left[n] = c
    # turned[c, a]: c - a, or one beyond the last length where that is less than nothing.
    turned = np.arange(capacity + 1)[:, None] - np.arange(capacity + 1)
    turned[turned < 0] = capacity + 1
    padded = lambda x: np.append(x, -np.inf)
    out = []
    while len(out) < PURSUED:
        have = np.flatnonzero(left)
        if not have.size:
            break
        one = np.where(left > 0, left, -np.inf)
        # two[c]: the greatest sum of counts of two lengths that make c; three and four follow from it.
        value = padded(one)[turned[:, have]] + one[have]
        last = have[value.argmax(axis=1)]
        two = value.max(axis=1)
        sums = one[::-1] + one, two[::-1] + one, two[::-1] + two
        k = max(range(3), key=lambda i: sums[i].max())
        c = int(sums[k].argmax())
        if not np.isfinite(sums[k][c]):
            break
        halves = [c, capacity - c]
        pattern = []
        for half, pair in zip(halves, ((False, False), (False, True), (True, True))[k]):
            pattern += [int(last[half]), half - int(last[half])] if pair else [half]
        lengths, times = np.unique(pattern, return_counts=True)
        repeats = (left[lengths] // times).min()
        if repeats < 1:  # a length is left less often than the pattern holds it
            left[lengths[(left[lengths] // times).argmin()]] = 0
            continue
        left[lengths] -= repeats * times
        if len(pattern) > 1:
            out.append(tuple(sorted(pattern)))
    return out


def fit_repeats(patterns: list[tuple[int, ...]], hist: dict[int, int], sweeps: int = 40) -> list[float]:
    """Non-negative least squares: repeats x >= 0 that bring the patterns' lengths closest to the
    histogram, by cyclic coordinate descent on the sparse columns."""
    left = {n: float(c) for n, c in hist.items()}
    columns = [[(n, p.count(n)) for n in sorted(set(p))] for p in patterns]
    norms = [sum(k * k for _, k in c) for c in columns]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, column in enumerate(columns):
            step = max(-x[i], sum(k * left[n] for n, k in column) / norms[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for n, k in column:
                    left[n] -= step * k
        if moved < 0.5:
            break
    return x


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit packing of a histogram, equal sequences together: the longest length opens a
    sequence, the longest one that fits fills it, until none does; the sequence is repeated as often
    as its lengths last. Every step uses up a length, so the steps depend on the bins, not the pieces."""
    left = {n: c for n, c in hist.items() if c > 0}
    have, out = sorted(left), []
    while have:
        room, pattern = capacity, []
        used: dict[int, int] = {}
        at = len(have)
        while (at := min(at, bisect_right(have, room))) > 0:
            n = have[at - 1]
            k = min(room // n, left[n] - used.get(n, 0))
            if not k:
                at -= 1
                continue
            used[n] = used.get(n, 0) + k
            pattern += [n] * k
            room -= n * k
        times = min(left[n] // k for n, k in used.items())
        out.append((tuple(pattern), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        have = sorted(left)
    return out


def plan(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram exactly once. Of plans that place all, three quarters,
    a half, a quarter and none of the fitted repeats, the first that needs the fewest sequences."""
    left = {n: c for n, c in hist.items() if c > 0}
    whole = left.pop(capacity, 0)
    patterns = enumerate_patterns(left, capacity) if left else []
    order = sorted(zip(fit_repeats(patterns, left), patterns), key=lambda x: (-x[0], x[1]))
    plans = []
    for share in (1.0, 0.75, 0.5, 0.25, 0.0):
        rest, fitted = dict(left), [((capacity,), whole)] if whole else []
        for times, p in order:
            times = min([int(times * share), *(rest[n] // p.count(n) for n in set(p))])
            if times > 0:
                fitted.append((p, times))
                for n in p:
                    rest[n] -= times
        plans.append(fitted + best_fit(rest, capacity))
    return min(plans, key=lambda x: sum(t for _, t in x))


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: (first ranks, first sequences, offsets), one entry for each place in a pattern."""
    out: dict[int, list[list[int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in planned:
        offset = 0
        for n in pattern:
            out.setdefault(n, []).append([taken.get(n, 0), base, offset])
            taken[n] = taken.get(n, 0) + times
            offset += n
        base += times
    return {n: tuple(np.array(x, np.int64).T) for n, x in out.items()}


def pieces_of(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the encoded documents."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches):
        encode = Vocabulary(*shared.value).core.encode_to_numpy
        end = np.array([end_id], "<u4")
        for b in batches:
            rows: list[tuple[int, int, int, int]] = []
            which: list[int] = []
            for at, x in enumerate(texts_of(b)):
                ids = np.concatenate([encode(x, allowed_special="all").astype("<u4", copy=False), end])
                first = (ids.size - 1) % capacity + 1
                edges = [0, *range(first, ids.size + 1, capacity)]
                for piece, (s, e) in enumerate(zip(edges, edges[1:])):
                    rows.append((piece, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                which += [at] * (len(edges) - 1)
            table = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(table[0].astype(np.int32)), *map(pa.array, table[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _place(shared):
    def run(batches):
        at = shared.value
        for b in batches:
            n, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(n.size, np.int64), np.zeros(n.size, np.int64)
            order = np.argsort(n, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
                if group.size:
                    ranks, sequences, offsets = at[int(n[group[0]])]
                    i = np.searchsorted(ranks, rank[group], "right") - 1
                    sequence[group], offset[group] = sequences[i] + rank[group] - ranks[i], offsets[i]
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    A document is its ids and end_id. Documents of more than `capacity` ids are cut into pieces of
    `capacity`, of which the first may be shorter; others are one piece. Null and empty texts are
    the one id end_id. Rows that repeat a doc_id, or have none, are packed like any other; other
    columns are ignored. An empty table gives no rows. Pieces in one sequence lie without gaps from
    offset 0. Sequences are numbered from 0 on.
    """
    spark = docs.sparkSession
    made = cut(pieces_of(docs, vocabulary_path, capacity, end_id, text, doc_id)).withColumn("part", F.spark_partition_id())
    # Ranks within a length without gathering a length: counts by part, then ranks within a part.
    local = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = local.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    hist = {r.length: r.n for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(plan(hist, capacity)))
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    placed = ranked.join(base, ["part", "length"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
    return placed.mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pattern_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
