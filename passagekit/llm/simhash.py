"""Operator 1: SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.llm.blocks import bitmap, blocks_for, key_masks, min_keys, tiled, wanted
from passagekit.llm.graph import connected_components
from passagekit.llm.rows import packed
from passagekit.runtime import cut, ship_code, table

SEED = 42
CHUNK = 1 << 16
#: Classes of documents are gathered in parts of so many shingles' bytes, times their tile.
UNIT_BYTES = 1 << 15


def shingle_hashes(words: list[bytes], size: int):
    """XXH64 of each run of `size` words, joined by spaces; of the whole sequence if it is shorter."""
    if len(words) < size:
        return iter([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [])
    runs = zip(*(islice(words, i, None) for i in range(size)))
    return map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED))


def simhash64(text: bytes | None, size: int = 4) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text. Words are what ASCII white space separates, A-Z in
    lower case; null, empty and blank texts give 0."""
    words = (text or b"").lower().split()
    hashes, total, counts = shingle_hashes(words, size), 0, np.zeros(64, np.int64)
    while (h := np.fromiter(islice(hashes, CHUNK), np.uint64)).size:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += h.size
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id long, fp long): one row for each row of docs."""
    ship_code(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([simhash64(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits (as unsigned: of signed numbers numpy counts the bits of the absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _stars(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Star edges that connect whatever the links among a group's fingerprints connect."""
    a, c = [], []
    left = np.ones(fps.size, bool)
    while left.any():
        seed = int(np.argmax(left))
        left[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            idx = np.flatnonzero(left)
            near = idx[_distance(fps[idx], fps[at]) <= distance]
            left[near] = False
            front.extend(near.tolist())
            a.extend(repeat(int(fps[seed]), near.size))
            c.extend(fps[near].tolist())
    return a, c


def _edges(a, c, group=0, over=0):
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(np.full(n, group, np.int64)), pa.array(np.full(n, over, np.int32))], ["a", "b", "grp", "over"])


def _runs(masks: np.ndarray, distance: int, tile: int):
    """Rows (c, fp) sorted by (c, masked fp): star edges of every run of equal keys. A run of more than
    `tile` rows is passed on row by row (over = 1), so a task never holds more than that and a batch."""

    def settle(choice, fp):
        """Edges of whole runs, none of more than `tile` rows."""
        key = fp & masks[choice]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])]))
        size = np.diff(np.append(first, fp.size))
        a, c = [], []
        pair = first[size == 2]
        near = pair[_distance(fp[pair], fp[pair + 1]) <= distance]
        a += fp[near].tolist()
        c += fp[near + 1].tolist()
        for n in np.unique(size[size > 2]).tolist():
            starts = first[size == n]
            if n <= 32:  # most runs meet by chance; those without any close pair go together
                rows = fp[starts[:, None] + np.arange(n)]
                some = np.zeros(len(rows), bool)
                for i in range(n - 1):
                    some |= (_distance(rows[:, i + 1 :], rows[:, i, None]) <= distance).any(axis=1)
                starts = starts[some]
            for s in starts.tolist():
                x, y = _stars(fp[s : s + n], distance)
                a += x
                c += y
        return _edges(a, c)

    def run(batches):
        none = (np.zeros(0, np.int32), np.zeros(0, np.int64))
        held, long_key = none, None
        for b in batches:
            choice, fp = (np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held))
            key = fp & masks[choice]
            if long_key is not None:  # rows of a long run that began before
                n = int(np.argmin(np.append((choice == long_key[0]) & (key == long_key[1]), False)))
                yield _edges(fp[:n], fp[:n], long_key[2], 1)
                choice, fp, key = choice[n:], fp[n:], key[n:]
                if not fp.size:
                    held = none
                    continue
                long_key = None
            last = int(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])]))[-1])
            first = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])])), fp.size)
            big = np.flatnonzero(np.diff(first) > tile)
            short = np.ones(fp.size, bool)
            for i in big.tolist():
                s, e = int(first[i]), int(first[i + 1])
                group = xxhash.xxh64_intdigest(np.array([choice[s], key[s]], np.int64).tobytes()) >> 1
                yield _edges(fp[s:e], fp[s:e], group, 1)
                short[s:e] = False
                if e == fp.size:
                    long_key = (choice[s], key[s], group)
            if long_key is None:
                short[last:] = False
                held = (choice[last:], fp[last:])
            else:
                held = none
            if short.any():
                yield settle(choice[short], fp[short])
        if held[1].size:
            yield settle(*held)

    return run


def _gathered(distance: int):
    def run(batches):
        for b in batches:
            for fps in b.column(0).to_pylist():
                a, c = _stars(np.unique(np.array(fps, np.int64)), distance)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def near_links(fps: DataFrame, distance: int, blocks: int, tile: int = 4096) -> DataFrame:
    """fps (fp long, distinct) -> edges (a, b) whose components are those of all pairs at Hamming
    distance 1..distance.

    One shuffle deals each fingerprint out by its block keys, as (number of the key, fingerprint): the
    key itself need not travel. Sorted runs of equal keys are compared as they stream by, and leave
    star edges. Runs of more than `tile` fingerprints are compared in tile pairs instead."""
    ship_code(fps.sparkSession)
    masks = key_masks(distance, blocks)
    key = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("c") + 1).bitwiseAND(F.col("fp"))
    rows = fps.select(F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("c"), "fp")
    dealt = rows.repartition(F.xxhash64("c", key)).sortWithinPartitions("c", key).select("c", "fp")
    found = cut(dealt.mapInArrow(_runs(np.array(masks, np.int64), distance, tile), "a long, b long, grp long, over int"))
    over = found.filter("over = 1").select(F.col("grp").alias("key"), F.col("a").alias("fp"))
    counts = over.groupBy("key").agg(F.count("*").alias("cnt"))
    links = found.filter("over = 0").select("a", "b")
    if counts.isEmpty():
        return links
    members = tiled(over.join(counts, "key"), "key", tile, "fp")
    groups = members.groupBy("key", "ti", "tj").agg(F.collect_list("fp").alias("fps")).select("fps")
    return links.union(groups.mapInArrow(_gathered(distance), "a long, b long"))


def simhash_components(docs: DataFrame, size: int = 4, distance: int = 4, blocks: int | None = None, tile: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Near-duplicate classes: (doc_id, fp long, component_id), one row for each row of docs.

    Documents link when their SimHash fingerprints differ in at most `distance` bits; component_id
    is the smallest doc_id reachable. Blank and null texts have fingerprint 0 and link like any
    other. A row whose doc_id is null gets the component of its fingerprint, and is never its
    smallest id; repeated rows each come back. Other columns are ignored, so may have any name.
    `blocks` (default: from the number of distinct fingerprints) changes cost only, never results.
    """
    ship_code(docs.sparkSession)
    marked = cut(fingerprints(docs, size, text, doc_id))
    reps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = near_links(reps.select("fp"), distance, blocks or blocks_for(reps.count(), distance), tile)
    roots = connected_components(links)
    classes = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    return marked.join(classes.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _simhash(h: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for a in range(0, h.size, CHUNK):
        counts += np.unpackbits(h[a : a + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > h.size, bitorder="little").tobytes(), "little")


def _marks(size: int, keys: int, minima: int):
    """(doc_id, h, fp, units, keys) of each document: h tells word sequences apart; fp is the SimHash of its shingles, units
    their size in UNIT_BYTES, and keys are their MinHash keys, none of a blank text."""

    def made(ids, h, fps, sets):
        some = np.flatnonzero([x.size for x in sets])
        n = np.zeros(len(sets) + 1, np.int32)
        n[some + 1] = keys
        sizes = np.array([sets[i].size for i in some], np.int64)
        flat = min_keys(np.concatenate([sets[i] for i in some]), np.cumsum(sizes) - sizes, keys, minima).T.ravel() if some.size else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(n).astype(np.int32)), pa.array(flat.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array([1 + x.nbytes // UNIT_BYTES for x in sets], pa.int32()), lists], ["doc_id", "h", "fp", "units", "keys"])

    def run(batches):
        for b in batches:
            ids, hs, fps, sets, held = [], [], [], [], 0
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = (t or b"").lower().split()
                ids.append(doc_id)
                hs.append(xxhash.xxh64_intdigest(b" ".join(words), 3))
                sets.append(np.fromiter(shingle_hashes(words, size), np.uint64))
                fps.append(_simhash(sets[-1]))
                held += sets[-1].size
                if held > CHUNK:
                    yield made(ids, hs, fps, sets)
                    ids, hs, fps, sets, held = [], [], [], [], 0
            if ids:
                yield made(ids, hs, fps, sets)

    return run


def _key_stars(batches):
    """Rows (key, h) sorted by key -> an edge from the first h of each key to every other."""
    key, seed = None, None
    for b in batches:
        keys, h = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not keys.size:
            continue
        new = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
        at = np.cumsum(new) - 1
        firsts = h[new]
        heads = np.where(at < 0, 0 if seed is None else seed, firsts[at] if firsts.size else 0)
        key, seed = keys[-1], heads[-1]
        other = h != heads
        yield pa.RecordBatch.from_arrays([pa.array(heads[other], pa.int64()), pa.array(h[other], pa.int64())], ["a", "b"])


def _shingle_sets(shared, size: int):
    """Sorted distinct shingle hashes of the documents whose h may be wanted, each at most once a batch."""

    def run(batches):
        bits = shared.value
        for b in batches:
            found = {}
            for t in b.column(0).to_pylist():
                words = (t or b"").lower().split()
                h = xxhash.xxh64_intdigest(b" ".join(words), 3)
                if h not in found and wanted(bits, np.array([h], np.uint64))[0]:
                    found[h] = np.unique(np.fromiter(shingle_hashes(words, size), np.uint64)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.binary())], ["h", "shingles"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; 1 for two empty ones."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both) if a.size + b.size else 1.0


def _alike(least: float):
    """Edges between the documents of a class that share enough shingles, none within what is connected already."""

    def run(batches):
        for b in batches:
            a, c = [], []
            for rows in b.column(0).to_pylist():
                sets, top = [np.frombuffer(r["shingles"], np.uint64) for r in rows], list(range(len(rows)))
                sizes = np.array([x.size for x in sets])

                def root(i, top=top):
                    while top[i] != i:
                        top[i] = i = top[top[i]]
                    return i

                for i in range(1, len(rows)):
                    ratio = np.minimum(sizes[:i], sizes[i]) >= least * np.maximum(sizes[:i], sizes[i]) - 1e-9
                    for j in np.flatnonzero(ratio).tolist():
                        x, y = root(i), root(j)
                        if x != y and jaccard(sets[i], sets[j]) >= least - 1e-12:
                            top[max(x, y)] = min(x, y)
                            a.append(rows[i]["h"])
                            c.append(rows[j]["h"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def near_dedup(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 4, blocks: int | None = None, keys: int = 20, minima: int = 4, tile: int = 256) -> DataFrame:
    """The rows of docs that stay: one for each near-duplicate class, that of the smallest doc_id (of
    rows that repeat an id, the first by text). Rows with a null doc_id all stay, as nothing tells them apart;
    an empty table stays empty.

    Documents link when they have the same words, or when the Jaccard similarity of their shingles of `size` words is
    at least `similarity`. Candidates are all pairs whose SimHash fingerprints differ in at most `distance` bits, found by
    pigeonhole blocks, and, as a similarity of 0.8 moves about ten bits, also pairs that share one of `keys` MinHash
    keys of `minima` smallest hashes: a pair of similarity s is missed with a chance of at most (1 - s^minima)^keys, 3 in
    100,000 at 0.8. Blank and null texts are one class."""
    spark = docs.sparkSession
    ship_code(spark)
    narrow = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    marked = narrow.mapInArrow(_marks(size, keys, minima), "doc_id long, h long, fp long, units int, keys array<long>")
    unique = cut(marked.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("units").alias("units"), F.first("keys").alias("keys")))
    dealt = unique.select(F.explode("keys").alias("key"), "h").repartition(F.xxhash64("key")).sortWithinPartitions("key", "h")
    # Documents of one fingerprint hang on the first of them, and the first ones of close fingerprints on each other.
    heads = cut(unique.groupBy("fp").agg(F.min("h").alias("head"), F.count("*").alias("n")))
    equal = unique.select("h", "fp").join(heads.filter("n > 1"), "fp").select(F.col("head").alias("a"), F.col("h").alias("b"))
    near = near_links(heads.select("fp"), distance, blocks or blocks_for(heads.count(), distance))
    ends = heads.select("fp", "head")
    near = near.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    candidates = dealt.mapInArrow(_key_stars, "a long, b long").union(equal).union(near)
    classes = connected_components(candidates).toDF("h", "class")
    placed = unique.select("h", "units").join(classes, "h")
    several = placed.groupBy("class").agg(F.sum("units").alias("cnt"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut(placed.join(several, "class").select("h", "class", "cnt"))
    sets = narrow.select("t").mapInArrow(_shingle_sets(bitmap(members.select("h")), size), "h long, shingles binary").dropDuplicates(["h"])
    dealt = tiled(members.join(sets, "h"), "class", tile, "h")
    gathered = dealt.groupBy("class", "ti", "tj").agg(F.collect_list(F.struct("h", "shingles")).alias("rows"))
    groups = connected_components(gathered.select("rows").mapInArrow(_alike(similarity), "a long, b long"))
    rooted = unique.select("h", "rep").join(groups.withColumnRenamed("node", "h"), "h", "left").withColumn("g", F.coalesce("root", "h"))
    kept = rooted.groupBy("g").agg(F.min("rep").alias("kept")).select("kept")
    rows = packed(docs).withColumn("key", F.col("row.doc_id").cast("long"))
    first = rows.join(kept, rows["key"] == kept["kept"]).groupBy("key").agg(F.min_by("row", F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("row")).select("row")
    return first.unionByName(rows.filter("key is null").select("row")).select("row.*")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), size=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
