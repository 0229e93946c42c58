"""Exact vector retrieval and score fusion.

Queries are a DataFrame too. Scores are computed in blocks: vectors are dealt into blocks by hash, a
block keeps its best k for each query, and only those meet for the final cut, so neither the vectors
nor the pairs of one query are ever gathered. A handful of queries is broadcast behind a size check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.runtime import ship_code

#: Queries are broadcast up to this number; beyond it they are dealt out in blocks.
MOST_BROADCAST = 4096
#: Numbers in a packed block of vectors.
BLOCK_NUMBERS = 1 << 19


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _rows_of(ids: pa.Array, column: pa.Array):
    """(length, ids, matrix) of the vectors of each length; vectors with a null or non-finite number go."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy()
    starts, values = np.cumsum(sizes) - sizes, column.flatten().to_numpy(zero_copy_only=False)
    ids = ids.to_numpy()
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        block = values[starts[at][:, None] + np.arange(n)]
        whole = np.isfinite(block).all(axis=1)
        if whole.any():
            yield n, ids[at[whole]], block[whole]


def _best_of_block(query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int, digits: int):
    """Record batches (query_id, vec_id, similarity): of a block of rows, each query's best k by rounded product, then id, and any
    whose rounding is in doubt."""
    last = max(0, ids.size - k)
    for first in range(0, len(query_ids), 256):
        products = rows[first : first + 256] @ block.T
        least = np.partition(products, last, axis=1)[:, last]
        q, v = np.nonzero(products >= least[:, None] - 10.0**-digits)
        found, near = products[q, v], ids[v]
        rounded, part = np.round(found, digits), found * 10.0**digits % 1
        doubt = np.abs(part - 0.5) < 1e-3
        order = np.lexsort((near, -rounded, doubt, q))
        group = 2 * q[order] + doubt[order]
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if group.size else group
        rank = np.arange(group.size) - np.repeat(begins, np.diff(np.append(begins, group.size)))
        order = order[(rank < k) | doubt[order]]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[first : first + 256][q[order]]), pa.array(near[order]), pa.array(found[order])], ["query_id", "vec_id", "similarity"])


_SCORED = "query_id long, vec_id long, similarity double"


def _best_of_blocks(vectors: DataFrame, queries: list, k: int, digits: int) -> DataFrame:
    """(query_id, vec_id, similarity): for each query the best k vectors of every block of rows. A block's products are one matrix."""
    ship_code(vectors.sparkSession)
    by_size: dict[int, tuple[list[int], list]] = {}
    for q in queries:
        if q.vector and None not in q.vector:
            ids, rows = by_size.setdefault(len(q.vector), ([], []))
            ids.append(q.query_id)
            rows.append(q.vector)
    shared = vectors.sparkSession.sparkContext.broadcast({n: (np.array(ids, np.int64), np.array(rows, np.float64)) for n, (ids, rows) in by_size.items()})

    def run(batches):
        known = shared.value
        for b in batches:
            for n, ids, block in _rows_of(b.column(0), b.column(1)):
                if n in known:
                    yield from _best_of_block(*known[n], ids, block, k, digits)

    return vectors.mapInArrow(run, _SCORED).withColumn("similarity", F.round("similarity", digits))


def _packed_vectors(most: int):
    """(id, vector, g) -> (g, n, ids, numbers): vectors of one length and g, up to `most` a row, as bytes."""

    def run(batches):
        for b in batches:
            groups = b.column(2).to_numpy()
            for g in np.unique(groups).tolist():
                x = b.filter(pa.array(groups == g))
                for n, ids, block in _rows_of(x.column(0), x.column(1)):
                    step = max(1, min(most, BLOCK_NUMBERS // n))
                    cuts = range(0, ids.size, step)
                    made = [[g] * len(cuts), [n] * len(cuts), [ids[i : i + step].tobytes() for i in cuts], [block[i : i + step].tobytes() for i in cuts]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["g", "n", "ids", "numbers"])

    return run


def _best_of_pairs(k: int, digits: int):
    """(n, query ids, query numbers, ids, numbers), each packed -> (query_id, vec_id, similarity): the best k of every pair of blocks."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                n, query_ids, rows, ids, block = (b.column(c)[i].as_py() for c in range(5))
                query_ids, ids = (np.frombuffer(x, np.int64) for x in (query_ids, ids))
                rows, block = (np.frombuffer(x, np.float64).reshape(-1, n) for x in (rows, block))
                yield from _best_of_block(query_ids, rows, ids, block, k, digits)

    return run


def _best_of_dealt(vectors: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """As _best_of_blocks, for any number of queries: they are dealt into groups of about MOST_BROADCAST, vectors are packed
    into blocks, and every block meets every group as one matrix product."""
    spark = vectors.sparkSession
    ship_code(spark)
    groups = max(1, -(-queries.count() // MOST_BROADCAST))
    # Few groups are copied for several shares of the blocks, so that there is work for all cores.
    shares = max(1, -(-4 * spark.sparkContext.defaultParallelism // groups))
    schema = "g long, n long, ids binary, numbers binary"
    dealt = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"), F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("g")).repartition("g")
    asked = dealt.mapInArrow(_packed_vectors(MOST_BROADCAST), schema).toDF("g", "n", "query_ids", "rows").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    blocks = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.lit(0).cast("long")).mapInArrow(_packed_vectors(BLOCK_NUMBERS), schema).drop("g")
    blocks = blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = blocks.join(asked, ["g", "share", "n"]).select("n", "query_ids", "rows", "ids", "numbers")
    return pairs.mapInArrow(_best_of_pairs(k, digits), _SCORED).withColumn("similarity", F.round("similarity", digits))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, digits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, similarity): best k by inner product, ties to the smaller id, at least `least`. A few thousand
    queries go to every task, where a block of rows and the queries make one matrix product; more are dealt out in blocks.

    vectors (vec_id, embedding), queries (query_id, vector). Vectors of another length than the query's match
    nothing. WindowGroupLimit keeps k rows of each query in every task before the shuffle."""
    asked = queries.limit(MOST_BROADCAST + 1).collect()
    if len(asked) <= MOST_BROADCAST:
        scored = _best_of_blocks(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")), asked, k, digits)
    else:
        scored = _best_of_dealt(vectors, queries, k, digits)
    if least is not None:
        scored = scored.filter(F.col("similarity") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def ensemble(strategies: DataFrame, weights: dict[str, float], least: float = 0.42, k: int = 12) -> DataFrame:
    """strategies (query_id, strategy, vec_id, similarity) -> (query_id, rank, vec_id, score, best_similarity, n_sources).

    The score is the weighted sum over strategies; hits below `least` go."""
    weight = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
    summed = strategies.groupBy("query_id", "vec_id").agg(
        F.round(F.sum(F.col("similarity") * weight[F.col("strategy")]), 6).alias("score"), F.max("similarity").alias("best_similarity"), F.count_distinct("strategy").alias("n_sources")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = summed.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "best_similarity", "n_sources")


def overlap_boost(vector: DataFrame, text: DataFrame, keys: list[str], boost: float = 0.10) -> DataFrame:
    """Vector hits and text hits by key: what both found gets the vector confidence and a boost, up to 1."""
    v, t = vector.withColumnRenamed("confidence", "_v"), text.withColumnRenamed("confidence", "_t")
    both = F.col("_v").isNotNull() & F.col("_t").isNotNull()
    out = v.join(t, keys, "full_outer").withColumn("confidence", F.round(F.when(both, F.least(F.col("_v") + boost, F.lit(1.0))).otherwise(F.coalesce("_v", "_t")), 6))
    return out.withColumn("source", F.when(both, "both").when(F.col("_v").isNotNull(), "vector").otherwise("text")).drop("_v", "_t")


def to_passages(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Vector hits (query_id, vec_id, similarity) as passages (query_id, doc_id, paragraph, similarity): the first passage of
    the document whose number a vector has; vectors without one go."""
    first = passages.groupBy("doc_id").agg(F.min("paragraph").alias("paragraph"))
    return hits.join(first, hits["vec_id"] == first["doc_id"]).select("query_id", "doc_id", "paragraph", "similarity")


def in_edition(hits: DataFrame, passages: DataFrame, active: Column, place: list[str]) -> DataFrame:
    """hits (doc_id, paragraph, ..) with shown_doc_id: the document of the active edition (smallest id) that has the same place;
    hits whose place the edition lacks go."""
    known = passages.select("doc_id", "paragraph", *[c for c in place if c not in ("doc_id", "paragraph")])
    shown = passages.filter(active).groupBy(*place).agg(F.min("doc_id").alias("shown_doc_id"))
    return hits.join(known, ["doc_id", "paragraph"]).join(shown, place)


def score_bands(rows: DataFrame, group: list[str], score: str, order: str, epsilon: float) -> DataFrame:
    """rows with `band`, from 1 by descending score: a new one begins where a score lies at least epsilon below the one
    above it, so that scores closer than that count as equal."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), order)
    falls = F.lag(score).over(w)
    begins = F.when(falls.isNull() | (falls - F.col(score) >= epsilon), 1).otherwise(0)
    return rows.withColumn("_b", begins).withColumn("band", F.sum("_b").over(w)).drop("_b")


def merge_detections(found: DataFrame, session: list[str], key: list[str], least: float = 0.45, auto: float = 0.80) -> DataFrame:
    """Detections (session, key, confidence, is_direct, ord) -> one a key: direct before semantic, then higher confidence,
    then earlier. Below `least` they go; the first of a session by confidence, if at least `auto`, is flagged auto_queued."""
    w = Window.partitionBy(*session, *key).orderBy(F.desc("is_direct"), F.desc("confidence"), "ord")
    kept = found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").filter(F.col("confidence") >= least)
    order = Window.partitionBy(*session).orderBy(F.desc("confidence"), "ord")
    return kept.withColumn("place", F.row_number().over(order).cast("bigint")).withColumn("auto_queued", (F.col("place") == 1) & (F.col("confidence") >= auto))


def finalize_live(found: DataFrame, session: list[str], key: list[str], k: int = 3, boost: float = 0.10, most: float = 0.98) -> DataFrame:
    """One row a key: highest confidence, boosted (to at most `most`) if several agree; best k a session."""
    grouped = found.groupBy(*session, *key).agg(F.max("confidence").alias("_c"), F.count("*").alias("n_seen"))
    grouped = grouped.withColumn("confidence", F.round(F.when(F.col("n_seen") > 1, F.greatest(F.col("_c"), F.least(F.col("_c") + boost, F.lit(most)))).otherwise(F.col("_c")), 6)).drop("_c")
    w = Window.partitionBy(*session).orderBy(F.desc("confidence"), *key)
    return grouped.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= k)


def hashed_embedding(words: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hashed words, at length 1. An injected model
    takes its place through `embed_with`."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)) == i), F.lit(0.0), lambda s, w: s + F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)))
    return normalise(counts)


def embed_with(df: DataFrame, make_model, text: str = "text", out: str = "embedding") -> DataFrame:
    """Embed each distinct text once. make_model() is called once a task and returns a function from a list of
    texts to a list of float lists."""

    def run(batches):
        model = make_model()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(0).to_pylist()), pa.list_(pa.float32()))], ["_text", out])

    known = df.select(F.col(text).alias("_text")).filter("_text is not null").distinct().mapInArrow(run, f"_text string, {out} array<float>")
    return df.join(known, F.col(text) == F.col("_text"), "left").drop("_text")


def synonym_variants(texts: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """(id, variant_no, variant): the text, then up to `most` variants in which its first word with synonyms is replaced, in table order.

    texts (id, text); synonyms (term, synonym, ord)."""
    words = texts.select("id", "text", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    words = words.withColumn("term", F.lower(F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    known = synonyms.select("term").distinct()
    first = words.join(known, "term", "left_semi").groupBy("id").agg(F.min_by(F.struct("pos", "word", "term", "text"), "pos").alias("w"))
    w = Window.partitionBy("id").orderBy("ord", "synonym")
    made = first.join(synonyms, F.col("w.term") == F.col("term")).withColumn("variant_no", F.row_number().over(w).cast("bigint")).filter(F.col("variant_no") <= most)
    # Punctuation around the word stays.
    lead, tail = F.regexp_extract("w.word", r"^([^\p{L}\p{N}]*)", 1), F.regexp_extract("w.word", r"([^\p{L}\p{N}]*)$", 1)
    changed = F.array_join(F.transform(F.split("w.text", " "), lambda x, i: F.when(i == F.col("w.pos"), F.concat(lead, F.col("synonym"), tail)).otherwise(x)), " ")
    return texts.select("id", F.lit(0).cast("bigint").alias("variant_no"), F.col("text").alias("variant")).unionByName(made.select("id", "variant_no", changed.alias("variant")))


def synonym_map(groups: DataFrame) -> DataFrame:
    """(term, synonym, ord) of groups (group_no, ord, word): every word of a group stands for all others of it. A pair that several
    groups have counts once, at its first place; ord numbers a term's synonyms by group, then by place."""
    words = groups.select("group_no", "ord", F.lower("word").alias("word"))
    pairs = words.select("group_no", F.col("word").alias("term")).join(words, "group_no").filter("term != word")
    first = pairs.groupBy("term", F.col("word").alias("synonym")).agg(F.min(F.struct("group_no", "ord")).alias("at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("term").orderBy("at", "synonym")).cast("bigint")).select("term", "synonym", "ord")


def semantic_detections(hits: DataFrame, event: list[str], least: float = 0.42, k: int = 8) -> DataFrame:
    """(event, vec_id, similarity, chunk_no, place): of the hits of an event's chunks (event, chunk_no, vec_id, similarity), at
    least `least` each, the one of the first chunk that found a vector; best k an event."""
    kept = hits.filter(F.col("similarity") >= least).groupBy(*event, "vec_id").agg(F.min_by(F.struct("similarity", "chunk_no"), "chunk_no").alias("h"))
    w = Window.partitionBy(*event).orderBy(F.desc("similarity"), "vec_id")
    return kept.select(*event, "vec_id", "h.similarity", "h.chunk_no").withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= k)


def merge_shown(found: DataFrame, key: list[str], order: str, numbers: list[str], texts: list[str], any_of: list[str], all_of: list[str]) -> DataFrame:
    """One row a key of detections that are shown twice: the highest confidence, for each number the first that is not 0, for each
    text the first that is not empty, flags true for any (`any_of`) or for all (`all_of`)."""
    first = [F.min_by(c, F.when(F.col(c) != 0, F.col(order))).alias(c) for c in numbers] + [F.min_by(c, F.when(F.col(c) != "", F.col(order))).alias(c) for c in texts]
    return found.groupBy(*key).agg(F.max("confidence").alias("confidence"), *first, *[F.bool_or(c).alias(c) for c in any_of], *[F.bool_and(c).alias(c) for c in all_of])


#: Concept words, in list order.
CONCEPTS = (
    "love faith grace mercy sin salvation forgiveness righteousness holy spirit prayer worship heaven eternal life death "
    "resurrection cross blood covenant promise blessing curse judgment kingdom peace joy hope truth wisdom light darkness "
    "shepherd lamb sacrifice temple circumcision baptism communion apostle prophet priest repentance obedience commandment law gospel"
).split()


def concept_terms(text: Column, concepts: list[str] = CONCEPTS) -> Column:
    """Concepts among the words of a text (outer non-letters trimmed), in list order."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    return F.array_intersect(F.array(*map(F.lit, concepts)), words)
