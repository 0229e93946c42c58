"""Full-text retrieval: postings, BM25, and the phrase / all-words / any-word cascade.

A query batch is a DataFrame, so one plan answers all queries. Postings are restricted to the terms of the
batch by an equi-join on the term before anything is counted; statistics (passages, average length,
document frequencies) span the whole index, whatever edition the results are limited to.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.functions.text import and_terms, or_terms, tokens
from passagekit.runtime import cut, ship_code

K1, B = 1.2, 0.75
#: Queries that a scan of all passages takes at once.
MOST_TYPED = 64
#: A negative or zero inverse document frequency counts as this.
LEAST_IDF = 1e-6
KEY = ["doc_id", "paragraph"]


def postings(passages: DataFrame) -> DataFrame:
    """(doc_id, paragraph, pos, term): one row for each word, positions from 0."""
    return passages.select(*KEY, F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


def lengths(passages: DataFrame) -> DataFrame:
    return passages.select(*KEY, F.size(tokens(F.col("text"))).cast("bigint").alias("n_terms"))


def statistics(lengths_: DataFrame) -> DataFrame:
    """One row: passages, average length."""
    return lengths_.agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("avg_len"))


def document_frequency(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count_distinct(*KEY).alias("df"), F.count("*").alias("cf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def bm25(weight: Column, f: Column, length: Column, average: Column) -> Column:
    return weight * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def anchors(queries: DataFrame, frequency: DataFrame) -> DataFrame:
    """(query_id, words, at, term): the rarest word of each query and its first place. A query with a word that the
    index lacks has none, as nothing can match all of it."""
    words = queries.filter(F.size("words") > 0).select("query_id", "words", F.posexplode("words").alias("at", "term"))
    known = words.join(frequency.select("term", "cf"), "term", "left")
    rarest = known.groupBy("query_id").agg(F.min_by(F.struct("words", "at", "term"), F.struct("cf", "at")).alias("a"), F.count_if(F.col("cf").isNull()).alias("lacks"))
    return rarest.filter("lacks = 0").select("query_id", "a.*")


def _candidates(queries: DataFrame, index: BatchIndex) -> DataFrame:
    """(query_id, words, at, term, KEY, n_terms, hits): the passages with the rarest word of each query."""
    rarest = anchors(queries, index.frequency)
    rarest = F.broadcast(rarest) if index.few else rarest
    return index.rows.select("*", F.explode(F.array_distinct("hits.term")).alias("term")).join(rarest, "term")


def phrase_hits(queries: DataFrame, index: BatchIndex) -> DataFrame:
    """(query_id, doc_id, paragraph, n_terms, f): how often the query's words stand in a row. queries: (query_id, words).

    Only passages with each query's rarest word are looked at; the words around it are compared within the passage."""
    n = F.size("words")

    def stands(start) -> Column:
        around = F.filter("hits", lambda h: (h["pos"] >= start) & (h["pos"] < start + n))
        return F.transform(around, lambda h: h["term"]) == F.col("words")

    starts = F.transform(F.filter("hits", lambda h: h["term"] == F.col("term")), lambda h: h["pos"] - F.col("at"))
    found = _candidates(queries, index).withColumn("f", F.size(F.filter(starts, stands)).cast("bigint"))
    return found.filter("f > 0").select("query_id", *KEY, "n_terms", "f")


def term_hits(queries: DataFrame, index: BatchIndex, every: bool) -> DataFrame:
    """(query_id, doc_id, paragraph, n_terms, term, f) for passages with every word of a query, or any."""
    count = lambda term: F.size(F.filter("hits", lambda h: h["term"] == term)).cast("bigint")
    if every:
        found = _candidates(queries, index).drop("term").withColumn("words", F.array_distinct("words"))
        full = found.filter(F.size(F.array_except("words", F.col("hits.term"))) == 0)
        return full.select("query_id", *KEY, "n_terms", "hits", F.explode("words").alias("term")).select("query_id", *KEY, "n_terms", "term", count(F.col("term")).alias("f"))
    words = queries.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    # Terms are counted in each passage once, not once a query.
    return words.join(index.counts, "term").select("query_id", *KEY, "n_terms", "term", "f")


def scored_phrases(hits: DataFrame, sizes: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, doc_id, paragraph, score): the phrase counts as one term. Lengths come from `sizes` where the hits have none."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("df"))
    rows = hits if "n_terms" in hits.columns else hits.join(sizes, KEY)
    rows = rows.join(n, "query_id").crossJoin(F.broadcast(stats))
    return rows.select("query_id", *KEY, F.round(bm25(idf(F.col("n_docs"), F.col("df")), F.col("f"), F.col("n_terms"), F.col("avg_len")), 6).alias("score"))


def scored_terms(hits: DataFrame, frequency: DataFrame, sizes: DataFrame, stats: DataFrame) -> DataFrame:
    rows = hits if "n_terms" in hits.columns else hits.join(sizes, KEY)
    rows = rows.join(frequency.select("term", "df"), "term").crossJoin(F.broadcast(stats))
    part = bm25(idf(F.col("n_docs"), F.col("df")), F.col("f"), F.col("n_terms"), F.col("avg_len"))
    return rows.groupBy("query_id", *KEY).agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best passages of each query: score descending, then key. row_number <= k is limited map-side."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def batch_words(queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three forms of a batch (query_id, query): phrase, all-words and any-word terms."""
    flat = lambda c: F.flatten(F.transform(c, tokens))  # noqa: E731  an apostrophe parts a word in two, as in the index
    return (
        queries.select("query_id", tokens(F.col("query")).alias("words")),
        queries.select("query_id", flat(and_terms(F.col("query"))).alias("words")).filter(F.size("words") > 0),
        queries.select("query_id", flat(or_terms(F.col("query"))).alias("words")).filter(F.size("words") > 0),
    )


#: Terms of a batch are looked up in a set that goes with the plan up to this number; beyond it they are joined.
MOST_TERMS = 20_000


@dataclass
class BatchIndex:
    """What a batch of queries needs of an index: rows (KEY, n_terms, hits: the places of the batch's terms), counts
    (term, KEY, n_terms, f), sizes (KEY, n_terms), statistics of all passages and document frequencies of the terms; and whether the batch is small."""

    rows: DataFrame
    counts: DataFrame
    sizes: DataFrame
    stats: DataFrame
    frequency: DataFrame
    few: bool


def batch_index(passages: DataFrame, forms: tuple[DataFrame, ...]) -> BatchIndex:
    """Passages are read and cut into words once: all but the batch's terms go at once, and nothing is shuffled but counts."""
    terms = forms[0].select(F.explode("words").alias("term"))
    for f in forms[1:]:
        terms = terms.union(f.select(F.explode("words").alias("term")))
    wanted = [r.term for r in terms.distinct().limit(MOST_TERMS + 1).collect()]
    few = len(wanted) <= MOST_TERMS
    placed = lambda t, i: F.struct(i.alias("pos"), t.alias("term"))
    read = passages.select(*KEY, tokens(F.col("text")).alias("toks")).select(*KEY, F.size("toks").cast("bigint").alias("n_terms"), F.transform("toks", placed).alias("hits"))
    if few:
        rows = cut(read.withColumn("hits", F.filter("hits", lambda h: h["term"].isin(wanted))))
    else:
        found = read.select(*KEY, F.explode("hits").alias("h")).join(terms.distinct(), F.col("h.term") == F.col("term"), "left_semi")
        found = found.groupBy(*KEY).agg(F.array_sort(F.collect_list("h")).alias("hits"))
        rows = cut(read.select(*KEY, "n_terms").join(found, KEY, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<pos:int,term:string>>"))))
    stats, sizes = statistics(rows.select("n_terms")), rows.select(*KEY, "n_terms")
    rows = rows.filter(F.size("hits") > 0)
    distinct = F.transform(F.array_distinct("hits.term"), lambda t: F.struct(t.alias("term"), F.size(F.filter("hits", lambda h: h["term"] == t)).cast("bigint").alias("f")))
    counts = rows.select(*KEY, "n_terms", F.explode(distinct).alias("c")).select("c.term", *KEY, "n_terms", "c.f")
    return BatchIndex(rows, counts, sizes, stats, cut(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("f").alias("cf"))), few)


def tiered_search(passages: DataFrame, queries: DataFrame, k: int = 10, fetch: int = 4, only: Column | None = None) -> DataFrame:
    """(query_id, rank, tier, doc_id, paragraph, score): phrase hits before all-words hits before any-word hits.

    Each tier fetches fetch * k rows by BM25; a later tier counts only for queries whose earlier tiers found
    fewer than k distinct passages, and a passage keeps its first tier. `only` limits results (such as to an
    edition) but not the statistics. Any-word hits are looked up only for queries that need them."""
    phrase, all_, any_ = forms = batch_words(queries)
    index = batch_index(passages, forms)
    sizes, stats, frequency = index.sizes, index.stats, index.frequency
    shown = (lambda hits: hits) if only is None else lambda hits: hits.join(passages.filter(only).select(*KEY), KEY, "left_semi")
    found = cut(top(scored_phrases(shown(phrase_hits(phrase, index)), sizes, stats), fetch * k).withColumn("tier", F.lit(1)))
    second = top(scored_terms(shown(term_hits(_lacking(all_, found, k), index, True)), frequency, sizes, stats), fetch * k).withColumn("tier", F.lit(2))
    found = cut(found.unionByName(second))
    third = top(scored_terms(shown(term_hits(_lacking(any_, found, k), index, False)), frequency, sizes, stats), fetch * k).withColumn("tier", F.lit(3))
    found = found.unionByName(third)
    once = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", *KEY).orderBy("tier"))).filter("_r = 1")
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), *KEY)
    return once.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("tier").cast("bigint").alias("tier"), *KEY, "score")


def _lacking(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Queries with fewer than k distinct passages so far."""
    full = found.select("query_id", *KEY).distinct().groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    return queries.join(full.select("query_id"), "query_id", "left_anti")


def rank_confidence(rank: Column, first: float = 0.75, decay: float = 0.04, least: float = 0.42) -> Column:
    """Confidence by rank from 0; null below the least."""
    c = F.round(F.lit(first) - F.lit(decay) * rank, 6)
    return F.when(c >= least, c)


def catalogue_score(query: str, number: Column, title: Column, line: Column) -> Column:
    """Additive score of a catalogue entry."""
    q, t = query.strip().lower(), F.lower(title)
    digits = number.cast("string")
    return (
        F.when(digits == q, 100).otherwise(0) + F.when(digits.startswith(q), 40).otherwise(0) + F.when(t == q, 80).otherwise(0)
        + F.when(t.startswith(q), 50).otherwise(0) + F.when(F.contains(t, F.lit(q)), 30).otherwise(0) + F.when(F.contains(F.lower(line), F.lit(q)), 20).otherwise(0)
    ).cast("bigint")


def keep_best(found: DataFrame, keys: list[str], score: str, order: str, k: int) -> DataFrame:
    """Union of result lists: the best score of every key (earlier list first on ties), best k."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(F.desc(score), *keys).limit(k)


def window_errors(pattern: str, text: str) -> int:
    """The fewest edits between a pattern and any stretch of a text (bit-parallel)."""
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top, errors = (1 << len(pattern)) - 1, 1 << len(pattern) - 1, len(pattern)
    up, down, best = full, 0, errors
    for c in text:
        eq = where.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(xh | up) & full, up & xh
        errors += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(xv | plus) & full, plus & xv
        best = min(best, errors)
    return best


def field_score(query: str, text: str, threshold: float = 0.35, piece: int = 32) -> float | None:
    """0.001 (found) to 1: the mean share of errors of the query's pieces where they fit best, those beyond the threshold
    adding nothing; 0 for equal texts, None if no piece fits."""
    if query == text:
        return 0.0
    starts = [*range(0, len(query) - piece + 1, piece)] or [0]
    if len(query) > piece and len(query) % piece:
        starts.append(len(query) - piece)
    pieces = [query[a : a + piece] for a in starts]
    shares = [e / len(x) for x in pieces if (e := window_errors(x, text)) / len(x) <= threshold]
    return sum(max(0.001, x) for x in shares) / len(pieces) if shares else None


def context_similarity(query: str, fields: list[tuple[str, float]], threshold: float = 0.35) -> float:
    """1 less the product of the fields' scores, each to the power of its weight over the root of its number of words."""
    total, found = 1.0, False
    for text, weight in fields:
        score = field_score(query, text.lower(), threshold)
        if score is not None:
            found = True
            total *= max(score, 2.0**-52) ** (weight * round(1 / max(1, len(text.split())) ** 0.5, 3))
    return round(1 - min(1.0, total), 4) if found else 0.0


def context_search(passages: DataFrame, queries: DataFrame, book: str = "source", k: int = 15, least: float = 0.55) -> DataFrame:
    """(query_id, rank, doc_id, paragraph, similarity): passages that contain something like a query (query_id, query of two
    characters or more), by text (0.92) and book name (0.08), at least `least`. Every passage is read for every query of the
    batch, so it is meant for the few queries that someone types; more than MOST_TYPED raise an error."""
    ship_code(passages.sparkSession)
    asked = [(r.query_id, " ".join((r.query or "").lower().split())) for r in queries.limit(MOST_TYPED + 1).collect()]
    if len(asked) > MOST_TYPED:
        raise ValueError(f"more than {MOST_TYPED} queries")
    asked = [(i, q) for i, q in asked if len(q) >= 2]

    def run(batches):
        for b in batches:
            found = []
            for doc_id, paragraph, text, name in zip(*(c.to_pylist() for c in b.columns)):
                for query_id, q in asked:
                    similarity = context_similarity(q, [(text or "", 0.92), (name or "", 0.08)])
                    if similarity >= least:
                        found.append((query_id, doc_id, paragraph, similarity))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["query_id", *KEY, "similarity"])

    scored = passages.select(*KEY, "text", F.col(book)).mapInArrow(run, "query_id long, doc_id long, paragraph long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *KEY)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", *KEY, "similarity")


def fuzzy_similarity(query: Column, text: Column) -> Column:
    """1 - edit distance / longer length, both in lower case (an approximation of client-side fuzzy search)."""
    a, b = F.lower(query), F.lower(text)
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1)), 4)
