"""Passages of a corpus: layout, lookups, joins and shaping.

A passage table has one row for each line of a document: doc_id (its chapter), paragraph (from 1),
text, lang (its edition) and source (its book). Stored partitioned by edition and sorted by
(doc_id, paragraph), row-group statistics take the place of the usual lookup indexes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def passages(docs: DataFrame) -> DataFrame:
    """Lines that are not blank, numbered by their place in the document."""
    split = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return split.filter("trim(text) != ''").select("doc_id", (F.col("pos") + 1).cast("bigint").alias("paragraph"), "text", "lang", "source")


def by_key(p: DataFrame, doc_id: int, paragraph: int) -> DataFrame:
    return p.filter((F.col("doc_id") == doc_id) & (F.col("paragraph") == paragraph))


def chapter(p: DataFrame, doc_id: int) -> DataFrame:
    return p.filter(F.col("doc_id") == doc_id).orderBy("paragraph")


def between(p: DataFrame, doc_id: int, first: int, last: int) -> DataFrame:
    """An inclusive range of paragraphs."""
    return p.filter((F.col("doc_id") == doc_id) & F.col("paragraph").between(first, last)).orderBy("paragraph")


def edition(p: DataFrame, lang: str) -> DataFrame:
    return p.filter(F.col("lang") == lang).orderBy("source", "doc_id", "paragraph")


def chapter_counts(p: DataFrame) -> DataFrame:
    return p.groupBy("source", "doc_id").agg(F.count("*").alias("n_passages"))


def prefix_search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows in which some column starts with the query, whatever the case. % and _ keep their LIKE meaning."""
    match = F.lit(False)
    for c in columns:
        match = match | F.col(c).ilike(query + "%")
    return df.filter(match)


def reference_text(book: Column, chapter_: Column, first: Column, last: Column | None = None) -> Column:
    """book:chapter:first, and -last where the range has more than one verse."""
    text = F.concat_ws(":", book.cast("string"), chapter_.cast("string"), first.cast("string"))
    return text if last is None else F.when(last > first, F.concat(text, F.lit("-"), last.cast("string"))).otherwise(text)


def resolve(detections: DataFrame, verses: DataFrame, by_id: str, keys: list[str], text: str) -> DataFrame:
    """Text of each detection: by id, else by key, else empty. verses has `by_id`, `keys` (unique each) and `text`."""
    first = verses.select(F.col(by_id), F.col(text).alias("_by_id"))
    second = verses.select(*keys, F.col(text).alias("_by_key"))
    joined = detections.join(first, by_id, "left").join(second, keys, "left")
    return joined.withColumn(text, F.coalesce("_by_id", "_by_key", F.lit(""))).drop("_by_id", "_by_key")


def release_gate(rows: DataFrame, allowed: DataFrame, key: str, forbidden: Column) -> DataFrame:
    """One row: rows, rows whose key is not allowed, and forbidden rows; ok if both are 0."""
    marked = rows.join(allowed.select(key).distinct().withColumn("_ok", F.lit(1)), key, "left")
    out = marked.agg(F.count("*").alias("n_rows"), F.count_if(F.col("_ok").isNull()).alias("n_unknown"), F.count_if(forbidden).alias("n_forbidden"))
    return out.withColumn("ok", (F.col("n_unknown") == 0) & (F.col("n_forbidden") == 0))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "ord") -> DataFrame:
    """Rows renumbered from 0 within their key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Overwrite by key: the rows of `old` whose key `new` has give way to those of `new`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def with_ids(df: DataFrame, order: list[Column], part: str, name: str = "id") -> DataFrame:
    """Surrogate ids 1..n in a given order within partitions of `part`, continued over its values; no
    window sees more than one value of `part`, and the counts of its values are one small table."""
    counts = df.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return ranked.join(F.broadcast(base), part).withColumn(name, F.col("_base") + F.col("_r")).drop("_base", "_r")
