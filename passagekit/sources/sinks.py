"""Writers: corpora, indexes, exports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.operators import retrieval as R


def write_passages(passages: DataFrame, path: str) -> None:
    """Partitioned by edition and sorted by key within files, so lookups prune partitions and row groups."""
    passages.repartition("lang", F.pmod(F.xxhash64("doc_id"), F.lit(64))).sortWithinPartitions("doc_id", "paragraph").write.mode("overwrite").partitionBy("lang").parquet(path)


def write_index(passages: DataFrame, path: str) -> None:
    """Drop and rebuild: postings by term, passage lengths, document frequencies."""
    posts = R.postings(passages)
    posts.repartition("term").sortWithinPartitions("term", "doc_id", "paragraph", "pos").write.mode("overwrite").parquet(f"{path}/postings")
    R.lengths(passages).write.mode("overwrite").parquet(f"{path}/lengths")
    R.document_frequency(posts).write.mode("overwrite").parquet(f"{path}/terms")


def replace_books(new: DataFrame, path: str) -> None:
    """Replace by book: only the partitions of the books in `new` are overwritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_number").parquet(path)


def analyze(spark: SparkSession, table: str) -> None:
    spark.sql(f"analyze table {table} compute statistics for all columns")


def export_json(passages: DataFrame, lang: str, path: str) -> None:
    """{id, text, ref} of one edition, ordered by id."""
    rows = passages.filter(F.col("lang") == lang).select(F.col("doc_id").alias("id"), "text", F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.col("paragraph").cast("string")).alias("ref"))
    rows.orderBy("id", "ref").write.mode("overwrite").json(path)


def sql_dump(rows: DataFrame, name: str, text: str) -> DataFrame:
    """One INSERT statement a row; quotes doubled, white space collapsed."""
    quoted = [F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "), "'", "''"), F.lit("'")) if t == "string" else F.col(c).cast("string") for c, t in rows.dtypes]
    return rows.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(rows.columns)}) VALUES ("), F.concat_ws(", ", *[F.coalesce(q, F.lit("NULL")) for q in quoted]), F.lit(");")).alias(text))


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def emit(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None):
    """Append a stream to Parquet, exactly once; without a trigger, what is there now and no more."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
