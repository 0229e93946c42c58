"""Readers of structured corpora, pages, transcripts and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.functions.text import html_text, pdf_text
from passagekit.runtime import ship_code

EDITION = "books array<struct<name:string,abbreviation:string,chapters:array<struct<chapter:int,verses:array<struct<verse:int,text:string>>>>>>"
PARAGRAPHS = "title string, abbreviation string, book_number int, chapters array<struct<chapter:int,title:string,paragraphs:array<string>>>"
WORDS = "array<struct<word:string,start:double,end:double,confidence:double,punctuated_word:string>>"
LIVE = f"type string, is_final boolean, speech_final boolean, channel struct<alternatives:array<struct<transcript:string,confidence:double,words:{WORDS}>>>"
BATCH = f"results struct<channels:array<struct<alternatives:array<struct<transcript:string,confidence:double,words:{WORDS}>>>>>"
PLAN = "id string, title string, status string, updatedAt bigint, items array<struct<id:string,title:string,status:string,`order`:int,durationSeconds:double>>"


def edition_json(spark: SparkSession, path: str, edition: str) -> DataFrame:
    """books[].chapters[].verses[] -> verse rows; books are numbered by place, the first 39 are OT, and a missing
    abbreviation is the first four letters of the name."""
    books = spark.read.schema(EDITION).option("multiLine", True).json(path).select(F.posexplode("books").alias("p", "b"))
    verses = books.select("p", "b.name", "b.abbreviation", F.explode("b.chapters").alias("c")).select("p", "name", "abbreviation", "c.chapter", F.explode("c.verses").alias("v"))
    number = (F.col("p") + 1).alias("book_number")
    return verses.select(F.lit(edition).alias("edition"), number, F.col("name").alias("book_name"), F.coalesce("abbreviation", F.substring("name", 1, 4)).alias("book_abbreviation"), F.when(F.col("p") < 39, "OT").otherwise("NT").alias("testament"), "chapter", "v.verse", "v.text")


def public_editions(manifest: DataFrame) -> DataFrame:
    return manifest.filter("includeInPublicRelease")


def cross_references(spark: SparkSession, path: str, codes: DataFrame, ranges: bool = True) -> DataFrame:
    """Tab-separated `Book.c.v <tab> Book.c.v[-Book.c.v] <tab> votes`; header, comments, blanks and unknown books go; votes default to 0.

    codes (code, book_number). With ranges=False the end repeats the start."""
    lines = spark.read.text(path).filter("trim(value) != '' and value not like '#%' and value not like 'From%'")
    f = F.split("value", "\t")
    target = F.split(F.get(f, F.lit(1)), "-")

    def part(ref: Column, i: int) -> Column:
        return F.get(F.split(ref, r"\."), F.lit(i))

    first, last = F.get(target, F.lit(0)), F.coalesce(F.get(target, F.lit(1)), F.get(target, F.lit(0)))
    rows = lines.select(
        part(F.get(f, F.lit(0)), 0).alias("fb"), *[part(F.get(f, F.lit(0)), i).try_cast("int").alias(n) for i, n in ((1, "from_chapter"), (2, "from_verse"))],
        part(first, 0).alias("tb"), part(first, 1).try_cast("int").alias("to_chapter"), part(first, 2).try_cast("int").alias("to_verse_start"),
        part(last if ranges else first, 2).try_cast("int").alias("to_verse_end"), F.coalesce(F.get(f, F.lit(2)).try_cast("int"), F.lit(0)).alias("votes"),
    )
    a, b = (F.broadcast(codes.select(F.col("code").alias(c), F.col("book_number").alias(n))) for c, n in (("fb", "from_book"), ("tb", "to_book")))
    return rows.join(a, "fb").join(b, "tb").select("from_book", "from_chapter", "from_verse", "to_book", "to_chapter", "to_verse_start", "to_verse_end", "votes")


def paragraph_json(spark: SparkSession, path: str) -> DataFrame:
    """One book a file: chapters[].paragraphs[] -> rows numbered from 1 within a chapter."""
    book = spark.read.schema(PARAGRAPHS).option("multiLine", True).json(path)
    chapters = book.select("book_number", F.col("title").alias("book_title"), F.explode("chapters").alias("c"))
    return chapters.select("book_number", "book_title", "c.chapter", F.col("c.title").alias("chapter_title"), F.posexplode("c.paragraphs").alias("p", "text")).select("book_number", "book_title", "chapter", "chapter_title", (F.col("p") + 1).alias("paragraph"), "text")


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, link_no, href, label) of plain links, in order."""
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("label"))
    return pages.select(key, F.posexplode(both).alias("n", "l")).select(key, F.col("n").cast("bigint").alias("link_no"), "l.href", "l.label")


def chapter_links(links: DataFrame, key: str, chapters: int) -> DataFrame:
    """The first link of each chapter 1..chapters, by a number in its label; raises unless all are there."""
    numbered = links.withColumn("chapter", F.regexp_extract("label", r"(\d+)", 1).try_cast("int")).filter(F.col("chapter").between(1, chapters))
    w = Window.partitionBy(key, "chapter").orderBy("link_no")
    first = numbered.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    short = first.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") < chapters).count()
    if short:
        raise ValueError(f"{short} pages lack chapters")
    return first


def html_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, paragraph, text): cleaned <p> and <blockquote> blocks that are not blank; where there are none, pieces of the rendered text between blank lines."""
    body = F.regexp_replace(html, r"(?is)<(script|style|table|nav)\b.*?</(script|style|table|nav)>", "")
    clean = lambda blocks: F.filter(F.transform(blocks, html_text), lambda p: p != "")
    blocks = clean(F.regexp_extract_all(body, F.lit(r"(?is)<(?:p|blockquote)\b[^>]*>(.*?)</(?:p|blockquote)>"), F.lit(1)))
    rendered = clean(F.split(F.regexp_replace(F.regexp_replace(body, r"(?i)<(br|/p|/div|/h\d)\b[^>]*>", "\n\n"), r"(?s)<[^>]*>", ""), r"\n\s*\n"))
    some = F.when(F.size(blocks) > 0, blocks).otherwise(rendered)
    return pages.select(key, F.posexplode(some).alias("p", "text")).select(key, (F.col("p") + 1).cast("bigint").alias("paragraph"), "text")


def chapters_by_anchor(texts: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, chapter, text): a text cut at the last occurrence of each anchor (chapter, anchor); each chapter runs to the next one's anchor.

    Raises if anchors are not in rising order."""
    t = texts.select(key, pdf_text(F.col("text")).alias("t"))
    at = F.char_length("t") - F.instr(F.reverse("t"), F.reverse("anchor")) - F.char_length("anchor") + 2
    found = t.crossJoin(F.broadcast(anchors)).filter(F.contains("t", F.col("anchor"))).withColumn("at", at)
    w = Window.partitionBy(key).orderBy("chapter")
    found = found.withColumn("to", F.coalesce(F.lead("at").over(w), F.char_length("t") + 1))
    if found.filter(F.col("to") < F.col("at")).count():
        raise ValueError("anchors are out of order")
    return found.select(key, "chapter", F.regexp_replace(F.substr("t", F.col("at"), F.col("to") - F.col("at")), r"^\s+|\s+$", "").alias("text"))


def verse_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, text string, ref string").option("multiLine", True).json(path)


def vector_files(spark: SparkSession, matrix: str, ids: str, dim: int) -> DataFrame:
    """(vec_id, embedding) from a little-endian float32 matrix file and an int64 id file; raises if their sizes do not fit.

    One file is one record, so it must fit a task; Parquet is the format for more."""
    ship_code(spark)
    both = spark.read.format("binaryFile").load(matrix).select(F.col("content").alias("m")).crossJoin(spark.read.format("binaryFile").load(ids).select(F.col("content").alias("i")))

    def run(batches):
        for b in batches:
            for m, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, k = np.frombuffer(m, "<f4"), np.frombuffer(i, "<i8")
                if x.size != k.size * dim:
                    raise ValueError(f"{x.size} numbers are not {k.size} vectors of {dim}")
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(x.reshape(-1, dim)), pa.list_(pa.float32()))], ["vec_id", "embedding"])

    return both.mapInArrow(run, "vec_id long, embedding array<float>")


def live_transcripts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Provider events (JSON in `value`) -> kind partial | final, transcript, confidence, speech_final, words; other types and bad lines go.

    The first alternative counts; words without a required field go. Works on batch and streaming frames."""
    rows = lines.withColumn("_e", F.from_json(value, LIVE)).filter("_e.type = 'Results'")
    first = F.get("_e.channel.alternatives", F.lit(0))
    words = F.filter(first["words"], lambda w: w["word"].isNotNull() & w["start"].isNotNull() & w["end"].isNotNull() & w["confidence"].isNotNull())
    out = rows.withColumn("kind", F.when(F.coalesce("_e.is_final", F.lit(False)), "final").otherwise("partial")).withColumn("transcript", first["transcript"]).withColumn("confidence", first["confidence"])
    return out.withColumn("speech_final", F.coalesce("_e.speech_final", F.lit(False))).withColumn("words", F.coalesce(words, F.array().cast(WORDS))).filter("transcript != ''").drop("_e", value)


def worker_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Line-delimited worker events: ready, partial, final, error; other lines go."""
    e = lines.withColumn("_e", F.from_json(value, f"type string, text string, message string, words {WORDS}")).filter("_e.type in ('ready', 'partial', 'final', 'error')")
    positive = F.filter("_e.words", lambda w: w["confidence"] > 0)
    mean = F.aggregate(positive, F.lit(0.0), lambda s, w: s + w["confidence"]) / F.size(positive)
    return e.withColumn("kind", F.col("_e.type")).withColumn("transcript", F.coalesce("_e.text", "_e.message")).withColumn("confidence", F.when(F.size(positive) > 0, mean).otherwise(0.75)).drop("_e", value)


def batch_transcripts(lines: DataFrame, value: str = "value") -> DataFrame:
    """Request/response transcripts: the first alternative of every channel that is not empty, always final."""
    channels = lines.withColumn("_e", F.from_json(value, BATCH)).withColumn("_c", F.explode("_e.results.channels"))
    first = F.get("_c.alternatives", F.lit(0))
    return channels.withColumn("transcript", first["transcript"]).withColumn("confidence", first["confidence"]).withColumn("speech_final", F.lit(True)).filter("transcript != ''").drop("_e", "_c", value)


def remote_commands(lines: DataFrame, value: str = "value") -> DataFrame:
    """{"command", "value"} -> command, value as text; rows without a command go."""
    e = F.from_json(value, "command string, value string")
    return lines.withColumn("_e", e).filter("_e.command is not null").select("*", "_e.command", F.col("_e.value").alias("argument")).drop("_e", value)


def accuracy_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with an actual transcript."""
    cases = spark.read.schema("name string, expected string, scripture_terms array<string>, actual string").option("multiLine", True).json(folder)
    return cases.filter("actual is not null")


def valid_plans(plans: DataFrame) -> DataFrame:
    """Plans with an id, a title and items that all have an id, a title and an order that is not negative."""
    good = lambda i: (F.coalesce(i["id"], F.lit("")) != "") & (F.coalesce(i["title"], F.lit("")) != "") & (F.coalesce(i["order"], F.lit(-1)) >= 0)
    return plans.filter((F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & F.forall(F.coalesce("items", F.array().cast(PLAN.split("items ")[1])), good))


def plan_store(spark: SparkSession, path: str, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Valid plans, and the summaries that still have one."""
    plans = valid_plans(spark.read.schema(PLAN).option("multiLine", True).json(path))
    return plans, None if summaries is None else summaries.join(plans.select("id"), "id", "left_semi")


def hymn_bucket(number: Column, size: int = 100) -> Column:
    """The partition of a hymn, so that a lookup by number reads one."""
    return F.floor((number - 1) / size).cast("int")
