"""Service plans, hymns, slides, catalogues and client-side helpers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.streaming.drivers import fold
from passagekit.streaming.transitions import Walk


def highlight(text: Column, query: Column) -> Column:
    """array<struct<word, hit>>: the words of a text, and whether the query (words of two letters or more) has them."""
    wanted = F.filter(F.split(F.lower(query), r"[^a-z']+"), lambda w: F.length(w) >= 2)
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("word"), F.array_contains(wanted, F.regexp_replace(F.lower(w), r"[^a-z']", "")).alias("hit")))


def removal(key: Column, ref: Column, argument: str) -> Column:
    """Whether a detection is the one that an argument names: by key, exact reference, or reference without case and blanks."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return (key == argument) | (ref == argument) | (plain(ref) == plain(F.lit(argument)))


def catalogue(themes: DataFrame, name: str = "", pinned: bool | None = None, custom: bool | None = None) -> DataFrame:
    """Entries whose name contains a text, whatever the case, and whose flags are as asked."""
    out = themes.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    for column, value in (("pinned", pinned), ("custom", custom)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out


def set_edition(editions: DataFrame, wanted: int) -> int:
    """A session's edition, if there is such a one."""
    if editions.filter(F.col("id") == wanted).isEmpty():
        raise ValueError(f"no edition {wanted}")
    return wanted


def combine_editions(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Books of several files (book, chapter, verse, text), texts trimmed, in canonical order (book, ord)."""
    return rows.withColumn("text", F.trim("text")).join(F.broadcast(order), "book").orderBy("ord", "chapter", "verse")


def expand_template(templates: DataFrame) -> DataFrame:
    """(plan_id, ord, title, kind, status, duration): items array<struct<title, kind, duration>> with their defaults."""
    item = F.posexplode("items").alias("ord", "i")
    return templates.select("plan_id", item).select("plan_id", "ord", "i.title", F.coalesce("i.kind", F.lit("other")).alias("kind"), F.lit("pending").alias("status"), F.coalesce("i.duration", F.lit(0)).alias("duration"))


def key_terms(core: list[str], domain: DataFrame, most: int = 100) -> DataFrame:
    """Core terms, then domain terms (term, ord), distinct, the first `most`."""
    spark = domain.sparkSession
    both = spark.createDataFrame([(t, 0, i) for i, t in enumerate(core)], "term string, part int, ord long").unionByName(domain.select("term", F.lit(1).alias("part"), F.col("ord").cast("long")))
    first = both.groupBy("term").agg(F.min(F.struct("part", "ord")).alias("at"))
    return first.orderBy("at", "term").limit(most).select("term", F.row_number().over(Window.orderBy("at", "term")).alias("place"))


def section_kind(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.rlike("refrain|chorus"), "refrain").when(F.contains(low, F.lit("bridge")), "bridge").when(low.rlike("intro|opening"), "intro").when(low.rlike("ending|outro|coda"), "ending").otherwise("verse")


def slide_deck(slides: DataFrame, key: str, order: str) -> DataFrame:
    """Slides with a title or a body, numbered, with their count and a label where there is none."""
    w = Window.partitionBy(key)
    kept = slides.filter("trim(coalesce(title, '')) != '' or trim(coalesce(body, '')) != ''")
    index = F.row_number().over(w.orderBy(order))
    return kept.withColumn("slide_no", index).withColumn("n_slides", F.count("*").over(w)).withColumn("label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("Slide "), index.cast("string"))))


def group_labels(rows: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """ "i of n" within each group of a key."""
    w = Window.partitionBy(key, group)
    return rows.withColumn("part_label", F.concat(F.row_number().over(w.orderBy(order)).cast("string"), F.lit(" of "), F.count("*").over(w).cast("string")))


def repeat_refrains(sections: DataFrame, key: str, order: str) -> DataFrame:
    """Each verse followed by the refrain, where a hymn has one; verse order and place."""
    refrain = sections.filter("kind = 'refrain'").groupBy(key).agg(F.min_by("label", order).alias("refrain"))
    verses = sections.filter("kind != 'refrain'").join(refrain, key, "left")
    both = F.when(F.col("refrain").isNull(), F.array("label")).otherwise(F.array("label", "refrain"))
    shown = verses.select(key, order, F.posexplode(both).alias("part", "shown"))
    return shown.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order, "part")) - 1).select(key, "place", "shown")


def drop_refrains(sections: DataFrame, key: str) -> DataFrame:
    """Sections without refrains, unless nothing else remains of a hymn."""
    others = F.count_if(F.col("kind") != "refrain").over(Window.partitionBy(key))
    return sections.withColumn("_o", others).filter("kind != 'refrain' or _o = 0").drop("_o")


def bounded_history(rows: DataFrame, key: list[str], newest: str, most: int) -> DataFrame:
    """The latest `most` rows of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(newest))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def service_context(items: DataFrame, plan: str) -> DataFrame:
    """(plan, active_title, next_title, n_expected, hymns): items have ord, title, status, kind, hymn."""
    active = F.min_by("title", F.when(F.col("status") == "active", F.col("ord")))
    at = items.groupBy(plan).agg(F.min(F.when(F.col("status") == "active", F.col("ord"))).alias("at"))
    joined = items.join(at, plan)
    later = (F.col("ord") > F.col("at")) & ~F.col("status").isin("completed", "skipped")
    return joined.groupBy(plan).agg(active.alias("active_title"), F.min_by("title", F.when(later, F.col("ord"))).alias("next_title"), F.count_if(F.col("kind") == "scripture").alias("n_expected"), F.array_sort(F.collect_set("hymn")).alias("hymns"))


def plan_summaries(plans: DataFrame) -> DataFrame:
    """Counts of each plan's items, newest plan first."""
    done = F.size(F.filter("items", lambda i: i["status"] == "completed"))
    return plans.select("id", "title", "updatedAt", F.size("items").alias("n_items"), done.alias("n_completed")).orderBy(F.desc("updatedAt"), "id")


def edition_of(found: DataFrame, editions: DataFrame, abbreviation: str = "edition") -> DataFrame:
    """Rows with a found abbreviation and the edition (id, abbreviation, ..) that has it, whatever the case; others go."""
    known = editions.withColumn("_a", F.lower("abbreviation")).drop("abbreviation")
    return found.withColumn("_a", F.lower(abbreviation)).join(known, "_a").drop("_a")


def expected_books(refs: DataFrame, books: DataFrame) -> DataFrame:
    """Plan references whose book is a name or an abbreviation, whatever the case: two equality joins, not one OR."""
    low = refs.withColumn("_b", F.lower(F.trim("book")))
    keys = books.select(F.lower("name").alias("_b"), "book_number").union(books.select(F.lower("abbreviation").alias("_b"), "book_number")).distinct()
    return low.join(F.broadcast(keys), "_b").drop("_b")


def utterances(parts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, utterance_no, text, last): parts joined up to each one that ends speech."""
    w = Window.partitionBy(key).orderBy(order)
    ended = F.coalesce(F.sum(F.col("speech_final").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = parts.withColumn("utterance_no", ended).groupBy(key, "utterance_no")
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda p: p["text"]), " ").alias("text"), F.max(order).alias("last"))


def walk_positions(commands: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """(key, order, command, position) after each command: `next` and `previous` stay within 0..size-1, others change nothing."""
    types = dict(commands.dtypes)
    return fold(commands, functools.partial(Walk, size), key, [order], f"{key} {types[key]}, {order} {types[order]}, command string, position int")


def walk(commands: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """(key, position) after the last command of each key."""
    return walk_positions(commands, key, order, size).groupBy(key).agg(F.max_by("position", order).alias("position"))


def live_preview(detections: DataFrame, least: float = 0.90) -> DataFrame:
    """Detections sure and whole enough to be shown while someone still speaks: a book, a chapter and a verse, no chapter alone."""
    return detections.filter(~F.col("chapter_only") & (F.col("book_number") > 0) & (F.col("chapter") > 0) & (F.col("verse_start") > 0) & (F.col("confidence") >= least))


def queue_route(detections: DataFrame, least: float = 0.80) -> DataFrame:
    """Detections that go to the queue: flagged, or direct and sure enough, and not a chapter alone."""
    return detections.filter(F.col("auto_queued") | (F.col("is_direct") & (F.col("confidence") >= least) & ~F.col("chapter_only")))


def completion(typed: Column, name: Column, chapter: Column | None = None) -> Column:
    """What a typed reference completes to: the name it begins, or the name with the chapter and verse typed so far."""
    rest = F.regexp_extract(typed, r"\s(\d+(?::\d*)?)$", 1)
    return F.when(rest == "", name).otherwise(F.concat(name, F.lit(" "), rest))


def tab_advance(typed: Column, suggestion: Column) -> Column:
    """The input after Tab: a begun name is completed and followed by a blank, a chapter gets its colon, a verse stays."""
    return (
        F.when(typed.rlike(r"\d+:\d+$"), typed).when(typed.rlike(r"\d+:$"), typed).when(typed.rlike(r"\D\s\d+$"), F.concat(typed, F.lit(":")))
        .when(F.lower(suggestion).startswith(F.lower(F.trim(typed))), F.concat(suggestion, F.lit(" "))).otherwise(typed)
    )


def roman_name(typed: Column) -> Column:
    """A leading digit 1 to 3 as the roman numeral that some editions use."""
    digit = F.regexp_extract(typed, r"^([1-3])\s", 1)
    numeral = F.when(digit == "1", "I").when(digit == "2", "II").when(digit == "3", "III")
    return F.when(numeral.isNull(), typed).otherwise(F.concat(numeral, F.substr(typed, F.lit(2))))
