"""Ordered folds, plans, hymns and queues as window and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_distinct(df: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_v", value).withColumn("_p", F.lag("_v").over(w)).filter(F.col("_p").isNull() | (F.col("_p") != F.col("_v"))).drop("_v", "_p")


def rolling_text(df: DataFrame, key: list[str], order: list[str], text: str, n: int = 8, out: str = "window_text") -> DataFrame:
    """The last n texts, oldest first, joined by blanks."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.array_join(F.collect_list(text).over(w), " "))


def sessions(df: DataFrame, key: list[str], ts: str, seconds: float) -> DataFrame:
    """session_no from 1: a new one after a gap longer than `seconds`."""
    w = Window.partitionBy(*key).orderBy(ts, "event_id")
    gap = (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))) > int(seconds * 1e6)
    return df.withColumn("_new", F.coalesce(gap, F.lit(True)).cast("bigint")).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def every_nth(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """Rows n, 2n, ... of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_r") % n == 0).drop("_r")


def islands(df: DataFrame, key: list[str], order: list[str], active: Column) -> DataFrame:
    """(key, island, first, last, n_rows): maximal runs of active rows; `order` ends in a unique column named pos."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("_a", active).withColumn("pos", F.row_number().over(w).cast("bigint"))
    marked = marked.withColumn("_s", F.when(F.col("_a") & ~F.coalesce(F.lag("_a").over(w), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_a").groupBy(*key, "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_rows"))


def plan_report(items: DataFrame, plan: str, status: Column, seconds: Column) -> DataFrame:
    """Items of each plan: done, skipped, all, and their seconds (null counts as 0)."""
    return items.groupBy(plan).agg(F.count_if(status == "completed").alias("n_completed"), F.count_if(status == "skipped").alias("n_skipped"), F.count("*").alias("n_items"), F.round(F.sum(F.coalesce(seconds, F.lit(0.0))), 2).alias("total_seconds"))


def next_item(items: DataFrame, plan: str, ord_: str, active: Column, eligible: Column) -> DataFrame:
    """(plan, next_ord): the first eligible item after the active one (after none: the first)."""
    at = items.groupBy(plan).agg(F.max(F.when(active, F.col(ord_))).alias("_at"))
    open_ = items.filter(eligible).join(at, plan).filter(F.col("_at").isNull() | (F.col(ord_) > F.col("_at")))
    return items.select(plan).distinct().join(open_.groupBy(plan).agg(F.min(ord_).alias("next_ord")), plan, "left")


def screens(lines: DataFrame, key: list[str], order: str, size: int) -> DataFrame:
    """Lines in screens of at most `size`: screen_no from 1 and n_screens for each key, lines_text joined by ' / '."""
    w = Window.partitionBy(*key).orderBy(order)
    dealt = lines.withColumn("_n", F.row_number().over(w) - 1).withColumn("screen_no", (F.floor(F.col("_n") / size) + 1).cast("bigint"))
    made = dealt.groupBy(*key, "screen_no").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), " / ").alias("lines_text"))
    return made.withColumn("n_screens", F.count("*").over(Window.partitionBy(*key)))


def select_sections(wanted: DataFrame, sections: DataFrame, key: str, section: str) -> DataFrame:
    """Sections in the order and number in which they are wanted (key, ids array); unknown ids go. out_ord counts from 0."""
    asked = wanted.select(key, F.posexplode("ids").alias("_p", section))
    found = asked.join(sections, [key, section])
    return found.withColumn("out_ord", (F.row_number().over(Window.partitionBy(key).orderBy("_p")) - 1).cast("bigint")).drop("_p")


def move_item(ord_: Column, source: int, target: int) -> Column:
    """The new ordinal of an item when the one at `source` moves to `target`."""
    if source < target:
        return F.when(ord_ == source, target).when((ord_ > source) & (ord_ <= target), ord_ - 1).otherwise(ord_)
    return F.when(ord_ == source, target).when((ord_ >= target) & (ord_ < source), ord_ + 1).otherwise(ord_)


def toggle(list_: Column, item: Column) -> Column:
    """The list without the item, or with it at its end."""
    return F.when(F.array_contains(list_, item), F.array_remove(list_, item)).otherwise(F.array_append(list_, item))


def clamp(position: Column, size: Column) -> Column:
    """A position within 0..size-1."""
    return F.greatest(F.lit(0), F.least(position, size - 1))


def level(samples: Column) -> tuple[Column, Column]:
    """(rms, peak) of 16-bit samples, from 0 to 1."""
    n = F.size(samples)
    squares = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    peak = F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("int")))), F.lit(0))
    return F.when(n > 0, F.least(F.sqrt(squares / n) / 32767, F.lit(1.0))).otherwise(0.0), F.least(peak / 32767, F.lit(1.0))


def resample(samples: Column, rate: int, target: int) -> Column:
    """Linear interpolation at i * rate / target."""
    ratio, n = rate / target, F.size(samples)
    steps = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / ratio).cast("int"), F.lit(0)))

    def at(i):
        p = i * F.lit(ratio)
        k = F.floor(p).cast("int")
        a, b = F.get(samples, k).cast("double"), F.coalesce(F.get(samples, k + 1), F.get(samples, k)).cast("double")
        return a + (b - a) * (p - k)

    return F.when(n > 0, F.transform(steps, at)).otherwise(F.array().cast("array<double>"))


def word_times(text: Column, start: Column, end: Column) -> Column:
    """Words of a segment with evenly spread start and end times and confidence 0.9."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    each = (end - start) / F.greatest(F.size(words), F.lit(1))
    return F.transform(words, lambda w, i: F.struct(w.alias("text"), (start + each * i).alias("start"), (start + each * (i + 1)).alias("end"), F.lit(0.9).alias("confidence")))


def levels(frames: DataFrame, keys: list[str], sample: str, full: int = 32767) -> DataFrame:
    """(keys, rms, peak) of samples, one a row, as shares of full scale: two sums and a maximum, so no key is gathered."""
    x = F.col(sample).cast("double") / full
    return frames.groupBy(*keys).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"))


def queue_positions(live: DataFrame, queue: DataFrame, session: str, ref: str = "ref", pos: str = "pos") -> DataFrame:
    """live rows with the first place of the queue (session, ref, pos) that has the same reference; null where none has."""
    first = queue.groupBy(session, ref).agg(F.min(pos).alias("queue_pos"))
    return live.join(first, [session, ref], "left")


def source_losses(frames: DataFrame, key: str, ts: str, silence: int = 2000) -> DataFrame:
    """(key, lost_at, recovered_at): each silence of more than `silence` (in the unit of ts) between the frames of a source is lost after that time
    and recovered with the next frame."""
    w = Window.partitionBy(key).orderBy(ts)
    gaps = frames.select(key, F.lag(ts).over(w).alias("_p"), F.col(ts).alias("recovered_at")).filter(F.col("recovered_at") - F.col("_p") > silence)
    return gaps.select(key, (F.col("_p") + silence).alias("lost_at"), "recovered_at")


def speech_segments(frames: DataFrame, key: str, ts: str, is_open: Column, frame: int, longest: int = 10_000, least: int = 1_000) -> DataFrame:
    """(key, segment_no, started, ended): runs of open frames, cut every `longest` (in the unit of ts); what is
    shorter than `least` goes. A frame lasts `frame`."""
    w = Window.partitionBy(key).orderBy(ts)
    marked = frames.select(key, ts, F.coalesce(is_open, F.lit(False)).alias("_o")).withColumn("_was", F.coalesce(F.lag("_o").over(w), F.lit(False)))
    runs = marked.withColumn("_run", F.sum(F.when(F.col("_o") & ~F.col("_was"), 1).otherwise(0)).over(w)).filter("_o")
    runs = runs.withColumn("_part", F.floor((F.col(ts) - F.min(ts).over(Window.partitionBy(key, "_run"))) / longest))
    cut_up = runs.groupBy(key, "_run", "_part").agg(F.min(ts).alias("started"), (F.max(ts) + frame).alias("ended")).filter(F.col("ended") - F.col("started") >= least)
    return cut_up.withColumn("segment_no", F.row_number().over(Window.partitionBy(key).orderBy("started")).cast("bigint")).select(key, "segment_no", "started", "ended")


def merge_equivalent(found: DataFrame, session: list[str], ref: str, order: str) -> DataFrame:
    """One row for each reference that is the same but for case and blanks: that of the highest confidence, then the latest."""
    plain = F.lower(F.regexp_replace(ref, r"\s+", ""))
    w = Window.partitionBy(*session, "_k").orderBy(F.desc("confidence"), F.desc(order))
    return found.withColumn("_k", plain).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_k", "_r")
