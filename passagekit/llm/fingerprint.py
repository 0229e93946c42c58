"""Operator 4: homomorphic multiset fingerprints, in DataFrame functions alone.

A text is the multiset of its paragraphs (lines, and sentences within lines). Each paragraph is
hashed to a wide vector, and a text's fingerprint is the sum of the vectors of its paragraphs, each
field modulo a power of two. The order of paragraphs does not matter, and adding or taking away a
paragraph is adding or subtracting its vector.

A vector is 70 longs: a count, 5 longs of uniform bits in four packed fields (three of 15 bits, the top one
of 14; 295 bits that tell multisets apart, each long from a hash with a seed of its own) and 64 longs of two fields (31 and 30 bits), each of which counts
a single bit of every paragraph, so none wraps below 2^30 paragraphs. The sums of the latter are 128 sign
projections of the multiset, so that two fingerprints also estimate how
much two texts share: 2<a, b> / (<a, a> + <b, b>), 1 for equal multisets and 0 on average for disjoint
ones, with a standard error of about 0.12 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.runtime import cut, table

#: Fields of a long; the bits above them catch carries and borrows, and no sum overflows a long.
FIELDS = 0x3FFF7FFF7FFF7FFF
GUARDS = 0x4000800080008000
#: The same for the count and the sign sums.
WIDE_FIELDS = 0x3FFFFFFF7FFFFFFF
WIDE_GUARDS = 0x4000000080000000
WIDE_LOW_BITS = 0x0000000100000001
UNIFORM, SIGNS = 5, 64
#: Separates lines, and sentences after . ! or ?
PARAGRAPH_END = r"\n|(?<=[.!?])\s+"
BUCKET_BITS = 10


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def paragraphs(text: Column) -> Column:
    """array<string>: trimmed pieces that are not blank."""
    return F.filter(F.transform(F.split(text, PARAGRAPH_END, -1), lambda p: F.trim(p)), lambda p: p != "")


def _hashes(units: Column) -> Column:
    """array<array<long>>: for each uniform long and each of the two sign words, a hash of every paragraph with its own seed."""

    def seeded(j: int) -> Column:
        return F.transform(units, lambda u: F.xxhash64(F.lit(j), u))

    return F.array(*map(seeded, range(UNIFORM + SIGNS // 32)))


def _vector(hashes: Column) -> Column:
    def total(values: Column, part, fields: int) -> Column:
        return F.aggregate(values, _long(0), lambda a, h: (a + part(h)).bitwiseAND(_long(fields)))

    uniform = [total(hashes[j], lambda h: h.bitwiseAND(_long(FIELDS)), FIELDS) for j in range(UNIFORM)]
    signs = [total(hashes[UNIFORM + k // 32], lambda h, k=k: F.shiftrightunsigned(h, k % 32).bitwiseAND(_long(WIDE_LOW_BITS)), WIDE_FIELDS) for k in range(SIGNS)]
    return F.array(F.size(hashes[0]).cast("long").bitwiseAND(_long(WIDE_FIELDS)), *uniform, *signs)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df and a column `out` array<long>: the fingerprint of column `text`; of no paragraphs for null and blank texts."""
    hashed = df.withColumn("_hashes", _hashes(paragraphs(F.coalesce(F.col(text), F.lit("")))))
    return hashed.withColumn(out, _vector(F.col("_hashes"))).drop("_hashes")


def _each(narrow: int, wide: int) -> Column:
    """One value for each long of a fingerprint."""
    return F.array(_long(wide), *[_long(narrow)] * UNIFORM, *[_long(wide)] * SIGNS)


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), _each(FIELDS, WIDE_FIELDS), lambda x, m: x.bitwiseAND(m))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of a's multiset without b's."""
    guarded = F.zip_with(a, _each(GUARDS, WIDE_GUARDS), lambda x, g: x.bitwiseOR(g))
    return F.zip_with(F.zip_with(guarded, b, lambda x, y: x - y), _each(FIELDS, WIDE_FIELDS), lambda x, m: x.bitwiseAND(m))


def text_form(fp: Column) -> Column:
    """A fingerprint as hexadecimal digits."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _projections(fp: Column) -> Column:
    """array<double>: 2 * ones - count of every sign field."""
    fields = F.flatten(F.transform(F.slice(fp, 2 + UNIFORM, SIGNS), lambda x: F.array(x.bitwiseAND(_long(0x7FFFFFFF)), F.shiftrightunsigned(x, 32))))
    return F.transform(fields, lambda c: (2 * c - fp[0]).cast("double"))


def likeness(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    """Estimated share of two fingerprints a, b with projections pa, pb, between 0 and 1; exactly 1 if they are equal."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda u, v: u + v)

    share = 2.0 * dot(pa, pb) / F.greatest(dot(pa, pa) + dot(pb, pb), F.lit(1.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def following(keys: DataFrame, span: int) -> DataFrame:
    """keys (k long, distinct, within a range of span) -> (k, below): the next smaller key, null for
    the smallest. Keys are dealt by their upper bits, so a window holds at most 2^BUCKET_BITS keys (or a range of 4,096)."""
    if span <= 4096:
        return keys.withColumn("below", F.lead("k").over(Window.orderBy(F.desc("k"))))
    dealt = keys.withColumn("g", F.shiftright("k", BUCKET_BITS))
    tops = dealt.groupBy("g").agg(F.max("k").alias("top"))
    order = following(tops.select(F.col("g").alias("k")), (span >> BUCKET_BITS) + 2)
    lower = order.select(F.col("k").alias("g"), F.col("below").alias("h")).join(tops.select(F.col("g").alias("h"), "top"), "h").select("g", "top")
    inside = dealt.withColumn("own", F.lead("k").over(Window.partitionBy("g").orderBy(F.desc("k"))))
    return inside.join(lower, "g", "left").select("k", F.coalesce("own", "top").alias("below"))


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row
    for each row of docs.

    A null text counts as empty. The edited text has its last floor(n_chars / 3) code points replaced by
    as many first ones of the next document, by descending doc_id; after the last comes the first. Rows
    that repeat a doc_id follow each other by text. A row without a doc_id has no next document: an
    empty text stands for it. Two texts without paragraphs have likeness 1. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    marked = with_fingerprint(rows, "t", "fp")
    ids = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("doc_id").alias("n")).first()
    # Buckets of about 2^BUCKET_BITS rows each, however far the ids lie apart.
    spread = 0 if ids.a is None else (ids.z - ids.a + 1) // ids.n
    shift = min(62, BUCKET_BITS + max(0, spread.bit_length() - 1))
    some = rows.filter("doc_id is not null").withColumn("b", F.shiftright("doc_id", shift))
    # The first row of every bucket follows the last row of the bucket above it.
    first = some.groupBy("b").agg(F.min_by("t", F.struct(F.bitwise_not("doc_id").alias("i"), F.col("t").alias("t"))).alias("ht"))
    heads = cut(with_fingerprint(first, "ht", "hfp"))
    highest = None if ids.a is None else ids.z >> shift
    lower = following(heads.select(F.col("b").alias("k")), 0 if ids.a is None else highest - (ids.a >> shift) + 1)
    # After the smallest bucket comes the largest.
    nexts = lower.select(F.col("k").alias("b"), F.coalesce("below", F.lit(highest)).alias("below")).join(heads.withColumnRenamed("b", "below"), "below").select("b", "ht", "hfp")
    order = Window.partitionBy("b").orderBy(F.desc("doc_id"), "t")
    inside = marked.filter("doc_id is not null").withColumn("b", F.shiftright("doc_id", shift))
    inside = inside.select("b", "doc_id", "t", "fp", F.lead("t").over(order).alias("nt"), F.lead("fp").over(order).alias("nfp"))
    linked = inside.join(nexts, "b").select("doc_id", "t", "fp", F.coalesce("nt", "ht").alias("nt"), F.coalesce("nfp", "hfp").alias("nfp"))
    lost = with_fingerprint(marked.filter("doc_id is null").select("doc_id", "t", "fp", F.lit("").alias("nt")), "nt", "nfp")
    both = linked.unionByName(lost)

    n = F.char_length("t")
    third = F.floor(n / 3).cast("int")
    edited = both.select("doc_id", n.cast("long").alias("n_chars"), "fp", "nfp", F.concat(F.substring("t", F.lit(1), n - third), F.substring("nt", F.lit(1), third)).alias("e"))
    done = with_fingerprint(edited, "e", "efp").withColumn("sha", F.sha2(F.col("e").cast("binary"), 256)).drop("e")
    done = done.select("*", *[_projections(F.col(c)).alias(f"p_{c}") for c in ("fp", "efp", "nfp")])
    return done.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), text_form(F.col("fp")).alias("fingerprint"), text_form(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp"), F.col("p_fp"), F.col("p_efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp"), F.col("p_fp"), F.col("p_nfp")).alias("near_next"),
    )


def op4_multiset_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
