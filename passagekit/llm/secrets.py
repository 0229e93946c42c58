"""Operator 7: secrets by a battery of randomness tests, in DataFrame functions alone.

Besides the strict base patterns, every long run of key characters is a candidate. Its encoding is
inferred from its characters (hexadecimal, base 32 or base 64), and three tests compare its symbols
with uniform noise over that alphabet: chi-squared frequencies, runs above and below the middle, and
correlation of neighbours. Fisher's method combines their p-values, and a candidate that the three together reject as
noise (one in a thousand of true noise) is dropped. For the rest, a model of readable text (changes between small letters, capitals, digits and separators, and letter pairs of English)
gives the ratio of its probability to that of noise. Readable text has a ratio under r with a chance of at
most r, so the ratio is the p-value, and the Benjamini-Hochberg rule, within each encoding and length band,
bounds the share of false finds as far as the model holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekit.runtime import cut, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs shorter than wanted cannot hold a wanted match, so the least lengths go into the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Encoding -> (pattern, alphabet, how readable text changes between the classes of CLASS_OF:
#: a row for each class before, a column for each class after).
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", ((0.85, 0.0, 0.15, 0.0), (0.0, 0.0, 0.0, 0.0), (0.05, 0.0, 0.95, 0.0), (0.5, 0.0, 0.5, 0.0))),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ((0.0, 0.0, 0.0, 0.0), (0.0, 0.95, 0.05, 0.0), (0.0, 0.15, 0.85, 0.0), (0.0, 0.8, 0.2, 0.0))),
    "base64": (r"^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", ((0.85, 0.04, 0.03, 0.08), (0.38, 0.54, 0.03, 0.05), (0.07, 0.05, 0.76, 0.12), (0.6, 0.2, 0.18, 0.02))),
}
CLASS_OF = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/")
#: -4 ln of the share of each letter, and of each letter after another (a row), in the English of this repository's
#: documents, a fifth of it made even: a is 1, b is 2 and so on.
LETTERS = "kolmippoksqmnklnrjjjnpqqps"
LETTER_PAIRS = (
    "somnsrnspsrjmhslsilgjqsrpskorshsssissgosisslosisssjsksqsissiosnorshsshqgnsssrskopndorshsrqrskssojrnrssrs"
    "lrjkpopsrssnljsoqghkrorlpslsssimssfssmssgssjpkjsssrskpsrfsmlkssnonoqshjomslspsgrqresssissrqmksslnlnsrsls"
    "olkmnqpsssslmghnsmkisnsqsqksssjssssssssqdsssfsomssssossocqrripsrsnsqrsiplssssshrskgsssgsskqsjsssnlnqrsms"
    "fjsqgsssjssqjmkjssmspsrssslskhjpisnsonsplrsrihmqsrqsornnrorrosnmkfmmshmnkolssshrsqhspmmsrjsskmsjoiksssns"
    "sssssssssssesssssqsscsrsssirhnhsqsisprprkrsqinmpssososmrgrsnlsqossmmogmgosqrqshspsfssjhssrrskrsljnosrsos"
    "ooonkqrslssmkiqlsfijssssspissscsqsgsssqsmsssrssssssslsssjssifssrsjhssmjsssqssslsmskqsplssssssfsrsdsssrss"
    "snrslqrsqssogjlhsqhhsspssoprrrerrrorrrrrprrrrrorrrff"
)
#: A published Chebyshev fit of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Candidates whose combined p-value as noise is less are no noise.
LEAST_NOISE = 0.001
BINS = 400
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,ok:boolean,body:string>>"


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, with code-point positions; ok: its group has `least` characters."""
    found, bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), bodies.alias("body"))

    def step(acc, row):
        start = acc["at"] + F.char_length(row["gap"])
        end = start + F.char_length(row["hit"])
        span = F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"), (F.char_length(row["body"]) >= least).alias("ok"), row["body"].alias("body"))
        return F.struct(F.coalesce(end, start).cast("bigint").alias("at"), F.when(row["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.filter(F.aggregate(rows, start, step, lambda acc: acc["out"]), lambda s: s["ok"])).otherwise(F.array().cast(_SPAN))


def _classes(body: Column) -> tuple[Column, Column]:
    """For each symbol, the number of its class as a digit; and itself as a small letter, or - if it is no letter."""
    every = "".join(CLASS_OF)
    kind = F.translate(body, every, "".join(str(i) * len(x) for i, x in enumerate(CLASS_OF)))
    return kind, F.translate(body, every, CLASS_OF[0] * 2 + "-" * 12)


def _battery(span: Column) -> Column:
    """A candidate span -> struct(start, rank, end, encoding, band, bin); bin is null for what is no noise."""
    body = F.translate(F.regexp_replace(span["body"], "=+$", ""), "-_", "+/")
    encoding = F.when(body.rlike("^[0-9]*$"), F.lit(None).cast("string"))
    for name, (pattern, _, _) in ENCODINGS.items():
        encoding = encoding.when(body.rlike(pattern), F.lit(name))
    return F.struct(span["start"].alias("start"), span["rank"].alias("rank"), span["end"].alias("end"), F.when(encoding == "hex", F.lower(body)).otherwise(body).alias("body"), encoding.alias("encoding"))


def _by_encoding(encoding: Column, values) -> Column:
    names = iter(ENCODINGS.items())
    first, entry = next(names)
    out = F.when(encoding == first, F.lit(values(entry)))
    for name, entry in names:
        out = out.when(encoding == name, F.lit(values(entry)))
    return out


def _let(x: Column, body) -> Column:
    """body(x), with x computed once."""
    return F.transform(F.array(x), body)[0]


def _two_tails(z: Column) -> Column:
    """Chance that a normal value lies at least as far from 0; to a relative error of 2e-7, and at least 1e-300."""

    def tail(x: Column) -> Column:
        def erfc(t: Column) -> Column:
            power = F.lit(0.0)
            for k in reversed(ERFC):
                power = power * t + k
            return t * F.exp(power - x * x)

        return F.greatest(F.least(_let(1 / (1 + x / 2), erfc), F.lit(1.0)), F.lit(1e-300))

    return _let(F.least(F.abs(z), F.lit(37.0)) / math.sqrt(2), tail)


def _upper_tail(z: Column) -> Column:
    return _let(_two_tails(z) / 2, lambda p: F.when(z >= 0, p).otherwise(1 - p))


def _noise(z: Column) -> Column:
    """Whether three z-values together may be noise: under it, -2 times the sum of the logarithms of their p-values is
    chi-squared with 6 degrees of freedom."""
    half = -(F.log(_upper_tail(z["chi"])) + F.log(_two_tails(z["runs"])) + F.log(_two_tails(z["serial"])))
    return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2) >= LEAST_NOISE)


def _tested(c: Column) -> Column:
    """The tests of one candidate with an encoding."""
    n = F.char_length(c["body"]).cast("double")
    size = _by_encoding(c["encoding"], lambda e: float(len(e[1])))
    alphabet = _by_encoding(c["encoding"], lambda e: e[1])
    values = F.transform(F.filter(F.split(c["body"], ""), lambda x: x != ""), lambda x: (F.instr(alphabet, x) - 1).cast("double"))
    squares = F.aggregate(F.array_distinct(values), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), 2))
    chi = squares * size / n - n
    free = size - 1
    # Even frequencies: exact mean and variance of the statistic under noise.
    chi_z = (chi - free) / F.sqrt(2 * free * (n - 1) / n)
    # Runs above and below the middle of the alphabet.
    high = F.transform(values, lambda v: F.when(v >= size / 2, 1.0).otherwise(0.0))
    ups = F.aggregate(high, F.lit(0.0), lambda a, v: a + v)
    lag = F.zip_with(F.slice(high, F.lit(2), F.greatest(F.size(high) - 1, F.lit(0))), F.slice(high, F.lit(1), F.greatest(F.size(high) - 1, F.lit(0))), lambda x, y: F.abs(x - y))
    runs = 1 + F.aggregate(lag, F.lit(0.0), lambda a, v: a + v)
    mean = 1 + 2 * ups * (n - ups) / n
    runs_z = F.coalesce((runs - mean) / F.sqrt(F.nullif((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0))), F.lit(99.0))
    # Correlation of neighbours.
    centre = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - centre) * (v - centre))
    pairs = F.zip_with(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), lambda x, y: (x - centre) * (y - centre))
    serial_z = F.coalesce((F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / F.nullif(spread, F.lit(0.0)) + 1 / n) * F.sqrt(n), F.lit(99.0))
    noise = _let(F.struct(chi_z.alias("chi"), runs_z.alias("runs"), serial_z.alias("serial")), _noise)
    # -ln of the probability of each symbol in readable text, given the one before it.
    kind, letter = _classes(c["body"])
    before_kind, before_letter = F.concat(F.lit("3"), kind), F.concat(F.lit("-"), letter)
    changes = _by_encoding(c["encoding"], lambda e: [-math.log(max(x, 1e-4)) for row in e[2] for x in row])
    letters = F.when(c["encoding"] == "hex", math.log(6)).otherwise(0.0)
    digits = F.when(c["encoding"] == "base32", math.log(6)).otherwise(math.log(10))

    def cost(i: Column) -> Column:
        here = lambda x: F.ascii(F.substr(x, i, F.lit(1)))
        now, was, at, old = here(kind) - 48, here(before_kind) - 48, here(letter) - 97, here(before_letter) - 97
        pair = F.when(old >= 0, F.ascii(F.substr(F.lit(LETTER_PAIRS), 26 * old + at + 1, F.lit(1)))).otherwise(F.ascii(F.substr(F.lit(LETTERS), at + 1, F.lit(1))))
        shown = F.when(now == 2, digits).when(now == 3, math.log(2)).when(letters > 0, letters).otherwise((pair - 96) / 4)
        return F.get(changes, 4 * was + now) + shown

    readable = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(c["body"])), cost), F.lit(0.0), lambda a, v: a + v)
    bin_ = F.least(F.floor(20 * F.greatest(readable - n * F.log(size), F.lit(0.0)) / math.log(10)), F.lit(BINS)).cast("int")
    return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["encoding"].alias("encoding"), F.floor(F.log2(n) * 2).cast("int").alias("band"), F.when(noise, bin_).alias("bin"))


def thresholds(tested: DataFrame, rate: float) -> dict[tuple[str, int], int]:
    """(encoding, band) -> least bin that the Benjamini-Hochberg rule accepts at `rate`.

    p-values are counted in BINS bins, so at most a few thousand counts exist, whatever the corpus."""
    counts = tested.groupBy("encoding", "band", F.coalesce("bin", F.lit(-1)).alias("bin")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("encoding", "band")
    ranked = counts.withColumn("all", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy(F.desc("bin"))))
    passed = ranked.filter((F.col("bin") >= 0) & (F.col("all") * F.pow(F.lit(10.0), -F.col("bin") / 20) <= rate * F.col("upto")))
    return {(r.encoding, r.band): r.bin for r in passed.groupBy("encoding", "band").agg(F.min("bin").alias("bin")).collect()}


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rate: float = 0.01, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of docs.

    Whole texts are searched; a null text counts as empty. Counts and base_sha256 are of the base spans;
    spans also has the candidates that pass the tests at false-discovery rate `rate` and overlap no base
    span, as kind `random`. Positions are code points, end exclusive. Runs of digits alone are no
    candidates. Null and repeated doc_ids come back as they are; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = rows.select("doc_id", _spans(F.col("t"), ASSIGN, 0, 1, 8).alias("assign"), _spans(F.col("t"), ACCESS, 1).alias("access"), _spans(F.col("t"), HEX, 2).alias("hex"), _spans(F.col("t"), CANDIDATE, 3).alias("runs"))
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    found = found.withColumn("base", F.array_sort(F.concat(*[F.transform(F.col(k), plain) for k in ("assign", "access", "hex")])))
    free = F.filter(F.col("runs"), lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.withColumn("free", F.filter(F.transform(free, _battery), lambda c: c["encoding"].isNotNull()))
    found = cut(found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", F.transform("free", _tested).alias("tested")))
    least = thresholds(found.select(F.explode("tested").alias("c")).select("c.*"), rate)
    accepted = lambda c: F.lit(False)
    if least:
        bins = F.create_map(*[F.lit(x) for (e, b), v in sorted(least.items()) for x in (f"{e}:{b}", v)])
        accepted = lambda c: F.coalesce(c["bin"] >= bins[F.concat_ws(":", c["encoding"], c["band"].cast("string"))], F.lit(False))
    every = F.array_sort(F.concat("base", F.transform(F.filter("tested", accepted), plain)))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS[:3]], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def op7_randomness_battery(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
