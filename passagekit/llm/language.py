"""Operator 9: language identification in two steps: the family first, then one-versus-one linear
support vector machines between the languages of that family."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.llm.boosting import calibrate
from passagekit.llm.rows import map_texts, packed
from passagekit.runtime import ship_code, table

UNKNOWN = "und"

#: Families of language codes; a language that is not here joins the family that it most resembles.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "hellenic": "el",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr gu pa ne ur",
    "semitic": "ar he mt am",
    "cjk": "zh ja ko",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIM = 1 << 13
_LETTERS = None


def _letter_table() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def letter_grams(text: str | None) -> np.ndarray | None:
    """Hashed counts (square roots, scaled to length 1) of letter n-grams of 1 to 3 with word edges; None without a letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    if not c.size:
        return None
    letter = _letter_table()[c]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[0], np.where(letter, c, 0)[keep], [0, 0]]).astype(np.uint32)
    mix, shift = np.uint32(0x9E3779B1), np.uint32(32 - 13)
    one, two = c * np.uint32(0x85EBCA6B), c[:-1] * np.uint32(0xC2B2AE35) + c[1:] * np.uint32(0x27D4EB2F)
    three = two[:-1] * np.uint32(0x165667B1) + c[2:] * np.uint32(0x9E3779B1)
    grams = np.concatenate([one[c > 0] ^ np.uint32(1), two ^ np.uint32(2), three ^ np.uint32(3)])
    x = np.sqrt(np.bincount((grams * mix) >> shift, minlength=DIM)).astype(np.float32)
    return x / np.sqrt((x * x).sum())


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, a, b) of a linear support vector machine (squared hinge, dual coordinate
    descent, fixed order); 1 / (1 + exp(-(a * margin + b))) is the calibrated chance of y = 1."""
    sign = np.where(y, 1.0, -1.0)
    alpha, w, bias = np.zeros(len(y)), np.zeros(x.shape[1]), 0.0
    diag, norms = 0.5 / cost, (x * x).sum(1) + 1.0
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = sign[i] * (x[i] @ w + bias) - 1 + diag * alpha[i]
            new = max(alpha[i] - g / (norms[i] + diag), 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w += step * x[i]
                bias += step
                alpha[i] = new
    return w.astype(np.float32), float(bias), *calibrate(x @ w + bias, y.astype(float))


def _chance(machine, x: np.ndarray) -> float:
    w, bias, a, b = machine
    return float(1 / (1 + np.exp(-np.clip(a * (x @ w + bias) + b, -30, 30))))


class Hierarchy:
    """Families of languages, a machine for each family against the rest, and one for each pair of languages within a family."""

    def fit(self, x: np.ndarray, langs: np.ndarray) -> Hierarchy:
        self.langs = sorted(set(langs.tolist()))
        centre = {g: x[langs == g].mean(0) for g in self.langs}
        family = {g: _FAMILY[g] for g in self.langs if g in _FAMILY}
        for g in self.langs:
            if g not in family:
                family[g] = max(sorted(f for f in family if f in _FAMILY), key=lambda k: float(centre[g] @ centre[k] / np.linalg.norm(centre[k])), default=None)
                family[g] = family.get(family[g], "other")
        self.members: dict[str, list[str]] = {}
        for g in self.langs:
            self.members.setdefault(family[g], []).append(g)
        of = np.array([family[g] for g in langs.tolist()], object)
        names = sorted(self.members)
        self.family = {f: linear_svm(x, of == f) for f in (names if len(names) > 2 else names[1:])}
        self.pairs = {(g, h): linear_svm(x[(langs == g) | (langs == h)], langs[(langs == g) | (langs == h)] == g) for f in names for g, h in combinations(self.members[f], 2)}
        return self

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        names = sorted(self.members)
        if len(names) == 1:
            chance = {names[0]: 1.0}
        elif len(names) == 2:
            p = _chance(self.family[names[1]], x)
            chance = {names[0]: 1 - p, names[1]: p}
        else:
            raw = {f: _chance(self.family[f], x) for f in names}
            chance = {f: p / sum(raw.values()) for f, p in raw.items()} if sum(raw.values()) else dict.fromkeys(names, 1 / len(names))
        best = max(names, key=lambda f: chance[f])
        langs = self.members[best]
        votes, sums = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for g, h in combinations(langs, 2):
            p = _chance(self.pairs[g, h], x)
            votes[g if p >= 0.5 else h] += 1
            sums[g] += p
            sums[h] += 1 - p
        lang = max(langs, key=lambda g: (votes[g], sums[g]))
        return lang, chance[best] * (sums[lang] / (len(langs) - 1) if len(langs) > 1 else 1.0)


def training_rows(docs: DataFrame, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most `each` documents for each language, whose crc32(doc_id) mod 4 is not 2: those of the smallest hashed ids."""
    narrow = docs.filter("doc_id is not null and lang is not null and text is not null and crc32(cast(doc_id as string)) % 4 != 2")
    ids = narrow.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang"), F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(64)).alias("_salt"))
    for by in (("_lang", "_salt"), ("_lang",)):  # a language is cut down in 64 parts before it meets in one
        order = Window.partitionBy(*by).orderBy(F.xxhash64("_id"), "_id")
        ids = ids.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each).drop("r")
    ids = ids.select("_id", "_lang")

    def run(batches):
        for b in batches:
            made = [letter_grams((x or b"").decode("utf-8", "replace")) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if m is None else m.astype(np.float16).tobytes() for m in made], pa.binary())], ["doc_id", "lang", "x"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("t"))
    chosen = chosen.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "t")
    rows = chosen.mapInArrow(run, "doc_id long, lang string, x binary").filter("x is not null").dropDuplicates(["doc_id", "lang"]).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id))
    return np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(-1, DIM), np.array([r.lang for r in rows], object)


def identify(docs: DataFrame, each: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of docs.

    Learns from the text and non-null lang of at most `each` documents a language that are not held
    out (crc32 of the doc_id as text, mod 4, is not 2); nothing but the whole text enters a
    prediction. lang_pred is a learned value of lang, or 'und' with score 0 if the text is null or
    has no letter, or if there is nothing to learn from. A null doc_id is not held out. Repeated
    rows come back as they are; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_code(spark)
    x, langs = training_rows(docs, each)
    shared = spark.sparkContext.broadcast(Hierarchy().fit(x, langs) if len(langs) else None)

    def run(batches):
        model = shared.value
        for b in batches:
            found = []
            for t in b.column(2).to_pylist():
                g = letter_grams((t or b"").decode("utf-8", "replace")) if model else None
                found.append((UNKNOWN, 0.0) if g is None else model.predict(g))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predict_rows(docs: DataFrame, each: int = 300) -> DataFrame:
    """(row, lang_pred, score): identify() for whole rows, as one struct."""
    x, langs = training_rows(docs, each)
    shared = docs.sparkSession.sparkContext.broadcast(Hierarchy().fit(x, langs) if len(langs) else None)

    def work():
        model = shared.value

        def one(text):
            g = letter_grams(text) if model else None
            return (UNKNOWN, 0.0) if g is None else model.predict(g)

        def of(texts):
            found = [one(t) for t in texts]  # a text's 32 KB of features are gone before the next one's
            return [f[0] for f in found], [f[1] for f in found]

        return of

    return map_texts(packed(docs), work, [("lang_pred", T.StringType()), ("score", T.DoubleType())], [pa.string(), pa.float64()])


def op9_hierarchical_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
