import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.llm import pii
from passagekit.llm.language import identify
from passagekit.llm.neighbours import encode, estimate, nearest, rotation
from passagekit.llm.quality import score_quality


def slow_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return spans + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_of_random_texts():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "@", ".", "1", "4111111111111111", "-", " ", "+", "(", ")", "256", "10.0.0.7", "x@y.zz", "é", "0", "007", "+1 (017) 555-7713"]) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(t) == slow_base(t), t


def test_model_adds_disguised_data_and_leaves_look_alikes():
    fitted = pii.model()
    kinds = lambda t: {k for k, *_ in pii.find_spans(t, fitted)[1]}
    assert kinds("please call (415) 555-0134 today") == {"phone"}
    assert kinds("you may contact jane.doe at example dot com please") == {"email"}
    for clean in ("on 2021-10-12 we met", "version 1.2.3 of it", "see page 12 and 13", "it was at the dot of noon", "In 1990 there were 2000 more", "Licensed under the Apache License, Version 2.0."):
        assert kinds(clean) == set(), clean
    base, spans = pii.find_spans("mail x@y.zz, call +1 (017) 555-7713.", fitted)
    assert set(base) <= set(spans)
    assert pii.redact("mail x@y.zz, call +1 (017) 555-7713.", spans) == "mail <EMAIL>, call <PHONE>."


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a@b.co", "s"), (3, "a@b.co", "s"), (None, "é 10.0.0.1", "s"), (4, "1" * 200_000 + " " + "a" * 200_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.personal_data(df).collect()
    assert len(got) == 6 and sum(r.n_email for r in got) == 2 and sum(r.n_ip for r in got) == 1
    for r in got:
        t = next(x or "" for d, x, _ in rows if d == r.doc_id)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in slow_base(t)).encode()).hexdigest()
    assert pii.personal_data(df.limit(0)).count() == 0
    assert pii.redact_rows(df).count() == 6


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    got = score_quality(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "some words here", 0.3), (3, "some words here", 0.3), (None, "x", 0.4), (5, "w " * 100_000, 0.5)], "doc_id long, text string, score double")
    for labels in ([], [(3, 1, 0)], [(2, 0, 0), (3, 1, 0), (3, 1, 0), (None, 1, 0), (5, None, 0)]):
        got = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert score_quality(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_language_of_odd_rows_and_new_languages(spark):
    words = {"en": "the of and to in", "de": "der die und das ist", "nl": "het een van de en", "xx": "zzq qqz zqz qzq zzz", "fr": "le la les des est"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[g].split(), k=20)), g, 0.0) for i, g in enumerate(sorted(words) * 12)]
    odd = [(900, None, "en", 1.0), (901, "", "en", 1.0), (902, "123 --- !!!", "en", 1.0), (None, "the of and", None, 1.0), (903, "der " * 50_000, None, 1.0), (903, "der " * 50_000, None, 1.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert {by[d].lang_pred for d in (900, 901, 902)} == {"und"} and by[900].score == 0
    assert by[903].lang_pred == "de"
    assert sum(by[i].lang_pred == g for i, _, g, _ in rows) / len(rows) > 0.95
    none = identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert identify(df.limit(0)).count() == 0


def test_codes_estimate_cosines_within_their_bounds():
    rng = np.random.default_rng(3)
    assert np.allclose(rotation(20) @ rotation(20).T, np.eye(20))
    for dim in (1, 7, 64, 130):
        x, q = rng.standard_normal((400, dim)), rng.standard_normal((9, dim))
        inner, bound = estimate(q, *encode(x), 3.0)
        true = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
        assert (np.abs(inner - true) <= bound).mean() > 0.99


@pytest.mark.parametrize("dim", [3, 64])
def test_nearest_against_brute_force(spark, dim):
    rng = np.random.default_rng(5)
    x = {i: rng.standard_normal(dim).round(3).tolist() for i in range(700)}
    for i in range(100, 160):
        x[i] = x[50]
    odd = {800: None, 850: [0.0] * dim, 900: [1.0, None] + [1.0] * (dim - 2), 950: [float("nan")] * dim, 1000: [float("inf")] + [1.0] * (dim - 1), 1050: [], 1100: [1.0, 2.0]}
    rows = [(i, v, 0.5) for i, v in [*x.items(), *odd.items(), (7, x[7]), (None, x[1])]]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")).collect()
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    hit = total = 0
    for q in range(0, 700, 50):
        v = np.array(x[q])
        cosine = (m * v).sum(1) / (np.sqrt((m * m).sum(1)) * np.sqrt((v * v).sum()))
        cosine[ids == q] = -9
        best = np.lexsort((ids, -cosine))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        hit += len({r[1] for r in mine} & set(ids[best].tolist()))
        total += 5
        for _, i, s in mine:
            assert abs(s - cosine[ids == i][0]) < 1e-12
    assert hit / total >= 0.99
    assert {r.query_id for r in got} == set(range(0, 700, 50))
    few = nearest(spark.createDataFrame(rows[:2] + [(100, x[3], 0.1)], "vec_id long, embedding array<double>, score double")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (100, 1), (100, 2)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
