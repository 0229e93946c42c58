import base64
import hashlib
import random
import re

from pyspark.sql import functions as F

from passagekit.llm import fingerprint as P
from passagekit.llm.secrets import find_secrets


def test_fingerprints_add_and_subtract(spark):
    df = spark.createDataFrame([("a b.\nc d", "e\nf", "e\nc d\na b.\nf", "c d\na b.", "")], "a string, b string, both string, turned string, none string")
    for c in df.columns:
        df = P.with_fingerprint(df, c, f"f_{c}")
    r = df.select("*", P.combine(F.col("f_a"), F.col("f_b")).alias("sum"), P.remove(F.col("f_both"), F.col("f_b")).alias("rest")).first()
    assert r.sum == r.f_both and r.rest == r.f_a == r.f_turned != r.f_b
    assert set(r.f_none) == {0}


def test_likeness_follows_what_texts_share(spark):
    rng = random.Random(1)
    unit = lambda: " ".join(str(rng.random()) for _ in range(4)).replace(".", "")
    rows = []
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for _ in range(30):
            a = [unit() for _ in range(20)]
            rows.append((share, "\n".join(a), "\n".join(a[: int(20 * share)] + [unit() for _ in range(20 - int(20 * share))])))
    df = spark.createDataFrame(rows, "share double, a string, b string")
    df = P.with_fingerprint(P.with_fingerprint(df, "a", "fa"), "b", "fb").withColumn("pa", P._projections(F.col("fa"))).withColumn("pb", P._projections(F.col("fb")))
    got = {r.share: r.near for r in df.groupBy("share").agg(F.avg(P.likeness(F.col("fa"), F.col("fb"), F.col("pa"), F.col("pb"))).alias("near")).collect()}
    assert got[1.0] == 1.0
    assert all(abs(near - share) < 0.08 for share, near in got.items())


def test_fingerprints_of_documents(spark, sf):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = base + [(10**12, None), (10**12 + 5000, ""), (-7, "é😀\nx"), (-3000, "last one here"), (5, "again five"), (-(2**63), "least"), (2**63 - 1, "most of all")]
    df = spark.createDataFrame([(d, t, "h") for d, t in [*rows, (None, "no id at all")]], "doc_id long, text string, fp string")
    got = P.fingerprint_documents(df).collect()
    assert len(got) == len(rows) + 1
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        n, k = order[(i + 1) % len(order)][1], len(t) // 3
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    texts = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            texts.setdefault(dict((d, t or "") for d, t in rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in texts.values())
    assert P.fingerprint_documents(df.limit(0)).count() == 0
    assert P.fingerprint_documents(df.filter("doc_id = -7")).first().near_next == 1.0


def slow_base(t):
    kinds = ["assign", "access", "hex"]
    s = [("assign", m.start(), m.end()) for m in re.finditer(r'((?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', t) if len(m[2]) >= 8]
    s += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    s += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(s, key=lambda x: (x[1], kinds.index(x[0]))))


def test_secrets_against_brute_force(spark):
    rng = random.Random(6)
    pieces = ["token", "Secret", "api_key", "APIKEY", "passwd", ":", "=", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "é", "😀", "x", "\n", "AKIAABCDEFGHIJKL", "deadbeef" * 4]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 14))), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (None, "token=abcdefgh", "s"), (902, "a" * 100_000 + " token: " + "f" * 50_000, "s"), (3, "token=abcdefgh", "s")]
    got = find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    want = sorted((str(d), hashlib.sha256(slow_base(t or "").encode()).hexdigest()) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    for r in got:
        n = [x.split(":")[0] for x in r.spans.split(",")]
        assert (n.count("assign"), n.count("access"), n.count("hex")) == (r.n_assign, r.n_access, r.n_hex)
    assert find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_battery_tells_noise_from_text(spark):
    rng = random.Random(7)
    noise = [base64.b64encode(bytes(rng.randrange(256) for _ in range(48))).decode() for _ in range(30)]
    plain = ["theinternationalizationofcommunication", "some_very_long_identifier_name_for_a_function", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + "Z" * 8, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678901234567890123456789012"[:31], "http/www/example/org/path/to/some/page/of/text"]
    rows = [(i, f"see {s} here") for i, s in enumerate(noise + plain)]
    got = {r.doc_id: "random" in r.spans for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(30)) >= 27
    assert not any(got[30 + i] for i in range(len(plain)))
