import base64
import random

from passagekit.llm.secrets import find_secrets


def test_values_after_a_name_are_candidates_of_their_own(spark):
    rng = random.Random(11)
    values = [base64.b64encode(rng.randbytes(48 if i % 2 else 46)).decode() for i in range(40)]
    names = ["sig", "AccountKey", "auth", "https://a.example/x?key"]
    rows = [(i, f"see {names[i % 4]}={v} here") for i, v in enumerate(values)]
    got = {r.doc_id: r.spans for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = [f"random:{t.index(v)}:{t.index(v) + len(v)}" for (_, t), v in zip(rows, values)]
    assert sum(s in got[i] for i, s in enumerate(spans)) >= 36


def noise(rng, encoding, n):
    alphabet = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}[encoding]
    return "".join(rng.choice(alphabet) for _ in range(n))


def readable(rng, words):
    ws = [rng.choice(words) for _ in range(rng.randint(4, 8))]
    return rng.choice(["_".join(ws), "/".join(ws), "".join(w.title() for w in ws), "-".join([*ws, str(rng.randint(1, 2030))]), "_".join(ws).upper(), "".join(ws).upper()])


def test_noise_of_every_encoding_and_length_among_readable_runs(spark):
    rng = random.Random(12)
    words = "the user index value table count order name page search find last first document stream window people number state with water between report server account".split()
    rows, kind = [], {}
    for encoding in ("hex", "HEX", "base32", "base64"):
        for n in (20, 24, 32, 40, 64):
            for _ in range(60):
                kind[len(rows)] = (encoding, n)
                rows.append((len(rows), f"see {noise(rng, encoding, n)} here"))
    for _ in range(4000):
        kind[len(rows)] = None
        rows.append((len(rows), f"see {readable(rng, words)} here"))
    got = {r.doc_id: r.spans != "" for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rate = {}
    for d, k in kind.items():
        rate.setdefault(k, []).append(got[d])
    rate = {k: sum(v) / len(v) for k, v in rate.items()}
    print(rate)
    assert rate.pop(None) <= 0.005
    assert all(v >= (0.55 if n == 20 else 0.8) for (_, n), v in rate.items())
