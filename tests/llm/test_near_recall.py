import random

from passagekit.llm.simhash import near_dedup


def test_isolated_pairs_at_the_threshold_are_all_found(spark):
    rng = random.Random(9)
    rows, close = [], []
    while len(close) < 300:
        words = [f"x{rng.randrange(10**9)}" for _ in range(rng.randint(80, 300))]
        copy = list(words)
        for _ in range(rng.randint(1, len(words) // 45 + 1)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10**9)}"
        a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, copy))
        if 0.8 <= len(a & b) / len(a | b) < 0.84:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(copy))]
            close.append(rows[-1][0])
    kept = {r.doc_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(d not in kept for d in close) >= 0.99 * len(close)
    assert kept >= {d for d, _ in rows} - set(close)
