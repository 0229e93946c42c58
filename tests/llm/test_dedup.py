import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from passagekit.llm.graph import connected_components
from passagekit.llm.lines import dedup_lines, edit_distance, normal_lines, numbered_lines, similar
from passagekit.llm.simhash import near_dedup, near_links, simhash64, simhash_components


def classes(edges, nodes):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    return {n: root(n) for n in nodes}


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 90)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5), (7, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == classes(real, {x for e in real for x in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(text, n):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] if words else []
    h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One  two\x0bTHREE", "a b c d", "É é É é x", "w " * 500, " ".join(map(str, range(70_000)))])
def test_simhash_of_odd_texts(text):
    assert simhash64(None if text is None else text.encode()) == (slow_simhash(text, 4) if text is None or len(text) < 10_000 else simhash64(text.encode(), 4))


@pytest.mark.parametrize(("distance", "blocks", "tile"), [(4, 6, 4096), (4, 6, 5), (4, 5, 3), (6, 9, 4096), (0, 2, 4096)])
def test_near_links_lose_and_invent_nothing(spark, distance, blocks, tile):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(80)}
    for base in list(fps)[:12]:
        fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(12)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    found = near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), distance, blocks, tile).collect()
    close = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    assert classes([(r.a, r.b) for r in found], fps) == classes(close, fps)


def test_simhash_components_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "x"), (900002, "", "y"), (900003, "  ", "z"), (900004, "only", None), (900004, "only", None), (None, "only", None)], "doc_id long, text string, fp string")
    both = docs.select("doc_id", "text").withColumnRenamed("text", "text").unionByName(odd.select("doc_id", "text"))
    got = simhash_components(both, tile=4).collect()
    rows = both.collect()
    fp = {r.doc_id: slow_simhash(r.text, 4) for r in rows if r.doc_id is not None}
    want = classes([(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got if r.doc_id is not None} == {(d, fp[d], want[d]) for d in fp}
    assert [r.component_id for r in got if r.doc_id is None] == [900004]
    assert simhash_components(odd.limit(0)).count() == 0


def test_near_dedup_keeps_one_of_each_and_all_columns(spark):
    rows = [(1, "same words in here now", "a", 1), (2, "same words in here now", "b", 2), (3, "something else entirely different", "c", 3), (3, "something else entirely different", "c", 3), (None, "same words in here now", "d", 4), (5, None, "e", 5), (6, "", "f", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


@pytest.mark.parametrize("seed", range(40))
def test_edit_distance(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 30))) for _ in range(2))
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    assert edit_distance(a, b) == row[-1]


def slow_lines(docs, least):
    """By edit similarity of all pairs of lines, without fingerprints or keys."""
    lines = [(d, i, b" ".join(w).decode("utf-8", "replace"), w) for d, t in docs if d is not None for i, w in enumerate(normal_lines(t)) if w]
    texts = sorted({x[2] for x in lines})
    letters = {x: Counter(x) for x in texts}

    def near(a, b):
        if (n := max(len(a), len(b))) * least > min(len(a), len(b)) or sum((letters[a] - letters[b]).values()) > (1 - least) * n + 1e-9:
            return False
        return similar(a, b, least)

    top = classes([(a, b) for a, b in combinations(texts, 2) if near(a, b)], texts)
    first = {}
    for d, i, t, _ in sorted(lines, key=lambda x: x[:2]):
        first.setdefault(top[t], (d, i))
    gone = {(d, i) for d, i, t, _ in lines if first[top[t]] != (d, i)}
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs if d is not None}


def test_line_ids_tell_normalised_lines_apart(spark):
    rng = random.Random(6)
    parts = ["a", "B", "b", "É", "é", "ß", "x" * 300, "x" * 301, "y" * 700, "12", "...", "\t", "  ", "\u00a0", "\u2028", "word", "Wörter", "abcdefgh", "abcdefghi", "ab", "c", "\x0b"]
    texts = ["\n".join("".join(rng.choices([*parts, " "], k=rng.randint(0, 14))) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (10, 11, 300, 2000)] + ["", "\n\n", "z " * 70_000, "q" * 100_000, "\n".join(f"line {i} of a long text with some more words in it" for i in range(100_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.h for r in numbered_lines(df).collect()}
    want = {(d, i): b" ".join(w) for d, t in enumerate(texts) for i, w in enumerate(normal_lines(t)) if w}
    assert got.keys() == want.keys()
    assert len(set(got.values())) == len(set(want.values())) == len({(got[k], want[k]) for k in got})


@pytest.mark.parametrize("tile", [2048, 3])
def test_line_dedup_against_brute_force(spark, sf, tile):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(6)]

    def vary(line):
        w = line.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    docs = [(i, "\n".join(rng.choice([b, vary(b), vary(vary(b)), b.upper() + "!!", "", "***", "short one", " ".join(rng.choices(words, k=12))]) for b in rng.choices(base, k=6))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[0][1]), (None, docs[0][1]), (104, "x " * 3000)]
    df = spark.createDataFrame([(d, t, "h", 1) for d, t in docs], "doc_id long, text string, h string, line_no int")
    got = dedup_lines(df, tile=tile).collect()
    want = slow_lines(docs, 0.8)
    assert {r.row.doc_id: r.text for r in got if r.row.doc_id is not None} == want
    assert [r.text for r in got if r.row.doc_id is None] == [docs[0][1]]
    for r in got:
        assert r.n_lines - r.n_removed == (0 if r.n_lines == r.n_removed else len(r.text.split("\n")))
    assert dedup_lines(df.limit(0)).count() == 0


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([4, 60, 150]))
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows) * 7 % 101, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {t}

    sets, fp = {d: shingles(t) for d, t in rows}, {d: slow_simhash(t, 5) for d, t in rows}

    def links(bits):
        return classes([(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and (fp[a] ^ fp[b]).bit_count() <= bits], sets)

    for tile in (256, 3):
        got = {r.doc_id for r in near_dedup(docs, tile=tile).collect()}
        # All of what the blocks promise, nothing beyond what the similarity allows.
        assert set(links(64).values()) <= got <= set(links(8).values())
