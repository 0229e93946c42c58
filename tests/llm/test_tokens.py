import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from passagekit.llm.bpe import Automaton, Encoder, Vocabulary, encode_documents, load_vocabulary
from passagekit.llm.packing import best_fit, enumerate_patterns, fit_repeats, pack_documents, plan, slots

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n  x", "it's we'll I'VE 'tis ''s", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "é ñ ß 漢字 😀😀   x", "1234567 ½ ²", "!!!???... --", "tab\tnew\r\nline \n", "\x1c\x1f\x85 ​", "x" * 5000, "A" + " " * 300 + "B", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_of_every_character(library):
    encoder = Encoder(Vocabulary(*load_vocabulary(PATH)))
    chars = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 50):
        text = "".join(f"a{c} {c}{c}1{c}" for c in chars[at : at + 50])
        assert encoder.encode(text) == wanted(library, text)


def test_automaton_finds_exactly_its_words(tmp_path):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcé ") for _ in range(rng.randint(0, 7))).encode(): tuple(rng.choices(range(9), k=rng.randint(1, 4))) for _ in range(600)}
    made = Automaton.compile(words)
    found = Automaton(Automaton.save(made, str(tmp_path)))
    assert all(found.find(w) == ids for w, ids in words.items())
    for _ in range(2000):
        w = "".join(rng.choice("abcé d") for _ in range(rng.randint(0, 8))).encode()
        assert found.find(w) == words.get(w)
    assert len(made["final"]) < sum(map(len, words)) / 2
    assert Automaton(Automaton.save(Automaton.compile({}), str(tmp_path))).find(b"") is None


@pytest.mark.parametrize("lexicon", [0, 500])
def test_encoding_and_decoding_documents(spark, sf, library, lexicon):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, 1) for r in docs] + [(10_000 + i, t, 2) for i, t in enumerate(ODD)] + [(None, "null id", 3), (10_004, "again", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = encode_documents(df, PATH, lexicon_words=lexicon, keep_ids=True).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        options = [wanted(library, t) for t in texts[r.doc_id]]
        assert r.ids in options and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(df.limit(0), PATH).count() == 0


def test_plans_use_every_piece_once():
    rng = random.Random(2)
    for capacity in (8, 100, 1024):
        for _ in range(15):
            hist = {n: rng.randint(1, 60) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 40)))}
            for made in (plan(hist, capacity), best_fit(hist, capacity)):
                used = {}
                for pattern, times in made:
                    assert 0 < sum(pattern) <= capacity and times > 0
                    for n in pattern:
                        used[n] = used.get(n, 0) + times
                assert used == hist
            assert sum(t for _, t in plan(hist, capacity)) <= sum(t for _, t in best_fit(hist, capacity))
    assert plan({}, 8) == [] and slots([]) == {}


def test_fit_follows_a_histogram_made_of_patterns():
    hist = {3: 100, 7: 100, 2: 60, 8: 60}
    patterns = enumerate_patterns(hist, 10)
    x = dict(zip(patterns, fit_repeats(patterns, hist)))
    assert all(v >= 0 for v in x.values()) and x[3, 7] > 50
    assert sum(t for _, t in plan(hist, 10)) == 160


def test_packing_against_the_library(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(d, t, "c") for d, t in docs] + [(20_000 + i, t, "c") for i, t in enumerate(ODD)] + [(None, "x", "c"), (20_003, ODD[3], "c")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, rank string"), PATH).collect()
    pieces, want = [], []
    for d, t, _ in rows:
        ids = np.array([*wanted(library, t), 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    places = {}
    for r in got:
        pieces.append((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces, key=str) == sorted(want, key=str)
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(w[3] for w in want) // 1024) + 1
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
