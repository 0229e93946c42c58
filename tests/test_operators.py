import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from passagekit.functions import text as X
from passagekit.operators import corpus as C
from passagekit.operators import folds as W
from passagekit.operators import retrieval as R
from passagekit.operators import vectors as V
from passagekit.sources import imports as I
from passagekit.sources import sinks as K
from passagekit.streaming import drivers as D
from passagekit.streaming import transitions as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("query", "terms"), [("be doers of the word", "doers word"), ("for God so loved the world", "God loved world"), ("I am a the", "")])
def test_and_terms(spark, query, terms):
    assert " ".join(one(spark, X.and_terms(F.lit(query)))) == terms


def test_query_builders(spark):
    assert one(spark, X.phrase_query(F.lit("Follow peace with all men"))) == '"Follow peace with all men"'
    assert one(spark, X.phrase_query(F.lit("God's love* NEAR/2"))) == '"God\'s love NEAR2"'
    assert one(spark, X.or_terms(F.lit("It's a new creature Old things are passed away"))) == ["It's", "new", "creature", "Old", "things", "passed", "away"]
    many = " ".join(f"word{i}" for i in range(16))
    assert len(one(spark, X.and_terms(F.lit(many)))) == 12 and len(one(spark, X.or_terms(F.lit(many)))) == 10


def test_bm25_against_sqlite(spark):
    texts = ["love your neighbor as yourself", "love love love", "your faith and your love", "grace and peace", "the neighbor went home", "peace I leave with you my peace"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text, tokenize='unicode61')")
    con.executemany("insert into t(rowid, text) values (?, ?)", enumerate(texts))
    p = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, paragraph long, text string")
    for query, phrase in (("love", False), ("neighbor home", False), ("your love", True), ("peace", False)):
        q = spark.createDataFrame([(1, query.split())], "query_id int, words array<string>")
        i = R.batch_index(p, (q,))
        found = R.scored_phrases(R.phrase_hits(q, i), i.sizes, i.stats) if phrase else R.scored_terms(R.term_hits(q, i, True), i.frequency, i.sizes, i.stats)
        want = con.execute("select rowid, -bm25(t) from t where t match ?", (f'"{query}"' if phrase else query,)).fetchall()
        assert {r.doc_id: r.score for r in found.collect()} == pytest.approx(dict(want), abs=2e-6)


def test_cross_reference_rows_and_import(spark, tmp_path):
    codes = spark.createDataFrame([("Gen", 1), ("John", 43), ("Ps", 19)], "code string, book_number int")
    path = tmp_path / "refs.txt"
    path.write_text("From Verse\tTo Verse\tVotes\n# note\n\nGen.1.1\tJohn.3.16\t5\nGen.1.1\tPs.33.6-Ps.33.9\t12\nGen.1.1\tXyz.1.1\t9\nGen.1.2\tPs.1.1\n")
    rows = I.cross_references(spark, str(path), codes)
    shown = rows.filter("from_verse = 1").orderBy(F.desc("votes")).select(C.reference_text(F.col("to_book"), F.col("to_chapter"), F.col("to_verse_start"), F.col("to_verse_end")).alias("r"), "votes")
    assert [tuple(r) for r in shown.collect()] == [("19:33:6-9", 12), ("43:3:16", 5)]
    assert rows.filter("from_verse = 2").first().votes == 0
    assert {r.to_verse_end for r in I.cross_references(spark, str(path), codes, ranges=False).collect()} == {16, 6, 1}


def test_edition_and_paragraph_json(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"books": [{"name": "Genesis", "abbreviation": None, "chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "In the"}, {"verse": 2, "text": "And"}]}]}]}))
    got = I.edition_json(spark, str(tmp_path / "e.json"), "T").orderBy("verse").collect()
    assert [(r.book_number, r.book_abbreviation, r.testament, r.chapter, r.verse, r.text) for r in got] == [(1, "Gene", "OT", 1, 1, "In the"), (1, "Gene", "OT", 1, 2, "And")]
    (tmp_path / "p.json").write_text(json.dumps({"title": "T", "abbreviation": "t", "book_number": 2, "chapters": [{"chapter": 1, "title": "One", "paragraphs": ["a", "b"]}]}))
    rows = I.paragraph_json(spark, str(tmp_path / "p.json"))
    assert [(r.chapter, r.paragraph, r.text) for r in rows.orderBy("paragraph").collect()] == [(1, 1, "a"), (1, 2, "b")]
    K.replace_books(rows, str(tmp_path / "store"))
    K.replace_books(rows.filter("paragraph = 1").withColumn("text", F.lit("new")), str(tmp_path / "store"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "store")).collect()] == ["new"]


def test_vector_files(spark, tmp_path):
    import numpy as np

    np.eye(3, 4, dtype="<f4").tofile(tmp_path / "m.bin")
    np.array([10, 20, 30], "<i8").tofile(tmp_path / "i.bin")
    vectors = I.vector_files(spark, str(tmp_path / "m.bin"), str(tmp_path / "i.bin"), 4)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<float>")
    top = V.exact_topk(vectors, q, 2).orderBy("rank").collect()
    assert (top[0].vec_id, top[0].similarity, len(top)) == (10, 1.0, 2)
    with pytest.raises(Exception, match="vectors of 5"):
        I.vector_files(spark, str(tmp_path / "m.bin"), str(tmp_path / "i.bin"), 5).collect()


def test_provider_events(spark):
    word = {"word": "hi", "start": 0.0, "end": 0.5, "confidence": 0.9}
    lines = [{"type": "Results", "is_final": True, "speech_final": True, "channel": {"alternatives": [{"transcript": "hi", "confidence": 0.9, "words": [word, {"word": "x"}]}]}}, {"type": "Results", "channel": {"alternatives": [{"transcript": "h"}]}}, {"type": "Metadata"}]
    got = I.live_transcripts(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("bad",)], "value string")).collect()
    assert [(r.kind, r.transcript, r.speech_final, len(r.words)) for r in got] == [("final", "hi", True, 1), ("partial", "h", False, 0)]
    got = I.worker_events(spark.createDataFrame([('{"type": "final", "text": "yes"}',), ("nonsense",), ('{"type": "other"}',)], "value string")).collect()
    assert [(r.kind, r.transcript, r.confidence) for r in got] == [("final", "yes", 0.75)]
    body = {"results": {"channels": [{"alternatives": [{"transcript": "a", "confidence": 0.5}]}, {"alternatives": [{"transcript": ""}]}]}}
    assert [r.transcript for r in I.batch_transcripts(spark.createDataFrame([(json.dumps(body),)], "value string")).collect()] == ["a"]


@pytest.mark.parametrize(("direct", "semantic", "want"), [
    ([0.96], [0.72], [0.96]), ([], [0.62, 0.78], [0.78]), ([0.90], [0.99], [0.90]), ([], [0.20], []),
])
def test_merge(spark, direct, semantic, want):
    rows = [(1, "43:3:16", c, True, i) for i, c in enumerate(direct)] + [(1, "43:3:16", c, False, 9 + i) for i, c in enumerate(semantic)]
    got = V.merge_detections(spark.createDataFrame(rows, "s int, k string, confidence double, is_direct boolean, ord int"), ["s"], ["k"]).collect()
    assert [r.confidence for r in got] == want


def test_chunks(spark):
    assert one(spark, X.sentence_windows(F.lit("Hi. Bye."))) == []
    got = one(spark, X.sentence_windows(F.lit("one two three four five. six seven eight nine ten! tail")))
    assert got == ["one two three four five", "one two three four five. six seven eight nine ten", "six seven eight nine ten", "six seven eight nine ten. tail"]


def test_levels_and_resampling(spark):
    rms, peak = W.level(F.array(*[F.lit(x) for x in (32767, -32767)]))
    assert one(spark, rms) == pytest.approx(1.0) and one(spark, peak) == pytest.approx(1.0)
    assert one(spark, W.resample(F.array(*[F.lit(x) for x in (0, 10, 20, 30)]), 2, 1)) == [0.0, 20.0]
    assert one(spark, W.resample(F.array(*[F.lit(x) for x in (0, 10)]), 1, 2)) == [0.0, 5.0, 10.0]


@pytest.mark.parametrize(("value", "flag", "share"), [("true", True, None), ("0", False, 0.0), ("75", True, 0.75), ("0.5", True, 0.5), ("maybe", None, None), ("250", True, 1.0)])
def test_loose_types(spark, value, flag, share):
    assert one(spark, X.loose_bool(F.lit(value))) is flag
    assert one(spark, X.loose_share(F.lit(value))) == share


def test_embedding_once_a_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in V.embed_with(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()}
    assert got == {1: [1.0, 1.0], 2: [1.0, 1.0], 3: [1.0, 1.0], 4: None}
    assert one(spark, F.size(V.hashed_embedding(F.array(F.lit("x"), F.lit("y"))))) == 64


def test_anchored_chapters(spark):
    texts = spark.createDataFrame([(1, "contents ONE TWO\nONE first part\nTWO second part")], "id int, text string")
    anchors = spark.createDataFrame([(1, "ONE"), (2, "TWO")], "chapter int, anchor string")
    assert [r.text for r in I.chapters_by_anchor(texts, anchors, "id").orderBy("chapter").collect()] == ["ONE first part", "TWO second part"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, f"line {i % 4} of {s}", "final") for s in ("a", "b") for i in range(20)]
    df = spark.createDataFrame(rows, "session string, seq long, text string, kind string")
    schema = "session string, seq long, accepted boolean, reason string"
    batch = sorted(map(tuple, D.fold(df, S.Router, "session", ["seq"], schema).collect()))
    for i in range(4):
        df.filter(f"seq between {5 * i} and {5 * i + 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = D.stream(stream, S.Router, "session", ["seq"], schema).writeStream.format("memory").queryName("routed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("routed").collect()
    assert len(got) == len(batch) == 40 and {r.reason for r in got} == {"", "duplicate_final"}


def test_plans(spark):
    plans = spark.createDataFrame([("1", "ok", [("a", "A", 0)]), ("2", "", []), ("3", "bad", [("", "B", 1)])], "id string, title string, items array<struct<id:string,title:string,`order`:int>>")
    assert [r.id for r in plans.filter("title != ''").collect()] == ["1", "3"]
    moved = spark.range(5).select("id", W.move_item(F.col("id"), 3, 1).alias("m")).collect()
    assert [r.m for r in moved] == [0, 2, 3, 1, 4]


def test_window_errors_against_the_plain_table():
    import random

    rng = random.Random(5)
    for _ in range(300):
        p, t = ("".join(rng.choices("abc ", k=rng.randint(a, 12))) for a in (1, 0))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            last, row[0] = row[0], 0
            for i, d in enumerate(p, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (c != d))
            best = min(best, row[-1])
        assert R.window_errors(p, t) == best


def test_context_search_finds_short_queries_in_long_passages(spark):
    long = "In the beginning was the word and the word was with god and so it went on for a good while"
    p = spark.createDataFrame([(1, 1, long, "John"), (1, 2, "Something else entirely", "John"), (2, 1, "the wrod was wiht us", "Mark")], "doc_id long, paragraph long, text string, source string")
    q = spark.createDataFrame([(1, "The  word was with"), (2, "x"), (3, "zzzzzz qqqq")], "query_id long, query string")
    got = [(r.query_id, r.rank, r.doc_id, r.paragraph) for r in R.context_search(p, q, least=0.1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1, 1), (1, 2, 2, 1)] or got == [(1, 1, 2, 1), (1, 2, 1, 1)]
    assert R.context_similarity("abc", [("abc", 1.0)]) == 1.0 and R.context_similarity("abc", [("xyz", 1.0)]) == 0.0


def test_many_queries_meet_blocks_of_vectors(spark, monkeypatch):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(3)] if i % 3 else [rng.random() for _ in range(5)]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 0.0]), (1003, [float("nan"), 1.0, 0.0]), (1004, [float("inf"), 0.0, 1.0]), *[(2000 + i, [1.0, 1.0, 1.0]) for i in range(30)]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 2 = 0 and vec_id != 1004").selectExpr("vec_id as query_id", "embedding as vector")
    few = sorted(map(tuple, V.exact_topk(vectors, queries, 4, least=0.1).collect()))
    monkeypatch.setattr(V, "MOST_BROADCAST", 9)
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 100)
    many = V.exact_topk(vectors, queries, 4, least=0.1)
    assert sorted(map(tuple, many.collect())) == few and len(few) > 500
    # Products are those of matrices, not an expression for each pair.
    assert "zip_with" not in many._jdf.queryExecution().toString()
    whole = {i: v for i, v in rows if v and None not in v and i not in (1003, 1004)}
    for q in (2, 4, 2002):
        near = sorted((-round(sum(a * b for a, b in zip(whole[q], v)), 6), i) for i, v in whole.items() if len(v) == len(whole[q]))[:4]
        assert [(i, s) for x, _, i, s in few if x == q] == [(i, -s) for s, i in near if -s >= 0.1]
