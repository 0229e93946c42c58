import json

import pytest
from pyspark.sql import functions as F

from passagekit.operators import corpus as C
from passagekit.operators import references as G
from passagekit.operators import service as V
from passagekit.operators import vectors as E
from passagekit.sources import imports as I
from passagekit.sources import sinks as K
from passagekit.streaming import drivers as D


@pytest.fixture(scope="module")
def passages(spark, sf):
    return C.passages(spark.read.parquet(f"{sf}/documents.parquet")).filter("doc_id < 20")


def test_written_passages_come_back_by_edition(spark, passages, tmp_path):
    K.write_passages(passages, str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.count() == passages.count()
    lang = passages.first().lang
    assert got.filter(F.col("lang") == lang).count() == passages.filter(F.col("lang") == lang).count()
    assert (tmp_path / "p" / f"lang={lang}").is_dir()


def test_written_index_agrees_with_the_passages(spark, passages, tmp_path):
    K.write_index(passages, str(tmp_path / "i"))
    posts, lengths, terms = (spark.read.parquet(str(tmp_path / "i" / x)) for x in ("postings", "lengths", "terms"))
    words = {(r.doc_id, r.paragraph): [w for w in __import__("re").split(r"[\W_]+", r.text.lower()) if w] for r in passages.collect()}
    assert {(r.doc_id, r.paragraph): r.n_terms for r in lengths.collect()} == {k: len(v) for k, v in words.items()}
    assert posts.count() == sum(map(len, words.values()))
    some = next(w for v in words.values() for w in v)
    assert terms.filter(F.col("term") == some).first().df == sum(some in v for v in words.values())


def test_exports(spark, passages, tmp_path):
    lang = passages.first().lang
    K.export_json(passages, lang, str(tmp_path / "j"))
    rows = [json.loads(x) for f in sorted((tmp_path / "j").glob("*.json")) for x in f.read_text().splitlines()]
    assert [r["id"] for r in rows] == sorted(r["id"] for r in rows) and len(rows) == passages.filter(F.col("lang") == lang).count()
    (tmp_path / "e.json").write_text(json.dumps([{"id": 3, "text": "t", "ref": "Gen 1:1"}]))
    assert tuple(I.verse_export(spark, str(tmp_path / "e.json")).first()) == (3, "t", "Gen 1:1")
    dump = K.sql_dump(spark.createDataFrame([(1, "it's\n two"), (None, None)], "id int, text string"), "verses", "line")
    assert [r.line for r in dump.collect()] == ["INSERT INTO verses (id, text) VALUES (1, 'it''s two');", "INSERT INTO verses (id, text) VALUES (NULL, NULL);"]
    K.write_vectors(spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<double>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().embedding == [0.5, 1.0]


def test_emit_appends_a_stream_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        K.emit(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_stale_rows_go_in_stream_and_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 6), ("a", 4, 7), ("b", 1, 1)], "k string, arrived int, seq int")
    want = [("a", 1, 5), ("a", 2, 7), ("a", 4, 7), ("b", 1, 1)]
    schema = "k string, arrived int, seq int"
    assert sorted(map(tuple, D.drop_stale(rows, "k", "seq", ["arrived"], schema).collect())) == want
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    K.emit(D.drop_stale(stream, "k", "seq", ["arrived"], schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_plans_are_checked_listed_and_summed_up(spark, tmp_path):
    item = {"id": "i", "title": "T", "order": 0, "status": "completed"}
    plans = [{"id": "p1", "title": "One", "updatedAt": 2, "items": [item, {**item, "id": "j", "status": "pending"}]}, {"id": "p2", "title": "Two", "updatedAt": 3, "items": []}, {"id": "", "title": "x", "items": []}, {"id": "p4", "title": "x", "items": [{**item, "order": -1}]}]
    (tmp_path / "plans.json").write_text(json.dumps(plans))
    summaries = spark.createDataFrame([("p1",), ("gone",)], "id string")
    stored, left = I.plan_store(spark, str(tmp_path / "plans.json"), summaries)
    assert sorted(r.id for r in stored.collect()) == ["p1", "p2"] and [r.id for r in left.collect()] == ["p1"]
    assert [(r.id, r.n_items, r.n_completed) for r in V.plan_summaries(stored).collect()] == [("p2", 0, 0), ("p1", 2, 1)]
    assert I.valid_plans(stored).count() == 2


def test_readers_of_commands_cases_and_hymns(spark, tmp_path):
    lines = spark.createDataFrame([('{"command": "next", "value": 3}',), ('{"value": 1}',), ("bad",)], "value string")
    assert [(r.command, r.argument) for r in I.remote_commands(lines).collect()] == [("next", "3")]
    (tmp_path / "a.json").write_text(json.dumps({"name": "n", "expected": "e", "scripture_terms": ["t"], "actual": "a"}))
    (tmp_path / "b.json").write_text(json.dumps({"name": "m", "expected": "e", "scripture_terms": []}))
    assert [r.name for r in I.accuracy_cases(spark, str(tmp_path)).collect()] == ["n"]
    got = spark.createDataFrame([(n,) for n in (1, 100, 101, 695)], "n int").select(I.hymn_bucket(F.col("n")).alias("b")).collect()
    assert [r.b for r in got] == [0, 0, 1, 6]


def test_lookups_and_choices(spark):
    verses = spark.createDataFrame([(1, "Gen", 1, "a"), (2, "Gen", 2, "b")], "id int, book string, verse int, text string")
    found = spark.createDataFrame([(1, "x", 9), (None, "Gen", 2), (7, "no", 1)], "id int, book string, verse int")
    assert sorted(r.text for r in C.resolve(found, verses, "id", ["book", "verse"], "text").collect()) == ["", "a", "b"]
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "k int, n int")
    assert sorted(map(tuple, C.first_per_key(rows, ["k"], [F.col("n")]).collect())) == [(1, 3), (2, 4)]
    themes = spark.createDataFrame([("Dark blue", True, False), ("Light", True, True), ("dark red", False, True)], "name string, pinned boolean, custom boolean")
    assert [r.name for r in V.catalogue(themes, "dark", pinned=True).collect()] == ["Dark blue"]
    editions = spark.createDataFrame([(1, "KJV"), (2, "NIV")], "id int, abbreviation string")
    assert V.set_edition(editions, 2) == 2
    with pytest.raises(ValueError, match="no edition 5"):
        V.set_edition(editions, 5)
    asked = spark.createDataFrame([(1, "niv"), (2, "XYZ"), (3, None)], "n int, edition string")
    assert [(r.n, r.id) for r in V.edition_of(asked, editions).collect()] == [(1, 2)]
    order = spark.createDataFrame([("Exodus", 2), ("Genesis", 1)], "book string, ord int")
    both = spark.createDataFrame([("Exodus", 1, 1, " e "), ("Genesis", 1, 2, "g2"), ("Genesis", 1, 1, "g1")], "book string, chapter int, verse int, text string")
    assert [r.text for r in V.combine_editions(both, order).collect()] == ["g1", "g2", "e"]


def test_what_reaches_queue_and_preview(spark):
    d = spark.createDataFrame([(1, True, False, 0.5, False, 1, 1, 1), (2, False, True, 0.95, False, 1, 1, 1), (3, False, True, 0.95, True, 1, 1, 1), (4, False, True, 0.85, False, 1, 1, 1), (5, False, False, 0.99, False, 1, 0, 1)], "n int, auto_queued boolean, is_direct boolean, confidence double, chapter_only boolean, book_number int, chapter int, verse_start int")
    assert [r.n for r in V.queue_route(d).orderBy("n").collect()] == [1, 2, 4]
    assert [r.n for r in V.live_preview(d).orderBy("n").collect()] == [2]
    said = ["John 3:16", "romans chapter 8", "genesis", "no name 3:16", "acts verse 2"]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(G.looks_complete(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, True]


def test_names_table_and_walk(spark):
    assert {(r.phrase, r.book_number) for r in G.name_table(spark).collect()} >= {("1cor", 46), ("first john", 62), ("genesis", 1)}
    c = spark.createDataFrame([(1, i, x) for i, x in enumerate(["previous", "next", "next", "next", "stay", "previous"])], "k int, n int, command string")
    assert [r.position for r in V.walk_positions(c, "k", "n", 3).orderBy("n").collect()] == [0, 1, 2, 2, 2, 1]


def test_hits_move_to_the_active_edition(spark):
    p = spark.createDataFrame([(1, 1, "de", "s"), (2, 1, "en", "s"), (3, 1, "en", "s"), (4, 2, "de", "s")], "doc_id long, paragraph long, lang string, source string")
    hits = spark.createDataFrame([(9, 1, 1), (9, 4, 2)], "query_id long, doc_id long, paragraph long")
    assert [(r.doc_id, r.shown_doc_id) for r in E.in_edition(hits, p, F.col("lang") == "en", ["source", "paragraph"]).collect()] == [(1, 2)]


def test_statistics_of_a_table(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("counted")
    try:
        K.analyze(spark, "counted")
        assert "3 rows" in spark.sql("describe extended counted").filter("col_name = 'Statistics'").first().data_type
    finally:
        spark.sql("drop table counted")
