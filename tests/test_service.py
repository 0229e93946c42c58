from pyspark.sql import functions as F

from passagekit.operators import service as V


def test_hymn_sections(spark):
    rows = [("a", 0, "verse", "1"), ("a", 1, "refrain", "R"), ("a", 2, "verse", "2"), ("b", 0, "refrain", "only")]
    s = spark.createDataFrame(rows, "hymn string, ord int, kind string, label string")
    assert [tuple(r) for r in V.repeat_refrains(s, "hymn", "ord").orderBy("hymn", "place").collect()] == [("a", 0, "1"), ("a", 1, "R"), ("a", 2, "2"), ("a", 3, "R")]
    assert sorted(r.label for r in V.drop_refrains(s, "hymn").collect()) == ["1", "2", "only"]


def test_walk_stays_in_bounds(spark):
    c = spark.createDataFrame([(1, i, x) for i, x in enumerate(["previous", "next", "next", "next", "next", "previous"])], "k int, n int, command string")
    assert V.walk(c, "k", "n", 3).first().position == 1


def test_removal_templates_terms_and_context(spark):
    d = spark.createDataFrame([("k1", "John 3:16"), ("k2", "Acts 1:1")], "key string, ref string")
    assert [r.key for r in d.filter(V.removal(F.col("key"), F.col("ref"), "john  3:16")).collect()] == ["k1"]
    t = spark.createDataFrame([(1, [("Hymn", None, 60), ("Talk", "sermon", None)])], "plan_id int, items array<struct<title:string,kind:string,duration:int>>")
    assert [tuple(r) for r in V.expand_template(t).orderBy("ord").collect()] == [(1, 0, "Hymn", "other", "pending", 60), (1, 1, "Talk", "sermon", "pending", 0)]
    terms = V.key_terms(["b", "a"], spark.createDataFrame([("a", 0), ("c", 1)], "term string, ord int"), 3)
    assert [r.term for r in terms.orderBy("place").collect()] == ["b", "a", "c"]
    items = spark.createDataFrame([(1, 0, "A", "completed", "x", None), (1, 1, "B", "active", "scripture", "h"), (1, 2, "C", "skipped", "x", "h"), (1, 3, "D", "pending", "x", "g")], "plan int, ord int, title string, status string, kind string, hymn string")
    r = V.service_context(items, "plan").first()
    assert (r.active_title, r.next_title, r.n_expected, r.hymns) == ("B", "D", 1, ["g", "h"])


def test_typing_helpers(spark):
    rows = [("Gen", "Genesis", "Genesis "), ("Genesis 3", "Genesis", "Genesis 3:"), ("Genesis 3:", "Genesis", "Genesis 3:"), ("Genesis 3:1", "Genesis", "Genesis 3:1")]
    df = spark.createDataFrame(rows, "typed string, name string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", V.tab_advance(F.col("typed"), F.col("name"))).collect())
    got = df.select(V.completion(F.col("typed"), F.col("name")).alias("c"), V.roman_name(F.lit("1 John")).alias("r")).collect()
    assert [r.c for r in got] == ["Genesis", "Genesis 3", "Genesis 3:", "Genesis 3:1"] and got[0].r == "I John"
