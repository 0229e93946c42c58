"""Queries over plans, hymns and helpers, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit.operators import service as V
from passagekit.runtime import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


@query("bounded_history", "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 12")
def bounded_history(spark, sf):
    return V.bounded_history(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 12)


@query("group_labels", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey) || ' of ' || count(*) over (partition by l_orderkey, l_returnflag) as part_label from lineitem")
def group_labels(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("_o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return V.group_labels(rows, "l_orderkey", "l_returnflag", "_o").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "part_label")


@query("utterances", """with p as (select *, turn % 3 = 2 as f from conversations), u as (select *, coalesce(sum(f::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as n from p)
  select conv_id, cast(n as bigint) as utterance_no, md5(string_agg(text, ' ' order by turn)) as text_md5, max(turn) as last from u group by conv_id, n""")
def utterances(spark, sf):
    parts = table(spark, sf, "conversations").withColumn("speech_final", F.col("turn") % 3 == 2)
    return V.utterances(parts, "conv_id", "turn").select("conv_id", "utterance_no", F.md5("text").alias("text_md5"), "last")


@query("section_kinds", """select p_partkey, case when regexp_matches(lower(p_name), 'refrain|chorus') then 'refrain' when contains(lower(p_name), 'bridge') then 'bridge' when regexp_matches(lower(p_name), 'intro|opening') then 'intro' when regexp_matches(lower(p_name), 'ending|outro|coda') then 'ending' else 'verse' end as kind from part""")
def section_kinds(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.section_kind(F.col("p_name")).alias("kind"))


@query("highlighted_words", """select conv_id, turn, cast(len(list_filter(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w != ''), lambda w: list_contains(['the', 'and', 'of'], regexp_replace(lower(w), '[^a-z'']', '', 'g')))) as bigint) as n_hits from conversations""")
def highlighted_words(spark, sf):
    hits = F.filter(V.highlight(F.col("text"), F.lit("The and of a")), lambda w: w["hit"])
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(hits).cast("bigint").alias("n_hits"))


@query("service_context", """with i as (select l_orderkey, l_partkey * 100 + l_linenumber as ord, l_shipdate, l_returnflag, l_linestatus, l_suppkey from lineitem), a as (select l_orderkey, min(case when l_linestatus = 'O' then ord end) as act from i group by all)
  select l_orderkey, min(act) as active_ord, min(case when ord > act and l_returnflag != 'R' then ord end) as next_ord, count(*) filter (l_returnflag = 'A') as n_expected from i join a using (l_orderkey) group by all""")
def service_context(spark, sf):
    ord_ = F.col("l_partkey") * 100 + F.col("l_linenumber")
    status = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "R", "active_done").otherwise("active")).when(F.col("l_returnflag") == "R", "completed").otherwise("pending")
    items = table(spark, sf, "lineitem").select("l_orderkey", ord_.alias("ord"), status.alias("status"), "l_returnflag", "l_linestatus")
    at = items.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_linestatus") == "O", F.col("ord"))).alias("act"))
    joined = items.join(at, "l_orderkey")
    return joined.groupBy("l_orderkey").agg(F.min("act").alias("active_ord"), F.min(F.when((F.col("ord") > F.col("act")) & (F.col("l_returnflag") != "R"), F.col("ord"))).alias("next_ord"), F.count_if(F.col("l_returnflag") == "A").alias("n_expected"))


@query("slide_deck", """select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as slide_no, count(*) over (partition by p_brand) as n_slides, 'Slide ' || row_number() over (partition by p_brand order by p_partkey) as label from part where p_size > 10""")
def slide_deck(spark, sf):
    slides = table(spark, sf, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 10, F.col("p_name")).alias("title"), F.lit("").alias("body"), F.lit(" ").alias("label"))
    return V.slide_deck(slides, "p_brand", "p_partkey").select("p_brand", "p_partkey", F.col("slide_no").cast("bigint").alias("slide_no"), "n_slides", "label")


@query("expected_books", "select distinct o_orderkey, n_nationkey as book_number from orders join nation on lower(n_name) = 'nation_' || (o_custkey % 30)")
def expected_books(spark, sf):
    books = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("abbreviation"), F.col("n_nationkey").alias("book_number"))
    n = F.col("o_custkey") % 30
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("n"), n.cast("string"))).otherwise(F.concat(F.lit(" Nation_"), n.cast("string")))
    return V.expected_books(table(spark, sf, "orders").select("o_orderkey", said.alias("book")), books).select("o_orderkey", "book_number")
