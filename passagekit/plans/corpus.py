"""Corpus queries over the driver's tables, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit.operators import corpus as C
from passagekit.operators.references import MAX_CHAPTER, is_valid
from passagekit.runtime import table

PASSAGES = """passages as (select doc_id, cast(paragraph as bigint) as paragraph, text, lang, source from (
  select doc_id, lang, source, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as paragraph from documents)
  where trim(text, ' ') != '')"""


def _p(spark, sf):
    return C.passages(table(spark, sf, "documents"))


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("passage_by_id", "select doc_id, n_chars, lang, source from documents where doc_id = 7")
def passage_by_id(spark, sf):
    return table(spark, sf, "documents").filter("doc_id = 7").select("doc_id", "n_chars", "lang", "source")


@query("passage_by_key", f"with {PASSAGES} select * from passages where doc_id = 7 and paragraph = 1")
def passage_by_key(spark, sf):
    return C.by_key(_p(spark, sf), 7, 1)


@query("passage_range", f"with {PASSAGES} select * from passages where doc_id = 12 and paragraph between 2 and 4")
def passage_range(spark, sf):
    return C.between(_p(spark, sf), 12, 2, 4)


@query("chapter_passages", f"with {PASSAGES} select * from passages where doc_id = 12")
def chapter_passages(spark, sf):
    return C.chapter(_p(spark, sf), 12)


@query("edition_passages", f"with {PASSAGES} select * from passages where lang = 'de'")
def edition_passages(spark, sf):
    return C.edition(_p(spark, sf), "de")


@query("list_groups", "select distinct lang, source from documents")
def list_groups(spark, sf):
    return table(spark, sf, "documents").select("lang", "source").distinct()


@query("group_prefix_search", "select p_partkey, p_name, p_brand from part where p_name ilike 'b%' or p_brand ilike 'b%' ")
def group_prefix_search(spark, sf):
    return C.prefix_search(table(spark, sf, "part"), ["p_name", "p_brand"], "b").select("p_partkey", "p_name", "p_brand")


@query("chapter_counts", f"with {PASSAGES} select source, doc_id, count(*) as n_passages from passages group by all")
def chapter_counts(spark, sf):
    return C.chapter_counts(_p(spark, sf))


@query("corpus_counts", f"with {PASSAGES} select (select count(*) from documents) as n_documents, count(*) as n_passages, count(distinct lang) as n_editions from passages")
def corpus_counts(spark, sf):
    docs = table(spark, sf, "documents").agg(F.count("*").alias("n_documents"))
    return docs.crossJoin(_p(spark, sf).agg(F.count("*").alias("n_passages"), F.count_distinct("lang").alias("n_editions")))


@query(
    "crossrefs_formatted",
    """select l_orderkey, l_linenumber, concat_ws(':', l_orderkey, l_suppkey, l_partkey) ||
       case when l_linenumber > 1 then '-' || (l_partkey + l_linenumber - 1) else '' end as reference, cast(l_quantity as bigint) as votes from lineitem""",
)
def crossrefs_formatted(spark, sf):
    edges = table(spark, sf, "lineitem")
    ref = C.reference_text(F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_partkey") + F.col("l_linenumber") - 1)
    return edges.select("l_orderkey", "l_linenumber", ref.alias("reference"), F.col("l_quantity").cast("bigint").alias("votes"))


@query(
    "crossrefs_top_votes",
    "select * from (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_suppkey, l_linenumber) as place from lineitem) where place <= 3",
)
def crossrefs_top_votes(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.row_number().over(w).cast("bigint").alias("place")).filter("place <= 3")


@query(
    "resolve_with_fallback",
    """select o.o_orderkey, coalesce(c.c_name, n.n_name, '') as text from orders o left join (select c_custkey, c_name from customer where c_acctbal > 0) c on o.o_custkey = c.c_custkey
       left join nation n on n.n_nationkey = o.o_orderkey % 40""",
)
def resolve_with_fallback(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 40).alias("key"))
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("by_id"))
    keyed = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("by_key"))
    return orders.join(known, "o_custkey", "left").join(keyed, "key", "left").select("o_orderkey", F.coalesce("by_id", "by_key", F.lit("")).alias("text"))


@query("anti_unmatched", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def anti_unmatched(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("semi_valid", "select o_orderkey, o_custkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def semi_valid(spark, sf):
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return table(spark, sf, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query(
    "release_gate",
    """select count(*) as n_rows, count(*) filter (r_regionkey is null) as n_unknown, count(*) filter (c_acctbal < 0) as n_forbidden,
       count(*) filter (r_regionkey is null) = 0 and count(*) filter (c_acctbal < 0) = 0 as ok
       from customer left join (select distinct n_nationkey, r_regionkey from nation join region on n_regionkey = r_regionkey where r_name != 'ASIA') on c_nationkey = n_nationkey""",
)
def release_gate(spark, sf):
    allowed = table(spark, sf, "nation").join(table(spark, sf, "region").filter("r_name != 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return C.release_gate(table(spark, sf, "customer"), allowed, "c_nationkey", F.col("c_acctbal") < 0)


@query("impossible_references", f"select l_orderkey, l_linenumber, l_partkey % 70 as book, l_suppkey as chapter from lineitem where not (l_partkey % 70 between 1 and 66 and l_suppkey between 1 and {MAX_CHAPTER}[l_partkey % 70])")
def impossible_references(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 70).alias("book"), F.col("l_suppkey").alias("chapter"))
    return rows.filter(~is_valid(F.col("book"), F.col("chapter")))


@query(
    "replace_by_key",
    "select o_orderkey, o_totalprice from orders where o_orderstatus != 'F' union all select o_orderkey, 0.0 from orders where o_orderstatus = 'F'",
)
def replace_by_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(0.0).alias("o_totalprice"))
    return C.replace_by_key(orders.select("o_orderkey", "o_totalprice"), new, ["o_orderkey"])


@query("surrogate_ids", "select doc_id, lang, row_number() over (order by lang, doc_id) as id from documents")
def surrogate_ids(spark, sf):
    return C.with_ids(table(spark, sf, "documents").select("doc_id", "lang"), [F.col("doc_id")], "lang").select("doc_id", "lang", "id")


@query("ordered_list_join", "select n_nationkey, n_name, pos from (select unnest([7, 3, 99, 3, 12]) as k, unnest([0, 1, 2, 3, 4]) as pos) join nation on k = n_nationkey")
def ordered_list_join(spark, sf):
    wanted = spark.createDataFrame([([7, 3, 99, 3, 12],)], "ids array<int>").select(F.posexplode("ids").alias("pos", "n_nationkey"))
    return wanted.join(table(spark, sf, "nation"), "n_nationkey").select("n_nationkey", "n_name", "pos").orderBy("pos")


@query("either_key_join", "select distinct o_orderkey, n_nationkey from orders join nation on o_custkey = n_nationkey or o_orderkey = n_nationkey")
def either_key_join(spark, sf):
    orders, nation = table(spark, sf, "orders"), F.broadcast(table(spark, sf, "nation"))
    sides = [orders.join(nation, F.col(k) == F.col("n_nationkey")).select("o_orderkey", "n_nationkey") for k in ("o_custkey", "o_orderkey")]
    return sides[0].union(sides[1]).distinct()


@query("json_export", "select doc_id as id, text, source || ':' || doc_id as ref from documents where lang = 'en'")
def json_export(spark, sf):
    return table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), "text", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("ref"))
