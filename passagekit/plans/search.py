"""Full-text and vector queries over the driver's tables, each with the same statement in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagekit.functions import text as X
from passagekit.operators import corpus as C
from passagekit.operators import retrieval as R
from passagekit.operators import vectors as V
from passagekit.operators.references import fuzzy_names
from passagekit.plans.corpus import PASSAGES
from passagekit.runtime import table

QUERIES, SQL = {}, {}
K = 5
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t != '')"
# Queries: the first line of every benchmark passage.
_BATCH = "batch as (select item_id as query_id, string_split(text, chr(10))[1] as query from benchmark)"
_POSTS = f"""posts as (select doc_id, paragraph, unnest(toks) as term, generate_subscripts(toks, 1) - 1 as pos from (select doc_id, paragraph, {_TOK.format("text")} as toks from passages)),
  sizes as (select doc_id, paragraph, len({_TOK.format("text")}) as n_terms from passages),
  stats as (select count(*) as n_docs, avg(n_terms) as avg_len from sizes),
  freq as (select term, count(distinct (doc_id, paragraph)) as df, count(*) as cf from posts group by term)"""
_IDF = "greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6)"
_BM = f"{_IDF} * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_terms / avg_len))"
_CLEAN = r"list_filter(list_transform(regexp_split_to_array(trim(query), '\s+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}'']', '', 'g')), lambda w: w != '')"


def _terms(least: int, most: int) -> str:
    return f"list_filter({_CLEAN}, lambda w: strlen(w) >= {least} and not list_contains([{_STOP}], lower(w)))[1:{most}]"


def _flat(least: int, most: int) -> str:
    return _TOK.format(f"array_to_string({_terms(least, most)}, ' ')")


_PHRASE = f"""ph as (select query_id, {_TOK.format("query")} as words from batch),
  pw as (select query_id, len(words) as n, unnest(words) as term, generate_subscripts(words, 1) - 1 as pat from ph),
  pf as (select query_id, doc_id, paragraph, count(*) as f from (select query_id, n, doc_id, paragraph, pos - pat as start from pw join posts using (term) group by all having count(*) = n) group by all),
  pn as (select query_id, count(*) as df from pf group by all),
  t1 as (select query_id, doc_id, paragraph, round({_BM}, 6) as score from pf join pn using (query_id) join sizes using (doc_id, paragraph), stats)"""


def _tier(name: str, least: int, most: int, every: bool, among: str) -> str:
    have = f"join (select query_id, doc_id, paragraph from (select query_id, doc_id, paragraph, count(*) as n from {name}h group by all) join (select query_id, count(*) as n from {name}w group by all) using (query_id, n)) using (query_id, doc_id, paragraph)" if every else ""
    return f"""{name}w as (select distinct query_id, unnest({_flat(least, most)}) as term from batch {among}),
  {name}h as (select query_id, term, doc_id, paragraph, count(*) as f from {name}w join posts using (term) group by all),
  {name} as (select query_id, doc_id, paragraph, round(sum({_BM}), 6) as score from {name}h {have} join freq using (term) join sizes using (doc_id, paragraph), stats group by all)"""


def _top(name: str, k: int) -> str:
    return f"(select *, row_number() over (partition by query_id order by score desc, doc_id, paragraph) as rank from {name} qualify rank <= {k})"


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _p(spark, sf):
    return C.passages(table(spark, sf, "documents"))


def _batch(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", "\n")[0].alias("query"))


@query("corpus_postings", f"with {PASSAGES}, {_POSTS} select term, count(*) as n_postings, min(pos) as first_pos, max(pos) as last_pos from posts group by term")
def corpus_postings(spark, sf):
    return R.postings(_p(spark, sf)).groupBy("term").agg(F.count("*").alias("n_postings"), F.min("pos").cast("bigint").alias("first_pos"), F.max("pos").cast("bigint").alias("last_pos"))


@query("doc_lengths", f"with {PASSAGES}, {_POSTS} select * from sizes")
def doc_lengths(spark, sf):
    return R.lengths(_p(spark, sf))


@query("term_df", f"with {PASSAGES}, {_POSTS} select term, df, cf from freq")
def term_df(spark, sf):
    return R.document_frequency(R.postings(_p(spark, sf)))


@query("query_forms", f"""with {_BATCH} select query_id, array_to_string({_terms(2, 12)}, ' ') as and_query, array_to_string({_terms(3, 10)}, ' OR ') as or_query,
  '"' || trim(regexp_replace(query, '[^\\p{{L}}\\p{{N}}\\s'']', '', 'g')) || '"' as phrase_query from batch""")
def query_forms(spark, sf):
    q = F.col("query")
    return _batch(spark, sf).select("query_id", F.array_join(X.and_terms(q), " ").alias("and_query"), F.array_join(X.or_terms(q), " OR ").alias("or_query"), X.phrase_query(q).alias("phrase_query"))


def _parts(spark, sf):
    forms = R.batch_words(_batch(spark, sf))
    return R.batch_index(_p(spark, sf), forms), forms


@query("fts_phrase", f"with {PASSAGES}, {_POSTS}, {_BATCH}, {_PHRASE} select query_id, doc_id, paragraph, score, rank from {_top('t1', K)}")
def fts_phrase(spark, sf):
    i, (phrase, _, _) = _parts(spark, sf)
    return R.top(R.scored_phrases(R.phrase_hits(phrase, i), i.sizes, i.stats), K)


@query("fts_and", f"with {PASSAGES}, {_POSTS}, {_BATCH}, {_tier('t2', 2, 12, True, '')} select query_id, doc_id, paragraph, score, rank from {_top('t2', K)}")
def fts_and(spark, sf):
    i, (_, every, _) = _parts(spark, sf)
    return R.top(R.scored_terms(R.term_hits(every, i, True), i.frequency, i.sizes, i.stats), K)


@query("fts_or", f"with {PASSAGES}, {_POSTS}, {_BATCH}, {_tier('t3', 3, 10, False, '')} select query_id, doc_id, paragraph, score, rank from {_top('t3', K)}")
def fts_or(spark, sf):
    i, (_, _, some) = _parts(spark, sf)
    return R.top(R.scored_terms(R.term_hits(some, i, False), i.frequency, i.sizes, i.stats), K)


_LACK = "where query_id not in (select query_id from (select distinct query_id, doc_id, paragraph from {}) group by all having count(*) >= " + str(K) + ")"
_CASCADE = f"""f1 as (select *, 1 as tier from {_top('t1', 4 * K)}),
  {_tier('t2', 2, 12, True, _LACK.format('f1'))}, f2 as (select * from f1 union all by name select *, 2 as tier from {_top('t2', 4 * K)}),
  {_tier('t3', 3, 10, False, _LACK.format('f2'))}, f3 as (select * from f2 union all by name select *, 3 as tier from {_top('t3', 4 * K)}),
  once as (select * from f3 qualify row_number() over (partition by query_id, doc_id, paragraph order by tier) = 1),
  cascade as (select query_id, row_number() over (partition by query_id order by tier, score desc, doc_id, paragraph) as rank, cast(tier as bigint) as tier, doc_id, paragraph, score from once qualify rank <= {K})"""


@query("fts_tiered_bm25", f"with {PASSAGES}, {_POSTS}, {_BATCH}, {_PHRASE}, {_CASCADE} select * from cascade")
def fts_tiered_bm25(spark, sf):
    return R.tiered_search(_p(spark, sf), _batch(spark, sf), K)


@query("fts_single_edition", f"with {PASSAGES} select doc_id, paragraph, text from passages where lang = 'en' and list_has_all({_TOK.format('text')}, ['the', 'and']) order by doc_id, paragraph limit 50")
def fts_single_edition(spark, sf):
    have = X.tokens(F.col("text"))
    return _p(spark, sf).filter((F.col("lang") == "en") & F.array_contains(have, "the") & F.array_contains(have, "and")).select("doc_id", "paragraph", "text").orderBy("doc_id", "paragraph").limit(50)




@query(
    "paragraph_keyword_search",
    f"""with {PASSAGES}, {_POSTS}, {_BATCH}, kw as (select distinct query_id, unnest(({_TOK.format('query')})[1:3]) as term from batch),
    kh as (select query_id, term, doc_id, paragraph, count(*) as f from kw join posts using (term) group by all),
    full_ as (select query_id, doc_id, paragraph from (select query_id, doc_id, paragraph, count(*) as n from kh group by all) join (select query_id, count(*) as n from kw group by all) using (query_id, n)),
    k as (select query_id, doc_id, paragraph, round(sum({_BM}), 6) as score from kh join full_ using (query_id, doc_id, paragraph) join freq using (term) join sizes using (doc_id, paragraph), stats group by all)
    select query_id, doc_id, paragraph, score, rank from {_top('k', K)}""",
)
def paragraph_keyword_search(spark, sf):
    i, (phrase, _, _) = _parts(spark, sf)
    words = phrase.select("query_id", F.slice("words", 1, 3).alias("words"))
    return R.top(R.scored_terms(R.term_hits(words, i, True), i.frequency, i.sizes, i.stats), K)


@query(
    "quotation_lookup",
    f"""with {PASSAGES}, {_POSTS}, {_BATCH}, {_PHRASE}, w as (select query_id, list_distinct(list_filter({_TOK.format('query')}, lambda t: strlen(t) >= 2)) as qs from batch)
    select query_id, doc_id, paragraph, f, round(case when len(qs) = 0 then 0.0 else len(list_intersect(qs, list_filter({_TOK.format('text')}, lambda t: strlen(t) >= 2))) / len(qs) end, 6) as overlap
    from pf join passages using (doc_id, paragraph) join w using (query_id)""",
)
def quotation_lookup(spark, sf):
    p, q = _p(spark, sf), _batch(spark, sf)
    phrase = R.batch_words(q)[:1]
    hits = R.phrase_hits(phrase[0], R.batch_index(p, phrase)).join(p, R.KEY).join(F.broadcast(q), "query_id")
    return hits.select("query_id", *R.KEY, "f", F.round(X.overlap(X.word_set(F.col("query")), X.word_set(F.col("text"))), 6).alias("overlap"))


_CAT = """(case when cast(p_partkey as varchar) = '{q}' then 100 else 0 end + case when starts_with(cast(p_partkey as varchar), '{q}') then 40 else 0 end + case when lower(p_name) = '{q}' then 80 else 0 end
  + case when starts_with(lower(p_name), '{q}') then 50 else 0 end + case when contains(lower(p_name), '{q}') then 30 else 0 end + case when contains(lower(p_type), '{q}') then 20 else 0 end)"""


@query("catalogue_scored_search", f"select p_partkey, p_name, cast({_CAT.format(q='1')} as bigint) as score from part where {_CAT.format(q='1')} > 0 order by score desc, p_partkey limit 20")
def catalogue_scored_search(spark, sf):
    scored = table(spark, sf, "part").select("p_partkey", "p_name", R.catalogue_score("1", F.col("p_partkey"), F.col("p_name"), F.col("p_type")).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "p_partkey").limit(20)


@query(
    "autocomplete_stage",
    """select o_orderkey, q, case when n_name is null then 'none' when q = left(lower(n_name), len(q)) and q not like '% %' then 'group' when regexp_matches(q, '^\\S+ \\d+$') then 'chapter' else 'member' end as stage, n_name
    from (select o_orderkey, case o_orderkey % 3 when 0 then left(lower(n1.n_name), 2) when 1 then lower(n1.n_name) || ' 3' else lower(n1.n_name) || ' 3:1' end as q from orders join nation n1 on o_custkey % 25 = n1.n_nationkey) s
    left join (select min_by(n_name, n_nationkey) as n_name, p from (select n_name, n_nationkey, unnest(list_distinct([left(lower(n_name), 2), lower(n_name)])) as p from nation) group by p) n on n.p = string_split(q, ' ')[1]""",
)
def autocomplete_stage(spark, sf):
    nation = table(spark, sf, "nation")
    name = F.lower("n_name")
    typed = F.when(F.col("o_orderkey") % 3 == 0, F.left(name, F.lit(2))).when(F.col("o_orderkey") % 3 == 1, F.concat(name, F.lit(" 3"))).otherwise(F.concat(name, F.lit(" 3:1")))
    orders = table(spark, sf, "orders").withColumn("n_nationkey", (F.col("o_custkey") % 25).cast("int")).join(F.broadcast(nation), "n_nationkey").select("o_orderkey", typed.alias("q"))
    prefixes = nation.select("n_name", "n_nationkey", F.explode(F.array_distinct(F.array(F.left(name, F.lit(2)), name))).alias("p")).groupBy("p").agg(F.min_by("n_name", "n_nationkey").alias("n_name"))
    joined = orders.join(F.broadcast(prefixes), F.split("q", " ")[0] == F.col("p"), "left")
    stage = F.when(F.col("n_name").isNull(), "none").when(F.lower("n_name").startswith(F.col("q")) & ~F.contains("q", F.lit(" ")), "group").when(F.col("q").rlike(r"^\S+ \d+$"), "chapter").otherwise("member")
    return joined.select("o_orderkey", "q", stage.alias("stage"), "n_name")


_VEC = "v as (select vec_id, cast(embedding as double[]) as e from embeddings)"
_ROWS = "round(list_inner_product(v.e, q.e), 6)"


def _queries(spark, sf, every: int):
    return table(spark, sf, "embeddings").filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _topk_sql(where: str, k: int, least: str = "") -> str:
    return f"with {_VEC} select query_id, rank, vec_id, similarity from (select q.vec_id as query_id, v.vec_id, {_ROWS} as similarity, row_number() over (partition by q.vec_id order by {_ROWS} desc, v.vec_id) as rank from v, (select * from v where {where}) q {least}) where rank <= {k}"


@query("vector_topk", _topk_sql("vec_id = 0", 10))
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return V.exact_topk(e, e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


@query("vector_topk_batch", _topk_sql("vec_id % 25 = 0", 5))
def vector_topk_batch(spark, sf):
    return V.exact_topk(table(spark, sf, "embeddings").select("vec_id", "embedding"), _queries(spark, sf, 25), 5)


@query("vector_threshold", _topk_sql("vec_id % 25 = 0", 8, f"where {_ROWS} >= 0.3"))
def vector_threshold(spark, sf):
    return V.exact_topk(table(spark, sf, "embeddings").select("vec_id", "embedding"), _queries(spark, sf, 25), 8, least=0.3)


_STRATEGIES = f"""{_VEC}, s as (select q.vec_id // 4 * 4 as query_id, case q.vec_id % 4 when 0 then 'original' when 1 then 'synonym1' when 2 then 'synonym2' else 'concept' end as strategy, v.vec_id, {_ROWS} as similarity
  from v, v q where q.vec_id % 40 < 4 qualify row_number() over (partition by q.vec_id order by {_ROWS} desc, v.vec_id) <= 12)"""


def _strategies(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    hits = V.exact_topk(e, e.filter("vec_id % 40 < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 12)
    n = F.col("query_id") % 4
    return hits.select((F.col("query_id") - n).alias("query_id"), F.when(n == 0, "original").when(n == 1, "synonym1").when(n == 2, "synonym2").otherwise("concept").alias("strategy"), "vec_id", "similarity")


@query(
    "ensemble_fusion",
    f"""with {_STRATEGIES}, g as (select query_id, vec_id, round(sum(similarity * case strategy when 'original' then 0.7 else 0.1 end), 6) as score, max(similarity) as best_similarity, count(distinct strategy) as n_sources from s group by all)
    select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score, best_similarity, n_sources from g where score >= 0.1 qualify rank <= 12""",
)
def ensemble_fusion(spark, sf):
    return V.ensemble(_strategies(spark, sf), {"original": 0.7, "synonym1": 0.1, "synonym2": 0.1, "concept": 0.1}, least=0.1)


@query("rank_decay_confidence", f"with {PASSAGES}, {_POSTS}, {_BATCH}, {_tier('t3', 3, 10, False, '')} select query_id, doc_id, paragraph, cast(round(0.75 - 0.04 * (rank - 1), 6) as double) as confidence from {_top('t3', 12)} where round(0.75 - 0.04 * (rank - 1), 6) >= 0.42")
def rank_decay_confidence(spark, sf):
    i, (_, _, some) = _parts(spark, sf)
    found = R.top(R.scored_terms(R.term_hits(some, i, False), i.frequency, i.sizes, i.stats), 12)
    return found.select("query_id", *R.KEY, R.rank_confidence(F.col("rank") - 1).alias("confidence")).filter("confidence is not null")


# Vector hits stand for the first passage of the document of their number; text hits are those of the cascade.
_HYB = f"""{PASSAGES}, {_POSTS}, {_BATCH}, {_PHRASE}, {_CASCADE}, {_VEC}, firsts as (select doc_id, min(paragraph) as paragraph from passages group by doc_id),
  vh as (select query_id, doc_id, paragraph, similarity from ({_topk_sql('vec_id in (select item_id from benchmark)', 10).replace('with ' + _VEC, '')}) h join firsts on doc_id = vec_id),
  th as (select query_id, doc_id, paragraph, round(0.75 - 0.04 * (rank - 1), 6) as confidence from cascade)"""


def _hybrid(spark, sf):
    """(vector hits as passages, text hits of the cascade), each (query_id, doc_id, paragraph, a score)."""
    passages, batch = _p(spark, sf), _batch(spark, sf)
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.join(batch, vectors["vec_id"] == batch["query_id"], "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = V.to_passages(V.exact_topk(vectors, asked, 10), passages)
    text = R.tiered_search(passages, batch, K).select("query_id", *R.KEY, R.rank_confidence(F.col("rank") - 1).alias("confidence"))
    return hits, text.filter("confidence is not null")


@query(
    "hybrid_search",
    f"""with {_HYB} select query_id, doc_id, paragraph, similarity, 'vector' as source from vh union all
    select query_id, doc_id, paragraph, confidence, 'text' from th where not exists (select 1 from vh where vh.query_id = th.query_id and vh.doc_id = th.doc_id and vh.paragraph = th.paragraph)""",
)
def hybrid_search(spark, sf):
    hits, text = _hybrid(spark, sf)
    extra = text.join(hits, ["query_id", *R.KEY], "left_anti").select("query_id", *R.KEY, F.col("confidence").alias("similarity"), F.lit("text").alias("source"))
    return hits.select("query_id", *R.KEY, "similarity", F.lit("vector").alias("source")).unionByName(extra)


@query(
    "overlap_boost",
    f"""with {_HYB}, vv as (select query_id, doc_id, paragraph, similarity as confidence from vh)
    select query_id, doc_id, paragraph, round(case when vv.confidence is not null and th.confidence is not null then least(vv.confidence + 0.1, 1.0) else coalesce(vv.confidence, th.confidence) end, 6) as confidence,
    case when vv.confidence is not null and th.confidence is not null then 'both' when vv.confidence is not null then 'vector' else 'text' end as source from vv full join th using (query_id, doc_id, paragraph)""",
)
def overlap_boost(spark, sf):
    hits, text = _hybrid(spark, sf)
    return V.overlap_boost(hits.select("query_id", *R.KEY, F.col("similarity").alias("confidence")), text, ["query_id", *R.KEY])


@query(
    "hits_in_edition",
    f"""with {_HYB}, places as (select h.*, p.source from vh h join passages p using (doc_id, paragraph))
    select h.query_id, h.doc_id, e.doc_id as shown_doc_id, h.paragraph, h.similarity from places h join (select source, paragraph, min(doc_id) as doc_id from passages where lang = 'en' group by all) e using (source, paragraph)""",
)
def hits_in_edition(spark, sf):
    passages = _p(spark, sf)
    hits, _ = _hybrid(spark, sf)
    return V.in_edition(hits, passages, F.col("lang") == "en", ["source", "paragraph"]).select("query_id", "doc_id", "shown_doc_id", "paragraph", "similarity")


@query("merged_similar_scores", f"with {_STRATEGIES}, d as (select *, lag(similarity) over (partition by query_id, strategy order by similarity desc, vec_id) as above from s) select query_id, strategy, vec_id, similarity, sum(case when above is null or above - similarity >= 0.02 then 1 else 0 end) over (partition by query_id, strategy order by similarity desc, vec_id) as band from d")
def merged_similar_scores(spark, sf):
    return V.score_bands(_strategies(spark, sf), ["query_id", "strategy"], "similarity", "vec_id", 0.02)


@query("merge_keep_max", f"with {_STRATEGIES} select vec_id, max(similarity) as similarity from s group by vec_id order by similarity desc, vec_id limit 15")
def merge_keep_max(spark, sf):
    return R.keep_best(_strategies(spark, sf).select("vec_id", "similarity", "strategy"), ["vec_id"], "similarity", "strategy", 15).select("vec_id", "similarity")


@query("sentence_windows", r"""with s as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda s: trim(s, ' ')), lambda s: s != '') as s from conversations),
  r as (select conv_id, turn, list_distinct_in_order from (select conv_id, turn, list_filter(flatten(list_transform(range(1, len(s) + 1), lambda i: [s[i], case when i < len(s) then s[i] || '. ' || s[i + 1] end])), lambda w: w is not null and len(regexp_split_to_array(trim(w), '\s+')) >= 5) as list_distinct_in_order from s)),
  u as (select conv_id, turn, unnest(list_distinct_in_order) as window_text, generate_subscripts(list_distinct_in_order, 1) as p from r), f as (select conv_id, turn, window_text, min(p) as p from u group by all)
  select conv_id, turn, cast(row_number() over (partition by conv_id, turn order by p) - 1 as int) as window_no, window_text from f""")
def sentence_windows(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.sentence_windows(F.col("text"))).alias("window_no", "window_text"))


@query(
    "sentence_counts",
    r"select conv_id, turn, cast(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda s: trim(s, ' ')), lambda s: s != '')) as bigint) as n_sentences from conversations",
)
def sentence_counts(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(X.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


@query("term_accuracy", f"""select item_id, round(len(list_filter(({_TOK.format('text')})[1:6], lambda t: contains(lower(string_split(text, chr(10))[1]), t))) / len(({_TOK.format('text')})[1:6]), 6) as accuracy from benchmark""")
def term_accuracy(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.round(X.term_accuracy(F.split("text", "\n")[0], F.slice(X.tokens(F.col("text")), 1, 6)), 6).alias("accuracy"))


def _distinct_words(rows, key):
    """(key, word, n): the distinct words of each row, and how many it has."""
    return rows.select(key, X.word_set(F.col("text")).alias("ws")).select(key, F.size("ws").alias("n"), F.explode("ws").alias("word"))


def _word_rows(name, key, rows):
    """The same as a common table expression."""
    return f"{name} as (select {key}, len(ws) as n, unnest(ws) as word from (select {key}, list_distinct(list_filter({_TOK.format('text')}, lambda t: strlen(t) >= 2)) as ws from {rows}))"


@query("word_overlap", f"""with {_word_rows('w', 'doc_id', 'documents')}, {_word_rows('b', 'item_id', 'benchmark')}
  select item_id, doc_id, round(count(*) / any_value(b.n), 6) as overlap from b join w on b.word = w.word group by item_id, doc_id""")
def word_overlap(spark, sf):
    """Every document and benchmark item with a common word: the share of the item's words that the document has."""
    docs = _distinct_words(table(spark, sf, "documents"), "doc_id").drop("n")
    met = docs.join(_distinct_words(table(spark, sf, "benchmark"), "item_id"), "word")
    return met.groupBy("item_id", "doc_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("overlap"))


@query("jaccard_similarity", f"""with {_word_rows('w', 'item_id', 'benchmark')}
  select a.item_id as a, b.item_id as b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) as jaccard from w a join w b on a.word = b.word and a.item_id < b.item_id group by a.item_id, b.item_id""")
def jaccard_similarity(spark, sf):
    """Every two benchmark items with a common word."""
    words = _distinct_words(table(spark, sf, "benchmark"), "item_id")
    met = words.toDF("a", "n", "word").join(words.toDF("b", "m", "word"), "word").filter("a < b")
    return met.groupBy("a", "b").agg(F.round(F.count("*") / (F.first("n") + F.first("m") - F.count("*")), 6).alias("jaccard"))


@query("label_quality", "select l.quality, count(*) as n_docs, count(*) filter (contains(text, '***')) as n_noisy from documents d join labels l on d.doc_id = l.doc_id group by all")
def label_quality(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return joined.groupBy("quality").agg(F.count("*").alias("n_docs"), F.count_if(F.contains("text", F.lit("***"))).alias("n_noisy"))


@query("fuzzy_name_match", """with w as (select p_partkey, substr(unnest(string_split(p_name, ' ')), 2) as word from part), d as (select distinct unnest(string_split(p_name, ' ')) as name from part)
  select p_partkey, name, word, levenshtein(lower(word), lower(name)) as distance from w, d
  where abs(len(word) - len(name)) <= 3 and levenshtein(lower(word), lower(name)) between 1 and case when len(name) <= 4 then 1 when len(name) <= 8 then 2 else 3 end""")
def fuzzy_name_match(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("name"))
    words = part.select("p_partkey", F.substr("name", F.lit(2)).alias("word"))
    return fuzzy_names(words, part.select("name").distinct(), "word", "name").select("p_partkey", "name", "word", F.col("distance").cast("bigint").alias("distance"))


@query("detection_merge", """with d as (select user_id, event_type, event_id, round(least(abs(value) / 100, 1.0), 6) as confidence, event_id % 3 = 0 as is_direct from events),
  k as (select *, row_number() over (partition by user_id, event_type order by is_direct desc, confidence desc, event_id) as r from d), m as (select * from k where r = 1 and confidence >= 0.45)
  select user_id, event_type, event_id, confidence, is_direct, row_number() over (partition by user_id order by confidence desc, event_id) as place,
  row_number() over (partition by user_id order by confidence desc, event_id) = 1 and confidence >= 0.8 as auto_queued from m""")
def detection_merge(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.round(F.least(F.abs("value") / 100, F.lit(1.0)), 6).alias("confidence"), (F.col("event_id") % 3 == 0).alias("is_direct"))
    return V.merge_detections(d.withColumn("ord", F.col("event_id")), ["user_id"], ["event_type"]).drop("ord")


@query("detection_finalize", """with d as (select user_id, event_type, round(least(abs(value) / 100, 1.0), 6) as c from events), g as (select user_id, event_type, max(c) as m, count(*) as n_seen from d group by all),
  f as (select user_id, event_type, n_seen, round(case when n_seen > 1 then greatest(m, least(m + 0.1, 0.98)) else m end, 6) as confidence from g)
  select *, row_number() over (partition by user_id order by confidence desc, event_type) as place from f qualify place <= 3""")
def detection_finalize(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_type", F.round(F.least(F.abs("value") / 100, F.lit(1.0)), 6).alias("confidence"))
    return V.finalize_live(d, ["user_id"], ["event_type"])


@query("detection_coalesce", """select user_id, max(value) as value, bool_or(event_type = 'click') as any_click, bool_and(event_type = 'click') as all_click, min(event_type) as first_type, count(*) as n_seen from events group by user_id""")
def detection_coalesce(spark, sf):
    click = F.col("event_type") == "click"
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("value"), F.bool_or(click).alias("any_click"), F.bool_and(click).alias("all_click"), F.min("event_type").alias("first_type"), F.count("*").alias("n_seen"))


