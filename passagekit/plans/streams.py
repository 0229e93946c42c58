"""Transcript, event, import and plan queries over the driver's tables, with the same statement in SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagekit.functions import text as X
from passagekit.operators import folds as W
from passagekit.operators import references as G
from passagekit.operators import vectors as V
from passagekit.runtime import table
from passagekit.sources import imports as I
from passagekit.streaming import drivers as D
from passagekit.streaming import transitions as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _turns(spark, sf):
    return table(spark, sf, "conversations")


# Imports and cleaning


@query("html_links", """select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) as label,
  cast(generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 as bigint) as link_no from pages""")
def html_links(spark, sf):
    return I.html_links(table(spark, sf, "pages"), "page_id", "html")


@query("html_paragraph_counts", r"""with b as (select page_id, regexp_replace(html, '(?is)<(script|style|table|nav)\b.*?</(script|style|table|nav)>', '', 'g') as body from pages),
  p as (select page_id, list_filter(list_transform(regexp_extract_all(body, '(?is)<(?:p|blockquote)\b[^>]*>(.*?)</(?:p|blockquote)>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x != '') as blocks,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(body, '(?i)<(br|/p|/div|/h\d)\b[^>]*>', chr(10) || chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x != '') as rendered from b)
  select page_id, cast(case when len(blocks) > 0 then len(blocks) else len(rendered) end as bigint) as n_paragraphs from p""")
def html_paragraph_counts(spark, sf):
    found = I.html_paragraphs(table(spark, sf, "pages"), "page_id", "html").groupBy("page_id").agg(F.count("*").alias("n_paragraphs"))
    return table(spark, sf, "pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n_paragraphs", F.lit(0)).cast("bigint").alias("n_paragraphs"))


@query("html_paragraphs")
def html_paragraphs(spark, sf):
    return I.html_paragraphs(table(spark, sf, "pages"), "page_id", "html")


@query("clean_text", r"""select conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe\b', '', 'g'), '(?i)\band\b', 'with', 'g'), '\s+', ' ', 'g')) as text from (select conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') as text from conversations)""")
def clean_text(spark, sf):
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    pairs = [("the", ""), ("and", "with")]
    return _turns(spark, sf).select("conv_id", "turn", X.collapse(X.replace_phrases(ascii_, pairs)).alias("text"))


@query("coerce_loose_types", """select event_id, case when k in ('true','1') then true when k in ('false','0') then false else try_cast(k as double) != 0 end as as_bool, case when try_cast(k as double) is not null then round(greatest(0.0, least(1.0, case when try_cast(k as double) > 1 then try_cast(k as double) / 100 else try_cast(k as double) end)), 6) end as as_share
  from (select event_id, json_extract_string(props, '$.k') as k from events)""")
def coerce_loose_types(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", X.loose_bool(k).alias("as_bool"), F.round(X.loose_share(k), 6).alias("as_share"))


# References


@query("parse_reference_roundtrip", "select l_orderkey, l_linenumber, 43 as book_number, cast(l_partkey % 21 + 1 as int) as chapter, cast(l_suppkey % 99 + 1 as int) as verse_start from lineitem")
def parse_reference_roundtrip(spark, sf):
    chapter, verse = (F.col("l_partkey") % 21 + 1).cast("string"), (F.col("l_suppkey") % 99 + 1).cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("Turn to John chapter "), chapter, F.lit(" and look at verse "), verse)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("we read in John "), chapter, F.lit(":"), verse)).otherwise(F.concat(F.lit("John "), chapter, F.lit(" "), verse))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", said.alias("text"))
    return G.detect_references(rows, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "book_number", "chapter", "verse_start")


_DICT = "select 'the' as phrase, 1 as id union all select 'of the', 2 union all select 'and of the', 3 union all select 'it', 4"


@query("dictionary_spans")
def dictionary_spans(spark, sf):
    dictionary = spark.sql(_DICT)
    return G.dictionary_spans(table(spark, sf, "documents"), F.broadcast(dictionary), ["doc_id"])


@query("commands_from_text", r"""with t as (select conv_id, turn, case turn % 4 when 0 then 'please show slide ' || (conv_id % 30) when 1 then 'next slide now' when 2 then 'read it in the niv' else text end as said from conversations)
  select conv_id, turn, case when regexp_extract(lower(said), '\b(?:go to |jump to )?slide (?:number )?(\d+)\b', 1) != '' then regexp_extract(lower(said), '\b(?:go to |jump to )?slide (?:number )?(\d+)\b', 1) when regexp_matches(lower(said), '\bnext slide\b') then 'next' when regexp_matches(lower(said), '\b(?:previous|last) slide\b|\bslide back\b') then 'previous' end as slide,
  case when turn % 4 = 2 then 'NIV' end as edition from t""")
def commands_from_text(spark, sf):
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("please show slide "), (F.col("conv_id") % 30).cast("string"))).when(F.col("turn") % 4 == 1, "next slide now").when(F.col("turn") % 4 == 2, "read it in the niv").otherwise(F.col("text"))
    t = _turns(spark, sf).select("conv_id", "turn", said.alias("said"))
    return t.select("conv_id", "turn", G.slide_command(F.col("said")).alias("slide"), F.when(F.col("turn") % 4 != 3, G.edition_command(F.col("said"))).alias("edition"))


@query("synonym_variants", """with syn as (select * from (values ('the', 'this', 1), ('the', 'that', 2), ('and', 'also', 1)) v(term, synonym, ord)), t as (select conv_id * 1000 + turn as id, string_split(text, ' ') as ws, text from conversations),
  w as (select id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from t), c as (select id, pos, word, lower(regexp_replace(word, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')) as term from w),
  f as (select id, min(pos) as pos from c where term in (select term from syn) group by id)
  select id, cast(0 as bigint) as variant_no, text as variant from t union all
  select f.id, row_number() over (partition by f.id order by ord), array_to_string(list_concat(ws[:f.pos - 1], [regexp_extract(ws[f.pos], '^([^\\p{L}\\p{N}]*)', 1) || synonym || regexp_extract(ws[f.pos], '([^\\p{L}\\p{N}]*)$', 1)], ws[f.pos + 1:]), ' ') from f join t using (id) join c on c.id = f.id and c.pos = f.pos join syn using (term)""")
def synonym_variants(spark, sf):
    syn = spark.createDataFrame([("the", "this", 1), ("the", "that", 2), ("and", "also", 1)], "term string, synonym string, ord int")
    return V.synonym_variants(_turns(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), F.broadcast(syn))


@query("concept_terms", """select conv_id, turn, array_to_string(list_filter(['that', 'on', 'it', 'heart'], lambda c: list_contains(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g')), c)), ' ') as concepts from conversations""")
def concept_terms(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(V.concept_terms(F.col("text"), ["that", "on", "it", "heart"]), " ").alias("concepts"))


#: What is said, and the book, chapter and verse that it means (0 for none).
_SAID = [
    ("Rom 8:28", 45, 8, 28), ("turn to Heb 11:1", 58, 11, 1), ("Rev 3:20", 66, 3, 20), ("we read in Dan 9:24", 27, 9, 24), ("Jn 3:16 says", 43, 3, 16), ("Mt 5:3", 40, 5, 3),
    ("Ps 23:1", 19, 23, 1), ("Phlm 1:6", 57, 1, 6), ("Song of Songs 2:1", 22, 2, 1), ("two timothy 3:16", 55, 3, 16), ("one john chapter 2 verse 3", 62, 2, 3),
    ("song chapter 23 verse 1", 19, 23, 1), ("1Cor 13:4", 46, 13, 4), ("III John 1:2", 64, 1, 2), ("Mark 30:1", 0, 0, 0), ("the weather today", 0, 0, 0),
]
_SAID_SQL = "select event_id, cast(b[event_id % 16 + 1] as int) as book_number, cast(c[event_id % 16 + 1] as int) as chapter, cast(v[event_id % 16 + 1] as int) as verse_start from events, (select {} as b, {} as c, {} as v) where b[event_id % 16 + 1] > 0".format(*([x[i] for x in _SAID] for i in (1, 2, 3)))


def _said(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_id").alias("ts"), F.get(F.array(*[F.lit(x[0]) for x in _SAID]), (F.col("event_id") % 16).cast("int")).alias("text"))


@query("detect_table", _SAID_SQL)
def detect_table(spark, sf):
    return G.detect_references(_said(spark, sf), ["event_id"]).select("event_id", "book_number", "chapter", "verse_start")


@query("detect_table_streamed", _SAID_SQL)
def detect_table_streamed(spark, sf):
    return D.fold(_said(spark, sf), S.Detector, "event_id", ["ts"], "event_id long, book_number int, chapter int, verse_start int")


# Streams, folded in batch

_FORM = r"array_to_string(list_filter(list_transform(regexp_split_to_array(lower(trim({})), '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w != ''), ' ')"


@query("router_stateless", rf"""select conv_id, turn, case when trim(text) = '' then 'empty' when regexp_full_match(trim(text), '(?s)[\[(].*[\])]') then 'noise_label' when not regexp_matches(text, '[\p{{L}}\p{{N}}]') then 'non_speech' else '' end as reason, {_FORM.format('text')} as form from conversations""")
def router_stateless(spark, sf):
    t = F.trim("text")
    reason = F.when(t == "", "empty").when(t.rlike(r"(?s)^[\[(].*[\])]$"), "noise_label").when(~t.rlike(r"[\p{L}\p{N}]"), "non_speech").otherwise("")
    return _turns(spark, sf).select("conv_id", "turn", reason.alias("reason"), X.dedup_form(F.col("text")).alias("form"))


@query("consecutive_dedup", "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as p from events) where p is null or p != event_type")
def consecutive_dedup(spark, sf):
    return W.consecutive_distinct(_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("user_id", "event_id", "event_type")


@query("rolling_window_8", "select conv_id, turn, array_to_string(list(role) over (partition by conv_id order by turn rows between 7 preceding and current row), ' ') as window_text from conversations")
def rolling_window_8(spark, sf):
    return W.rolling_text(_turns(spark, sf), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "window_text")


@query("context_asof_60s", """select event_id, user_id, case when epoch_us(ts) - epoch_us(seen_at) <= 3600000000 then v end as context from (select event_id, user_id, ts,
  last_value(case when event_type = 'click' then ts end ignore nulls) over w as seen_at, last_value(case when event_type = 'click' then event_id end ignore nulls) over w as v from events window w as (partition by user_id order by ts rows between unbounded preceding and 1 preceding))""")
def context_asof_60s(spark, sf):
    e = _events(spark, sf).withColumn("click", F.when(F.col("event_type") == "click", F.col("event_id")))
    return G.last_within(e, ["user_id"], "ts", "click", 3600, "context").select("event_id", "user_id", "context")


@query("session_gap", """select user_id, cast(session_no as bigint) as session_no, count(*) as n_events, round(sum(value), 2) as total from (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as session_no from
  (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) <= 7200000000 then 0 else 1 end as n from events)) group by all""")
def session_gap(spark, sf):
    return W.sessions(_events(spark, sf), ["user_id"], "ts", 7200).groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))


@query("tumbling_batches", "select epoch_us(ts) // 21600000000 * 21600 as window_start, count(*) as n_events, max(value) as top_value from events group by all")
def tumbling_batches(spark, sf):
    w = F.window("ts", "6 hours")
    return _events(spark, sf).groupBy(w).agg(F.count("*").alias("n_events"), F.max("value").alias("top_value")).select(F.unix_seconds("window.start").alias("window_start"), "n_events", "top_value")


@query("profiler_windows", "select epoch_us(ts) // 86400000000 * 86400 as window_start, event_type, count(*) as n_events, round(avg(value), 6) as avg_value, max(value) as max_value from events group by all")
def profiler_windows(spark, sf):
    g = _events(spark, sf).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.avg("value"), 6).alias("avg_value"), F.max("value").alias("max_value"))
    return g.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n_events", "avg_value", "max_value")


@query("latest_per_trigger", "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def latest_per_trigger(spark, sf):
    return D.latest_per_key(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("stale_filtered", "select event_id, user_id from (select *, max(ts) over (partition by user_id order by event_id rows unbounded preceding) as newest from events) where epoch_us(newest) - epoch_us(ts) <= 3600000000")
def stale_filtered(spark, sf):
    e = _events(spark, sf).select("event_id", "user_id", F.unix_micros("ts").alias("at"))
    return D.drop_stale(e, "user_id", "at", ["event_id"], "event_id long, user_id long", 3_600_000_000)


@query("live_ranking", """with n as (select max(epoch_us(ts)) as now from events) select user_id, event_id, place from (select user_id, event_id, row_number() over (partition by user_id order by
  round(least(value / 100, 1.0) + case when event_type = 'click' then 0.04 else 0 end + greatest(0, 0.01 * (1 - (now - epoch_us(ts)) / 2592000000000)), 6) desc, event_id) as place from events, n) where place <= 8""")
def live_ranking(spark, sf):
    e = _events(spark, sf)
    now = e.agg(F.max(F.unix_micros("ts")).alias("now"))
    age = (F.col("now") - F.unix_micros("ts")) / 2_592_000_000_000
    score = F.round(F.least(F.col("value") / 100, F.lit(1.0)) + F.when(F.col("event_type") == "click", 0.04).otherwise(0.0) + F.greatest(F.lit(0.0), 0.01 * (1 - age)), 6)
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")
    return e.crossJoin(F.broadcast(now)).withColumn("score", score).withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 8").select("user_id", "event_id", "place")


@query("voice_gate_islands", """with m as (select *, value >= 50 as a, row_number() over (partition by user_id order by ts, event_id) as pos from events), s as (select *, case when a and not coalesce(lag(a) over (partition by user_id order by pos), false) then 1 else 0 end as st from m)
  select user_id, cast(island as bigint) as island, min(pos) as first_pos, max(pos) as last_pos, count(*) as n_rows from (select *, sum(st) over (partition by user_id order by pos) as island from s) where a group by all""")
def voice_gate_islands(spark, sf):
    return W.islands(_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("value") >= 50)


@query("every_fourth", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts, event_id) % 4 = 0")
def every_fourth(spark, sf):
    return W.every_nth(_events(spark, sf), ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id")


def _folded(spark, sf):
    return _events(spark, sf).select("user_id", "event_id", F.unix_millis("ts").alias("ts"), F.least(F.col("value") / 100, F.lit(1.0)).alias("value"), "event_type")


@query("recent_dedup_12")
def recent_dedup_12(spark, sf):
    rows = _turns(spark, sf).select("conv_id", "turn", "text", F.lit("final").alias("kind"))
    return D.fold(rows, S.Router, "conv_id", ["turn"], "conv_id long, turn long, accepted boolean, reason string")


@query("cooldown_flags", """with recursive e as (select user_id, event_id, epoch_ms(ts) as ts, least(value / 100, 1.0) as value, row_number() over (partition by user_id order by ts, event_id) as r from events),
  f as (select user_id, event_id, r, value >= 0.8 as flagged, case when value >= 0.8 then ts end as at from e where r = 1 union all
  select e.user_id, e.event_id, e.r, e.value >= 0.8 and (f.at is null or e.ts - f.at >= 60000), case when e.value >= 0.8 and (f.at is null or e.ts - f.at >= 60000) then e.ts else f.at end from f join e on e.user_id = f.user_id and e.r = f.r + 1)
  select user_id, event_id, flagged from f""")
def cooldown_flags(spark, sf):
    return D.fold(_folded(spark, sf), _cooldown, "user_id", ["ts", "event_id"], "user_id long, event_id long, flagged boolean")


def _cooldown():
    return S.Cooldown(60_000)


@query("debounce", """with recursive e as (select user_id, event_id, epoch_ms(ts) as ts, row_number() over (partition by user_id order by ts, event_id) as r from events),
  f as (select user_id, event_id, r, ts as at, true as passed from e where r = 1 union all
  select e.user_id, e.event_id, e.r, case when e.ts - f.at >= 3600000 then e.ts else f.at end, e.ts - f.at >= 3600000 from f join e on e.user_id = f.user_id and e.r = f.r + 1)
  select user_id, event_id from f where passed""")
def debounce(spark, sf):
    return D.fold(_folded(spark, sf), _debounce, "user_id", ["ts", "event_id"], "user_id long, event_id long")


def _debounce():
    return S.Debounce(3_600_000)


@query("voice_gate", """with recursive e as (select user_id, event_id, least(value / 100, 1.0) >= 0.5 as loud, row_number() over (partition by user_id order by ts, event_id) as r from events),
  f as (select user_id, cast(null as bigint) as event_id, cast(0 as bigint) as r, false as is_open, 0 as l, 0 as q, 0 as n from (select distinct user_id from events) union all
  select user_id, event_id, r, case when opens then true when closes then false else is_open end, case when closes then 0 else l1 end, q1, case when opens then 0 else n1 end from
  (select *, not is_open and l1 >= 2 as opens, is_open and (q1 >= 3 or n1 >= 20) as closes from (select f.user_id, e.event_id, e.r, f.is_open,
    case when e.loud then f.l + 1 else 0 end as l1, case when e.loud then 0 else f.q + 1 end as q1, f.n + case when f.is_open then 1 else 0 end as n1 from f join e on e.user_id = f.user_id and e.r = f.r + 1)))
  select user_id, event_id, is_open from f where r > 0""")
def voice_gate(spark, sf):
    return D.fold(_folded(spark, sf), _gate, "user_id", ["ts", "event_id"], "user_id long, event_id long, is_open boolean")


def _gate():
    return S.VoiceGate(0.5, 2, 3, 20)


def _spoken(spark, sf):
    n = F.col("event_id")
    said = F.when(n % 5 == 0, F.concat(F.lit("turn to Acts "), (n % 28 + 1).cast("string"))).when(n % 5 == 1, F.concat(F.lit("verse "), (n % 40 + 1).cast("string"))).when(n % 5 == 2, F.lit("show me the last verse")).when(n % 5 == 3, F.concat(F.lit("John "), (n % 21 + 1).cast("string"), F.lit(":"), (n % 30 + 1).cast("string"))).otherwise(F.lit("the weather is nice"))
    return _events(spark, sf).select("user_id", "event_id", (n * 1000).alias("ts"), said.alias("text"))


@query("pending_reference")
def pending_reference(spark, sf):
    return D.fold(_spoken(spark, sf), S.Detector, "user_id", ["ts"], "user_id long, event_id long, book_number int, chapter int, verse_start int, confidence double")


@query("queue_changes")
def queue_changes(spark, sf):
    found = pending_reference(spark, sf).withColumn("chapter_only", F.col("confidence") < 0.9)
    return D.fold(found, S.Queue, "user_id", ["event_id", "book_number", "chapter"], "user_id long, event_id long, change string, place int")


@query("rolling_prompt", """select conv_id, turn, left(array_to_string(list(coalesce(text, '')) over (partition by conv_id order by turn desc rows between current row and 5 following), ' '), 1200) as prompt from conversations""")
def rolling_prompt(spark, sf):
    rows = _turns(spark, sf).select("conv_id", "turn", (F.col("turn") * 10_000).alias("ts"), "text")
    return D.fold(rows, S.RollingPrompt, "conv_id", ["turn"], "conv_id long, turn long, prompt string")


@query("sentence_buffer")
def sentence_buffer(spark, sf):
    rows = _turns(spark, sf).select("conv_id", "turn", (F.col("turn") * 1_000).alias("ts"), "text")
    return D.fold(rows, S.SentenceBuffer, "conv_id", ["turn"], "conv_id long, text string, why string")


# Plans and hymns

_STATUS = "case l_returnflag when 'R' then 'completed' when 'A' then 'skipped' else 'open' end"


def _items(spark, sf):
    status = F.when(F.col("l_returnflag") == "R", "completed").when(F.col("l_returnflag") == "A", "skipped").otherwise("open")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", status.alias("status"))


@query("plan_report", f"select l_orderkey, count(*) filter (s = 'completed') as n_completed, count(*) filter (s = 'skipped') as n_skipped, count(*) as n_items, round(sum(l_quantity), 2) as total_seconds from (select *, {_STATUS} as s from lineitem) group by all")
def plan_report(spark, sf):
    return W.plan_report(_items(spark, sf), "l_orderkey", F.col("status"), F.col("l_quantity"))


@query("next_item", f"""with i as (select l_orderkey, l_linenumber as ord, {_STATUS} as s, l_quantity >= 25 as active from lineitem), a as (select l_orderkey, max(case when active then ord end) as act from i group by all)
  select l_orderkey, min(case when s != 'skipped' and (act is null or ord > act) then ord end) as next_ord from i join a using (l_orderkey) group by all""")
def next_item(spark, sf):
    return W.next_item(_items(spark, sf), "l_orderkey", "l_linenumber", F.col("l_quantity") >= 25, F.col("status") != "skipped")


@query("renumber", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber) - 1 as ord from lineitem")
def renumber(spark, sf):
    from passagekit.operators.corpus import numbered

    return numbered(_items(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), ["l_orderkey"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")])


@query("move_item", "select l_orderkey, l_linenumber, case when l_linenumber = 1 then 3 when l_linenumber between 2 and 3 then l_linenumber - 1 else l_linenumber end as moved from lineitem")
def move_item(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", W.move_item(F.col("l_linenumber"), 1, 3).alias("moved"))


@query("screens_chunked", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
  select doc_id, (n - 1) // 4 + 1 as screen_no, count(*) as n_lines, md5(string_agg(line, ' / ' order by n)) as lines_md5, cast(ceil(max(t) / 4) as bigint) as n_screens from (select *, max(n) over (partition by doc_id) as t from l) group by all""")
def screens_chunked(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return W.screens(lines, ["doc_id"], "n", 4).select("doc_id", "screen_no", "n_lines", F.md5("lines_text").alias("lines_md5"), "n_screens")


@query("repeat_sections", """with w as (select o_orderkey, unnest([2, 1, 2, 9, 3]) as l_linenumber, unnest([0, 1, 2, 3, 4]) as p from orders where o_orderstatus = 'F')
  select o_orderkey, w.l_linenumber, l_partkey, l_suppkey, row_number() over (partition by o_orderkey order by p, l_partkey, l_suppkey) - 1 as out_ord from w join (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by all) l on l_orderkey = o_orderkey and l.l_linenumber = w.l_linenumber""")
def repeat_sections(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.array(*map(F.lit, (2, 1, 2, 9, 3))).alias("ids"))
    sections = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return W.select_sections(wanted, sections, "o_orderkey", "l_linenumber").select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "out_ord")


@query("audio_level", "select user_id, round(sqrt(avg(v * v)) / 32767, 6) as rms, round(max(abs(v)) / 32767, 6) as peak from (select user_id, cast(floor(value * 100) as bigint) % 32767 as v from events) group by all")
def audio_level(spark, sf):
    frames = table(spark, sf, "events").select("user_id", (F.floor(F.col("value") * 100) % 32767).alias("s"))
    return W.levels(frames, ["user_id"], "s").select("user_id", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


@query("toggle_membership", "select o_orderkey, case when list_contains([1, 2, 3, 4], o_custkey % 6) then len([1, 2, 3, 4]) - 1 else 5 end as n_left from orders")
def toggle_membership(spark, sf):
    four = F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3, 4)])
    return table(spark, sf, "orders").select("o_orderkey", F.size(W.toggle(four, F.col("o_custkey") % 6)).cast("bigint").alias("n_left"))


@query("word_times", "select conv_id, turn, cast(len(ws) as bigint) as n_words, round(10.0 / len(ws), 6) as each from (select conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w != '') as ws from conversations)")
def word_times(spark, sf):
    w = W.word_times(F.col("text"), F.lit(0.0), F.lit(10.0))
    return _turns(spark, sf).select("conv_id", "turn", w.alias("w")).select("conv_id", "turn", F.size("w").cast("bigint").alias("n_words"), F.round(F.col("w")[0]["end"] - F.col("w")[0]["start"], 6).alias("each"))


# Sources, queues and what is shown


@query("source_losses", """select user_id, before + 7200000000 as lost_at, recovered_at from (select user_id, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as before, epoch_us(ts) as recovered_at from events) where recovered_at - before > 7200000000""")
def source_losses(spark, sf):
    return W.source_losses(_events(spark, sf).select("user_id", F.unix_micros("ts").alias("at")), "user_id", "at", 7_200_000_000)


@query("speech_segments", """with f as (select user_id, epoch_us(ts) as us, event_id, value >= 30 as o, coalesce(lag(value >= 30) over (partition by user_id order by epoch_us(ts), event_id), false) as was from events),
  r as (select *, sum(case when o and not was then 1 else 0 end) over (partition by user_id order by us, event_id) as run from f), p as (select user_id, run, us, (us - min(us) over (partition by user_id, run)) // 21600000000 as part from r where o),
  g as (select user_id, run, part, min(us) as started, max(us) + 1000 as ended from p group by all)
  select user_id, row_number() over (partition by user_id order by started) as segment_no, started, ended from g where ended - started >= 600000000""")
def speech_segments(spark, sf):
    frames = _events(spark, sf).select("user_id", F.unix_micros("ts").alias("at"), F.col("value").alias("v"))
    return W.speech_segments(frames, "user_id", "at", F.col("v") >= 30, 1_000, 21_600_000_000, 600_000_000)


@query("queue_positions", """select o_orderkey, o_custkey, o_orderpriority, queue_pos from orders left join (select o_custkey, o_orderpriority, min(o_orderkey) as queue_pos from orders where o_orderstatus = 'O' group by all) using (o_custkey, o_orderpriority) where o_orderstatus = 'F'""")
def queue_positions(spark, sf):
    orders = table(spark, sf, "orders")
    queue = orders.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("pos"))
    live = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderpriority")
    return W.queue_positions(live, queue, "o_custkey", "o_orderpriority").select("o_orderkey", "o_custkey", "o_orderpriority", "queue_pos")


@query("merge_equivalent", """select user_id, event_id, event_type, confidence from (select *, round(least(value / 100, 1.0), 6) as confidence from events) qualify row_number() over (partition by user_id, lower(event_type) order by confidence desc, event_id desc) = 1""")
def merge_equivalent(spark, sf):
    spelled = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type")))
    found = table(spark, sf, "events").select("user_id", "event_id", spelled.alias("ref"), "event_type", F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("confidence"))
    return W.merge_equivalent(found, ["user_id"], "ref", "event_id").select("user_id", "event_id", "event_type", "confidence")


@query("merge_shown", """select user_id, max(round(value / 100, 6)) as confidence, min_by(event_id % 3, event_id) filter (event_id % 3 != 0) as chapter, min_by(event_type, event_id) filter (event_type != 'click') as kind, bool_or(event_id % 5 = 0) as is_direct, bool_and(event_id % 2 = 0) as chapter_only
  from (select user_id, event_id, value, event_type from events) group by user_id""")
def merge_shown(spark, sf):
    e = table(spark, sf, "events")
    found = e.select("user_id", "event_id", F.round(F.col("value") / 100, 6).alias("confidence"), (F.col("event_id") % 3).alias("chapter"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("kind"), (F.col("event_id") % 5 == 0).alias("is_direct"), (F.col("event_id") % 2 == 0).alias("chapter_only"))
    return V.merge_shown(found, ["user_id"], "event_id", ["chapter"], ["kind"], ["is_direct"], ["chapter_only"])


@query("semantic_detections", """with h as (select user_id, event_id % 4 as chunk_no, event_id % 7 as vec_id, max(round(least(value / 100, 1.0), 6)) as similarity from events group by all),
  f as (select user_id, vec_id, min_by(similarity, chunk_no) as similarity, min(chunk_no) as chunk_no from h where similarity >= 0.42 group by all)
  select *, row_number() over (partition by user_id order by similarity desc, vec_id) as place from f qualify place <= 3""")
def semantic_detections(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_id") % 4).alias("chunk_no"), (F.col("event_id") % 7).alias("vec_id"), F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("s"))
    hits = e.groupBy("user_id", "chunk_no", "vec_id").agg(F.max("s").alias("similarity"))
    return V.semantic_detections(hits, ["user_id"], k=3)


@query("synonym_map", """with g as (select n_regionkey as group_no, n_nationkey as ord, lower(n_name) as word from nation), p as (select a.word as term, b.word as synonym, min((b.group_no, b.ord)) as place from g a join g b on a.group_no = b.group_no and a.word != b.word group by all)
  select term, synonym, row_number() over (partition by term order by place, synonym) as ord from p""")
def synonym_map(spark, sf):
    return V.synonym_map(table(spark, sf, "nation").select(F.col("n_regionkey").alias("group_no"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("word")))
