import pytest
from pyspark.sql import functions as F

from passagekit.operators.references import BOOKS, MAX_CHAPTER, Matcher, clean, clean_text, continuation, detect, edition_command, hymn_command, is_valid, names, parse_after, read, transcription_command
from passagekit.streaming.transitions import CommandGate, Cooldown, Debounce, Detector, Newest, PlanRun, Queue, ReadingMode, RollingPrompt, Router, SentenceBuffer, VoiceGate

MATCHER = Matcher()


def run(machine, events):
    state, out = machine.start(), []
    for e in events:
        state, rows = machine.step(state, e)
        out.append(rows)
    return out, state


@pytest.mark.parametrize(("text", "want"), [
    ("3:16 says something", (3, 16, None)),
    ("8:28-30 is powerful", (8, 28, 30)),
    ("thirty two verse one now says", (32, 1, None)),
    ("3 is about the fall", (3, 0, None)),
    ("chapter 53 verse 5", (53, 5, None)),
    ("119 105 thy word is a lamp", (119, 105, None)),
    ("chapter six we will be reading from verse 10 to verse 16", (6, 10, 16)),
    ("chapter three and I want us to look at verse sixteen", (3, 16, None)),
    ("chapter one verse one to verse five", (1, 1, 5)),
    ("8 and let's look at verse 28", (8, 28, None)),
    ("let's go to chapter 3 verse 2 to verse 3", (3, 2, 3)),
    ("", (1, 0, None)),
    ("verse 10", (1, 10, None)),
    ("verse 5 sorry chapter 3", (3, 5, None)),
    ("verse 5 chapter 3 rather", (3, 5, None)),
    ("chapter 3 verse 5 I mean chapter 4 verse 7", (4, 7, None)),
    ("chapter 8 sorry chapter 12", (12, 1, None)),
    ("chapter", (1, 0, None)),
    ("chapter verse 8", (1, 8, None)),
    ("verse", (1, 1, None)),
    ("5 through 18", (5, 0, None)),
    ("was a good man", None),
])
def test_grammar(text, want):
    assert parse_after(text) == want


@pytest.mark.parametrize(("text", "value"), [("twenty three", 23), ("two hundred fifty one", 251), ("one hundred and nineteen", 119), ("nineteen", 19), ("hundred", 100), ("12", 12)])
def test_spoken_numbers(text, value):
    assert [(t.kind, t.value) for t in read(text)] == [("N", value)]


@pytest.mark.parametrize(("text", "book_only", "want"), [
    ("chapter 3 verse 22", True, (3, 22)), ("chapter 5", True, (5, None)), ("and I'm reading from verse 22", False, (None, 22)),
    ("3", True, (3, None)), ("22", False, (None, 22)), ("the weather is nice", True, None), ("verse 200", False, None), ("1 verse 5", True, (1, 5)),
])
def test_continuations(text, book_only, want):
    assert continuation(text, book_only) == want


def found(text):
    return [(r["book_name"], r["chapter"], r["verse_start"]) for r in detect(text, MATCHER)]


@pytest.mark.parametrize(("text", "want"), [
    ("Jesus said in John 3:16 that God loved the world", [("John", 3, 16)]),
    ("Paul wrote in 1 Corinthians 13:4 about love", [("1 Corinthians", 13, 4)]),
    ("1 John chapter two verse three", [("1 John", 2, 3)]),
    ("second corinthians chapter five verse seventeen", [("2 Corinthians", 5, 17)]),
    ("Psalms chapter twenty three verse one", [("Psalms", 23, 1)]),
    ("Filipians chapter 4 verse 13", [("Philippians", 4, 13)]),
    ("Revelations 3", [("Revelation", 3, 1)]),
    ("Hebrws chapter 11 verse 1", [("Hebrews", 11, 1)]),
    ("programming is fun", []),
    ("The weather is nice today", []),
    ("John 99:1", []),
])
def test_single_fragments(text, want):
    assert found(text) == want


def test_two_references_and_their_order():
    assert [b for b, *_ in found("Compare John 3:16 with Romans 5:8 for understanding God's love")] == ["John", "Romans"]


def test_names_and_chapters():
    assert len(BOOKS) == len(MAX_CHAPTER) == 66 and sum(MAX_CHAPTER) == 1189
    assert {n for _, n in names()} == set(range(1, 67))


def test_confidences():
    by = {t: detect(t, MATCHER)[0] for t in ("John 3:16", "John 3", "John")}
    assert by["John 3:16"]["confidence"] == 1.0 and not by["John 3:16"]["chapter_only"]
    assert all(by[t]["confidence"] == 0.88 and by[t]["chapter_only"] and by[t]["verse_start"] == 1 for t in ("John 3", "John"))


def said(*texts, step=1000):
    return [{"ts": i * step, "text": t} for i, t in enumerate(texts)]


def refs(rows):
    return [(r["book_name"], r["chapter"], r["verse_start"]) for r in rows]


def test_pending_reference_is_completed():
    out, _ = run(Detector(), said("Genesis 3", "verse 15"))
    assert refs(out[0]) == [("Genesis", 3, 1)] and out[0][0]["chapter_only"] and refs(out[1]) == [("Genesis", 3, 15)]


def test_pending_reference_gives_way_and_expires():
    _, state = run(Detector(), said("Genesis 3", "let's look at John 1"))
    assert state["pending"]["book"] == 43
    out, state = run(Detector(), said("Genesis 3", "something unrelated", step=20_000))
    assert out[1] == [] and state["pending"] is None


def test_last_verse_again():
    out, _ = run(Detector(), said("John 3:16", "can you show me the last verse"))
    assert refs(out[1]) == [("John", 3, 16)] and out[1][0]["confidence"] == 0.92


@pytest.mark.parametrize(("texts", "want"), [
    (("daniel chapter", "1 verse 5"), ("Daniel", 1, 5)),
    (("turn to Acts", "3", "22"), ("Acts", 3, 22)),
    (("God had put in his mouth. Acts", "chapter three, and I'm reading from verse", "22. Acts three, for Moses truly"), ("Acts", 3, 22)),
])
def test_references_over_fragments(texts, want):
    out, _ = run(Detector(), said(*texts))
    assert want in [r for rows in out for r in refs(rows)]


def test_router():
    e = [{"kind": "partial", "text": "so John three"}, {"kind": "partial", "text": "So John three."}, {"kind": "final", "text": "Hello there", "confidence": 0.9}, {"kind": "final", "text": "hello THERE!", "confidence": 0.9},
         {"kind": "final", "text": "[music]"}, {"kind": "final", "text": ""}, {"kind": "final", "text": "la la la la"}, {"kind": "final", "text": "quiet words", "confidence": 0.2, "provider": "cloud"}, {"kind": "final", "text": "quiet words", "confidence": 0.25, "provider": "local"}]
    out, _ = run(Router(), e)
    assert [r[0]["reason"] for r in out] == ["", "duplicate_partial", "", "duplicate_final", "noise_label", "empty", "non_speech", "low_confidence", ""]


def test_sentence_buffer():
    out, state = run(SentenceBuffer(), [{"ts": 0, "text": "God so loved"}, {"ts": 500, "text": "the world."}, {"ts": 900, "text": "and then"}, {"ts": 9000, "text": "more"}])
    assert [[(r["text"], r["why"]) for r in rows] for rows in out] == [[], [("God so loved the world.", "end")], [], [("and then", "silence")]]
    assert SentenceBuffer().end(state) == [{"text": "more", "why": "forced"}]


def test_cooldown_debounce_gate_prompt():
    out, _ = run(Cooldown(), [{"ts": t, "value": 0.9} for t in (0, 1000, 2500, 2600, 5000)] + [{"ts": 9000, "value": 0.5}])
    assert [r[0]["flagged"] for r in out] == [True, False, True, False, True, False]
    out, _ = run(Debounce(), [{"ts": t} for t in (0, 100, 150, 299, 300)])
    assert [bool(r) for r in out] == [True, False, True, False, True]
    out, _ = run(VoiceGate(0.5, 2, 2, 100), [{"value": v} for v in (1, 1, 1, 0, 0, 1)])
    assert [r[0]["is_open"] for r in out] == [False, True, True, True, False, False]
    out, _ = run(RollingPrompt(2, 9), [{"ts": 0, "text": "one"}, {"ts": 1, "text": "two"}, {"ts": 2, "text": "three"}, {"ts": 99_999, "text": "four"}])
    assert [r[0]["prompt"] for r in out] == ["one", "two one", "three two", "four"]


def test_reading_mode():
    verses = [[28, "it seemed good to the holy ghost".split()], [29, "abstain from meats offered to idols".split()], [30, "so when they were dismissed".split()], [31, "which when they had read".split()]]
    m = ReadingMode()
    out, state = run(m, [{"ts": 0, "verses": verses, "verse": 28}, {"ts": 1, "text": "that ye abstain from meats offered"}, {"ts": 2, "text": "verse 31"}, {"ts": 3, "text": "hello"}, {"ts": 400_000, "text": "so"}])
    assert [[(r["verse"], r["why"]) for r in rows] for rows in out] == [[(28, "start")], [(29, "overlap")], [(31, "command")], [], [(31, "pause")]]
    assert not state["active"] and m.step(state, {"ts": 400_001, "text": "verse 28"})[1] == []


def test_queue_refines_early_references():
    e = [{"book_number": 43, "chapter": 3, "verse_start": 1, "chapter_only": True}, {"book_number": 43, "chapter": 3, "verse_start": 16}, {"book_number": 43, "chapter": 3, "verse_start": 16}, {"book_number": 45, "chapter": 8, "verse_start": 28}]
    out, state = run(Queue(), e)
    assert [[(r["change"], r["place"]) for r in rows] for rows in out] == [[("added", 0)], [("refined", 0)], [], [("added", 1)]]


@pytest.mark.parametrize(("text", "want"), [("please sing hymn 12", 12), ("song two hundred fifty one", 251), ("12", None), ("hymn 9999", None)])
def test_hymns(text, want):
    assert hymn_command(text) == want


def test_command_gate_and_plan():
    out, _ = run(CommandGate(), [{"ts": t, "value": v} for t, v in ((0, "12"), (3000, "12"), (4000, "13"), (5000, "12"), (20_000, "12"))])
    assert [bool(r) for r in out] == [True, False, True, True, True]
    out, state = run(PlanRun(), [{"command": "load", "item": 3}, {"command": "activate", "item": 0}, {"command": "complete", "item": None}, {"command": "skip", "item": None}, {"command": "nonsense", "item": None}])
    assert [r[0]["active"] if r else "-" for r in out] == [None, 0, 1, 2, "-"] and state["items"] == ["completed", "skipped", "pending"]


#: Fragments and the first reference in them: (book, chapter, verse); None for none.
SPOKEN = [
    ("Rom 8:28", (45, 8, 28)), ("Heb 11:1", (58, 11, 1)), ("Rev 3:20", (66, 3, 20)), ("Dan 9:24", (27, 9, 24)), ("Num 6:24", (4, 6, 24)),
    ("Jn 3:16", (43, 3, 16)), ("Mt 5:3", (40, 5, 3)), ("Ps 23:1", (19, 23, 1)), ("Phlm 1:6", (57, 1, 6)), ("Lk 2:1", (42, 2, 1)), ("Mk 1:1", (41, 1, 1)),
    ("Song of Songs 2:1", (22, 2, 1)), ("two timothy 3:16", (55, 3, 16)), ("one john chapter 2 verse 3", (62, 2, 3)), ("song chapter 23 verse 1", (19, 23, 1)),
    ("1Cor 13:4", (46, 13, 4)), ("2nd Peter 1:3", (61, 1, 3)), ("III John 1:2", (64, 1, 2)), ("1 Co 2:9", (46, 2, 9)), ("Apocalypse 1:8", (66, 1, 8)),
    ("please open your bibles to Genesis 1:1", (1, 1, 1)), ("look at Mark 4:5", (41, 4, 5)), ("Mark 30:1", None), ("John 99999999999:1", None), ("good morning everyone", None),
]


@pytest.mark.parametrize(("text", "want"), SPOKEN)
def test_batch_and_stream_give_the_right_books(text, want):
    first = lambda rows: (rows[0]["book_number"], rows[0]["chapter"], rows[0]["verse_start"]) if rows else None
    assert first(detect(clean_text(text), MATCHER)) == want
    m = Detector()
    assert first(m.step(m.start(), {"ts": 0, "text": text})[1]) == want


def test_cleaning_is_the_same_for_columns_and_strings(spark):
    texts = [t for t, _ in SPOKEN] + ["Turn in your Bibles to  two Kings", "look at me", "someone john", "ONE JOHN and two timothys", "revelations", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t").withColumn("c", clean(F.col("t"))).collect()
    assert [r.c for r in rows] == [clean_text(r.t) for r in rows]


def test_editions_and_lifecycle_commands(spark):
    texts = [("new king james please", "NKJV", None), ("read in the message", "MSG", None), ("Holman Christian Standard", "HCSB", None), ("can I have it in amp", "AMP", None), ("KJV!", "KJV", None), ("stop listening", None, "stop"), ("please start the transcription", None, "start"), ("start and stop recording", None, "stop"), ("nothing", None, None)]
    df = spark.createDataFrame(texts, "t string, e string, c string")
    for r in df.select("*", edition_command(F.col("t")).alias("ge"), transcription_command(F.col("t")).alias("gc")).collect():
        assert (r.ge, r.gc) == (r.e, r.c), r.t


def test_validity_follows_every_books_chapters(spark):
    rows = [(b, c) for b in range(-1, 69) for c in (-1, 0, 1, 2, 16, 22, 66, 150, 151)] + [(None, 1), (1, None)]
    got = spark.createDataFrame(rows, "b int, c int").select("b", "c", is_valid(F.col("b"), F.col("c")).alias("ok")).collect()
    assert all(r.ok == (r.b is not None and r.c is not None and 1 <= r.b <= 66 and 1 <= r.c <= MAX_CHAPTER[r.b - 1]) for r in got)


def test_reading_mode_commands_and_recurring_words():
    verses = [[1, "the lord is good to all".split()], [2, "the lord is near to all".split()], [3, "bless the name for ever".split()]]
    m = ReadingMode()
    state, _ = m.step(m.start(), {"ts": 0, "verses": verses, "verse": 1, "chapter": 5})
    out = []
    for ts, text in enumerate(["the lord", "lord is good", "next verse", "go back", "go back", "verse 3", "chapter five", "let's go to chapter seven", "chapter 8 verse 2", "next chapter", "Genesis chapter", "3", "2"], 1):
        state, rows = m.step(state, {"ts": ts, "text": text})
        out.append([(r.get("chapter", 5), r["verse"], r["why"]) for r in rows])
    assert out == [[], [(5, 2, "overlap")], [(5, 3, "command")], [(5, 2, "command")], [(5, 1, "command")], [(5, 3, "command")], [], [(7, 1, "chapter")], [(8, 2, "chapter")], [(6, 1, "chapter")], [], [(3, 1, "chapter")], [(5, 2, "command")]]


def test_reading_mode_pauses_without_a_match_and_resumes_by_command():
    m = ReadingMode()
    state, _ = m.step(m.start(), {"ts": 0, "verses": [[1, ["alpha", "beta"]], [2, ["gamma", "delta"]]], "verse": 1})
    state, rows = m.step(state, {"ts": 200_000, "text": "verse 2"})
    assert rows[0]["verse"] == 2 and state["active"]
    state, rows = m.step(state, {"ts": 400_001, "text": "hello"})
    assert rows[0]["why"] == "pause" and not state["active"]


def test_stale_rows_go():
    out, _ = run(Newest(), [{"seq": s} for s in (1, 3, 2, 3, None, 4)])
    assert [bool(r) for r in out] == [True, True, False, True, True, True]


def test_queue_keeps_the_active_item_and_every_item():
    verses = [{"book_number": 1, "chapter": 1, "verse_start": v} for v in range(1, 701)]
    out, state = run(Queue(), [*verses, {"command": "activate", "place": 600}, {"command": "remove", "place": 10}, {"command": "remove", "place": 650}])
    assert len(state["items"]) == 698 and state["active"] == 599
    out, state = run(Queue(), [*verses[:2], {"command": "activate", "place": 1}, {"command": "remove", "place": 1}, {"command": "remove", "place": 0}])
    assert state == {"items": [], "active": None}


def test_plan_log_is_bounded_and_counts_on():
    _, state = run(PlanRun(log=3), [{"ts": 0, "command": "load", "item": 3}, *[{"ts": t, "command": "activate", "item": t % 3} for t in range(1, 6)]])
    assert state["log"] == [[3, "activate", 0], [4, "activate", 1], [5, "activate", 2]] and state["entries"] == 6
