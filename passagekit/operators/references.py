"""Citations in text: dictionary and fuzzy names, spoken numbers, the reference grammar.

The grammar reads a fragment as a string of token kinds and matches ordered patterns on it, inside one
Arrow-batched function. Dictionary and fuzzy matching are joins on a broadcast name table (66 names).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekit.functions.text import replace_phrases
from passagekit.runtime import ship_code

#: Book names by number, from 1.
BOOKS = (
    "Genesis,Exodus,Leviticus,Numbers,Deuteronomy,Joshua,Judges,Ruth,1 Samuel,2 Samuel,1 Kings,2 Kings,1 Chronicles,2 Chronicles,"
    "Ezra,Nehemiah,Esther,Job,Psalms,Proverbs,Ecclesiastes,Song of Solomon,Isaiah,Jeremiah,Lamentations,Ezekiel,Daniel,Hosea,Joel,"
    "Amos,Obadiah,Jonah,Micah,Nahum,Habakkuk,Zephaniah,Haggai,Zechariah,Malachi,Matthew,Mark,Luke,John,Acts,Romans,1 Corinthians,"
    "2 Corinthians,Galatians,Ephesians,Philippians,Colossians,1 Thessalonians,2 Thessalonians,1 Timothy,2 Timothy,Titus,Philemon,"
    "Hebrews,James,1 Peter,2 Peter,1 John,2 John,3 John,Jude,Revelation"
).split(",")

#: Chapters of each book.
MAX_CHAPTER = [
    50, 40, 27, 36, 34, 24, 21, 4, 31, 24, 22, 25, 29, 36, 10, 13, 10, 42, 150, 31, 12, 8, 66, 52, 5, 48, 12, 14, 3, 9, 1, 4, 7,
    3, 3, 3, 2, 14, 4, 28, 16, 24, 21, 28, 16, 16, 13, 6, 6, 4, 4, 5, 3, 6, 4, 3, 1, 13, 5, 5, 3, 5, 1, 1, 1, 22,
]

#: What speech recognition mishears, and its correction, in order.
CORRECTIONS = [
    ("one samuel", "1 Samuel"), ("two samuel", "2 Samuel"), ("one kings", "1 Kings"), ("two kings", "2 Kings"),
    ("one chronicles", "1 Chronicles"), ("two chronicles", "2 Chronicles"), ("first corinthian", "1 Corinthians"),
    ("one corinthian", "1 Corinthians"), ("one corinthians", "1 Corinthians"), ("second corinthian", "2 Corinthians"),
    ("two corinthian", "2 Corinthians"), ("two corinthians", "2 Corinthians"), ("first thessalonian", "1 Thessalonians"),
    ("one thessalonian", "1 Thessalonians"), ("one thessalonians", "1 Thessalonians"), ("second thessalonian", "2 Thessalonians"),
    ("two thessalonian", "2 Thessalonians"), ("two thessalonians", "2 Thessalonians"), ("one timothy", "1 Timothy"),
    ("two timothy", "2 Timothy"), ("one peter", "1 Peter"), ("two peter", "2 Peter"), ("one john", "1 John"), ("two john", "2 John"),
    ("three john", "3 John"), ("revelations", "Revelation"), ("song chapter", "Psalms chapter"), ("songs chapter", "Psalms chapter"),
    ("song verse", "Psalms verse"), ("songs verse", "Psalms verse"),
]

#: Phrases without meaning for a citation.
FILLERS = [
    "please open your bibles to", "let us turn to", "let's turn to", "go to the book of", "the book of", "book of", "if you turn to",
    "if you'll turn to", "we will be reading from", "we read in", "the bible says in", "it says in", "as we see in", "as written in",
    "let's go to", "turn in your bibles to", "turn in your bible to",
]

#: Phrases that ask for the latest reference again.
AGAIN = ["previous verse", "last verse", "that verse again", "go back to that verse", "back to that verse", "the same verse", "repeat that verse"]

#: Number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}


#: Other names and short forms of each book, in the order of BOOKS; those of a numbered book, without its number, stand once.
SHORT_FORMS = {
    "Genesis": "Gen, Ge, Gn", "Exodus": "Exod, Exo, Ex", "Leviticus": "Lev, Le, Lv", "Numbers": "Num, Nu, Nm, Nb", "Deuteronomy": "Deut, De, Dt",
    "Joshua": "Josh, Jos, Jsh", "Judges": "Judg, Jdg, Jg, Jdgs", "Ruth": "Rth, Ru", "Samuel": "Sam, Sa", "Kings": "Kgs, Ki", "Chronicles": "Chr, Ch",
    "Ezra": "Ezr", "Nehemiah": "Neh, Ne", "Esther": "Esth, Est, Es", "Job": "Jb", "Psalms": "Ps, Psalm, Psa, Psm, Pss",
    "Proverbs": "Prov, Pro, Prv, Pr", "Ecclesiastes": "Eccl, Ecc, Ec, Qoh", "Song of Solomon": "Song, Song of Songs, SOS, Cant", "Isaiah": "Isa, Is",
    "Jeremiah": "Jer, Je, Jr", "Lamentations": "Lam, La", "Ezekiel": "Ezek, Eze, Ezk", "Daniel": "Dan, Da, Dn", "Hosea": "Hos, Ho", "Joel": "Jl",
    "Obadiah": "Obad, Ob", "Jonah": "Jnh, Jon", "Micah": "Mic, Mc", "Nahum": "Nah, Na", "Habakkuk": "Hab, Hb", "Zephaniah": "Zeph, Zep, Zp",
    "Haggai": "Hag, Hg", "Zechariah": "Zech, Zec, Zc", "Malachi": "Mal, Ml", "Matthew": "Matt, Mat, Mt", "Mark": "Mrk, Mk, Mr", "Luke": "Luk, Lk",
    "John": "Joh, Jhn, Jn", "Acts": "Act, Ac", "Romans": "Rom, Ro, Rm", "Corinthians": "Cor, Co", "Galatians": "Gal, Ga", "Ephesians": "Eph, Ephes",
    "Philippians": "Phil, Php, Pp", "Colossians": "Col, Co", "Thessalonians": "Thess, Th", "Timothy": "Tim, Ti", "Titus": "Tit, Ti",
    "Philemon": "Phlm, Phm, Philem", "Hebrews": "Heb", "James": "Jas, Jm", "Peter": "Pet, Pe", "Jude": "Jud, Jd", "Revelation": "Rev, Re, Rv, Apocalypse",
}
#: Short forms of the numbered books of a name that also stands alone.
NUMBERED_SHORT_FORMS = {"John": "John, Jn"}
ORDINALS = {"1": ("First", "1st", "I"), "2": ("Second", "2nd", "II"), "3": ("Third", "3rd", "III")}


def names() -> list[tuple[str, int]]:
    """(lower-case phrase, book number): every name; a short form alone, or after the number of its book with and without
    a blank; and the name of a numbered book after an ordinal."""
    out: dict[str, int] = {}
    for i, name in enumerate(BOOKS, 1):
        number, _, rest = name.partition(" ") if name[0].isdigit() else ("", "", name)
        short = (number and NUMBERED_SHORT_FORMS.get(rest) or SHORT_FORMS.get(rest, "")).split(", ")
        forms = [f"{number}{gap}{x}" for x in short for gap in (" ", "")] + [f"{o} {rest}" for o in ORDINALS[number]] if number else short
        for form in [name, *forms]:
            if form:
                out.setdefault(form.lower(), i)
    return sorted(out.items())


def name_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(names(), "phrase string, book_number int")


def clean(text: Column) -> Column:
    """Corrections, then fillers, then "look at" before a capital; blanks collapsed."""
    text = replace_phrases(replace_phrases(text, CORRECTIONS), [(f, "") for f in FILLERS])
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i:\blook at)\s+(?=\p{Lu})", ""), r"\s+", " "))


def _phrase(phrase: str) -> re.Pattern:
    return re.compile(rf"(?<![^\W_]){re.escape(phrase)}(?![^\W_])", re.IGNORECASE | re.ASCII if phrase.isascii() else re.IGNORECASE)


_REPLACED = [(a, _phrase(a), b) for a, b in [*CORRECTIONS, *((f, "") for f in FILLERS)]]


def clean_text(text: str) -> str:
    """clean() of one string: what both the batch detector and the streaming one read."""
    low = text.lower()
    for phrase, pattern, new in _REPLACED:
        if phrase in low:
            text = pattern.sub(new, text)
            low = text.lower()
    if "look at" in low:
        text = re.sub(r"(?i:look at)(?=\s*[A-Z])", "", text)
    return re.sub(" +", " ", text).strip()


def is_valid(book: Column, chapter: Column) -> Column:
    """Book 1..66 and a chapter that it has. Verses are not checked."""
    return F.coalesce(book.between(1, len(BOOKS)) & chapter.between(1, F.element_at(F.array(*map(F.lit, MAX_CHAPTER)), F.when(book.between(1, len(BOOKS)), book).otherwise(1).cast("int"))), F.lit(False))


@dataclass
class Token:
    kind: str
    value: int = 0


_WORDS = re.compile(r"\d+|[^\W\d_]+(?:'[^\W\d_]+)?|:|[-–—]")
_KIND = {"chapter": "C", "verse": "V", "verses": "V", "to": "T", "through": "T", "sorry": "S", "rather": "S", "meant": "S", "mean": "S", "and": "A", ":": ":", "-": "-", "–": "-", "—": "-"}


def read(text: str) -> list[Token]:
    """Tokens with spoken numbers joined: tens and a unit, N hundred [and] R. Digits stay single numbers."""
    words = _WORDS.findall(text.lower())
    out, i = [], 0
    while i < len(words):
        w = words[i]
        if w.isdecimal():  # what is too large for a chapter or verse number is a word
            out.append(Token("N", int(w)) if len(w.lstrip("0")) <= 9 else Token("w"))
        elif w in NUMBER_WORDS or w == "hundred":
            value, j = (1, i) if w == "hundred" else (NUMBER_WORDS[w], i + 1)
            if value >= 20 and j < len(words) and 1 <= NUMBER_WORDS.get(words[j], 0) <= 9:
                value, j = value + NUMBER_WORDS[words[j]], j + 1
            if j < len(words) and words[j] == "hundred":
                value, j = value * 100, j + 1
                k = j + (j < len(words) and words[j] == "and")
                if k < len(words) and words[k] in NUMBER_WORDS:
                    rest, k = NUMBER_WORDS[words[k]], k + 1
                    if rest >= 20 and k < len(words) and 1 <= NUMBER_WORDS.get(words[k], 0) <= 9:
                        rest, k = rest + NUMBER_WORDS[words[k]], k + 1
                    value, j = value + rest, k
            out.append(Token("N", value))
            i = j
            continue
        else:
            out.append(Token(_KIND.get(w, "w")))
        i += 1
    return out


#: Ordered patterns on token kinds; groups name the numbers. Text may stand between a chapter and its verse, within bounds.
_COLON = re.compile(r"(?P<c>N):(?P<v>N)(?:-(?P<e>N))?")
_END = r"(?:-(?P<e>N)|TV?(?P<f>N))?"
_CHAPTER_VERSE = re.compile(rf"C(?P<c>N)(?:.{{0,14}}?V(?P<v>N){_END})?")
_NUMBER_VERSE = re.compile(rf"(?P<c>N).{{0,9}}?V(?P<v>N){_END}")
_VERSE = re.compile(r"^[^N]*?V(?P<v>N)?")
_PAIR = re.compile(rf"^(?P<c>N)(?P<v>N){_END}")


def parse_after(text: str) -> tuple[int, int, int | None] | None:
    """(chapter, first verse, last verse) said after a book name; verse 0 is a chapter alone."""
    tokens = read(text)
    kinds = "".join(t.kind for t in tokens)
    if not kinds:
        return 1, 0, None

    def numbers(m: re.Match) -> tuple[int, int, int | None]:
        g = {k: tokens[m.start(k)].value for k, v in m.groupdict().items() if v}
        return g.get("c", 1), g.get("v", 0), g.get("e", g.get("f"))

    if m := _COLON.search(kinds):
        return numbers(m)
    if (at := kinds.find("S")) >= 0:
        said: dict[str, int] = {}
        for part in (range(at), range(at + 1, len(kinds) - 1)):
            said |= {kinds[i]: tokens[i + 1].value for i in part if kinds[i] in "CV" and kinds[i + 1] == "N"}
        if said:
            return said.get("C", 1), said.get("V", 1), None
    if m := _CHAPTER_VERSE.search(kinds):
        return numbers(m)
    if m := _VERSE.match(kinds):
        return 1, tokens[m.start("v")].value if m["v"] else 1, None
    if m := _NUMBER_VERSE.search(kinds):
        return numbers(m)
    if kinds.endswith("C"):
        return 1, 0, None
    if m := _PAIR.match(kinds):
        return numbers(m)
    return (tokens[0].value, 0, None) if kinds[0] == "N" else None


def continuation(text: str, book_only: bool) -> tuple[int | None, int | None] | None:
    """(chapter, verse) that completes an earlier reference: `chapter N [verse M]`, `verse M`, or a bare number,
    which is the chapter of a bare book and the verse otherwise. Verses run from 1 to 176."""
    tokens = read(text)
    kinds = "".join(t.kind for t in tokens)
    ok = lambda v: 1 <= v <= 176
    if m := re.search(r"C(?P<c>N)(?:.*?V(?P<v>N))?", kinds):
        verse = tokens[m.start("v")].value if m["v"] else None
        return tokens[m.start("c")].value, verse if verse and ok(verse) else None
    if m := re.search(r"(?:(?P<c>N).{0,9}?)?V(?P<v>N)", kinds):
        chapter = tokens[m.start("c")].value if m["c"] and book_only else None
        return (chapter, tokens[m.start("v")].value) if ok(tokens[m.start("v")].value) else None
    if kinds[:1] == "N":
        return (tokens[0].value, None) if book_only else (None, tokens[0].value) if ok(tokens[0].value) else None
    return None


class Matcher:
    """Names in a text: leftmost-longest at word boundaries; if none, close spellings of the longer names."""

    def __init__(self):
        known = names()
        self.number = dict(known)
        self.pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(re.escape(p) for p, _ in sorted(known, key=lambda x: (-len(x[0]), x[0]))) + r")(?![^\W_])")
        self.full = [(b.lower(), i, 1 if len(b) <= 4 else 2 if len(b) <= 8 else 3) for i, b in enumerate(BOOKS, 1) if len(b) >= 4]
        self.longest = max(len(b) + most for b, _, most in self.full)
        self.counts = [Counter(b) for b, _, _ in self.full]
        self.seen: dict[str, list[tuple[int, int]]] = {}

    def _close(self, piece: str) -> list[tuple[int, int]]:
        """(edits, book number) of the names that a piece is close to, remembered up to a bound."""
        got = self.seen.get(piece)
        if got is None:
            letters, got = Counter(piece), []
            for (name, number, most), have in zip(self.full, self.counts):
                if abs(len(piece) - len(name)) <= most and sum((letters - have).values()) <= most and 0 < (d := _edits(piece, name, most)) <= most:
                    got.append((d, number))
            if len(self.seen) >= 200_000:
                self.seen.clear()
            self.seen[piece] = got
        return got

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, book number) in the lower-cased text."""
        return [(m.start(), m.end(), self.number[m[0]]) for m in self.pattern.finditer(text)]

    def named(self, text: str) -> list[tuple[int, int, int]]:
        return self.find(text) or self.fuzzy(text)

    def fuzzy(self, text: str) -> list[tuple[int, int, int]]:
        """Words within 1, 2 or 3 edits of a name (by its length), never equal to it; greedy by start and distance."""
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        found = []
        for i, (start, _) in enumerate(words):
            for n in range(1, min(5, len(words) - i + 1)):
                end = words[i + n - 1][1]
                if end - start > self.longest:
                    break
                if end - start >= 5:
                    found += [(start, d, -n, end, number) for d, number in self._close(text[start:end])]
        out, at = [], 0
        for start, _, _, end, number in sorted(found):
            if start >= at:
                out.append((start, end, number))
                at = end
        return out


def _edits(a: str, b: str, most: int) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        if min(row) > most:
            return most + 1
    return row[-1]


def confidence(chapter: int, verse: int, named: bool = True) -> float:
    """0.88 for a chapter alone; else 0.90, more for a chapter, a verse and a name, up to 1."""
    return 0.88 if not verse else min(1.0, round(0.90 + 0.04 * (chapter > 0) + 0.04 * (verse > 0) + 0.02 * named, 2))


def detect(text: str, matcher: Matcher, named: list[tuple[int, int, int]] | None = None) -> list[dict]:
    """References in one cleaned fragment, in order. A bare book or chapter gives verse 1, flagged chapter_only.
    `named`: the names in the lower-cased text, where they are known already."""
    low = text.lower()
    out = []
    for start, end, book in matcher.named(low) if named is None else named:
        said = parse_after(low[end:])
        if said and 1 <= said[0] <= MAX_CHAPTER[book - 1]:
            chapter, verse, last = said
            out.append({"book_number": book, "book_name": BOOKS[book - 1], "chapter": chapter, "verse_start": verse or 1, "verse_end": last, "confidence": confidence(chapter, verse), "chapter_only": not verse, "start": start, "snippet": snippet(text, start, end)})
    return out


def snippet(text: str, start: int, end: int, around: int = 30) -> str:
    """The match and up to `around` characters on either side, cut at blanks."""
    a, b = max(0, start - around), min(len(text), end + around)
    a = a if a == 0 else (text.find(" ", a, start) + 1 or start)
    b = b if b == len(text) else (text.rfind(" ", end, b) if text.rfind(" ", end, b) > 0 else end)
    return text[a:b].strip()


DETECTION = "array<struct<book_number:int,book_name:string,chapter:int,verse_start:int,verse_end:int,confidence:double,chapter_only:boolean,start:int,snippet:string>>"


def detect_references(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, book_number .. snippet): one row for each reference of each fragment."""
    ship_code(df.sparkSession)
    item = pa.struct([("book_number", pa.int32()), ("book_name", pa.string()), ("chapter", pa.int32()), ("verse_start", pa.int32()), ("verse_end", pa.int32()), ("confidence", pa.float64()), ("chapter_only", pa.bool_()), ("start", pa.int32()), ("snippet", pa.string())])

    def run(batches):
        matcher = Matcher()
        for b in batches:
            found = [detect(clean_text(t or ""), matcher) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(item))], [*b.schema.names[:-1], "found"])

    narrow = df.select(*keys, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, found {DETECTION}").select(*keys, F.explode("found").alias("r")).select(*keys, "r.*")


#: A dictionary's first words go with the plan up to this number.
MOST_FIRST = 10_000


def _gram(n: int):
    """A place -> the n words from there on, none if there are fewer."""

    def gram(g: Column) -> Column:
        phrase = F.when(g["start"] + n <= F.size("w"), F.array_join(F.slice("w", g["start"] + 1, n), " "))
        return F.struct(g["start"].alias("start"), F.lit(n).alias("n_words"), phrase.alias("phrase"))

    return gram


def dictionary_spans(df: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", most_words: int = 3) -> DataFrame:
    """(keys, start, n_words, phrase, id): leftmost-longest non-overlapping dictionary phrases, as an equi-join.

    Word n-grams meet the dictionary (phrase, id) by an equality join, so neither side is scanned for the other;
    overlaps are settled by a fold over the hits of one text. Of a dictionary of at most MOST_FIRST first words, only words that
    begin a phrase start n-grams. Positions count words from 0."""
    firsts = [r.w for r in dictionary.select(F.split("phrase", " ")[0].alias("w")).distinct().limit(MOST_FIRST + 1).collect()]
    begins = (lambda w: w.isin(firsts)) if len(firsts) <= MOST_FIRST else lambda w: F.lit(True)
    words = df.select(*keys, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))
    starts = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("start"), x.alias("first"))), lambda g: begins(g["first"]))
    made = [F.transform(starts, _gram(n)) for n in range(1, most_words + 1)]
    hits = words.select(*keys, F.explode(F.filter(F.concat(*made), lambda g: g["phrase"].isNotNull())).alias("g")).select(*keys, "g.*").join(dictionary, "phrase")
    kind = "array<struct<start:int,minus:int,n_words:int,phrase:string,id:int>>"
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("n_words")).alias("minus"), "n_words", "phrase", F.col("id").cast("int").alias("id"))))
    fold = F.aggregate(
        F.col("h"), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, h: F.when(h["start"] >= acc["at"], F.struct((h["start"] + h["n_words"]).alias("at"), F.concat(acc["out"], F.array(h)).alias("out"))).otherwise(acc), lambda acc: acc["out"],
    )
    return hits.groupBy(*keys).agg(ordered.alias("h")).select(*keys, F.explode(fold).alias("s")).select(*keys, "s.start", "s.n_words", "s.phrase", "s.id")


def fuzzy_names(words: DataFrame, dictionary: DataFrame, word: str = "word", name: str = "name") -> DataFrame:
    """Pairs within 1, 2 or 3 edits by the name's length (up to 4, up to 8, longer), never equal.

    The dictionary is small and fixed; an equality on length bands keeps the join from comparing all pairs."""
    most = F.when(F.char_length(name) <= 4, 1).when(F.char_length(name) <= 8, 2).otherwise(3)
    left = words.withColumn("_n", F.explode(F.sequence(F.char_length(word) - 3, F.char_length(word) + 3)))
    right = dictionary.withColumn("_n", F.char_length(name)).withColumn("_most", most)
    d = F.levenshtein(F.lower(word), F.lower(name))
    return left.join(right, "_n").withColumn("distance", d).filter((F.col("distance") > 0) & (F.col("distance") <= F.col("_most"))).drop("_n", "_most")


#: Abbreviations, and words, that name an edition when they stand alone.
EDITION_WORDS = {
    "niv": "NIV", "esv": "ESV", "nasb": "NASB", "nkjv": "NKJV", "nlt": "NLT", "kjv": "KJV", "amp": "AMP", "amplified": "AMP", "sparv": "SpaRV",
    "spanish": "SpaRV", "frejnd": "FreJND", "french": "FreJND", "porblivre": "PorBLivre", "portuguese": "PorBLivre", "msg": "MSG", "csb": "CSB",
    "hcsb": "HCSB", "rsv": "RSV", "nrsv": "NRSV", "net": "NET", "cev": "CEV", "gnt": "GNT", "gnb": "GNT",
}


#: Spoken names of editions, in the order in which they are looked for; the longer of two that contain each other first.
EDITION_NAMES = [
    ("NIV", "new international version, in new international"), ("ESV", "english standard version, in english standard"),
    ("NASB", "new american standard, in new american"), ("NKJV", "new king james, in new king james"),
    ("NLT", "new living translation, in new living"), ("KJV", "king james version, king james, in king james"),
    ("AMP", "amplified bible, amplified version, amplified translation, in amplified version, in amplified translation"),
    ("SpaRV", "in reina valera, in spanish, spanish version, spanish translation"), ("FreJND", "in french, french version, french translation, darby french"),
    ("PorBLivre", "in portuguese, portuguese version, portuguese translation, biblia livre"),
    ("MSG", "in the message, message version, message translation, message bible"),
    ("HCSB", "holman christian standard, holman christian, in holman christian"), ("CSB", "christian standard bible, christian standard, in christian standard"),
    ("NRSV", "new revised standard version, new revised standard, in new revised standard"),
    ("RSV", "revised standard version, revised standard, in revised standard"), ("NET", "new english translation, in new english"),
    ("CEV", "contemporary english, contemporary english version, in contemporary english"),
    ("GNT", "good news, good news translation, good news bible, in good news"),
]
#: What is said before the abbreviation or a short name of an edition, and those names.
EDITION_REQUESTS = ["give me", "read in", "switch to", "in the", "can i have it in", "can i have that in", "show me"]
EDITION_REQUESTED = {"AMP": ["amplified", "amp"], "SpaRV": ["reina valera", "spanish"], "FreJND": ["french"], "PorBLivre": ["portuguese"], "MSG": ["the message", "message"], "GNT": ["gnt", "gnb", "good news"]}
#: Phrases that stop and start the transcription.
STOP_PHRASES = ["stop transcribing", "stop transcription", "stop the transcription", "stop listening", "stop recording"]
START_PHRASES = ["start transcribing", "start transcription", "start the transcription", "start listening", "start recording"]


def edition_phrases() -> list[tuple[str, str]]:
    """(phrase, edition) in the order in which they are looked for."""
    out = []
    for edition, spoken in EDITION_NAMES:
        out += [(f"{request} {name}", edition) for request in EDITION_REQUESTS for name in EDITION_REQUESTED.get(edition, [edition.lower()])]
        out += [(name, edition) for name in spoken.split(", ")]
    return out


def edition_command(text: Column, phrases: list[tuple[str, str]] | None = None) -> Column:
    """The edition a text asks for: by the first listed phrase it contains (edition_phrases() by default), else by its first
    edition word; null without one."""
    low = F.lower(text)
    words = F.filter(F.transform(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w.isin(*EDITION_WORDS))
    table = F.create_map(*[F.lit(x) for kv in sorted(EDITION_WORDS.items()) for x in kv])
    named = [F.when(F.contains(low, F.lit(p)), F.lit(a)) for p, a in (edition_phrases() if phrases is None else phrases)]
    return F.coalesce(*named, F.when(F.size(words) > 0, table[F.get(words, F.lit(0))]))


def transcription_command(text: Column) -> Column:
    """`stop` or `start` if a text asks for the transcription to stop or, else, to start; null for neither."""
    has = lambda phrases: F.lower(text).rlike("|".join(map(re.escape, phrases)))
    return F.when(has(STOP_PHRASES), "stop").when(has(START_PHRASES), "start")


def slide_command(text: Column) -> Column:
    """`next`, `previous`, or the number of a slide to jump to; null for none."""
    low = F.lower(text)
    jump = F.regexp_extract(low, r"\b(?:go to |jump to )?slide (?:number )?(\d+)\b", 1)
    return F.when(jump != "", jump).when(low.rlike(r"\bnext slide\b"), "next").when(low.rlike(r"\b(?:previous|last) slide\b|\bslide back\b"), "previous")


def hymn_command(text: str, known: range = range(1, 696)) -> int | None:
    """The number of a hymn that a text calls for by digits or words; None if it names none that is known."""
    m = re.search(r"\b(?:hymn|song)(?: number| no\.?)?\s+(.+)", text.lower())
    n = next((t.value for t in read(m[1])[:1] if t.kind == "N"), None) if m else None
    return n if n in known else None


def looks_complete(text: Column) -> Column:
    """A preview is worth parsing: a book name, and a colon, a verse word, two numbers, or a chapter with a number."""
    low = F.lower(text)
    named = low.rlike(r"\b(" + "|".join(re.escape(b.lower().lstrip("123 ")) for b in BOOKS) + r")\b")
    return named & (F.contains(low, F.lit(":")) | low.rlike(r"\bverses?\b") | low.rlike(r"\d+\D+\d+") | low.rlike(r"\bchapter\b.*\d"))


def last_within(events: DataFrame, key: list[str], ts: str, value: str, seconds: int, out: str) -> DataFrame:
    """As-of: the latest earlier non-null value of the same key, if at most `seconds` old."""
    w = Window.partitionBy(*key).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("at"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    return events.withColumn("_p", prior).withColumn(out, F.when(F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_p.at")) <= seconds * 1_000_000, F.col("_p.v"))).drop("_p")
