"""Text normalisation as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of full-text queries.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is it not be are was were been has have had do does did will "
    "would shall should may might can could that this these those he she we they you i me him her us them my his its "
    "our your their so if as no up all am about into when what which who whom how than then now just also very like "
    "even out there here"
).split()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def clean_word(word: Column) -> Column:
    """Only letters, digits and apostrophes of a word."""
    return F.regexp_replace(word, r"[^\p{L}\p{N}']", "")


def query_words(text: Column) -> Column:
    """Cleaned words of a query, blanks dropped, case kept."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), clean_word), lambda w: w != "")


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(STOP_WORDS)


def phrase_query(text: Column) -> Column:
    """The query as one quoted phrase: letters, digits, white space and apostrophes."""
    kept = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}\s']", ""))
    return F.when(kept != "", F.concat(F.lit('"'), kept, F.lit('"'))).otherwise("")


def and_terms(text: Column, most: int = 12) -> Column:
    """Words of at least two bytes that are no stop words, the first `most`."""
    return F.slice(F.filter(query_words(text), lambda w: (F.octet_length(w) >= 2) & ~is_stop_word(w)), 1, most)


def or_terms(text: Column, most: int = 10) -> Column:
    """Words of at least three bytes that are no stop words, the first `most`."""
    return F.slice(F.filter(query_words(text), lambda w: (F.octet_length(w) >= 3) & ~is_stop_word(w)), 1, most)


def dedup_form(text: Column) -> Column:
    """How transcripts are compared: lower case, words without outer punctuation, single blanks."""
    words = F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def replace_phrases(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replace phrases at word boundaries, whatever their ASCII case, in list order."""
    for phrase, new in pairs:
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])\Q{phrase}\E(?![\p{{L}}\p{{N}}])", new)
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Trimmed pieces between . ! ? and line ends."""
    return F.filter(F.transform(F.split(text, r"[.!?\n]"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_windows(text: Column, most: int = 2, least_words: int = 5) -> Column:
    """Distinct runs of 1..most sentences with at least `least_words` words, by first sentence and length."""
    s = sentences(text)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(i + n - 1 <= F.size(s), F.array_join(F.slice(s, i, n), ". ")))))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull() & (F.size(F.split(F.trim(r), r"\s+")) >= least_words)))


def word_set(text: Column, least: int = 2) -> Column:
    """Distinct lower-case words of at least `least` bytes."""
    return F.array_distinct(F.filter(tokens(text), lambda w: F.octet_length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; 1 for two empty sets, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(verse: Column, heard: Column) -> Column:
    """Share of the verse's words that were heard; 0 for a verse without words."""
    return F.when(F.size(verse) == 0, 0.0).otherwise(F.size(F.array_intersect(verse, heard)) / F.size(verse))


def term_accuracy(text: Column, terms: Column) -> Column:
    """Share of terms that the text contains; 1 without terms."""
    low = F.lower(text)
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.size(terms))


def loose_bool(value: Column) -> Column:
    """true/1/yes/on, false/0/no/off, or a number that is not 0; null for the rest."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes", "on"), True).when(v.isin("false", "0", "no", "off"), False).otherwise(v.try_cast("double") != 0)


def loose_share(value: Column) -> Column:
    """A number from 0 to 1; values above 1 are percents, clamped."""
    x = F.trim(value).try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))))


def html_text(fragment: Column) -> Column:
    """Tags out, common entities decoded, white space collapsed."""
    text = F.regexp_replace(fragment, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return collapse(text)


def pdf_text(text: Column) -> Column:
    """Soft hyphens out, quotes straightened, words joined across line ends, blank lines collapsed."""
    text = F.regexp_replace(text, "\u00ad", "")
    text = F.translate(text, "‘’“”", "''\"\"")
    text = F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")
    text = F.regexp_replace(text, r"(?m)^\s*(?:page\s+)?\d+\s*$", "")
    return F.trim(F.regexp_replace(text, r"\n\s*\n+", "\n\n"))
