"""Operator 8: byte-level BPE encoding and decoding.

Frequent words of the corpus, with their ids, are compiled into a minimal acyclic automaton: words
share prefixes and suffixes, and the numbers on the arcs of a word's path add up to its rank, which
gives its ids. The automaton is one file of flat arrays that Spark hands to the executors and
their workers map into memory; it is walked by all distinct words of some texts at once. Words that are not in it are
merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import tempfile
from bisect import bisect_right
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.runtime import cut, ship_code, table

#: Fixed value: how byte-level BPE splits text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(WORD_PATTERN)
#: The same for texts without characters outside _PLAIN, where the two classes of letters and numbers agree: twice as fast.
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]")
#: Characters of text that are encoded together, and the longest word that is remembered.
CHUNK, LONGEST = 1 << 22, 32


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text) if _NOT_PLAIN.search(text) else _PLAIN_WORDS.findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(token bytes -> id, special string -> id) of a byte-level BPE file of the tokenizers library.

    Raises ValueError for files that normalise, drop out or number merges in another order than ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, alphabet = spec["model"], byte_alphabet()
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or model["type"] != "BPE" or model.get("dropout") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return ranks, special


class Vocabulary:
    """A vocabulary as workers use it: exact merging, special strings, decoding."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]):
        self.special = special
        self.core = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.token = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in special.items()}

    def segments(self, text: str):
        """(is special, string): a text's special strings and what lies between them, in order."""
        at = 0
        if self.cut and any(s in text for s in self.special):
            for m in self.cut.finditer(text):
                if at < m.start():
                    yield False, text[at : m.start()]
                yield True, m[0]
                at = m.end()
        if at < len(text):
            yield False, text[at:] if at else text

    def merge(self, word: str) -> tuple[int, ...]:
        return tuple(self.core.encode_ordinary(word))

    def decode(self, ids) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


class Automaton:
    """Minimal acyclic automaton over byte strings, as flat arrays in one file."""

    NAMES = ("start", "arc", "target", "skip", "final", "at", "ids")

    @staticmethod
    def compile(words: dict[bytes, tuple[int, ...]]) -> dict[str, np.ndarray]:
        """Incremental construction from sorted words: a state is replaced by an equal one (same
        finality, same arcs) as soon as no later word can pass through it."""
        known: dict[tuple, int] = {}
        arcs_of: list[tuple] = []
        counts: list[int] = []

        def freeze(node) -> int:
            final, arcs = node
            key = (final, tuple(arcs))
            if (state := known.get(key)) is None:
                state = known[key] = len(arcs_of)
                arcs_of.append(key)
                counts.append(final + sum(counts[t] for _, t in arcs))
            return state

        path, last = [[False, []]], b""
        for word in sorted(words):
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            for i in range(len(last), same, -1):
                state = freeze(path.pop())
                path[-1][1].append((last[i - 1], state))
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0], last = True, word
        for i in range(len(last), 0, -1):
            state = freeze(path.pop())
            path[-1][1].append((last[i - 1], state))
        start = freeze(path.pop())
        arc, target, skip = [], [], []
        for state, (final, arcs) in enumerate(arcs_of):
            before = int(final)
            for c, t in arcs:
                arc.append(state << 8 | c)
                target.append(t)
                skip.append(before)
                before += counts[t]
        ids = [words[w] for w in sorted(words)]
        sizes = np.cumsum([0, *map(len, ids)])
        return {
            "start": np.array([start]), "arc": np.array(arc, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64),
            "final": np.array([f for f, _ in arcs_of], np.int64), "at": sizes.astype(np.int64), "ids": np.array([*chain.from_iterable(ids)], np.int64),
        }

    @staticmethod
    def save(arrays: dict[str, np.ndarray], folder: str) -> str:
        body = b"".join(arrays[n].astype("<i8").tobytes() for n in Automaton.NAMES)
        head = np.array([len(arrays[n]) for n in Automaton.NAMES], "<i8").tobytes()
        path = os.path.join(folder, f"lexicon-{hashlib.sha256(head + body).hexdigest()[:24]}.bin")
        with open(path, "wb") as f:
            f.write(head + body)
        return path

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.file, "<i8", len(self.NAMES))
        at = 8 * len(self.NAMES)
        for name, n in zip(self.NAMES, sizes.tolist()):
            setattr(self, name, np.frombuffer(self.file, "<i8", n, at))
            at += 8 * n

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word in the lexicon, -1 for others: all words take a step on the automaton at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        octets, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        out, rank = np.full(len(words), -1), np.zeros(len(words), np.int64)
        state, live, step = np.full(len(words), self.start[0]), np.arange(len(words)), 0
        while live.size:
            done = sizes[live] == step
            ends = live[done]
            out[ends] = np.where(self.final[state[ends]], rank[ends], -1)
            live = live[~done]
            if not self.arc.size:
                break
            wanted = state[live] << 8 | octets[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.arc, wanted), self.arc.size - 1)
            there = self.arc[arc] == wanted
            live, arc = live[there], arc[there]
            rank[live] += self.skip[arc]
            state[live] = self.target[arc]
            step += 1
        return out

    def ids_of(self, rank: int) -> tuple[int, ...]:
        return tuple(self.ids[self.at[rank] : self.at[rank + 1]].tolist())

    def find(self, word: bytes) -> tuple[int, ...] | None:
        """The ids of a word of the lexicon, or None."""
        rank = int(self.ranks([word])[0])
        return None if rank < 0 else self.ids_of(rank)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] for each start, one after the other."""
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


class Strings:
    """Byte strings by number, for joining many of them at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at, self.octets = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        return gathered(self.octets, self.at[numbers], self.size[numbers]).tobytes()


class Encoder:
    """Texts -> ids. The distinct words of a call take their ids from the automaton, all at once, and the others are
    merged. `remember` bounds the words that are kept from one call to the next."""

    def __init__(self, vocabulary: Vocabulary, automaton: Automaton | None = None, remember: int = 131_072):
        self.vocabulary, self.automaton, self.remember = vocabulary, automaton, remember
        most = max(vocabulary.token) + 1
        self.tokens = Strings([vocabulary.token.get(i, b"") for i in range(most)])
        self.decimals = Strings([b"%d," % i for i in range(most)])
        # Word -> its number; special strings are never words.
        self.known = {x: i for i, x in enumerate(vocabulary.special)}
        self.ids, self.sizes = np.array([*vocabulary.special.values()], np.int64), np.ones(len(vocabulary.special), np.int64)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many it has) of words that are not in the lexicon. Those that begin with a
        blank are merged side by side: the blank keeps them apart, and the lengths of tokens tell where a word ends."""
        led = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
        ids = self.vocabulary.core.encode_to_numpy("".join([words[i] for i in led]), disallowed_special=()).astype(np.int64) if led else np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter((len(words[i].encode()) for i in led), np.int64, len(led)))
        upto = np.searchsorted(np.cumsum(self.tokens.size[ids]), ends, "right")
        at, sizes = np.zeros(len(words), np.int64), np.full(len(words), -1)
        sizes[led] = np.diff(upto, prepend=0)
        at[led] = upto - sizes[led]
        pool, size = [ids], ids.size
        for i in np.flatnonzero(sizes < 0).tolist():
            pool.append(np.array(self.vocabulary.merge(words[i]), np.int64))
            at[i], sizes[i] = size, pool[-1].size
            size += pool[-1].size
        return np.concatenate(pool), at, sizes

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, how many each has)."""
        lexicon = self.automaton
        ranks = lexicon.ranks([w.encode() for w in words]) if lexicon else np.full(len(words), -1)
        unseen, seen = np.flatnonzero(ranks < 0), np.flatnonzero(ranks >= 0)
        pool, starts, merged = self._merged([words[i] for i in unseen.tolist()])
        sizes, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        sizes[unseen], at[unseen] = merged, starts
        if seen.size:
            sizes[seen], at[seen] = np.diff(lexicon.at)[ranks[seen]], lexicon.at[ranks[seen]] + pool.size
            pool = np.concatenate([pool, lexicon.ids])
        return gathered(pool, at, sizes), sizes

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        made = [[*chain.from_iterable([x] if special else words_of(x) for special, x in self.vocabulary.segments(t))] for t in texts]
        flat = list(chain.from_iterable(made))
        new = sorted(set(flat).difference(self.known), key=len)
        kept = len(self.known)
        if new:
            ids, sizes = self._learned(new)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.known.update(zip(new, range(kept, kept + len(new))))
        numbers = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        before = np.concatenate([[0], np.cumsum(self.sizes[numbers])])[np.append(0, ends)]
        out = gathered(self.ids, (np.cumsum(self.sizes) - self.sizes)[numbers], self.sizes[numbers]), np.diff(before)
        # The shortest words stay, as far as there is room.
        stay = max(kept, min(self.remember, kept + bisect_right(new, LONGEST, key=len)))
        for x in new[stay - kept :]:
            del self.known[x]
        self.sizes = self.sizes[:stay].copy()
        self.ids = self.ids[: int(self.sizes.sum())].copy()
        return out

    def encode(self, text: str) -> list[int]:
        return self.encoded([text])[0].tolist()


_SENT: dict[tuple[str, str], str] = {}


def send_file(spark, path: str) -> str:
    """Hand a file to all executors, present and future; its name there."""
    name, app = os.path.basename(path), spark.sparkContext.applicationId
    if (app, name) not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT[app, name] = path
    return name


def texts_of(batch, column: int = 1) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in batch.column(column).to_pylist()]


def _together(texts: list[str]):
    """Lists of texts of about CHUNK characters."""
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted_words(batches):
    """(word, n): words of whole partitions, or of as many as are held at a time."""
    seen: Counter = Counter()
    for b in batches:
        for x in texts_of(b, 0):
            seen.update(words_of(x))
            if len(seen) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, most: int = 65_536, text: str = "text") -> list[str]:
    """At most `most` words of all docs: those that occur at least n times, and more than once, for the least such n.

    Words are counted on every partition and summed; n comes from a histogram of the counts (a bin for each count up to
    1,024, then 16 for each doubling), so no task sees more than its share and the driver gets `most` words at most."""
    ship_code(docs.sparkSession)
    counted = docs.select(F.col(text).cast("binary")).mapInArrow(_counted_words, "word string, n long").filter("length(word) <= 64")
    level = F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor(16 * F.log2(F.col("n") / 1024))).cast("long")
    summed = cut(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("level", level))
    least, total = None, 0
    for r in summed.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        total += r.words
        if total > most:
            break
        least = r.level
    return [] if least is None else [r.word for r in summed.filter(F.col("level") >= least).select("word").toLocalIterator()]


def encode_documents(docs: DataFrame, vocabulary_path: str, lexicon_words: int = 65_536, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with keep_ids also ids array<int>: one row for
    each row of docs, in whole texts.

    Ids are those of the vocabulary's own library without added special tokens; special strings in
    a text are special ids. Null texts count as empty (0 tokens); bytes that are not UTF-8 become
    U+FFFD first. Null and repeated doc_ids come back as they are; an empty table gives no rows; other columns are ignored.
    lexicon_words bounds the automaton; it changes speed only, as other words are merged exactly.
    """
    spark = docs.sparkSession
    ship_code(spark)
    ranks, special = load_vocabulary(vocabulary_path)
    vocabulary = Vocabulary(ranks, special)
    lexicon = {w.encode(): vocabulary.merge(w) for w in frequent_words(docs, lexicon_words, text)}
    name = send_file(spark, Automaton.save(Automaton.compile(lexicon), tempfile.mkdtemp(prefix="passagekit-lexicon-")))
    shared = spark.sparkContext.broadcast((ranks, special))

    def run(batches):
        v = Vocabulary(*shared.value)
        encoder = Encoder(v, Automaton(SparkFiles.get(name)))
        for b in batches:
            counts, ids_out, shas, decoded = [], [], [], []
            for texts in _together(texts_of(b)):
                ids, sizes = encoder.encoded(texts)
                ends = np.cumsum(sizes)
                decimal, octets = encoder.decimals.joined(ids), encoder.tokens.joined(ids)
                to = [np.concatenate([[0], np.cumsum(x.size[ids])])[np.append(0, ends)].tolist() for x in (encoder.decimals, encoder.tokens)]
                counts += sizes.tolist()
                for a, z, c, d in zip(to[0], to[0][1:], to[1], to[1][1:]):
                    shas.append(hashlib.sha256(decimal[a : max(a, z - 1)]).hexdigest())
                    decoded.append(hashlib.sha256(octets[c:d].decode("utf-8", "replace").encode()).hexdigest())
                if keep_ids:
                    ids_out += [x.tolist() for x in np.split(ids, ends[:-1])]
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids_out, pa.list_(pa.int32()))] * keep_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)


def op8_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
