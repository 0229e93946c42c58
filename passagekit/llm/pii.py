"""Operator 2: personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap; boosted trees score each by its format and
the words around it; thresholds on calibrated chances select what is redacted. Spans of the strict
base patterns are always selected, so the model can add spans but never lose one.

The model learns from synthetic candidates made here (fixed seed), not from the corpus, which has no
labels for personal data: half of them fit the trees, a quarter calibrates their scores, and on the last
quarter the thresholds are chosen.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekit.llm.boosting import BoostedTrees, calibrate
from passagekit.llm.rows import map_texts, packed
from passagekit.runtime import ship_code, table

KINDS = ("email", "ip", "card", "phone")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these starts with a run of digits or ends it, so one try for each run finds all.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping matches, found from each @ so that long words cost no second look."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


#: High-recall generators; a span may come from several. Lookbehinds keep each run to one try.
_GENERATORS = {
    "email": [re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}+){1,3}", re.I)],
    "ip": [re.compile(r"(?<![0-9.])[0-9]{1,4}(?: ?[.,] ?[0-9]{1,4}){3}(?![0-9])"), re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")],
    "card": [re.compile(r"(?<![0-9])[0-9](?:[ ._-]{0,2}[0-9]){11,18}(?![0-9])")],
    "phone": [re.compile(r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"), re.compile(r"(?<![0-9])(?:00|0)[0-9]{8,12}(?![0-9])")],
}

#: Words that tell a kind, or that tell it is none, within 40 characters before a span.
_CUES = {
    "email": "email e-mail mail contact write reach address correo courriel".split(),
    "ip": "ip host server address client addr from ping node serveur servidor".split(),
    "card": "card visa mastercard amex credit debit payment pay karte carte tarjeta".split(),
    "phone": "phone tel call mobile cell fax dial sms telefon telephone number whatsapp".split(),
    "none": "version v release section build order isbn invoice tracking id serial chapter page pages figure date year years score ratio part sku ticket reference".split(),
}
_CUE_SETS = {k: frozenset(v) for k, v in _CUES.items()}
_WORD = re.compile(r"[a-z-]+")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that the generators propose."""
    digit = _DIGIT.search(text)
    out = set()
    for kind, patterns in _GENERATORS.items():
        if kind == "email" and not ("@" in text or "[at]" in text or "(at)" in text or " at " in text and " dot " in text) or kind in ("card", "phone") and not digit:
            continue
        for i, p in enumerate(patterns):
            if kind == "ip" and not (digit if i == 0 else "::" in text or digit and ":" in text):
                continue
            out |= {(kind, *m.span()) for m in p.finditer(text)}
    return sorted(out)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = digits_of(span)
    groups = re.findall("[0-9]+", span)
    words = set(_WORD.findall(before)) if before else set()
    near = set(_WORD.findall(before[-14:]))
    low = span.lower()
    return [
        KINDS.index(kind), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count(":"), span.count("@"), span.startswith("+"), "(" in span,
        luhn(digits) if 13 <= len(digits) <= 19 else 0.5, sum(len(g) <= 3 and int(g) <= 255 for g in groups) / max(1, len(groups)), len(set(digits)) / max(1, len(digits)),
        " at " in low, " dot " in low or "dot)" in low or "dot]" in low, sum(c.isalpha() for c in span) / len(span), len(low.rsplit(".", 1)[-1]) if "." in low else 0,
        digits[:1] in ("3", "4", "5", "6"), len(groups) == 3 and len(groups[0]) == 4, len(groups) >= 3 and len(groups[-1]) == 4,
        *(bool(words & _CUE_SETS[k]) for k in (kind, "none")), *(bool(near & _CUE_SETS[k]) for k in (kind, "none")),
        text[start - 1 : start].isalnum(), text[end : end + 1].isalnum(), text[start - 1 : start] in ("$", "#", "=", "/"),
    ]


def _synthetic(rng: random.Random):
    """(text, kind, start, end, is personal) examples: usual, disguised and mistyped personal data, and look-alikes."""
    pick, num = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("ba", "ter", "on", "li", "ra", "men", "so", "ki", "est", "ul")) for _ in range(rng.randint(1, 4)))

    def card(valid: bool, n: int = 16) -> str:
        d = pick("3456") + num(n - 2)
        good = next(c for c in "0123456789" if luhn(d + c))
        return d + (good if valid else pick([c for c in "0123456789" if c != good]))

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def cue(kind: str) -> str:
        return f"{word()} {pick(_CUES[kind])}{pick([':', '', ' is', ' no.'])} "

    plain = lambda: f"{word()} {word()} "
    name, host, end = word() + pick([".", "_", ""]) + word(), word(), pick(["com", "org", "net", "de", "io"])
    octet = lambda: str(rng.randint(0, 255))
    kind = pick(KINDS)
    good = rng.random() < 0.5
    if kind == "email":
        if good:
            at, dot = pick([("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) ")])
            s, left = f"{name}{at}{host}{dot}{end}", cue("email") if at == " at " else pick([plain, lambda: cue("email")])()
        else:
            s, left = pick([f"{word()} at {word()} dot {word()}", f"{word()} at {word()}.{word()}", f"look at {word()}. {word()}"]), plain()
    elif kind == "ip":
        if good:
            s = pick([".".join(octet() for _ in range(4))] * 2 + [" . ".join(octet() for _ in range(4)), ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))])
            left = pick([plain, lambda: cue("ip")])() if "." in s and " " not in s else cue("ip")
        else:
            s = pick([".".join(str(rng.randint(0, 2000)) for _ in range(3)) + f".{rng.randint(256, 9999)}", ".".join(str(rng.randint(0, 30)) for _ in range(4)), f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", ", ".join(str(rng.randint(0, 300)) for _ in range(4))])
            left = cue("none") if s.count(".") == 3 else plain()
    elif kind == "card":
        if good:
            valid = rng.random() < 0.7
            s, left = grouped(card(valid), pick(["", " ", "-", "."])), pick([plain, lambda: cue("card")])() if valid else cue("card")
        else:
            s, left = pick([card(False), num(rng.randint(13, 19)), grouped(card(False), pick([" ", "-"]))]), pick([plain, lambda: cue("none")])()
            if luhn(digits_of(s)):
                return None
    else:
        if good:
            s = pick([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"0{num(2)} {num(3)} {num(4)}"])
            left = cue("phone") if s[0] not in "+(" or rng.random() < 0.5 else plain()
        else:
            s = pick([f"{rng.randint(1800, 2100)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(2)}.{num(2)}.{rng.randint(1900, 2030)}", f"{num(3)} {num(3)} {num(3)}", f"0{num(9)}", f"{num(4)}-{num(4)}-{num(2)}"])
            left = pick([plain, lambda: cue("none")])()
    text = f"{left}{s}{pick([' ', '. ', ', ', '!', ''])}{word()}"
    hit = max((c for c in candidates(text) if c[0] == kind and c[2] > len(left) and c[1] < len(left) + len(s)), key=lambda c: c[2] - c[1], default=None)
    return hit and (text, *hit, good)


def threshold(chance: np.ndarray, true: np.ndarray, precision: float) -> float:
    """The lowest chance c such that of the examples with a chance of at least c, one more false one counted, a share of
    `precision` is true; more than 1 (nothing is selected) if there is none."""
    order = np.argsort(-chance, kind="stable")
    last = np.append(np.diff(chance[order]) != 0, True) if len(order) else np.zeros(0, bool)
    share = np.cumsum(true[order]) / (np.arange(1, len(order) + 1) + 1)
    good = np.flatnonzero(last & (share >= precision))
    return float(chance[order][good[-1]]) if good.size else 1.1


@functools.lru_cache(1)
def model(examples: int = 12000, seed: int = 11, precision: float = 0.98) -> tuple[BoostedTrees, dict[str, tuple[float, float, float]]]:
    """(trees, kind -> (a, b, threshold)): trees from half of the examples, chances from a quarter, thresholds that reach
    `precision` from the rest."""
    rng = random.Random(seed)
    made = [x for x in (_synthetic(rng) for _ in range(examples)) if x]
    x, y = np.array([features(*e[:4]) for e in made], float), np.array([e[4] for e in made], float)
    half, most = len(y) // 2, 3 * len(y) // 4
    trees = BoostedTrees().fit(x[:half], y[:half])
    scores, cuts = trees.score(x), {}
    for k, kind in enumerate(KINDS):
        mine = x[:, 0] == k
        fit, choose = mine.copy(), mine.copy()
        fit[:half], fit[most:], choose[:most] = False, False, False
        a, b = calibrate(scores[fit], y[fit])
        cuts[kind] = (a, b, threshold(1 / (1 + np.exp(-(a * scores[choose] + b))), y[choose], precision))
    return trees, cuts


def _united(spans) -> list[tuple[int, int]]:
    """Spans by start, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(text: str, fitted) -> tuple[list, list]:
    """(base spans, all spans), each by kind and start. A span that the model adds overlaps no other."""
    base = base_spans(text)
    proposed = [c for c in candidates(text)]
    if not proposed:
        return base, base
    trees, cuts = fitted
    scores = trees.score(np.array([features(text, *c) for c in proposed], float))
    ranked = []
    for c, s in zip(proposed, scores):
        a, b, least = cuts[c[0]]
        if (p := 1 / (1 + np.exp(-(a * s + b)))) >= least:
            ranked.append((-p, c[1], -c[2], c))
    taken, added = _united((a, b) for _, a, b in base), []
    for *_, c in sorted(ranked):
        at = bisect_left(taken, c[2], key=lambda s: s[0])  # spans before `at` begin before c ends
        if not at or taken[at - 1][1] <= c[1]:
            taken.insert(at, c[1:])
            added.append(c)
    return base, sorted(base + added, key=lambda c: (KINDS.index(c[0]), c[1], c[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans) -> str:
    """Overlapping spans become one placeholder, named after the first of them."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for each row of docs.

    Whole texts are searched; a null text counts as empty (no spans). Counts and
    base_sha256 are of the base spans; spans also has what the model adds. Positions are code points.
    Null and repeated doc_ids come back as they are; an empty table gives no rows; other columns are ignored.
    """
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        fitted = shared.value
        for b in batches:
            counts, shas, every = [], [], []
            for raw in b.column(1).to_pylist():
                t = (raw or b"").decode("utf-8", "replace")
                base, spans = find_spans(t, fitted)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(spans))
            columns = np.array(counts, np.int64).reshape(-1, 4).T
            arrays = [b.column(0), *map(pa.array, columns), pa.array(shas, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)


def redact_rows(docs: DataFrame) -> DataFrame:
    """(row, text): rows of docs, as one struct, and their texts with placeholders for personal data; a null text stays null."""
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def work():
        fitted = shared.value
        return lambda texts: ([t and redact(t, find_spans(t, fitted)[1]) for t in texts],)

    return map_texts(packed(docs), work, [("text", T.StringType())], [pa.string()])


def op2_candidate_boosting(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
