"""State machines of the transcript stream, as pure functions: step(state, event) -> (state, rows).

One core serves batch and stream: passagekit.streaming.drivers folds it over ordered rows of a session, or
keeps its state in Structured Streaming. States are JSON-ready dictionaries, bounded by construction;
all timers run on event time (milliseconds).
"""

from __future__ import annotations

import re

from passagekit.operators.references import AGAIN, BOOKS, Matcher, clean_text, continuation, detect, parse_after, read

_OUTER = re.compile(r"^[^\w]+|[^\w]+$")


def dedup_form(text: str) -> str:
    return " ".join(w for w in (_OUTER.sub("", w) for w in text.lower().split()) if w)


class Router:
    """Which transcript events go on, and why the others do not."""

    def __init__(self, finals: int = 12, least: float = 0.20, least_cloud: float = 0.35, clouds: tuple[str, ...] = ("deepgram", "cloud")):
        self.finals, self.least, self.least_cloud, self.clouds = finals, least, least_cloud, clouds

    def start(self) -> dict:
        return {"partial": "", "finals": []}

    def step(self, state: dict, e: dict) -> tuple[dict, list[dict]]:
        text, final = (e.get("text") or "").strip(), e.get("kind", "final") == "final"
        form = dedup_form(text)
        words = form.split()
        confidence = e.get("confidence") or 0.0
        least = self.least_cloud if e.get("provider") in self.clouds else self.least
        if not text:
            reason = "empty"
        elif re.fullmatch(r"[\[(].*[\])]", text):
            reason = "noise_label"
        elif not any(c.isalnum() for c in text) or len(words) >= 4 and len(set(words)) == 1:
            reason = "non_speech"
        elif final and 0 < confidence < least:
            reason = "low_confidence"
        elif not final and form == state["partial"]:
            reason = "duplicate_partial"
        elif final and form in state["finals"]:
            reason, state = "duplicate_final", {**state, "partial": ""}
        elif final:
            reason, state = "", {"partial": "", "finals": (state["finals"] + [form])[-self.finals :]}
        else:
            reason, state = "", {**state, "partial": form}
        return state, [{**e, "accepted": not reason, "reason": reason}]


class SentenceBuffer:
    """Fragments joined to sentences: flushed at . ! ? and after a silence."""

    def __init__(self, silence_ms: int = 3000):
        self.silence_ms = silence_ms

    def start(self) -> dict:
        return {"text": "", "at": 0}

    def step(self, state: dict, e: dict) -> tuple[dict, list[dict]]:
        out = []
        if state["text"] and e["ts"] - state["at"] >= self.silence_ms:
            out.append({**e, "text": state["text"], "why": "silence"})
            state = self.start()
        text = f"{state['text']} {(e.get('text') or '').strip()}".strip()
        if text and text[-1] in ".!?":
            return self.start(), [*out, {**e, "text": text, "why": "end"}]
        return {"text": text, "at": e["ts"]}, out

    def end(self, state: dict) -> list[dict]:
        return [{"text": state["text"], "why": "forced"}] if state["text"] else []


class Cooldown:
    """Flags an event unless one was flagged less than wait_ms before."""

    def __init__(self, wait_ms: int = 2500, least: float = 0.80):
        self.wait_ms, self.least = min(60_000, max(250, wait_ms)), least

    def start(self) -> dict:
        return {"at": None}

    def step(self, state: dict, e: dict) -> tuple[dict, list[dict]]:
        flag = e["value"] >= self.least and (state["at"] is None or e["ts"] - state["at"] >= self.wait_ms)
        return ({"at": e["ts"]} if flag else state), [{**e, "flagged": flag}]


class Debounce:
    """Passes an event if the last one passed is at least gap_ms old."""

    def __init__(self, gap_ms: int = 150):
        self.gap_ms = gap_ms

    def start(self) -> dict:
        return {"at": None}

    def step(self, state: dict, e: dict) -> tuple[dict, list[dict]]:
        ok = state["at"] is None or e["ts"] - state["at"] >= self.gap_ms
        return ({"at": e["ts"]} if ok else state), ([e] if ok else [])


class Detector:
    """References over fragments: holds an incomplete one for hold_ms, answers "last verse" from the latest five."""

    def __init__(self, hold_ms: int = 15_000, recent: int = 5):
        self.hold_ms, self.recent, self.matcher = hold_ms, recent, Matcher()

    def start(self) -> dict:
        return {"pending": None, "recent": []}

    def _emit(self, state: dict, e: dict, r: dict) -> dict:
        key = [r["book_number"], r["chapter"], r["verse_start"]]
        if not r["chapter_only"] and (not state["recent"] or state["recent"][0][:3] != key):
            state = {**state, "recent": [key, *state["recent"]][: self.recent]}
        return state

    def step(self, state: dict, e: dict) -> tuple[dict, list[dict]]:
        text = clean_text(e.get("text") or "")
        low = text.lower()
        if any(p in low for p in AGAIN) and state["recent"]:
            book, chapter, verse = state["recent"][0]
            return state, [{**e, "book_number": book, "book_name": BOOKS[book - 1], "chapter": chapter, "verse_start": verse, "verse_end": None, "confidence": 0.92, "chapter_only": False}]
        pending, out = state["pending"], []
        if pending and e["ts"] - pending["at"] > self.hold_ms:
            pending = None
        named = self.matcher.named(low)
        if pending and (not named or named[0][2] == pending["book"]):
            said = continuation(low[: named[0][0]] if named else low, pending["book_only"])
            if said:
                chapter, verse = said[0] or pending["chapter"], said[1]
                if verse:
                    r = {"book_number": pending["book"], "book_name": BOOKS[pending["book"] - 1], "chapter": chapter, "verse_start": verse, "verse_end": None, "confidence": 1.0, "chapter_only": False}
                    state = self._emit({**state, "pending": None}, e, r)
                    return state, [{**e, **r}]
                state = {**state, "pending": {**pending, "chapter": chapter, "book_only": False, "at": e["ts"]}}
                if not named:
                    return state, []
                pending = state["pending"]
            elif not named and any(t.kind in "CV" for t in read(low)):
                return {**state, "pending": {**pending, "at": e["ts"]}}, []
        if not named:
            return {**state, "pending": pending}, []
        for r in detect(text, self.matcher, named):
            out.append({**e, **{k: r[k] for k in ("book_number", "book_name", "chapter", "verse_start", "verse_end", "confidence", "chapter_only")}})
            state = self._emit(state, e, r)
            if r["chapter_only"]:
                end = next(b for a, b, _ in named if a == r["start"])
                kinds = "".join(t.kind for t in read(low[end:]))
                pending = {"book": r["book_number"], "chapter": r["chapter"], "book_only": "N" not in kinds, "at": e["ts"]}
                if parse_after(low[end:]) is None:
                    pending = None
            else:
                pending = None
        return {**state, "pending": pending}, out


class ReadingMode:
    """Follows a reader through a chapter.

    Commands come first: "chapter N [verse M]", "next chapter", "previous chapter" and, after a lone "chapter", bare numbers
    ask for another chapter (why `chapter`; the caller answers with its verses); "verse N", "next [verse]", "previous verse", "go back"
    and a number at the start move within this one (why `command`), also out of a pause. Else the words heard since the
    last move decide: where they cover enough of the current verse, only the next one can follow, and must be covered too;
    where they do not, the next or the next but one. After a silence without a match it pauses.

    verses: [[number, [words]], ...] of the chapter, given by the event that starts it."""

    def __init__(self, least: float = 0.40, silence_ms: int = 180_000, most: int = 176):
        self.least, self.silence_ms, self.most = least, silence_ms, most

    def start(self) -> dict:
        return {"verses": [], "chapter": 0, "at": 0, "heard": [], "last": None, "active": False, "expect": None}

    def _chapter(self, state: dict, said: str, tokens: list, kinds: str) -> tuple[int, int | None] | None:
        """(chapter, verse) that is asked for."""
        if state["expect"] == "chapter" and kinds in ("N", "NN"):
            return tokens[0].value, tokens[1].value if kinds == "NN" else 1
        if said == "next chapter":
            return state["chapter"] + 1, None
        if said == "previous chapter":
            return (state["chapter"] - 1, None) if state["chapter"] > 1 else None
        m = re.search(r"C(?P<c>N)(?:.*?V(?P<v>N))?", kinds) or re.match(r"(?P<c>N).*?V(?P<v>N)", kinds)
        if not m:
            return None
        chapter, verse = tokens[m.start("c")].value, tokens[m.start("v")].value if m["v"] else None
        return None if chapter == state["chapter"] and verse is None else (chapter, verse)

    def _verse(self, state: dict, said: str, tokens: list, kinds: str) -> int | None:
        """The place of the verse that is asked for."""
        if said in ("next", "next verse"):
            return state["at"] + 1 if state["at"] + 1 < len(state["verses"]) else None
        if said in ("previous verse", "go back"):
            return state["at"] - 1 if state["at"] else None
        at = kinds.find("V")
        if at >= 0:
            while kinds[at + 1 : at + 2] == "V":
                at += 1
            number = tokens[at + 1].value if kinds[at + 1 : at + 2] == "N" else None
        elif said.startswith("first ") and kinds[1:2] == "N":
            number = tokens[1].value
        else:
            number = tokens[0].value if kinds[:1] == "N" and kinds[1:2] != "N" else None
        return next((i for i, v in enumerate(state["verses"]) if v[0] == number and 1 <= number <= self.most), None)

    def step(self, state: dict, e: dict) -> tuple[dict, list[dict]]:
        if e.get("verses"):
            at = next((i for i, v in enumerate(e["verses"]) if v[0] == e.get("verse")), 0)
            state = {**self.start(), "verses": e["verses"], "chapter": e.get("chapter") or 0, "at": at, "last": e["ts"], "active": True, "expect": state["expect"]}
            return state, [{**e, "verse": e["verses"][at][0], "why": "start"}]
        if not state["active"]:
            return state, []
        low = (e.get("text") or "").lower()
        said, tokens = low.strip().rstrip(".,?! "), read(low)
        kinds = "".join(t.kind for t in tokens)
        if kinds.endswith("C") and "next" not in said and "previous" not in said:
            state = {**state, "expect": "chapter"}
        elif asked := self._chapter(state, said, tokens, kinds):
            state = {**state, "expect": None if asked[1] and kinds != "N" else "verse"}
            return state, [{**e, "chapter": asked[0], "verse": asked[1] or 1, "why": "chapter"}]
        at = self._verse(state, said, tokens, kinds)
        if state["expect"] == "verse" and kinds == "N":
            state = {**state, "expect": None}
        if at is not None:
            return {**state, "at": at, "heard": [], "last": e["ts"]}, [{**e, "verse": state["verses"][at][0], "why": "command"}]
        if e["ts"] - state["last"] > self.silence_ms:
            return {**state, "active": False}, [{**e, "verse": state["verses"][state["at"]][0], "why": "pause"}]
        words = ("".join(c for c in w if c.isalnum() or c == "'") for w in low.split())
        heard = {*state["heard"], *(w for w in words if len(w.encode()) >= 2)}
        state = {**state, "heard": sorted(heard)}

        def covered(i: int) -> bool:
            words = {*state["verses"][i][1]} if i < len(state["verses"]) else set()
            return bool(words) and len(words & heard) / len(words) >= self.least

        at = state["at"]
        if covered(at):
            follows = at + 1 if covered(at + 1) else None
            state = {**state, "last": e["ts"]}
        else:
            follows = next((i for i in (at + 1, at + 2) if covered(i)), None)
        if follows is None:
            return state, []
        return {**state, "at": follows, "heard": [], "last": e["ts"]}, [{**e, "verse": state["verses"][follows][0], "why": "overlap"}]


class VoiceGate:
    """Opens after `opens` loud frames, closes after `closes` quiet ones or `longest` frames; one row for each frame."""

    def __init__(self, threshold: float = 0.005, opens: int = 4, closes: int = 12, longest: int = 240):
        self.threshold, self.opens, self.closes, self.longest = threshold, opens, closes, longest

    def start(self) -> dict:
        return {"open": False, "loud": 0, "quiet": 0, "n": 0}

    def step(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        loud = e["value"] >= self.threshold
        s = {**s, "loud": s["loud"] + 1 if loud else 0, "quiet": 0 if loud else s["quiet"] + 1, "n": s["n"] + s["open"]}
        if not s["open"] and s["loud"] >= self.opens:
            s = {**s, "open": True, "n": 0}
        elif s["open"] and (s["quiet"] >= self.closes or s["n"] >= self.longest):
            s = {**s, "open": False, "loud": 0}
        return s, [{**e, "is_open": s["open"]}]


class RollingPrompt:
    """The last texts, newest first, within a number of characters; forgotten after a silence."""

    def __init__(self, texts: int = 6, chars: int = 1200, silence_ms: int = 45_000):
        self.texts, self.chars, self.silence_ms = texts, chars, silence_ms

    def start(self) -> dict:
        return {"texts": [], "at": None}

    def step(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        texts = [] if s["at"] is not None and e["ts"] - s["at"] > self.silence_ms else s["texts"]
        texts = [e.get("text") or "", *texts][: self.texts]
        return {"texts": texts, "at": e["ts"]}, [{**e, "prompt": " ".join(texts)[: self.chars]}]


class Newest:
    """Rows that lie at most `slack` behind the newest sequence number before them; the rest are stale. Rows without a
    number pass and change nothing."""

    def __init__(self, seq: str = "seq", slack: int = 0):
        self.seq, self.slack = seq, slack

    def start(self) -> dict:
        return {"newest": None}

    def step(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        seq, newest = e.get(self.seq), s["newest"]
        if seq is None:
            return s, [e]
        if newest is not None and seq < newest - self.slack:
            return s, []
        return {"newest": seq if newest is None else max(newest, seq)}, [e]


class Walk:
    """Positions 0..size-1 under `next` and `previous`; one row for each command."""

    def __init__(self, size: int):
        self.size = size

    def start(self) -> dict:
        return {"at": 0}

    def step(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        move = {"next": 1, "previous": -1}.get(e["command"], 0)
        at = max(0, min(self.size - 1, s["at"] + move))
        return {"at": at}, [{**e, "position": at}]


class Queue:
    """Detections to a queue: a verse already there is not added again; a fuller reference replaces an early one
    of the same chapter, else of the same book. `active` is the place of the item that is shown: it stays with that item as
    items go, and an `activate`, `remove` or `clear` command moves it. One row for each change."""

    def start(self) -> dict:
        return {"items": [], "active": None}

    def _command(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        items, active, command, place = s["items"], s["active"], e["command"], e.get("place")
        if command == "clear":
            return self.start(), [{**e, "change": "cleared", "place": None}]
        if place is None or not 0 <= place < len(items):
            return s, []
        if command == "activate":
            return {**s, "active": place}, [{**e, "change": "activated", "place": place}]
        if command == "remove":
            if active is not None and (place < active or place == active == len(items) - 1):
                active = active - 1 if active else None
            items = [*items[:place], *items[place + 1 :]]
            return {"items": items, "active": active if items else None}, [{**e, "change": "removed", "place": place}]
        return s, []

    def step(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        if e.get("command"):
            return self._command(s, e)
        key = [e["book_number"], e["chapter"], 0 if e.get("chapter_only") else e["verse_start"]]
        items = s["items"]
        if key in items:
            return s, []
        early = next((i for i, x in enumerate(items) if x[:2] == key[:2] and not x[2]), None)
        if early is None and key[2]:
            early = next((i for i, x in enumerate(items) if x[0] == key[0] and not x[2]), None)
        if early is not None and key[2]:
            items = [*items[:early], key, *items[early + 1 :]]
            return {**s, "items": items}, [{**e, "change": "refined", "place": early}]
        return {**s, "items": [*items, key]}, [{**e, "change": "added", "place": len(items)}]


class CommandGate:
    """Voice commands, without those that repeat the last handled value within wait_ms."""

    def __init__(self, wait_ms: int = 5000):
        self.wait_ms = wait_ms

    def start(self) -> dict:
        return {"value": None, "at": None}

    def step(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        if e["value"] == s["value"] and e["ts"] - s["at"] <= self.wait_ms:
            return s, []
        return {"value": e["value"], "at": e["ts"]}, [e]


class PlanRun:
    """A plan's items under commands: load (item: how many), activate (item), complete, skip, reset. Completing or skipping the
    active item activates the next one that is open. Every change enters the log, (ts, command, item), which keeps its latest
    `log` entries; a row carries the number of entries that were ever made."""

    def __init__(self, log: int = 200):
        self.log = log

    def start(self) -> dict:
        return {"items": [], "active": None, "log": [], "entries": 0}

    def step(self, s: dict, e: dict) -> tuple[dict, list[dict]]:
        command, items, active = e["command"], list(s["items"]), s["active"]
        about = active
        if command == "load":
            items, active, about = ["pending"] * e["item"], None, None
        elif command == "activate" and 0 <= e["item"] < len(items):
            active = about = e["item"]
        elif command in ("complete", "skip") and active is not None:
            items[active] = "completed" if command == "complete" else "skipped"
            active = next((i for i in range(active + 1, len(items)) if items[i] == "pending"), None)
        elif command == "reset":
            items, active, about = ["pending"] * len(items), None, None
        else:
            return s, []
        log = [*s["log"], [e.get("ts"), command, about]][-self.log :]
        return {"items": items, "active": active, "log": log, "entries": s["entries"] + 1}, [{**e, "active": active, "entries": s["entries"] + 1}]
