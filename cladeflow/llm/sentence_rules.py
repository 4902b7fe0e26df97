"""Sentence boundaries of one text, given what the corpus says about its ambiguous dots."""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter

# Abbreviations as written before their last dot, lower case, that count as known
# where the corpus has little evidence; those in FINAL also end sentences.
KNOWN = frozenset(
    "mr mrs ms dr prof st sr jr inc ltd co corp no nos vs etc e.g i.e cf approx fig vol pp a.m p.m dept est min max "
    "bzw ca inkl exkl nr lt usw z.b u.a d.h evtl ggf vgl tel str hr fr abs bd geb "
    "mme mlle mm env ex av apr chap éd réf sra srta dra pág págs ej p.ej aprox ud uds núm ee.uu avda "
    "डॉ सं श्री श्रीमती प्रो कि.ग्रा कि.मी रु กก ซม กม มล พ.ศ น ดร ver".split()
)
FINAL = frozenset("a.m p.m etc usw inc ltd co corp jr ee.uu".split())
# Characters.
STRONG = "!?。！？।॥‼⁉⁈⁇．｡"
DOTS = ".…‥"
OPEN, CLOSE = "“«„「『‘‹〈《", "”»“」』’›〉》"
PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "‹": "›", "《": "》", "〈": "〉"}
_EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿️‍⃣"
_CLOSERS = r"[\"'”»“」』’›)\]）】〉》]"
_RUN = re.compile(rf"[{STRONG}{DOTS}](?:[{STRONG}{DOTS}]|[   ](?=[!?]))*")
_TAIL = re.compile(rf"(?:{_CLOSERS}|[   ][»])*(?:[  ]?[{_EMOJI}]+)*")
_BLOCK = re.compile(r"\n[^\S\n]*\n\s*|\n(?=- )")
_TOKEN = re.compile(r"[^\s()\[\]{}\"'«»„“”‘’¿¡「」『』,;:!?…。！？।，、：—–/]+\Z")
_WORD = re.compile(r"[^\W_]+")
_SHOWN = re.compile(r"\S")
_INSIDE = re.compile(r"(?<=[^\W\d_A-Z][ ,])[^\W\d_a-z][^\W_]*|(?<=[^\W\d_A-Z], )[^\W\d_a-z][^\W_]*")
_NEXT = re.compile(r"[\s\"'«»„“”‘’¿¡(]*([^\W\d_]+(?:[ऀ-ॣ०-ॿ]*))")


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin" if c.isalpha() else "other"
    if 0x900 <= o < 0x980:
        return "hindi"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xFF66 <= o < 0xFFA0 or 0x20000 <= o < 0x30000 or c in "々ー〆":
        return "cjk"
    return "other"


def _ahead(text: str, i: int, e: int) -> int:
    """The first place from i on that is no white space; e if there is none."""
    m = _SHOWN.search(text, i, e)
    return m.start() if m else e


def _behind(text: str, i: int, s: int) -> int:
    """The end, at or before i, of what stands there without white space after it; s if there is nothing."""
    while i > s and text[i - 1].isspace():
        i -= 1
    return i


#: A token of more dotted parts is glued words or a list, no abbreviation.
MOST_PARTS = 8


def _token(text: str, at: int, start: int) -> str:
    """The run of characters before a place, however long; no more of it than a few parts beyond MOST_PARTS."""
    width = 64
    while True:
        low = max(start, at - width)
        blank = text.rfind(" ", low, at)
        m = _TOKEN.search(text, max(low, blank + 1), at)
        if not m:
            return ""
        if blank >= 0 or m.start() > low or low == start or m[0].count(".") > MOST_PARTS:
            return m[0]
        width *= 4


def token_before(text: str, at: int, start: int) -> str:
    """The lower-case run of characters before a dot; only its last part where dots glue long words."""
    t = _token(text, at, start).lower().lstrip("-*•")
    if "." in t:
        parts = t.split(".")
        if len(parts) > MOST_PARTS or any(len(p) > 3 for p in parts):
            t = parts[-1]
    return t


def last_word(text: str, at: int, start: int) -> str:
    """The last word before an ellipsis, over blanks."""
    return _token(text, _behind(text, at, start), start).lower()


def next_word(text: str, at: int, end: int) -> str:
    m = _NEXT.match(text, at, end)
    return m[1] if m else ""


@functools.lru_cache(maxsize=4)
def is_cased(text: str) -> bool:
    """Whether upper and lower case both occur, so that case can tell something."""
    up = sum(map(str.isupper, text))
    return up > 0 and up < sum(map(str.islower, text))


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a dash line) of the stretches between empty lines and around dash lines."""
    cuts, at = [], 0
    for m in _BLOCK.finditer(text):
        cuts.append((at, m.start()))
        at = m.end()
    cuts.append((at, len(text)))
    out = []
    for s, e in cuts:
        if text.startswith("- ", s):
            stop = text.find("\n", s, e)
            if stop >= 0:
                out += [(s, stop, True), (stop + 1, e, False)]
                continue
        out.append((s, e, text.startswith("- ", s)))
    return out


def spans(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Pairs of quote marks and of round brackets within a block, outermost first found."""
    out, stack, straight = [], [], 0
    for m in _MARK.finditer(text, s, e):
        i, c = m.start(), m[0]
        if c == '"':
            if straight:
                while stack[-1][1] != '"':
                    stack.pop()
                out.append((stack.pop()[0], i))
                straight = 0
            else:
                stack.append((i, '"'))
                straight = 1
        elif stack and c in stack[-1][1]:
            out.append((stack.pop()[0], i))
        elif c in PAIRS:
            stack.append((i, PAIRS[c]))
        elif c in "(（":
            stack.append((i, ")" if c == "(" else "）"))
    return out


_MARK = re.compile('["()（）' + "".join(PAIRS) + "".join(PAIRS.values()) + "]")


def _opened_inside(text: str, o: int, s: int) -> bool:
    """Whether a sentence is under way where a quote opens."""
    i = _behind(text, o, s)
    return i > s and text[i - 1] not in STRONG + DOTS + CLOSE + '"' and not re.match(f"[{_EMOJI}]", text[i - 1])


class Evidence:
    """Counts of one text or of many: what follows dotted tokens, ellipses, quotes and numbers.

    Features: c - the sentence goes on, u - a capital or a script without case follows, e - it
    ends for sure, w - a word without a dot, k - only that the key occurs, and what counts within
    one text only: o - lower case follows (also in c), p - a comma or the like follows (also in
    c), a and l - all sentences that start for sure and those of them in lower case.
    """

    def __init__(self) -> None:
        self.n: Counter = Counter()

    def add(self, kind: str, a: str, b: str, feature: str, n: int = 1) -> None:
        self.n[kind, a, b, feature] += n

    def starts(self, word: str) -> None:
        self.add("i", "", "", "a")
        if word[0].islower():
            self.add("i", "", "", "l")

    @classmethod
    def of(cls, text: str) -> Evidence:
        """What one text says for itself: of words without a dot only those that it also has as dotted tokens count."""
        own = cls()
        own.read(text, False)
        dotted = {a for (kind, a, _, f) in own.n if kind == "d" and f in "op"}
        if dotted:
            for s, e, dash in blocks(text):
                for m in () if dash else _WORD.finditer(text, s, e):
                    if text[m.end() : m.end() + 1] != "." and (w := m[0].lower()) in dotted:
                        own.add("d", w, "", "w")
        return own

    def read(self, text: str, words: bool = True) -> None:
        """Adds the counts of a text; words: also of the words without a dot."""
        cased = is_cased(text)
        for s, e, dash in blocks(text):
            if dash:
                continue
            first = next_word(text, s, e)
            if first:
                self.add("s", first.lower(), "", "e")
                self.starts(first)
            for m in _RUN.finditer(text, s, e):
                run, at, end = m[0], m.start(), m.end()
                tail = _TAIL.match(text, end, e).end()
                nxt = text[tail : tail + 1]
                w = next_word(text, tail, e)
                ended = tail >= e
                emoji = tail > end and re.match(f"[{_EMOJI}]", text[tail - 1]) is not None
                closed = tail > end and not emoji
                blank = nxt.isspace() or not nxt
                shown = _ahead(text, tail, e)
                follows = text[shown : min(shown + 1, e)]
                if closed and text[end : end + 1] not in ")]）":
                    if w:
                        kind = "c" if follows.islower() and cased else "u"
                        self.add("q", w.lower(), "", kind)
                    continue
                if any(c in STRONG for c in run):
                    if w and blank:
                        self.add("s", w.lower(), "", "e")
                        self.starts(w)
                    continue
                if closed:
                    continue
                if run == ".":
                    t = token_before(text, at, s)
                    if not t:
                        continue
                    if t.isdigit():
                        if w and blank and not ended:
                            self.add("n", w.lower(), "", "c")
                        continue
                    self.add("d", t, "", "k")
                    if "." in t:
                        self.add("d", t.rsplit(".", 1)[1], "", "k")
                    self.add("f", t, w.lower(), "k")
                    if ended or emoji:
                        self.add("d", t, "", "e")
                    elif blank and "\n" not in text[tail:shown]:
                        if follows.isdigit() or follows in ",;:)":
                            self.add("d", t, "", "c")
                            if not follows.isdigit():
                                self.add("d", t, "", "p")
                        elif cased and follows.islower():
                            self.add("d", t, "", "c")
                            self.add("d", t, "", "o")
                            self.add("f", t, w.lower(), "c")
                        elif cased or script(follows or " ") not in ("latin", "other"):
                            self.add("d", t, "", "u")
                    elif nxt and nxt in ",;:":
                        self.add("d", t, "", "c")
                        self.add("d", t, "", "p")
                else:
                    t = last_word(text, at, s)
                    if t:
                        self.add("e", t, "", "k")
                    if t and (ended or emoji):
                        self.add("e", t, "", "e")
                    elif t and cased:
                        self.add("e", t, "", "c" if follows.islower() else "u")
            if words:
                plain = [m[0].lower() for m in _WORD.finditer(text, s, e) if text[m.end() : m.end() + 1] != "."]
                self.n.update(("d", w, "", "w") for w in plain)


def bounds(k: int, n: int) -> tuple[float, float]:
    """Least and greatest share that k of n cases agree with (Wilson, 95 % on either side)."""
    z = 2.7  # 1.645 squared
    mid, half = k + z / 2, math.sqrt(z * (k * (n - k) / n + z / 4)) if n else z / 2
    return max(0.0, mid - half) / (n + z), min(1.0, (mid + half) / (n + z))


def classify(kind: str, a: str, c: int, u: int, e: int, w: int, starts: int) -> str:
    """What summed counts say: N - abbreviation that never ends a sentence, L - one that goes on in lower case only, F - one that also ends, C - the sentence goes on, R - a word like others, '' - nothing sure.

    Only shares and what the counts make sure of them are tested, so that a small corpus leaves
    more undecided and a larger one of the same kind says nothing else.
    """
    total = c + u + e
    on, up, end = bounds(c, total), bounds(u, total), bounds(e, total)
    if kind == "d":
        if w > 3 * total:
            return "L" if on[0] > 0.5 else "R"
        if e <= 0.01 * total:
            never = end[1] < 0.1 and (w <= 0.1 * total or len(a) == 1)
            if (c >= 0.5 * total and on[0] > 0.2) or never:
                return "L" if u <= 0.02 * total and up[1] < 0.12 else "N"
        elif c >= 0.2 * total and on[0] > 0.05 and w <= total:
            return "F"
        return "R" if on[1] < 0.25 or (on[1] < 0.5 and w > total) else ""
    if kind == "e":
        return "C" if c > 0.5 * total else "R" if on[1] <= 0.5 else ""
    if kind == "f":
        return "C"
    if kind == "n":
        return "C" if bounds(starts, starts + total)[1] < 0.6 else "R"
    if kind == "q":
        if c > 0:
            return "C" if c >= u else "R"
        return "C" if starts <= 0.02 * u and bounds(starts, starts + u)[1] < 0.5 else ""
    return ""


def merged(own: Evidence, said: dict) -> dict:
    """Decisions for one text: its own unambiguous occurrences first, then the corpus.

    A dot before a comma is unambiguous; one before lower case is if the text surely starts its
    sentences in capitals. A token that the text has without a dot more often is a word there.
    """
    out = dict(said)
    formal = bounds(own.n["i", "", "", "l"], own.n["i", "", "", "a"])[1] < 0.5
    for kind, a, b, feature in list(own.n):
        if kind != "d" or feature not in "op":
            continue
        on = own.n["d", a, "", "p"] + (own.n["d", a, "", "o"] if formal else 0)
        if on <= own.n["d", a, "", "w"]:
            continue
        # a single dot before lower case may be a slip where the corpus is sure of a word
        slip = not own.n["d", a, "", "p"] and bounds(on, on + own.n["d", a, "", "w"])[0] < 0.4
        if slip and said.get(("d", a, "")) == "R":
            continue
        if own.n["d", a, "", "e"]:
            out["d", a, ""] = "F"
        elif out.get(("d", a, ""), "R") == "R":
            out["d", a, ""] = "F" if own.n["d", a, "", "u"] else "N"
    for kind, a, b, feature in list(own.n):
        if kind == "s":
            out["s", a, ""] = "S"
    return out


class Names:
    """Which words of a text are proper names: counts of capitals within sentences and of lower case."""

    def __init__(self, text: str, said: dict) -> None:
        self.text, self.said = text, said

    @functools.cached_property
    def counts(self) -> tuple[Counter, Counter]:
        return Counter(m[0].lower() for m in _INSIDE.finditer(self.text)), Counter(m[0] for m in _WORD.finditer(self.text) if m[0][0].islower())

    def is_name(self, word: str) -> bool:
        """The text has it in capitals where no sentence can start, never in lower case, and never starts a sentence with it for sure; a lone letter is none."""
        inside, lower = self.counts
        w = word.lower()
        return len(w) > 1 and inside[w] > 0 and not lower[w] and ("s", w, "") not in self.said

    def is_common(self, word: str) -> bool:
        """The text has it in lower case and never in capitals within a sentence."""
        inside, lower = self.counts
        return lower[word.lower()] > 0 and not inside[word.lower()]


def wanted(own: Evidence) -> list[tuple[str, str, str]]:
    """The keys that a text would look up."""
    return sorted({(k, a, b) for (k, a, b, f) in own.n if k in "denqf" and f != "w"})


def _abbreviation(t: str, said: dict) -> str:
    got = said.get(("d", t, ""), "")
    if got:
        return "" if got == "R" else got
    if t in FINAL:
        return "F"
    if t in KNOWN or (len(t) == 1 and t.isalpha()):
        return "N"
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", t):
        return "N"
    return _abbreviation(t.rsplit(".", 1)[1], said) if "." in t else ""


def _goes_on(text: str, o: int, k: int, s: int, e: int, cased: bool, said: dict) -> bool:
    """Whether the surrounding sentence continues after the quote or bracket from o to k."""
    end, at = _behind(text, k, o + 1), _ahead(text, k + 1, e)
    bracket = text[k] in ")）"
    if end == o + 1 or at == e:
        return False
    last, first = text[end - 1], text[at]
    if first in ",;:)，、；：）":
        return True
    if last not in STRONG + DOTS:
        return True
    if re.match(f"[{_EMOJI}]", first):
        return False
    if first in STRONG + DOTS:
        return True
    kind = script(first)
    inside = _opened_inside(text, o, s)
    if kind == "cjk":
        return inside or first == "と"
    if kind == "thai":
        return inside and text[k + 1 : k + 2] == first
    if bracket:
        return inside and not (cased and first.isupper())
    w = next_word(text, k + 1, e)
    got = said.get(("q", w.lower(), ""), "")
    if kind == "hindi":
        return got == "C"
    if kind == "latin":
        if cased:
            return first.islower()
        return got == "C"
    return False


def boundaries(text: str, s: int, e: int, cased: bool, said: dict) -> list[int]:
    """Ends of sentences within a block."""
    names = Names(text, said)
    held = sorted((o, k) for o, k in spans(text, s, e) if _goes_on(text, o, k, s, e, cased, said))
    quotes = {c: [m.start() for m in re.finditer(c, text[s:e])] for c in '"“„' if text.find(c, s, e) >= 0}
    out, entered, until = [], 0, -1
    for m in _RUN.finditer(text, s, e):
        run, at, end = m[0], m.start(), m.end()
        while entered < len(held) and held[entered][0] < at:
            until = max(until, held[entered][1])
            entered += 1
        if at < until:
            continue
        tail = _TAIL.match(text, end, e).end()
        tail = _closed(text, s, end, tail, quotes)
        emoji = tail > end and re.match(f"[{_EMOJI}]", text[tail - 1]) is not None
        shown = _ahead(text, tail, e)
        nxt, follows = text[tail : tail + 1], text[shown : min(shown + 1, e)]
        if not follows:
            continue
        before = text[at - 1 : at] if at > s else ""
        if any(c in STRONG for c in run):
            if (follows in ",;:)" or (follows in "，、；：）" and tail > end)) or (script(follows) == "latin" and not nxt.isspace() and follows.islower() and before.isalnum() and run in "!?"):
                continue
            out.append(tail)
            continue
        if emoji:
            if run == "." or script(_last_shown(text, at, s)) != "cjk":
                out.append(tail)
            continue
        if follows in ",;:)，、；：）":
            continue
        if run == ".":
            t = token_before(text, at, s)
            kind = script(before) if before else "other"
            if kind == "thai":
                continue
            if not nxt.isspace() and tail == end:
                # glued: only a capital, an opening mark or another script can begin a sentence
                if before.isdigit() and nxt.isdigit():
                    continue
                fresh = nxt.isupper() or nxt in "¿¡«„“「『\"" or script(nxt) == "cjk"
                a = _abbreviation(t, said)
                if not fresh or len(t) < 2 or a in ("N", "L") or (script(nxt) == "cjk" and kind not in ("latin", "cjk")):
                    continue
                if nxt.isupper() and "." in t and a != "F":
                    continue
                out.append(tail)
                continue
            if not t:
                out.append(tail)
                continue
            w = next_word(text, tail, e)
            if t.isdigit():
                if follows.isdigit() or (cased and follows.islower()) or said.get(("n", w.lower(), "")) == "C":
                    if not (said.get(("n", w.lower(), "")) == "R" and not follows.isdigit()):
                        continue
                out.append(tail)
                continue
            a = _abbreviation(t, said)
            # a capital tells nothing where the text shows that the word is a name, all where it shows that it is none
            capital = a in ("L", "F") and cased and w[:1].isupper() and not _capitals(w)
            if capital and names.is_name(w):
                continue
            if a == "N" or (a == "L" and not capital):
                continue
            if a == "F" and not (capital and names.is_common(w)):
                if follows.isdigit() or said.get(("f", t, w.lower())) == "C" or (cased and follows.islower()):
                    continue
            out.append(tail)
            continue
        # an ellipsis
        if script(_last_shown(text, at, s)) == "cjk":
            continue
        t = last_word(text, at, s)
        got = said.get(("e", t, ""), "")
        if got == "C" or (got != "R" and cased and follows.islower()):
            continue
        out.append(tail)
    return out


def _capitals(rest: str) -> bool:
    """Whether the first word is written in capitals throughout (two letters or more)."""
    m = _WORD.match(rest)
    return bool(m) and len(m[0]) > 1 and m[0].isupper()


def _last_shown(text: str, at: int, s: int) -> str:
    i = _behind(text, at, s)
    return text[i - 1] if i > s else " "


def _closed(text: str, s: int, end: int, tail: int, quotes: dict[str, list[int]]) -> int:
    """The tail without quote marks that open the next sentence; quotes: their places from s on."""
    before = lambda c, i: bisect.bisect_left(quotes.get(c, ()), i - s)
    for i in range(end, tail):
        if text[i] == '"' and before('"', i) % 2 == 0:
            return i
        if text[i] == "“" and before("„", i) <= before("“", i):
            return i
    return tail


_THAI = re.compile("[฀-๿]")
_THAI_GAP = re.compile(r"\s+")


def _thai_cuts(text: str, s: int, e: int) -> list[int]:
    out = []
    for m in _THAI_GAP.finditer(text, s, e):
        a, b = text[m.start() - 1 : m.start()] if m.start() > s else "", text[m.end() : m.end() + 1] if m.end() < e else ""
        if not a or not b or not (script(a) == "thai" or script(b) == "thai"):
            continue
        if any(c.isdigit() or script(c) == "latin" or c == "." for c in (a, b)) or re.match(f"[{_EMOJI}]", b):
            continue
        out.append(m.start())
    return out


def sentences(text: str | None, said: dict) -> list[tuple[int, int]]:
    """(start, end) code point offsets of the sentences of a text, without surrounding white space."""
    if not text:
        return []
    cased = is_cased(text)
    thai = _THAI.search(text) is not None
    out = []
    for s, e, dash in blocks(text):
        cuts = [] if dash else boundaries(text, s, e, cased, said)
        if thai and not dash:
            cuts = sorted(set(cuts) | set(_thai_cuts(text, s, e)))
        at = s
        for cut in [*cuts, e]:
            a, b = at, cut
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            at = max(at, cut)
    return out
