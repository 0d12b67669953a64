"""Personal data: fixed patterns, and a semi-Markov conditional random field for the rest.

The patterns give the base spans of whole texts. The field scores whole segments of up to
``LONGEST`` tokens by features of the span (digit groups, separators, checksums, words
before it) and by what kind of segment stands before it, and a dynamic programme chooses
boundaries and kinds jointly. It reads every place where a segment can score: what no
segment can start or end at is outside in any case, so leaving it out changes nothing. Its
spans are added to the base spans.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# ---- base spans -------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A start inside a run of digits never matches where the run's own start does not.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each @ outwards, so that no run of letters is read twice."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base span, by start and then kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field ---------------------------------------------------------------------

#: Tokens that a segment has at most, and tokens of context on either side.
LONGEST, AROUND = 17, 3
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
#: What any segment has: four digits with no letter between, an at sign, or what stands for one before a dot.
_HINT = re.compile(r"[0-9](?:[^A-Za-z0-9]*+[0-9]){3,}|@|[\[({]\s?at\s?[\])}]|\bat\b(?=[^@\n]{1,40}\bdot\b|\s?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:\.[A-Za-z]|\s?[\[({]\s?(?:dot|\.)|\s?dot\b))", re.I)
_MAYBE = re.compile(r"[0-9@]|\bat\b", re.I)
#: What is left of a token, and as many more as a segment with its context has.
_AHEAD = re.compile(r"[A-Za-z0-9]*+(?:\s*+(?:[A-Za-z]++|[0-9]++|[^\sA-Za-z0-9])){0,%d}+" % (LONGEST + AROUND))
_SPAN_START = re.compile(r"[A-Za-z0-9+(]")
_CUES = (("email", "mail", "contact"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "cc", "payment"), ("tel", "phone", "call", "fax", "mobile", "cell", "dial"))
_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sat\s", re.I)
_DOT = re.compile(r"\.|[\[({]\s?dot\s?[\])}]|\sdot\s|\[\.\]", re.I)
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({]\s?at\s?[\])}]|\bat\b)\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[({]\s?dot\s?[\])}]|\bdot\b|\[\.\])\s?[A-Za-z0-9-]+)*(?:\s?(?:\.|[\[({]\s?dot\s?[\])}]|\bdot\b|\[\.\])\s?[A-Za-z]{2,6})", re.I)
_QUAD = re.compile(r"([0-9]{1,3})(?:\.|\[\.\]|\(\.\)|\sdot\s)([0-9]{1,3})(?:\.|\[\.\]|\(\.\)|\sdot\s)([0-9]{1,3})(?:\.|\[\.\]|\(\.\)|\sdot\s)([0-9]{1,3})")
_RUNS = re.compile(r"[0-9]+")
FEATURES = 35


def _features(text: str, start: int, end: int, before: str) -> list[int]:
    """Indices of the whole-span features that hold."""
    s = text[start:end]
    runs = [len(x) for x in _RUNS.findall(s)]
    d = sum(runs)
    letters = any(c.isalpha() for c in s)
    seps = set(_RUNS.sub("", s)) if not letters else set()
    out = [0]
    add = out.append
    if not letters:
        add(1 if d < 7 else 2 if d < 10 else 3 if d == 10 else 4 if d < 14 else 5 if d == 14 or d == 15 else 6 if d <= 19 else 7)
        if s[0] == "+":
            add(8)
        if s[0] == "(" and re.match(r"\([0-9]{3}\)", s):
            add(9)
        if re.match(r"\+[0-9]{1,3} ?\([0-9]{3}\)", s):
            add(10)
        if runs[-3:] == [3, 3, 4]:
            add(11)
        if runs[-1:] == [4] and len(runs) >= 2:
            add(12)
        if runs in ([4, 4, 4, 4], [4, 6, 5]):
            add(13)
        if 14 <= d <= 19:
            add(14 if luhn(_digits(s)) else 15)
        if len(runs) == 1:
            add(16)
        if len(runs) > 6:
            add(17)
        if seps & set(",:/;=*#$%&|"):
            add(18)
        if "\n" in s or "  " in s:
            add(19)
        if re.fullmatch(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}.*", s):
            add(20)
        if s.count("(") != s.count(")"):
            add(21)
        if len({*seps} - set(" ()+")) > 1:
            add(22)
    else:
        add(23)
        if _MAIL.fullmatch(s):
            add(24)
            if _DOT.search(s) and not re.search(r"\sat\s", s, re.I):
                add(25)
            if re.search(r"\bdot\b", s, re.I):
                add(26)
        if d > 6:
            add(27)
    if (m := _QUAD.fullmatch(s)) and all(int(x) <= 255 for x in m.groups()):
        add(28)
    if not (s[-1].isalnum()):
        add(29)
    if (start and text[start - 1].isalnum() and s[0].isalnum()) or (end < len(text) and text[end].isalnum() and s[-1].isalnum()):
        add(30)
    if start and text[start - 1] in "+." or end < len(text) - 1 and text[end] in ".-" and text[end + 1].isalnum():
        add(31)
    if re.search(r"[.,;:]\s", s):  # a sentence or clause ends inside
        add(34)
    add(32 if before else 33)
    return out


class Field:
    """Weights of the field: of features for each kind, and of a kind after another.

    ``w`` has a column for each feature and cue word's kind. ``t[p, k]`` is the weight of a
    segment of kind ``k`` right behind one of kind ``p``; the last row stands for a token
    outside all segments or the text's begin. Tokens outside have weight 0.
    """

    def __init__(self):
        self.w = np.zeros((len(KINDS), FEATURES + len(KINDS)))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS)))

    def segments(self, text: str, tokens: list[tuple[int, int]], blocked: list[bool]) -> list[tuple[int, int, np.ndarray]]:
        """(first, last, features) of each candidate: it starts and ends as an entity may."""
        out = []
        words = [text[s:e].lower() for s, e in tokens]
        for i, (a, _) in enumerate(tokens):
            if blocked[i] or not _SPAN_START.match(text, a):
                continue
            near = words[max(0, i - AROUND) : i]
            cues = [FEATURES + k for k, c in enumerate(_CUES) if any(w in c for w in near)]
            digits = runs = 0
            letters = at = False
            for j in range(i, min(len(tokens), i + LONGEST)):
                if blocked[j]:
                    break
                b, w = tokens[j][1], words[j]
                if w[0].isalpha():
                    letters, at = True, at or w == "at"
                elif w[0].isdigit():
                    digits, runs = digits + len(w), runs + 1
                elif w == "@":
                    letters = at = True
                if not letters and (digits > 19 or runs > 7):
                    break  # no kind of number is as long
                if b - a < 7 or not text[b - 1].isalnum() or (not at if letters else digits < 4):
                    continue
                out.append((i, j, np.array(_features(text, a, b, "x" if cues else "") + cues)))
        return out

    def scores(self, segments) -> np.ndarray:
        return np.array([self.w[:, f].sum(axis=1) for _, _, f in segments]).reshape(len(segments), len(KINDS))

    def decode(self, text: str, tokens: list[tuple[int, int]], blocked: list[bool]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation; tokens outside have score 0."""
        segments = self.segments(text, tokens, blocked)
        if not segments:
            return []
        scores, outside = self.scores(segments), len(KINDS)
        ending: dict[int, list[int]] = {}
        most = scores.max(axis=1) + self.t.max()
        for n, (_, j, _) in enumerate(segments):
            if most[n] > 0:
                ending.setdefault(j, []).append(n)
        # value[j][y]: best score of the first j tokens whose last segment is of kind y, or whose last token is outside
        value = np.full((len(tokens) + 1, outside + 1), -np.inf)
        value[0, outside] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        best_before = [outside] * (len(tokens) + 1)
        for j in range(len(tokens)):
            before = int(value[j].argmax())
            best_before[j + 1] = before
            value[j + 1, outside] = value[j, before]
            for n in ending.get(j, ()):
                by = value[segments[n][0]][:, None] + self.t
                came = by.argmax(axis=0)
                for k, v in enumerate(by.max(axis=0) + scores[n]):
                    if v > value[j + 1, k]:
                        value[j + 1, k] = v
                        back[j + 1, k] = (n, int(came[k]))
        out, j, y = [], len(tokens), int(value[-1].argmax())
        while j:
            if y == outside:
                j, y = j - 1, best_before[j]
            else:
                n, before = back[j, y]
                i, last, _ = segments[n]
                out.append((tokens[i][0], y, tokens[last][1]))
                j, y = i, before
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 12, rate: float = 0.25, decay: float = 1e-3) -> Field:
        """Gradient ascent of the log likelihood: features seen less features expected."""
        ready, outside = [], len(KINDS)
        for text, gold in examples:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            segments = self.segments(text, tokens, [False] * len(tokens))
            marked = {(s, e): k for s, k, e in gold}
            kinds = [marked.get((tokens[i][0], tokens[j][1]), -1) for i, j, _ in segments]
            ends = {segments[x][1] + 1: k for x, k in enumerate(kinds) if k >= 0}
            ready.append((len(tokens), segments, kinds, [ends.get(i, outside) for i, _, _ in segments]))
        squares, squares_t = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(rounds):
            for n, segments, gold, after in ready:
                if not segments:
                    continue
                scores = self.scores(segments)
                ahead, behind = np.full((n + 1, outside + 1), -np.inf), np.full((n + 1, outside + 1), -np.inf)
                ahead[0, outside], behind[n] = 0.0, 0.0
                by_end, by_start = {}, {}
                for x, (i, j, _) in enumerate(segments):
                    by_end.setdefault(j + 1, []).append(x)
                    by_start.setdefault(i, []).append(x)
                for j in range(1, n + 1):
                    ahead[j, outside] = np.logaddexp.reduce(ahead[j - 1])
                    for x in by_end.get(j, ()):
                        way = np.logaddexp.reduce(ahead[segments[x][0]][:, None] + self.t, axis=0) + scores[x]
                        ahead[j, :outside] = np.logaddexp(ahead[j, :outside], way)
                for i in range(n - 1, -1, -1):
                    behind[i] = behind[i + 1, outside]
                    for x in by_start.get(i, ()):
                        to = scores[x] + behind[segments[x][1] + 1, :outside]
                        behind[i] = np.logaddexp(behind[i], np.logaddexp.reduce(self.t + to[None], axis=1))
                whole = np.logaddexp.reduce(ahead[n])
                change, change_t = -decay * self.w, -decay * self.t
                for x, (i, j, f) in enumerate(segments):
                    p = np.exp(ahead[i][:, None] + self.t + (scores[x] + behind[j + 1, :outside])[None] - whole)
                    if gold[x] >= 0:
                        p[after[x], gold[x]] -= 1
                    change_t -= p
                    for k in np.flatnonzero(np.abs(p.sum(axis=0)) > 1e-4):
                        change[k, f] -= p[:, k].sum()
                squares += change**2
                squares_t += change_t**2
                self.w += rate * change / np.sqrt(squares)
                self.t += rate * change_t / np.sqrt(squares_t)
        return self


def examples(number: int = 260, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled texts made by rule: entities in plain and in unusual forms, and look-alikes."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))
    host = lambda: r.choice((word(), f"{word()}.{word()}", f"mail{n(1)}.{word()}"))

    def card() -> str:
        d = r.choice("3456") + n(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def bad() -> str:
        d = card()
        return d[:-1] + str((int(d[-1]) + r.randint(1, 9)) % 10)

    fours = lambda d, s: s.join(d[i : i + 4] for i in range(0, len(d), 4))
    quad = lambda: [str(r.randint(1, 255)) for _ in range(4)]
    plus = lambda: f"+{n(1)} ({r.randint(200, 999)}) {n(3)}-{n(4)}"
    tld = lambda: r.choice(("com", "org", "net", "de", "example.com"))
    made = (
        (0, lambda: f"{word()}@{host()}.{tld()}"), (0, lambda: f"{word()}.{n(2)}@{host()}.{tld()}"), (0, lambda: f"{word()} at {word()} dot {r.choice(('com', 'org', 'net'))}"), (0, lambda: f"{word()}(at){word()}.{r.choice(('com', 'org'))}"), (0, lambda: f"{word()} [at] {word()} [dot] {r.choice(('com', 'org'))}"),
        (1, lambda: ".".join(quad())), (1, lambda: "[.]".join(quad())),
        (2, card), (2, lambda: fours(card(), " ")), (2, lambda: fours(card(), "-")), (2, lambda: fours(card(), ".")),
        (3, plus), (3, plus), (3, lambda: f"+{n(2)} {n(3)} {n(3)} {n(4)}"), (3, lambda: f"({r.randint(200, 999)}) {n(3)}-{n(4)}"), (3, lambda: f"{r.choice(('tel', 'phone', 'call', 'fax'))}: {r.randint(200, 999)}-{n(3)}-{n(4)}"),
    )
    look_alike = (
        bad, lambda: fours(bad(), " "), lambda: f"20{n(2)}-0{r.randint(1, 9)}-1{n(1)} 1{n(1)}:{r.randint(10, 59)}", lambda: f"{n(1)},{n(3)},{n(3)}.{n(2)}", lambda: n(r.choice((7, 8, 9, 10, 11, 12, 13, 22, 26))), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"AKIA{n(4)}{word().upper()}{n(3)}", lambda: " ".join(n(1) for _ in range(9)), lambda: f"{n(3)}-{n(4)}-{n(2)}", lambda: f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: f"{word()} at {word()} and {word()}", lambda: f"we met at {word()} by the red dot then {word()}", lambda: f"@{word()} {word()}", lambda: f"{n(1)}.{n(2)}.{n(1)}", lambda: f"{n(4)}/{n(4)}/{n(4)}", lambda: ".".join(str(r.randint(300, 999)) for _ in range(4)), lambda: f"{n(5)} {n(5)} {n(4)}", lambda: f"{n(3)} {n(4)} {n(3)} {n(2)}",
    )
    out = []
    for _ in range(number):
        text, gold = " ".join(word() for _ in range(r.randint(1, 4))) + " ", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.6:
                kind, make = r.choice(made)
                s = make()
                cue = re.match(r"[a-z]+: ", s) if kind == 3 else None
                gold.append((len(text) + (cue.end() if cue else 0), kind, len(text) + len(s)))
            else:
                s = r.choice(look_alike)()
            text += s + r.choice((" ", " ", ". ", " " + word() + " ", f" {word()} {word()} "))
        out.append((text + word(), gold))
    return out


@functools.cache
def field() -> Field:
    return Field().fit(examples())


def _reach(text: str, at: int) -> int:
    """The end of the ``LONGEST + AROUND`` tokens from ``at`` on."""
    return _AHEAD.match(text, at).end()


def _reach_back(text: str, at: int, until: int) -> int:
    """A place before ``at`` with at least ``LONGEST + AROUND`` whole tokens between, or ``until``."""
    size = 128
    while at - size > until:
        # the first token may be the rest of one
        if sum(1 for _ in _TOKEN.finditer(text, at - size, at)) > LONGEST + AROUND:
            return at - size
        size *= 2
    return min(at, until)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Field) -> list[tuple[int, int, int]]:
    """Spans of the field where a hint is free of base spans; none of them touches one."""
    out: list[tuple[int, int, int]] = []
    windows: list[list[int]] = []
    covered: list[list[int]] = []  # base spans without their overlaps
    for s, _, e in base:
        if covered and s < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0
    for m in _HINT.finditer(text):
        begin, end = m.span()
        while at < len(covered) and covered[at][1] <= begin:
            at += 1
        free, i = end - begin, at
        while i < len(covered) and covered[i][0] < end:
            free -= min(covered[i][1], end) - max(covered[i][0], begin)
            i += 1
        if free < (4 if m[0][-1].isdigit() else 1):
            continue
        a, b = _reach_back(text, begin, windows[-1][1] if windows else 0), _reach(text, end)
        if windows and a <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], b)
        else:
            windows.append([a, b])
    at = 0
    for a, b in windows:
        tokens = [(s, e) for s, e in (m.span() for m in _TOKEN.finditer(text, a, b)) if (s > a or a == 0 or not text[a - 1].isalnum()) and (e < b or b == len(text) or not text[b].isalnum())]
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        blocked, i = [], at
        for s, e in tokens:
            while i < len(covered) and covered[i][1] <= s:
                i += 1
            blocked.append(i < len(covered) and covered[i][0] < e)
        out += model.decode(text, tokens, blocked)
    return out


def spans_of(text: str | None, model: Field) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a whole text, by start and then kind."""
    if not text or not _MAYBE.search(text):
        return []
    base = base_spans(text)
    both = sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in added_spans(text, base, model)])
    return [(KINDS[k], s, e, b) for s, k, e, b in both]


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``, an array of (kind, start, end, base), to every row of ``docs``.

    Positions are code points of the whole text, the end exclusive. Base spans are always
    there, those of two kinds may overlap; the others overlap no base span and not each
    other. Null, empty and clean texts have an empty array. A column ``pii`` is replaced.
    """
    model = field()

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in spans_of(t, model)] for t in s], dtype=object)

    return docs.withColumn("pii", spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``chars`` counted anew if it is there.

    Spans that overlap are replaced together by the first one's kind.
    """
    model = field()

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([redacted(t, spans_of(t, model)) for t in s], dtype=object)

    out = docs.withColumn(text, clean(F.col(text)))
    if chars in docs.columns:
        out = out.withColumn(chars, F.length(text).cast(dict(docs.dtypes)[chars]))
    return out.select(*docs.columns)


def redacted(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for kind, s, e, _ in spans:
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op3; the counts of kinds are of base spans, ``n_spans`` counts all spans."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
