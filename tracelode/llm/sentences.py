"""Problem 9: sentences across languages and scripts, by a hidden-event language model.

Layout comes first: blank lines end units, headings and list items are units, a line break ends a unit in scripts
written without spaces. In what remains, every gap between two tokens carries a hidden event, boundary or not. Tokens are
words, and single letters in scripts written without spaces; a mark, what closes after it and citations belong to the
token before them.
The model is a class-based bigram over the token before the gap, the event, and the token after it. Each token type
is one of a mixture of ender (a token that ends sentences), abbreviation (ends none) and both; how often a type stands at
the end of a paragraph, where the event is known, and what follows it elsewhere decide by expectation maximisation. How
much rather a token begins a sentence than goes on with one shows at the beginnings of paragraphs.
A forward-backward pass over all gaps of a paragraph, in which boundaries next to each other are unlikely, gives the
posterior of each event; above one half it is a boundary.

The model is fitted without labels on counts over all documents. Token types that occur LEAST times (without a mark,
LEAST_PLAIN times) are known by name, up to TYPES of either sort, by frequency; the others by their class.

Defined cases: null, empty and blank texts and null ids give no row; repeated rows count once; CRLF counts as a line break. Extra
columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.tables import cut

#: Token types that the model knows by name at most, the most frequent ones, and occurrences that each of them has at least;
#: above CLIP, counts of the others are not told apart.
TYPES, LEAST, CLIP = 100_000, 1, 3
#: Occurrences of a token type without a mark that is known by name, at least.
LEAST_PLAIN = 10

# Scripts written without spaces; marks that end a sentence; what closes after a mark.
UNSPACED = "฀-໿က-႟ក-៿々-〇぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
THAI = "฀-໿က-႟ក-៿"
FULL_MARKS = "。！？｡．"
OTHER_MARKS = "।॥؟۔።᙮։"
MARKS = ".!?…‼⁇⁈⁉" + FULL_MARKS + OTHER_MARKS
_BLANK_LINE = re.compile(r"[\s​-‏⁠﻿­]*\Z")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t ]|\r?\Z)")
_ITEM = re.compile(r"[ \t 　]*(?:[-*+•‣◦▪·–](?=[ \t 　])|\(?\d{1,3}[.)．）](?=[ \t 　])|\d{1,3}、|[①-⑳])")
_UNSPACED = re.compile(f"[{UNSPACED}]")
_LETTER = re.compile(r"[^\W\d_]")
_CLOSERS = "\"'”’»›)\\]」』】〉》）］｣"
_PLACE = re.compile(rf"[{re.escape(MARKS)}]+")
_AFTER = re.compile(rf"[{_CLOSERS}“‘]*")
_LATE = re.compile(r"(?:\s+[»”)\]」』]+)?(?:\s*(?:\[[A-Z]{1,2}\d+(?:\s*[,;]\s*[A-Z]{1,2}\d+)*\]|【\d+[^】]*】))*[.。]?(?:[”»」』)\]]*)")
_THAI_BLANK = re.compile(rf"(?<=[{THAI}\])）」”]) +(?=[“\"(「]?[{THAI}])")
_PARTS = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
_WORDS = re.compile(r"\S+")
_CITED = re.compile(r"\[[A-Z][^\]]*\]|【[^】]*】|[\s.。]+")
_OPENERS = "([{“„«\"'‘¿¡「"
_THAI_LETTER = re.compile(f"[{THAI}]")
_THAI_TYPE = "blank", "ก", "blank"
_LOWER_WORD = re.compile(r"[^\W\d_]+(?![\w.]*\d)")


def _shape(word: str) -> str:
    """The class of a token before a full stop, for types too rare to know."""
    core = word.rsplit(" ", 1)[-1].rstrip(".")
    if not core:
        return "bare"
    if "." in core and not core.replace(".", "").isdigit():
        return "dotted"
    if core.isdigit():
        return f"number{min(len(core), 3)}"
    last = core[-1]
    if not last.isalpha():
        return "other" + ("digit" if last.isdigit() else "sign")
    size = "1" if len(core) == 1 else "2" if len(core) <= 3 else "long"
    return ("upper" if core.isupper() else "title" if core[0].isupper() else "lower" if core[0].islower() else "plain") + size


def _next_class(text: str, at: int, end: int) -> str:
    """The class of the token that begins at text[at]."""
    if at >= end:
        return "end"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c.isupper():
        return "upper"
    if c.islower():
        m = _LOWER_WORD.match(text, at)
        return "lower" if m else "code"
    if c in "“«„\"'‘「『¿¡":
        return "quote"
    if c in "([（":
        return "paren"
    if c.isalpha():
        return "plain"
    return "sign"


NEXT = ("upper", "lower", "code", "digit", "quote", "paren", "plain", "sign")
_AT = {c: i for i, c in enumerate((*NEXT, "end"))}
END = _AT["end"]
KINDS = ("ender", "abbreviation", "both")
#: Sorts of tokens: before a full stop, before other marks, before such marks and what closes after them, Thai before a blank
#: and Thai, without a mark.
STOP, MARK, CLOSED, BLANK, PLAIN = SORTS = ("stop", "mark", "closed", "blank", "plain")
#: Chance that an ender goes on in lower case before paragraphs show theirs, and that an abbreviation ends a paragraph.
SLIP = 0.003
#: Occurrences of a type that count as evidence at most; its shares stay as they are.
EVIDENCE = 100
#: Beginnings of paragraphs that stand against what is seen of a token after a gap.
SHRINK = 20
FIRST_GUESS = {"ender": 0.75, "abbreviation": 0.2, "both": 0.05}
#: Of tokens before marks other than the full stop, and of tokens without a mark.
MARK_GUESS, PLAIN_GUESS = {"ender": 0.98, "abbreviation": 0.01, "both": 0.01}, {"ender": 0.00001, "abbreviation": 0.99, "both": 0.00999}


def _guess(sort: str) -> dict[str, float]:
    return {MARK: MARK_GUESS, PLAIN: PLAIN_GUESS}.get(sort, FIRST_GUESS)


def _plain(token: str) -> tuple[str, str]:
    """The type and the class of a token without a mark: the signs that it ends with, or its word."""
    stop = len(token)
    while stop and unicodedata.category(token[stop - 1])[0] in "PS":
        stop -= 1
    if stop < len(token):
        return token[stop:][-4:], "plain sign" + token[-1]
    word = token.lstrip(_OPENERS)[-20:]
    if any(c.isdigit() for c in word):
        return "9", "plain number"
    if len(word) == 1 and _UNSPACED.match(word):
        return word, "plain unspaced"
    return word, "plain " + ("upper" if word.isupper() else "title" if word[:1].isupper() else "lower" if word[:1].islower() else "letters")


class _Memo(dict):
    """Results of a function by its argument, of the last million of arguments at most."""

    def __init__(self, function) -> None:
        self.function = function

    def __missing__(self, key):
        if len(self) > 1_000_000:
            self.clear()
        self[key] = value = self.function(key)
        return value


_STOPS = _Memo(lambda word: (STOP, word, _shape(word)))


@dataclass
class Model:
    """What is fitted: log odds of a boundary between token types, or classes of them, and the classes of what follows, and
    what tokens after the gap add to their class."""

    types: dict[tuple[str, str], int] = field(default_factory=dict)
    shapes: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, len(NEXT))))
    unseen: dict[str, int] = field(default_factory=dict)
    begins: dict[str, float] = field(default_factory=dict)

    def row(self, left: str | tuple[str, str, str]) -> int:
        """The row of a token before a gap: a token without a mark, or a sort, type and class."""
        sort, word, shape = (PLAIN, *_plain(left)) if isinstance(left, str) else left
        at = self.types.get((sort, word))
        return at if at is not None else self.shapes.get(shape, self.unseen[sort])

    def begin(self, right: str | tuple[str, str, str]) -> float:
        return 0.0 if not isinstance(right, str) else self.begins.get(_plain(right)[0], 0.0)


@dataclass
class Counts:
    """What a corpus shows of one token type before a full stop, or of `times` types alike: how often it ends a paragraph,
    and what follows it elsewhere."""

    word: str
    shape: str
    ends: int
    inner: dict[str, int]
    times: int = 1
    sort: str = STOP

    @property
    def within(self) -> int:
        return sum(self.inner.values())


def fit(types: Iterable[Counts], starts: dict[str, int], words: dict[str, int] | None = None, rounds: int = 6) -> Model:
    """Expectation maximisation over token types. Known events: a gap at a paragraph's end is a boundary, one before a
    word in lower case is one as seldom as paragraphs begin so. Of types that stand for many, only what their class has in
    common is kept. words: how often tokens begin paragraphs."""
    every = sorted(types, key=lambda c: (c.sort, c.word, c.shape, c.ends, sorted(c.inner.items())))
    known = sum(starts.values())
    rates = dict.fromkeys(SORTS, 0.2)
    slip = max(0.0005, min(0.5, (starts.get("lower", 0) + 100 * SLIP) / (known + 100)))
    prior: dict[str, dict[str, float]] = {}
    sorts = {c.shape: c.sort for c in every}
    alike: Counter[tuple[str, int, int, int]] = Counter()  # types of one class and equal evidence have equal shares
    shown = [(c.shape, c.ends, c.within, c.inner.get("lower", 0)) for c in every]
    for c, key in zip(every, shown):
        alike[key] += c.times
    member: dict[tuple[str, int, int, int], dict[str, float]] = {}
    for _ in range(rounds):
        sums: dict[str, Counter[str]] = defaultdict(Counter)
        closed, within = Counter[str](), Counter[str]()
        for (shape, last, inner, lower), times in alike.items():
            base, rate = prior.get(shape, _guess(sorts[shape])), rates[sorts[shape]]
            # a text that is copied many times shows no more than a few do
            scale = min(1.0, EVIDENCE / max(1, last + inner))
            n_end, n, against = scale * last, scale * inner, scale * lower
            # What follows an abbreviation is its own habit, so its share of lower-case words is integrated out.
            habit = math.lgamma(against + 1) + math.lgamma(n - against + 1) - math.lgamma(n + 2)
            logs = {
                "ender": n_end * math.log(rate) + n * math.log(1 - rate) + against * math.log(slip) + (n - against) * math.log(1 - slip),
                "abbreviation": n_end * math.log(SLIP) + habit,
                "both": n_end * math.log(rate / 2) + n * math.log(1 - rate / 2) + habit,
            }
            logs = {k: v + math.log(base[k]) for k, v in logs.items()}
            top = max(logs.values())
            weights = {k: math.exp(v - top) for k, v in logs.items()}
            z = sum(weights.values())
            member[shape, last, inner, lower] = kinds = {k: v / z for k, v in weights.items()}
            for k, v in kinds.items():
                sums[shape][k] += v * min(n_end + n, 20) * times
            closed[sorts[shape]] += last * kinds["ender"] * times
            within[sorts[shape]] += (inner - lower) * kinds["ender"] * times
        rates = {sort: min(0.6, max(0.02, (closed[sort] + 1) / (closed[sort] + within[sort] + 5))) for sort in SORTS}
        prior = {s: {k: (c[k] + 4 * _guess(sorts[s])[k]) / (sum(c.values()) + 4) for k in KINDS} for s, c in sums.items()}
    follows, never, members = {}, {}, [member[key] for key in shown]
    for sort in SORTS:
        first, other = {c: 1.0 for c in NEXT}, {c: 1.0 for c in NEXT}
        last = 0.0
        for c, kinds in zip(every, members):
            if c.sort == sort:
                last += c.ends * kinds["abbreviation"] * c.times
                for after, n in c.inner.items():
                    first[after] += n * kinds["ender"] * c.times * (after != "lower")
                    other[after] += n * kinds["abbreviation"] * c.times
        for after, n in starts.items():
            if after in first:
                first[after] += n
        z1, z0 = sum(first.values()), sum(other.values())
        ratio = {c: math.log((first[c] / z1) / (other[c] / z0)) for c in NEXT}
        follows[sort] = [max(-7.0 if c == "lower" else -2.5, min(1.5, ratio[c])) for c in NEXT]
        never[sort] = min(0.01, (last + 1) / (last + z0 + 100))
    shares = [(c.sort, kinds, True) for c, kinds in zip(every, members) if c.word]
    shares += [(sorts[s], kinds, False) for s, kinds in prior.items()] + [(sort, _guess(sort), False) for sort in SORTS]
    ender = {True: [0.9 if c == "lower" else 0.99 for c in NEXT], False: [max(0.1, min(0.9, 2 * slip)) if c == "lower" else 0.99 for c in NEXT]}
    kinds = np.array([[k[x] for x in KINDS] for _, k, _ in shares])
    either = 1 / (1 + np.exp(-np.array([follows[sort] for sort, _, _ in shares])))
    p = kinds[:, :1] * np.array([ender[named] for _, _, named in shares]) + kinds[:, 1:2] * np.array([[never[sort]] for sort, _, _ in shares]) + kinds[:, 2:] * either
    names = [(c.sort, c.word) for c in every if c.word]
    n, m = len(names), len(names) + len(prior)
    return Model(
        {name: i for i, name in enumerate(names)}, {s: n + i for i, s in enumerate(prior)}, np.log(p / (1 - p)).astype(np.float32), {sort: m + i for i, sort in enumerate(SORTS)}, _begins(every, starts, words or {})
    )


def _begins(types: list[Counts], starts: dict[str, int], words: dict[str, int]) -> dict[str, float]:
    """What each token type adds to its class after a gap: log of how often it begins a paragraph against how often tokens of
    its class do."""
    total: Counter[str] = Counter()
    occurs: dict[str, tuple[int, str]] = {}
    for c in types:
        if c.sort == PLAIN:
            first = _next_class(c.word, 0, len(c.word)) if c.word else {"plain upper": "upper", "plain title": "upper", "plain lower": "lower", "plain number": "digit"}.get(c.shape, "plain")
            total[first] += (c.ends + c.within) * c.times
            if c.word:
                occurs[c.word] = c.ends + c.within, first
    out = {}
    for word, (n, first) in occurs.items():
        if first in ("upper", "lower", "plain"):
            expected = n * min(1.0, starts.get(first, 0) / total[first])
            out[word] = max(-4.0, min(1.5, math.log((words.get(word, 0) + SHRINK) / (expected + SHRINK))))
    return out


def segments(text: str, unspaced: bool) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of headings, list items and stretches of prose, in order."""
    at, kind, begin, end, dense = 0, "", 0, 0, False
    for line in text.split("\n"):
        own, at = at, at + len(line) + 1
        if not line or line.isspace() or _BLANK_LINE.match(line):
            if kind:
                yield kind, begin, end
                kind = ""
            continue
        body = line.rstrip()
        stop = own + len(body)
        if body[0] in "# " and _HEADING.match(body):
            if kind:
                yield kind, begin, end
            yield "heading", own, stop
            kind = ""
            continue
        if _ITEM.match(line):
            if kind:
                yield kind, begin, end
            kind, begin, end = "item", own + len(line) - len(line.lstrip()), stop
            dense = unspaced and _dense(body)
            continue
        now = unspaced and _dense(body)
        if kind and not (dense or now):
            end = stop
        else:
            if kind:
                yield kind, begin, end
            kind, begin, end = "prose", own + len(line) - len(line.lstrip()), stop
        dense = now
    if kind:
        yield kind, begin, end


def _dense(line: str) -> bool:
    """Whether most letters of a line are of scripts written without spaces."""
    n = len(_UNSPACED.findall(line))
    return n > 0 and 2 * n >= len(_LETTER.findall(line))


def _closed(text: str, begin: int, at: int, end: int) -> int:
    """Where the closing signs after a mark end. Quotes that could open what follows are judged by what is open."""
    while at < end:
        c = text[at]
        if c == "“":
            if text.rfind("„", begin, at) <= text.rfind("“", begin, at):
                break
        elif c == "‘":
            if text.rfind("‚", begin, at) <= text.rfind("‘", begin, at):
                break
        elif c == '"':
            if text.count('"', begin, at) % 2 == 0:
                break
        elif c not in "'”’»›)]」』】〉》）］｣":
            break
        at += 1
    return at


def places(text: str, begin: int, end: int) -> Iterator[tuple[int, int, int, tuple[str, str, str]]]:
    """Tokens of text[begin:end] that end with a mark: (where the mark begins, where the token ends, number of the class of
    what follows, the token's sort, type and class)."""
    for m in _PLACE.finditer(text, begin, end):
        first, stop = m.start(), m.end()
        mark = text[stop - 1]
        after = _closed(text, begin, stop, end)
        full = mark in FULL_MARKS or mark == "…" and (first > begin and _UNSPACED.match(text, first - 1) is not None or first > begin and text[first - 1] in "）」”")
        follows = text[after : after + 1]
        blank = after >= end or follows.isspace()
        if not blank and not full:
            if follows == "[" or mark in "!?" and _UNSPACED.match(text, after) or mark in OTHER_MARKS:
                pass
            else:
                continue
        if full and mark == "．" and follows.isdigit():
            continue
        last = _LATE.match(text, after, end).end()
        if last == after and not blank and follows == "[":
            continue
        begin_next = last
        while begin_next < end and text[begin_next].isspace():
            begin_next += 1
        if begin_next < end:
            if last == after and not blank and not full and mark not in OTHER_MARKS and not (mark in "!?" and _UNSPACED.match(text, after)):
                continue
            if full and text[last] in "、，,；;：:。)）":  # no token begins with these
                continue
        if mark == "." and stop - first == 1:
            word = _token(text, begin, stop)
            key = _STOPS[word]
        else:
            closers = _CITED.sub("", text[stop:last]) if last > stop else ""
            # a mark after a blank and one that closes a quotation are types of their own
            key = CLOSED if closers else MARK, (" " if first > begin and text[first - 1] == " " else "") + text[first:stop][-4:] + closers[:3], f"mark {mark}{closers[:1]}"
        yield first, (end if begin_next >= end else last), END if begin_next >= end else _AT[_next_class(text, begin_next, end)], key


def _marked(text: str, begin: int, end: int, unspaced: bool) -> list[tuple[int, int, int, tuple[str, str, str]]]:
    """The places of text[begin:end] and its blanks between Thai letters, in order."""
    found = list(places(text, begin, end))
    if unspaced and _THAI_LETTER.search(text, begin, end):
        ends = {p[1] for p in found}
        for m in _THAI_BLANK.finditer(text, begin, end):
            if m.start() not in ends:
                before = text[m.start() - 1]
                found.append((m.start(), m.start(), _AT[_next_class(text, m.end(), end)], _THAI_TYPE if _THAI_LETTER.match(before) else (BLANK, before, "blank")))
        found.sort(key=lambda p: p[1])
    return found


class _Ids(dict):
    """Numbers of tokens without a mark, and of (sort, type, class) of tokens with one, in the order that they are met, and
    what is known of them by number."""

    def __init__(self, known=lambda key: ()) -> None:
        self.known, self.values = known, []

    def __missing__(self, key) -> int:
        self[key] = n = len(self.values)
        self.values.append((_AT[_next_class(key, 0, len(key))] if isinstance(key, str) else 0, *self.known(key)))
        return n


@dataclass
class Gaps:
    """The tokens of segments of prose, one segment after the other. Each has a gap after it, the last of a segment its end.
    Of marked tokens: number, (sort, type, class), number of the class of what follows, where they end. Between them tokens
    are counted from numbers and places in the text on."""

    tokens: list[str] = field(default_factory=list)
    marked: list[int] = field(default_factory=list)
    keys: list[tuple[str, str, str]] = field(default_factory=list)
    classes: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    near: list[int] = field(default_factory=list)
    counted: list[tuple[int, int]] = field(default_factory=list)
    segments: list[tuple[int, int, int, int]] = field(default_factory=list)

    def add(self, owner: int, text: str, begin: int, end: int, unspaced: bool) -> None:
        """Adds text[begin:end] of text number `owner`."""
        parts = _PARTS.findall if unspaced and _UNSPACED.search(text, begin, end) else None
        tokens, at = self.tokens, begin
        own = len(tokens)
        self.segments.append((own, owner, begin, end))
        for mark, stop, c, key in _marked(text, begin, end, unspaced):
            self.counted.append((len(tokens), at))
            found = parts(text, at, mark) if parts else text[at:mark].split()
            if found:
                tokens += found
            else:
                if len(tokens) > own:
                    self.near.append(len(tokens))
                tokens.append("")
            self.marked.append(len(tokens) - 1)
            self.keys.append(key)
            self.classes.append(c)
            self.stops.append(stop)
            at = stop
        if at < end:
            self.counted.append((len(tokens), at))
            tokens += (parts(text, at, end) if parts else text[at:end].split()) or [""]
            if parts and _THAI_LETTER.match(text, end - 1):  # as before a blank
                self.marked.append(len(tokens) - 1)
                self.keys.append(_THAI_TYPE)
                self.classes.append(END)
                self.stops.append(end)

    def numbered(self, ids: _Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token its number as it stands before its gap and as it stands after one, and the number of the class of
        what follows it."""
        plain = np.fromiter(map(ids.__getitem__, self.tokens), np.int64, len(self.tokens))
        left = plain.copy()
        left[self.marked] = np.fromiter(map(ids.__getitem__, self.keys), np.int64, len(self.keys))
        after = np.append(np.array([v[0] for v in ids.values], np.int64)[plain[1:]], END)
        after[self.marked] = self.classes
        after[[s[0] - 1 for s in self.segments[1:]]] = END
        return left, plain, after

    def ends(self, texts: list[str], chosen: Iterable[int]) -> Iterator[tuple[int, int]]:
        """For chosen tokens, in order, the number of their text and where they end in it."""
        marked = dict(zip(self.marked, self.stops))
        at = k = 0
        scanned, words, begun = -1, iter(()), 0
        for i in chosen:
            while k + 1 < len(self.segments) and self.segments[k + 1][0] <= i:
                k += 1
            _, owner, begin, stop = self.segments[k]
            if i in marked:
                yield owner, marked[i]
                continue
            while at + 1 < len(self.counted) and self.counted[at + 1][0] <= i:
                at += 1
            if at != scanned:
                scanned, (begun, x) = at, self.counted[at]
                words = (_PARTS if _UNSPACED.search(texts[owner], begin, stop) else _WORDS).finditer(texts[owner], x, stop)
            yield owner, next(islice(words, i - begun, None)).end()
            begun = i + 1


def _token(text: str, begin: int, stop: int) -> str:
    """The token that ends at a full stop, without what opens before it."""
    before = text[max(begin, stop - 40) : stop]
    word = before.split()[-1]
    core = word.lstrip(_OPENERS)[-20:]
    if _DIGITS.search(core):
        core = _DIGITS.sub(lambda m: "9" * min(3, len(m[0])), core)
        if core.strip("9.") == "":  # what a number means shows in the word before it
            core = f"{(before[: -len(word)].split() or [''])[-1].lower()} {core}"
    return core


_DIGITS = re.compile(r"\d+")


#: Log odds that a boundary directly after another costs, by the tokens between the two.
NEAR = {0: -4.0, 1: -1.5, 2: -0.5}


def posteriors(odds: list[float], gaps: list[int]) -> list[float]:
    """Chances of boundaries at places with these log odds, by forward-backward; gaps[i] tokens lie between places i − 1
    and i, and close boundaries are unlikely."""
    n = len(odds)
    forward = [(1.0, 0.0)] * n
    cost = [math.exp(NEAR.get(g, 0.0)) for g in gaps]
    up = [math.exp(max(-30.0, min(30.0, o))) for o in odds]
    off = on = 0.0
    for i in range(n):
        off, on = (1.0, up[0]) if i == 0 else (off + on, up[i] * (off + on * cost[i]))
        z = off + on
        off, on = off / z, on / z
        forward[i] = (off, on)
    out = [0.0] * n
    back_off = back_on = 1.0
    for i in range(n - 1, -1, -1):
        off, on = forward[i]
        a, b = off * back_off, on * back_on
        out[i] = b / (a + b)
        if i:
            back_off, back_on = back_off + up[i] * back_on, back_off + up[i] * cost[i] * back_on
            z = back_off + back_on
            back_off, back_on = back_off / z, back_on / z
    return out


#: Chains of more gaps are passed one by one; others side by side, up to SIDE of them; gaps that are held at once.
LONG, SIDE, HELD = 2_000, 2_048, 250_000


def _chances(odds: np.ndarray, apart: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """posteriors() of chains of these lengths, one after the other."""
    out = np.zeros(len(odds))
    begins = np.cumsum(np.append(0, lengths))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    while len(order) and lengths[order[0]] > LONG:
        a, b = begins[order[0]], begins[order[0] + 1]
        out[a:b] = posteriors(odds[a:b].tolist(), apart[a:b].tolist())
        order = order[1:]
    all_up, all_cost = np.exp(np.clip(odds, -30, 30)), np.array([math.exp(NEAR.get(g, 0.0)) for g in range(10)])[apart]
    for k in range(0, len(order), SIDE):
        chains = order[k : k + SIDE]
        n = lengths[chains]
        steps = np.arange(n[0])[:, None]
        held = steps < n
        at = np.where(held, begins[chains] + steps, 0)
        up, cost = np.where(held, all_up[at], 0.0), all_cost[at]
        forward_off, forward_on = np.empty_like(up), np.empty_like(up)
        off, on = np.ones(len(chains)), np.zeros(len(chains))
        for i in range(len(up)):
            off, on = off + on, up[i] * (off + on * cost[i])
            z = off + on
            off, on = off / z, on / z
            forward_off[i], forward_on[i] = off, on
        chance = np.empty_like(up)
        off, on = np.ones(len(chains)), np.ones(len(chains))
        for i in range(len(up) - 1, -1, -1):
            a, b = forward_off[i] * off, forward_on[i] * on
            chance[i] = b / (a + b)
            off, on = off + up[i] * on, off + up[i] * cost[i] * on
            z = off + on
            off, on = off / z, on / z
        out[at[held]] = chance[held]
    return out


def all_ends(texts: Iterable[str], model: Model) -> Iterator[list[int]]:
    """Exclusive ends of the sentences of each text, in order."""
    ids = _Ids(lambda key: (model.row(key), model.begin(key)))
    gaps, held, found = Gaps(), [], []

    def decided() -> list[list[int]]:
        if gaps.tokens:
            left, right, after = gaps.numbered(ids)
            inner = np.flatnonzero(after != END)
            row, begin = np.array([v[1] for v in ids.values], np.int64), np.array([v[2] for v in ids.values])
            odds = model.table[row[left[inner]], after[inner]] + begin[right[inner + 1]]
            firsts = np.array([s[0] for s in gaps.segments])
            lengths = np.diff(np.append(np.searchsorted(inner, firsts), len(inner)))
            apart = np.ones(len(inner), np.int64)
            apart[np.searchsorted(inner, np.intersect1d(inner, gaps.near))] = 0
            for owner, at in gaps.ends(held, inner[_chances(odds, apart, lengths) > 0.5].tolist()):
                found[owner].append(at)
        return [sorted(set(x)) for x in found]

    for text in texts:
        out, unspaced = [], _UNSPACED.search(text) is not None
        for kind, b, e in segments(text, unspaced):
            if kind == "prose":
                gaps.add(len(held), text, b, e, unspaced)
            out.append(e)
        held.append(text)
        found.append(out)
        if len(gaps.tokens) > HELD:
            yield from decided()
            gaps, held, found = Gaps(), [], []
            if len(ids) > 4 * HELD:
                ids = _Ids(ids.known)
    yield from decided()


def ends(text: str, model: Model) -> list[int]:
    """Exclusive ends of the sentences of a text."""
    return next(all_ends([text], model))




def _split(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at = [], []
        for i, found in zip(batch.column(0).to_pylist(), all_ends(batch.column(1).to_pylist(), model)):
            ids += [i] * len(found)
            at += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], names=["doc_id", "end_char"])


def _units(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts = [], batch.column(1).to_pylist()
        for i, text, found in zip(batch.column(0).to_pylist(), texts, all_ends(texts, model)):
            at = 0
            for n, e in enumerate(found):
                rows.append((i, n, e, text[at:e].strip()))
                at = e
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["doc_id", "sentence", "end_char", "text"])


#: The sort of counts of tokens that begin paragraphs.
BEGINS = "begins"


def _counts(texts: Iterable[str]) -> Counter[tuple[str, str, str, int]]:
    """How often (sort, type, class, number of the class of what follows, END at a paragraph's end) occurs before a gap or an
    end; for tokens that begin paragraphs, of the sort BEGINS, their own class instead."""
    out: Counter[tuple[str, str, str, int]] = Counter()
    ids, gaps = _Ids(), Gaps()

    def add() -> None:
        if not gaps.tokens:
            return
        left, plain, after = gaps.numbered(ids)
        keys, counts = list(ids), np.bincount(left * (END + 1) + after)
        for at in np.flatnonzero(counts).tolist():
            key = keys[at // (END + 1)]
            out[(PLAIN, *_plain(key), at % (END + 1)) if isinstance(key, str) else (*key, at % (END + 1))] += int(counts[at])
        for n, owner, b, e in gaps.segments:
            first = gaps.tokens[n]
            out[BEGINS, _plain(first)[0], "", ids.values[plain[n]][0]] += 1

    for text in texts:
        unspaced = _UNSPACED.search(text) is not None
        for kind, b, e in segments(text, unspaced):
            if kind == "prose":
                gaps.add(0, text, b, e, unspaced)
        if len(gaps.tokens) > HELD:
            add()
            ids, gaps = _Ids(), Gaps()
    add()
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = _counts(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in n], pa.string()) for i in range(3)), pa.array([k[3] for k in n], pa.int32()), pa.array(n.values(), pa.int64())], names=["sort", "word", "shape", "after", "n"])


def fitted(documents: DataFrame) -> Model:
    """The model of all documents: counted in their scan's tasks, summed by token type. The types that occur most, at most
    TYPES of them with and without a mark and each LEAST or LEAST_PLAIN times, come to the driver by name; all others as
    numbers of types that have the same class and the same counts up to CLIP, of which there are few."""
    counts = cut(documents.where("length(text) > 0").select("text").mapInArrow(_counted, "sort string, word string, shape string, after int, n bigint").groupBy("sort", "word", "shape", "after").agg(F.sum("n").alias("n")))
    begins = counts.where(F.col("sort") == BEGINS)
    starts = {(*NEXT, "end")[r["after"]]: r["n"] for r in begins.groupBy("after").agg(F.sum("n").alias("n")).collect()}
    columns = ("end", *NEXT)
    types = counts.where(F.col("sort") != BEGINS).groupBy("sort", "word", "shape").agg(*(F.sum(F.when(F.col("after") == _AT[c], F.col("n")).otherwise(0)).alias(c) for c in columns))
    types = cut(types.withColumn("total", sum(F.col(c) for c in columns)))
    plain = F.col("sort") == PLAIN
    named = types.where(~plain & (F.col("total") >= LEAST)).orderBy(F.desc("total"), "word", "sort").limit(TYPES).unionByName(types.where(plain & (F.col("total") >= LEAST_PLAIN)).orderBy(F.desc("total"), "word").limit(TYPES))
    clipped = [F.least(F.col(c), F.lit(CLIP)).alias(c) for c in columns]
    rare = types.join(named.select("sort", "word"), ["sort", "word"], "left_anti").select("sort", "shape", *clipped).groupBy("sort", "shape", *columns).agg(F.count("*").alias("times"))
    known = [Counts(r["word"], r["shape"], r["end"], {c: r[c] for c in NEXT if r[c]}, sort=r["sort"]) for r in named.collect()]
    words = begins.groupBy("word").agg(F.sum("n").alias("n")).join(F.broadcast(named.where(plain).select("word")), "word", "left_semi")
    first = {r["word"]: r["n"] for r in words.collect()}
    return fit(known + [Counts("", r["shape"], r["end"], {c: r[c] for c in NEXT if r[c]}, r["times"], r["sort"]) for r in rare.collect()], starts, first)


def sentence_ends(documents: DataFrame) -> DataFrame:
    """(doc_id, end_char) for each sentence."""
    return documents.select("doc_id", "text").where("length(text) > 0 and doc_id is not null").mapInArrow(partial(_split, model=fitted(documents)), "doc_id bigint, end_char bigint").distinct()


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence, end_char, text) for each sentence."""
    return documents.select("doc_id", "text").where("length(text) > 0 and doc_id is not null").distinct().mapInArrow(partial(_units, model=fitted(documents)), "doc_id bigint, sentence int, end_char bigint, text string")
