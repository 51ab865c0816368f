"""Personal data: fixed patterns, and a linear-chain CRF for what they miss.

The patterns find emails, IPv4 addresses, card and phone numbers.  A conditional
random field over word-shape features, trained on the small table LABELLED, gives
each word of a text a tag: outside, or the beginning or the inside of a kind.  What a
beginning and the insides behind it cover is added as a span if its characters hold a
valid value of that kind, written in a way that the patterns don't match.

Words without a mark (a digit, '@', '+' or a bracketed at) and with none within
CONTEXT words have one and the same score.  Where that score outweighs all that
transitions could gain (``Model.certain``, looked up after training), such words are
outside in the best path, and a chain may be cut at them without changing it: Viterbi
runs on what lies between, padded and batched in numpy.  With a model for which this
doesn't hold, whole texts are chains.

Offsets are code points.  A null text has no spans; equal texts have equal spans, so
repeated rows do; of two best paths the one whose tags come first in TAGS is taken;
empty tables give no rows; columns of the input with the names of the results are
replaced.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE = "none"
#: Outside, and for each kind its beginning (odd) and its inside (even).
TAGS = [OUTSIDE, *[f"{part} {kind}" for kind in KINDS for part in ("begin", "inside")]]
FIELDS = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]

#: The labelled table: a text a line, with [kind words] around personal data.
LABELLED = """
write to [email mara.lund@post.example.org] before noon
Contact: [email j_ortega+news@mail.example.com], thanks
send it to [email tom(at)letters.example.net] or call
reach us at [email ann.b[at]mail.example.org]. Bye
her address is [email kim(at)post(dot)example(dot)com] since May
MAIL [email RON@PLACE.EXAMPLE.COM] NOW
mail%%% [email <lou.d@firm.example.com>%%%] and%%%
from [email ***sam@two.example.org***] to
write to@ or @all of them
the price is 3 @ 12.50 each
tagged @anna and @ben5 in it
host [ip 10.20.30.40] is down
server at [ip 192.168.7.25]:8080 answered
route via [ip 172[.]16[.]9[.]14] was cut
IP [ip (203.0.113.77)]. Next
seen [ip 10[.]0[.]3[.]8] twice
hosts [ip 10[.]1[.]2[.]30] [ip 10[.]1[.]2[.]31] are up
both [ip 192-168-1-20] [ip 192-168-1-21] and [ip 10,1,0,9] [ip 10,1,0,8] answered
mails to [email ada(at)post.example.org] [email bo[at]place.example.net] bounced
ask [email cy(at)one.example.com], [email di(at)two.example.com] today
cards [card 4111/1111/1111/1111] [card 5500/0000/0000/0004] were used
blocked [ip 198[.]51[.]100[.]4], again
peer [ip 198.51.100.23%%%] left%%%
address [ip 203-0-113-9] was seen
node [ip 10,0,7,42] replied
version 4.0.1 of the file
release 2.17.3 is out
section 1.2.3.4.5.6 applies
License, Version 2.0. All
under CC BY-NC 4.0.
paid with [card 4111 1111 1111 1111] yesterday
card [card 5500-0000-0000-0004] expires
number [card 4111111111111111] was used
visa [card 4012.8888.8888.1881] ok
her card [card 4111/1111/1111/1111] is lost
pay [card 5105%%% 5105%%% 5105%%% 5100%%%] now%%%
| [card 4222222222222] | total |
card no. [card 3782_822463_10005] on file
call [phone +1 (243) 555-0126] tonight
phone [phone +44 20 7946 0958] or write
tel. [phone +49-30-5550123], room 5
on [phone +1%%% (613)%%% 555-0173%%%] or%%%
fax [phone +33 1 55 50 01 42] works
at [phone ***+1*** (907)*** 555-0119***] all
dial [phone +1/415/555/0133] now
mobile [phone +44_7700_900123] please
reach [phone +1 [212] 555 0147] by six
call [phone (415) 555-0198] after ten
phone: [phone 020 7946 0321] or come
tel [phone 613-555-0182] office
ring [phone (212) 555-0143] or [phone 020 7946 0188] now
mobile [phone 07700 900 456], home
office [phone 415-555-0136] [phone 415-555-0137] both
score +3 points in 2 games
a rise of +12 % in 2019
about 100 people in 1984 and 2001
on 2024-05-17 at 10:45 we met
from 12/31/1999 to 01/02/2000
order 20231145 of 16 items
total 12,500.75 in 3 rows
id 7 and 15 of 20
see pages 110-125 and 130
room 12-b on floor 3
key = "8f14e45fceea167a5a36dedd4bea2543"
token = "A9F0E61A137D86AA9DB53465E0801612"
item no. 8841 or 8842 7
| 14 | 2550 | 318 |
x1 y2 z3 a4b5
part 00-17-22 is sold
lot 2019-0045-118 of 1200
from 1914-1918 and 1939-1945
isbn 978-0-306-40615-7 in print
rows 100 200 300 400 in all
(12) 3456 and (7) 89
one two three four five
The end of the day, and more.
"""


# -- patterns -----------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a start inside a run of digits matches only where the run's own start does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48 << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, from each '@' outwards: in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- the random field ---------------------------------------------------------

CONTEXT = 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@+]|[\[({<]at[\])}>]", re.I)
_RUN = re.compile(r"(X+|x+|9+)")
_DECOR = "*%$#!&~^|<>{}\"'`,;:?=…"
PLAIN = "plain"


def shape(word: str) -> str:
    """Letters to X and x, digits to 9, runs shortened; decoration left out."""
    return _known_shape(word) if len(word) <= 64 else _shape(word)


def _shape(word: str) -> str:
    if not _MARK.search(word):
        return PLAIN
    s = "".join("9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word.strip(_DECOR))
    return _RUN.sub(lambda m: m[0] if len(m[0]) <= 1 else m[0][0] + ("+" if len(m[0]) < 5 else "*" if len(m[0]) < 11 else "#"), s)


#: Shapes of short words are kept, some 10 MB of them at most.
_known_shape = functools.lru_cache(maxsize=1 << 16)(_shape)


def word_features(words: list[str], i: int) -> list[str]:
    """What the field sees of word i; a word and its neighbours give all of it."""
    own = shape(words[i])
    before = shape(words[i - 1]) if i else "begin"
    after = shape(words[i + 1]) if i + 1 < len(words) else "end"
    out = [f"s {own}"]
    if own != PLAIN:
        core = words[i].strip(_DECOR + "()[]*.-")
        digits = sum("0" <= c <= "9" for c in core)
        out += [f"b {before}", f"a {after}", f"n {min(digits, 20)}", f"q {'@' in core}{'(at)' in core or '[at]' in core}", f"p {words[i].strip(_DECOR)[:1] == '+'}", f"d {min(core.count('.'), 4)}"]
        out += [f"l {any(c.isalpha() for c in core)}"]
    else:
        # all words far from digits look the same
        out += [f"b {before}" if before not in (PLAIN, "begin") else "b", f"a {after}" if after not in (PLAIN, "end") else "a"]
    return out


def labelled(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """(words, tags) of each line."""
    rows = []
    for line in table.strip().splitlines():
        words, tags, tag, depth = [], [], 0, 0
        for word in line.split():
            if word[1:] in KINDS and word[0] == "[":
                tag, depth = TAGS.index(f"begin {word[1:]}"), 1
                continue
            own = tag
            if tag:
                tag = own + own % 2  # what follows a beginning is inside
                if (depth := depth + word.count("[") - word.count("]")) <= 0:
                    cut = word.rindex("]")
                    word, tag = word[:cut] + word[cut + 1 :], 0
            words.append(word)
            tags.append(own)
        rows.append((words, tags))
    return rows


@dataclass
class Model:
    index: dict[str, int]
    emission: np.ndarray  # (features + 1, tags); the last row is of unknown features
    transition: np.ndarray  # (tags, tags)
    certain: bool = False  # words far from any mark are outside in every best path

    def scores(self, words: list[str], first: int, last: int) -> np.ndarray:
        unknown = len(self.index)
        return np.array([self.emission[[self.index.get(f, unknown) for f in word_features(words, i)]].sum(0) for i in range(first, last)])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def expectations(e: np.ndarray, transition: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains (n, length, tags) of scores, of which ``live`` words count: the log
    of each one's sum over all paths, each word's chance of each tag, and the
    expected number of each transition in all of them."""
    n, length, k = e.shape
    forward, backward = np.zeros((length, n, k)), np.zeros((length, n, k))
    forward[0] = e[:, 0]
    for i in range(1, length):
        new = _logsum(forward[i - 1][:, :, None] + transition, 1) + e[:, i]
        forward[i] = np.where(live[:, i, None], new, forward[i - 1])
    for i in range(length - 2, -1, -1):
        new = _logsum(transition + (e[:, i + 1] + backward[i + 1])[:, None, :], 2)
        backward[i] = np.where(live[:, i + 1, None], new, 0.0)
    total = _logsum(forward[-1], 1)
    chance = np.exp(forward.transpose(1, 0, 2) + backward.transpose(1, 0, 2) - total[:, None, None]) * live[:, :, None]
    pairs = np.zeros((k, k))
    for i in range(1, length):
        p = np.exp(forward[i - 1][:, :, None] + transition + (e[:, i] + backward[i])[:, None, :] - total[:, None, None])
        pairs += p[live[:, i]].sum(0)
    return total, chance, pairs


@functools.lru_cache(maxsize=4)
def train(table: str = LABELLED, steps: int = 300, decay: float = 2e-2) -> Model:
    """Maximum conditional likelihood, by gradients from forward-backward over
    all sentences at once; fixed steps from zero, so each run gets this model."""
    rows = labelled(table)
    index: dict[str, int] = {}
    lists = [[[index.setdefault(f, len(index)) for f in word_features(w, i)] for i in range(len(w))] for w, _ in rows]
    n, length, k, size = len(rows), max(len(w) for w, _ in rows), len(TAGS), len(index)
    slots = max(len(f) for row in lists for f in row)
    at = np.full((n, length, slots), size)
    gold, live = np.zeros((n, length), int), np.zeros((n, length), bool)
    for r, (row, (_, tags)) in enumerate(zip(lists, rows, strict=True)):
        for i, f in enumerate(row):
            at[r, i, : len(f)], gold[r, i], live[r, i] = f, tags[i], True
    truth = np.eye(k)[gold] * live[:, :, None]
    steps_gold = sum(np.eye(k * k)[gold[:, i - 1] * k + gold[:, i]][live[:, i]].sum(0) for i in range(1, length)).reshape(k, k)
    emission, transition = np.zeros((size + 1, k)), np.zeros((k, k))
    square_e, square_t = np.full_like(emission, 1e-8), np.full_like(transition, 1e-8)
    for _ in range(steps):
        _, chance, pairs = expectations(emission[at].sum(2), transition, live)
        slope = np.zeros_like(emission)
        np.add.at(slope, at, np.broadcast_to((truth - chance)[:, :, None, :], (*at.shape, k)))
        slope[size] = 0.0
        slope -= decay * emission
        slope_t = steps_gold - pairs - decay * transition
        square_e += slope**2
        square_t += slope_t**2
        emission += 0.5 * slope / np.sqrt(square_e)
        transition += 0.5 * slope_t / np.sqrt(square_t)
    model = Model(index, emission, transition)
    model.certain = bool(plain_margin(model) > 0)
    return model


def plain_margin(model: Model) -> float:
    """By how much at least a path gains if a word far from any mark is outside in
    it, whatever stands on either side."""
    plain, t = model.scores([""] * 5, 2, 3)[0], model.transition
    gains = [plain[0] - plain[k] + (t[:, 0] - t[:, k]).min() + (t[0] - t[k]).min() for k in range(1, len(TAGS))]
    return float(min(gains))


def viterbi(model: Model, chains: list[np.ndarray]) -> list[np.ndarray]:
    """The best tags of each chain of scores; chains of like length together.
    A word that is certain to be outside stands before and after each."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
    order = sorted(range(len(chains)), key=lambda c: len(chains[c]))
    start = 0
    while start < len(order):
        stop = start + 1
        longest = len(chains[order[start]])
        while stop < len(order) and len(chains[order[stop]]) <= longest * 1.25 + 2 and (stop - start) * len(chains[order[stop]]) < 1 << 17:
            stop += 1
        mine = order[start:stop]
        length = len(chains[mine[-1]])
        k = len(TAGS)
        e = np.full((len(mine), length, k), -1e9)
        e[:, :, 0] = 0.0  # past a chain's end: outside
        for r, c in enumerate(mine):
            e[r, : len(chains[c])] = chains[c]
        best = model.transition[0] + e[:, 0]
        back = np.zeros((length, len(mine), k), np.int8)
        for i in range(1, length):
            ways = best[:, :, None] + model.transition
            back[i] = ways.argmax(1)
            best = ways.max(1) + e[:, i]
        tag = (best + model.transition[:, 0]).argmax(1)
        tags = np.zeros((len(mine), length), np.int8)
        for i in range(length - 1, -1, -1):
            tags[:, i] = tag
            tag = back[i][np.arange(len(mine)), tag]
        for r, c in enumerate(mine):
            out[c] = tags[r, : len(chains[c])]
        start = stop
    return out


# -- added spans --------------------------------------------------------------

_AT = re.compile(r"\s*[\[({<]at[\])}>]\s*", re.I)
_DOT = re.compile(r"\s*[\[({<](?:dot|\.)[\])}>]\s*", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_FIRST, _LAST = re.compile(r"[A-Za-z0-9+]"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The part of text[a:b] without what surrounds a value; b <= a if that is all."""
    m = _FIRST.search(text, a, b)
    a = m.start() if m else b
    while b > a and text[b - 1] not in _LAST:
        b -= 1
    return a, b


def valid(kind: int, piece: str) -> bool:
    """Whether the piece holds a value of the kind, however it is written.  A phone
    number without a country's code stands in two groups of digits at least."""
    if kind == 0:
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", _BLANKS.sub(" ", piece)))))
    if any(c.isalpha() for c in piece):
        return False
    digits = _NOT_DIGIT.sub("", piece)
    if kind == 1:
        parts = _NOT_DIGIT.split(piece)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and (piece[0] == "+" or piece != digits)


def _islands(words: list[str]) -> list[tuple[int, int]]:
    """Ranges of words which have a mark within CONTEXT words."""
    out: list[tuple[int, int]] = []
    for i, w in enumerate(words):
        if _MARK.search(w):
            a, b = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
            if out and out[-1][1] >= a:
                out[-1] = out[-1][0], b
            else:
                out.append((a, b))
    return out


def entities(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, kind, word behind the last) of what the tags cover.  An inside
    that follows nothing of its kind begins one."""
    out: list[tuple[int, int, int]] = []
    for i, tag in enumerate(tags.tolist()):
        if not tag:
            continue
        kind = (tag - 1) // 2
        if tag % 2 == 0 and out and out[-1][1:] == (kind, i):
            out[-1] = out[-1][0], kind, i + 1
        else:
            out.append((i, kind, i + 1))
    return out


def find(texts: list[str | None], model: Model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, as (start, number of the kind, end)."""
    found, chains, places = [], [], []
    for t, text in enumerate(texts):
        if not text or not _MARK.search(text):
            found.append(([], []))
            continue
        base = base_spans(text)
        found.append((base, list(base)))
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        for a, b in _islands(words) if model.certain else [(0, len(words))]:
            chains.append(model.scores(words, a, b))
            places.append((t, spans[a:b]))
    starts, reach = {}, {}
    for tags, (t, spans) in zip(viterbi(model, chains), places, strict=True):
        base, every = found[t]
        if t not in starts:
            starts[t], reach[t] = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
        for first, kind, behind in entities(tags):
            a, b = trimmed(texts[t], spans[first][0], spans[behind - 1][1])
            ahead = bisect.bisect_left(starts[t], b)  # base spans that begin before b
            if a < b and not (ahead and reach[t][ahead - 1] > a) and valid(kind, texts[t][a:b]):
                every.append((a, kind, b))
    return [(base, sorted(every)) for base, every in found]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, *, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with FIELDS: counts of base spans, base spans, all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def kernel(col: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
        found = find(col.to_pylist(), sent.value)
        counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
        return [*counts, pa.array([listed(b) for b, _ in found], pa.string()), pa.array([listed(s) for _, s in found], pa.string())]

    return common.annotate(docs, text_col, kernel, FIELDS)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, as its first kind."""
    out, at, end = [], 0, -1
    for a, k, b in spans:
        if a >= end:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, *, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """All documents, with personal data masked; n_chars, if there, follows the
    text where that has changed."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def kernel(col: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
        texts = col.to_pylist()
        return [pa.array([masked(t, s) if s else t for t, (_, s) in zip(texts, find(texts, sent.value), strict=True)], pa.string())]

    field = T.StructField("_masked", T.StringType())
    out = common.annotate(docs, text_col, kernel, [field])
    changed = ~F.col("_masked").eqNullSafe(F.col(text_col))
    new = {text_col: F.col("_masked")}
    if "n_chars" in docs.columns:
        new = {"n_chars": F.when(changed, F.length("_masked")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType), **new}
    return out.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns])
