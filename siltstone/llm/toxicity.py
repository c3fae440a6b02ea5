"""Toxicity with noisy-channel deobfuscation.

A writer's intended letters pass a channel that swaps look-alike glyphs for
letters, spells words out with separators and repeats letters.  Stretches of
text that the channel may have touched become lattices, with an edge for each
reading of a glyph; Viterbi decoding under a character trigram model, mixed
from the whole corpus and the toxic words, picks the best path.  A stretch in
which no glyph has a second reading has a single path and needs no decoding,
so most text is passed over.  Doubled letters, and separators within words, are
second readings too; where no reading of a word could begin as the lexicon's
words do, its lattice is not decoded, as that could not change a score.

Restored texts are scored by a Poisson likelihood ratio.  Words and word
beginnings that are frequent in documents labelled toxic and rare in others
form a lexicon, learned from one half of a bounded sample of labelled rows;
rates by strength, and the threshold, come from the other half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import as_strings, raw, released, slices, stored

#: What each glyph may stand for, besides itself.
GLYPHS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s",
}
_LETTER = r"[^\W\d_]"
_ANY = rf"(?:{_LETTER}|[0-9@$!|+(])"
_SEP = r"[ .\-_*~]"
#: Single glyphs with separators, of any number and kind, between: a word spelled out.
SPELLED = re.compile(rf"{_ANY}(?:{_SEP}+{_ANY}){{2,}}(?!{_ANY})")
_SEPARATORS = re.compile(rf"{_SEP}+")
#: What is left of a window after a word spelled out, or all of it, where the word may go on beyond.
_GOES_ON = re.compile(rf"{_SEP}*{_ANY}?")
_OPEN = re.compile(rf"{_ANY}(?:{_SEP}+{_ANY})?{_SEP}+")
#: A run of glyphs, or several with separators that are no space between: a word in pieces.
_RUN = re.compile(rf"{_ANY}+(?:[.\-_*~]+{_ANY}+)*")
_INNER = re.compile(r"[.\-_*~]+")
#: Marks after a word are punctuation, and so are the same mark thrice or more.
_MARKS = re.compile(r"(?:[!|+(]|([$@])\1\1+)+$")
_TWICE = re.compile(rf"({_LETTER})\1")
_CYRILLIC = re.compile(r"[а-яѕі]")
WORD = re.compile(rf"{_LETTER}+")
#: The readings of stretches of more characters are not remembered.
LONGEST = 64
#: Bytes in which a word spelled out is looked for first; twice as many each time it goes on.
_WINDOW = 256
_LOG_SUBSTITUTE, _LOG_KEEP, _LOG_REPEAT, _LOG_DOUBLE = math.log(0.2), math.log(0.001), math.log(0.3), math.log(0.1)
_LOG_SPACE = math.log(0.05)
#: Of a separator within a word that the channel put there.
_LOG_PIECES = math.log(0.1)
BOUNDS = (3.0, 4.0, 5.0, 6.0)
_SYMBOLS = 32
_CODE = {c: k + 1 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def _code(c: str) -> int:
    """A letter's number, 27 for letters of other alphabets, 0 for a boundary."""
    return _CODE.get(c) or (27 if c.isalpha() else 0)


def _byte_codes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for c, k in _CODE.items():
        table[ord(c)] = table[ord(c.upper())] = k
    table[0xC0:] = 27
    return table


def _char_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _byte_codes()
    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = raw(as_strings(part.column("text")))
            codes = np.zeros(len(data) + len(offsets) + 1, np.int64)
            at = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets)) + 1
            codes[at] = table[data]
            # the later bytes of a letter are not letters of their own
            keep = np.ones(len(codes), bool)
            keep[at[(data & 0xC0) == 0x80]] = False
            codes = codes[keep]
            codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])] if len(codes) else codes
            if len(codes) > 2:
                total += np.bincount((codes[:-2] * _SYMBOLS + codes[1:-1]) * _SYMBOLS + codes[2:], minlength=len(total))
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["gram", "n"])


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts of the characters of all texts (a fixed number of cells, whatever the corpus)."""
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(released(_char_counter), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(_SYMBOLS**3)
    for r in rows.collect():
        out[r.gram] = r.n
    return out.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)


def log_model(counts: np.ndarray, words: list[str], share: float = 0.5) -> np.ndarray:
    """log P(c | a, b), interpolated over three orders, mixed of the corpus and a list of words."""

    def interpolated(n: np.ndarray) -> np.ndarray:
        one = (n.sum(axis=(0, 1)) + 0.1) / (n.sum() + 0.1 * _SYMBOLS)
        two = (n.sum(axis=0) + 5 * one) / (n.sum(axis=(0, 2))[:, None] + 5)
        return (n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)

    own = np.zeros_like(counts)
    for w in words:
        c = [0, *(_code(x) for x in w), 0]
        own[0, 0, c[1]] += 1
        for a, b, d in zip(c, c[1:], c[2:]):
            own[a, b, d] += 1
    # a word begins after a boundary, whatever was before that
    counts = counts.copy()
    counts[0, 0] = counts[:, 0].sum(axis=0)
    mixed = interpolated(counts) if not words else (1 - share) * interpolated(counts) + share * interpolated(own)
    return np.log(mixed)


def readings(text: str) -> list[list[tuple[str, float]]]:
    """The lattice of a stretch: for every kept glyph, what it may stand for (possibly nothing) and at which cost.

    Separators between single glyphs drop out, or, at a cost, are a space.  A
    run of one letter of three or more stands for one or two of it; a run of two
    for itself, or, at a cost, one.  Separators between longer pieces stay, or,
    at a cost, drop out.
    """
    pieces = _INNER.split(text)
    if " " not in text and len(pieces) > 1 and max(map(len, pieces)) > 1:
        out = readings(pieces[0])
        for sep, piece in zip(_INNER.findall(text), pieces[1:]):
            out += [[(sep, 0.0), ("", _LOG_PIECES)], *readings(piece)]
        return out
    if re.search(_SEP, text):
        glyphs = re.sub(_SEP, "", text)
        return [x for k, c in enumerate(glyphs) for x in ([[("", 0.0), (" ", _LOG_SPACE)]] if k else []) + readings(c)]
    out: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(text):
        c = text[k]
        run = 1
        while k + run < len(text) and text[k + run] == c:
            run += 1
        stands = [(c, 0.0)] if c.isalpha() and c not in GLYPHS else [(c, _LOG_KEEP)]
        stands += [(x, _LOG_SUBSTITUTE) for x in GLYPHS.get(c, "")]
        if run == 1:
            out.append(stands)
        elif run == 2:
            out.append(stands)
            out.append([*stands, ("", _LOG_DOUBLE)])
        else:
            out.append(stands)
            out.append([*[(x, w + _LOG_REPEAT) for x, w in stands], ("", 0.0)])
        k += run
    return out


def _before(a: tuple | None, b: tuple | None) -> bool:
    """Whether the letters of path ``a`` come before those of ``b``, looking back no further than to where they part."""
    shorter = (a[2] if a else 0) < (b[2] if b else 0)
    while a is not b and (a[2] if a else 0) > (b[2] if b else 0):
        a = a[1]
    while a is not b and (b[2] if b else 0) > (a[2] if a else 0):
        b = b[1]
    first = shorter
    while a is not b:
        if a[0] != b[0]:
            first = a[0] < b[0]
        a, b = a[1], b[1]
    return first


def viterbi(lattice: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The best path's letters; ties go to the path that is first in order.

    A path is its last letter, the path before it and its length, so the work
    is linear in the lattice.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for stands in lattice:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for c, cost in stands:
                if c:
                    k = _code(c)
                    key, new = (b, k), (score + cost + model[a, b, k], (c, path, path[2] + 1 if path else 1))
                else:
                    key, new = (a, b), (score + cost, path)
                old = after.get(key)
                if old is None or new[0] > old[0] or (new[0] == old[0] and _before(new[1], old[1])):
                    after[key] = new
        states = after
    best = None
    for (a, b), (score, path) in states.items():
        new = (score + model[a, b, 0], path)
        if best is None or new[0] > best[0] or (new[0] == best[0] and _before(path, best[1])):
            best = new
    path, letters = best[1], []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


def _classes() -> np.ndarray:
    """By byte, in lower case: 1 a letter or part of one, 2 a glyph, 4 a separator, 8 white space."""
    out = np.zeros(256, np.uint8)
    out[ord("a") : ord("z") + 1] = out[0x80:] = 1
    for c in "0123456789@$!|+(":
        out[ord(c)] = 2
    for c in " .-_*~":
        out[ord(c)] = 4
    for c in " \t\n\r\f\v":
        out[ord(c)] |= 8
    return out


_CLASS = _classes()


def squeezed_heads(lexicon: Iterable[str]) -> np.ndarray:
    """By three bytes, whether a feature of the lexicon begins with them once repeated letters are dropped."""
    out = np.zeros(1 << 24, bool)
    for f in lexicon:
        w = f.removesuffix("$").encode()
        w = bytes(c for k, c in enumerate(w) if k == 0 or c != w[k - 1])
        if len(w) > 2:
            out[_first_three(w)] = True
        else:
            # what follows is not known
            at = _first_three(w)
            out[at : at + (1 << (8 * (3 - len(w))))] = True
    return out


def triggers(data: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """Positions in lower-cased bytes where the channel may have been at work; every such stretch has one.

    With ``heads``, words whose only sign is a doubled letter or a separator
    within are passed over where they, with repeated letters and separators
    dropped, do not begin as any feature of the lexicon does: no reading of
    theirs could count.
    """
    # 32 bits are enough for running sums: no text has 2^31 bytes
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    kind = np.zeros(n + 8, np.uint8)
    kind[1 : n + 1] = _CLASS[data]
    letter, glyph, sep = (kind & 1) > 0, (kind & 2) > 0, (kind & 4) > 0
    either = letter | glyph
    hit = np.zeros(n + 8, bool)
    # a glyph next to a letter; white space and mere marks after words drop out when the run is looked at
    mark = np.zeros(n + 8, bool)
    mark[1 : n + 1] = (data == ord("!")) | (data == ord("|")) | (data == ord("+")) | (data == ord("("))
    hit[:-1] |= glyph[:-1] & letter[1:]
    hit[1:-2] |= letter[:-3] & glyph[1:-2] & ~mark[1:-2]
    hit[:-1] |= mark[:-1] & glyph[1:] & ~mark[1:]
    byte = np.zeros(n + 8, np.uint8)
    byte[1 : n + 1] = data
    wide = (byte[:-4] == byte[2:-2]) & (byte[1:-3] == byte[3:-1]) & (byte[:-4] >= 0xC3)
    hit[:-4] |= wide
    # doubled letters, and separators within words
    doubled = np.zeros(n + 8, bool)
    doubled[1:] = (byte[1:] == byte[:-1]) & letter[1:] & (byte[1:] < 0x80)
    space = byte == 32
    inner = sep & ~space
    # a run of separators with a letter or glyph at either end
    before, after = np.zeros(n + 8, bool), np.zeros(n + 8, bool)
    at = np.flatnonzero(inner)
    if len(at):
        begin = np.concatenate([[True], at[1:] != at[:-1] + 1])
        first = at[begin]
        last = np.concatenate([at[:-1][begin[1:]], at[-1:]])
        good = either[first - 1] & either[last + 1]
        before[first[good]] = after[last[good]] = True
        hit[first[good & (glyph[first - 1] != glyph[last + 1])]] = True
    inside = np.zeros(n + 8, np.int8)
    inside[before] += 1
    shifted = np.zeros(n + 8, np.int8)
    shifted[1:][after[:-1]] = 1
    inside = np.cumsum(inside - shifted, dtype=np.int32) > 0
    soft = doubled | before
    if heads is None:
        hit |= soft
    elif soft.any():
        # heads of the pieces of words, without repeated letters and separators within
        kept = np.flatnonzero(~doubled & ~inside)
        own = byte[kept]
        code = np.zeros(len(kept) + 2, np.int32)
        code[:-2] = np.where(letter[kept], own, 0)
        starts = np.flatnonzero(either[kept] & np.concatenate([[True], ~either[kept][:-1] | (np.diff(kept) > 1)]))
        a, b, c = code[starts], code[starts + 1], code[starts + 2]
        b = np.where(a > 0, b, 0)
        c = np.where(b > 0, c, 0)
        good = heads[a << 16 | b << 8 | c]
        # the word around a piece that could count
        word = np.zeros(n + 8, np.int32)
        np.cumsum((either | inside)[1:] & ~(either | inside)[:-1], dtype=np.int32, out=word[1:])
        wanted = np.zeros(int(word[-1]) + 1, bool)
        wanted[word[kept[starts[good]]]] = True
        hit |= soft & wanted[word]
    cyrillic = (byte == 0xD0) | (byte == 0xD1)
    latin = letter & (byte < 0x80)
    hit[1:-2] |= cyrillic[1:-2] & (latin[:-3] | latin[3:])
    # single glyphs, separators between; letters of two bytes count by their last one
    first = either & ~((byte & 0xC0) == 0x80)
    begin = np.zeros(n + 8, bool)
    begin[1:] = first[1:] & ~either[:-1]
    begin[0] = first[0]
    alone = begin.copy()
    alone[:-2] &= np.where(byte[:-2] >= 0xC0, ~either[2:], ~either[1:-1])
    at = np.flatnonzero(alone)
    if len(at) > 2:
        end = at + np.where(byte[at] >= 0xC0, 2, 1)
        seps = np.zeros(n + 9, np.int32)
        np.cumsum(sep, dtype=np.int32, out=seps[1:])
        close = (at[1:] > end[:-1]) & (seps[at[1:]] - seps[end[:-1]] == at[1:] - end[:-1])
        three = close[:-1] & close[1:]
        hit[at[:-2][three]] = True
    return np.flatnonzero(hit[1 : n + 1])


def _is_spelled(stretch: str) -> bool:
    """Whether single glyphs are a word spelled out: with one separator throughout, or, mixed ones, enough of them (``a 3.5`` is no such word)."""
    between = set(_SEPARATORS.findall(stretch))
    glyphs = _SEPARATORS.sub("", stretch)
    return len(between) == 1 or (len(glyphs) > 4 and sum(c.isalpha() for c in glyphs) > 2)


class Restorer:
    """Decodes the suspect stretches of texts; the readings of a stretch are remembered."""

    def __init__(self, model: np.ndarray, remember: int = 200_000, words: Iterable[str] = ()):
        self.model, self.known, self.remember = model, {}, remember
        # an ending of one or two letters stays with its word
        longest_first = sorted((w for w in words if len(w) > 3), key=lambda w: (-len(w), w))
        self.words = re.compile(rf"({'|'.join(map(re.escape, longest_first))})(?!{_LETTER}{{1,2}}(?!{_LETTER}))") if longest_first else None

    def phrase(self, seen: str) -> str:
        """The best reading of a stretch that is spelled out, with the given words apart from what is joined to them.

        The character model alone does not see where the words of a phrase end.
        """
        best = self.decode(seen)
        return re.sub(" +", " ", self.words.sub(r" \1 ", best)).strip(" ") if self.words else best

    def decode(self, seen: str) -> str:
        """The best reading of one stretch."""
        if len(seen) > LONGEST:
            return viterbi(readings(seen), self.model)
        if seen not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[seen] = viterbi(readings(seen), self.model)
        return self.known[seen]

    def _run(self, match: re.Match) -> str:
        run = match.group()
        marks = _MARKS.search(run)
        body = run[: marks.start()] if marks else run
        letters = sum(c.isalpha() for c in body)
        if letters and (letters < len(body) or (len(body) > 3 and _TWICE.search(body)) or (_CYRILLIC.search(body) and re.search("[a-z]", body))):
            return self.decode(body) + run[len(body) :]
        return run

    def edits(self, data: bytes, at: list[int]) -> list[tuple[int, int, str, str]]:
        """(begin, end, stretch, restored) of what changes in lower-cased bytes with triggers at ``at``."""
        out: list[tuple[int, int, str, str]] = []
        until = 0
        for t in at:
            if t < until:
                continue
            begin = max(data.rfind(s, until, t) for s in (b" ", b"\n", b"\t", b"\r")) + 1 or until
            end = min((e for e in (data.find(s, t) for s in (b" ", b"\n", b"\t", b"\r")) if e >= 0), default=len(data))
            begin = max(begin, until)
            # a word spelled out begins at its first glyph
            spelled = None
            if t == begin or data[t - 1 : t] in (b".", b"-", b"_", b"*", b"~"):
                size = _WINDOW
                while True:
                    window = data[t : t + size].decode("utf-8", "ignore")
                    spelled = SPELLED.match(window)
                    # where it ends in separators and one more glyph at most, the word may go on
                    if t + size >= len(data) or not (_GOES_ON.fullmatch(window, spelled.end()) if spelled else _OPEN.fullmatch(window)):
                        break
                    size *= 2
            if spelled and _is_spelled(spelled.group()):
                stretch = spelled.group()
                begin, end = t, t + len(stretch.encode())
                new = self.phrase(stretch)
            else:
                stretch = data[begin:end].decode("utf-8", "ignore")
                new = _RUN.sub(self._run, stretch)
            until = end
            if new != stretch:
                out.append((begin, end, stretch, new))
        return out

    def __call__(self, text: str) -> tuple[str, int]:
        """The restored text, lower-cased, and the number of stretches that changed."""
        data = pc.utf8_lower(pa.scalar(text)).as_py().encode()
        found = self.edits(data, triggers(np.frombuffer(data, np.uint8)).tolist())
        out, at = [], 0
        for begin, end, _, new in found:
            out += [data[at:begin].decode(), new]
            at = end
        return "".join([*out, data[at:].decode()]), len(found)


def beginnings(word: str) -> list[str]:
    """The features of a word: the word (marked) and its beginnings of three to seven letters."""
    return [word + "$", *(word[:k] for k in range(3, min(8, len(word))))]


@dataclass
class Classifier:
    """Strength (log ratio of rates) of the lexicon's features, with the rates of each strength class."""

    lexicon: dict[str, float]
    log_ratio: list[float]
    rate_gap: float
    threshold: float
    known: dict[str, int] = field(default_factory=dict, repr=False)

    def strength_class(self, word: str) -> int:
        """Which class of strength a word is in; -1: none."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            best = max((self.lexicon.get(f, 0.0) for f in beginnings(word)), default=0.0)
            self.known[word] = sum(best >= b for b in BOUNDS) - 1
        return self.known[word]

    def counts(self, text: str) -> tuple[int, list[int]]:
        words = Counter(WORD.findall(text))
        k = [0] * len(BOUNDS)
        for w, n in words.items():
            c = self.strength_class(w)
            if c >= 0:
                k[c] += n
        return words.total(), k

    def score(self, total: int, k: list[int]) -> float:
        return sum(n * r for n, r in zip(k, self.log_ratio)) - total * self.rate_gap


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update({f for w in set(WORD.findall(text.lower())) for f in beginnings(w)})
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])


def _tokens(features: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = Counter(WORD.findall(text.lower()))
                seen["", toxic] = seen.get(("", toxic), 0) + words.total()
                for w, n in words.items():
                    for f in beginnings(w):
                        if f in features:
                            seen[f, toxic] = seen.get((f, toxic), 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
            ["feature", "toxic", "n"],
        )

    return run


def _profiles(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(lexicon, [], 0.0, 0.0)
        for batch in batches:
            found = [own.counts(t.lower()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.int64()))], ["toxic", "words", "k"]
            )

    return run


def _best_threshold(scores: list[tuple[float, int]], least: float) -> float:
    """The threshold of the best F1; of equally good ones the middle of the widest gap; ``least`` at least."""
    scores.sort()
    values = [s for s, _ in scores]
    toxic = sum(t for _, t in scores)
    best, left = (-1.0, 0.0, least), toxic
    for k in range(len(scores) + 1):
        low = values[k - 1] if k else values[0] - 2 * least if values else 0.0
        high = values[k] if k < len(values) else values[-1] + 2 * least if values else 0.0
        if high > low:
            f1 = 2 * left / (left + toxic - left + len(scores) - k + left) if left else 0.0
            best = max(best, (f1, high - low, (low + high) / 2))
        if k < len(scores):
            left -= scores[k][1]
    return max(least, best[2])


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 12_000, min_docs: int = 3, min_ratio: float = 20.0, least: float = 4.0,
    id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
) -> Classifier:
    """Fits the lexicon, rates and threshold on at most ``sample`` labelled rows.

    The sample is the labelled ids of the least hashes.  Labels other than 0
    and 1, null ones, and those that contradict each other are left out, as are
    labelled ids without a text.  Without toxic labels the lexicon is empty and
    nothing is toxic.
    """
    known = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    ids = (
        known.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other")
        .select("doc_id", "toxic", F.xxhash64("doc_id").alias("order"))
        .orderBy("order", "doc_id")
        .limit(sample)
    )
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # the sample is bounded by its parameter, so it can be sent to every task
    own = stored(source.join(F.broadcast(ids), "doc_id").select("text", "toxic", (F.col("order") % 2 == 0).alias("first")), "toxicity-sample")
    first, second = own.where("first").select("text", "toxic"), own.where("NOT first").select("text", "toxic")
    frequent = first.where("toxic = 1").mapInArrow(released(_frequent), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    features = frozenset(r.feature for r in frequent.where(F.col("n") >= min_docs).collect())
    counted = first.mapInArrow(released(_tokens(features)), "feature string, toxic int, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n")).collect()
    n = {(r.feature, r.toxic): r.n for r in counted}
    toxic_words, clean_words = n.get(("", 1), 0) + 1, n.get(("", 0), 0) + 1
    ratio = {f: (n.get((f, 1), 0) + 0.5) / toxic_words / ((n.get((f, 0), 0) + 0.5) / clean_words) for f in features}
    lexicon = {f: math.log(r) for f, r in ratio.items() if r > min_ratio}
    profiles = second.mapInArrow(released(_profiles(lexicon)), "toxic int, words long, k array<long>").collect() if lexicon else []
    k, words = np.full((2, len(BOUNDS)), 0.5), np.ones(2)
    for r in profiles:
        k[r.toxic] += r.k
        words[r.toxic] += r.words
    rate = k / words[:, None]
    out = Classifier(lexicon, [max(0.0, x) for x in np.log(rate[1] / rate[0]).tolist()], max(0.0, float((rate[1] - rate[0]).sum())), least)
    if profiles:
        out.threshold = _best_threshold([(out.score(r.words, r.k), r.toxic) for r in profiles], least)
    return out


def _first_three(word: bytes) -> int:
    w = word[:3].ljust(3, b"\0")
    return w[0] << 16 | w[1] << 8 | w[2]


def _judging(classifier: Classifier, model: np.ndarray) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """:func:`_judged` with the tables that a task makes once."""
    restore = Restorer(model, words=[f[:-1] for f in classifier.lexicon if f.endswith("$")])
    own = Classifier(classifier.lexicon, classifier.log_ratio, classifier.rate_gap, classifier.threshold)
    heads = np.zeros(1 << 24, bool)
    heads[[_first_three(f.removesuffix("$").encode()) for f in own.lexicon]] = True
    squeezed = squeezed_heads(own.lexicon)
    return lambda part: _judged(part, restore, own, heads, squeezed)


def _judge(classifier: Classifier, model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _judging(classifier, model)
        for batch in batches:
            for part in slices(batch, "text"):
                yield judged(part)

    return run


def _judged(part: pa.RecordBatch, restore: Restorer, own: Classifier, heads: np.ndarray, squeezed: np.ndarray) -> pa.RecordBatch:
    # a line break ends each text, so that no stretch goes from one to the next
    empty, line = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    data, offsets = raw(pc.binary_join_element_wise(pc.utf8_lower(as_strings(part.column("text"))), empty, line))
    m = part.num_rows
    words, k = np.zeros(m, np.int64), np.zeros((m, len(BOUNDS)), np.int64)
    changed = np.zeros(m, np.int64)
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = (_CLASS[data] & 1) > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        starts = np.flatnonzero(begins)
        ends = inside
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        ends = np.flatnonzero(ends) + 1
        words = np.diff(np.searchsorted(starts, offsets))
        length = ends - starts
        padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int32)
        head = padded[starts] << 16 | np.where(length > 1, padded[starts + 1], 0) << 8 | np.where(length > 2, padded[starts + 2], 0)
        chosen = heads[head]
        row = np.searchsorted(offsets, starts[chosen], "right") - 1
        whole = data.tobytes()
        for r, a, b in zip(row.tolist(), starts[chosen].tolist(), ends[chosen].tolist()):
            c = own.strength_class(whole[a:b].decode("utf-8", "ignore"))
            if c >= 0:
                k[r, c] += 1
        at = triggers(data, squeezed)
        cut = np.searchsorted(at, offsets)
        for r in np.flatnonzero(np.diff(cut)).tolist():
            base = int(offsets[r])
            for _, _, old, new in restore.edits(whole[base : int(offsets[r + 1])], (at[cut[r] : cut[r + 1]] - base).tolist()):
                changed[r] += 1
                for text, sign in ((old, -1), (new, 1)):
                    n, kinds = own.counts(text)
                    words[r] += sign * n
                    k[r] += sign * np.array(kinds)
    scores = np.round(k @ np.array(own.log_ratio) - words * own.rate_gap, 4)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(scores), pa.array(k.sum(axis=1)), pa.array(changed), pa.array(scores >= own.threshold)],
        ["doc_id", "score", "n_hits", "n_restored", "toxic"],
    )


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_hits, n_restored, toxic) of every row of ``docs``.

    ``n_restored`` counts the stretches that decoding changed, ``n_hits`` the
    restored text's words in the lexicon; ``toxic`` is score >= the fitted
    threshold.  Null and empty texts score 0 and are not toxic; very long texts
    and stretches are decoded whole.  Repeated rows and null ids are scored as
    any other; other columns are ignored; an empty table gives an empty
    result.  ``labels`` has doc_id and toxic (0 or 1), as :func:`fit` says.
    """
    classifier = fit(docs, labels, sample, id_col=id_col, text_col=text_col)
    words = sorted(f[:-1] for f in classifier.lexicon if f.endswith("$"))
    model = log_model(character_counts(docs, text_col), words)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(released(_judge(classifier, model)), "doc_id long, score double, n_hits long, n_restored long, toxic boolean")


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity` does not call toxic, all columns kept.

    Every row is judged by its own text, so repeated and null ids do not
    matter; rows with a null or empty text are kept; an empty table gives an
    empty result.
    """
    classifier = fit(docs, labels, sample, id_col=id_col, text_col=text_col)
    words = sorted(f[:-1] for f in classifier.lexicon if f.endswith("$"))
    model = log_model(character_counts(docs, text_col), words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _judging(classifier, model)
        for batch in batches:
            for part in slices(batch, text_col):
                own = pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column(text_col)], ["doc_id", "text"])
                yield part.filter(pc.invert(judged(own).column("toxic")))

    return docs.mapInArrow(released(keep), docs.schema)
