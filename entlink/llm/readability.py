"""Problem 9: the reading level of each text, from classic readability formulas.

A text is cut into sentences, and sentences into clauses, as the fog index asks for: independent clauses count as
sentences of their own, so a string of short clauses is not one long sentence. Syllables are counted by
hyphenation-like rules (vowel groups, silent endings, hiatus) in the content words: function words are as short in hard texts
as in easy ones, and capital words are mostly names, which count for the length only. Five
formulas give a grade each: Flesch-Kincaid, fog, Flesch reading ease, Powers-Sumner-Kearl and SMOG. Cut points fitted on
graded texts put the grades on the scale of levels, and their median is the grade of a passage.

A passage is a paragraph; short ones are put together, long ones are parted. The grade of a text is the mean of the middle half of
its words, ordered by the grade of their passage: what a text quotes in its smaller part hardly moves it.

Only running sentences are read: lines of lists and tables, templates, tags, addresses and lines
without English function words or without the end of a sentence are left out. A text is running
English if they make up most of its words. NULL, empty and other texts have a NULL level. All whole texts
are read, in one narrow stage that works on the bytes of many texts at once; only ``graded`` texts, at most
``FIT_ROWS`` of them, come to the driver for the fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most graded texts that are used for the fit, those with the smallest hash of their text.
FIT_ROWS = 20_000
#: Small words in a passage, at least and about at most.
PASSAGE, LONG_PASSAGE = 40, 150
#: Characters of the texts that are measured at once.
TOGETHER = 200_000
#: Share of a text's words that must be in running English sentences.
LEAST_SHARE = 0.5
#: Share of function words among the small words of an English sentence, at least.
FUNCTION_SHARE = 0.1

FUNCTION_WORDS = (
    "the a an of and to in is was were are be been it its he she they his her their this that these those for with on at by from as or but not"
    " had has have which who while although because when after before under near beside behind within into then so"
    " another throughout during among between beyond across along alongside one some many every all".split()
)
CLAUSE_WORDS = "and but or so while because although though when after before whereas whereupon which who that if unless until since provided insofar inasmuch".split()

_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}|<!--.*?-->|<[^<>\n]*>|https?://\S+|\[\d+\]|&[a-z]+;", re.S)
_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_LIST_LINE = re.compile(rb"^[ \t]*(?:[*#:;|!]|\{\||\d+[.)][ \t]|-[ \t]|={2,}).*$", re.M)

# Classes of the bytes of folded texts.
_LOWER, _UPPER = 0x80, 0x81  #: letters of other scripts
_SMALL = np.isin(np.arange(256), [*range(97, 123), _LOWER])
_CAPITAL = np.isin(np.arange(256), [*range(65, 91), _UPPER])
_VOWEL = np.isin(np.arange(256), list(b"aeiouy"))
_STOP = np.isin(np.arange(256), list(b".!?"))
_CLOSING = np.isin(np.arange(256), list(b".!?\"')]"))
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c\x00"))
#: Between two texts.
_BETWEEN = b"\n\n\x00"


class _Fold(dict):
    """Code point -> one byte: letters without accents, quotes and dashes as in ASCII, other letters by case, the rest as a sign."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if code < 128:
            out = c
        elif unicodedata.category(c) in ("Mn", "Me", "Cf"):
            out = None
        elif c in "‘’‛ʼ′":
            out = "'"
        elif c in "“”„‟″«»":
            out = '"'
        elif c in "‐‑":
            out = "-"
        elif c in "–•":
            out = "*"  # marks an item of a list at the beginning of a line
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())
            out = plain if plain.strip() else " " if c.isspace() else chr(_LOWER if c.islower() else _UPPER) if c.isalpha() else "\x82"
        self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str) -> bytes:
    """The text without templates, tags and links, one byte for each character."""
    if not text.isascii():
        text = _FOREIGN.sub(lambda m: m[0].translate(_FOLD), text)
    if "[" in text or "{" in text or "<" in text or "&" in text or "http" in text:
        text = _LINK.sub(r"\1", _TEMPLATE.sub(" ", text))
    return text.replace("\x00", " ").encode("latin-1")


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x[:1] & False, x[:-1]))


def _after(x: np.ndarray, by: int = 1) -> np.ndarray:
    return np.concatenate((x[by:], np.zeros(min(by, len(x)), x.dtype)))


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))


def _codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, made of its first and last eight letters and its length."""
    first, last = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | np.where(start + k < end, raw[np.minimum(start + k, end - 1)], 0).astype(np.uint64)
        last = (last << np.uint64(8)) | np.where(end - 1 - k >= start, raw[np.maximum(end - 1 - k, start)], 0).astype(np.uint64)
    return (first * np.uint64(0x9E3779B97F4A7C15)) ^ last ^ (end - start).astype(np.uint64)


def _listed(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return np.sort(_codes(raw, end - np.array([len(w) for w in words]), end))


def _among(pool: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return pool[np.minimum(np.searchsorted(pool, codes), len(pool) - 1)] == codes


_FUNCTION, _CLAUSE = _listed(FUNCTION_WORDS), _listed(CLAUSE_WORDS)


def _syllables(raw: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Syllables of each lower-case English word raw[start:end]; ``inside`` marks the signs of words."""
    vowel = _VOWEL[raw] & inside
    group = _sums(vowel & ~_before(vowel))
    n = group[end] - group[start]
    at = lambda k: np.where(end - k >= start, raw[np.maximum(end - k, 0)], 0)
    one, two, three = at(1), at(2), at(3)
    has = lambda x, signs: np.isin(x, list(signs))
    silent = (one == ord("e")) & ~has(two, b"leyo")
    silent |= (one == ord("s")) & (two == ord("e")) & ~has(three, b"szcgxie") & ~((three == ord("h")) & has(at(4), b"cs"))
    silent |= (one == ord("d")) & (two == ord("e")) & ~has(three, b"tdie")
    a, b = _after(raw), _after(raw, 2)
    previous = np.concatenate((raw[:1] * 0, raw[:-1])) * _before(inside)
    apart = (raw == ord("i")) & ((((a == ord("a")) | (a == ord("o"))) & (b != ord("n")) & (b != ord("u"))) | (a == ord("u")))
    apart |= (raw == ord("u")) & (a == ord("a")) & (previous != ord("q")) & (previous > 0) & (b != ord("r"))
    apart |= (raw == ord("e")) & (a == ord("o")) & (b != ord("u"))
    apart |= vowel & (a == ord("i")) & (b == ord("n")) & (_after(raw, 3) == ord("g"))
    split = _sums(apart & inside)
    hissing = (one == ord("m")) & (two == ord("s")) & (three > 0)
    return np.maximum(n - ((n > 1) & silent) + split[end] - split[start] + hissing, 1)


def syllables(word: str) -> int:
    """Syllables of a lower-case English word."""
    raw = np.frombuffer(word.encode("latin-1", "replace"), np.uint8)
    return int(_syllables(raw, np.ones(len(raw), bool), np.array([0]), np.array([len(raw)]))[0]) if len(raw) else 1


#: Columns of the counts: all words, small words, content words, their syllables, those of three or more syllables, clauses.
WORDS, SMALL, CONTENT, SYLLABLES, LONG, CLAUSES = range(6)


def counted(texts: list[str]) -> list[tuple[np.ndarray, float]]:
    """For each text the counts of its passages and the share of its words that are in running English sentences."""
    none = (np.zeros((0, 6)), 0.0)
    parts = [folded(t) for t in texts]
    joined = _BETWEEN.join(parts) + _BETWEEN
    raw = np.frombuffer(joined, np.uint8).copy()
    close = np.cumsum([len(p) + len(_BETWEEN) for p in parts]) - 1  # the sign that ends each text
    capital, small = _CAPITAL[raw], _SMALL[raw]
    at_ends = np.concatenate(([0], close))
    loud = np.diff(_sums(capital)[at_ends]) > np.diff(_sums(small)[at_ends])
    if loud.any():  # texts in capitals
        lower = np.repeat(loud, np.diff(np.concatenate(([-1], close)))) & capital
        raw[lower & (raw < 0x80)] |= 0x20
        raw[lower & (raw == _UPPER)] = _LOWER
        capital, small = _CAPITAL[raw], _SMALL[raw]
    letter = capital | small
    inside = letter | (((raw == ord("'")) | (raw == ord("-"))) & _before(letter) & _after(letter))
    start = np.flatnonzero(inside & ~_before(inside))
    end = np.flatnonzero(inside & ~_after(inside)) + 1
    listed = np.zeros(len(raw) + 1, np.int32)
    for m in _LIST_LINE.finditer(joined):
        listed[m.start()] += 1
        listed[m.end()] -= 1
    listed = np.cumsum(listed)[:-1] > 0
    # sentences end at a stop before a blank, or unfinished with the text
    position = np.arange(len(raw))
    following = np.minimum.accumulate(np.where(_CLOSING[raw], len(raw) - 1, position)[::-1])[::-1]
    stop = _STOP[raw] & _BLANK[raw[following]] & ~listed
    bounds = stop.copy()
    bounds[close] = True
    bound = np.flatnonzero(bounds)
    text_of = np.searchsorted(close, start)
    every = np.bincount(text_of, minlength=len(texts))
    kept = ~listed[start]
    start, end, text_of = start[kept], end[kept], text_of[kept]
    if not len(start):
        return [none] * len(texts)
    sentence = np.searchsorted(bound, start)
    is_small = np.diff(_sums(capital)[np.stack((start, end), 1)], axis=1)[:, 0] == 0
    lowered = np.where(capital & (raw < 0x80), raw | 0x20, raw)
    code = _codes(lowered, start, end)
    function = _among(_FUNCTION, code)
    content = is_small & ~function
    clause = is_small & _among(_CLAUSE, code)
    n = np.zeros(len(start))
    n[content] = _syllables(raw, inside, start[content], end[content])
    add = lambda w: np.bincount(sentence, w, len(bound))
    semicolons = np.diff(_sums(raw == ord(";"))[np.concatenate(([0], bound))])
    rows = np.stack([np.bincount(sentence, minlength=len(bound)), add(is_small), add(content), add(n), add(n >= 3), 1 + add(clause) + semicolons], axis=1)
    running = stop[bound] & (rows[:, WORDS] >= 3) & (rows[:, SMALL] > 0) & (add(function) >= FUNCTION_SHARE * rows[:, SMALL])
    line = _sums((raw == ord("\n")) & (_after(raw) == ord("\n")))
    first = np.searchsorted(sentence, np.arange(len(bound)))
    paragraph = line[start[np.minimum(first, len(start) - 1)]]
    owner = np.searchsorted(close, bound)
    rows, paragraph, owner = rows[running], paragraph[running], owner[running]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for k, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        own = rows[low:high]
        out.append((_passages(own, paragraph[low:high]), float(own[:, WORDS].sum() / every[k])) if high > low else none)
    return out


def _passages(rows: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """Sentences put together to passages, in their order."""
    before = np.cumsum(rows[:, SMALL]) - rows[:, SMALL]
    begin = np.searchsorted(paragraph, paragraph)
    part = (before - before[begin]) // LONG_PASSAGE
    new = np.flatnonzero(np.concatenate(([True], (paragraph[1:] != paragraph[:-1]) | (part[1:] != part[:-1]))))
    if len(new) == 1:
        return rows.sum(axis=0)[None]
    size = np.diff(np.concatenate((before[new], [before[-1] + rows[-1, SMALL]]))).tolist()
    kept, held = [int(new[0])], 0.0
    for at, n in zip(new.tolist(), size):
        if held >= PASSAGE:
            kept.append(at)
            held = 0.0
        held += n
    if held < PASSAGE / 2 and len(kept) > 1:
        kept.pop()
    return np.add.reduceat(rows, kept, axis=0)


def formulas(rows: np.ndarray) -> np.ndarray:
    """The five grades of each row of counts."""
    content = np.maximum(rows[:, CONTENT], 1)
    length = rows[:, WORDS] / np.maximum(rows[:, CLAUSES], 1)
    syllable, long = rows[:, SYLLABLES] / content, rows[:, LONG] / content
    return np.stack(
        [
            0.39 * length + 11.8 * syllable - 15.59,  # Flesch-Kincaid
            0.4 * (length + 100 * long),  # fog
            -(206.835 - 1.015 * length - 84.6 * syllable),  # Flesch reading ease, as difficulty
            0.0778 * length + 4.55 * syllable - 2.2029,  # Powers-Sumner-Kearl
            1.043 * np.sqrt(30 * long * length) + 3.1291,  # SMOG
        ],
        axis=1,
    )


def _cut(values: np.ndarray, above: np.ndarray) -> float:
    """The cut that parts the two classes with the fewest errors; the middle of the best ones."""
    order = np.argsort(values, kind="stable")
    v, up = values[order], above[order]
    errors = np.concatenate(([0], np.cumsum(up))) + np.concatenate(((~up)[::-1].cumsum()[::-1], [0]))
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    low, high = v[max(k - 1, 0)], v[min(k, len(v) - 1)]
    return float((low + high) / 2)


class Levels:
    """Cut points fitted on graded texts."""

    def __init__(self, texts: list[tuple[str, int]]):
        self.kinds = sorted({level for _, level in texts})
        passages = [(rows, level) for (rows, _), (_, level) in zip(counted([t for t, _ in texts]) if texts else [], texts) if len(rows)]
        if not passages:
            raise ValueError("no graded text holds running English sentences")
        values = formulas(np.concatenate([rows for rows, _ in passages]))
        levels = np.concatenate([np.full(len(rows), level) for rows, level in passages])
        self.cuts = [np.maximum.accumulate([_cut(v, levels > k) for k in self.kinds[:-1]]) for v in values.T]

    def grades(self, rows: np.ndarray) -> np.ndarray:
        """The median grade of each passage: k + 1/2 lies at the cut between the k-th and the next level, counted from 0."""
        if len(self.kinds) == 1:
            return np.zeros(len(rows))
        each = []
        for cuts, v in zip(self.cuts, formulas(rows).T):
            low, high = (cuts[1] - cuts[0], cuts[-1] - cuts[-2]) if len(cuts) > 1 else (1.0, 1.0)
            scale = np.concatenate(([cuts[0] - max(low, 1e-9)], cuts, [cuts[-1] + max(high, 1e-9)]))
            each.append(np.interp(v, scale, np.arange(len(scale)) - 0.5))
        return np.median(np.stack(each, axis=1), axis=1)

    def level_of(self, grade: np.ndarray, weight: np.ndarray) -> int:
        """The level of a text of passages of these grades and weights: the mean of the middle half, to the next level."""
        order = np.argsort(grade, kind="stable")
        upto = np.concatenate(([0], np.cumsum(weight[order]) / weight.sum()))
        middle = np.clip(np.minimum(upto[1:], 0.75) - np.maximum(upto[:-1], 0.25), 0, None)
        return self.kinds[int(np.clip(np.floor((grade[order] * middle).sum() / middle.sum() + 0.5), 0, len(self.kinds) - 1))]

    def levels(self, texts: list[str | None]) -> list[int | None]:
        """The reading level of each text."""
        out: list[int | None] = [None] * len(texts)
        held: list[int] = []
        size = 0
        for k, t in enumerate([*texts, None]):
            if t:
                held.append(k)
                size += len(t)
            if held and (size >= TOGETHER or k == len(texts)):
                found = counted([texts[h] for h in held])
                grades, low = self.grades(np.concatenate([rows for rows, _ in found])), 0
                for at, (rows, share) in zip(held, found):
                    if len(rows) and share >= LEAST_SHARE:
                        out[at] = self.level_of(grades[low : low + len(rows)], rows[:, SMALL])
                    low += len(rows)
                held, size = [], 0
        return out

    def level(self, text: str | None) -> int | None:
        """The reading level of a text, or None if it is not running English."""
        return self.levels([text])[0]


def fit(graded: DataFrame, text: str = "text", level: str = "reading_level") -> Levels:
    """Levels fitted on at most FIT_ROWS graded texts."""
    rows = graded.select(F.col(text).alias("t"), F.col(level).alias("l")).where("t is not null and l is not null")
    return Levels([(r["t"], r["l"]) for r in rows.orderBy(F.xxhash64("t"), "l").limit(FIT_ROWS).collect()])


def reading_levels(docs: DataFrame, levels: Levels, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reading_level): the level of every row's text; NULL where it is not running English."""
    model = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.levels(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=[key, "reading_level"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, reading_level int")
