"""Problem 7: the token ids of every text by a public byte-level BPE vocabulary.

Texts stay in Arrow buffers. A batch is split into words by array operations over its code points
(the split pattern of byte-level BPE, see ``_word_starts``). Equal words are encoded once: words of
similar length form one padded matrix of ids, in which every row merges its leftmost pair of lowest
rank each round. Pairs are looked up in a hashed table; rows without a mergeable pair leave the
matrix. Words longer than ``LONG`` bytes merge all places of their lowest pair in each round, which
gives the same ids, as a merge never makes a pair of a lower rank.

Results: NULL and the empty text give an empty list; special tokens are never made, their strings
are ordinary text. Very long texts are cut into pieces at the start of a run of white space, where
the split pattern always begins a word, so memory stays bounded by ``PIECE`` and the longest word.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.session import env_path

#: Bytes of text that are worked on at once.
PIECE = 2_000_000
#: Longest word, in bytes, that goes into a padded matrix.
LONG = 128
NONE = np.uint32(0xFFFFFFFF)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def default_path() -> str:
    """The vocabulary file of byte_bpe_50k; a parameter of every operator that encodes."""
    return env_path("ENTLINK_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = value
    return table


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in plain)
    letters.update({chr(256 + k): b for k, b in enumerate(rest)})
    return letters


class PairTable:
    """Pairs of ids -> (rank, merged id), as two hashed arrays that never need a second probe."""

    SIZE = 20

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        ranks = np.arange(len(keys), dtype=np.uint32)
        self.merged = merged.astype(np.uint32)
        self.levels = []
        rng = np.random.default_rng(7)
        todo = np.arange(len(keys))
        while len(todo):
            best = None
            for _ in range(32):
                factor = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
                slot = self._slot(keys[todo], factor)
                _, first = np.unique(slot, return_index=True)
                if best is None or len(first) > len(best[1]):
                    best = (factor, first, slot)
                if len(first) == len(todo):
                    break
            factor, first, slot = best
            at = np.full(1 << self.SIZE, np.uint64(0xFFFFFFFFFFFFFFFF))
            rank = np.full(1 << self.SIZE, NONE)
            at[slot[first]] = keys[todo[first]]
            rank[slot[first]] = ranks[todo[first]]
            self.levels.append((factor, at, rank))
            todo = np.delete(todo, first)

    def _slot(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys * factor) >> np.uint64(64 - self.SIZE)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE where the pair is not merged."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(keys.shape, NONE)
        for factor, at, rank in self.levels:
            slot = self._slot(keys, factor)
            out = np.where(at[slot] == keys, rank[slot], out)
        return out


class ByteBPE:
    """One vocabulary with the state that a worker keeps between batches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.bytes = np.zeros(256, np.uint32)
        for letter, b in letters.items():
            self.bytes[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(
            np.array([vocab[a] for a, _ in pairs], np.uint32),
            np.array([vocab[b] for _, b in pairs], np.uint32),
            np.array([vocab[a + b] for a, b in pairs], np.uint32),
        )

    def _merge_matrix(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``ids`` (padded on the right with NONE) after all merges, and their lengths."""
        out, out_len = ids.copy(), length.copy()
        rows, work, left = np.arange(len(ids)), ids, length
        ranks = np.where(work[:, 1:] != NONE, self.pairs.rank(work[:, :-1], work[:, 1:]), NONE)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            each = np.arange(len(rows))
            best = ranks[each, at] if ranks.shape[1] else np.full(len(rows), NONE)
            over = best == NONE
            if over.any():
                done = rows[over]
                out[done, : work.shape[1]] = work[over]
                out[done, work.shape[1] :] = NONE
                out_len[done] = left[over]
                keep = ~over
                rows, work, left, ranks, at, best = rows[keep], work[keep], left[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            width = int(left.max())
            work, ranks = work[:, :width], ranks[:, : width - 1]
            work[each, at] = self.pairs.merged[best]
            columns = np.arange(width - 1)
            work = np.take_along_axis(work, columns + (columns > at[:, None]), axis=1)
            left = left - 1
            columns = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            work[np.arange(work.shape[1]) >= left[:, None]] = NONE
            for shift in (-1, 0):
                col = at + shift
                ok = (col >= 0) & (col + 1 < left)
                r, c = each[ok], col[ok]
                ranks[r, c] = self.pairs.rank(work[r, c], work[r, c + 1])
            if ranks.shape[1]:
                ranks[np.arange(ranks.shape[1]) >= (left - 1)[:, None]] = NONE
        return out, out_len

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long word: each round merges every place of the lowest pair, left to right."""
        ranks = self.pairs.rank(ids[:-1], ids[1:])
        while len(ranks):
            low = ranks.min()
            if low == NONE:
                break
            at = np.flatnonzero(ranks == low)
            new_run = np.diff(at, prepend=-2) > 1
            place = np.arange(len(at))
            start = np.maximum.accumulate(np.where(new_run, place, 0))
            at = at[(place - start) % 2 == 0]
            ids[at] = self.pairs.merged[low]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            ranks = self.pairs.rank(ids[:-1], ids[1:])
        return ids

    def _encode_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many ids each has."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bucket = np.ceil(np.log2(np.maximum(size, 2)) * 2).astype(int)
        for b in np.unique(bucket[size <= LONG]):
            rows = np.flatnonzero((bucket == b) & (size <= LONG))
            for k in range(0, len(rows), 1 << 15):
                part = rows[k : k + (1 << 15)]
                width = int(size[part].max())
                columns = np.arange(width)
                inside = columns < size[part][:, None]
                ids = np.where(inside, self.bytes[data[np.minimum(start[part][:, None] + columns, len(data) - 1)]], NONE)
                ids, length = self._merge_matrix(ids, size[part].copy())
                parts.append((part, length, ids[np.arange(ids.shape[1]) < length[:, None]]))
        for row in np.flatnonzero(size > LONG):
            ids = self._merge_long(self.bytes[data[start[row] : start[row] + size[row]]])
            parts.append((np.array([row]), np.array([len(ids)]), ids))
        count = np.zeros(len(size), np.int64)
        for rows, length, _ in parts:
            count[rows] = length
        offset = np.concatenate(([0], np.cumsum(count)))
        pool = np.zeros(offset[-1], np.uint32)
        for rows, length, ids in parts:
            pool[_spread(offset[rows], length)] = ids
        return pool, count

    def encode(self, data: np.ndarray, ends: np.ndarray, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in UTF-8 ``data`` up to ``ends``, and the count of each text."""
        counts = np.zeros(len(ends), np.int64)
        if not len(data):
            return np.zeros(0, np.int32), counts
        starts, lens = _words(data, ends)
        first, inverse = _distinct(data, starts, lens)
        pool, each = self._encode_words(data, starts[first], lens[first])
        n = each[inverse]
        text = np.searchsorted(ends, starts, side="right")
        counts += np.bincount(text, weights=n, minlength=len(ends)).astype(np.int64)
        if not with_ids:
            return np.zeros(0, np.int32), counts
        offset = np.concatenate(([0], np.cumsum(each)))[:-1]
        return pool[_spread(offset[inverse], n)].astype(np.int32), counts


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), start[1], ..."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


def _word_starts(codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where words begin, by the split pattern of byte-level BPE.

    A word is a run of letters, of numbers or of other signs, each with one blank before it if there
    is one; or one of 's 't 're 've 'm 'll 'd where the apostrophe begins a word; or white space.
    White space before a word leaves its last character to that word (a blank) or stands alone
    (any other); white space at the end of a text is one word.
    """
    n = len(codes)
    kind = _classes()[codes]
    first = np.zeros(n + 1, bool)
    first[text_start] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[last] = True
    blank = last[codes[last] == 32]
    start[blank + 1] = False
    quote = np.flatnonzero((codes == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    one = codes[quote + 1]
    two = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], codes[np.minimum(quote + 2, n - 1)], 0)
    short = np.isin(one, np.array([115, 116, 109, 100], codes.dtype))
    pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    start[quote[short] + 1] = False
    start[quote[short] + 2] = True
    pair &= ~short
    start[quote[pair] + 1] = False
    start[quote[pair] + 3] = True
    return start[:n]


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and byte length of each word."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(codes) == len(data):
        place = None
        begins = np.concatenate(([0], ends[:-1]))
        begins = begins[begins < len(data)]
    else:
        place = np.flatnonzero((data & 0xC0) != 0x80)
        begins = np.concatenate(([0], ends[:-1]))
        begins = np.searchsorted(place, begins[begins < len(data)])
    at = np.flatnonzero(_word_starts(codes, begins))
    at = at if place is None else place[at]
    return at, np.diff(at, append=len(data))


def _distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word, and for each word the number of its equal."""
    padded = np.concatenate((data, np.zeros(24, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,)).copy()
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    inverse = np.zeros(len(start), np.int64)
    firsts, known = [], 0
    for low, high in ((1, 7), (8, 16)):
        rows = np.flatnonzero((size >= low) & (size <= high))
        if not len(rows):
            continue
        if high == 7:
            key = (eight[start[rows]] & masks[size[rows]]) | (size[rows].astype(np.uint64) << np.uint64(56))
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
        else:
            a, b = eight[start[rows]], eight[start[rows] + 8] & masks[size[rows] - 8]
            mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (size[rows].astype(np.uint64) << np.uint64(57))
            order = np.argsort(mixed, kind="stable")
            sa, sb, ss = a[order], b[order], size[rows][order]
            new = np.concatenate(([True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1]) | (ss[1:] != ss[:-1])))
        number = np.cumsum(new) - 1
        inverse[rows[order]] = number + known
        firsts.append(rows[order[new]])
        known += int(number[-1]) + 1
    long = np.flatnonzero(size > 16)
    if len(long):
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        own = []
        for row, s, n in zip(long.tolist(), start[long].tolist(), size[long].tolist()):
            word = raw[s : s + n]
            k = seen.get(word)
            if k is None:
                k = seen[word] = known + len(own)
                own.append(row)
            inverse[row] = k
        firsts.append(np.array(own))
    return np.concatenate(firsts), inverse


_kept: dict[str, ByteBPE] = {}


def vocabulary(path: str) -> ByteBPE:
    """The vocabulary of ``path``, loaded once per worker."""
    if path not in _kept:
        _kept[path] = ByteBPE(path)
    return _kept[path]


def _cuts(data: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of pieces of one long text: places where a run of white space begins after a visible sign."""
    cuts, at = [], start
    while end - at > PIECE:
        low, width = at + PIECE // 2, PIECE // 2
        cut = None
        while low < end - 1:
            part = data[low : min(low + width, end)]
            white = (part == 32) | (part == 10)
            here = np.flatnonzero(white[1:] & (part[:-1] > 32) & (part[:-1] < 127))
            if len(here):
                cut = low + 1 + int(here[0])
                break
            low += width - 1
        if cut is None:
            break
        cuts.append(cut)
        at = cut
    return [*cuts, end]


def encode_column(model: ByteBPE, texts: pa.Array, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the number of ids of each; NULL counts none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    piece_end: list[int] = []
    owner: list[int] = []
    big = np.flatnonzero(np.diff(offsets) > PIECE)
    if len(big):
        for k in range(n):
            cuts = _cuts(data, int(offsets[k]), int(offsets[k + 1]))
            piece_end += cuts
            owner += [k] * len(cuts)
        ends, own = np.array(piece_end), np.array(owner)
    else:
        ends, own = offsets[1:], np.arange(n)
    counts, ids = np.zeros(n, np.int64), []
    at, begin = 0, int(offsets[0])
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, begin + PIECE, side="right")))
        part, each = model.encode(data[begin : ends[upto - 1]], ends[at:upto] - begin, with_ids)
        np.add.at(counts, own[at:upto], each)
        ids.append(part)
        at, begin = upto, int(ends[upto - 1])
    return np.concatenate(ids), counts


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's text.

    One narrow stage: no shuffle, texts go to Python as Arrow buffers and ids come back as one Arrow
    list. Repeated rows each give a row; NULL and empty texts give an empty list.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            ids, counts = encode_column(model, batch.column(1))
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): like :func:`token_ids`, only the number of tokens of each text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in batches:
            _, counts = encode_column(model, batch.column(1), with_ids=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
