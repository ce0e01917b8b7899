"""Tokens with offsets and n-grams.

Offsets of tokens are running sums over a text. Built-in functions can only give them by a window,
which shuffles every token of the corpus; the tokenizer here is one narrow Arrow stage instead.
N-grams are built in the same stage and, where a dictionary is given, only those that pass a sieve made of it: a Bloom
filter of at most 128 MB, whatever the dictionary's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entlink.functions.arrays import slices, spread, text_buffer
from entlink.functions.text import DROP, KEEP
from entlink.session import maybe_broadcast, stored

NGRAM_SIZE = 11
#: Frames whose tokens are made at a time.
_FRAMES = 20_000


def _tokenize(texts: pa.Array, utf16: bool) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row, position, lower-case token, offset and length of every token."""
    data, offsets = text_buffer(texts)
    n = len(texts)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    drop = np.isin(codes, np.array([ord(c) for c in DROP], np.uint32))
    keep = np.isin(codes, np.array([ord(c) for c in KEEP], np.uint32))
    begin = np.searchsorted(place, offsets[:-1])
    edge = np.zeros(len(codes) + 1, bool)
    edge[begin] = True
    edge[-1] = True
    plain = ~(drop | keep)
    starts = plain & (edge[:-1] | np.concatenate(([True], ~plain[:-1])))
    ends = plain & (edge[1:] | np.concatenate((~plain[1:], [True])))
    start = np.flatnonzero(starts | keep)
    end = np.flatnonzero(ends | keep) + 1
    row = np.searchsorted(begin, start, side="right") - 1
    if len(start):  # texts of no characters share their beginning with the next one
        row = np.searchsorted(np.searchsorted(place, offsets[1:]), start, side="right")
    first = np.searchsorted(row, np.arange(n))
    position = np.arange(len(row)) - first[row]
    byte = np.concatenate((place, [len(data)]))
    token = pc.utf8_lower(slices(data, byte[start], byte[end] - byte[start]))
    if utf16:
        wide = np.concatenate(([0], np.cumsum(1 + (codes > 0xFFFF))))
        return row, position, token, wide[start] - wide[begin[row]], wide[end] - wide[start]
    return row, position, token, start - begin[row], end - start


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", utf16: bool = False) -> DataFrame:
    """(key, pos, token, off, len): every token of every text, with 0-based position and offset.

    Runs between delimiters are tokens, and so is each of ``. ! - :``. Offsets count characters, or
    UTF-16 units with ``utf16``. NULL and empty texts have no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices_of(whole)):
            row, position, token, offset, length = _tokenize(batch.column(1), utf16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(position.astype(np.int32)), token.cast(pa.string()), pa.array(offset.astype(np.int32)), pa.array(length.astype(np.int32))],
                names=[key, "pos", "token", "off", "len"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, pos int, token string, off int, len int")


def token_figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, sum_off, sum_len, n_distinct, last_token) of each row whose text has tokens, in one narrow stage: a text is whole in its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices_of(whole)):
            row, _, token, offset, length = _tokenize(batch.column(1), False)
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            last = np.concatenate((first[1:], [len(row)])) - 1
            kind = token.dictionary_encode()
            seen = np.unique(row * len(kind.dictionary) + kind.indices.to_numpy()) // len(kind.dictionary)
            sums = [np.add.reduceat(x.astype(np.int64), first) for x in (np.ones(len(row)), offset, length)]
            distinct = np.bincount(seen, minlength=batch.num_rows)[row[first]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[first])), *map(pa.array, sums), pa.array(distinct), token.take(pa.array(last)).cast(pa.string())],
                names=[key, "n", "sum_off", "sum_len", "n_distinct", "last_token"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, n bigint, sum_off bigint, sum_len bigint, n_distinct bigint, last_token string")


def _hashes(tokens: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    data, offsets = text_buffer(tokens)
    if not len(data):
        return np.zeros(len(tokens), np.uint64)
    size = np.diff(offsets)
    factor = np.cumprod(np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15), np.uint64))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    summed = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * factor[place])))
    h = summed[offsets[1:]] - summed[offsets[:-1]]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_STEP = np.uint64(0xD6E8FEB86659FD93)


_WORD_BITS, _BLOCK_BITS = 16, 30  # fewest and most bits of a sieve, as powers of two
_PLACES = 3
_PAGE = 16  # bits of a page, as a power of two


def _entry_hashes(mentions: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all entries of at most ``most`` tokens, and of their first tokens."""
    words = pc.split_pattern(mentions.cast(pa.large_string()), " ")
    size = pc.list_value_length(words).to_numpy().astype(np.int64)
    flat = _hashes(pc.list_flatten(words))
    begin = np.cumsum(size) - size
    begin, size = begin[size <= most], size[size <= most]
    total = np.zeros(len(size), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        rows = size > k
        total[rows] = total[rows] * _STEP + flat[begin[rows] + k]
    return total, flat[begin] if len(begin) else total


def _places(h: np.ndarray, bits: int, first: bool) -> list[np.ndarray]:
    """The places of a hash in a sieve of 2^bits bits; hashes of first tokens have places of their own."""
    h = h * np.uint64(0xC2B2AE3D27D4EB4F if first else 0x165667B19E3779F9)
    out = []
    for k in range(_PLACES):
        h ^= h >> np.uint64(29 + k)
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        out.append((h >> np.uint64(64 - bits)).astype(np.int64))
    return out


class Sieve:
    """A Bloom filter of all dictionary entries and of their first tokens: it lets every entry through and few others."""

    def __init__(self, bits: int, longest: int, pages: dict[int, bytes]):
        self.bits, self.longest = bits, longest
        self.data = np.zeros(1 << (bits - 3), np.uint8)
        size = 1 << (_PAGE - 3)
        for page, content in pages.items():
            self.data[page * size : (page + 1) * size] = np.frombuffer(content, np.uint8)

    def among(self, h: np.ndarray, first: bool = False) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for place in _places(h, self.bits, first):
            ok &= (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return ok


def sieve_of(entries: DataFrame, n: int, most: int) -> Sieve:
    """The sieve of ``n`` entries(mention), about 16 bits for each; built on the executors page by page. The driver gets at most 128 MB."""
    bits = min(max(_WORD_BITS, (16 * max(n, 1) - 1).bit_length()), _BLOCK_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, first = _entry_hashes(batch.column(0), most)
            place = np.unique(np.concatenate([*_places(whole, bits, False), *_places(np.unique(first), bits, True)]))
            yield pa.RecordBatch.from_arrays([pa.array((place >> _PAGE).astype(np.int32)), pa.array((place & ((1 << _PAGE) - 1)).astype(np.int32))], names=["page", "place"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        content = np.zeros(1 << _PAGE, np.uint8)
        content[pdf["place"].to_numpy()] = 1
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "content": [np.packbits(content, bitorder="little").tobytes()]})

    marked = entries.select("mention").mapInArrow(mark, "page int, place int").distinct()
    pages = {r["page"]: bytes(r["content"]) for r in marked.groupBy("page").applyInPandas(fill, "page int, content binary").collect()}
    size = F.size(F.split("mention", " "))
    longest = entries.select(size.alias("k")).where(F.col("k") <= most).agg(F.max("k").alias("k")).head()["k"]
    return Sieve(bits, longest or 0, pages)


def _slices_of(batch: pa.RecordBatch, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _ngram_batches(batch: pa.RecordBatch, most: int, sieve: Sieve | None, key: str) -> Iterator[pa.RecordBatch]:
    row, position, token, offset, length = _tokenize(batch.column(1), False)
    n_tokens = np.bincount(row, minlength=batch.num_rows)
    left = n_tokens[row] - position
    start = np.arange(len(row))
    if sieve is not None:
        h = _hashes(token)
        start = start[sieve.among(h, first=True)]
        total = np.zeros(len(start), np.uint64)
        loose = np.zeros(len(start), np.uint64)
        dash = np.asarray(pc.equal(token, "-"))
        pending = np.zeros(len(start), bool)
        skipped = np.zeros(len(start), bool)
        most = min(most, 2 * sieve.longest)
    for n in range(1, most + 1):
        inside = left[start] >= n
        start = start[inside]
        if not len(start):
            return
        if sieve is None:
            at = start
        else:
            last = start + n - 1
            own = h[last]
            total = total[inside] * _STEP + own
            # the other form of the n-gram leaves out single hyphens between tokens
            loose, pending, skipped = loose[inside], pending[inside], skipped[inside]
            hyphen = dash[last] & (n > 1) & ~pending
            loose = np.where(hyphen, loose, loose * _STEP + own)
            skipped |= hyphen
            pending = hyphen
            ok = sieve.among(total) | (skipped & hyphen)
            more = np.flatnonzero(skipped & ~hyphen & ~ok)
            ok[more] = sieve.among(loose[more])
            at = start[ok]
        if len(at):
            words = [token.take(pa.array(at + k)) for k in range(n)]
            gram = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if n > 1 else words[0]
            end = at + n - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row[at])),
                    *(pa.array(x.astype(np.int32)) for x in (n_tokens[row[at]], position[at], np.full(len(at), n))),
                    gram.cast(pa.string()),
                    *(pa.array(x.astype(np.int32)) for x in (offset[at], offset[end] + length[end] - offset[at])),
                ],
                names=[key, "n_tokens", "pos", "n", "ngram", "off", "len"],
            )


def ngrams(docs: DataFrame, most: int = NGRAM_SIZE, key: str = "doc_id", text: str = "text", sieve: Sieve | None = None) -> DataFrame:
    """(key, n_tokens, pos, n, ngram, off, len) of all n-grams of 1..most tokens, or of those that pass ``sieve``.

    ``len`` runs from the first token to the end of the last in the original text.
    """
    hashes = None if sieve is None else docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices_of(batch):
                yield from _ngram_batches(part, most, None if hashes is None else hashes.value, key)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens int, pos int, n int, ngram string, off int, len int")


def dictionary_ngrams(docs: DataFrame, mentions: DataFrame, most: int = NGRAM_SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, pos, n, ngram, mention, off, len, ...): the n-grams that are entries of ``mentions``(mention, ...), with the entry's other columns.

    An n-gram that is no entry is looked up once more with each `` - `` as a blank. A sieve of the entries passes
    the n-grams where they are made; one inner join on the looked-up form decides. The entries, one row for each mention, are
    broadcast while few, by count.
    """
    entries = stored(mentions.where("mention is not null").dropDuplicates(["mention"]))
    n = entries.count()
    grams = ngrams(docs, most, key, text, sieve_of(entries, n, most))
    hyphen = F.replace("ngram", F.lit(" - "), F.lit(" "))
    forms = F.when(F.contains("ngram", F.lit(" - ")), F.array("ngram", hyphen)).otherwise(F.array("ngram"))
    looked = grams.select("*", F.posexplode(forms).alias("loose", "form"))
    # an entry knows the entries with hyphens that would look it up second, so an exact hit needs no join of its own
    tight = entries.where(F.contains("mention", F.lit(" - "))).select(F.replace("mention", F.lit(" - "), F.lit(" ")).alias("form"), F.col("mention").alias("exact"))
    known = entries.withColumnRenamed("mention", "form").join(tight.groupBy("form").agg(F.collect_set("exact").alias("exact")), "form", "left")
    hits = looked.join(maybe_broadcast(known, n), "form").where("loose = 0 or exact is null or not array_contains(exact, ngram)")
    rest = [c for c in entries.columns if c != "mention"]
    return hits.select(key, "n_tokens", "pos", "n", "ngram", F.col("form").alias("mention"), "off", "len", *rest)


def context_bounds(position: Column, n_tokens: Column, width: int = 50) -> tuple[Column, Column]:
    """First and end position of the context of a token: a frame that is shifted, not cut, at the ends of the text."""
    half = width // 2
    begin = F.when(position < half, F.lit(0)).when(position + half >= n_tokens, F.greatest(F.lit(0), n_tokens - width)).otherwise(position - half)
    return begin, F.least(n_tokens, begin + width)


def _framed(docs: DataFrame, frames: DataFrame, make, out: str, key: str, text: str) -> DataFrame:
    """(key, pos, ...) of each frame by ``make``(owner, start, size, token), which gives a frame's number for each row it makes, and the rows' other columns.

    A text meets its ``frames``(key, pos, begin, end) in one row, so their tokens are taken in the stage that makes them: neither the
    tokens of the texts nor those of the frames are shuffled or broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices_of(whole)):
            row, _, token, _, _ = _tokenize(batch.column(1), False)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            text_of = pc.list_parent_indices(batch.column(2)).to_numpy()
            pos, begin, end = (pc.list_flatten(batch.column(k)).to_numpy() for k in (2, 3, 4))
            size = np.minimum(first[text_of] + end, first[text_of + 1]) - first[text_of] - begin
            full = np.flatnonzero(size > 0)
            for k in range(0, len(full), _FRAMES):
                at = full[k : k + _FRAMES]
                owner, columns = make(first[text_of[at]] + begin[at], size[at], token)
                owner = at[owner]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text_of[owner])), pa.array(pos[owner].astype(np.int32)), *columns], names=[key, "pos", *(f"c{k}" for k in range(len(columns)))])

    kind = docs.schema[key].dataType.simpleString()
    each = frames.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("pos", "begin", "end"))).alias("__frames"))
    rows = docs.select(key, F.col(text).cast("string").alias("__text")).join(each, key)
    rows = rows.select(key, "__text", *[F.col(f"__frames.{c}").alias(c) for c in ("pos", "begin", "end")])
    names = [c.split()[0] for c in out.split(", ")]
    types = [c.split()[1] for c in out.split(", ")]
    made = rows.mapInArrow(run, f"`{key}` {kind}, pos int, " + ", ".join(f"c{k} {t}" for k, t in enumerate(types)))
    return made.select(key, "pos", *[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def frame_terms(docs: DataFrame, frames: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term, tf): how often each token stands in each of ``frames``(key, pos, begin, end)."""

    def make(start: np.ndarray, size: np.ndarray, token: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        kind = token.dictionary_encode()
        n = len(kind.dictionary)
        code, tf = np.unique(np.repeat(np.arange(len(start)), size) * n + kind.indices.to_numpy()[spread(start, size)], return_counts=True)
        return code // n, [kind.dictionary.take(pa.array(code % n)).cast(pa.string()), pa.array(tf.astype(np.int64))]

    return _framed(docs, frames, make, "term string, tf bigint", key, text)


def frame_texts(docs: DataFrame, frames: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, context): the tokens of each of ``frames``(key, pos, begin, end) in their order."""

    def make(start: np.ndarray, size: np.ndarray, token: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        words = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), token.take(pa.array(spread(start, size))))
        return np.arange(len(start)), [pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())]

    return _framed(docs, frames, make, "context string", key, text)


def text_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term): each different token of each text once, in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices_of(whole)):
            row, _, token, _, _ = _tokenize(batch.column(1), False)
            kind = token.dictionary_encode()
            n = max(1, len(kind.dictionary))
            code = np.unique(row * n + kind.indices.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(code // n)), kind.dictionary.take(pa.array(code % n)).cast(pa.string())], names=[key, "term"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, term string")


def running_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same tokens by built-in functions only (a shuffle of every piece of text); kept as a check of :func:`tokens`."""
    from entlink.functions.text import DROP_CLASS, KEEP_CLASS

    signs = DROP_CLASS + KEEP_CLASS
    pieces = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"([^{signs}]+|[{signs}])"), F.lit(1))).alias("p", "piece"))
    w = Window.partitionBy(key).orderBy("p")
    rows = pieces.withColumn("off", F.sum(F.length("piece")).over(w) - F.length("piece")).where(~F.col("piece").rlike(f"^[{DROP_CLASS}]$"))
    return rows.select(key, (F.row_number().over(w) - 1).alias("pos"), F.lower("piece").alias("token"), F.col("off").cast("int").alias("off"), F.length("piece").alias("len"))
