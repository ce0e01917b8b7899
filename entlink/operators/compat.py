"""Cosine of contexts and entity vectors, text by text.

A text, its frames and its candidates meet in one row, and the vectors of the candidate entities come to the tasks in blocks
of a fixed size. So neither the terms of the contexts nor their products with the vectors are ever rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.functions.arrays import spread
from entlink.operators import tokens as tk
from entlink.session import stored

#: Entries of entity vectors that go to the tasks at a time.
VECTOR_BLOCK = 2_000_000
# Frames and entities that are multiplied at a time.
_FRAMES, _ENTITIES = 64, 1_000


class Vectors:
    """Vectors of some entities, entity by entity: places in ``words`` and weights."""

    def __init__(self, rows: pa.Table):
        entity = rows["entity_id"].to_numpy()
        order = np.argsort(entity, kind="stable")
        self.ids, self.start, self.size = np.unique(entity[order], return_index=True, return_counts=True)
        kind = rows["term"].combine_chunks().dictionary_encode()
        self.words, self.term, self.w = kind.dictionary, kind.indices.to_numpy()[order], rows["w"].to_numpy()[order]
        self.norm = np.sqrt(np.add.reduceat(self.w * self.w, self.start)) if len(order) else np.zeros(0)

    def places(self, entity: np.ndarray) -> np.ndarray:
        """The place of each entity among ``ids``, -1 for those without a vector."""
        if not len(self.ids):
            return np.full(len(entity), -1)
        at = np.minimum(np.searchsorted(self.ids, entity), len(self.ids) - 1)
        return np.where((self.ids[at] == entity) & (self.norm[at] > 0), at, -1)


def _cosines(kind: np.ndarray, begin: np.ndarray, end: np.ndarray, idf: np.ndarray, word: np.ndarray, frame: np.ndarray, entity: np.ndarray, v: Vectors, local: np.ndarray) -> np.ndarray:
    """The cosine of each (frame, entity) of one text.

    ``kind`` numbers the text's tokens; ``idf`` and ``word``, the place in ``v.words`` or -1, are by that number. ``local`` is -1 everywhere and so again afterwards.
    """
    out = np.zeros(len(frame))
    for low in range(0, len(begin), _FRAMES):
        at = np.arange(low, min(low + _FRAMES, len(begin)))
        mine = np.flatnonzero((frame >= low) & (frame < low + _FRAMES))
        if not len(mine):
            continue
        size = end[at] - begin[at]
        terms, place = np.unique(kind[spread(begin[at], size)], return_inverse=True)
        w = np.bincount(np.repeat(np.arange(len(at)), size) * len(terms) + place, minlength=len(at) * len(terms)).reshape(len(at), len(terms)) * idf[terms]
        norm = np.sqrt((w * w).sum(axis=1))
        known = np.flatnonzero(word[terms] >= 0)
        local[word[terms[known]]] = known
        entities, column = np.unique(entity[mine], return_inverse=True)
        for first in range(0, len(entities), _ENTITIES):
            e = entities[first : first + _ENTITIES]
            entry = spread(v.start[e], v.size[e])
            near = local[v.term[entry]]
            hit = np.flatnonzero(near >= 0)
            m = np.bincount(np.repeat(np.arange(len(e)), v.size[e])[hit] * len(terms) + near[hit], v.w[entry[hit]], len(e) * len(terms)).reshape(len(e), len(terms))
            dots = w @ m.T
            own = np.flatnonzero((column >= first) & (column < first + len(e)))
            f = frame[mine[own]] - low
            both = norm[f] * v.norm[entity[mine[own]]]
            out[mine[own]] = np.where(both > 0, dots[f, column[own] - first] / np.where(both > 0, both, 1), 0.0)
        local[word[terms[known]]] = -1
    return out


def _batch(batch: pa.RecordBatch, v: Vectors, local: np.ndarray) -> pa.RecordBatch:
    row, _, token, _, _ = tk._tokenize(batch.column(1), False)
    first = np.searchsorted(row, np.arange(batch.num_rows + 1))
    encoded = token.dictionary_encode()
    kind = encoded.indices.to_numpy()
    word = pc.fill_null(pc.index_in(encoded.dictionary, value_set=v.words.cast(encoded.dictionary.type)), -1).to_numpy()
    terms, idfs = pc.list_flatten(batch.column(2)), pc.list_flatten(batch.column(3)).to_numpy()
    at = pc.index_in(encoded.dictionary, value_set=terms.cast(encoded.dictionary.type)).to_numpy()  # a term's weight is the same in every text
    idf = idfs[at] if len(at) else np.zeros(0)
    bounds = [np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_numpy()))) for k in (4, 7)]
    pos, begin, end, c_pos, c_entity = (pc.list_flatten(batch.column(k)).to_numpy() for k in range(4, 9))
    place = v.places(c_entity)
    keep, cosine = place >= 0, np.zeros(len(place))
    for k in range(batch.num_rows):
        f = slice(bounds[0][k], bounds[0][k + 1])
        c = np.flatnonzero(keep[bounds[1][k] : bounds[1][k + 1]]) + bounds[1][k]
        if len(c) and first[k + 1] > first[k]:
            n = first[k + 1] - first[k]
            cosine[c] = _cosines(kind[first[k] : first[k + 1]], np.minimum(begin[f], n), np.minimum(end[f], n), idf, word, np.searchsorted(pos[f], c_pos[c]), place[c], v, local)
    owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds[1]))
    hit = np.flatnonzero(cosine != 0)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[hit])), pa.array(c_pos[hit]), pa.array(c_entity[hit]), pa.array(cosine[hit])], names=["doc_id", "pos", "entity_id", "cosine"])


def cosines(docs: DataFrame, frames: DataFrame, weights: DataFrame, cands: DataFrame, vectors: DataFrame, block: int = VECTOR_BLOCK) -> DataFrame:
    """(doc_id, pos, entity_id, cosine) of the candidates whose cosine is not 0.

    ``frames``(doc_id, pos, begin, end) of tokens, ``weights``(term, idf, doc_id) of each term of each text, ``cands``(doc_id, pos, entity_id), ``vectors``(entity_id, term, w).
    """
    each = cands.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "entity_id")).alias("c"))
    framed = frames.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("pos", "begin", "end"))).alias("f"))
    weighed = weights.groupBy("doc_id").agg(F.collect_list(F.struct("term", "idf")).alias("t"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(framed, "doc_id").join(weighed, "doc_id").join(each, "doc_id")
    rows = rows.select("doc_id", "text", "t.term", "t.idf", "f.pos", "f.begin", "f.end", F.col("c.pos").alias("c_pos"), "c.entity_id")
    wanted = stored(vectors.select("entity_id", "term", "w").join(cands.select("entity_id").distinct(), "entity_id", "left_semi"))
    blocks = max(1, -(-wanted.count() // block))
    if blocks > 1:
        rows = stored(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(k: int) -> DataFrame:
        some = wanted.where(F.pmod(F.xxhash64("entity_id"), F.lit(blocks)) == k)
        sent = docs.sparkSession.sparkContext.broadcast(Vectors(some.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = sent.value
            local = np.full(len(v.words), -1)
            for batch in (part for whole in batches for part in tk._slices_of(whole)):
                yield _batch(batch, v, local)

        made = rows.mapInArrow(run, f"doc_id {kind}, pos int, entity_id int, cosine double")
        if blocks == 1:
            return made
        made = stored(made)
        sent.destroy()
        return made

    return functools.reduce(DataFrame.unionByName, [of(k) for k in range(blocks)])
