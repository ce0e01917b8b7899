"""Linking of texts against a stored knowledge base: one text, a table of texts, or texts as they arrive."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from entlink.operators import bp, detect, links, walk
from entlink.session import stored


class Knowledge(NamedTuple):
    """What linking needs to know: dictionary, document frequencies, entity vectors, relatedness, co-citation, popularity."""

    dictionary: DataFrame
    df: DataFrame
    vectors: DataFrame
    rel: DataFrame
    common: DataFrame
    popular: DataFrame

    @classmethod
    def of(cls, base) -> Knowledge:
        """That of ``plans.base.Base``."""
        return cls(base.dictionary, base.df, base.vectors, base.rel, base.common, base.popular)


def link_texts(docs: DataFrame, known: Knowledge, threshold: float | None, method: str) -> DataFrame:
    """(doc_id, pos, n, mention, entity_id) of ``docs``(doc_id, text), one text or many.

    The mentions are those of at least this keyphraseness, or without a threshold the usual share of each text's tokens. ``method`` is
    ``frequent``, ``walk`` or ``bp`` (full scorer), the last two run to convergence.
    """
    found = detect.spots(docs, known.dictionary)
    kept = detect.top_share(found) if threshold is None else detect.by_threshold(found, threshold)
    return solve(docs, stored(detect.importance(kept)), known, method)


def solve(docs: DataFrame, mentions: DataFrame, known: Knowledge, method: str) -> DataFrame:
    """The same for given mentions with their importance."""
    cands = detect.candidates(mentions, known.dictionary)
    if method == "frequent":
        return detect.most_frequent(cands)
    if method not in ("walk", "bp"):
        raise ValueError(f"no such method: {method}")
    scored = stored(detect.text_compatibility(docs, mentions, cands, known.df, known.vectors))
    if method == "bp":
        return detect.best_scored(bp.converge(*bp.Full().prepare(scored, known.rel, known.common, known.popular)), "score")
    graph = stored(walk.edges(scored, links.related_pairs(scored, known.rel)))
    ranks = walk.converge(graph, walk.vertices(mentions, scored), tolerance=1e-10, most=200)
    return detect.best_scored(walk.decide(scored, ranks), "score")


def link_batch(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The most frequent entity of each mention of ``docs``(doc_id, text)."""
    mentions = detect.top_share(detect.spots(docs, dictionary))
    return detect.most_frequent(detect.candidates(mentions, dictionary))


def link_stream(docs: DataFrame, dictionary: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Links every micro-batch of the stream and writes it under ``out``/batch=N.

    A batch that is run again after a failure replaces its own folder, so each is written once in effect.
    """

    def write(batch: DataFrame, number: int) -> None:
        link_batch(batch, dictionary).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
