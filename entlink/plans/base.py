"""Frames that many queries share, built once per session and data directory.

A frame that is costly and used again is written to the shared folder and read back, so that plans stay
small and the loss of an executor loses nothing.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from entlink.operators import detect, kb, links, walk
from entlink.session import release, stored, table

_known: dict[tuple[str, str], Base] = {}


class Base:
    """The knowledge base and the detected mentions of one data directory."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    @classmethod
    def of(cls, spark: SparkSession, d: str) -> Base:
        key = (spark.sparkContext.applicationId, d)
        if key not in _known:
            _known[key] = cls(spark, d)
        return _known[key]

    @staticmethod
    def forget(spark: SparkSession) -> None:
        """Drops all shared frames of the session and their files; do so when tables have changed."""
        for key in [k for k in _known if k[0] == spark.sparkContext.applicationId]:
            del _known[key]
        release(spark)

    def kept(self, df: DataFrame) -> DataFrame:
        return stored(df)

    @cached_property
    def docs(self) -> DataFrame:
        return kb.documents(self.spark, self.d)

    @cached_property
    def edges(self) -> DataFrame:
        return self.kept(kb.resolved_links(self.spark, self.d))

    @cached_property
    def counts(self) -> DataFrame:
        return kb.candidate_counts(self.edges)

    @cached_property
    def inlinks(self) -> DataFrame:
        return self.kept(kb.inlinks(self.edges))

    @cached_property
    def keyphraseness(self) -> DataFrame:
        return self.kept(kb.keyphraseness(self.docs, self.edges))

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.kept(kb.mention_dictionary(self.keyphraseness, self.counts))

    @cached_property
    def df(self) -> DataFrame:
        return self.kept(kb.term_df(self.docs))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.kept(kb.entity_tfidf(self.docs, self.df, detect.DOCS_IN_CORPUS))

    @cached_property
    def spots(self) -> DataFrame:
        return self.kept(detect.spots(self.docs, self.dictionary))

    @cached_property
    def mentions(self) -> DataFrame:
        """The mentions that are linked, with their importance."""
        return self.kept(detect.importance(detect.top_share(self.spots)))

    @cached_property
    def weights(self) -> DataFrame:
        return self.kept(detect.context_weights(detect.contexts(self.docs, self.mentions), self.df))

    @cached_property
    def candidates(self) -> DataFrame:
        return detect.candidates(self.mentions, self.dictionary)

    @cached_property
    def scored(self) -> DataFrame:
        """Candidates with compatibility, the truth of small differences between engines rounded away."""
        return self.kept(detect.text_compatibility(self.docs, self.mentions, self.candidates, self.df, self.vectors))

    @cached_property
    def popular(self) -> DataFrame:
        return self.kept(links.popularity(self.inlinks))

    @cached_property
    def common(self) -> DataFrame:
        return self.kept(links.cocitation(self.inlinks))

    @cached_property
    def rel(self) -> DataFrame:
        return self.kept(links.relatedness(self.inlinks, self.common))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.kept(links.related_pairs(self.scored, self.rel))

    @cached_property
    def truth(self) -> DataFrame:
        return self.kept(kb.document_links(self.docs, self.edges))

    @cached_property
    def frequent_solution(self) -> DataFrame:
        return self.kept(detect.most_frequent(self.candidates))

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Edges and vertices of the referent graphs."""
        return self.kept(walk.edges(self.scored, self.pairs)), self.kept(walk.vertices(self.mentions, self.scored))

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.d, name)
