"""Mention detection: spots of dictionary entries, their ranking, and their local fit to candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entlink.operators import compat
from entlink.operators import tokens as tk
from entlink.operators.kb import idf

# Corpus size of document frequencies, the share of tokens that are kept as mentions, the candidate cap.
DOCS_IN_CORPUS = 4532295
PERCENT = 0.06
MAX_CANDIDATES = 2000
CONTEXT = 50


def spots(docs: DataFrame, dictionary: DataFrame, most: int = tk.NGRAM_SIZE) -> DataFrame:
    """(doc_id, n_tokens, pos, n, mention, off, len, linked, total, name_freq, n_candidates, keyphraseness): every n-gram that is a dictionary entry."""
    entries = dictionary.groupBy("mention").agg(F.first("linked").alias("linked"), F.first("total").alias("total"), F.first("name_freq").alias("name_freq"), F.count("*").alias("n_candidates"))
    found = tk.dictionary_ngrams(docs, entries, most).drop("ngram")
    return found.withColumn("keyphraseness", F.col("linked") / F.col("total"))


def few_candidates(found: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """Spots whose mention has at most ``most`` candidates."""
    return found.where(F.col("n_candidates") <= most)


def by_threshold(found: DataFrame, threshold: float) -> DataFrame:
    """Spots of at least this keyphraseness."""
    return found.where(F.col("keyphraseness") >= threshold)


def top_share(found: DataFrame, percent: float = PERCENT) -> DataFrame:
    """Per text the spots of highest keyphraseness, as many as ``percent`` of its tokens, at least one.

    Ties are broken by the later offset, then by the greater mention, then by the longer span.
    """
    order = [F.desc("keyphraseness"), F.desc("off"), F.desc("mention"), F.desc("n")]
    most = F.greatest(F.floor(F.col("n_tokens") * F.lit(percent)), F.lit(1))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("rank") <= most)


def _frames(mentions: DataFrame, width: int) -> DataFrame:
    """(doc_id, pos, begin, end): the frame of tokens around each mention; it is shifted at the ends of a text."""
    begin, end = tk.context_bounds(F.col("pos"), F.col("n_tokens"), width)
    return mentions.select("doc_id", "pos", begin.alias("begin"), end.alias("end"))


def contexts(docs: DataFrame, mentions: DataFrame, width: int = CONTEXT) -> DataFrame:
    """(doc_id, pos, term, tf): the terms around each mention."""
    return tk.frame_terms(docs, _frames(mentions, width))


def context_texts(docs: DataFrame, mentions: DataFrame, width: int = CONTEXT) -> DataFrame:
    """(doc_id, pos, context): the tokens around each mention in their order, at most ``width`` of them."""
    return tk.frame_texts(docs, _frames(mentions, width))


def context_weights(context: DataFrame, df: DataFrame, n_docs: int = DOCS_IN_CORPUS) -> DataFrame:
    """(doc_id, pos, term, tf, w): TF-IDF of the contexts; unseen terms have document frequency 0."""
    return context.join(df, "term", "left").select("doc_id", "pos", "term", "tf", (F.col("tf") * idf(F.col("df"), F.lit(n_docs))).alias("w"))


def norms(vectors: DataFrame, *key: str) -> DataFrame:
    """Euclidean norm of each vector."""
    return vectors.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def candidates(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, pos, n, mention, entity_id, freq, name_freq): each mention with its candidates."""
    return mentions.select("doc_id", "pos", "n", "mention").join(dictionary.select("mention", "entity_id", "freq", "name_freq"), "mention")


def compatibility(cands: DataFrame, weights: DataFrame, vectors: DataFrame) -> DataFrame:
    """``cands`` with ``compat``: the cosine of context and entity vector, 0 where either is missing or zero.

    Only candidates with a vector take part in the term join. It makes a row of every term of every candidate; a check of :func:`text_compatibility`.
    """
    known = norms(vectors, "entity_id").where("norm > 0")
    pairs = cands.select("doc_id", "pos", "entity_id").distinct().join(known, "entity_id")
    around = weights.join(norms(weights, "doc_id", "pos").withColumnRenamed("norm", "around"), ["doc_id", "pos"]).where("around > 0")
    dots = (
        pairs.join(around, ["doc_id", "pos"])
        .join(vectors.select("entity_id", "term", F.col("w").alias("we")), ["entity_id", "term"])
        .groupBy("doc_id", "pos", "entity_id")
        .agg((F.sum(F.col("w") * F.col("we")) / (F.first("around") * F.first("norm"))).alias("cosine"))
    )
    return cands.join(dots, ["doc_id", "pos", "entity_id"], "left").withColumn("compat", F.coalesce("cosine", F.lit(0.0))).drop("cosine")


def text_compatibility(docs: DataFrame, mentions: DataFrame, cands: DataFrame, df: DataFrame, vectors: DataFrame, n_docs: int = DOCS_IN_CORPUS) -> DataFrame:
    """The same, rounded to 9 places, from the texts themselves: no term of a context becomes a row."""
    weights = tk.text_terms(docs.join(mentions.select("doc_id").distinct(), "doc_id", "left_semi")).join(df, "term", "left").select("doc_id", "term", idf(F.col("df"), F.lit(n_docs)).alias("idf"))
    dots = compat.cosines(docs, _frames(mentions, CONTEXT), weights, cands, vectors)
    return cands.join(dots, ["doc_id", "pos", "entity_id"], "left").withColumn("compat", F.round(F.coalesce("cosine", F.lit(0.0)), 9)).drop("cosine")


def drop_incompatible(scored: DataFrame) -> DataFrame:
    """Without the mentions whose candidates have no compatibility at all."""
    w = Window.partitionBy("doc_id", "pos", "n")
    return scored.withColumn("all", F.sum("compat").over(w)).where("all > 0").drop("all")


def importance(mentions: DataFrame, n_docs: int = DOCS_IN_CORPUS, tf: Column | None = None) -> DataFrame:
    """``mentions`` with ``importance``: ln(N / documents of the mention), as a share of its text's sum.

    The number of occurrences counts as one, as every mention occurs; pass ``tf`` for true counts.
    """
    weight = (F.lit(1) if tf is None else tf) * F.log(F.lit(n_docs) / F.col("total"))
    return mentions.withColumn("weight", weight).withColumn("importance", F.col("weight") / F.sum("weight").over(Window.partitionBy("doc_id"))).drop("weight")


def most_frequent(cands: DataFrame) -> DataFrame:
    """(doc_id, pos, n, mention, entity_id): the candidate linked most often, the smaller of equal ones."""
    best = F.max_by("entity_id", F.struct(F.col("freq"), -F.col("entity_id"))).alias("entity_id")
    return cands.groupBy("doc_id", "pos", "n", "mention").agg(best)


def best_scored(scored: DataFrame, score: str, digits: int = 9, by: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, n, mention, entity_id): the candidate of the highest rounded score, the smaller of equal ones; for each run ``by``."""
    best = F.max_by("entity_id", F.struct(F.round(score, digits), -F.col("entity_id"))).alias("entity_id")
    return scored.groupBy(*(by or []), "doc_id", "pos", "n", "mention").agg(best)
