"""Measures on in-links: popularity, co-citation, relatedness, conditional denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: number of articles.
ARTICLES = 4399390


def popularity(inlinks: DataFrame) -> DataFrame:
    """(entity_id, popularity, popularity_freq): one plus linking pages, one plus links."""
    return inlinks.groupBy("entity_id").agg((F.count("*") + 1).alias("popularity"), (F.sum("freq") + 1).alias("popularity_freq"))


#: Entities of a page that are paired in one piece; the pairs of pages with more are made in pieces of about so many by so many.
PAGE_PIECE = 1_000


def cocitation(inlinks: DataFrame) -> DataFrame:
    """(e1, e2, common, weighted) with e1 < e2 of all entities that a page links together.

    Pages are the join key, so popular entities do not make a large group. The entities of a page with many
    links are parted by a hash; each pair of parts is a group of its own.
    """
    parts = inlinks.groupBy("src").agg(F.ceil(F.count("*") / PAGE_PIECE).alias("k"))
    rows = inlinks.join(parts, "src").withColumn("part", F.pmod(F.xxhash64("entity_id"), "k"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1))
    a = rows.select("src", F.col("entity_id").alias("e1"), F.col("freq").alias("f1"), F.col("part").alias("p1"), every.alias("p2"))
    b = rows.select("src", F.col("entity_id").alias("e2"), F.col("freq").alias("f2"), every.alias("p1"), F.col("part").alias("p2"))
    return a.join(b, ["src", "p1", "p2"]).where("e1 < e2").groupBy("e1", "e2").agg(F.count("*").alias("common"), F.sum(F.col("f1") * F.col("f2")).alias("weighted"))


def self_cocitation(inlinks: DataFrame) -> DataFrame:
    """(entity_id, self_cocitation): pairs of links from the same page."""
    return inlinks.groupBy("entity_id").agg(F.sum(F.floor(F.col("freq") * (F.col("freq") - 1) / 2)).cast("bigint").alias("self_cocitation"))


def conditional_denominator(inlinks: DataFrame, outlinks: DataFrame) -> DataFrame:
    """(entity_id, denominator): pairs of links of the citing pages that take in a link to the entity."""
    f, d = F.col("freq"), F.col("out_links")
    pairs = f * (d - f) + F.floor(f * (f - 1) / 2)
    return inlinks.join(outlinks, "src").groupBy("entity_id").agg(F.sum(pairs).cast("bigint").alias("denominator"))


def relatedness_of(n1: Column, n2: Column, common: Column, articles: int = ARTICLES) -> Column:
    """Semantic relatedness of two different entities from their numbers of in-links; 0 without a common one, not clamped."""
    top = F.log(F.greatest(n1, n2)) - F.log(common)
    return F.when(F.coalesce(common, F.lit(0)) == 0, F.lit(0.0)).otherwise(1 - top / (F.log(F.lit(float(articles))) - F.log(F.least(n1, n2))))


def relatedness(inlinks: DataFrame, common: DataFrame, articles: int = ARTICLES) -> DataFrame:
    """(e1, e2, common, rel) with e1 < e2 of all pairs in ``common``, the result of :func:`cocitation`; every other pair has 0."""
    n = inlinks.groupBy("entity_id").agg(F.count("*").alias("n"))
    a, b = n.select(F.col("entity_id").alias("e1"), F.col("n").alias("n1")), n.select(F.col("entity_id").alias("e2"), F.col("n").alias("n2"))
    pairs = common.select("e1", "e2", "common").join(a, "e1").join(b, "e2")
    return pairs.select("e1", "e2", "common", relatedness_of(F.col("n1"), F.col("n2"), F.col("common"), articles).alias("rel"))


def _turned(values: DataFrame, *columns: str) -> DataFrame:
    """(low, high, e1, e2, columns...): each listed pair from its entity with fewer partners to the one with more.

    So turned, no entity has more than the square root of twice the number of pairs as ``high`` sides, however popular it is.
    """
    ends = values.select(F.col("e1").alias("e")).unionByName(values.select(F.col("e2").alias("e"))).groupBy("e").agg(F.count("*").alias("n"))
    for k in ("1", "2"):
        values = values.join(ends.select(F.col("e").alias(f"e{k}"), F.col("n").alias(f"n{k}")), f"e{k}")
    up = F.struct("n1", "e1") < F.struct("n2", "e2")
    return values.select(F.when(up, F.col("e1")).otherwise(F.col("e2")).alias("low"), F.when(up, F.col("e2")).otherwise(F.col("e1")).alias("high"), "e1", "e2", *columns)


def text_pairs(cands: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, entity1, entity2, columns...): the listed pairs of entities of each text, once."""
    own = cands.select("doc_id", "entity_id").distinct()
    low = own.select("doc_id", F.col("entity_id").alias("low")).join(_turned(values.select("e1", "e2", *columns), *columns), "low")
    up = low.join(own.select("doc_id", F.col("entity_id").alias("high")), ["doc_id", "high"], "left_semi")
    return up.select("doc_id", F.col("e1").alias("entity1"), F.col("e2").alias("entity2"), *columns)


def listed_pairs(cands: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, pos1, n1, entity1, pos2, n2, entity2, columns...): candidates of different mentions of a text, both orders, whose entities are listed in ``values``(e1 < e2, columns...) or equal.

    The columns are NULL for equal entities. The entities of a text are joined to the listed pairs of each, from the
    side with fewer partners, and what has its other side in the text is spread over the mentions; pairs that are not listed
    are never made.
    """
    own = cands.select("doc_id", "entity_id").distinct()
    up = text_pairs(cands, values, *columns)
    down = up.select("doc_id", F.col("entity2").alias("entity1"), F.col("entity1").alias("entity2"), *columns)
    same = own.select("doc_id", F.col("entity_id").alias("entity1"), F.col("entity_id").alias("entity2"), *[F.lit(None).cast(values.schema[c].dataType).alias(c) for c in columns])
    every = up.unionByName(down).unionByName(same)
    for k in ("1", "2"):
        every = every.join(cands.select("doc_id", F.col("entity_id").alias(f"entity{k}"), F.col("pos").alias(f"pos{k}"), F.col("n").alias(f"n{k}")), ["doc_id", f"entity{k}"])
    return every.where("pos1 <> pos2 or n1 <> n2").select("doc_id", "pos1", "n1", "entity1", "pos2", "n2", "entity2", *columns)


def related_pairs(cands: DataFrame, values: DataFrame) -> DataFrame:
    """Candidate pairs with a relatedness ``rel``; pairs without a common in-link have none."""
    return listed_pairs(cands, values, "rel").withColumn("rel", F.coalesce("rel", F.lit(1.0)))
