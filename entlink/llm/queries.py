"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.llm import canonical, cooccur, frequent, packing, readability, termfreq, tokenizer, topn
from entlink.session import mention_key, once, spread, stored, table


def _unresolved(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "page_links").where(F.col("canonical_target").isNull() & F.col("normalized_target").isNotNull())
    links = links.select("link_id", "normalized_target").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "link_id")  # the search is long: no coalescing
    return once(links, "link_id").where(F.length(F.translate("normalized_target", " \t", "")) > 0)


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    names = canonical.reference_names(table(spark, d, "titles"), table(spark, d, "redirects"))
    return canonical.map_values(_unresolved(spark, d), "link_id", "normalized_target", names)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The title that each unresolved link target means, -1 if none."""
    return _mapped(spark, d).select("link_id", "entity_id")


def _link_records(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "entity_links").select("record_id", F.col("links.src").alias("pages"))
    return once(records, "record_id")


def far_above_chance(parts: int, times: int) -> Column:
    """Whether a pair is in one of ``parts`` of the records and ``times`` as often as by chance; products of counts pass 64 bits at billions of records."""
    n_ab, n_a, n_b, n = (F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n_a", "n_b", "n_records"))
    return (n_ab * parts >= n) & (n_ab * n >= n_a * n_b * times)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of pages in at least 5 records and a 200th of them, three times more often than by chance."""
    pairs = cooccur.cooccurrence(_link_records(spark, d), "pages", min_count=5, min_share=1 / 200)
    return pairs.where(far_above_chance(200, 3)).select("src_a", "src_b")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of pages with its count, lift and corrected odds ratio."""
    return cooccur.cooccurrence(_link_records(spark, d), "pages").select(
        "src_a", "src_b", "n_ab", "n_a", "n_b", "n_records", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio")
    )


def _entries(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "mention_candidates").select("entry_id", "mention", "name_freq", "top_candidates")
    return once(entries, "entry_id")


def _candidate_sums(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d).where("mention is not null")
    each = entries.select(mention_key("mention").alias("mention"), F.explode("top_candidates").alias("entity_id", "freq"))
    return each.groupBy("mention", "entity_id").agg(F.coalesce(F.sum(F.col("freq").cast("bigint")), F.lit(0)).alias("freq"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The up to three most frequent entities of each mention."""
    return topn.top_n(_candidate_sums(spark, d), "mention", "entity_id", "freq", 3).select("mention", "entity_id")


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The same with sums and ranks."""
    return topn.top_n(_candidate_sums(spark, d), "mention", "entity_id", "freq", 3)


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    entries = stored(_entries(spark, d).withColumn("mention", mention_key("mention")))  # each of two columns is read twice
    mentions = entries.select(F.col("mention").alias("item"), F.col("name_freq").alias("weight"))
    entities = entries.select(F.explode("top_candidates").alias("item", "weight"))
    parts = [frequent.frequent_items(rows, "item", "weight", 0.01).withColumn("kind", F.lit(kind)) for kind, rows in (("mention", mentions), ("entity", entities))]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The mentions and entities with at least a hundredth of all weight."""
    return _frequent(spark, d).select("kind", "item")


def p4_weights(spark: SparkSession, d: str) -> DataFrame:
    """The same with exact weights; the bounds of the summary must hold them."""
    return _frequent(spark, d).select("kind", "item", "weight", "total", F.col("weight").between(F.col("count") - F.col("error"), F.col("count")).alias("bounded"))


def _mention_counts(spark: SparkSession, d: str) -> DataFrame:
    records = once(table(spark, d, "keyphraseness").select("record_id", "batch_no", "mention", "linked", "total"), "record_id")
    named = stored(records.withColumn("mention", mention_key("mention")).drop("record_id"))
    counts = termfreq.term_counts(named, "mention", "batch_no", ["linked", "total"])
    return termfreq.marked(counts, "total", named, "batch_no", 3, 0.4)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The mentions that are too rare or too common."""
    marks = F.array_compact(F.array(F.when(F.col("is_rare"), F.lit("rare")), F.when(F.col("is_common"), F.lit("common"))))
    return _mention_counts(spark, d).select("mention", F.explode(marks).alias("mark"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with its sums, its number of batches and its marks."""
    return _mention_counts(spark, d).select("mention", "linked", "total", "n_records", "is_rare", "is_common")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizer.token_ids(_documents(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of 4,096 tokens."""
    docs = _documents(spark, d)
    return packing.pack(tokenizer.token_counts(docs), "doc_id", "n_tokens", 4096, table(spark, d, "documents").count())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The English documents of level 4 or 5."""
    english = _documents(spark, d).where("lang = 'en' and text is not null")
    levels = readability.fit(table(spark, d, "graded_texts"))
    return readability.reading_levels(english, levels).where("reading_level >= 4").select("doc_id")


def queries() -> dict:
    """Every query of this package by name."""
    every = [p1_found, p2_found, p2_pairs, p3_found, p3_ranked, p4_found, p4_weights, p5_found, p5_counts, p7_ids, p8_containers, p9_found]
    return {f.__name__: f for f in every}
