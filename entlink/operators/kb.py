"""Knowledge base: titles, redirects, mention dictionary, in-links, term statistics.

Every frame is one declarative plan over the source tables. Deliveries are removed once, on the
narrow column set that a plan needs. Reference-sized sides (titles, redirects) carry no hint: Spark
broadcasts them while they are small by its own size statistics and joins by shuffling beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entlink.functions import text as T
from entlink.session import once, spread, table

MINIMUM_COUNT = 5
SHARE_LIMIT = 0.02


def articles(spark: SparkSession, d: str) -> DataFrame:
    """(docno, title) of article pages that are no redirects."""
    pages = once(table(spark, d, "pages").select("docno", "title", "is_article", "is_redirect"), "docno")
    return pages.where("is_article and not is_redirect").select("docno", "title")


def canonical_titles(spark: SparkSession, d: str) -> DataFrame:
    """(docno, title) of pages that may be entities: articles, no lists, disambiguations or namespace pages."""
    t = F.col("title")
    return articles(spark, d).where(t.isNotNull() & ~T.is_list_page(t) & ~T.is_disambiguation(t) & ~T.is_namespace(t))


def redirect_map(spark: SparkSession, d: str) -> DataFrame:
    """(from_title, to_title), one row for each from_title, targets made titles."""
    rows = table(spark, d, "redirects").select("from_title", T.remove_hash(T.process_target(F.col("to_title"))).alias("to_title"))
    return rows.groupBy("from_title").agg(F.min("to_title").alias("to_title"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(link_id, src, mention, target): every link once; the mention normalised, the target as a title."""
    rows = once(table(spark, d, "page_links").select("link_id", "docno", "anchor_text", "normalized_target"), "link_id")
    return rows.select("link_id", F.col("docno").alias("src"), T.normalize(F.col("anchor_text")).alias("mention"), T.process_target(F.col("normalized_target")).alias("target"))


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """(link_id, src, mention, target, entity_id): links from articles whose target, through one redirect at most, is a title."""
    found = links(spark, d).where("mention <> ''").join(articles(spark, d).select(F.col("docno").alias("src")), "src", "left_semi")
    through = found.join(redirect_map(spark, d), F.col("target") == F.col("from_title"), "left").withColumn("target", F.coalesce("to_title", "target"))
    titles = table(spark, d, "titles").select("title", F.col("id").alias("entity_id"))
    return through.join(titles, F.col("target") == F.col("title")).select("link_id", "src", "mention", "target", "entity_id")


def candidate_counts(edges: DataFrame) -> DataFrame:
    """(mention, entity_id, freq, name_freq): how often each mention links each entity, and anything."""
    counts = edges.groupBy("mention", "entity_id").agg(F.count("*").alias("freq"))
    return counts.withColumn("name_freq", F.sum("freq").over(Window.partitionBy("mention")))


def cut_candidates(counts: DataFrame, limit: float = SHARE_LIMIT) -> DataFrame:
    """The candidates that hold at least ``limit`` of their mention's links."""
    return counts.where(F.col("freq") >= F.lit(limit) * F.col("name_freq"))


def inlinks(edges: DataFrame) -> DataFrame:
    """(entity_id, src, freq): how often each page links each entity."""
    return edges.groupBy("entity_id", "src").agg(F.count("*").alias("freq"))


def outlinks(edges: DataFrame) -> DataFrame:
    """(src, out_links): the number of links of each page."""
    return edges.groupBy("src").agg(F.count("*").alias("out_links"))


def entity_link_entries(edges: DataFrame) -> DataFrame:
    """(entity_id, total_freq, out_links, links): one entry per linked entity, links ascending by page.

    An entity's own out-links are those of the page with its id.
    """
    entry = inlinks(edges).groupBy("entity_id").agg(F.sum("freq").alias("total_freq"), F.array_sort(F.collect_list(F.struct("src", "freq"))).alias("links"))
    own = outlinks(edges).select(F.col("src").alias("entity_id"), "out_links")
    return entry.join(own, "entity_id", "left").select("entity_id", "total_freq", F.coalesce("out_links", F.lit(0)).alias("out_links"), "links")


def link_counters(edges: DataFrame) -> DataFrame:
    """(pairs_total, links_total) over all pages, in 64 bits."""
    n = F.col("out_links")
    return outlinks(edges).agg(F.sum(F.floor(n * (n - 1) / 2)).cast("bigint").alias("pairs_total"), F.sum(n).cast("bigint").alias("links_total"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, docno, filename, text); doc_id is unique."""
    return spread(table(spark, d, "documents").select("doc_id", "docno", "filename", "text"), "doc_id")


def document_links(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, mention, entity_id), distinct: the links of the page that a document belongs to."""
    pages = edges.select(F.col("src").alias("docno"), "mention", "entity_id").distinct()
    return docs.select("doc_id", "docno").join(pages, "docno").select("doc_id", "mention", "entity_id")


def keyphraseness(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(mention, linked, total): in how many documents a mention is linked, and is linked or occurs."""
    from entlink.operators.tokens import dictionary_ngrams

    mentions = edges.select("mention").distinct()
    plain = docs.select("doc_id", T.normalize(F.col("text")).alias("text"))
    inside = dictionary_ngrams(plain, mentions).where("ngram = mention").select("doc_id", "mention", F.lit(0).alias("linked"))
    linked = document_links(docs, edges).select("doc_id", "mention", F.lit(1).alias("linked"))
    each = inside.unionByName(linked).groupBy("doc_id", "mention").agg(F.max("linked").alias("linked"))
    return each.groupBy("mention").agg(F.sum("linked").alias("linked"), F.count("*").alias("total"))


def mention_dictionary(keyphrases: DataFrame, counts: DataFrame, minimum: int = MINIMUM_COUNT) -> DataFrame:
    """(mention, linked, total, name_freq, entity_id, freq): one row per candidate of the mentions worth keeping."""
    kept = keyphrases.where(f"total >= {minimum} and linked <> 0")
    return kept.join(cut_candidates(counts), "mention")


def terms(docs: DataFrame, key: str) -> DataFrame:
    """(key, term): one row for each term occurrence of the normalised texts."""
    words = F.split(T.normalize_no_delimiters(F.col("text")), " ")
    return docs.select(key, F.explode(words).alias("term")).where("term <> ''")


def term_df(docs: DataFrame) -> DataFrame:
    """(term, df): the number of documents of each term."""
    each = docs.select(F.explode(F.array_distinct(F.split(T.normalize_no_delimiters(F.col("text")), " "))).alias("term"))
    return each.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))


def idf(df, n_docs):
    """log10(N / (df + 1)), 0 where that is the whole corpus; unseen terms have df 0."""
    seen = F.coalesce(df, F.lit(0)) + 1
    return F.when(seen == n_docs, F.lit(0.0)).otherwise(F.log10(n_docs / seen))


def entity_tfidf(docs: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(entity_id, term, tf, w): the TF-IDF vector of each entity's texts."""
    tf = terms(docs.where("docno is not null"), "docno").groupBy("docno", "term").agg(F.count("*").alias("tf"))
    return tf.join(df, "term", "left").select(F.col("docno").alias("entity_id"), "term", "tf", (F.col("tf") * idf(F.col("df"), F.lit(n_docs))).alias("w"))


def lookup_vector(vectors: DataFrame, entity_id: int) -> DataFrame:
    """The vector of one entity, heaviest terms first."""
    return vectors.where(F.col("entity_id") == entity_id).orderBy(F.desc("w"), "term")
