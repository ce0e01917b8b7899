"""Registered queries: name -> function of (spark, directory).

Doubles are rounded to 6 places at the end, arrays are given as text, counts are BIGINT.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entlink.functions import text as T
from entlink.operators import bp, detect, evaluate, kb, links, skew, thresholds, walk
from entlink.operators import tokens as tk
from entlink.plans.base import Base
from entlink.session import once, stored, table
from entlink.sources import formats
from entlink.streaming import linker

_REGISTRY: dict = {}


def query(f):
    """Register a query under its own name."""
    _REGISTRY[f.__name__] = f
    return f


def _r(c: str, digits: int = 6):
    return (F.round(c, digits) + F.lit(0.0)).alias(c)  # no negative zero


def _joined(c: str):
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


# --- titles, redirects, links -------------------------------------------------------------------------------


@query
def titles_index(spark: SparkSession, d: str) -> DataFrame:
    """Pages that may be entities, by title."""
    return kb.canonical_titles(spark, d).orderBy("title", "docno")


@query
def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every entity of the in-link lists with its title, NULL if it has none."""
    ids = table(spark, d, "entity_links").select("entity_id").where("entity_id is not null").distinct()
    return ids.join(table(spark, d, "titles").withColumnRenamed("id", "entity_id"), "entity_id", "left").select("entity_id", "title")


@query
def redirect_map(spark: SparkSession, d: str) -> DataFrame:
    """Redirects with their target as a title, duplicates removed."""
    return kb.redirect_map(spark, d)


@query
def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Each link's target after one redirect, and its entity; -1 if it is no title."""
    rows = kb.links(spark, d).select("link_id", "target").join(kb.redirect_map(spark, d), F.col("target") == F.col("from_title"), "left")
    titles = table(spark, d, "titles").select("title", F.col("id").alias("entity_id"))
    rows = rows.select("link_id", F.coalesce("to_title", "target").alias("resolved")).join(titles, F.col("resolved") == F.col("title"), "left")
    return rows.groupBy(F.coalesce("entity_id", F.lit(-1)).alias("entity_id")).agg(F.count("*").alias("n"))


@query
def links_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Valid links: both ends canonical and a mention that is not blank."""
    return Base.of(spark, d).edges.select("link_id", "src", "mention", "entity_id")


@query
def normalized_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Normalised anchors and how many links have them."""
    return kb.links(spark, d).groupBy("mention").agg(F.count("*").alias("n"))


@query
def normalized_target(spark: SparkSession, d: str) -> DataFrame:
    """Processed targets and how many links have them."""
    return kb.links(spark, d).groupBy("target").agg(F.count("*").alias("n"))


@query
def normalize_no_delims(spark: SparkSession, d: str) -> DataFrame:
    """Length and hash-like figures of the texts normalised without delimiters."""
    text = T.normalize_no_delimiters(F.col("text"))
    return kb.documents(spark, d).select("doc_id", F.length(text).alias("length"), F.size(F.split(text, " ")).alias("words"), F.substring(text, 1, 40).alias("start"))


@query
def normalize_no_delims_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole texts normalised without delimiters."""
    return kb.documents(spark, d).select("doc_id", T.normalize_no_delimiters(F.col("text")).alias("normalized"))


# --- dictionary ------------------------------------------------------------------------------------------------


@query
def mention_all_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each mention with all its entities, ascending."""
    return Base.of(spark, d).edges.groupBy("mention").agg(_joined("entity_id").alias("candidates"))


@query
def mention_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each mention with the entities of at least 2 % of its links, most frequent first."""
    cut = kb.cut_candidates(Base.of(spark, d).counts)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("a"), F.col("entity_id").alias("e"))))
    return cut.groupBy("mention").agg(F.array_join(F.transform(ordered, lambda x: x["e"]), ",").alias("candidates"))


@query
def mention_top_candidates_10(spark: SparkSession, d: str) -> DataFrame:
    """The same with a cut of 10 %."""
    return kb.cut_candidates(Base.of(spark, d).counts, 0.1).select("mention", "entity_id", "freq", "name_freq")


@query
def mention_candidate_freq(spark: SparkSession, d: str) -> DataFrame:
    """Candidates after the 2 % cut with their counts and the mention's total before it."""
    return kb.cut_candidates(Base.of(spark, d).counts).select("mention", "entity_id", "freq", "name_freq")


@query
def mention_debug_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each mention with its distinct target+source strings, unresolved."""
    rows = kb.links(spark, d).where("mention <> '' and target is not null").join(kb.articles(spark, d).where("title is not null"), F.col("src") == F.col("docno"))
    return rows.groupBy("mention").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("+", "target", "title"))), "|").alias("pairs"))


@query
def entity_inlinks(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with its distinct linking pages, ascending."""
    return Base.of(spark, d).inlinks.groupBy("entity_id").agg(_joined("src").alias("srcs"))


@query
def entity_links_freq(spark: SparkSession, d: str) -> DataFrame:
    """In-link entries: total, own out-links, and page,freq pairs."""
    rows = kb.entity_link_entries(Base.of(spark, d).edges)
    return rows.select("entity_id", "total_freq", "out_links", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["src"], x["freq"])), ",").alias("links"))


@query
def link_counters(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of links and links over all pages."""
    return kb.link_counters(Base.of(spark, d).edges)


@query
def keyphraseness(spark: SparkSession, d: str) -> DataFrame:
    """Documents that link each mention, and that hold it."""
    return Base.of(spark, d).keyphraseness.select("mention", F.col("linked").cast("bigint").alias("linked"), "total")


@query
def mention_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The merged dictionary after admission."""
    return Base.of(spark, d).dictionary.select("mention", F.col("linked").cast("bigint").alias("linked"), "total", "name_freq", "entity_id", "freq")


@query
def batch_keyphraseness(spark: SparkSession, d: str) -> DataFrame:
    """Keyphraseness merged from partial counts of batches and joined to the partial candidate entries of the same mention."""
    from entlink.session import mention_key

    kp = once(table(spark, d, "keyphraseness").select("record_id", "mention", "linked", "total"), "record_id").where("mention is not null")
    kp = kp.groupBy(mention_key("mention").alias("mention")).agg(F.coalesce(F.sum(F.col("linked").cast("bigint")), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("total").cast("bigint")), F.lit(0)).alias("total"))
    names = once(table(spark, d, "mention_candidates").select("entry_id", "mention", "name_freq"), "entry_id").where("mention is not null")
    names = names.groupBy(mention_key("mention").alias("mention")).agg(F.coalesce(F.sum(F.col("name_freq").cast("bigint")), F.lit(0)).alias("name_freq"))
    return kp.join(names, "mention").where(f"total >= {kb.MINIMUM_COUNT} and linked <> 0")


@query
def term_df(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every term."""
    return Base.of(spark, d).df


@query
def entity_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF vectors in long form."""
    return Base.of(spark, d).vectors.select("entity_id", "term", "tf", _r("w"))


@query
def entity_norms(spark: SparkSession, d: str) -> DataFrame:
    """Norm of every entity vector."""
    return detect.norms(Base.of(spark, d).vectors, "entity_id").select("entity_id", _r("norm"))


@query
def tfidf_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The vector of entity 1."""
    return kb.lookup_vector(Base.of(spark, d).vectors, 1).select("term", _r("w"))


# --- tokens and n-grams ------------------------------------------------------------------------------------------


@query
def tokens_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with offsets, summed up per document."""
    return tk.token_figures(kb.documents(spark, d))


@query
def ngrams_1_11(spark: SparkSession, d: str) -> DataFrame:
    """All n-grams of up to 11 tokens: per n their number, offsets and lengths."""
    rows = tk.ngrams(kb.documents(spark, d))
    return rows.groupBy("n").agg(F.count("*").alias("n_grams"), F.sum("off").alias("sum_off"), F.sum("len").alias("sum_len"), F.sum(F.length("ngram")).alias("sum_text"))


@query
def dictionary_spots(spark: SparkSession, d: str) -> DataFrame:
    """Every n-gram that is a dictionary entry, also without its hyphens."""
    return Base.of(spark, d).spots.select("doc_id", "pos", "n", "mention", "off", "len", "linked", "total", "n_candidates", _r("keyphraseness"))


@query
def ngrams_dehyphen(spark: SparkSession, d: str) -> DataFrame:
    """The n-grams that are an entry only without their hyphens."""
    b = Base.of(spark, d)
    found = tk.dictionary_ngrams(b.docs, b.dictionary.select("mention"))
    return found.where("ngram <> mention").select("doc_id", "pos", "n", "ngram", "mention")


@query
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """The tokens around each linked mention, in their order."""
    b = Base.of(spark, d)
    return detect.context_texts(b.docs, b.mentions)


@query
def mentions_topk(spark: SparkSession, d: str) -> DataFrame:
    """The mentions of highest keyphraseness, 6 % of a text's tokens."""
    return Base.of(spark, d).mentions.select("doc_id", "pos", "n", "mention", "off", "len", "rank")


@query
def mentions_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The mentions of keyphraseness at least 0.1."""
    return detect.by_threshold(Base.of(spark, d).spots, 0.1).select("doc_id", "pos", "n", "mention")


@query
def mentions_cap_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The mentions of at most 5 candidates."""
    return detect.few_candidates(Base.of(spark, d).spots, 5).select("doc_id", "pos", "n", "mention")


@query
def mention_context_text(spark: SparkSession, d: str) -> DataFrame:
    """Each linked mention with the 50 characters on either side."""
    b = Base.of(spark, d)
    rows = b.mentions.select("doc_id", "pos", "n", "off", "len").join(b.docs.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "pos", "n", F.substr("text", F.col("off") + 1, F.col("len")).alias("original"), T.window_around(F.col("text"), F.col("off"), F.col("len")).alias("context"))


@query
def context_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Norm and size of the context vector of each mention."""
    w = F.col("w")
    return Base.of(spark, d).weights.groupBy("doc_id", "pos").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.round(F.sqrt(F.sum(w * w)), 6).alias("norm"))


@query
def local_compat(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility of each mention with each candidate."""
    return Base.of(spark, d).scored.select("doc_id", "pos", "n", "mention", "entity_id", _r("compat"))


@query
def compatible_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the mentions with some compatibility."""
    return detect.drop_incompatible(Base.of(spark, d).scored).select("doc_id", "pos", "n", "entity_id")


@query
def mention_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance of each mention in its text."""
    return Base.of(spark, d).mentions.select("doc_id", "pos", "n", _r("importance"))


@query
def prior_probability(spark: SparkSession, d: str) -> DataFrame:
    """P(entity | mention) of every candidate."""
    return Base.of(spark, d).dictionary.select("mention", "entity_id", F.round(F.col("freq") / F.col("name_freq"), 6).alias("p"))


@query
def link_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Each mention with its most frequent entity."""
    b = Base.of(spark, d)
    return detect.most_frequent(b.candidates)


# --- in-link measures -----------------------------------------------------------------------------------------


@query
def popularity(spark: SparkSession, d: str) -> DataFrame:
    """Popularity of every entity, by pages and by links."""
    return Base.of(spark, d).popular


@query
def cocitation(spark: SparkSession, d: str) -> DataFrame:
    """Pages that link both entities of a pair."""
    return Base.of(spark, d).common.select("e1", "e2", "common")


@query
def cocitation_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The same weighted by the product of link counts."""
    return Base.of(spark, d).common.select("e1", "e2", "weighted")


@query
def self_cocitation(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of links from the same page to an entity."""
    return links.self_cocitation(Base.of(spark, d).inlinks)


@query
def conditional_denominator(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of links of the citing pages that take in a link to the entity."""
    b = Base.of(spark, d)
    return links.conditional_denominator(b.inlinks, kb.outlinks(b.edges))


@query
def relatedness_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Semantic relatedness of every pair with a common in-link."""
    return Base.of(spark, d).rel.select("e1", "e2", "common", _r("rel"))


# --- graph and walk ------------------------------------------------------------------------------------------------


def _graph(b: Base) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the graphs of texts are made of; they are made where they are used."""
    return b.mentions, b.scored, b.rel


@query
def referent_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the referent graphs, summed up for each source vertex."""
    return walk.text_sums(*_graph(Base.of(spark, d))).select("doc_id", "pos1", "n1", "entity1", "edges", _r("heaviest"), _r("squares"), "targets")


@query
def referent_edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the referent graphs themselves."""
    return walk.text_edges(*_graph(Base.of(spark, d))).select("doc_id", "pos1", "n1", "entity1", "pos2", "n2", "entity2", _r("w"))


@query
def referent_validate(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the graphs' invariants (none expected) and the number of edges."""
    b = Base.of(spark, d)
    sums = b.kept(walk.text_sums(*_graph(b)).select("doc_id", "edges", F.col("sum").alias("s"), F.col("lightest").alias("low"), F.col("heaviest").alias("high")))
    bad = walk.violations_of(sums, walk.vertices(b.mentions, b.scored)).agg(F.count("*").alias("violations"))
    return bad.crossJoin(sums.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges")))  # one row each


@query
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    """Weakly connected components of each text's graph."""
    return walk.text_components(*_graph(Base.of(spark, d)))


@query
def walk_k_steps(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after three steps of the walk."""
    return walk.text_steps(*_graph(Base.of(spark, d)), 3).select("doc_id", "pos", "n", "entity", _r("p"))


def _walk_solution(b: Base) -> DataFrame:
    ranks = walk.text_converge(*_graph(b), tolerance=1e-10, most=200)
    return detect.best_scored(walk.decide(b.scored, ranks), "score")


@query
def link_walk(spark: SparkSession, d: str) -> DataFrame:
    """Each mention with the entity that the converged walk chooses."""
    return _walk_solution(Base.of(spark, d))


@query
def walk_top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ten best candidates of each mention after three steps."""
    from pyspark.sql import Window

    b = Base.of(spark, d)
    rows = walk.decide(b.scored, walk.text_steps(*_graph(b), 3)).withColumn("score", F.round("score", 9))
    w = Window.partitionBy("doc_id", "pos", "n").orderBy(F.desc("score"), "entity_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("doc_id", "pos", "n", "entity_id", "rank")


@query
def link_walk_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Each mention of keyphraseness at least 0.8 with the entity that the converged walk chooses."""
    b = Base.of(spark, d)
    return linker.link_texts(b.docs, linker.Knowledge.of(b), 0.8, "walk")


# --- belief propagation ---------------------------------------------------------------------------------------------


def _bp(b: Base, scorer) -> tuple[DataFrame, DataFrame]:
    return scorer.prepare(b.kept(b.candidates), None, b.common, b.popular)  # no compatibility, no relatedness


def _bp_k(spark: SparkSession, d: str, scorer) -> DataFrame:
    return bp.rounds(*_bp(Base.of(spark, d), scorer), 2).select("doc_id", "pos", "n", "entity_id", _r("score"))


@query
def bp_basic_k(spark: SparkSession, d: str) -> DataFrame:
    """Final scores after two rounds, scorer of compatibility and relatedness."""
    b = Base.of(spark, d)
    return bp.basic_rounds(b.scored, b.rel, [2]).select("doc_id", "pos", "n", "entity_id", F.col("score0").alias("score")).withColumn("score", _r("score"))


@query
def bp_full_k(spark: SparkSession, d: str) -> DataFrame:
    """Final scores after two rounds, scorer of link probability and co-citation."""
    return _bp_k(spark, d, bp.Full())


@query
def bp_maxent_k(spark: SparkSession, d: str) -> DataFrame:
    """Final scores after two rounds, scorer of popularity and co-citation."""
    return _bp_k(spark, d, bp.MaxEnt())


@query
def bp_delta(spark: SparkSession, d: str) -> DataFrame:
    """Largest change of a score in the second round."""
    b = Base.of(spark, d)
    moved = F.max(F.abs(F.col("score1") - F.col("score0")))
    return bp.basic_rounds(b.scored, b.rel, [1, 2]).groupBy("doc_id").agg(moved.alias("delta")).select("doc_id", _r("delta"))


@query
def link_bp(spark: SparkSession, d: str) -> DataFrame:
    """Each mention with the entity that converged belief propagation chooses."""
    return detect.best_scored(bp.converge(*_bp(Base.of(spark, d), bp.Full())), "score")


# --- evaluation -----------------------------------------------------------------------------------------------------


def _annotations(b: Base) -> DataFrame:
    """Links of the documents' pages with their place in the text and their entity, -1 if unresolved."""
    # ``place`` is the order of annotations: a link that was made earlier stands earlier
    rows = once(b.read("page_links").select("link_id", "docno", "anchor_text", "canonical_target"), "link_id")
    titles = b.read("titles").select("title", F.col("id").alias("entity_id"))
    named = rows.join(titles, F.col("canonical_target") == F.col("title"), "left").select("docno", F.lower(F.trim("anchor_text")).alias("mention"), F.coalesce("entity_id", F.lit(-1)).alias("entity_id"), "link_id")
    named = named.where("mention <> ''").groupBy("docno", "mention", "entity_id").agg(F.min("link_id").alias("place"))
    placed = b.docs.select("doc_id", "docno", F.lower("text").alias("text")).join(named, "docno")
    return placed.select("doc_id", "mention", "entity_id", (F.expr("locate(mention, text)") - 1).alias("off"), F.length("mention").alias("len"), "place").where("off >= 0")


@query
def eval_prf_per_doc(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the most frequent entities, per document."""
    b = Base.of(spark, d)
    return evaluate.per_document(b.frequent_solution, b.truth).select("doc_id", "good", "fp", "fn", _r("precision"), _r("recall"))


@query
def eval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every annotation as good, false positive or false negative, with its title."""
    b = Base.of(spark, d)
    rows = evaluate.outcomes(b.frequent_solution, b.truth)
    return rows.join(b.read("titles").withColumnRenamed("id", "entity_id"), "entity_id", "left").select("doc_id", "mention", "entity_id", "title", "outcome")


@query
def eval_macro_micro(spark: SparkSession, d: str) -> DataFrame:
    """Macro and micro figures."""
    b = Base.of(spark, d)
    return evaluate.summary(evaluate.per_document(b.frequent_solution, b.truth)).select(*[_r(c) for c in ("macro_p", "macro_r", "micro_p", "micro_r", "mean_pr", "f1")], "good", "fp", "fn")


@query
def eval_missing(spark: SparkSession, d: str) -> DataFrame:
    """The attainable recall."""
    b = Base.of(spark, d)
    return evaluate.attainable_recall(b.truth, b.dictionary).select("n_truth", "n_missing", _r("max_recall"))


@query
def truth_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Truth mentions that the dictionary covers, with their number of candidates."""
    b = Base.of(spark, d)
    covered = b.truth.join(b.dictionary.select("mention", "entity_id"), ["mention", "entity_id"], "left_semi")
    size = b.dictionary.groupBy("mention").agg(F.count("*").alias("n_candidates"))
    return covered.join(size, "mention").select("doc_id", "mention", "entity_id", "n_candidates")


@query
def eval_md(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of mention detection, per document."""
    b = Base.of(spark, d)
    return evaluate.detection(b.candidates, b.truth).select("doc_id", "good", "wrong", "n_truth", _r("precision"), _r("recall"))


@query
def eval_diff_runs(spark: SparkSession, d: str) -> DataFrame:
    """What two rounds of belief propagation make of the names that the frequent entities miss."""
    b = Base.of(spark, d)
    second = detect.best_scored(bp.basic_rounds(b.scored, b.rel, [2]), "score0", 6)
    return evaluate.compare_runs(b.frequent_solution, second, b.truth)


@query
def annotation_status(spark: SparkSession, d: str) -> DataFrame:
    """Which annotations the detection can find: 1, -1, -2 or -3."""
    b = Base.of(spark, d)
    return evaluate.status(_annotations(b), b.spots, b.dictionary)


@query
def annotation_dupes(spark: SparkSession, d: str) -> DataFrame:
    """Places with more than one annotation."""
    return evaluate.duplicate_spots(_annotations(Base.of(spark, d)))


@query
def annotation_first(spark: SparkSession, d: str) -> DataFrame:
    """One annotation for each place, the first one."""
    return evaluate.first_of_spot(_annotations(Base.of(spark, d)), "place").select("doc_id", "off", "len", "mention", "entity_id")


@query
def annotation_names(spark: SparkSession, d: str) -> DataFrame:
    """Annotations as names: the text at their place, without the place."""
    b = Base.of(spark, d)
    rows = _annotations(b).join(b.docs.select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", T.normalize(F.substr("text", F.col("off") + 1, F.col("len"))).alias("name"), "entity_id").distinct()


@query
def annotations_xml(spark: SparkSession, d: str) -> DataFrame:
    """Annotations written as XML elements and parsed."""
    rows = _annotations(Base.of(spark, d)).select(F.col("doc_id").cast("string").alias("filename"), F.trim(F.regexp_replace("mention", "[\\x00-\\x1f\\x7f]", " ")).alias("name"), "off", "len")
    return formats.parse_annotations(formats.format_annotations(rows.where("name <> ''").distinct()))


@query
def annotations_offset_fix(spark: SparkSession, d: str) -> DataFrame:
    """The offsets of the linked mentions found again by their context, the first place where it stands."""
    b = Base.of(spark, d)
    texts = b.docs.select(F.col("doc_id").cast("string").alias("filename"), "text")
    rows = b.mentions.select(F.col("doc_id").cast("string").alias("filename"), "pos", "n", "off", "len").join(texts, "filename")
    notes = rows.select(F.col("filename").alias("doc"), "pos", "n", F.substr("text", F.col("off") + 1, F.col("len")).alias("name"), T.window_around(F.col("text"), F.col("off"), F.col("len")).alias("context"))
    return formats.repair_offsets(notes, texts).select(F.col("doc").cast("bigint").alias("doc_id"), "pos", "n", "off")


@query
def eval_linkers(spark: SparkSession, d: str) -> DataFrame:
    """Macro and micro figures of the frequent entities, the converged walk and converged belief propagation against the truth."""
    b = Base.of(spark, d)
    runs = {"frequent": b.frequent_solution, "walk": _walk_solution(b), "bp": detect.best_scored(bp.full_converged(b.candidates, b.common, b.popular, bp.Full()), "score")}
    every = [evaluate.summary(evaluate.per_document(r, b.truth)).withColumn("method", F.lit(m)) for m, r in runs.items()]
    out = functools.reduce(DataFrame.unionByName, every)
    return out.select("method", *[_r(c) for c in ("macro_p", "macro_r", "micro_p", "micro_r", "mean_pr", "f1")], "good", "fp", "fn")


@query
def link_truth_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The true mentions whose entity is a candidate, solved by converged belief propagation, and whether that is right."""
    b = Base.of(spark, d)
    covered = b.truth.join(b.dictionary.select("mention", "entity_id"), ["mention", "entity_id"], "left_semi")
    mentions = detect.importance(b.spots.join(covered.select("doc_id", "mention"), ["doc_id", "mention"], "left_semi"))
    solved = linker.solve(b.docs, b.kept(mentions), linker.Knowledge.of(b), "bp")
    mark = covered.select(*evaluate.KEY).distinct().withColumn("right", F.lit(True))
    return solved.join(mark, evaluate.KEY, "left").select("doc_id", "pos", "n", "mention", "entity_id", F.coalesce("right", F.lit(False)).alias("right"))


@query
def annotation_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Annotations whose span is no n-gram of the text."""
    b = Base.of(spark, d)
    places = _annotations(b).select("doc_id", "off", "len").distinct()
    begin = tk.tokens(b.docs).select("doc_id", "off", F.col("pos").alias("p1"))
    end = tk.tokens(b.docs).select("doc_id", (F.col("off") + F.col("len")).alias("end"), F.col("pos").alias("p2"))
    found = places.withColumn("end", F.col("off") + F.col("len")).join(begin, ["doc_id", "off"]).join(end, ["doc_id", "end"]).where(f"p2 - p1 between 0 and {tk.NGRAM_SIZE - 1}")
    return places.join(found.select("doc_id", "off", "len"), ["doc_id", "off", "len"], "left_anti")


@query
def missed_by_keyphraseness(spark: SparkSession, d: str) -> DataFrame:
    """The hundred spots of highest keyphraseness that are no true mention."""
    b = Base.of(spark, d)
    rows = b.spots.join(b.truth.select("doc_id", "mention").distinct(), ["doc_id", "mention"], "left_anti")
    return rows.orderBy(F.desc(F.round("keyphraseness", 9)), "doc_id", "pos", "n").limit(100).select("doc_id", "pos", "n", "mention", _r("keyphraseness"))


@query
def false_positives_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Every spot that is no true mention, by descending keyphraseness."""
    b = Base.of(spark, d)
    rows = b.spots.join(b.truth.select("doc_id", "mention").distinct(), ["doc_id", "mention"], "left_anti")
    return _ranked(rows.select("doc_id", "pos", "n", "mention", _r("keyphraseness", 9)), F.desc("keyphraseness"), "doc_id", "pos", "n")


@query
def truth_low_keyphraseness(spark: SparkSession, d: str) -> DataFrame:
    """Every true mention of the dictionary, by ascending keyphraseness."""
    b = Base.of(spark, d)
    entries = b.dictionary.groupBy("mention").agg(F.round(F.first("linked") / F.first("total"), 9).alias("keyphraseness"))
    rows = b.truth.select(*evaluate.KEY).distinct().join(entries, "mention")
    return _ranked(rows.select(*evaluate.KEY, "keyphraseness"), "keyphraseness", *evaluate.KEY)


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with their ``rank`` over all: a range sort, and the rows of the partitions before added to the place in the own one."""
    rows = rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows)  # written, so that places are fixed
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in sorted(sizes):
        before.append((k, total))
        total += sizes[k]
    starts = rows.sparkSession.createDataFrame(before, "part bigint, before bigint")
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", place + F.col("before") + 1).drop("part", "at", "before")


_THRESHOLDS = [k / 100 for k in range(90, 9, -1)]
_MD_THRESHOLDS = [5e-5, 1e-4, 5e-4] + [k / 1000 for k in range(1, 10)] + [k / 100 for k in range(1, 101)]


def _threshold_solutions(b: Base) -> DataFrame:
    """(doc_id, method, mention, entity_id, below, up): what each method makes of the mentions kept, in texts with a truth."""
    found = detect.by_threshold(b.spots, min(_THRESHOLDS)).join(b.truth.select("doc_id").distinct(), "doc_id", "left_semi")
    cands = detect.candidates(found, b.dictionary)
    scored = detect.text_compatibility(b.docs, found, cands, b.df, b.vectors)
    scored = b.kept(scored.join(found.select("doc_id", "pos", "n", "keyphraseness", "total"), ["doc_id", "pos", "n"]))
    return thresholds.solutions(scored, b.rel, _THRESHOLDS)


@query
def sweep_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the most frequent entities, the converged walk and converged belief propagation for each threshold of keyphraseness."""
    b = Base.of(spark, d)
    key = ["threshold", "method"]
    mark = b.truth.select(*evaluate.KEY).distinct().withColumn("true", F.lit(1))
    spans = _threshold_solutions(b).join(mark, evaluate.KEY, "left").groupBy("method", "below", "up").agg(F.count("true").alias("good"), F.count("*").alias("found"))
    each = F.explode(F.slice(F.array(*map(F.lit, sorted(_THRESHOLDS))), F.col("below") + 1, F.col("up") - F.col("below")))
    counts = spans.select(each.alias("threshold"), "method", "good", "found").groupBy(*key).agg(F.sum("good").alias("good"), F.sum("found").alias("found"))
    grid = spark.createDataFrame([(t, m) for t in _THRESHOLDS for m in ("frequent", "walk", "bp")], "threshold double, method string")
    truth = b.truth.agg(F.count("*").alias("n_truth"))
    rows = grid.join(counts, key, "left").na.fill(0).crossJoin(truth)  # one row
    p, r = evaluate._share(F.col("good"), F.col("found")), evaluate._share(F.col("good"), F.col("n_truth"))
    return rows.select("threshold", "method", "good", "found", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@query
def sweep_detection(spark: SparkSession, d: str) -> DataFrame:
    """Macro precision and recall of mention detection for each threshold."""
    b = Base.of(spark, d)
    best = b.spots.groupBy("doc_id", "mention").agg(F.max("keyphraseness").alias("keyphraseness"))
    return evaluate.detection_sweep(best, b.dictionary, b.truth, "keyphraseness", _MD_THRESHOLDS)


_BETAS = [k / 10 for k in range(5, 16)]


@query
def sweep_beta_best(spark: SparkSession, d: str) -> DataFrame:
    """Correct links of converged belief propagation, full scorer, for each beta, and whether it is the best one."""
    from pyspark.sql import Window

    b = Base.of(spark, d)
    runs = bp.sweep(*_bp(b, bp.Full()), _BETAS)
    solved = detect.best_scored(runs, "score", by=["beta"]).select("beta", *evaluate.KEY).distinct()
    good = solved.join(b.truth, evaluate.KEY, "left_semi").groupBy("beta").agg(F.count("*").alias("good"))
    grid = spark.createDataFrame([(beta,) for beta in _BETAS], "beta double")
    rows = grid.join(good, "beta", "left").na.fill(0, ["good"]).select("good", "beta")
    w = Window.orderBy(F.desc("good"), "beta")  # one row per beta
    return rows.withColumn("is_best", F.row_number().over(w) == 1)


# --- text formats -----------------------------------------------------------------------------------------------------


@query
def candidates_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Candidate entries written as text and read back."""
    rows = kb.cut_candidates(Base.of(spark, d).counts)
    return formats.parse_candidates(formats.format_candidates(rows))


@query
def links_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """In-link entries written as text and read back, exploded."""
    rows = formats.parse_entity_links(formats.format_entity_links(kb.entity_link_entries(Base.of(spark, d).edges)))
    return rows.select("entity_id", "total_freq", "out_links", F.inline("links"))


@query
def scored_mentions_parse(spark: SparkSession, d: str) -> DataFrame:
    """Scored-mention lines made from the keyphraseness and parsed."""
    kp = Base.of(spark, d).keyphraseness
    lines = kp.select(F.concat(F.col("mention"), F.lit("\t<score>"), F.format_string("%.8f", F.col("linked") / F.col("total")), F.lit("</score>")).alias("value"))
    return formats.parse_scored_mentions(lines, "<score>", "</score>")


@query
def keyphraseness_pairs_parse(spark: SparkSession, d: str) -> DataFrame:
    """(linked, total) pairs as text and parsed."""
    kp = Base.of(spark, d).keyphraseness
    linked, total = T.keyphraseness_pair(F.concat(F.lit("("), F.col("linked"), F.lit(", "), F.col("total"), F.lit(")")))
    return kp.select("mention", linked.alias("linked"), total.alias("total"))


# --- a few keys holding most records -------------------------------------------------------------------------------


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The page that links each entity most often."""
    return skew.top_source(skew.link_frequencies(table(spark, d, "entity_links"))).select("entity_id", "src")


@query
def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with its summed total_freq, its number of linking pages and its top page."""
    rows = table(spark, d, "entity_links")
    freq = stored(skew.link_frequencies(rows))  # for the pages and for the top page
    totals = once(rows.select("record_id", "entity_id", "total_freq"), "record_id").where("entity_id is not null")
    totals = totals.groupBy("entity_id").agg(F.coalesce(F.sum(F.col("total_freq").cast("bigint")), F.lit(0)).alias("total_freq"))
    pages = freq.groupBy("entity_id").agg(F.count("*").alias("n_pages"))
    top = skew.top_source(freq).select("entity_id", F.col("src").alias("top_src"), F.col("freq").alias("top_freq"))
    return totals.join(pages, "entity_id", "left").join(top, "entity_id", "left").select("entity_id", "total_freq", F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"), "top_src", "top_freq")


@query
def p6_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of the link frequencies of each entity."""
    freq = skew.link_frequencies(table(spark, d, "entity_links"))
    return skew.quantiles(freq, "entity_id", "freq", [0.25, 0.5, 0.75])


def queries() -> dict:
    """Every query of the core."""
    return dict(_REGISTRY)
