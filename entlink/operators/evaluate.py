"""Evaluation against known links: precision, recall, coverage, sweeps, reports.

Solutions and truths are frames of (doc_id, mention, entity_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "mention", "entity_id"]


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 1 where there is nothing to divide."""
    return F.coalesce(F.try_divide(part, whole), F.lit(1.0))


def outcomes(solution: DataFrame, truth: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Every annotation of either side once, with ``outcome`` good, fp or fn."""
    key = [*(extra or []), *KEY]
    a = solution.select(*key).distinct().withColumn("a", F.lit(True))
    b = truth.select(*key).distinct().withColumn("b", F.lit(True))
    return a.join(b, key, "full").select(*key, F.when(F.col("a") & F.col("b"), "good").when(F.col("a"), "fp").otherwise("fn").alias("outcome"))


def _counts(rows: DataFrame, *key: str) -> DataFrame:
    is_ = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0))
    return rows.groupBy(*key).agg(is_("good").alias("good"), is_("fp").alias("fp"), is_("fn").alias("fn"))


def _scores(rows: DataFrame) -> DataFrame:
    g = F.col("good")
    return rows.withColumn("precision", _share(g, g + F.col("fp"))).withColumn("recall", _share(g, g + F.col("fn")))


def per_document(solution: DataFrame, truth: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, good, fp, fn, precision, recall) of the documents that have a truth."""
    known = truth.select("doc_id").distinct()
    rows = outcomes(solution.join(known, "doc_id", "left_semi"), truth, extra)
    return _scores(_counts(rows, *(extra or []), "doc_id"))


def summary(docs: DataFrame, *key: str) -> DataFrame:
    """Macro averages over documents and micro figures over all annotations, with their mean and F1."""
    total = docs.groupBy(*key).agg(F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), *[F.sum(c).alias(c) for c in ("good", "fp", "fn")])
    p, r = F.col("precision"), F.col("recall")
    out = _scores(total).withColumn("mean_pr", (F.col("macro_p") + F.col("macro_r")) / 2).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return out.withColumnRenamed("precision", "micro_p").withColumnRenamed("recall", "micro_r")


def missing(truth: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The truth that no linker can find: the mention is no entry or the entity no candidate."""
    return truth.join(dictionary.select("mention", "entity_id").distinct(), ["mention", "entity_id"], "left_anti").select(*KEY)


def attainable_recall(truth: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(n_truth, n_missing, max_recall) counted on distinct (document, mention)."""
    spots = truth.select("doc_id", "mention").distinct().agg(F.count("*").alias("n_truth"))
    lost = missing(truth, dictionary).select("doc_id", "mention").distinct().agg(F.count("*").alias("n_missing"))
    both = spots.crossJoin(lost)  # one row each
    return both.withColumn("max_recall", 1 - F.coalesce(F.try_divide(F.col("n_missing"), F.col("n_truth")), F.lit(0.0)))


def detection(cands: DataFrame, truth: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, good, wrong, n_truth, precision, recall) of mention detection.

    A true annotation is found if a mention of its name has its entity among the candidates; a
    mention is wrong if no true annotation of its name has one of its candidates. Wrong mentions count once by name.
    """
    by = extra or []
    found = cands.select(*by, *KEY).distinct()
    hit = truth.join(found, KEY) if by else truth.join(found, KEY, "left_semi")
    good = hit.groupBy(*by, "doc_id").agg(F.count("*").alias("good"))
    n_truth = truth.groupBy("doc_id").agg(F.count("*").alias("n_truth"))
    right = found.join(truth, KEY, "left_semi").select(*by, "doc_id", "mention").distinct()
    wrong = found.select(*by, "doc_id", "mention").distinct().join(right, [*by, "doc_id", "mention"], "left_anti").groupBy(*by, "doc_id").agg(F.count("*").alias("wrong"))
    base = n_truth if not by else n_truth.crossJoin(F.broadcast(found.select(*by).distinct()))  # the few settings of a sweep
    rows = base.join(good, [*by, "doc_id"], "left").join(wrong, [*by, "doc_id"], "left").na.fill(0, ["good", "wrong"])
    return rows.withColumn("precision", _share(F.col("good"), F.col("good") + F.col("wrong"))).withColumn("recall", _share(F.col("good"), F.col("n_truth")))


def detection_sweep(found: DataFrame, dictionary: DataFrame, truth: DataFrame, score: str, settings: list[float]) -> DataFrame:
    """(threshold, precision, recall, good): the means of :func:`detection` over the texts with a truth, and its sum of good ones, for each threshold that anything reaches.

    ``found``(doc_id, mention, score) has each name of a text once, an entry of ``dictionary``(mention, entity_id, ...). A name counts at every threshold up to
    its score, so a text's names are counted once by the number of thresholds that they reach, and summed up from there; neither names nor candidates
    are repeated for each threshold.
    """
    grid = sorted({float(t) for t in settings})
    steps = F.array(*map(F.lit, grid))
    level = F.size(F.filter(steps, lambda t: F.col(score) >= t))
    names = found.select("doc_id", "mention", level.alias("level")).where("level > 0")
    hit = truth.join(dictionary.select("mention", "entity_id"), ["mention", "entity_id"], "left_semi").groupBy("doc_id", "mention").agg(F.count("*").alias("good"))
    counted = names.join(hit, ["doc_id", "mention"], "left").groupBy("doc_id", "level").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.count_if(F.col("good").isNull()).alias("wrong"))
    levels = counted.groupBy("doc_id").agg(F.collect_list(F.struct("level", "good", "wrong")).alias("levels"))
    rows = truth.groupBy("doc_id").agg(F.count("*").alias("n_truth")).join(levels, "doc_id", "left")
    rows = rows.select("n_truth", F.coalesce("levels", F.array().cast(levels.schema["levels"].dataType)).alias("levels"), F.posexplode(steps).alias("at", "threshold"))
    above = lambda c: F.aggregate(F.filter("levels", lambda x: x["level"] > F.col("at")), F.lit(0).cast("bigint"), lambda s, x: s + x[c])
    rows = rows.select("threshold", "n_truth", above("good").alias("good"), above("wrong").alias("wrong"))
    rows = rows.withColumn("precision", _share(F.col("good"), F.col("good") + F.col("wrong"))).withColumn("recall", _share(F.col("good"), F.col("n_truth")))
    means = rows.groupBy("threshold").agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.sum("good").alias("good"))
    top = found.agg(F.max(score).alias("top"))
    return means.crossJoin(top).where("threshold <= top").drop("top")  # one row


def status(annotations: DataFrame, spots: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``annotations``(doc_id, mention, entity_id, off, len) with ``status``.

    1: a spot at the same place has the entity as candidate; -2: it has not; -1: no spot there; -3: the entity is no title (-1).
    """
    places = spots.select("doc_id", "off", "len", F.col("mention").alias("spot")).distinct()
    cands = dictionary.select(F.col("mention").alias("spot"), "entity_id", F.lit(True).alias("among"))
    rows = annotations.join(places, ["doc_id", "off", "len"], "left").join(cands, ["spot", "entity_id"], "left")
    state = F.when(F.col("entity_id") == -1, -3).when(F.col("spot").isNull(), -1).when(F.col("among"), 1).otherwise(-2)
    return rows.select("doc_id", "mention", "entity_id", "off", "len", state.alias("status"))


def duplicate_spots(annotations: DataFrame) -> DataFrame:
    """(doc_id, off, len, n): places that are annotated more than once."""
    return annotations.groupBy("doc_id", "off", "len").agg(F.count("*").alias("n")).where("n > 1")


def first_of_spot(annotations: DataFrame, order: str) -> DataFrame:
    """The first annotation of each place in the order of ``order``."""
    rest = [c for c in annotations.columns if c not in ("doc_id", "off", "len")]
    return annotations.groupBy("doc_id", "off", "len").agg(F.min_by(F.struct(*rest), order).alias("r")).select("doc_id", "off", "len", "r.*")


def compare_runs(first: DataFrame, second: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, mention, outcome2): what the second run makes of the names that the first one both missed and got wrong."""
    one, two = outcomes(first, truth), outcomes(second, truth)
    names = lambda o: one.where(F.col("outcome") == o).select("doc_id", "mention").distinct()
    lost = names("fp").join(names("fn"), ["doc_id", "mention"], "left_semi")
    return lost.join(two.select("doc_id", "mention", F.col("outcome").alias("outcome2")).distinct(), ["doc_id", "mention"], "left")


def sweep(scored: DataFrame, score: str, settings: list[float]) -> DataFrame:
    """``scored`` once per threshold that it reaches, with ``threshold``; scored once, filtered many times."""
    grid = scored.sparkSession.createDataFrame([(float(t),) for t in settings], "threshold double")
    return scored.crossJoin(F.broadcast(grid)).where(F.col(score) >= F.col("threshold"))  # as many rows as settings


def best_setting(results: DataFrame, setting: str, score: str) -> DataFrame:
    """(setting, score): the best setting, the smaller of equal ones."""
    return results.agg(F.max_by(setting, F.struct(F.round(score, 9), -F.col(setting))).alias(setting), F.max(score).alias(score))
