"""Disambiguation by a random walk with restart on the graph of mentions and candidates of each text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entlink.operators import texts
from entlink.session import checkpointed, renewed

# Restart probability and the least relatedness of an edge.
ALPHA = 0.1
EPSILON = 1e-5
#: Entity part of a mention's own vertex.
MENTION = -1


def edges(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, pos1, n1, entity1, pos2, n2, entity2, w): edges from mentions (entity1 = -1) to candidates and between candidates.

    The weights of a vertex's edges sum to 1. A mention without any compatibility spreads evenly.
    """
    own = Window.partitionBy("doc_id", "pos", "n")
    share = scored.withColumn("all", F.sum("compat").over(own)).withColumn("k", F.count("*").over(own))
    down = share.select(
        "doc_id", F.col("pos").alias("pos1"), F.col("n").alias("n1"), F.lit(MENTION).alias("entity1"), F.col("pos").alias("pos2"), F.col("n").alias("n2"), F.col("entity_id").alias("entity2"),
        F.when(F.col("all") > 0, F.col("compat") / F.col("all")).otherwise(1 / F.col("k")).alias("w"),
    )
    strong = pairs.where(F.col("rel") > EPSILON)
    across = strong.withColumn("w", F.col("rel") / F.sum("rel").over(Window.partitionBy("doc_id", "pos1", "n1", "entity1")))
    return down.unionByName(across.select(*down.columns))


def vertices(mentions: DataFrame, scored: DataFrame) -> DataFrame:
    """(doc_id, pos, n, entity, prior): mentions with their importance, candidates with 0."""
    own = mentions.select("doc_id", "pos", "n", F.lit(MENTION).alias("entity"), F.col("importance").alias("prior"))
    return own.unionByName(scored.select("doc_id", "pos", "n", F.col("entity_id").alias("entity"), F.lit(0.0).alias("prior")))


def violations(graph: DataFrame, nodes: DataFrame, eps: float = EPSILON) -> DataFrame:
    """(doc_id, problem, n): weights or priors outside [0, 1] and sums that are not 1."""
    return violations_of(graph.groupBy("doc_id", "pos1", "n1", "entity1").agg(F.sum("w").alias("s"), F.min("w").alias("low"), F.max("w").alias("high")), nodes, eps)


def violations_of(out: DataFrame, nodes: DataFrame, eps: float = EPSILON) -> DataFrame:
    """The same from the weights of each vertex: their sum ``s``, the least ``low`` and the greatest ``high``."""
    bad = out.where(F.abs(F.col("s") - 1) > eps).select("doc_id", F.lit("edge sum").alias("problem"))
    bad = bad.unionByName(out.where((F.col("low") < 0) | (F.col("high") > 1 + eps)).select("doc_id", F.lit("edge weight").alias("problem")))
    prior = nodes.groupBy("doc_id").agg(F.sum("prior").alias("s"), F.min("prior").alias("low"))
    bad = bad.unionByName(prior.where((F.abs(F.col("s") - 1) > eps) | (F.col("low") < 0)).select("doc_id", F.lit("priors").alias("problem")))
    return bad.groupBy("doc_id", "problem").agg(F.count("*").alias("n"))


def steps(graph: DataFrame, nodes: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, pos, n, entity, p): the distribution after k steps; vertices without edges return their mass by prior."""
    keyed = graph.select("doc_id", F.struct("pos1", "n1", "entity1").alias("a"), F.struct(F.col("pos2").alias("pos1"), F.col("n2").alias("n1"), F.col("entity2").alias("entity1")).alias("b"), "w")
    state = nodes.select("doc_id", F.struct(F.col("pos").alias("pos1"), F.col("n").alias("n1"), F.col("entity").alias("entity1")).alias("v"), "prior", F.col("prior").alias("p"))
    for _ in range(k):
        flow = keyed.join(state.select("doc_id", F.col("v").alias("a"), "p"), ["doc_id", "a"]).groupBy("doc_id", F.col("b").alias("v")).agg(F.sum(F.col("w") * F.col("p")).alias("come"))
        sent = F.coalesce(F.sum("come").over(Window.partitionBy("doc_id")), F.lit(0.0))
        moved = state.join(flow, ["doc_id", "v"], "left").withColumn("come", F.coalesce("come", F.lit(0.0))).withColumn("hanging", F.sum("p").over(Window.partitionBy("doc_id")) - sent)
        state = moved.select("doc_id", "v", "prior", (alpha * F.col("prior") + (1 - alpha) * (F.col("come") + F.col("hanging") * F.col("prior"))).alias("p"))
        state = checkpointed(state)
    return state.select("doc_id", F.col("v.pos1").alias("pos"), F.col("v.n1").alias("n"), F.col("v.entity1").alias("entity"), "p")


def converge(graph: DataFrame, nodes: DataFrame, alpha: float = ALPHA, tolerance: float = 1e-3, most: int = 100) -> DataFrame:
    """(doc_id, pos, n, entity, p) when no rank moves by more than ``tolerance``, at the latest after ``most`` steps.

    The graph of one text goes to one task; its size is bounded by the text's mentions, not by the corpus.
    """
    kind = nodes.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, pos int, n int, entity int, p double"

    def solve(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values(["pos", "n", "entity"], ignore_index=True)
        where = {key: k for k, key in enumerate(zip(v["pos"], v["n"], v["entity"]))}
        a = np.array([where[x] for x in zip(e["pos1"], e["n1"], e["entity1"])], np.int64)
        b = np.array([where[x] for x in zip(e["pos2"], e["n2"], e["entity2"])], np.int64)
        p = ranks(v["prior"].to_numpy(float), a, b, e["w"].to_numpy(float), alpha, tolerance, most)
        return v[["doc_id", "pos", "n", "entity"]].assign(p=p)

    return renewed(nodes).groupBy("doc_id").cogroup(renewed(graph).groupBy("doc_id")).applyInPandas(solve, out)


def ranks(prior: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, alpha: float = ALPHA, tolerance: float = 1e-3, most: int = 100) -> np.ndarray:
    """Ranks of one text's vertices; edges go from ``a`` to ``b``."""
    p, hanging = prior.copy(), ~np.isin(np.arange(len(prior)), a)
    for _ in range(most):
        q = alpha * prior + (1 - alpha) * (np.bincount(b, weights=w * p[a], minlength=len(prior)) + p[hanging].sum() * prior)
        moved = np.abs(q - p).max() if len(prior) else 0.0
        p = q
        if moved < tolerance:
            break
    return p


def decide(scored: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, pos, n, mention, entity_id, score): each mention's candidate of the highest compat x rank."""
    rank = ranks.where(F.col("entity") != MENTION).withColumnRenamed("entity", "entity_id")
    return scored.join(rank, ["doc_id", "pos", "n", "entity_id"]).withColumn("score", F.col("compat") * F.col("p"))


def components(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, n_components): weakly connected components by spreading the least label; rounds end when no label moves."""
    key = lambda p, n, e: F.struct(F.col(p).alias("p"), F.col(n).alias("n"), F.col(e).alias("e"))
    there = graph.select("doc_id", key("pos1", "n1", "entity1").alias("a"), key("pos2", "n2", "entity2").alias("b"))
    both = checkpointed(there.unionByName(there.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(nodes.select("doc_id", key("pos", "n", "entity").alias("v")).withColumn("label", F.col("v")))
    while True:
        seen = both.join(labels.withColumnRenamed("v", "b"), ["doc_id", "b"]).groupBy("doc_id", F.col("a").alias("v")).agg(F.min("label").alias("near"))
        after = labels.join(seen, ["doc_id", "v"], "left").select("doc_id", "v", F.least("label", F.coalesce("near", "label")).alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        after = checkpointed(after)
        labels = after.select("doc_id", "v", "label")
        if not after.where("moved").limit(1).count():
            return labels.groupBy("doc_id").agg(F.count_distinct("label").alias("n_components"))


# --- the same, text by text: the graph is made where it is used -------------------------------------------------


def _graph(at: dict, mention: np.ndarray, a: np.ndarray, b: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of one text's graph: from, to, weight. The vertices are the rows of ``at``."""
    own = at["entity_id"] == MENTION
    k = int(mention.max()) + 1
    top = np.full(k, -1)
    top[mention[own]] = np.flatnonzero(own)
    down = np.flatnonzero(~own)
    down = down[top[mention[down]] >= 0]
    m, compat = mention[down], at["compat"][down]
    every, size = np.bincount(m, compat, k)[m], np.bincount(m, minlength=k)[m]
    w = np.where(every > 0, compat / np.where(every > 0, every, 1), 1 / size)
    strong = rel > EPSILON
    a, b, rel = a[strong], b[strong], rel[strong]
    across = rel / np.bincount(a, rel, len(own))[a]
    return np.concatenate((top[m], a)), np.concatenate((down, b)), np.concatenate((w, across))


def _nodes(mentions: DataFrame, scored: DataFrame) -> DataFrame:
    own = mentions.select("doc_id", "pos", "n", F.lit(MENTION).alias("entity_id"), F.col("importance").alias("prior"), F.lit(0.0).alias("compat"))
    return own.unionByName(scored.select("doc_id", "pos", "n", "entity_id", F.lit(0.0).alias("prior"), "compat"))


def text_edges(mentions: DataFrame, scored: DataFrame, rel: DataFrame) -> DataFrame:
    """:func:`edges` of each text; nothing but the candidates is shuffled."""

    def solve(at: dict, *pairs) -> dict:
        a, b, w = _graph(at, *pairs)
        return {"w": w} | {f"{c}{k}": at[c if c != "entity" else "entity_id"][x] for k, x in (("1", a), ("2", b)) for c in ("pos", "n", "entity")}

    return texts.solved(_nodes(mentions, scored), rel, "rel", solve, "pos1 int, n1 int, entity1 int, pos2 int, n2 int, entity2 int, w double")


def text_sums(mentions: DataFrame, scored: DataFrame, rel: DataFrame) -> DataFrame:
    """(doc_id, pos1, n1, entity1, edges, heaviest, lightest, squares, sum, targets) of each vertex that has edges."""

    def solve(at: dict, *pairs) -> dict:
        a, b, w = _graph(at, *pairs)
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        x, first = np.unique(a, return_index=True)
        sums = lambda f, v: f.reduceat(v, first) if len(first) else v
        out = {"edges": sums(np.add, np.ones(len(a), np.int64)), "heaviest": sums(np.maximum, w), "lightest": sums(np.minimum, w), "squares": sums(np.add, w * w), "sum": sums(np.add, w), "targets": sums(np.add, at["entity_id"][b].astype(np.int64))}
        return out | {"pos1": at["pos"][x], "n1": at["n"][x], "entity1": at["entity_id"][x]}

    return texts.solved(_nodes(mentions, scored), rel, "rel", solve, "pos1 int, n1 int, entity1 int, edges bigint, heaviest double, lightest double, squares double, sum double, targets bigint")


def _ranked(mentions: DataFrame, scored: DataFrame, rel: DataFrame, rank) -> DataFrame:
    def solve(at: dict, *pairs) -> dict:
        return {"pos": at["pos"], "n": at["n"], "entity": at["entity_id"], "p": rank(at["prior"], *_graph(at, *pairs))}

    return texts.solved(_nodes(mentions, scored), rel, "rel", solve, "pos int, n int, entity int, p double")


def text_steps(mentions: DataFrame, scored: DataFrame, rel: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """:func:`steps` of each text."""

    def rank(prior: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        p = prior
        for _ in range(k):
            come = np.bincount(b, weights=w * p[a], minlength=len(p))
            p = alpha * prior + (1 - alpha) * (come + (p.sum() - come.sum()) * prior)
        return p

    return _ranked(mentions, scored, rel, rank)


def text_converge(mentions: DataFrame, scored: DataFrame, rel: DataFrame, alpha: float = ALPHA, tolerance: float = 1e-3, most: int = 100) -> DataFrame:
    """:func:`converge` of each text."""
    return _ranked(mentions, scored, rel, lambda prior, a, b, w: ranks(prior, a, b, w, alpha, tolerance, most))


def text_components(mentions: DataFrame, scored: DataFrame, rel: DataFrame) -> DataFrame:
    """:func:`components` of each text."""

    def solve(at: dict, *pairs) -> dict:
        a, b, _ = _graph(at, *pairs)
        label = np.arange(len(at["pos"]))
        while True:
            low = np.minimum(label[a], label[b])
            after = label.copy()
            for x in (a, b, label[a], label[b]):  # also the labels' own vertices take on what their edges found
                np.minimum.at(after, x, low)
            after = after[after]
            if (after == label).all():
                return {"n_components": np.array([len(np.unique(label))], np.int64)}
            label = after

    return texts.solved(_nodes(mentions, scored), rel, "rel", solve, "n_components bigint")
