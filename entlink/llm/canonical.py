"""Problem 1: mapping freely typed values to the entry of a reference list that they mean.

Reference names (canonical titles and their other names) and values are brought into the same form
(``names``). Every value is then searched in BK-trees over the reference names (``bktree``), which return every
name within the threshold: first with no edits, over the names, over the names with their words in alphabetical order
and over first names cut to their initial; what that leaves over with the edits that its length allows. The nearest name wins if
 * the edits, with a swap of neighbours as one, are few for its length,
 * its numbers are the same (another year or another ruler is another thing), and
 * no other entry is as near.
Else the value means no entry and is reported with ``NOTHING``.

The reference list goes to every task as long as it has at most ``SHARD`` names (counted first); a
larger list is cut into shards by a hash of the names' form, and the values into blocks by a hash. What depends on the whole
list (words of a class, initials of one entry only, short names of airports) is found before it is cut. Each pair of a shard
and a block is one task, which builds the trees of the shard and gives the best entries of each step, ties included; they are
merged for each value, so the result is that of one list. Each distinct value is searched once, so hot values cannot gather; they come back to their
rows by a broadcast.

NULL values, values of white space only and values without letters or digits mean nothing. Repeated rows each get a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entlink.llm.bktree import BKForest
from entlink.llm.names import ROMAN, undress, words
from entlink.session import stored

NOTHING = -1
#: Most reference names in one broadcast.
SHARD = 100_000
#: Rows that are searched at once.
TOGETHER = 50_000
#: Distinct values in a block, about, where the list is cut.
VALUES = 200_000
#: A value is hot if it has at least one of so many rows; so there are no more hot values than this.
HOT = 1000
#: Words in at least so many names are words of a class (river, castle), not of one name.
CLASS_WORD = 20
#: Scores of matches; smaller is surer. A search adds 10 * edits + distance.
EQUAL, REORDERED, INITIAL, SEARCHED = 0, 1, 2, 10
NO_MATCH = 1_000_000
#: Steps of a match: equal forms, search of initials, of whole names, of turned word orders. The first one with a single best entry decides.
EXACT, INITIALS, WHOLE, TURNED = range(4)
_NUMERALS = set(ROMAN[1:])


def edits(a: str, b: str) -> int:
    """Edit distance in which a swap of two neighbours is one edit (optimal string alignment)."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def allowed(length: int) -> int:
    """Edits that a name of this length (without blanks) may have."""
    return 0 if length < 4 else 1 if length < 6 else 2


def _numbers(tokens: list[str]) -> list[str]:
    return sorted(t for t in tokens if t.isdigit())


def _romans(tokens: list[str]) -> list[str]:
    return sorted(t for t in tokens if t in _NUMERALS)


class Prepared(NamedTuple):
    """What the whole list gives to one shard of it."""

    airports: list[tuple[list[str], int]]
    initial: dict[str, int]


class Matcher:
    """The reference list, or one shard of it with what is ``prepared`` from the whole list."""

    def __init__(self, names: list[tuple[str, int]], prepared: Prepared | None = None):
        forms = [(words(undress(name)), entity) for name, entity in names]
        self.equal: dict[str, int] = {}
        self.bag: dict[str, int] = {}
        self.tokens: dict[str, list[str]] = {}
        for tokens, entity in forms:
            self._add(tokens, entity)
        if prepared:
            for tokens, entity in prepared.airports:
                self._add(tokens, entity)
            self.initial = prepared.initial
        else:
            self._prepare(forms)
        self.names = list(self.equal)
        self.forest = BKForest(self.names)
        self.bags = list(self.bag)
        self.bag_forest = BKForest(self.bags)
        self.initials = list(self.initial)
        self.initial_forest = BKForest(self.initials)

    def _prepare(self, forms: list[tuple[list[str], int]]) -> None:
        count: dict[str, int] = {}
        for tokens, _ in forms:
            for t in set(tokens):
                count[t] = count.get(t, 0) + 1
        for tokens, entity in forms:  # an airport may leave out that it is international
            if "international" in tokens and "airport" in tokens:
                short = [t for t in tokens if t != "international"]
                if "".join(short) not in self.equal:
                    self._add(short, entity)
        initial: dict[str, set[int]] = {}
        for tokens, entity in forms:
            if len(tokens) == 2 and all(len(t) > 1 for t in tokens) and count[tokens[1]] < CLASS_WORD:
                initial.setdefault(f"{tokens[0][0]} {tokens[1]}", set()).add(entity)
        self.initial = {k: next(iter(v)) for k, v in initial.items() if len(v) == 1}

    def _add(self, tokens: list[str], entity: int) -> None:
        if tokens:
            key, bag = "".join(tokens), " ".join(sorted(tokens))
            self.equal[key] = min(entity, self.equal.get(key, entity))
            self.bag[bag] = min(entity, self.bag.get(bag, entity))
            self.tokens.setdefault(key, tokens)

    def _same_numbers(self, tokens: list[str], name: str) -> bool:
        own = self.tokens[name]
        if _numbers(tokens) != _numbers(own):
            joined = "".join(tokens)
            if any(t not in joined for t in _numbers(own)) or len(tokens) == len(own):
                return False
        mine, theirs = _romans(tokens), _romans(own)
        return mine == theirs or len(tokens) < len(own) and not mine or len(tokens) == len(own) and not mine

    def match(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Entity and score of each value."""
        entity, score = np.full(len(values), NOTHING, np.int64), np.full(len(values), NO_MATCH, np.int64)
        for k, _, s, low, high in sorted(self.steps(values), reverse=True):  # the first step comes last and stays
            if low == high:
                entity[k], score[k] = low, s
        return entity, score

    def steps(self, values: list[str], every: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(place, step, score, low, high): the best score of a value in a step, the least and the greatest entity that has it.

        A value that a step decides takes no later one, unless ``every`` step is asked for; one with equal forms never does.
        """
        out: list[tuple[int, int, int, int, int]] = []
        left = [(k, tokens) for k, tokens in enumerate(words(undress(v)) for v in values) if tokens]

        def equal(rows: list[tuple[int, list[str]]], forms: list[str], forest: BKForest, names: list[str], entity: dict[str, int], score: int) -> list[tuple[int, list[str]]]:
            """Takes the rows whose form is in the tree; gives back the others."""
            distinct = sorted(set(forms))
            query, entry, _ = forest.search(distinct, np.zeros(len(distinct), np.int64))
            found = {distinct[q]: entity[names[e]] for q, e in zip(query.tolist(), entry.tolist())}
            out.extend((k, EXACT, score, found[form], found[form]) for (k, _), form in zip(rows, forms) if form in found)
            return [row for row, form in zip(rows, forms) if form not in found]

        left = equal(left, ["".join(tokens) for _, tokens in left], self.forest, self.names, self.equal, EQUAL)
        left = equal(left, [" ".join(sorted(tokens)) for _, tokens in left], self.bag_forest, self.bags, self.bag, REORDERED)
        two = [(k, tokens) for k, tokens in left if len(tokens) == 2 and min(map(len, tokens)) == 1 and max(map(len, tokens)) > 1]
        cut = {k for k, _ in two}
        whole = [(k, tokens) for k, tokens in left if k not in cut]
        two = equal(two, [" ".join(sorted(tokens, key=len)) for _, tokens in two], self.initial_forest, self.initials, self.initial, INITIAL)
        short = [(k, " ".join(sorted(tokens, key=len)), tokens) for k, tokens in two]
        decided: set[int] = set()

        def search(rows: list[tuple[int, list[str]]], step: int) -> None:
            for k, (best, who) in self._search([r for r in rows if every or r[0] not in decided], step == INITIALS).items():
                out.append((k, step, best, min(who), max(who)))
                if len(who) == 1:
                    decided.add(k)

        search([(k, [first]) for k, first, _ in short], INITIALS)
        whole += [(k, tokens) for k, _, tokens in short]
        search(whole, WHOLE)
        turned = []
        for k, tokens in whole:
            if len(tokens) > 1:
                turned += [(k, tokens[1:] + tokens[:1]), (k, tokens[-1:] + tokens[:-1])]
                if tokens[-1].isdigit() and len(tokens) > 2:
                    turned.append((k, tokens[1:-1] + tokens[:1] + tokens[-1:]))
        search(turned, TURNED)
        return out

    def _search(self, rows: list[tuple[int, list[str]]], initials: bool) -> dict[int, tuple[int, set[int]]]:
        """The best score of each value over its rows and the entities that have it."""
        out: dict[int, tuple[int, set[int]]] = {}
        if not rows:
            return out
        forest, names = (self.initial_forest, self.initials) if initials else (self.forest, self.names)
        keys = ["".join(tokens) for _, tokens in rows]
        distinct = sorted(set(keys))
        place = {q: n for n, q in enumerate(distinct)}
        most = np.array([allowed(len(q)) for q in distinct])
        query, entry, distance = forest.search(distinct, most, swaps=True)
        found: dict[int, list[tuple[str, int, int]]] = {}
        for q, e, d in zip(query.tolist(), entry.tolist(), distance.tolist()):
            name = names[e]
            n = d if d < 2 else edits(distinct[q], name)
            if n <= min(most[q], allowed(len(name))):
                found.setdefault(q, []).append((name, n, d))
        for (k, tokens), key in zip(rows, keys):
            best, who = out.get(k, (NO_MATCH, set()))
            for name, n, d in found.get(place[key], ()):
                if initials:
                    if name[0] != key[0]:
                        continue
                    target = self.initial[name]
                else:
                    if not self._same_numbers(tokens, name):
                        continue
                    target = self.equal[name]
                s = SEARCHED + 10 * n + d
                if s < best:
                    best, who = s, {target}
                elif s == best:
                    who.add(target)
            if who:
                out[k] = best, who
        return out


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together to at least ``TOGETHER`` rows: a search of many values costs less for each."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= TOGETHER:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def reference_names(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """(name, entity): every title and every other name of a title."""
    own = titles.select(F.col("title").alias("name"), F.col("id").cast("bigint").alias("entity"))
    other = redirects.join(titles, F.col("to_title") == F.col("title")).select(F.col("from_title").alias("name"), F.col("id").cast("bigint").alias("entity"))
    return own.unionByName(other).where("name is not null and entity is not null").distinct()


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        tokens = [words(undress(name)) for name in pdf["name"]]
        yield pdf.assign(key=["".join(t) for t in tokens], tokens=tokens)[["name", "entity", "key", "tokens"]]


def _prepared(reference: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names, short names of airports and initials of the whole list, each with its ``shard``; equal forms are in one shard."""
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    forms = stored(reference.select("name", F.col("entity").cast("bigint").alias("entity")).mapInPandas(_forms, "name string, entity bigint, key string, tokens array<string>").where("key <> ''"))
    common = forms.select(F.explode(F.array_distinct("tokens")).alias("last")).groupBy("last").count().where(F.col("count") >= CLASS_WORD).select("last")
    two = forms.where("size(tokens) = 2 and length(tokens[0]) > 1 and length(tokens[1]) > 1").select(F.expr("tokens[1]").alias("last"), F.expr("substring(tokens[0], 1, 1)").alias("letter"), "entity")
    initial = two.join(common, "last", "left_anti").groupBy(F.concat_ws(" ", "letter", "last").alias("initial")).agg(F.min("entity").alias("entity"), F.max("entity").alias("other"))
    initial = initial.where("entity = other").select(shard("initial"), "initial", "entity")
    airports = forms.where("array_contains(tokens, 'international') and array_contains(tokens, 'airport')").withColumn("tokens", F.array_remove("tokens", "international"))
    airports = airports.withColumn("key", F.array_join("tokens", "")).join(forms.select("key"), "key", "left_anti")
    airports = airports.groupBy("key").agg(F.min(F.struct("name", "entity", "tokens")).alias("a")).select(shard("key"), "a.tokens", "a.entity")
    return forms.select(shard("key"), "name", "entity"), airports, initial


def map_values(rows: DataFrame, key: str, value: str, reference: DataFrame) -> DataFrame:
    """(key, entity_id, score): the entry that ``value`` of each row means, NOTHING if none; score NO_MATCH then."""
    rows = rows.select(F.col(key).alias("k"), F.col(value).cast("string").alias("v"))
    shards = max(1, math.ceil(reference.count() / SHARD))
    out = _in_one(rows, reference) if shards == 1 else _in_shards(rows, reference, shards)
    return out.select(F.col("k").alias(key), F.col("entity_id").cast("int").alias("entity_id"), "score")


def _in_one(rows: DataFrame, reference: DataFrame) -> DataFrame:
    names = [(r["name"], r["entity"]) for r in reference.select("name", "entity").collect()]  # at most SHARD names
    matcher = rows.sparkSession.sparkContext.broadcast(Matcher(sorted(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _together(batches):
            codes, distinct = pd.factorize(pdf["v"])
            entity, score = matcher.value.match(distinct.tolist())
            entity, score = np.append(entity, NOTHING), np.append(score, NO_MATCH)  # NULL has the code -1
            yield pd.DataFrame({"k": pdf["k"], "entity_id": entity[codes], "score": score[codes]})

    return rows.mapInPandas(run, f"k {rows.schema['k'].dataType.simpleString()}, entity_id bigint, score bigint")


def _in_shards(rows: DataFrame, reference: DataFrame, shards: int) -> DataFrame:
    """The same by one search for each shard of names and block of values; what they find is merged for each value."""
    names, airports, initial = _prepared(reference, shards)
    entries = names.select("shard", F.lit("name").alias("kind"), F.col("name").alias("text"), "entity")
    entries = entries.unionByName(airports.select("shard", F.lit("airport").alias("kind"), F.array_join("tokens", " ").alias("text"), "entity"))
    entries = stored(entries.unionByName(initial.select("shard", F.lit("initial").alias("kind"), F.col("initial").alias("text"), "entity")))
    rows = stored(rows)
    values = stored(rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n")))
    blocks = max(1, math.ceil(values.count() / VALUES))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.withColumn("block", grid(blocks))
    right = values.select("v", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), grid(shards).alias("shard"))
    left = left.withColumn("shard", F.col("shard").cast("int"))

    def search(names: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        of = {kind: list(zip(part["text"], part["entity"].tolist())) for kind, part in names.groupby("kind")}
        prepared = Prepared([(text.split(" "), entity) for text, entity in sorted(of.get("airport", []))], dict(of.get("initial", [])))
        typed = values["v"].tolist()
        steps = Matcher(sorted(of.get("name", [])), prepared).steps(typed, every=True)
        found = pd.DataFrame(steps, columns=["at", "step", "score", "low", "high"])
        return found.assign(v=[typed[k] for k in found["at"]])[["v", "step", "score", "low", "high"]]

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "v string, step int, score bigint, low bigint, high bigint")
    low, high = F.min(F.struct("score", "low")).alias("a"), F.min(F.struct("score", (-F.col("high")).alias("high"))).alias("b")
    best = found.groupBy("v", "step").agg(low, high).where(f"step = {EXACT} or a.low = -b.high")
    best = best.groupBy("v").agg(F.min(F.struct("step", "a.score", "a.low")).alias("a")).select("v", F.col("a.low").alias("entity_id"), F.col("a.score").alias("score"))
    best = stored(best)
    hot = values.where(F.col("n") * HOT >= rows.count()).select("v")
    often = rows.join(F.broadcast(hot.join(best, "v", "left")), "v")  # at most HOT values
    seldom = rows.join(F.broadcast(hot), "v", "left_anti").join(best, "v", "left")
    both = often.unionByName(seldom)
    return both.select("k", F.coalesce("entity_id", F.lit(NOTHING)).alias("entity_id"), F.coalesce("score", F.lit(NO_MATCH)).alias("score"))
