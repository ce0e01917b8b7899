import itertools
import random

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("entlink.llm")

from entlink.llm import bktree, canonical, cooccur, frequent, names, packing, readability, termfreq, tokenizer, topn  # noqa: E402


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bk_forest_finds_all_within_threshold(monkeypatch):
    monkeypatch.setattr(bktree, "BLOCK", 50)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
    entries = sorted({word() for _ in range(300)} | {"x" * 70, "y" * 64})
    queries = [word() for _ in range(80)] + ["x" * 69 + "z", "y" * 63, "é" * 3]
    limit = np.array([rng.randrange(0, 4) for _ in queries])
    q, e, d = bktree.BKForest(entries).search(queries, limit)
    got = set(zip(q.tolist(), e.tolist(), d.tolist()))
    want = {(i, j, n) for i, a in enumerate(queries) for j, b in enumerate(entries) if (n := plain_levenshtein(a, b)) <= limit[i]}
    assert got == want and len(q) == len(got)


def test_bk_forest_finds_all_within_edits_with_swaps():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
    entries = sorted({word() for _ in range(300)} | {"ab" * 35})
    queries = [word() for _ in range(80)] + ["ba" * 2 + "ab" * 33, "ab" * 34 + "b"]
    limit = np.array([rng.randrange(0, 3) for _ in range(80)] + [2, 2])
    q, e, d = bktree.BKForest(entries).search(queries, limit, swaps=True)
    got = {(i, j) for i, j in zip(q.tolist(), e.tolist()) if canonical.edits(queries[i], entries[j]) <= limit[i]}
    want = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(entries) if canonical.edits(a, b) <= limit[i]}
    assert got == want and all(plain_levenshtein(queries[i], entries[j]) == n for i, j, n in zip(q, e, d))


@pytest.mark.parametrize(("value", "entity"), [("Muesum of Kliarkotrn", 1), ("Kallisot III of Tounainoraer", 2), ("Onlo", 3), ("Muesum of Kilrakotrn", -1)])
def test_swaps_are_single_edits(value, entity):
    matcher = canonical.Matcher([("Museum of Kliarkortn", 1), ("Kallisto III of Tounainorare", 2), ("Olno", 3)])
    assert matcher.match([value])[0].tolist() == [entity]


@pytest.mark.parametrize(
    ("raw", "form"),
    [
        ("[[Mt_Foo%20Bar]]", "mount foo bar"),
        ("„The KliÃ¤pia (moth)“, etc.", "kliapia moth"),
        ("Zandor the Third of X", "zandor iii of x"),
        ("U. of Y", "university of y"),
        ("wiki/St._Foo_Cath.#History", "saint foo cathedral"),
        ("Ｆｏｏ​&nbsp;light house", "foo lighthouse"),
        ("Foo%2520%2528moth%2529", "foo moth"),
        ("Саstle", "castle"),
    ],
)
def test_names(raw, form):
    assert " ".join(names.words(names.undress(raw))) == form


@pytest.mark.parametrize(("value", "entity"), [("Gramorel Uppre Catsle", 1), ("Gramorel, Society of Friends of Old River and Lower Catsle", 2)])
def test_turned_values_with_typos(value, entity):
    matcher = canonical.Matcher([("Castle Gramorel Upper", 1), ("Society of Friends of Old River and Lower Castle Gramorel", 2)])
    assert matcher.match([value])[0].tolist() == [entity]


def test_map_values(spark):
    titles = spark.createDataFrame([("Castle Gramorel", 1), ("Siege of Druvena (1388)", 2), ("Kallisto III of Bruntha", 3), ("Feskia Nemkesttu", 4), ("Olmar International Airport", 5)], "title string, id int")
    redirects = spark.createDataFrame([("Old Vashkun", "Castle Gramorel"), ("Old Vashkun", "Castle Gramorel"), (None, "Castle Gramorel")], "from_title string, to_title string")
    cases = [("castle gramroel", 1), ("Gramorel, Castle", 1), ("Old Vashkuns", 1), ("Siege of Druvena (1389)", -1), ("Siege of Drvena (1388)", 2), ("Kallisto 3 of Bruntha", 3), ("Kallisto II of Bruntha", -1), ("F. Nemkesttu", 4), ("Olmar Airport", 5), ("Mayor of Gramorel", -1), ("...", -1), ("x" * 5000, -1)]
    rows = spark.createDataFrame([(k, v, "n") for k, (v, _) in enumerate(cases)], "link_id bigint, v string, entity_id string")
    names_df = canonical.reference_names(titles, redirects)
    got = {r.link_id: r.entity_id for r in canonical.map_values(rows, "link_id", "v", names_df).collect()}
    assert got == {k: e for k, (_, e) in enumerate(cases)}
    assert canonical.map_values(rows.limit(0), "link_id", "v", names_df).count() == 0


def test_map_values_in_shards(spark, monkeypatch):
    monkeypatch.setattr(canonical, "SHARD", 40)
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(12))
    reference = [(name(), k) for k in range(100)]
    values = [(k, n[:5] + n[6:]) for n, k in reference] + [(200, "zzzzzzzzzzz")]
    df = spark.createDataFrame(reference, "name string, entity bigint")
    got = {r.link_id: r.entity_id for r in canonical.map_values(spark.createDataFrame(values, "link_id bigint, v string"), "link_id", "v", df).collect()}
    assert got == {k: k for k in range(100)} | {200: -1}


@pytest.mark.parametrize(("value", "entity"), [("Malcom X", 1), ("Hnery V", 2), ("Vitamn C", 3), ("O'Brein", 4), ("M. Pontovedre", 5), ("M. Quastel", -1)])
def test_names_with_a_word_of_one_letter(value, entity):
    matcher = canonical.Matcher([("Malcolm X", 1), ("Henry V", 2), ("Vitamin C", 3), ("O'Brien", 4), ("Mary Pontoverde", 5)])
    assert matcher.match([value])[0].tolist() == [entity]


def test_shards_give_what_one_list_gives(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    reference = [("John Smith", 1), ("Jane Smith", 2), ("Mary Pontoverde", 3), ("Olmar International Airport", 4), ("Olmar  International Airport", 5)]
    reference += [(f"{word(4)} {word(4)}", k) for k in range(10, 150)] + [(f"{word(5)} Castle", k) for k in range(150, 180)] + [(f"{word(7)}", k) for k in range(180, 230)]
    values = ["J. Smith", "M. Pontoverde", "M. Pontovedre", "Olmar Airport", "Olmar Aiport", "a Castle", "...", "zzzzzzzz"] + [n for n, _ in reference]
    for n, _ in reference:
        at = rng.randrange(1, len(n) - 1)
        values += [n[:at] + n[at + 1 :], n[: at - 1] + n[at] + n[at - 1] + n[at + 1 :], " ".join(n.split()[::-1])[1:], f"{n[0]}. {n.split()[-1]}"]
    entity, score = canonical.Matcher(sorted(reference)).match(values)
    assert entity[0] == -1 and entity[1] == 3 and entity[3] == 5 and (entity >= 0).sum() > 100 and (entity < 0).sum() > 50
    monkeypatch.setattr(canonical, "SHARD", 60)
    df = spark.createDataFrame(reference, "name string, entity bigint")
    rows = spark.createDataFrame([(k // 2, v) for k, v in enumerate(values)] + [(0, values[0])], "link_id bigint, v string")  # keys repeat
    got = sorted(tuple(r) for r in canonical.map_values(rows, "link_id", "v", df).collect())
    assert got == sorted([(k // 2, e, s) for k, (e, s) in enumerate(zip(entity.tolist(), score.tolist()))] + [(0, entity[0], score[0])])


@pytest.mark.parametrize("least", [1, 3])
def test_cooccurrence_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(cooccur, "BLOCK", 40)
    monkeypatch.setattr(cooccur, "LONG", 5)  # records of up to 15 items: several pieces
    rng = random.Random(6)
    records = [(k, [rng.randrange(-3, 12) for _ in range(rng.randrange(0, 15))] + [None] * (k % 2)) for k in range(60)] + [(98, None), (99, [])]
    rows = cooccur.cooccurrence(spark.createDataFrame(records, "id bigint, l array<int>"), "l", least).collect()
    sets = [{x for x in r if x is not None} for _, r in records if r]
    sets = [s for s in sets if s]
    single, pair = {}, {}
    for s in sets:
        for x in s:
            single[x] = single.get(x, 0) + 1
        for p in itertools.combinations(sorted(s), 2):
            pair[p] = pair.get(p, 0) + 1
    n = len(sets)
    want = {p: (c, single[p[0]], single[p[1]], n) for p, c in pair.items() if c >= least}
    assert {(r.src_a, r.src_b): (r.n_ab, r.n_a, r.n_b, r.n_records) for r in rows} == want
    for r in rows:
        a, b, c = r.n_ab, r.n_a - r.n_ab, r.n_b - r.n_ab
        assert r.odds_ratio == pytest.approx((a + 0.5) * (n - a - b - c + 0.5) / ((b + 0.5) * (c + 0.5)))
        assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))


def test_top_n_with_ties_and_nulls(spark):
    rng = random.Random(7)
    rows = [(f"g{rng.randrange(5)}" if rng.random() < 0.9 else "hot", k, rng.randrange(4)) for k in range(500)] + [(None, 1, 9), ("g1", 1000, None)]
    df = spark.createDataFrame(rows, "g string, i int, s int").repartition(7)
    got = {(r.g, r["rank"]): r.i for r in topn.top_n(df, "g", "i", "s", 3).collect()}
    want = {}
    for g in {r[0] for r in rows} - {None}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))[:3]
        want.update({(g, k + 1): r[1] for k, r in enumerate(best)})
    assert got == want
    assert topn.top_n(df.limit(0), "g", "i", "s", 3).count() == 0


def test_space_saving_bounds(spark):
    rng = random.Random(8)
    items = [min(int(rng.paretovariate(0.8)), 5000) for _ in range(20000)]
    df = spark.createDataFrame([(str(i), 1 + i % 3) for i in items] + [(None, 7), ("1", None), ("2", -5)], "item string, w int").repartition(6)
    true = {}
    for i in items:
        true[str(i)] = true.get(str(i), 0) + 1 + i % 3
    rows = frequent.space_saving(df, "item", "w", 50).collect()
    total = next(r for r in rows if r["item"] is None)
    assert total["total"] == sum(true.values()) + 7 and len(rows) <= 51
    kept = {r["item"] for r in rows}
    for r in rows:
        if r["item"] is not None:
            assert r["count"] - r["error"] <= true[r["item"]] <= r["count"]
    assert all(v <= total["floor"] for k, v in true.items() if k not in kept)
    got = {r["item"]: r["weight"] for r in frequent.frequent_items(df, "item", "w", 0.02).collect()}
    assert got == {k: v for k, v in true.items() if v >= 0.02 * total["total"]}
    assert frequent.frequent_items(df.limit(0), "item", "w", 0.02).count() == 0


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "SLOTS", 20)
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.4 else f"t{rng.randrange(60)}", rng.randrange(15) if rng.random() < 0.9 else None, rng.randrange(5) if rng.random() < 0.8 else None) for _ in range(1500)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "term string, rec int, w int")
    got = {r.term: (r.w, r.n_records) for r in termfreq.term_counts(df, "term", "rec", ["w"], 0.05).collect()}
    want = {t: (sum(w or 0 for x, _, w in rows if x == t), len({r for x, r, _ in rows if x == t and r is not None})) for t in {r[0] for r in rows} - {None}}
    assert got == want
    assert termfreq.term_counts(df.limit(0), "term", "rec", ["w"]).count() == 0


def test_token_ids_equal_the_library(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer.default_path())
    t.encode_special_tokens = True
    rng = random.Random(10)
    signs = " \n\t' 　abcdstrevlmXYZé߁²٣-–.!?​́한강あ🙂\r\"<|endoftext|>"
    texts = [None, "", "  ", "'s't're 'll ''s", "<|endoftext|>", "a" * 3000, "ab" * 400 + " x", *("".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(300)), "word " * 900]
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for piece in (2_000_000, 300):
        monkeypatch.setattr(tokenizer, "PIECE", piece)
        model = tokenizer.vocabulary(tokenizer.default_path())
        import pyarrow as pa

        ids, counts = tokenizer.encode_column(model, pa.array(texts))
        ends = np.cumsum(counts)
        assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == want
    assert {r.doc_id: r.ids for r in tokenizer.token_ids(df).collect()} == dict(enumerate(want))
    assert {r.doc_id: r.n_tokens for r in tokenizer.token_counts(df).collect()} == {k: len(w) for k, w in enumerate(want)}


def test_packing(spark):
    rng = random.Random(11)
    sizes = [(k, rng.choice([0, None, rng.randrange(1, 60), 250])) for k in range(400)]
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n bigint"), "doc_id", "n", 100, 400, 150).collect()
    packed = {}
    for r in rows:
        total = sum(i["size"] for i in r["items"])
        assert total == r["used"] and r["used"] + r["unused"] == 100 and r["unused"] >= 0
        for i in r["items"]:
            packed.setdefault(i["item"], []).append(i["size"])
    assert {k: sum(v) for k, v in packed.items()} == {k: n for k, n in sizes if n}
    assert all(len(packed[k]) == -(-n // 100) for k, n in sizes if n)
    assert len({r["container_id"] for r in rows}) == len(rows)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n bigint"), "doc_id", "n", 100, 0).count() == 0


def test_first_fit_tree_is_first_fit():
    rng = random.Random(12)
    tree, rooms = packing.FirstFit(50, 200), []
    for size in sorted((rng.randrange(1, 40) for _ in range(200)), reverse=True):
        want = next((k for k, r in enumerate(rooms) if r >= size), len(rooms))
        if want == len(rooms):
            rooms.append(50)
        rooms[want] -= size
        assert tree.place(size) == want


def test_syllables():
    assert [readability.syllables(w) for w in ("cat", "table", "made", "wanted", "radio", "university", "the")] == [1, 2, 1, 2, 3, 5, 1]


def test_reading_levels_hold_out(spark):
    rows = pd.read_parquet("/root/testdata/sf0.01/graded_texts.parquet").sample(frac=1, random_state=1)
    train, test = rows.iloc[:300], rows.iloc[300:]
    levels = readability.fit(spark.createDataFrame(train[["text", "reading_level"]].values.tolist(), "text string, reading_level int"))
    got = [levels.level(t) for t in test["text"]]
    right = np.mean([(g is not None and g >= 4) == (w >= 4) for g, w in zip(got, test["reading_level"])])
    assert right >= 0.97
    hard = next(t for t, w in zip(test["text"], test["reading_level"]) if w == 5 and len(t) > 2000)
    assert levels.level(hard + " The cat sat on the mat. The dog ran to the cat.") >= 4
    for junk in (None, "", " \t", "* a list\n* of things", "{| x\n| 1 || 2\n|}", "река тихая", "x" * 100_000):
        assert levels.level(junk) is None
    docs = spark.createDataFrame([(1, hard), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.reading_level for r in readability.reading_levels(docs, levels).collect()}[2] is None


def test_syllables_by_hand_and_words_across_texts():
    words_ = {"cat": 1, "quality": 3, "being": 2, "prism": 2, "chasm": 2, "boxes": 2, "churches": 2, "baked": 1, "ended": 2, "actuation": 4}
    assert {w: readability.syllables(w) for w in words_} == words_
    texts = ["The cat sat on the mat. It was warm.", "", "* a list", "THE DOG RAN TO THE CAT. IT SAT.", "Der Hund läuft. ", "The “fat” cat—it’s old—sat in the hut!” It was <b class='" + "x" * 500 + "'>a</b> big one."]
    together = readability.counted(texts)
    for text, (rows, share) in zip(texts, together):
        (alone, part), = readability.counted([text])
        assert rows.tolist() == alone.tolist() and share == part
    assert together[0][0][:, readability.WORDS].sum() == 9 and together[3][0][:, readability.WORDS].sum() == 6  # two words are no sentence
    assert together[5][0][:, readability.WORDS].sum() == 14  # a long tag is no text


def test_reading_levels_of_empty_tables_and_clashing_names(spark):
    levels = readability.Levels([("The cat sat on the mat. The dog ran to the hut.", 1), ("The epiphenomenal interpretation of the periodization typified the fragmentation of the epistemological taxonomy.", 5)])
    docs = spark.createDataFrame([(1, "The cat sat on the mat. The dog ran to it.", 9), (1, "The cat sat on the mat. The dog ran to it.", 9), (None, None, None), (3, "", 1)], "doc_id bigint, text string, reading_level int")
    got = sorted((r.doc_id or 0, r.reading_level or 0) for r in readability.reading_levels(docs, levels).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (3, 0)]
    assert readability.reading_levels(docs.limit(0), levels).count() == 0


def test_top_n_of_a_hot_group_drops_rows_before_they_meet(spark, monkeypatch):
    rng = random.Random(13)
    rows = [("hot" if rng.random() < 0.9 else f"g{rng.randrange(200)}", k, rng.randrange(100_000)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "g string, i int, s int").repartition(16)
    want = {}
    for g in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:3]
        want.update({(g, k + 1): r[1] for k, r in enumerate(best)})
    kept = topn._kept(df, "g", "i", "s", 3)
    assert kept.where("g = 'hot'").count() <= 16 * 3
    survivors = topn._survivors(kept.cache(), 3)
    least = sorted((r[2] for r in rows if r[0] == "hot"), reverse=True)[2]
    hot = [r.s for r in survivors.where("g = 'hot'").collect()]
    bound = max(r.s for r in kept.where("g = 'hot' and r = 3").collect())
    assert least >= bound and min(hot) >= bound and len(hot) < 16 * 3  # what is below the bound never meets
    plan = survivors._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for most in (200_000, 0):  # broadcast bounds, then bounds joined by group and salt
        monkeypatch.setattr(topn, "BROADCAST_ROWS", most)
        assert {(r.g, r["rank"]): r.i for r in topn.top_n(df, "g", "i", "s", 3).collect()} == want


def test_frequent_items_beyond_a_broadcast(spark, monkeypatch):
    rng = random.Random(14)
    items = [f"i{min(int(rng.paretovariate(0.9)), 900)}" for _ in range(5000)] + [None] * 50
    df = spark.createDataFrame([(i,) for i in items], "item string").repartition(5)
    want = {k: n for k, n in ((k, items.count(k)) for k in set(items) - {None}) if n >= 0.03 * len(items)}
    for most in (200_000, 0):
        monkeypatch.setattr(frequent, "BROADCAST_ROWS", most)
        rows = frequent.frequent_items(df, "item", None, 0.03).collect()
        assert {r["item"]: r["weight"] for r in rows} == want and {r["total"] for r in rows} == {len(items)}


def test_lifts_of_billions_of_records(spark):
    big = spark.createDataFrame([(1, 2, 1_900_000_000, 1_900_000_000, 1_900_000_000, 6_000_000_000), (1, 3, 10, 1_900_000_000, 1_900_000_000, 6_000_000_000)], "src_a int, src_b int, n_ab bigint, n_a bigint, n_b bigint, n_records bigint")
    from entlink.llm import queries

    assert [r.src_b for r in big.where(queries.far_above_chance(200, 3)).collect()] == [2]


def test_containers_do_not_depend_on_the_layout(spark):
    rng = random.Random(15)
    sizes = [(k, rng.randrange(1, 60)) for k in range(300)] + [(None, 7)] * 400 + [(5, 9)] * 3
    found = []
    for n in (1, 7):
        rng.shuffle(sizes)
        rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n bigint").repartition(n), "doc_id", "n", 100, len(sizes), 100).collect()
        found.append(sorted((r.container_id, sorted((i["item"] or -1, i["part"], i["size"]) for i in r["items"])) for r in rows))
    assert found[0] == found[1]
    assert sum(len(items) for _, items in found[0]) == len(sizes)


@pytest.mark.parametrize("swaps", [False, True])
def test_bk_forest_of_many_signs(swaps):
    rng = random.Random(16)
    signs = [chr(0x4E00 + k) for k in range(100)]
    word = lambda: "".join(rng.choice(signs) for _ in range(rng.randrange(1, 4)))
    entries = sorted({word() for _ in range(200)})
    queries = entries[:20] + [word() for _ in range(60)]
    forest = bktree.BKForest(entries)
    assert forest.peq.shape[1] == bktree.SIGNS + 2
    measure = canonical.edits if swaps else plain_levenshtein
    limit = np.array([k % 3 for k in range(80)])
    q, e, _ = forest.search(queries, limit, swaps=swaps)
    got = {(i, j) for i, j in zip(q.tolist(), e.tolist()) if measure(queries[i], entries[j]) <= limit[i]}
    want = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(entries) if measure(a, b) <= limit[i]}
    assert got == want and (swaps or len(got) == len(q))


def test_map_values_of_nulls_and_hot_values(spark, monkeypatch):
    names_df = spark.createDataFrame([("Castle Gramorel", 1), ("Old Vashkun", 2), ("Lake Druvena", 3)], "name string, entity bigint")
    values = [None, "", " \t", "castle gramorle"] + ["Old Vashkun"] * 50 + ["nothing at all"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "link_id bigint, v string")
    want = [-1, -1, -1, 1] + [2] * 50 + [-1]
    for shard, hot in ((100, 1000), (2, 1000), (2, 3)):
        monkeypatch.setattr(canonical, "SHARD", shard)
        monkeypatch.setattr(canonical, "HOT", hot)
        got = {r.link_id: r.entity_id for r in canonical.map_values(rows, "link_id", "v", names_df).collect()}
        assert got == dict(enumerate(want))
    empty = spark.createDataFrame([], "name string, entity bigint")
    assert {r.entity_id for r in canonical.map_values(rows, "link_id", "v", empty).collect()} == {-1}
