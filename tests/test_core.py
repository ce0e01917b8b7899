import importlib.util
import math
import random

import pytest
from pyspark.sql import functions as F

from entlink.functions import text as T
from entlink.operators import bp, detect, evaluate, kb, links, skew, walk
from entlink.operators import tokens as tk
from entlink.plans.base import Base
from entlink.plans.queries import queries
from entlink.session import mention_key, once
from entlink.sources import formats

SENTENCE = "our bodies use carbohydrates. glycogen, amino-acids "


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).head()[0]


def test_tokens_golden(spark):
    rows = tk.tokens(spark.createDataFrame([(1, SENTENCE), (2, None), (3, "")], "doc_id bigint, text string")).collect()
    assert [(r.token, r.off) for r in sorted(rows, key=lambda r: r.pos)] == [
        ("our", 0), ("bodies", 4), ("use", 11), ("carbohydrates", 15), (".", 28), ("glycogen", 30), ("amino", 40), ("-", 45), ("acids", 46)
    ]


def test_ngrams_golden(spark):
    rows = tk.ngrams(spark.createDataFrame([(1, SENTENCE)], "doc_id bigint, text string"), 3).collect()
    got = {(r.ngram, r.off, r.len) for r in rows}
    assert len(rows) == 24
    assert {("carbohydrates . glycogen", 15, 23), (". glycogen amino", 28, 17), ("amino - acids", 40, 11), ("glycogen amino -", 30, 16), ("our bodies use", 0, 14)} <= got


def test_tokens_equal_builtin_functions(spark):
    rng = random.Random(5)
    signs = "aBéÑ \t\n.-!:—“()_ 🙂x"
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = sorted(map(tuple, tk.tokens(docs).collect()))
    b = sorted(map(tuple, tk.running_offsets(docs).collect()))
    assert a == b


def test_dictionary_ngrams_against_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "-", "."]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(60)]
    entries = ["a", "a b", "b - c", "a b c", "c . a", "b c a b"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.pos, r.n, r.mention) for r in tk.dictionary_ngrams(docs, spark.createDataFrame([(e,) for e in entries], "mention string")).collect()}
    want = set()
    for key, text in rows:
        t = text.split()
        for i in range(len(t)):
            for n in range(1, min(11, len(t) - i) + 1):
                gram = " ".join(t[i : i + n])
                if gram not in entries and " - " in gram:
                    gram = gram.replace(" - ", " ")
                if gram in entries:
                    want.add((key, i, n, gram))
    assert got == want


@pytest.mark.parametrize(("m", "want"), [(3, (1, 4)), (2, (1, 4)), (1, (0, 3)), (0, (0, 3))])
def test_context_window(spark, m, want):
    begin, end = tk.context_bounds(F.lit(m), F.lit(4), 3)
    assert tuple(spark.range(1).select(begin, end).head()) == want


def test_normalisation(spark):
    assert one(spark, T.normalize, "The <small>Big</small>&amp;<br />(Cat)-x. <!-- no --> Y") == "the big& cat - x . y"
    assert one(spark, T.normalize_no_delimiters, "A.b-c! d:e") == "a b c d e"
    assert one(spark, T.process_target, "foo_bar%20baz&#233;") == "Foo bar bazé"
    assert one(spark, T.process_target, "100%_x") == "100% x"
    assert one(spark, T.remove_hash, "A#b#c") == "A"
    assert one(spark, T.normalize, None) is None
    linked, total = T.keyphraseness_pair(F.lit("(11, 12)"))
    assert tuple(spark.range(1).select(linked, total).head()) == (11, 12)


def test_mention_key_and_once(spark):
    assert one(spark, mention_key, "\t A  b \t") == "a b"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "c"), (None, "c")], "id int, v string")
    assert sorted(r.v for r in once(rows, "id").collect()) == ["a", "b", "c"]
    maps = spark.createDataFrame([(1, {1: 2}), (1, {1: 2}), (None, None)], "id int, m map<int,int>")
    assert once(maps, "id").count() == 2


def test_relatedness_by_hand(spark):
    v = spark.range(1).select(links.relatedness_of(F.lit(3), F.lit(2), F.lit(1), 10)).head()[0]
    assert v == pytest.approx(0.317394, abs=1e-6)
    rows = spark.createDataFrame([(1, 10, 2), (2, 10, 3), (1, 11, 1), (3, 11, 1)], "entity_id int, src int, freq bigint")
    got = {(r.e1, r.e2): (r.common, r.weighted) for r in links.cocitation(rows).collect()}
    assert got == {(1, 2): (1, 6), (1, 3): (1, 1)}


def test_walk_by_hand(spark):
    scored = spark.createDataFrame([(1, 0, 1, "m", 5, 0.75), (1, 0, 1, "m", 6, 0.25)], "doc_id bigint, pos int, n int, mention string, entity_id int, compat double")
    mentions = spark.createDataFrame([(1, 0, 1, 1.0)], "doc_id bigint, pos int, n int, importance double")
    pairs = links.related_pairs(scored, spark.createDataFrame([], "e1 int, e2 int, rel double"))
    graph, nodes = walk.edges(scored, pairs), walk.vertices(mentions, scored)
    ranks = {r.entity: r.p for r in walk.converge(graph, nodes, tolerance=1e-12, most=500).collect()}
    assert ranks[-1] == pytest.approx(0.526316, abs=1e-5) and ranks[5] == pytest.approx(0.355263, abs=1e-5)
    assert sum(ranks.values()) == pytest.approx(1)
    assert walk.violations(graph, nodes).count() == 0
    assert walk.components(graph, nodes).head().n_components == 1
    stepped = {r.entity: r.p for r in walk.steps(graph, nodes, 2).collect()}
    assert sum(stepped.values()) == pytest.approx(1)


def test_belief_propagation_by_hand(spark):
    rows = [(1, 0, 1, "x", 1, 0.6), (1, 0, 1, "x", 2, 0.4), (1, 5, 1, "y", 3, 0.5), (1, 5, 1, "y", 4, 0.5)]
    scored = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id bigint, pos int, n int, mention string, entity_id int, compat double, freq bigint, name_freq bigint")
    rel = spark.createDataFrame([(1, 3, 0.8)], "e1 int, e2 int, rel double")
    none = spark.createDataFrame([], "entity_id int, popularity bigint")
    c, p = bp.Basic().prepare(scored, rel, None, none)
    done = {r.entity_id: r for r in bp.converge(c, p).collect()}
    assert {k: round(r.score, 6) for k, r in done.items()} == {1: 1.1, 2: 0.2, 3: 1.05, 4: 0.25}
    assert {r.iterations for r in done.values()} == {2}
    assert {r.entity_id: round(r.score, 6) for r in bp.rounds(c, p, 2).collect()} == {1: 1.1, 2: 0.2, 3: 1.05, 4: 0.25}
    assert bp.delta(c, p, 2).head().delta == pytest.approx(0)
    assert {(r.pos, r.entity_id) for r in detect.best_scored(bp.rounds(c, p, 2), "score").collect()} == {(0, 1), (5, 3)}


def test_belief_propagation_with_negative_relatedness_against_a_dense_one(spark):
    rng = random.Random(17)
    sizes = [2, 3, 1, 2]
    rows = [(1, 10 * m, 1, f"m{m}", 10 * m + k, rng.random()) for m, size in enumerate(sizes) for k in range(size)]
    scored = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id bigint, pos int, n int, mention string, entity_id int, compat double, freq bigint, name_freq bigint")
    values = {(a[4], b[4]): rng.choice([-0.9, -0.2, 5e-7, 0.3, 0.8]) for a in rows for b in rows if a[4] < b[4] and rng.random() < 0.7}
    rel = spark.createDataFrame([(*k, v) for k, v in values.items()], "e1 int, e2 int, rel double")
    c, p = bp.Basic().prepare(scored, rel, None, None)
    l = len(sizes)
    term = lambda x, y: 2 * max((v for v in [values.get((min(x, y), max(x, y)), 0.0)] if v >= 1e-6), default=0.0) / (l * (l - 1))
    mentions = {m: [r for r in rows if r[3] == f"m{m}"] for m in range(l)}
    sent = {}
    for done in range(1, 4):
        new = {}
        for i in mentions:
            for j in mentions:
                if i != j:
                    best = {y[4]: max(x[5] / l + sum(sent.get((k, i, x[4]), 0.0) for k in mentions if k not in (i, j)) + term(x[4], y[4]) for x in mentions[i]) for y in mentions[j]}
                    new |= {(i, j, y): v - min(best.values()) for y, v in best.items()}
        sent = new
        want = {r[4]: r[5] / l + sum(sent[k, int(r[3][1:]), r[4]] for k in mentions if f"m{k}" != r[3]) for r in rows}
        if done in (2, 3):
            assert {r.entity_id: r.score for r in bp.rounds(c, p, done).collect()} == pytest.approx(want)
            assert {r.entity_id: r.score for r in bp.converge(c, p, most=done, tolerance=0.0).collect()} == pytest.approx(want)


def test_pairs_of_long_pages_and_popular_entities(spark, monkeypatch):
    monkeypatch.setattr(links, "PAGE_PIECE", 3)
    rng = random.Random(18)
    rows = [(e, s, rng.randrange(1, 4)) for s in range(6) for e in rng.sample(range(20), 2 + 3 * s)]
    want = {}
    for e1, s1, f1 in rows:
        for e2, s2, f2 in rows:
            if s1 == s2 and e1 < e2:
                c, w = want.get((e1, e2), (0, 0))
                want[e1, e2] = c + 1, w + f1 * f2
    common = links.cocitation(spark.createDataFrame(rows, "entity_id int, src int, freq bigint"))
    assert {(r.e1, r.e2): (r.common, r.weighted) for r in common.collect()} == want
    cands = [(d, 5 * p, 1, e) for d in range(4) for p in range(4) for e in rng.sample(range(22), 3)]
    pairs = links.listed_pairs(spark.createDataFrame(cands, "doc_id bigint, pos int, n int, entity_id int"), common, "common")
    expected = sorted(
        (d, p, e, q, f, want.get((min(e, f), max(e, f)), (None,))[0])
        for d, p, _, e in cands for g, q, _, f in cands
        if d == g and p != q and (e == f or (min(e, f), max(e, f)) in want)
    )
    assert sorted((r.doc_id, r.pos1, r.entity1, r.pos2, r.entity2, r.common) for r in pairs.collect()) == expected
    assert all(r.n <= math.sqrt(2 * len(want)) for r in links._turned(common.select("e1", "e2")).groupBy("low").agg(F.count("*").alias("n")).collect())


def test_references_are_resolved_in_four_passes():
    assert T.unescaped("&amp;amp;amp;lt;b &#233;&#xE9; &eacute; &apos; &copy &nosuch; &#0; &#xD800;") == "<b éé é ' &copy &nosuch; &#0; &#xD800;"
    assert T.unescaped("&amp;amp;amp;amp;lt;") == "&lt;" and T.unescaped(None) is None and T.unescaped("a & b") == "a & b"


def test_token_figures_equal_the_tokens(spark):
    rng = random.Random(19)
    rows = [(k, " ".join(rng.choice(["a", "B", "b", ".", "é", "🙂-x"]) for _ in range(rng.randrange(12)))) for k in range(60)] + [(90, None), (91, ""), (92, " ; ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    by = tk.tokens(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("off").alias("sum_off"), F.sum("len").alias("sum_len"), F.count_distinct("token").alias("n_distinct"), F.max_by("token", "pos").alias("last_token"))
    assert sorted(map(tuple, tk.token_figures(docs).collect())) == sorted(map(tuple, by.collect()))


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "doc_id bigint, mention string, entity_id int")
    solved = spark.createDataFrame([(1, "a", 1), (1, "b", 9), (1, "a", 1)], "doc_id bigint, mention string, entity_id int")
    rows = {r.doc_id: (r.good, r.fp, r.fn, r.precision, r.recall) for r in evaluate.per_document(solved, truth).collect()}
    assert rows == {1: (1, 1, 1, 0.5, 0.5), 2: (0, 0, 1, 1.0, 0.0)}
    total = evaluate.summary(evaluate.per_document(solved, truth)).head()
    assert (total.macro_p, total.macro_r) == (0.75, 0.25) and total.micro_r == pytest.approx(1 / 3)
    found = spark.createDataFrame([(1, "a", 1), (1, "z", 7), (1, "z", 8)], "doc_id bigint, mention string, entity_id int")
    md = {r.doc_id: (r.good, r.wrong) for r in evaluate.detection(found, truth).collect()}
    assert md == {1: (1, 1), 2: (0, 0)}


def test_formats(spark, tmp_path):
    lines = spark.createDataFrame([("m\t3\t7,2\t9,1",), ("x\t1",)], "value string")
    assert {tuple(r) for r in formats.parse_candidates(lines).collect()} == {("m", 3, 7, 2), ("m", 3, 9, 1)}
    (tmp_path / "a.xml").write_text("<r><annotation><docName>d</docName><wikiName>T</wikiName><offset>3</offset><length>2</length></annotation><annotation><docName>d</docName><wikiName/><offset>1</offset><length>1</length></annotation></r>")
    rows = formats.read_annotations(spark, str(tmp_path / "a.xml"))
    kept = formats.keep_annotations(rows, spark.createDataFrame([("T", 4)], "title string, id int"), False)
    assert [tuple(r) for r in kept.select("filename", "off", "len", "entity_id").collect()] == [("d", 3, 2, 4)]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert formats.read_documents(spark, str(tmp_path / "t.txt")).head().text == "one\ntwo\n"
    manual = spark.createDataFrame([(0, "DOC: d"), (1, "NAME: cat"), (2, "OFFSET: 0"), (3, "URL: u"), (4, "CONTEXT: a cat")], "i int, value string")
    notes = formats.parse_manual_annotations(manual, "i")
    fixed = formats.repair_offsets(notes, spark.createDataFrame([("d", "see a cat")], "filename string, text string"))
    assert fixed.head().off == 6
    formats.write_tsv(spark.createDataFrame([("a b", 1)], formats.TITLES), str(tmp_path / "tsv"))
    assert tuple(formats.read_tsv(spark, str(tmp_path / "tsv"), formats.TITLES).head()) == ("a b", 1)


def test_ragged_lines(spark, tmp_path):
    lines = spark.createDataFrame([("m\t3\t7\t2\t9",), ("x\t1\t1",)], "value string")
    assert [tuple(r) for r in formats.parse_mentions(lines).orderBy("mention").collect()] == [("m", 3, 7, [2, 9]), ("x", 1, 1, [])]
    links_ = spark.createDataFrame([("5\t1\t2\t3",), ("6",)], "value string")
    assert [tuple(r) for r in formats.parse_inlinks(links_).orderBy("entity_id").collect()] == [(5, [1, 2, 3]), (6, [])]
    rows = spark.createDataFrame([(k, k % 2) for k in range(10)], "a int, b int")
    formats.write_outputs(rows, {"even": (F.col("b") == 0, str(tmp_path / "even")), "odd": (F.col("b") == 1, str(tmp_path / "odd"))})
    assert spark.read.parquet(str(tmp_path / "even")).count() == 5 and {r.a for r in spark.read.parquet(str(tmp_path / "odd")).collect()} == {1, 3, 5, 7, 9}


def test_sequence_files(spark, tmp_path):
    path = str(tmp_path / "seq")
    formats.write_sequence_file(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    assert sorted(tuple(r) for r in formats.read_sequence_file(spark, path, "k int, v string").collect()) == [(1, "a"), (2, "b")]


def test_xml_elements_round_trip(spark):
    rows = spark.createDataFrame([("f", "a & <b>", 3, 7), ("g", "é", 0, 1)], "filename string, name string, off int, len int")
    assert sorted(map(tuple, formats.parse_annotations(formats.format_annotations(rows)).collect())) == sorted(map(tuple, rows.collect()))


def test_stored_knowledge_base(spark, tmp_path):
    from entlink.plans.base import Base

    b = Base.of(spark, "/root/testdata/sf0.001")
    formats.store_kb(b, str(tmp_path))
    loaded = formats.load_kb(spark, str(tmp_path))
    assert loaded["dictionary"].count() == b.dictionary.count() and loaded["inlinks"].count() == b.inlinks.count() and loaded["titles"].count() == 4000


def test_occurrences_and_best_setting(spark):
    df = spark.createDataFrame([("ab", "ab ab x ab"), ("zz", "ab"), ("aa", "aaaa")], "part string, text string")
    got = [tuple(r) for r in df.select(T.count_occurrences(F.col("part"), F.col("text")), T.count_occurrences(F.col("part"), F.col("text"), True)).collect()]
    assert got == [(1, 3), (0, 0), (1, 2)]
    results = spark.createDataFrame([(0.5, 0.7), (0.6, 0.9), (0.4, 0.9)], "beta double, score double")
    assert tuple(evaluate.best_setting(results, "beta", "score").head()) == (0.4, 0.9)


@pytest.mark.parametrize(("pos", "want"), [(3, "lived in los"), (2, "lived in los"), (1, "michael lived in"), (0, "michael lived in")])
def test_context_texts_golden(spark, pos, want):
    docs = spark.createDataFrame([(1, "michael lived in los")], "doc_id bigint, text string")
    mentions = spark.createDataFrame([(1, pos, 4)], "doc_id bigint, pos int, n_tokens int")
    assert [r.context for r in detect.context_texts(docs, mentions, 3).collect()] == [want]


def test_context_frames_are_made_where_the_texts_are(spark):
    """Frames of tokens do not go to the driver to be broadcast, nor tokens through a join: only the mentions meet the texts."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["a", "b", "Él", ".", "x-y"]) for _ in range(rng.randrange(1, 9)))) for k in range(40)]
    docs = spark.createDataFrame(rows + [(90, ""), (91, None)], "doc_id bigint, text string")
    words = {}
    for r in sorted(tk.tokens(docs).collect(), key=lambda r: r.pos):
        words.setdefault(r.doc_id, []).append(r.token)
    places = [(k, p, len(t)) for k, t in words.items() for p in range(len(t)) if rng.random() < 0.6]
    mentions = spark.createDataFrame(places + places[:3], "doc_id bigint, pos int, n_tokens int")
    want = {}
    for k, p, n in places:
        begin = 0 if p < 2 else max(0, n - 4) if p + 2 >= n else p - 2
        want[k, p] = words[k][begin : begin + 4]
    texts, terms = detect.context_texts(docs, mentions, 4), detect.contexts(docs, mentions, 4)
    assert sorted((r.doc_id, r.pos, r.context) for r in texts.collect()) == sorted((*key, " ".join(t)) for key, t in want.items())
    assert sorted(map(tuple, terms.collect())) == sorted((*key, t, w.count(t)) for key, w in want.items() for t in set(w))
    for frame in (texts, terms):
        assert "Generate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_dictionary_of_many_names_passes_the_sieve(spark):
    names = spark.range(50_000).select(F.concat(F.lit("name "), F.col("id")).alias("mention"), F.col("id").alias("number"))
    docs = spark.createDataFrame([(1, "some name 7 and name 49999 or name 50000 and the name - 12"), (2, None)], "doc_id bigint, text string")
    sieve = tk.sieve_of(names, 50_000, 11)
    assert len(sieve.data) * 8 == 2**20 and sieve.longest == 2
    got = {(r.pos, r.n, r.mention, r.number) for r in tk.dictionary_ngrams(docs, names).collect()}
    assert got == {(1, 2, "name 7", 7), (4, 2, "name 49999", 49999), (11, 3, "name 12", 12)}
    plan = tk.dictionary_ngrams(docs, names)._jdf.queryExecution().toString()
    assert "LeftOuter" not in plan.split("Optimized Logical Plan")[1].split("Physical Plan")[0].replace("Join LeftOuter, (form", "", 1)


def test_one_text_is_linked_by_every_method(spark):
    from entlink.plans.base import Base
    from entlink.streaming import linker

    b = Base.of(spark, "/root/testdata/sf0.001")
    known = linker.Knowledge.of(b)
    key = b.spots.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy("n", "doc_id").head().doc_id
    one_text = b.docs.where(F.col("doc_id") == key)
    spots = {(r.pos, r.n) for r in b.spots.where(F.col("doc_id") == key).collect()}
    for method in ("frequent", "walk", "bp"):
        rows = linker.link_texts(one_text, known, 0.0, method).collect()
        assert {(r.pos, r.n) for r in rows} == spots, method
        assert {r.doc_id for r in rows} == {key}
    assert linker.link_texts(one_text, known, 2.0, "walk").count() == 0
    with pytest.raises(ValueError):
        linker.link_texts(one_text, known, 0.0, "guess")


def test_ranks_of_skewed_keys(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 30), rng.choice([rng.randrange(-50, 50), rng.randrange(-(2**61), 2**61)])) for _ in range(3000)] + [(None, 1), (3, None)]
    values = spark.createDataFrame(rows, "k int, v bigint")
    got = {(r.k, r.rank): r.v for r in skew.quantiles(values, "k", "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    by = {}
    for k, v in rows:
        if k is not None and v is not None:
            by.setdefault(k, []).append(v)
    want = {}
    for k, v in by.items():
        v.sort()
        for p in (0.0, 0.25, 0.5, 1.0):
            r = max(1, math.ceil(len(v) * p))
            want[k, r] = v[r - 1]
    assert got == want
    assert skew.quantiles(values.limit(0), "k", "v", [0.5]).count() == 0


def test_ranks_when_state_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    rows = [(k % 7 if k % 3 else 0, (k * 7919) % 1000) for k in range(2000)]
    values = spark.createDataFrame(rows, "k int, v bigint")
    got = {r.k: r.v for r in skew.select_ranks(values, "k", "v", F.array(F.col("n"))).collect()}
    assert got == {k: max(v for q, v in rows if q == k) for k in {k for k, _ in rows}}


def test_top_source_ties_and_nulls(spark):
    schema = "record_id bigint, entity_id int, total_freq int, links array<struct<src:int,freq:int>>, extra string"
    rows = [(1, 1, 1, [(5, 2), (4, 2)], "x"), (1, 1, 1, [(5, 2), (4, 2)], "y"), (2, 1, 1, None, None), (3, 2, 1, [], None), (4, None, 1, [(9, 9)], None), (5, 3, None, [(7, 1), (7, 1), (8, 1)], None)]
    got = {r.entity_id: (r.src, r.freq) for r in skew.top_source(skew.link_frequencies(spark.createDataFrame(rows, schema))).collect()}
    assert got == {1: (4, 2), 3: (7, 2)}


def test_top_source_of_frequencies_beyond_32_bits(spark, monkeypatch):
    rows = [(1, 5, 2**31 + 7), (1, 6, 9), (2, 5, 2**32 + 1), (2, 6, 9), (3, 8, 2**61), (3, 4, 2**61), (3, 2, 2**61 - 1), (4, 1, 0), (4, 2, 0), (None, 1, 1), (5, 1, None)]
    df = spark.createDataFrame(rows, "entity_id int, src int, freq bigint")
    for most in (200_000, 0):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", most)
        got = {r.entity_id: (r.src, r.freq) for r in skew.top_source(df).collect()}
        assert got == {1: (5, 2**31 + 7), 2: (5, 2**32 + 1), 3: (4, 2**61), 4: (1, 0)}
    assert skew.top_source(df.limit(0)).count() == 0


def test_core_does_not_need_llm():
    import pathlib

    root = pathlib.Path(kb.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "entlink.llm" not in p.read_text(), p
    assert importlib.util.find_spec("entlink.plans.queries")


def test_entry_point(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0


def test_link_stream(spark, tmp_path):
    from entlink.streaming.linker import link_stream

    dictionary = spark.createDataFrame([("cat", 3, 4, 5, 1, 3), ("cat", 3, 4, 5, 2, 2)], "mention string, linked bigint, total bigint, name_freq bigint, entity_id int, freq bigint")
    spark.createDataFrame([(1, "a cat sat")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    q = link_stream(docs, dictionary, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert [(r.mention, r.entity_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("cat", 1)]


def test_sweep_of_beta_is_converged_and_whole(spark):
    from entlink.plans import queries
    from entlink.plans.base import Base

    d = "/root/testdata/sf0.001"
    rows = {r.beta: r for r in queries.sweep_beta_best(spark, d).collect()}
    assert sorted(rows) == [k / 10 for k in range(5, 16)]
    b = Base.of(spark, d)
    truth = {tuple(r) for r in b.truth.select(*evaluate.KEY).collect()}
    for beta in (0.6, 1.3):
        done = detect.best_scored(bp.converge(*bp.Full(beta=beta).prepare(b.scored, b.rel, b.common, b.popular)), "score")
        assert rows[beta].good == len({tuple(r) for r in done.select(*evaluate.KEY).collect()} & truth)
    best = min(rows.values(), key=lambda r: (-r.good, r.beta))
    assert [r.beta for r in rows.values() if r.is_best] == [best.beta]


def test_threshold_sweep_solves_walk_and_belief_propagation(spark):
    from entlink.plans import queries
    from entlink.plans.base import Base

    d = "/root/testdata/sf0.001"
    rows = {(r.threshold, r.method): r for r in queries.sweep_threshold(spark, d).collect()}
    assert set(rows) == {(t, m) for t in queries._THRESHOLDS for m in ("frequent", "walk", "bp")}
    b = Base.of(spark, d)
    truth = {tuple(r) for r in b.truth.select(*evaluate.KEY).collect()}
    for t in (0.1, 0.45):
        mentions = detect.importance(detect.by_threshold(b.spots, t)).cache()
        cands = detect.candidates(mentions, b.dictionary)
        scored = detect.compatibility(cands, detect.context_weights(detect.contexts(b.docs, mentions), b.df), b.vectors).withColumn("compat", F.round("compat", 9)).cache()
        graph = walk.edges(scored, links.related_pairs(scored, b.rel)), walk.vertices(mentions, scored)
        done = {
            "frequent": detect.most_frequent(cands),
            "walk": detect.best_scored(walk.decide(scored, walk.converge(*graph, tolerance=1e-10, most=200)), "score"),
            "bp": detect.best_scored(bp.converge(*bp.Basic().prepare(scored, b.rel, b.common, b.popular)), "score"),
        }
        for method, solved in done.items():
            got = {tuple(r) for r in solved.select(*evaluate.KEY).collect() if r.doc_id in {x[0] for x in truth}}
            assert (rows[t, method].good, rows[t, method].found) == (len(got & truth), len(got)), (t, method)


def test_whole_texts_and_edges_come_out(spark):
    from entlink.plans import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.normalized for r in queries.queries()["normalize_no_delims_text"](spark, d).collect()}
    short = {r.doc_id: r for r in queries.normalize_no_delims(spark, d).collect()}
    assert {k: (t is not None and len(t), t and t[:40]) for k, t in texts.items()} == {k: (r.length is not None and r.length, r.start) for k, r in short.items()}
    assert max(len(t or "") for t in texts.values()) > 40
    sums = {}
    for r in queries.queries()["referent_edge_rows"](spark, d).collect():
        n, targets = sums.get((r.doc_id, r.pos1, r.n1, r.entity1), (0, 0))
        sums[r.doc_id, r.pos1, r.n1, r.entity1] = n + 1, targets + r.entity2
    assert sums == {(r.doc_id, r.pos1, r.n1, r.entity1): (r.edges, r.targets) for r in queries.referent_edges(spark, d).collect()}


def test_missed_lists_are_whole_and_ranked(spark):
    from entlink.plans import queries
    from entlink.plans.base import Base

    d = "/root/testdata/sf0.001"
    b, run = Base.of(spark, d), queries.queries()
    truth = {tuple(r) for r in b.truth.select(*evaluate.KEY).collect()}
    names = {r[:2] for r in truth}
    wrong = sorted((-round(r.keyphraseness, 9), r.doc_id, r.pos, r.n) for r in b.spots.collect() if (r.doc_id, r.mention) not in names)
    got = sorted(run["false_positives_ranked"](spark, d).collect(), key=lambda r: r["rank"])
    assert [(-r.keyphraseness, r.doc_id, r.pos, r.n) for r in got] == wrong and [r["rank"] for r in got] == list(range(1, len(wrong) + 1))
    kp = {r.mention: round(r.linked / r.total, 9) for r in b.dictionary.collect()}
    low = sorted((kp[m], k, m, e) for k, m, e in truth if m in kp)
    got = sorted(run["truth_low_keyphraseness"](spark, d).collect(), key=lambda r: r["rank"])
    assert [(r.keyphraseness, r.doc_id, r.mention, r.entity_id) for r in got] == low and [r["rank"] for r in got] == list(range(1, len(low) + 1))


class _NoCompatibility(Base):
    """A base without compatibility: what does not use it must not make it."""

    @property
    def scored(self):
        raise AssertionError("compatibility is not used here")


@pytest.mark.parametrize("name", ["eval_prf_per_doc", "eval_outcomes", "eval_macro_micro"])
def test_no_compatibility_for_frequent_entities(spark, monkeypatch, name):
    b = _NoCompatibility(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(Base, "of", classmethod(lambda cls, *_: b))
    assert queries()[name](spark, b.d).count()


def test_no_compatibility_for_scorers_of_counts(spark):
    from entlink.plans.queries import _bp

    b = _NoCompatibility(spark, "/root/testdata/sf0.001")
    for scorer in (bp.Full(), bp.MaxEnt()):
        rows, pairs = _bp(b, scorer)
        assert {"local", "absent"} <= set(rows.columns) and "compat" not in rows.columns and "pair" in pairs.columns


def test_detection_sweep_equals_detection_at_each_threshold(spark):
    """Nothing is repeated for each threshold before it is counted; texts without a truth or without a find count as before."""
    rng = random.Random(11)
    keyphraseness = {m: rng.choice([0.004, 0.1, 0.35, 0.5, 0.9]) for m in "abcdefgh"}
    dictionary = spark.createDataFrame(sorted({(m, rng.randrange(4)) for m in keyphraseness for _ in range(3)}), "mention string, entity_id int")
    found = spark.createDataFrame([(k, m, s) for k in range(12) for m, s in keyphraseness.items() if rng.random() < 0.4], "doc_id bigint, mention string, keyphraseness double")
    truth = spark.createDataFrame(sorted({(k, rng.choice("abcdefghz"), rng.randrange(4)) for k in range(2, 15) for _ in range(6)}), "doc_id bigint, mention string, entity_id int")
    grid = [0.001, 0.1, 0.3, 0.5, 0.6, 0.95]
    rows = evaluate.detection(evaluate.sweep(found.join(dictionary, "mention"), "keyphraseness", grid), truth, ["threshold"])
    want = rows.groupBy("threshold").agg(F.round(F.avg("precision"), 6), F.round(F.avg("recall"), 6), F.sum("good"))
    got = evaluate.detection_sweep(found, dictionary, truth, "keyphraseness", grid)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5


def _small_corpus(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(30)]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 300])))) for k in range(25)] + [(25, ""), (26, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = [(k, (t or "").count(" ") + 1, p, 1) for k, t in texts if t for p in range(0, t.count(" ") + 1, 3)]
    mentions = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, pos int, n int").withColumn("mention", F.lit("m"))
    cands = mentions.select("doc_id", "pos", "n", "mention").join(spark.createDataFrame([(e,) for e in range(6)], "entity_id int")).withColumn("freq", F.lit(1)).withColumn("name_freq", F.lit(1))
    df = spark.createDataFrame([(w, 10 + 7 * k) for k, w in enumerate(words[:25])], "term string, df bigint")
    vectors = [(e, w, rng.random() * 3) for e in range(5) for w in rng.sample(words + ["elsewhere"], 12)] + [(5, "w0", 0.0), (9, "w1", 1.0)]
    return docs, mentions, cands, df, spark.createDataFrame(vectors, "entity_id int, term string, w double")


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_compatibility_of_texts_equals_the_join_of_terms(spark, monkeypatch, block):
    from entlink.operators import compat

    docs, mentions, cands, df, vectors = _small_corpus(spark)
    plain = detect.compatibility(cands, detect.context_weights(detect.contexts(docs, mentions), df), vectors)
    want = {(r.doc_id, r.pos, r.entity_id): r.compat for r in plain.collect()}
    monkeypatch.setattr(compat.cosines, "__defaults__", (block,))
    got = {(r.doc_id, r.pos, r.entity_id): r.compat for r in detect.text_compatibility(docs, mentions, cands, df, vectors).collect()}
    assert got.keys() == want.keys() and sum(v > 0 for v in got.values()) > len(got) / 2
    assert all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_terms_of_contexts_are_no_rows(spark, monkeypatch):
    """Compatibility must not make a row of every term of a context, as it did."""

    def made(*_, **__):
        raise AssertionError("terms of contexts are not made here")

    monkeypatch.setattr(tk, "frame_terms", made)
    assert "compat" in Base(spark, "/root/testdata/sf0.001").scored.columns


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_graphs_and_messages_of_texts_equal_the_joins(spark, monkeypatch, most):
    from entlink.operators import texts

    monkeypatch.setattr(texts, "LISTED", most)
    rng = random.Random(4)
    rows = [(doc, pos, 1, f"m{pos}", e, rng.choice([0.0, 0.2, 0.7])) for doc in range(4) for pos in range(1 + doc * 2) for e in rng.sample(range(9), rng.randrange(1, 5))]
    scored = spark.createDataFrame(rows, "doc_id bigint, pos int, n int, mention string, entity_id int, compat double").withColumn("freq", F.col("entity_id") + 1).withColumn("name_freq", F.lit(20)).cache()
    mentions = scored.select("doc_id", "pos", "n").distinct().withColumn("importance", 1 / (F.col("doc_id") * 2 + 1))
    rel = spark.createDataFrame([(a, b, rng.choice([-0.5, 1e-7, 0.3, 0.8]), rng.randrange(1, 9)) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.5], "e1 int, e2 int, rel double, common int").cache()
    popular = spark.createDataFrame([(e, 3 + e) for e in range(8)], "entity_id int, popularity int")

    def near(got, want, key, *values):
        a, b = ({tuple(r[k] for k in key): [r[v] for v in values] for r in x.collect()} for x in (got, want))
        assert a.keys() == b.keys() and all(math.isclose(x, y, abs_tol=1e-9) for k in a for x, y in zip(a[k], b[k]))

    edge, node = ["doc_id", "pos1", "n1", "entity1", "pos2", "n2", "entity2"], ["doc_id", "pos", "n", "entity"]
    graph, nodes = walk.edges(scored, links.related_pairs(scored, rel.select("e1", "e2", "rel"))), walk.vertices(mentions, scored)
    made = mentions, scored, rel
    near(walk.text_edges(*made), graph, edge, "w")
    near(walk.text_steps(*made, 3), walk.steps(graph, nodes, 3), node, "p")
    near(walk.text_components(*made), walk.components(graph, nodes), ["doc_id"], "n_components")
    sums = graph.groupBy(*edge[:4]).agg(F.count("*").alias("edges"), F.sum("entity2").alias("targets"), F.sum("w").alias("sum"))
    near(walk.text_sums(*made), sums, edge[:4], "edges", "targets", "sum")
    prepared = bp.Basic().prepare(scored, rel, None, None)
    near(bp.basic_rounds(scored, rel, [2]).withColumnRenamed("score0", "score"), bp.rounds(*prepared, 2), ["doc_id", "pos", "n", "entity_id"], "score")
    near(bp.full_converged(scored, rel, popular, bp.Full()), bp.converge(*bp.Full().prepare(scored, None, rel, popular)), ["doc_id", "pos", "n", "entity_id"], "score")


def test_the_sets_of_mentions_of_a_text_are_solved_together(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from entlink.operators import thresholds
    from entlink.plans import queries

    plan = queries.sweep_threshold(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan  # pairs of candidates are no rows

    rng = np.random.default_rng(3)
    for mentions in (1, 2, 9, 30):
        mention = np.sort(np.concatenate((np.arange(mentions), rng.integers(0, mentions, 2 * mentions))))
        n = len(mention)
        total, compat = rng.integers(5, 500, mentions)[mention], np.where(rng.random(n) < 0.3, 0, rng.random(n))
        compat[mention == 0] = 0
        a, b = np.nonzero((rng.random((n, n)) < 0.3) & (mention[:, None] != mention[None, :]))
        rel = rng.choice([-0.2, 0.0, 5e-7, 5e-6, 0.3, 0.8, 1.0], len(a))
        reached = np.r_[5, rng.integers(1, 6, mentions)[1:]][mention]
        kept = reached[None, :] >= np.unique(reached)[:, None]
        ranks, scores = thresholds.walked(kept, mention, total, compat, a, b, rel), thresholds.propagated(kept, mention, compat, a, b, rel)
        for k, own in enumerate(map(np.flatnonzero, kept)):
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            m = np.unique(mention[own], return_inverse=True)[1]
            both = (at[a] >= 0) & (at[b] >= 0)
            x, y, r = at[a[both]], at[b[both]], rel[both]
            weight = np.log(detect.DOCS_IN_CORPUS / total[own][np.searchsorted(m, np.arange(m[-1] + 1))])
            every, size = np.bincount(m, compat[own])[m], np.bincount(m)[m]
            down = np.where(every > 0, compat[own] / np.where(every > 0, every, 1), 1 / size)
            s = r > walk.EPSILON
            across = r[s] / np.bincount(x[s], r[s], len(own))[x[s]]
            edges = np.r_[m + len(own), x[s]], np.r_[np.arange(len(own)), y[s]], np.r_[down, across]
            want = walk.ranks(np.r_[np.zeros(len(own)), weight / weight.sum()], *edges, tolerance=1e-10, most=200)[: len(own)]
            np.testing.assert_allclose(ranks[k, own], compat[own] * want, atol=1e-12)
            s, l = r >= bp.LEAST_RELATED, m[-1] + 1
            want = bp.solved(m, compat[own] / l, x[s], y[s], 2 * r[s] / (l * max(l - 1, 1)), 0.0)[0]
            np.testing.assert_allclose(scores[k, own], want, atol=1e-12)

    monkeypatch.setattr(thresholds.texts, "solved", lambda *x: x[3])
    rows = spark.createDataFrame([], "doc_id bigint, pos int, n int, mention string, entity_id int, freq bigint, keyphraseness double, total bigint, compat double")
    solve = thresholds.solutions(rows, rows, [k / 10 for k in range(1, 6)])
    at = {"keyphraseness": reached / 10, "entity_id": rng.integers(0, 40, n), "mention": pa.array([f"m{x % 7}" for x in mention]), "freq": rng.integers(1, 9, n), "total": total, "compat": compat}
    found = []
    for numbers in (10**9, 1):
        monkeypatch.setattr(thresholds, "_NUMBERS", numbers)
        made = solve(at, mention, a, b, rel)
        found.append(sorted(zip(*(made[c].tolist() if isinstance(made[c], np.ndarray) else made[c].to_pylist() for c in made))))
    assert found[0] == found[1] and {r[0] for r in found[0]} == {"frequent", "walk", "bp"}
