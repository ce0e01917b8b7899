"""DuckDB SQL that each registered query is checked against.

Queries share their first steps as common table expressions; ``_sql`` puts those that a query needs
in front of it.
"""

from __future__ import annotations

import re

# Fixed values, stated here once more so that a wrong one in the implementation is found.
BARE_TAGS = "big small code del math noinclude nowiki ref s sub sup tt u var".split()
ATTRIBUTE_TAGS = ["abbr", "span"]
DROP_CLASS = r" \t\n\r\f\x{2014}/*`\"'()\[\]{},\x{2018}\x{2019}\x{201c}\x{201d};?_\x{00a0}"
KEEP_CLASS = r".!:\-"
PAIRS, LINKS, ARTICLES, DOCS_IN_CORPUS = 9952525348, 133832127, 4399390, 4532295
PERCENT, CONTEXT = 0.06, 50


def _unescape(c: str) -> str:
    """Four passes over the named references that occur in the tables; within a pass the ampersand goes last, as nothing is resolved twice in it."""
    xml = [("lt", 60), ("gt", 62), ("quot", 34), ("apos", 39), ("amp", 38)]
    html = [("nbsp", 160), ("eacute", 233), ("uuml", 252), ("ndash", 8211), ("lt", 60), ("gt", 62), ("quot", 34), ("amp", 38)]
    for names in (xml, html, html, xml):
        for name, code in names:
            c = f"replace({c}, '&{name};', chr({code}))"
    return c


def _numeric(c: str) -> str:
    """Decimal references resolved, only where there are any."""
    inner = c
    for code in range(192, 384):
        inner = f"replace({inner}, '&#{code};', chr({code}))"
    return f"CASE WHEN contains({c}, '&#') THEN {inner} ELSE {c} END"


def _plain(c: str) -> str:
    c = f"regexp_replace(lower({_unescape(c)}), '<!--[^-]*-->', '', 'g')"
    for t in BARE_TAGS:
        c = f"regexp_replace({c}, '<{t}>([^<]*)</{t}>', '\\1', 'g')"
    for t in ATTRIBUTE_TAGS:
        c = f"regexp_replace({c}, '<{t}[^>]*>([^<]*)</{t}>', '\\1', 'g')"
    c = f"replace(replace({c}, '<br>', ' '), '<br />', ' ')"
    signs = DROP_CLASS.replace("'", "''")
    return f"regexp_replace({c}, '[{signs}]', ' ', 'g')"


def _normalize(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_plain(c)}, '([{KEEP_CLASS}])', ' \\1 ', 'g'), ' +', ' ', 'g'), ' ')"


def _no_delimiters(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_plain(c)}, '[{KEEP_CLASS}]', ' ', 'g'), ' +', ' ', 'g'), ' ')"


_SIGNS = (DROP_CLASS + KEEP_CLASS).replace("'", "''")
_EDGES = "'^[\\x01-\\x20]+|[\\x01-\\x20]+$'"
_TARGET = f"regexp_replace(replace(regexp_replace(regexp_replace(raw, '<!--[^-]*-->', '', 'g'), '<ref>([^<]*)</ref>', '\\1', 'g'), '_', ' '), {_EDGES}, '', 'g')"

_CTE: dict[str, str] = {
    "art": "SELECT docno, any_value(title) AS title FROM pages GROUP BY docno HAVING bool_and(is_article AND NOT is_redirect)",
    "red": "SELECT from_title, min(to_title) AS to_title FROM redirects GROUP BY from_title",
    "raw_links": "SELECT link_id, any_value(docno) AS src, any_value(anchor_text) AS anchor, any_value(normalized_target) AS t FROM page_links GROUP BY link_id",
    "raw_targets": f"SELECT link_id, src, anchor, {_unescape('t')} AS u FROM raw_links",
    "cut_targets": f"SELECT link_id, src, anchor, {_numeric('u')} AS raw FROM raw_targets",
    "lnk": f"SELECT link_id, src, {_normalize('anchor')} AS mention, upper(substr({_TARGET}, 1, 1)) || substr({_TARGET}, 2) AS c FROM cut_targets",
    "link": f"SELECT link_id, src, mention, regexp_replace(CASE WHEN contains(c, '%') THEN url_decode(replace(c, '+', ' ')) ELSE c END, {_EDGES}, '', 'g') AS target FROM lnk",
    "thru": "SELECT l.link_id, src, mention, coalesce(to_title, target) AS target FROM link l LEFT JOIN red ON target = from_title",
    "edge": "SELECT link_id, src, mention, target, id AS entity_id FROM thru JOIN titles ON target = title WHERE mention <> '' AND src IN (SELECT docno FROM art)",
    "cnt": "SELECT mention, entity_id, count(*) AS freq, CAST(sum(count(*)) OVER (PARTITION BY mention) AS BIGINT) AS name_freq FROM edge GROUP BY mention, entity_id",
    "cut": "SELECT * FROM cnt WHERE freq >= 0.02::DOUBLE * name_freq",
    "inl": "SELECT entity_id, src, count(*) AS freq FROM edge GROUP BY 1, 2",
    "outl": "SELECT src, count(*) AS out_links FROM edge GROUP BY 1",
    "doc": f"SELECT doc_id, docno, text, {_normalize('text')} AS norm, {_no_delimiters('text')} AS bare FROM documents",
    "men": "SELECT mention, len(string_split(mention, ' ')) AS k FROM (SELECT DISTINCT mention FROM edge)",
    "word": "SELECT doc_id, unnest(string_split(norm, ' ')) AS w, generate_subscripts(string_split(norm, ' '), 1) AS p FROM doc WHERE norm <> ''",
    "gram": "SELECT DISTINCT doc_id, " + "array_to_string(list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING), ' ') AS g FROM word",
    "truth": "SELECT DISTINCT doc_id, mention, entity_id FROM documents d JOIN edge e ON d.docno = e.src",
    "term": "SELECT docno, doc_id, unnest(string_split(bare, ' ')) AS term FROM doc WHERE bare <> ''",
    "df": "SELECT term, count(DISTINCT doc_id) AS df FROM term GROUP BY term",
    "vec": f"SELECT docno AS entity_id, t.term, count(*) AS tf, count(*) * CASE WHEN max(df) + 1 = {DOCS_IN_CORPUS} THEN 0 ELSE log10({DOCS_IN_CORPUS}::DOUBLE / (max(df) + 1)) END AS w FROM term t JOIN df ON t.term = df.term WHERE docno IS NOT NULL GROUP BY 1, 2",
    "vnorm": "SELECT entity_id, sqrt(sum(w * w)) AS norm FROM vec GROUP BY 1",
    "piece": f"SELECT doc_id, unnest(regexp_extract_all(text, '([^{_SIGNS}]+|[{_SIGNS}])', 1)) AS piece, generate_subscripts(regexp_extract_all(text, '([^{_SIGNS}]+|[{_SIGNS}])', 1), 1) AS p FROM documents WHERE text <> ''",
    "placed": "SELECT doc_id, piece, p, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY p) - length(piece) AS INTEGER) AS off FROM piece",
    "tok": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS pos, lower(piece) AS token, off, CAST(length(piece) AS INTEGER) AS len, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_tokens FROM placed WHERE NOT regexp_matches(piece, '^[{DROP_CLASS.replace(chr(39), chr(39) * 2)}]$')",
}

# n-grams up to the longest dictionary entry and the hyphens between its words
_MOST = 11


def _grams(source: str, columns: str, most: int) -> str:
    """All n-grams of 1..most tokens as one union; a longer n-gram extends the one before it."""
    return f"""SELECT a.doc_id, a.pos, CAST(n AS INTEGER) AS n, array_to_string(list_slice(b.ts, a.pos + 1, a.pos + n), ' ') AS ngram{columns}
    FROM {source} a JOIN arr b ON a.doc_id = b.doc_id, (SELECT unnest(range(1, {most + 1})) AS n) WHERE a.pos + n <= len(b.ts)"""


_CTE |= {
    "arr": "SELECT doc_id, list(token ORDER BY pos) AS ts, list(off ORDER BY pos) AS offs, list(len ORDER BY pos) AS lens FROM tok GROUP BY doc_id",
    "firsts": "SELECT string_split(mention, ' ')[1] AS first, least(11, max(2 * k - 1)) AS n_max FROM men GROUP BY 1",
    "tokn": "SELECT tok.*, n_max FROM tok JOIN firsts ON token = first",
    "ng": "SELECT a.doc_id, a.pos, n, n_tokens, array_to_string(list_slice(ts, a.pos + 1, a.pos + n), ' ') AS ngram, off, CAST(offs[a.pos + n] + lens[a.pos + n] - off AS INTEGER) AS len FROM (SELECT *, CAST(unnest(range(1, n_max + 1)) AS INTEGER) AS n FROM tokn) a JOIN arr b ON a.doc_id = b.doc_id WHERE a.pos + n <= len(ts)",
    "warr": "SELECT doc_id, string_split(norm, ' ') AS ws FROM doc WHERE norm <> ''",
    "wfirst": "SELECT word.doc_id, p, n_max FROM word JOIN firsts ON w = first",
    "inside": "SELECT DISTINCT a.doc_id, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS mention FROM (SELECT *, unnest(range(1, n_max + 1)) AS n FROM wfirst) a JOIN warr b ON a.doc_id = b.doc_id WHERE p + n - 1 <= len(ws) AND array_to_string(list_slice(ws, p, p + n - 1), ' ') IN (SELECT mention FROM men)",
    "mixed": "SELECT doc_id, mention, max(l) AS l FROM (SELECT doc_id, mention, 0 AS l FROM inside UNION ALL SELECT doc_id, mention, 1 FROM truth) GROUP BY 1, 2",
    "kp": "SELECT mention, CAST(sum(l) AS BIGINT) AS linked, count(*) AS total FROM mixed GROUP BY mention",
    "dict": "SELECT kp.mention, linked, total, name_freq, entity_id, freq FROM kp JOIN cut ON kp.mention = cut.mention WHERE total >= 5 AND linked <> 0",
    "ent": "SELECT mention, any_value(linked) AS linked, any_value(total) AS total, any_value(name_freq) AS name_freq, count(*) AS n_candidates FROM dict GROUP BY mention",
    "hit": "SELECT doc_id, pos, n, n_tokens, off, len, coalesce(e.mention, f.mention) AS mention FROM ng LEFT JOIN ent e ON ngram = e.mention LEFT JOIN ent f ON contains(ngram, ' - ') AND replace(ngram, ' - ', ' ') = f.mention AND e.mention IS NULL",
    "spot": "SELECT doc_id, pos, n, n_tokens, off, len, h.mention, linked, total, n_candidates, linked / total::DOUBLE AS kp FROM hit h JOIN ent ON h.mention = ent.mention",
    "ranked": f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kp DESC, off DESC, mention DESC, n DESC) AS INTEGER) AS rank FROM spot",
    "ment": f"SELECT *, ln({DOCS_IN_CORPUS}::DOUBLE / total) / sum(ln({DOCS_IN_CORPUS}::DOUBLE / total)) OVER (PARTITION BY doc_id) AS importance FROM ranked WHERE rank <= greatest(floor(n_tokens * {PERCENT}::DOUBLE), 1)",
    "place": f"SELECT DISTINCT doc_id, pos, n_tokens, CASE WHEN pos < {CONTEXT // 2} THEN 0 WHEN pos + {CONTEXT // 2} >= n_tokens THEN greatest(0, n_tokens - {CONTEXT}) ELSE pos - {CONTEXT // 2} END AS b FROM ment",
    "ctx": f"SELECT p.doc_id, p.pos, t.token AS term, count(*) AS tf FROM place p JOIN tok t ON p.doc_id = t.doc_id AND t.pos >= b AND t.pos < least(p.n_tokens, b + {CONTEXT}) GROUP BY 1, 2, 3",
    "cw": f"SELECT doc_id, pos, ctx.term, tf, tf * CASE WHEN coalesce(df, 0) + 1 = {DOCS_IN_CORPUS} THEN 0 ELSE log10({DOCS_IN_CORPUS}::DOUBLE / (coalesce(df, 0) + 1)) END AS w FROM ctx LEFT JOIN df ON ctx.term = df.term",
    "cnorm": "SELECT doc_id, pos, sqrt(sum(w * w)) AS norm FROM cw GROUP BY 1, 2",
    "cand": "SELECT doc_id, pos, n, m.mention, entity_id, freq, d.name_freq FROM ment m JOIN dict d ON m.mention = d.mention",
    "dots": "SELECT c.doc_id, c.pos, c.entity_id, sum(cw.w * vec.w) / (any_value(cnorm.norm) * any_value(vnorm.norm)) AS x FROM (SELECT DISTINCT doc_id, pos, entity_id FROM cand) c JOIN vnorm ON c.entity_id = vnorm.entity_id AND vnorm.norm > 0 JOIN cnorm ON c.doc_id = cnorm.doc_id AND c.pos = cnorm.pos AND cnorm.norm > 0 JOIN cw ON c.doc_id = cw.doc_id AND c.pos = cw.pos JOIN vec ON c.entity_id = vec.entity_id AND cw.term = vec.term GROUP BY 1, 2, 3",
    "scored": "SELECT c.*, round(coalesce(x, 0), 9) AS compat FROM cand c LEFT JOIN dots ON c.doc_id = dots.doc_id AND c.pos = dots.pos AND c.entity_id = dots.entity_id",
    "freqsol": "SELECT DISTINCT doc_id, mention, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, n ORDER BY freq DESC, entity_id) AS r FROM cand) WHERE r = 1",
    "pop": "SELECT entity_id, count(*) + 1 AS popularity, CAST(sum(freq) + 1 AS BIGINT) AS popularity_freq FROM inl GROUP BY 1",
    "coc": "SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS common, CAST(sum(a.freq * b.freq) AS BIGINT) AS weighted FROM inl a JOIN inl b ON a.src = b.src AND a.entity_id < b.entity_id GROUP BY 1, 2",
    "rel": f"SELECT e1, e2, common, 1 - (ln(greatest(a.popularity, b.popularity) - 1) - ln(common)) / (ln({ARTICLES}.0::DOUBLE) - ln(least(a.popularity, b.popularity) - 1)) AS rel FROM coc JOIN pop a ON e1 = a.entity_id JOIN pop b ON e2 = b.entity_id",
    "own": "SELECT DISTINCT doc_id, entity_id FROM scored",
    "epair": "SELECT a.doc_id, e1, e2, common, rel FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id JOIN rel ON e1 = a.entity_id AND e2 = b.entity_id",
    "bpair": "SELECT doc_id, e1, e2, common, rel FROM epair UNION ALL SELECT doc_id, e2, e1, common, rel FROM epair UNION ALL SELECT doc_id, entity_id, entity_id, NULL, 1.0::DOUBLE FROM own",
    "rpair": "SELECT p.doc_id, a.pos AS pos1, a.n AS n1, e1 AS entity1, b.pos AS pos2, b.n AS n2, e2 AS entity2, common, rel FROM bpair p JOIN scored a ON p.doc_id = a.doc_id AND e1 = a.entity_id JOIN scored b ON p.doc_id = b.doc_id AND e2 = b.entity_id WHERE a.pos <> b.pos OR a.n <> b.n",
    "down": "SELECT doc_id, pos AS pos1, n AS n1, -1 AS entity1, pos AS pos2, n AS n2, entity_id AS entity2, CASE WHEN s > 0 THEN compat / s ELSE 1.0::DOUBLE / k END AS w FROM (SELECT *, sum(compat) OVER (PARTITION BY doc_id, pos, n) AS s, count(*) OVER (PARTITION BY doc_id, pos, n) AS k FROM scored)",
    "graph": "SELECT * FROM down UNION ALL SELECT doc_id, pos1, n1, entity1, pos2, n2, entity2, rel / sum(rel) OVER (PARTITION BY doc_id, pos1, n1, entity1) FROM rpair WHERE rel > 1e-5",
    "node": "SELECT doc_id, pos, n, -1 AS entity, importance AS prior FROM ment UNION ALL SELECT doc_id, pos, n, entity_id, 0 FROM scored",
    "step0": "SELECT *, prior AS p FROM node",
    "lsize": "SELECT doc_id, count(*) AS l FROM (SELECT DISTINCT doc_id, pos, n FROM scored) GROUP BY 1",
    "ann0": "SELECT link_id, any_value(docno) AS docno, any_value(anchor_text) AS a, any_value(canonical_target) AS c FROM page_links GROUP BY link_id",
    "ann1": "SELECT docno, lower(trim(a, ' ')) AS mention, coalesce(id, -1) AS entity_id, min(link_id) AS place FROM ann0 LEFT JOIN titles ON c = title WHERE trim(a, ' ') <> '' GROUP BY 1, 2, 3",
    "ann": "SELECT doc_id, mention, entity_id, CAST(instr(lower(text), mention) - 1 AS INTEGER) AS off, CAST(length(mention) AS INTEGER) AS len, place FROM documents d JOIN ann1 ON d.docno = ann1.docno WHERE instr(lower(text), mention) > 0",
    "outc": "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.mention, b.mention) AS mention, coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'good' WHEN a.doc_id IS NOT NULL THEN 'fp' ELSE 'fn' END AS outcome FROM freqsol a FULL JOIN truth b ON a.doc_id = b.doc_id AND a.mention = b.mention AND a.entity_id = b.entity_id",
    "perdoc": "SELECT doc_id, count(*) FILTER (outcome = 'good') AS good, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM outc WHERE doc_id IN (SELECT doc_id FROM truth) GROUP BY doc_id",
    "prf": "SELECT *, CASE WHEN good + fp > 0 THEN good / (good + fp)::DOUBLE ELSE 1 END AS precision, CASE WHEN good + fn > 0 THEN good / (good + fn)::DOUBLE ELSE 1 END AS recall FROM perdoc",
    "found": "SELECT DISTINCT doc_id, mention, entity_id FROM cand",
    "tokc": "SELECT doc_id, pos, off, len, length(token) AS size, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM tok",
    "walked": "SELECT s.doc_id, s.pos, s.n, s.entity_id, round(compat * p, 9) AS score FROM scored s JOIN step3 w ON s.doc_id = w.doc_id AND s.pos = w.pos AND s.n = w.n AND s.entity_id = w.entity",
    "basicsol": "SELECT DISTINCT doc_id, mention, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, n ORDER BY round(score, 6) DESC, entity_id) AS r FROM basic_f2) WHERE r = 1",
    "lost": "SELECT DISTINCT a.doc_id, a.mention FROM outc a JOIN outc b ON a.doc_id = b.doc_id AND a.mention = b.mention WHERE a.outcome = 'fp' AND b.outcome = 'fn'",
    "names": "SELECT DISTINCT doc_id, mention FROM truth",
    "bestkp": "SELECT doc_id, s.mention, entity_id, max(kp) AS kp FROM spot s JOIN dict d ON s.mention = d.mention GROUP BY 1, 2, 3",
    "thr": "SELECT unnest([" + ", ".join(["0.00005", "0.0001", "0.0005", *(f"0.{k:03d}" for k in range(1, 10)), *(f"{k // 100}.{k % 100:02d}" for k in range(1, 101))]) + "]::DOUBLE[]) AS threshold",
    "hits": "SELECT threshold, b.doc_id, b.mention, t.doc_id IS NOT NULL AS ok FROM bestkp b JOIN thr ON kp >= threshold LEFT JOIN truth t ON b.doc_id = t.doc_id AND b.mention = t.mention AND b.entity_id = t.entity_id",
    "hitdoc": "SELECT threshold, doc_id, sum(good) AS good, count(*) FILTER (good = 0) AS wrong FROM (SELECT threshold, doc_id, mention, count(*) FILTER (ok) AS good FROM hits GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "ntruth": "SELECT doc_id, count(*) AS n_truth FROM truth GROUP BY 1",
    "swept": "SELECT g.threshold, n_truth, coalesce(good, 0) AS good, coalesce(wrong, 0) AS wrong FROM (SELECT DISTINCT threshold FROM hits) g CROSS JOIN ntruth t LEFT JOIN hitdoc h ON g.threshold = h.threshold AND t.doc_id = h.doc_id",
}
_CTE["outc2"] = _CTE["outc"].replace("freqsol", "basicsol")
del _CTE["gram"]

for _k in range(1, 4):
    _b = f"step{_k - 1}"
    _CTE[f"flow{_k}"] = f"SELECT g.doc_id, pos2 AS pos, n2 AS n, entity2 AS entity, sum(w * p) AS come FROM graph g JOIN {_b} s ON g.doc_id = s.doc_id AND pos1 = s.pos AND n1 = s.n AND entity1 = s.entity GROUP BY 1, 2, 3, 4"
    _CTE[f"hang{_k}"] = f"SELECT doc_id, p - coalesce(c, 0) AS h FROM (SELECT doc_id, sum(p) AS p FROM {_b} GROUP BY 1) JOIN (SELECT doc_id AS d2, sum(come) AS c FROM flow{_k} GROUP BY 1) ON doc_id = d2"
    _CTE[f"step{_k}"] = f"SELECT s.doc_id, s.pos, s.n, s.entity, prior, 0.1::DOUBLE * prior + 0.9::DOUBLE * (coalesce(come, 0) + h * prior) AS p FROM {_b} s JOIN hang{_k} h ON s.doc_id = h.doc_id LEFT JOIN flow{_k} f ON s.doc_id = f.doc_id AND s.pos = f.pos AND s.n = f.n AND s.entity = f.entity"

_CTE["cocited"] = """SELECT p.*, l, coalesce(x.popularity, 1) AS p1, coalesce(y.popularity, 1) AS p2, coalesce(common, x.popularity, 1) AS c
FROM rpair p JOIN lsize ON p.doc_id = lsize.doc_id LEFT JOIN pop x ON entity1 = x.entity_id LEFT JOIN pop y ON entity2 = y.entity_id"""
_CHANCE = f"(ln({PAIRS}::DOUBLE) - 2 * ln({LINKS}::DOUBLE))"
_SCORERS = {
    "basic": ("SELECT s.*, compat / l AS loc, 0 AS absent FROM scored s JOIN lsize ON s.doc_id = lsize.doc_id", "SELECT r.*, 2 * rel / (l * (l - 1)) AS pr FROM rpair r JOIN lsize ON r.doc_id = lsize.doc_id WHERE rel >= 1e-6"),
    "full": (
        f"SELECT s.*, ln(freq / name_freq::DOUBLE) / l AS loc, 2 * {_CHANCE} / (l * greatest(l - 1, 1)) AS absent FROM scored s JOIN lsize ON s.doc_id = lsize.doc_id",
        f"SELECT *, 2 * CASE WHEN c <= 0 OR c / p1::DOUBLE / p2 <= {PAIRS / LINKS / LINKS!r}::DOUBLE THEN {_CHANCE} ELSE ln(c) - ln(p1) - ln(p2) END / (l * (l - 1)) AS pr FROM cocited",
    ),
    "maxent": (
        f"SELECT s.*, ln(coalesce(popularity, 1)) AS loc, -ln({ARTICLES}::DOUBLE) AS absent FROM scored s LEFT JOIN pop ON s.entity_id = pop.entity_id",
        f"SELECT *, CASE WHEN c <= p1 * p2 // {ARTICLES} THEN -ln({ARTICLES}::DOUBLE) ELSE ln(c) - ln(p1) - ln(p2) END AS pr FROM cocited",
    ),
}
_CTE["side"] = "SELECT DISTINCT doc_id, pos, n FROM scored"
for _name, (_loc, _pr) in _SCORERS.items():
    _CTE[f"{_name}_loc"], _CTE[f"{_name}_pr"] = _loc, _pr
    _CTE[f"{_name}_b1"] = f"SELECT s.doc_id, s.pos AS pos1, s.n AS n1, s.entity_id AS entity1, o.pos AS pos2, o.n AS n2, loc, absent, loc AS base FROM {_name}_loc s JOIN side o ON s.doc_id = o.doc_id AND (s.pos <> o.pos OR s.n <> o.n)"
    _CTE[f"{_name}_b2"] = (
        f"SELECT t.doc_id, t.pos1, t.n1, t.entity1, t.pos2, t.n2, loc, absent, loc + h.s - b.v AS base FROM {_name}_b1 t"
        f" JOIN (SELECT doc_id, pos2, n2, entity2, sum(v) AS s FROM {_name}_m1 GROUP BY 1, 2, 3, 4) h ON t.doc_id = h.doc_id AND t.pos1 = h.pos2 AND t.n1 = h.n2 AND t.entity1 = h.entity2"
        f" JOIN {_name}_m1 b ON t.doc_id = b.doc_id AND b.pos1 = t.pos2 AND b.n1 = t.n2 AND b.pos2 = t.pos1 AND b.n2 = t.n1 AND b.entity2 = t.entity1"
    )
    for _k in (1, 2):
        _CTE[f"{_name}_a{_k}"] = f"SELECT x.doc_id, pos1, n1, pos2, n2, s.entity_id AS entity2, v FROM (SELECT doc_id, pos1, n1, pos2, n2, max(base + absent) AS v FROM {_name}_b{_k} GROUP BY 1, 2, 3, 4, 5) x JOIN scored s ON x.doc_id = s.doc_id AND pos2 = s.pos AND n2 = s.n"
        _CTE[f"{_name}_k{_k}"] = f"SELECT b.doc_id, b.pos1, b.n1, b.pos2, b.n2, p.entity2, max(base + pr) AS w FROM {_name}_b{_k} b JOIN {_name}_pr p ON b.doc_id = p.doc_id AND b.pos1 = p.pos1 AND b.n1 = p.n1 AND b.entity1 = p.entity1 AND b.pos2 = p.pos2 AND b.n2 = p.n2 GROUP BY 1, 2, 3, 4, 5, 6"
        _CTE[f"{_name}_m{_k}"] = f"SELECT doc_id, pos1, n1, pos2, n2, entity2, v - min(v) OVER (PARTITION BY doc_id, pos1, n1, pos2, n2) AS v FROM (SELECT a.doc_id, a.pos1, a.n1, a.pos2, a.n2, a.entity2, greatest(v, coalesce(w, v)) AS v FROM {_name}_a{_k} a LEFT JOIN {_name}_k{_k} k ON a.doc_id = k.doc_id AND a.pos1 = k.pos1 AND a.n1 = k.n1 AND a.pos2 = k.pos2 AND a.n2 = k.n2 AND a.entity2 = k.entity2)"
        _CTE[f"{_name}_f{_k}"] = f"SELECT s.doc_id, pos, n, mention, entity_id, coalesce(h.s, 0) + loc AS score FROM {_name}_loc s LEFT JOIN (SELECT doc_id, pos2, n2, entity2, sum(v) AS s FROM {_name}_m{_k} GROUP BY 1, 2, 3, 4) h ON s.doc_id = h.doc_id AND pos = pos2 AND n = n2 AND entity_id = entity2"


def _sql(final: str) -> str:
    """``final`` with the common table expressions that it needs, each computed once."""
    need: list[str] = []

    def visit(text: str, done: tuple[str, ...] = ()) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN|IN \(SELECT \w+ FROM)\s+(\w+)", text)):
            if word in _CTE and word not in need and word not in done:
                visit(_CTE[word], (*done, word))
                need.append(word)

    visit(final)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n]})" for n in need) + "\n" if need else "") + final


_FREQ = """
WITH rec AS (SELECT record_id, any_value(entity_id) AS entity_id, any_value(total_freq) AS total_freq, any_value(links) AS links FROM entity_links GROUP BY record_id),
flat AS (SELECT entity_id, unnest(links) AS l FROM rec WHERE entity_id IS NOT NULL),
freq AS (SELECT entity_id, l.src AS src, CAST(coalesce(sum(l.freq), 0) AS BIGINT) AS freq FROM flat WHERE l.src IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY freq DESC, src) AS r FROM freq)
"""
_KEY = "trim(regexp_replace(lower(m), '[ \\t\\x{00A0}]+', ' ', 'g'), ' ')"
_STATUS = "CASE WHEN a.entity_id = -1 THEN -3 WHEN s.mention IS NULL THEN -1 WHEN d.mention IS NOT NULL THEN 1 ELSE -2 END"
_RATIO = "CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE ELSE 1 END"

_FINAL = {
    "titles_index": "SELECT docno, title FROM art WHERE title IS NOT NULL AND NOT starts_with(title, 'List of ') AND NOT starts_with(title, 'list of') AND NOT contains(title, '(disambiguation)') AND NOT contains(title, ':')",
    "title_lookup": "SELECT DISTINCT entity_id, title FROM entity_links LEFT JOIN titles ON entity_id = id WHERE entity_id IS NOT NULL",
    "redirect_map": "SELECT from_title, to_title FROM red",
    "redirect_resolve": "SELECT coalesce(id, -1) AS entity_id, count(*) AS n FROM thru LEFT JOIN titles ON target = title GROUP BY 1",
    "links_extracted": "SELECT link_id, src, mention, entity_id FROM edge",
    "normalized_anchor": "SELECT mention, count(*) AS n FROM link GROUP BY 1",
    "normalized_target": "SELECT target, count(*) AS n FROM link GROUP BY 1",
    "normalize_no_delims": "SELECT doc_id, CAST(length(bare) AS INTEGER) AS length, CAST(len(string_split(bare, ' ')) AS INTEGER) AS words, substr(bare, 1, 40) AS start FROM doc",
    "normalize_no_delims_text": "SELECT doc_id, bare AS normalized FROM doc",
    "mention_all_candidates": "SELECT mention, array_to_string(list(DISTINCT entity_id ORDER BY entity_id), ',') AS candidates FROM edge GROUP BY mention",
    "mention_top_candidates": "SELECT mention, array_to_string(list(entity_id ORDER BY freq DESC, entity_id), ',') AS candidates FROM cut GROUP BY mention",
    "mention_top_candidates_10": "SELECT mention, entity_id, freq, name_freq FROM cnt WHERE freq >= 0.1::DOUBLE * name_freq",
    "mention_candidate_freq": "SELECT mention, entity_id, freq, name_freq FROM cut",
    "mention_debug_pairs": "SELECT mention, array_to_string(list(DISTINCT target || '+' || title ORDER BY target || '+' || title), '|') AS pairs FROM link JOIN art ON src = docno WHERE mention <> '' AND target IS NOT NULL AND title IS NOT NULL GROUP BY mention",
    "entity_inlinks": "SELECT entity_id, array_to_string(list(src ORDER BY src), ',') AS srcs FROM inl GROUP BY 1",
    "entity_links_freq": "SELECT entity_id, CAST(sum(freq) AS BIGINT) AS total_freq, coalesce(any_value(out_links), 0) AS out_links, array_to_string(list(inl.src || ':' || freq ORDER BY inl.src), ',') AS links FROM inl LEFT JOIN outl ON entity_id = outl.src GROUP BY 1",
    "link_counters": "SELECT CAST(sum(out_links * (out_links - 1) // 2) AS BIGINT) AS pairs_total, CAST(sum(out_links) AS BIGINT) AS links_total FROM outl",
    "keyphraseness": "SELECT mention, linked, total FROM kp",
    "mention_dictionary": "SELECT mention, linked, total, name_freq, entity_id, freq FROM dict",
    "batch_keyphraseness": f"""WITH k AS (SELECT {_KEY} AS mention, CAST(coalesce(sum(linked), 0) AS BIGINT) AS linked, CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM (SELECT record_id, any_value(mention) AS m, any_value(linked) AS linked, any_value(total) AS total FROM keyphraseness GROUP BY 1) WHERE m IS NOT NULL GROUP BY 1),
        c AS (SELECT {_KEY} AS mention, CAST(coalesce(sum(f), 0) AS BIGINT) AS name_freq FROM (SELECT entry_id, any_value(mention) AS m, any_value(name_freq) AS f FROM mention_candidates GROUP BY 1) WHERE m IS NOT NULL GROUP BY 1)
        SELECT k.mention, linked, total, name_freq FROM k JOIN c ON k.mention = c.mention WHERE total >= 5 AND linked <> 0""",
    "term_df": "SELECT term, df FROM df",
    "entity_tfidf": "SELECT entity_id, term, tf, round(w, 6) AS w FROM vec",
    "entity_norms": "SELECT entity_id, round(norm, 6) AS norm FROM vnorm",
    "tfidf_lookup": "SELECT term, round(w, 6) AS w FROM vec WHERE entity_id = 1",
    "tokens_offsets": "SELECT doc_id, count(*) AS n, CAST(sum(off) AS BIGINT) AS sum_off, CAST(sum(len) AS BIGINT) AS sum_len, count(DISTINCT token) AS n_distinct, max_by(token, pos) AS last_token FROM tok GROUP BY doc_id",
    "ngrams_1_11": "SELECT CAST(k AS INTEGER) AS n, count(*) AS n_grams, CAST(sum(a.off) AS BIGINT) AS sum_off, CAST(sum(b.off + b.len - a.off) AS BIGINT) AS sum_len, CAST(sum(b.upto - a.upto + a.size + k - 1) AS BIGINT) AS sum_text FROM (SELECT *, unnest(range(1, 12)) AS k FROM tokc) a JOIN tokc b ON a.doc_id = b.doc_id AND b.pos = a.pos + k - 1 GROUP BY k",
    "ngrams_dehyphen": "SELECT doc_id, pos, n, ngram, f.mention FROM ng LEFT JOIN ent e ON ngram = e.mention JOIN ent f ON contains(ngram, ' - ') AND replace(ngram, ' - ', ' ') = f.mention WHERE e.mention IS NULL",
    "context_window": f"SELECT p.doc_id, p.pos, string_agg(t.token, ' ' ORDER BY t.pos) AS context FROM place p JOIN tok t ON p.doc_id = t.doc_id AND t.pos >= b AND t.pos < least(p.n_tokens, b + {CONTEXT}) GROUP BY 1, 2",
    "walk_top_candidates": "SELECT doc_id, pos, n, entity_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, pos, n ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM walked) WHERE rank <= 10",
    "eval_diff_runs": "SELECT l.doc_id, l.mention, outcome AS outcome2 FROM lost l LEFT JOIN (SELECT DISTINCT doc_id, mention, outcome FROM outc2) o ON l.doc_id = o.doc_id AND l.mention = o.mention",
    "annotation_first": "SELECT doc_id, off, len, min_by(mention, place) AS mention, min_by(entity_id, place) AS entity_id FROM ann GROUP BY 1, 2, 3",
    "annotation_names": f"SELECT DISTINCT doc_id, {_normalize('x')} AS name, entity_id FROM (SELECT a.doc_id, entity_id, substr(text, off + 1, len) AS x FROM ann a JOIN documents d ON a.doc_id = d.doc_id)",
    "annotations_xml": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS filename, name, off, len FROM (SELECT *, trim(regexp_replace(mention, '[\\x00-\\x1f\\x7f]', ' ', 'g'), ' ') AS name FROM ann) WHERE name <> ''",
    "annotations_offset_fix": "SELECT doc_id, pos, n, CAST(instr(text, context) - 1 + instr(context, name) - 1 AS INTEGER) AS off FROM (SELECT m.doc_id, pos, n, text, substr(text, off + 1, len) AS name, substr(text, greatest(off - 50, 0) + 1, off + len + 50 - greatest(off - 50, 0)) AS context FROM ment m JOIN documents d ON m.doc_id = d.doc_id)",
    "sweep_detection": "SELECT threshold, round(avg(CASE WHEN good + wrong > 0 THEN good / (good + wrong)::DOUBLE ELSE 1 END), 6) AS precision, round(avg(good / n_truth::DOUBLE), 6) AS recall, CAST(sum(good) AS BIGINT) AS good FROM swept GROUP BY 1",
    "false_positives_ranked": "SELECT s.doc_id, pos, n, s.mention, round(kp, 9) AS keyphraseness, row_number() OVER (ORDER BY round(kp, 9) DESC, s.doc_id, pos, n) AS rank FROM spot s LEFT JOIN names t ON s.doc_id = t.doc_id AND s.mention = t.mention WHERE t.mention IS NULL",
    "truth_low_keyphraseness": "SELECT doc_id, t.mention, entity_id, round(linked / total::DOUBLE, 9) AS keyphraseness, row_number() OVER (ORDER BY round(linked / total::DOUBLE, 9), doc_id, t.mention, entity_id) AS rank FROM truth t JOIN ent ON t.mention = ent.mention",
    "dictionary_spots": "SELECT doc_id, pos, n, mention, off, len, linked, total, n_candidates, round(kp, 6) AS keyphraseness FROM spot",
    "mentions_topk": "SELECT doc_id, pos, n, mention, off, len, rank FROM ment",
    "mentions_threshold": "SELECT doc_id, pos, n, mention FROM spot WHERE kp >= 0.1::DOUBLE",
    "mentions_cap_candidates": "SELECT doc_id, pos, n, mention FROM spot WHERE n_candidates <= 5",
    "mention_context_text": "SELECT m.doc_id, pos, n, substr(text, off + 1, len) AS original, substr(text, greatest(off - 50, 0) + 1, off + len + 50 - greatest(off - 50, 0)) AS context FROM ment m JOIN documents d ON m.doc_id = d.doc_id",
    "context_tfidf": "SELECT doc_id, pos, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, round(sqrt(sum(w * w)), 6) AS norm FROM cw GROUP BY 1, 2",
    "local_compat": "SELECT doc_id, pos, n, mention, entity_id, round(compat, 6) AS compat FROM scored",
    "compatible_mentions": "SELECT doc_id, pos, n, entity_id FROM (SELECT *, sum(compat) OVER (PARTITION BY doc_id, pos, n) AS s FROM scored) WHERE s > 0",
    "mention_importance": "SELECT doc_id, pos, n, round(importance, 6) AS importance FROM ment",
    "prior_probability": "SELECT mention, entity_id, round(freq / name_freq::DOUBLE, 6) AS p FROM dict",
    "link_most_frequent": "SELECT doc_id, pos, n, mention, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, n ORDER BY freq DESC, entity_id) AS r FROM cand) WHERE r = 1",
    "popularity": "SELECT entity_id, popularity, popularity_freq FROM pop",
    "cocitation": "SELECT e1, e2, common FROM coc",
    "cocitation_weighted": "SELECT e1, e2, weighted FROM coc",
    "self_cocitation": "SELECT entity_id, CAST(sum(freq * (freq - 1) // 2) AS BIGINT) AS self_cocitation FROM inl GROUP BY 1",
    "conditional_denominator": "SELECT entity_id, CAST(sum(freq * (out_links - freq) + freq * (freq - 1) // 2) AS BIGINT) AS denominator FROM inl JOIN outl ON inl.src = outl.src GROUP BY 1",
    "relatedness_pairs": "SELECT e1, e2, common, round(rel, 6) AS rel FROM rel",
    "referent_edges": "SELECT doc_id, pos1, n1, entity1, count(*) AS edges, round(max(w), 6) AS heaviest, round(sum(w * w), 6) AS squares, CAST(sum(entity2) AS BIGINT) AS targets FROM graph GROUP BY 1, 2, 3, 4",
    "referent_edge_rows": "SELECT doc_id, pos1, n1, entity1, pos2, n2, entity2, round(w, 6) AS w FROM graph",
    "referent_validate": "SELECT CAST(0 AS BIGINT) AS violations, count(*) AS edges FROM graph",
    "walk_k_steps": "SELECT doc_id, pos, n, entity, round(p, 6) AS p FROM step3",
    "bp_basic_k": "SELECT doc_id, pos, n, entity_id, round(score, 6) + 0 AS score FROM basic_f2",
    "bp_full_k": "SELECT doc_id, pos, n, entity_id, round(score, 6) + 0 AS score FROM full_f2",
    "bp_maxent_k": "SELECT doc_id, pos, n, entity_id, round(score, 6) + 0 AS score FROM maxent_f2",
    "bp_delta": "SELECT a.doc_id, round(max(abs(a.score - b.score)), 6) AS delta FROM basic_f2 a JOIN basic_f1 b ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.n = b.n AND a.entity_id = b.entity_id GROUP BY 1",
    "eval_prf_per_doc": "SELECT doc_id, good, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM prf",
    "eval_outcomes": "SELECT doc_id, mention, entity_id, title, outcome FROM outc LEFT JOIN titles ON entity_id = id",
    "eval_macro_micro": "SELECT round(mp, 6) AS macro_p, round(mr, 6) AS macro_r, round(p, 6) AS micro_p, round(r, 6) AS micro_r, round((mp + mr) / 2, 6) AS mean_pr, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, good, fp, fn"
    " FROM (SELECT avg(precision) AS mp, avg(recall) AS mr, sum(good) / sum(good + fp)::DOUBLE AS p, sum(good) / sum(good + fn)::DOUBLE AS r, CAST(sum(good) AS BIGINT) AS good, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM prf)",
    "eval_missing": "SELECT n_truth, n_missing, round(1 - n_missing / n_truth::DOUBLE, 6) AS max_recall FROM (SELECT count(*) AS n_truth FROM (SELECT DISTINCT doc_id, mention FROM truth)), (SELECT count(*) AS n_missing FROM (SELECT DISTINCT doc_id, t.mention FROM truth t LEFT JOIN dict d ON t.mention = d.mention AND t.entity_id = d.entity_id WHERE d.mention IS NULL))",
    "truth_mentions": "SELECT doc_id, t.mention, t.entity_id, n_candidates FROM truth t JOIN dict d ON t.mention = d.mention AND t.entity_id = d.entity_id JOIN ent e ON t.mention = e.mention",
    "eval_md": "SELECT doc_id, good, wrong, n_truth, round("
    + _RATIO.format(a="good", b="good + wrong")
    + ", 6) AS precision, round(good / n_truth::DOUBLE, 6) AS recall FROM (SELECT t.doc_id, n_truth, coalesce(good, 0) AS good, coalesce(wrong, 0) AS wrong FROM (SELECT doc_id, count(*) AS n_truth FROM truth GROUP BY 1) t"
    " LEFT JOIN (SELECT t.doc_id, count(*) AS good FROM truth t JOIN found f ON t.doc_id = f.doc_id AND t.mention = f.mention AND t.entity_id = f.entity_id GROUP BY 1) g ON t.doc_id = g.doc_id"
    " LEFT JOIN (SELECT doc_id, count(*) AS wrong FROM (SELECT f.doc_id, f.mention, bool_or(t.doc_id IS NOT NULL) AS ok FROM found f LEFT JOIN truth t ON t.doc_id = f.doc_id AND t.mention = f.mention AND t.entity_id = f.entity_id GROUP BY 1, 2) WHERE NOT ok GROUP BY 1) w ON t.doc_id = w.doc_id)",
    "annotation_status": f"SELECT a.doc_id, a.mention, a.entity_id, a.off, a.len, CAST({_STATUS} AS INTEGER) AS status FROM ann a LEFT JOIN spot s ON a.doc_id = s.doc_id AND a.off = s.off AND a.len = s.len LEFT JOIN dict d ON s.mention = d.mention AND a.entity_id = d.entity_id",
    "annotation_dupes": "SELECT doc_id, off, len, count(*) AS n FROM ann GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "annotation_ngrams": "SELECT DISTINCT doc_id, off, len FROM ann a WHERE NOT EXISTS (SELECT 1 FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND y.pos >= x.pos AND y.pos <= x.pos + 10 WHERE x.doc_id = a.doc_id AND x.off = a.off AND y.off + y.len = a.off + a.len)",
    "missed_by_keyphraseness": "SELECT s.doc_id, pos, n, s.mention, round(kp, 6) AS keyphraseness FROM spot s LEFT JOIN (SELECT DISTINCT doc_id, mention FROM truth) t ON s.doc_id = t.doc_id AND s.mention = t.mention WHERE t.mention IS NULL ORDER BY round(kp, 9) DESC, s.doc_id, pos, n LIMIT 100",
    "candidates_text_round_trip": "SELECT mention, name_freq, entity_id, freq FROM cut",
    "links_text_round_trip": "SELECT entity_id, CAST(sum(freq) OVER (PARTITION BY entity_id) AS BIGINT) AS total_freq, coalesce(out_links, 0) AS out_links, inl.src, freq FROM inl LEFT JOIN outl ON entity_id = outl.src",
    "keyphraseness_pairs_parse": "SELECT mention, CAST(linked AS INTEGER) AS linked, CAST(total AS INTEGER) AS total FROM kp",
    "scored_mentions_parse": "SELECT mention, CAST(trunc(round(linked / total::DOUBLE, 8) * 100000) AS INTEGER) AS linked, 100000 AS total FROM kp",
}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    out = {name: final if final.lstrip().startswith("WITH") else _sql(final) for name, final in _FINAL.items()}
    return out | {
        "p6_found": _FREQ + "SELECT entity_id, src FROM ranked WHERE r = 1",
        "p6_entities": _FREQ
        + """, tot AS (SELECT entity_id, CAST(coalesce(sum(total_freq), 0) AS BIGINT) AS total_freq FROM rec WHERE entity_id IS NOT NULL GROUP BY 1),
        pages AS (SELECT entity_id, count(*) AS n FROM freq GROUP BY 1)
        SELECT tot.entity_id, tot.total_freq, coalesce(n, 0) AS n_pages, src AS top_src, freq AS top_freq
        FROM tot LEFT JOIN pages ON tot.entity_id = pages.entity_id LEFT JOIN ranked ON ranked.entity_id = tot.entity_id AND r = 1""",
        "p6_quantiles": _FREQ
        + """, pos AS (SELECT entity_id, freq, row_number() OVER (PARTITION BY entity_id ORDER BY freq) AS rank, count(*) OVER (PARTITION BY entity_id) AS n FROM freq)
        SELECT entity_id, rank, freq FROM pos WHERE rank IN (greatest((n + 3) // 4, 1), greatest((n + 1) // 2, 1), greatest((3 * n + 3) // 4, 1))""",
    }
