"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

KEY = "trim(regexp_replace(lower(mention), '[ \\t\\x{00A0}]+', ' ', 'g'), ' ')"

_PAIRS = """
WITH rec AS (SELECT record_id, any_value(links) AS links FROM entity_links GROUP BY record_id),
item AS (SELECT DISTINCT record_id, l.src AS src FROM (SELECT record_id, unnest(links) AS l FROM rec) WHERE l.src IS NOT NULL),
tot AS (SELECT count(DISTINCT record_id) AS n FROM item),
one AS (SELECT src, count(*) AS c FROM item GROUP BY src),
two AS (SELECT a.src AS src_a, b.src AS src_b, count(*) AS n_ab FROM item a JOIN item b ON a.record_id = b.record_id AND a.src < b.src GROUP BY 1, 2),
res AS (SELECT src_a, src_b, n_ab, x.c AS n_a, y.c AS n_b, n AS n_records FROM two JOIN one x ON src_a = x.src JOIN one y ON src_b = y.src CROSS JOIN tot)
"""

_SUMS = f"""
WITH ent AS (SELECT entry_id, any_value(mention) AS mention, any_value(name_freq) AS name_freq, any_value(top_candidates) AS c FROM mention_candidates GROUP BY entry_id),
flat AS (SELECT mention, unnest(map_keys(c)) AS entity_id, unnest(map_values(c)) AS freq FROM ent),
summed AS (SELECT {KEY} AS mention, entity_id, CAST(coalesce(sum(freq), 0) AS BIGINT) AS freq FROM flat WHERE mention IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY freq DESC, entity_id) AS INTEGER) AS rank FROM summed)
"""

_WEIGHTS = f"""
WITH ent AS (SELECT entry_id, any_value(mention) AS mention, any_value(name_freq) AS name_freq, any_value(top_candidates) AS c FROM mention_candidates GROUP BY entry_id),
flat AS (SELECT CAST(unnest(map_keys(c)) AS VARCHAR) AS item, unnest(map_values(c)) AS w FROM ent),
parts AS (SELECT 'mention' AS kind, {KEY} AS item, coalesce(name_freq, 0) AS w FROM ent UNION ALL SELECT 'entity', item, coalesce(w, 0) FROM flat),
tot AS (SELECT kind, CAST(sum(w) AS BIGINT) AS total FROM parts GROUP BY kind),
res AS (SELECT p.kind, item, CAST(sum(w) AS BIGINT) AS weight, max(total) AS total FROM parts p JOIN tot t ON p.kind = t.kind WHERE item IS NOT NULL GROUP BY 1, 2
        HAVING sum(w) > 0 AND sum(w) * 100 >= max(total))
"""

_COUNTS = f"""
WITH rec AS (SELECT record_id, any_value(batch_no) AS batch_no, any_value(mention) AS m, any_value(linked) AS linked, any_value(total) AS total FROM keyphraseness GROUP BY record_id),
named AS (SELECT {KEY.replace('mention', 'm')} AS mention, batch_no, linked, total FROM rec WHERE m IS NOT NULL),
cnt AS (SELECT mention, CAST(sum(coalesce(linked, 0)) AS BIGINT) AS linked, CAST(sum(coalesce(total, 0)) AS BIGINT) AS total, count(DISTINCT batch_no) AS n_records FROM named GROUP BY mention),
every AS (SELECT count(DISTINCT batch_no) AS b FROM keyphraseness),
res AS (SELECT cnt.*, total < 3 AS is_rare, n_records * 10 >= 4 * b AS is_common FROM cnt CROSS JOIN every)
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "p2_found": _PAIRS + "SELECT src_a, src_b FROM res WHERE n_ab >= 5 AND n_ab * 200 >= n_records AND n_ab * n_records >= 3 * n_a * n_b",
        "p2_pairs": _PAIRS
        + """SELECT src_a, src_b, n_ab, n_a, n_b, n_records, round(n_ab * CAST(n_records AS DOUBLE) / (n_a * n_b), 6) AS lift,
        round((n_ab + 0.5::DOUBLE) * (n_records - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) AS odds_ratio FROM res""",
        "p3_found": _SUMS + "SELECT mention, entity_id FROM ranked WHERE rank <= 3",
        "p3_ranked": _SUMS + "SELECT mention, entity_id, freq, rank FROM ranked WHERE rank <= 3",
        "p4_found": _WEIGHTS + "SELECT kind, item FROM res",
        "p4_weights": _WEIGHTS + "SELECT kind, item, weight, total, true AS bounded FROM res",
        "p5_found": _COUNTS + "SELECT mention, 'rare' AS mark FROM res WHERE is_rare UNION ALL SELECT mention, 'common' FROM res WHERE is_common",
        "p5_counts": _COUNTS + "SELECT mention, linked, total, n_records, is_rare, is_common FROM res",
    }
