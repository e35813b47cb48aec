"""SQL for DuckDB that gives the rows of the text queries that SQL can express, over whole tables."""

from __future__ import annotations

from chronoframe.llm.quality import CERTAIN, MIDDLE, RATES, SHRINK

WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _lower(x: str) -> str:
    return _LOWER.format(x)


NEAR_DUPLICATES = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
five AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM five WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

def _quality() -> str:
    rates = {name: f"{units} * {count} // greatest({against}, 1)" for name, (count, against, units, _, _) in RATES.items()}
    each = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rate, {x} AS x FROM m WHERE NOT base_failed" for name, x in rates.items())

    def fences(mark: str, keys: str) -> str:
        by, on = (f"{keys}, ", f"{keys}, rate") if keys else ("", "rate")
        group = f" GROUP BY {keys}" if keys else ""
        q = lambda name, p: f"min(bucket) FILTER (rate = '{name}' AND up >= {p} * total)"
        fence = ", ".join(f"CAST({q(name, high)} + {spread} * ({q(name, high)} - {q(name, MIDDLE)}) AS DOUBLE) AS {name}" for name, (_, _, _, high, spread) in RATES.items())
        return f"""{mark} AS (SELECT {by}max(total) AS docs, {fence} FROM (SELECT {by}rate, bucket, sum(n) OVER (PARTITION BY {on} ORDER BY bucket) AS up, sum(n) OVER (PARTITION BY {on}) AS total FROM (SELECT {by}rate, bucket, count(*) AS n FROM k GROUP BY {by}rate, bucket)){group})"""

    limit = ", ".join(f"(g.docs * g.{r} + {SHRINK} * ((l.docs * l.{r} + {SHRINK} * c.{r}) / (l.docs + {SHRINK}))) / (g.docs + {SHRINK}) AS {r}" for r in RATES)
    above = " OR ".join(f"{units} * {count} > {name} * {against} + {CERTAIN * units} * sqrt({count})" for name, (count, against, units, _, _) in RATES.items())
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
e AS MATERIALIZED (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM e),
three AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS s FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM three WHERE s IS NOT NULL),
hit AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice WHERE c > 1) GROUP BY rid),
c0 AS (SELECT doc_id, lang, source, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM e LEFT JOIN hit ON hit.rid = e.rid),
m AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c0),
k AS MATERIALIZED (SELECT lang, source, rate, (x >> z) << z AS bucket FROM (SELECT *, greatest(length(bin(x)) - 6, 0) AS z FROM ({each}))),
{fences("g", "lang, source")}, {fences("l", "lang")}, {fences("c", "")},
lim AS (SELECT g.lang AS lang, g.source AS source, {limit} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({above}, false) AS kept, m.lang AS lang, m.source AS source, n_lines
FROM m LEFT JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source"""


QUALITY = _quality()

LINES = f"""WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
k AS MATERIALIZED (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all({_lower("line")}, '{WORD}'))) AS ws FROM l),
s AS MATERIALIZED (SELECT row_number() OVER () AS sid, ws, len(ws) AS n, min(struct_pack(a := doc_id, b := i)) AS at FROM k WHERE len(ws) > 0 GROUP BY ws),
u AS (SELECT sid, n, unnest(ws) AS w FROM s), f AS (SELECT w, row_number() OVER (ORDER BY count(*), w) AS r FROM u GROUP BY w),
p AS MATERIALIZED (SELECT sid, r FROM (SELECT sid, n, r, row_number() OVER (PARTITION BY sid ORDER BY r) AS pos FROM u JOIN f USING (w)) WHERE pos <= n - (80 * n + 99) // 100 + 1),
c AS MATERIALIZED (SELECT DISTINCT x.sid AS a, y.sid AS b FROM p x JOIN p y ON x.r = y.r AND x.sid <> y.sid),
near AS (SELECT DISTINCT y.sid AS sid FROM c JOIN s x ON x.sid = c.a JOIN s y ON y.sid = c.b WHERE x.at < y.at AND 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)),
gone AS MATERIALIZED (SELECT k.doc_id AS doc_id, k.i AS i FROM k JOIN s ON k.ws = s.ws LEFT JOIN near ON near.sid = s.sid WHERE near.sid IS NOT NULL OR struct_pack(a := k.doc_id, b := k.i) <> s.at),
t AS (SELECT l.doc_id AS doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS kept FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id AS doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""

CONTAMINATION = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '{ALNUM}') AS ws FROM benchmark),
v AS (SELECT item, least(len(ws), 13) AS span, unnest(list_transform(range(1, len(ws) - least(len(ws), 13) + 2), lambda j: array_to_string(ws[j : j + least(len(ws), 13) - 1], ' '))) AS s FROM b WHERE len(ws) > 0),
x AS MATERIALIZED (SELECT DISTINCT item, span, s FROM v),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{ALNUM}') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
y AS (SELECT doc_id, n, i, span, string_agg(w, ' ') OVER (PARTITION BY doc_id, span ORDER BY i ROWS BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS s FROM w CROSS JOIN (SELECT DISTINCT span FROM x)),
h AS MATERIALIZED (SELECT doc_id, i, y.span AS span, item FROM y JOIN x ON x.s = y.s AND x.span = y.span WHERE i + y.span - 1 <= n),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS j FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""
