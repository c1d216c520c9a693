"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(0, len(w) - 9), lambda i: array_to_string(w[i + 1 : i + 10], ' ')) END) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, lens),
hits AS (SELECT rid, i, a.n, item FROM places a JOIN wins ON wins.n = a.n AND wins.win = array_to_string(w[i + 1 : i + a.n], ' ')),
cov AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
met AS (SELECT rid, count(*) AS k, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_hit, coalesce(k, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(c, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN met USING (rid)"""

#: Template tree: leaves and templates of 10 distinct texts or more, constants shared by a fifth of a leaf's distinct lines, templates of 0.7 constants.
LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
ln AS (SELECT doc_id, text, l, unnest(range(0, len(l))) AS i FROM d),
sp AS (SELECT doc_id, text, i, list_filter(regexp_split_to_array(trim(l[i + 1], ' '), '\s+'), lambda w: w <> '') AS s FROM ln),
lf AS (SELECT doc_id, text, i, len(s) AS n, CASE WHEN len(s) < 3 THEN s ELSE list_transform(s, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) END AS k FROM sp WHERE len(s) > 0),
tk AS (SELECT *, k[1:3] AS lead FROM lf),
hot AS (SELECT n, lead FROM tk GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
seen AS (SELECT tk.* FROM tk JOIN hot USING (n, lead)),
dl AS (SELECT DISTINCT n, lead, k FROM seen),
al AS (SELECT n, lead, count(*) AS al FROM dl GROUP BY ALL),
place AS (SELECT n, lead, p, k[p] AS w, count(*) AS c FROM (SELECT n, lead, k, unnest(range(1, n + 1)) AS p FROM dl) GROUP BY ALL),
pos AS (SELECT n, lead, k, p, k[p] AS w FROM (SELECT n, lead, k, unnest(range(1, n + 1)) AS p FROM dl)),
gen AS (SELECT pos.n, pos.lead, pos.k, list(CASE WHEN c > 1 AND 5 * c >= al THEN pos.w ELSE '<*>' END ORDER BY pos.p) AS t, sum(CASE WHEN c > 1 AND 5 * c >= al THEN 1 ELSE 0 END) AS held
  FROM pos JOIN place USING (n, lead, p, w) JOIN al USING (n, lead) GROUP BY pos.n, pos.lead, pos.k),
nm AS (SELECT doc_id, text, i, array_to_string(CASE WHEN n >= 3 AND held >= 0.7 * n THEN t ELSE k END, ' ') AS g FROM seen JOIN gen USING (n, lead, k)),
grp AS (SELECT g, arg_min(text, doc_id) AS first_text FROM nm GROUP BY g HAVING count(DISTINCT text) >= 10),
gone AS (SELECT doc_id, list(i) AS g FROM nm JOIN grp USING (g) WHERE text <> first_text GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone.g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(gone.g, i)), lambda i: l[i + 1]), chr(10)) END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone.g), 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN gone USING (doc_id)"""

def _runs(size: int, name: str) -> str:
    """CTEs that end in ``name``: the runs of bytes (a, b) of each text under strings of ``size`` bytes that start twice; two hexadecimal digits stand for a byte."""
    return f"""w{size} AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * size})) AS m FROM (SELECT doc_id, x, unnest(range(0, CAST(len(x) // 2 AS BIGINT) - {size - 1})) AS i FROM d WHERE len(x) >= {2 * size})),
r{size} AS (SELECT doc_id, i FROM w{size} QUALIFY count(*) OVER (PARTITION BY m) > 1),
s{size} AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {size} THEN 0 ELSE 1 END AS nw FROM r{size}),
g{size} AS (SELECT doc_id, i, sum(nw) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM s{size}),
{name} AS (SELECT doc_id, k, min(i) AS a, max(i) + {size} AS b FROM g{size} GROUP BY ALL)"""


SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), {_runs(400, "sp")}, {_runs(224, "ps")},
kp AS (SELECT doc_id, x, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS nx FROM sp JOIN d USING (doc_id)),
cut AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
  string_agg(substr(x, 2 * z + 1, 2 * (a - z)) || CASE WHEN nx IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM kp GROUP BY doc_id),
pw AS (SELECT doc_id, len(list_filter(regexp_extract_all(substr(x, 2 * a + 1, 2 * (b - a)), '(?:20|0[9A-D])+|(?:2[1-9A-F]|0[0-8EF]|[13-9A-F][0-9A-F])+'),
  lambda t: NOT regexp_matches(t, '^(20|0[9A-D])'))) AS words FROM ps JOIN d USING (doc_id)),
pn AS (SELECT doc_id, count(*) AS n FROM pw WHERE words >= 50 GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256,
  coalesce(n, 0) AS n_passages
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN pn USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_BLANK}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM sh a JOIN sh b USING (s) GROUP BY ALL),
link AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared.k >= 85 * (x.k + y.k - shared.k)),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
head AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN head ON u = d.doc_id"""


def quality(max_symbols: float, min_lines: int, max_lines: float, severe: float, spread: float) -> str:
    rate = "({r} + {m} * {s}) / (n + {s})"

    def prior(rule: str) -> str:
        return f"CASE WHEN {rule}_v > 0 THEN least(1000.0, greatest(1.0, {rule}_m * (1 - {rule}_m) / {rule}_v - 1)) ELSE 1000.0 END"

    rates = ", ".join(
        f"{rate.format(r=r, m=r + '_m', s='(' + prior(r) + ')')} > {r}_m + {spread} * sqrt({r}_m * (1 - {r}_m) / (({prior(r)}) + 1)) AS habit_{r}" for r in ("sym", "lin")
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_BLANK}')) AS l FROM documents),
tri AS (SELECT rid, i, w[i + 1 : i + 3] AS g FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
rep AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
  coalesce(c, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(n_symbols > CAST({max_symbols} AS DOUBLE) * word_chars AS INT) AS sym,
  CAST(n_dup_lines >= {min_lines} AND n_dup_lines > CAST({max_lines} AS DOUBLE) * n_lines AS INT) AS lin,
  n_symbols > CAST({severe * max_symbols} AS DOUBLE) * word_chars OR (n_dup_lines >= {min_lines} AND n_dup_lines > CAST({severe * max_lines} AS DOUBLE) * n_lines) AS severe FROM m),
h AS (SELECT source, count(*) AS n, sum(sym) AS sym, sum(lin) AS lin FROM f GROUP BY source),
p AS (SELECT avg(sym / n) AS sym_m, var_pop(sym / n) AS sym_v, avg(lin / n) AS lin_m, var_pop(lin / n) AS lin_v FROM h),
r AS (SELECT source, {rates} FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT severe AND NOT (sym = 1 AND habit_sym) AND NOT (lin = 1 AND habit_lin) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""
