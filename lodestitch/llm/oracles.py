"""DuckDB SQL for the queries that SQL can express; whole tables and whole texts."""

from __future__ import annotations

from lodestitch.llm.quality_rules import CUTOFFS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _strength(level: str) -> str:
    return f"""(SELECT greatest(least(1 / coalesce(greatest(least(CASE WHEN sum((n - 1) * prior * (1 - prior)) > 0
      THEN sum(n * pow(y / n - prior, 2) - prior * (1 - prior)) / sum((n - 1) * prior * (1 - prior)) ELSE 0 END, 0.5), 1e-4), 1e-4) - 1, 1000), 1)
      FROM {level} WHERE n > 0)"""


OP1 = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
lab AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality)::BIGINT AS y FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(y), 0)::BIGINT AS y FROM p LEFT JOIN lab USING (page_id) GROUP BY host),
parts AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS part FROM hosts),
two AS (SELECT *, array_to_string(list_slice(part, greatest(len(part) - 1, 1), len(part)), '.') AS pair, len(part) < 2 OR regexp_full_match(name, '[0-9.]+') AS whole FROM parts),
base AS (SELECT host, n, y,
    CASE WHEN whole THEN name WHEN pair IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN pair ELSE part[-1] END AS suffix,
    CASE WHEN whole THEN name ELSE array_to_string(list_slice(part, greatest(len(part) - CASE WHEN pair IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz',
      'co.in') THEN 2 ELSE 1 END, 1), len(part)), '.') END AS domain FROM two),
by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM base GROUP BY domain, suffix),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM by_domain GROUP BY suffix),
s AS (SELECT *, (SELECT (sum(y) + 1) / (sum(n) + 2) FROM by_suffix) AS prior FROM by_suffix),
s2 AS (SELECT suffix, (m * prior + y) / (m + n) AS mean FROM (SELECT *, {_strength("s")} AS m FROM s)),
d AS (SELECT b.*, s2.mean AS prior FROM by_domain b JOIN s2 USING (suffix)),
d2 AS (SELECT domain, suffix, (m * prior + y) / (m + n) AS mean FROM (SELECT *, {_strength("d")} AS m FROM d)),
h AS (SELECT b.*, d2.mean AS prior FROM base b JOIN d2 USING (domain, suffix)),
h2 AS (SELECT host, n, m * prior + y AS a, m * (1 - prior) + n - y AS b FROM (SELECT *, {_strength("h")} AS m FROM h)),
rep AS (SELECT host, n, least(1, (SELECT sum(exp((a + b) * ln(0.5) + i * ln(0.5) + lgamma(a + b + i) - lgamma(a + 1 + i) - lgamma(b)))
  FROM (SELECT unnest(range(0, (4 * (a + b))::BIGINT + 200)) AS i) q)) AS below FROM h2),
rules AS (SELECT action, rule, split_part(rule, '/', 1) AS rh, substr(rule, position('/' IN rule)) AS rp FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'),
  ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) v(action, rule)),
fit AS (SELECT host, path, rule, action, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) AS r
  FROM (SELECT DISTINCT host, path FROM p) u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN below <= 0.05 THEN 'allow' ELSE 'block' END) AS verdict, n AS labelled,
  floor(below * 1000 + 0.5) / 1000 AS below
FROM p LEFT JOIN rep USING (host) LEFT JOIN fit ON fit.host = p.host AND fit.path = p.path AND fit.r = 1
"""

OP2 = """
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(hex(encode(text)), '') AS h, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
w AS (SELECT u, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM d, LATERAL (SELECT unnest(range(0, n - 49)) AS p) r WHERE n >= 50),
least_ AS (SELECT s, min(doc_id) AS f FROM w GROUP BY s),
gone AS (SELECT u, p, CASE WHEN p <= lag(p) OVER (PARTITION BY u ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN least_ USING (s) WHERE f < doc_id),
runs AS (SELECT u, p, sum(new) OVER (PARTITION BY u ORDER BY p) AS run FROM gone),
spans AS (SELECT u, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY u, run),
cuts AS (SELECT u, a, b, lag(b, 1, 0) OVER (PARTITION BY u ORDER BY a) AS before FROM spans),
total AS (SELECT c.u, sum(b - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM cuts c JOIN d USING (u) GROUP BY c.u)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN total USING (u)
"""

_GRID = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for i, (r, cuts) in enumerate(CUTOFFS.items()) for c in cuts)

OP3 = f"""
WITH t AS (SELECT row_number() OVER () AS u, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT u, doc_id, stratum, text, {WORDS.format(text="text")} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS x FROM t),
win AS (SELECT u, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k FROM s, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) r WHERE len(w) > 8),
twice AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT u, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY u),
c AS (SELECT u, doc_id, stratum, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM s LEFT JOIN rep USING (u)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
m AS (SELECT u, doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbol_ratio', 'v': n_symbols / greatest(n_words, 1)}}, {{'rule': 'dup_line_ratio', 'v': n_dup_lines / greatest(n_lines, 1)}},
    {{'rule': 'repeat_ratio', 'v': n_repeat_words / greatest(n_words, 1)}}, {{'rule': 'mean_word_chars', 'v': word_chars / greatest(n_words, 1)}}], recursive := true) FROM b),
grid AS (SELECT * FROM (VALUES {_GRID}) g(rule, rank, cut)),
good AS (SELECT m.* FROM m JOIN labels l ON l.doc_id = m.doc_id AND l.quality = 1 WHERE NOT base_failed),
tests AS (SELECT stratum, grid.rule, cut, count(*) AS n, count(*) FILTER (v > cut) AS k FROM good JOIN grid USING (rule) GROUP BY stratum, grid.rule, cut),
pv AS (SELECT stratum, rule, cut, CASE WHEN k > n * 0.005 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005) + (n - i) * ln(0.995)))
    FROM (SELECT unnest(range(0, k + 1)) AS i) q) END AS p, (SELECT count(DISTINCT stratum) FROM tests) AS strata FROM tests),
cutoff AS (SELECT stratum, rule, min(cut) AS cut FROM pv WHERE p <= 0.05 / (strata * 4) GROUP BY stratum, rule),
failed AS (SELECT u, string_agg(m.rule, ',' ORDER BY grid.rank) AS rules FROM m JOIN cutoff USING (stratum, rule) JOIN (SELECT DISTINCT rule, rank FROM grid) grid ON grid.rule = m.rule
  WHERE v > cut GROUP BY u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules
FROM b LEFT JOIN failed USING (u)
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS sh FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) r WHERE len(w) >= 3
    UNION ALL SELECT doc_id, 'short ' || array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS doc_id, count(*) AS links FROM both_ways GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) JOIN comp ON comp.id = w.doc_id LEFT JOIN degree USING (doc_id)
"""

OP7 = f"""
WITH t AS (SELECT row_number() OVER () AS u, doc_id, text FROM documents),
l AS (SELECT u, doc_id, no, line, {WORDS.format(text=f"translate(line, '{UPPER}', '{LOWER}')")} AS w FROM (
    SELECT u, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM t WHERE text <> '')),
f AS (SELECT u, doc_id, no, w, array_to_string(w, ' ') AS k FROM l WHERE len(w) >= 1),
e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, no) = 1 AS first, min(doc_id * 1000000 + no) OVER (PARTITION BY k) AS pos FROM f),
v AS (SELECT k AS line, e.pos, k AS key, -1 AS j FROM e WHERE first AND len(w) >= 7
  UNION ALL SELECT k, e.pos, array_to_string(list_concat(list_slice(w, 1, j), list_slice(w, j + 2, len(w))), ' '), j FROM e, LATERAL (SELECT unnest(range(0, len(w))) AS j) r WHERE first AND len(w) >= 8),
m AS (SELECT line, pos, min(pos) OVER (PARTITION BY key, j) AS same, min(CASE WHEN j = -1 THEN pos END) OVER (PARTITION BY key) AS whole, min(pos) OVER (PARTITION BY key) AS any_, j FROM v),
near AS (SELECT DISTINCT line FROM m WHERE least(same, coalesce(whole, same), CASE WHEN j = -1 THEN any_ ELSE same END) < pos),
gone AS (SELECT u, no FROM e WHERE NOT (doc_id * 1000000 + no = pos) OR k IN (SELECT line FROM near)),
per AS (SELECT l.u, count(*) AS n_lines, list(l.no::INT ORDER BY l.no) FILTER (gone.no IS NOT NULL) AS removed, coalesce(string_agg(line, chr(10) ORDER BY l.no) FILTER (gone.no IS NULL), '') AS kept
  FROM l LEFT JOIN gone ON gone.u = l.u AND gone.no = l.no GROUP BY l.u)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed, []) AS removed_lines, sha256(coalesce(kept, text)) AS kept_sha256 FROM t LEFT JOIN per USING (u)
"""

OP11 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
r AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, row_number() OVER w AS place, first_value(page_id) OVER w AS leader FROM p
  WINDOW w AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
bits AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS g FROM r)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((g[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN leader END AS refers_to, true AS sound FROM bits
"""

_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT q, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark WHERE text IS NOT NULL)),
tot AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
p AS (SELECT u, doc_id, n, term, count(*) AS tf FROM (SELECT u, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY u, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, tot GROUP BY term, docs),
s AS (SELECT q, item_id, u, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), tot GROUP BY q, item_id, u, doc_id)
SELECT item_id, place::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, u) AS place FROM s WHERE score > 0) WHERE place <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_reputation": OP1,
        "op2_suffix_dedup": OP2,
        "op3_quality_rules": OP3,
        "op5_ngram_join": OP5,
        "op7_line_dedup": OP7,
        "op11_warc_transactions": OP11,
        "op12_tput_search": OP12,
    }
