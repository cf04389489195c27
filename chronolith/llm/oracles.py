"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from . import decontam, line_dedup, quality, substring_dedup

SPACE = r"[ \t\n\x0B\f\r]+"
BLANK = r"[^ \t\n\x0B\f\r]"
DOCS = "docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, lang, source FROM documents)"
WORDS = f"words AS (SELECT *, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS w FROM docs)"

OP2 = f"""
WITH {DOCS},
lines AS (SELECT row, source, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS pos FROM docs),
real AS (SELECT * FROM lines WHERE regexp_matches(line, '{BLANK}')),
bad AS (SELECT line FROM real WHERE source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
counts AS (SELECT row, count(*) AS n_lines, count(*) FILTER (line IN (SELECT line FROM bad)) AS n_bad FROM real GROUP BY row),
cut AS (SELECT row, n_bad < n_lines AS take FROM counts),
kept AS (
  SELECT l.row, string_agg(line, chr(10) ORDER BY pos) AS k, count(*) AS n FROM lines l LEFT JOIN cut c ON l.row = c.row
  WHERE NOT (coalesce(take, false) AND regexp_matches(line, '{BLANK}') AND line IN (SELECT line FROM bad)) GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, CAST(CASE WHEN take THEN n_bad ELSE 0 END AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs d LEFT JOIN counts c ON d.row = c.row LEFT JOIN cut u ON d.row = u.row LEFT JOIN kept k ON d.row = k.row"""

_N = substring_dedup.WINDOW
OP4 = f"""
WITH {DOCS}, {WORDS},
windows AS (SELECT row, i, md5(array_to_string(w[i + 1 : i + {_N}], ' ')) AS g FROM words, LATERAL (SELECT unnest(range(0, greatest(len(w) - {_N - 1}, 0))) AS i)),
twice AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT row, i + o AS pos FROM windows, range(0, {_N}) r(o) WHERE g IN (SELECT g FROM twice)),
each AS (SELECT row, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM words),
kept AS (SELECT e.row, string_agg(word, ' ' ORDER BY e.pos) AS k, count(*) AS n FROM each e WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.row = e.row AND h.pos = e.pos) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM words LEFT JOIN kept ON words.row = kept.row"""

# The fences come from quantiles of sketches; up to SKETCH_K documents a sketch is exact, as here.
_Q = (("low", quality.LOW), ("mid", quality.MIDDLE), ("high", quality.HIGH))
_RATES = ", ".join(f"(({count}) + 1) / greatest({units}, 1) AS {m}" for m, (count, units, _) in quality.MEASURES.items())
_QUANT = ", ".join(f"quantile_disc({m}, {q}) AS {m}_{n}" for m in quality.MEASURES for n, q in _Q)


def _drawn(n: str, own: str, to: str) -> str:
    return f"({n} * {own} + {quality.WEIGHT} * {to}) / ({n} + {quality.WEIGHT})"


_DRAWN = ", ".join(f"{_drawn('g.docs', f'g.{m}_{n}', _drawn('l.docs', f'l.{m}_{n}', f'a.{m}_{n}'))} AS {m}_{n}" for m in quality.MEASURES for n, _ in _Q)


def _within() -> str:
    out = []
    for m, (count, units, low) in quality.MEASURES.items():
        root = f"2 * (sqrt(({count}) + 0.375) - sqrt({{}} * {units} + 0.375))"
        out.append(f"{root.format(f'({m}_mid + {quality.SPREAD} * ({m}_high - {m}_mid))')} <= {quality.Z}")
        if low:
            out.append(f"{root.format(f'greatest({m}_mid - {quality.SPREAD} * ({m}_mid - {m}_low), 0)')} >= -{quality.Z}")
    return " AND ".join(out)


OP6 = f"""
WITH {DOCS}, {WORDS},
tri AS (SELECT row, i, w[i + 1 : i + 3] AS g FROM words, LATERAL (SELECT unnest(range(0, greatest(len(w) - 2, 0))) AS i)),
dup AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT row, count(*) AS n FROM (SELECT DISTINCT row, i + o AS pos FROM dup, range(0, 3) r(o)) GROUP BY 1),
lines AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{BLANK}') GROUP BY 1),
base AS (SELECT w.row, doc_id, lang, source, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.d, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM words w LEFT JOIN rep r ON w.row = r.row LEFT JOIN lines l ON w.row = l.row),
m AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
p AS (SELECT DISTINCT lang, source, t, {_RATES} FROM m WHERE NOT base_failed),
g AS (SELECT lang, source, count(*) AS docs, {_QUANT} FROM p GROUP BY 1, 2), l AS (SELECT lang, count(*) AS docs, {_QUANT} FROM p GROUP BY 1), a AS (SELECT {_QUANT} FROM p),
f AS (SELECT g.lang, g.source, {_DRAWN} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_within()}, false) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""

_K = decontam.WINDOW
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_W7 = r"list_filter(regexp_split_to_array({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_W7.format(t=_LOW)} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W7.format(t=_LOW)} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), {_K}) AS k, array_to_string(w[i + 1 : i + least(len(w), {_K})], ' ') AS g FROM b, LATERAL (SELECT unnest(range(0, greatest(len(w) - {_K} + 1, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT row, k, i, array_to_string(w[i + 1 : i + k], ' ') AS g FROM d, sizes, LATERAL (SELECT unnest(range(0, greatest(len(w) - k + 1, 0))) AS i)),
h AS (SELECT row, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
cover AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest(range(i, i + k)) AS pos FROM h) GROUP BY 1),
items AS (SELECT row, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c ON d.row = c.row LEFT JOIN items i ON d.row = i.row"""

_HEX = "CAST('0x' || substr(md5(host), {}, 2) AS INT)"
OP10 = f"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@]*)', 1)), '\\.$', '') AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  to_timestamp(1704067200 + (page_id * 7919) % 366 * 86400 + (page_id * 104729) % 86400)::TIMESTAMP AS pos FROM pages),
h AS (SELECT DISTINCT host, {_HEX.format(1)} AS a, {_HEX.format(3)} AS b, {_HEX.format(5)} AS c FROM p WHERE host <> ''),
k AS (SELECT *, CASE WHEN c % 3 = 0 THEN host || '/en' ELSE host END AS key, ['adult', 'malware', 'spam'][b % 3 + 1] AS list FROM h),
e AS (SELECT list, key, 'add' AS action, DATE '2024-01-01' + b AS dated_at FROM k WHERE a % 4 < 2 UNION ALL
      SELECT list, key, 'remove', DATE '2024-01-01' + (b + 20 + c % 60) FROM k WHERE a % 4 = 1 UNION ALL
      SELECT list, key, 'add', DATE '2024-01-01' + (b + 100 + c % 50) FROM k WHERE a % 8 = 1),
o AS (SELECT list, key, dated_at, max(action) AS action FROM e GROUP BY 1, 2, 3),
r AS (SELECT * FROM (SELECT list, key, action, CAST(dated_at AS TIMESTAMP) AS f, CAST(lead(dated_at) OVER (PARTITION BY list, key ORDER BY dated_at) AS TIMESTAMP) AS u FROM o) WHERE action = 'add'),
m AS (SELECT DISTINCT page_id, list, key FROM p JOIN r ON pos >= f AND (u IS NULL OR pos < u) AND (host = key OR ends_with(host, '.' || key) OR host || '/' || list_filter(string_split(path, '/'), lambda x: x <> '')[1] = key)),
g AS (SELECT page_id, count(*) AS n, string_agg(list || ':' || key, ',' ORDER BY list, key) AS s FROM m GROUP BY 1)
SELECT p.page_id, host, coalesce(n, 0) AS n_matches, coalesce(s, '') AS matches, coalesce(n, 0) > 0 AS blocked FROM p LEFT JOIN g ON p.page_id = g.page_id"""

ORACLES: dict[str, str] = {"op2_line_dedup": OP2, "op4_substring_dedup": OP4, "op6_quality_rules": OP6, "op7_decontamination": OP7, "op10_url_filter": OP10}
