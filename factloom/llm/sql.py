"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import decontaminate, license_scan, license_texts, negatives, quality, secrets

def _left(whole: str, own: str) -> str:
    """What is left of a sum over hosts for the mean of the others; a host alone has its own."""
    return f"CASE WHEN hosts > 1 THEN ({whole} - {own}) / (hosts - 1) ELSE {own} END"


_RATES = ("short", "repeats", "failing")
_SUMS = ", ".join(f"sum({x}) first_{x}, sum({x} * {x}) second_{x}" for x in _RATES)
_PRIORS = ", ".join(f"{_left(f'first_{x}', x)} raw_{x}, {_left(f'second_{x}', f'{x} * {x}')} square_{x}" for x in _RATES)
_MEANS = ", ".join(f"CASE WHEN hosts > 1 THEN greatest(raw_{x}, 1.0 / (docs - n + 1)) ELSE raw_{x} END mean_{x}" for x in _RATES)
_EXTRA = ", ".join(f"square_{x} - raw_{x} * raw_{x} - mean_{x} * (1 - mean_{x}) * each extra_{x}" for x in _RATES)
_WEIGHTS = ", ".join(f"CASE WHEN extra_{x} > 0 THEN least({quality.MAX_PRIOR}, greatest({quality.MIN_PRIOR}, mean_{x} * (1 - mean_{x}) / extra_{x} - 1)) ELSE {quality.MAX_PRIOR} END weight_{x}" for x in _RATES)
_SHRUNK = ", ".join(f"({x} * n + mean_{x} * weight_{x}) / (n + weight_{x}) rate_{x}, least({quality.MAX_HOST_RATE}, mean_{x} + {quality.DEVIATIONS} * sqrt(mean_{x} * (1 - mean_{x}) / (weight_{x} + 1) * n / (n + weight_{x}))) most_{x}" for x in _RATES)

OP8 = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') x FROM documents),
w AS (SELECT doc_id, source, x, list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+'), lambda v: v <> '') ws,
  list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^ \\t\\n\\x0b\\f\\r]')) ls FROM t),
grams AS (SELECT doc_id, i, array_to_string(ws[i : i + {quality.WINDOW - 1}], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) i FROM w WHERE len(ws) > {quality.WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, sum(least({quality.WINDOW}, coalesce(next - i, {quality.WINDOW}))) n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) n_words, length(array_to_string(ws, '')) word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) n_repeat_words FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) n, count(*) FILTER (n_words < {quality.MIN_WORDS}) / count(*) short, count(*) FILTER (100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) / count(*) repeats, count(*) FILTER (base_failed) / count(*) failing FROM f GROUP BY source),
p AS (SELECT count(*) hosts, sum(n) docs, sum(1.0 / n) per_doc, {_SUMS} FROM h),
q1 AS (SELECT *, {_left("per_doc", "1.0 / n")} each, {_PRIORS} FROM h, p),
q2 AS (SELECT *, {_MEANS} FROM q1), q3 AS (SELECT *, {_EXTRA} FROM q2), q4 AS (SELECT *, {_WEIGHTS} FROM q3), q5 AS (SELECT *, {_SHRUNK} FROM q4),
r AS (SELECT source, rate_short, rate_repeats, rate_failing rate_any, {" OR ".join(f"rate_{x} > most_{x}" for x in _RATES)} rejected FROM q5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept, round(rate_short, 6) rate_short, round(rate_repeats, 6) rate_repeats, round(rate_any, 6) rate_any
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' kind, st, st + length(found[i]) en FROM (
      SELECT doc_id, found, counted, i, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i-1], lambda g: length(g))), 0) AS BIGINT) st FROM (
        SELECT doc_id, regexp_split_to_array(x, '{p}') gaps, regexp_extract_all(x, '{p}') found, regexp_extract_all(x, '{p}', {group}) counted, unnest(range(1, len(regexp_extract_all(x, '{p}')) + 1)) i FROM t WHERE regexp_matches(x, '{secrets.GATES[kind].replace("'", "''")}'))
    ) WHERE length(counted[i]) >= {least}"""


OP5 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') x FROM documents),
spans AS ({" UNION ALL ".join(_kind(i, *rule) for i, rule in enumerate(secrets.RULES))}),
found AS (SELECT doc_id, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access, count(*) FILTER (kind = 'hex') n_hex,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) FILTER (rank < {len(secrets.BASE_RULES)}) base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM t LEFT JOIN found USING (doc_id)
"""


_TEMPLATES = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(license_texts.TEMPLATES))
_SHINGLES = f"list_transform(range(1, len(ws) - {license_scan.SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {license_scan.SHINGLE - 1}], ' '))"

#: Every window of every text that shares a shingle with a template, without bands.
OP1 = f"""
WITH n AS (SELECT notice, license, list_distinct({_SHINGLES}) parts FROM (SELECT notice, license, list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda v: v <> '') ws FROM (VALUES {_TEMPLATES}) v(notice, license, x))),
s AS (SELECT notice, license, parts, CAST(pow(2, ceil(log2(2.0 * len(parts)))) AS BIGINT) win FROM n),
t AS (SELECT doc_id, {_SHINGLES} sh FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda v: v <> '') ws FROM documents)),
marked AS (SELECT doc_id, notice FROM (SELECT doc_id, unnest(sh) p FROM t) JOIN (SELECT notice, unnest(parts) p FROM n) USING (p) GROUP BY ALL),
w AS (SELECT doc_id, notice, license, parts, win, sh, unnest(range(0, len(sh), win // 2)) st FROM t JOIN marked USING (doc_id) JOIN s USING (notice)),
c AS (SELECT doc_id, notice, license, len(parts) n, st, len(list_intersect(parts, list_distinct(sh[st + 1 : st + win]))) / len(parts)::DOUBLE contained, list_filter(range(st, least(st + win, len(sh))), lambda i: list_contains(parts, sh[i + 1])) held FROM w),
f AS (SELECT DISTINCT doc_id, notice, license, n, contained, list_min(held) a, list_max(held) + {license_scan.SHINGLE} b FROM c WHERE contained >= {license_scan.MIN_CONTAINED})
SELECT doc_id, license, notice, max(contained) contained, min(a) first_word, count(*) n_places FROM f WHERE NOT EXISTS (
  SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.a < f.b AND f.a < o.b AND (o.contained, o.n, -o.notice, -o.a, -o.b) > (f.contained, f.n, -f.notice, -f.a, -f.b)) GROUP BY doc_id, license, notice
"""


#: All scores of all anchors.
OP11 = f"""
WITH r AS (SELECT row_number() OVER () i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i, a.vec_id anchor_id, b.vec_id, a.label = b.label same, CAST(list_inner_product(a.v, b.v) AS BIGINT) score FROM r a JOIN r b ON a.i <> b.i WHERE a.vec_id % {negatives.ANCHORS} = 0),
p AS (SELECT * FROM (SELECT i, anchor_id, vec_id positive_id, score positive_score, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) place FROM s WHERE same) WHERE place <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id negative_id, s.score negative_score, row_number() OVER (PARTITION BY p.i, p.place ORDER BY s.score DESC, s.vec_id) rank FROM p JOIN s ON p.i = s.i AND NOT s.same
  AND {negatives.LEAST} * positive_score <= 100 * s.score AND 100 * s.score <= {negatives.MOST} * positive_score) WHERE rank <= {negatives.NEGATIVES}
"""


def _small_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{decontaminate.BETWEEN}'), lambda v: v <> '')"


#: All windows of all texts, without fingerprints.
OP12 = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') item, {_small_words("text")} ws FROM benchmark),
w AS (SELECT DISTINCT item, m, array_to_string(ws[st : st + m - 1], ' ') g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) st FROM (SELECT *, least({decontaminate.WINDOW}, len(ws)) m FROM i WHERE len(ws) > 0))),
d AS (SELECT row_number() OVER () r, doc_id, {_small_words("text")} ws FROM documents),
o AS (SELECT r, st, m, g FROM (SELECT r, st, m, array_to_string(ws[st : st + m - 1], ' ') g FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) st FROM d, (SELECT DISTINCT m FROM w))) WHERE g IN (SELECT g FROM w)),
c AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(st, st + m)) p FROM o) GROUP BY r),
n AS (SELECT r, count(*) n_items, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT r, item FROM (SELECT DISTINCT r, g FROM o) JOIN w USING (g)) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, n_hit IS NOT NULL contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
