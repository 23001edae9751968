"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .queries import BLOCKED_HOSTS, BLOCKED_MIRRORS, BLOCKED_NAMES, BLOCKED_ZONES, RULES
from .secret_scan import BASE, MAX_OWNERS, MAX_REPOSITORIES, OPAQUE

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings),
links AS (
  SELECT a.vec_id AS s, b.vec_id AS d FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND a.e IS NOT NULL AND b.e IS NOT NULL AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(s, d) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.s, l.d FROM reach r JOIN links l ON r.d = l.s),
n AS (SELECT s, count(*) AS n FROM links GROUP BY s),
c AS (SELECT s, min(d) AS c FROM reach GROUP BY s)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, c = vec_id AS kept
FROM v LEFT JOIN n ON n.s = vec_id JOIN c ON c.s = vec_id
"""

OP3 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, keeper IS NULL OR keeper = doc_id AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def _op4() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, source, {i} AS ord, '{kind}' AS kind, regexp_extract_all(t, {quote(p)}, 0) AS m,"
        f" regexp_extract_all(t, {quote(p)}, {group}) AS v, string_split_regex(t, {quote(p)}) AS g, {least} AS least FROM t"
        for i, (kind, p, group, least) in enumerate((*BASE, OPAQUE))
    )
    base = ", ".join(f"count(*) FILTER (WHERE kind = '{b[0]}') AS n_{b[0]}" for b in BASE)
    states = ", ".join(f"count(*) FILTER (WHERE state = '{x}') AS n_{x}" for x in ("live", "copied", "shared"))
    counts = ", ".join(f"coalesce(b.n_{b[0]}, 0) AS n_{b[0]}" for b in BASE)
    return f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({each}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
p AS (
  SELECT doc_id, source, ord, kind, v[i] AS val, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS st, length(m[i]) AS ln
  FROM i WHERE length(v[i]) >= least),
s AS (
  SELECT * FROM p WHERE ord < {len(BASE)} UNION ALL SELECT * FROM p o WHERE ord = {len(BASE)} AND regexp_matches(val, '[0-9]')
    AND regexp_matches(val, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = o.doc_id
    AND b.ord < {len(BASE)} AND b.st < o.st + o.ln AND o.st < b.st + b.ln)),
c AS (SELECT val, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT doc_id) AS repositories FROM s GROUP BY val),
h AS (
  SELECT *, CASE WHEN owners > {MAX_OWNERS} THEN 'copied' WHEN repositories > {MAX_REPOSITORIES} THEN 'shared' ELSE 'live' END AS state FROM c),
j AS (
  SELECT s.*, owners, repositories, state, kind || ':' || st || ':' || (st + ln) AS span
  FROM s JOIN h USING (val) WHERE ord < {len(BASE)} OR state = 'live'),
b AS (
  SELECT doc_id, {base}, string_agg(span, ',' ORDER BY st, ord) FILTER (WHERE ord < {len(BASE)}) AS base,
    string_agg(span, ',' ORDER BY st, ord) AS spans, {states},
    max(owners) AS most_owners, max(repositories) AS most_repositories FROM j GROUP BY doc_id)
SELECT t.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_shared, 0) AS n_shared,
  coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM t LEFT JOIN b USING (doc_id)
"""


#: The rules in order: rule i is bit i of failed.
_FAILS = (
    "n_words < 50",
    "100 * n_repeat_words > 50 * n_words",
    "10 * n_symbols > n_words",
    "2 * n_bangs > n_words",
    "10 * n_dup_lines > 4 * n_lines",
    "word_chars < 2 * n_words OR word_chars > 14 * n_words",
)
_FAILED = " + ".join(f"CASE WHEN {x} THEN {1 << i} ELSE 0 END" for i, x in enumerate(_FAILS))
_NAMES = ("few_words", "repeated_words", "symbols", "bangs", "dup_lines", "word_length")

_MEASURED = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n FROM x),
r AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM g WHERE n > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {_SPACES}) <> '' GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines,
    coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_bangs
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, CAST({_FAILED} AS BIGINT) AS failed FROM m)
"""

OP6 = f"""{_MEASURED}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_bangs AS BIGINT) AS n_bangs,
  failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""

ABLATION = f"""{_MEASURED}, rules(rule, bit) AS (VALUES {", ".join(f"('{n}', {1 << i})" for i, n in enumerate(_NAMES))})
SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed = bit) AS n_only,
  count(*) FILTER (WHERE failed & ~bit = 0) AS n_kept_without
FROM f, rules GROUP BY rule
"""


def _op7() -> str:
    cases = {"rule": "", "verdict": ""}
    for kind, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        site, slash, rest = text.partition("/")
        fits = f"WHEN (host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '{slash + rest}') THEN"
        cases["rule"] += f" {fits} '{text}'"
        cases["verdict"] += f" {fits} '{kind}'"
    listed = ", ".join(f"('{x}')" for x in BLOCKED_HOSTS)
    names, zones = (str(list(x)) for x in (BLOCKED_NAMES, BLOCKED_ZONES))
    n, z = len(BLOCKED_NAMES), len(BLOCKED_ZONES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS tail FROM pages),
h AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(tail, '^([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
listed AS (
  SELECT * FROM (VALUES {listed}) b(listed)
  UNION ALL SELECT {names}[i % {n} + 1] || CAST(i // {n * z} + 1 AS VARCHAR) || '.' || {zones}[i // {n} % {z} + 1] FROM range({BLOCKED_MIRRORS}) t(i)),
parts AS (SELECT host, string_split(host, '.') AS labels FROM (SELECT DISTINCT host FROM h)),
suffixes AS (SELECT host, array_to_string(labels[i:], '.') AS suffix FROM (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS i FROM parts)),
hit AS (SELECT DISTINCT host FROM suffixes WHERE suffix IN (SELECT listed FROM listed))
SELECT page_id, h.host, path, CASE{cases["rule"].replace("host", "h.host")} END AS rule,
  CASE{cases["verdict"].replace("host", "h.host")} WHEN hit.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN hit ON hit.host = h.host
"""


OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""

OP12 = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT run, min(doc_id) AS m FROM win GROUP BY run),
hit AS (SELECT doc_id, i, 1 AS starts FROM win JOIN least USING (run) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
judged AS (
  SELECT doc_id, i, word, max(coalesce(starts, 0)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN hit USING (doc_id, i)),
kept AS (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op1_near_vectors": OP1,
    "op3_line_dedup": OP3,
    "op4_secret_scan": _op4(),
    "op6_quality_rules": OP6,
    "op7_url_filter": _op7(),
    "op11_hard_negatives": OP11,
    "op12_substring_dedup": OP12,
    "quality_ablation": ABLATION,
}
