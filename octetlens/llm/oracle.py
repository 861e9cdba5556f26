"""What the queries give, in DuckDB's SQL, where it can be said without a model or a tokenizer.

Stated from the contracts, not from the operators: shingles are texts and not hashes, all pairs of a label are compared, and
places of matches follow from what lies between them.
"""

from __future__ import annotations

#: Smallest identifier reachable by ``links`` (a, b), which hold both directions: a smaller identifier than all on its way.
_REACHED = """reached(id, low) AS (
  SELECT id, id FROM nodes UNION SELECT links.b, reached.low FROM reached JOIN links ON links.a = reached.id AND links.b > reached.low),
component AS (SELECT id, min(low) AS component_id FROM reached GROUP BY id)"""


def _either_case(words: str) -> str:
    """A pattern for words in letters of either case; only ASCII's, whereas (?i) would take others that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGNED = """["'']?\\x20*[:=]\\x20*["'']?"""
#: Kind, place among kinds, pattern, and what its matches must be like. Between two matches of a kind lies a gap.
_SECRETS = (
    ("assign", 0, "(?:" + _either_case("password|passwd|secret|token|api_?key") + ")" + _ASSIGNED + "[A-Za-z0-9+/_.=-]+", _ASSIGNED + "[A-Za-z0-9+/_.=-]{6,}$"),
    ("access", 1, "AKIA[A-Z0-9]+", "^.{20,}$"),
    ("hex", 2, "[0-9a-f]+", "^.{24,}$"),
    ("weak_key", 3, "[A-Za-z0-9/+=_.-]+", "^[A-Za-z0-9/+]{40}$"),
    ("endpoint", 4, _either_case("https?") + "://[A-Za-z0-9.-]{4,}(?::[0-9]{1,5})?", "."),
    ("client", 5, "(?:" + _either_case("client_?id|user_?name|login") + ")" + _ASSIGNED + "[A-Za-z0-9_.@-]{3,}", "."),
)
_CUTS = " UNION ALL ".join(
    f"SELECT id, '{kind}' AS kind, {place} AS place, '{like}' AS form, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM texts" for kind, place, p, like in _SECRETS
)

ORACLE_SQL = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
nodes AS (SELECT id FROM words),
shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
{_REACHED}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM component LEFT JOIN sizes USING (id)
""",
    "op4_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (rn - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM s),
c AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS place, (sum(source_size) OVER ())::DOUBLE * 1.5e0 AS whole,
         coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
         sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (whole - 2e0 * below) / rest AS own FROM c),
m AS (SELECT *, arg_min(own, CASE WHEN own * weight <= 2e0 * source_size THEN place END) OVER () AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN 2e0 * source_size ELSE least(2e0 * source_size, level * weight) END AS target FROM m),
r AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, words - epochs * source_size - before)))::BIGINT AS taken FROM e
""",
    "op5_embedding_near_dedup": rf"""
WITH RECURSIVE vectors AS (
  SELECT vec_id AS id, label, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
nodes AS (SELECT id FROM vectors),
normed AS (SELECT *, CASE WHEN v IS NOT NULL AND len(v) > 0 THEN sqrt(list_dot_product(v, v)) END AS norm FROM vectors),
links AS (
  SELECT x.id AS a, y.id AS b FROM normed x JOIN normed y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id
  WHERE CASE WHEN x.norm > 0 AND y.norm > 0 THEN list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.98e0 ELSE false END),
degrees AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a),
{_REACHED}
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN degrees USING (id)
""",
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""",
    "op10_secret_scan": rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
cuts AS ({_CUTS}),
matches AS (SELECT id, kind, place, form, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS nth FROM cuts WHERE len(found) > 0),
ended AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY id, kind ORDER BY nth)::BIGINT AS stop FROM matches),
spans AS (SELECT id, kind, place, stop - length(m) AS start, stop FROM ended WHERE regexp_matches(m, form)),
-- A weak candidate and what lies within 400 code points of it.
near AS (
  SELECT w.id, w.kind, w.place, w.start, w.stop, bool_or(o.kind IN ('access', 'client')) AS account, bool_or(o.kind IN ('assign', 'hex', 'weak_key')) AS secret
  FROM spans w JOIN spans o ON o.id = w.id AND o.kind <> w.kind AND abs(o.start - w.start) <= 400 WHERE w.place > 2 GROUP BY ALL),
reported AS (
  SELECT * FROM spans WHERE place <= 2 UNION ALL
  SELECT id, kind, place, start, stop FROM near WHERE CASE kind WHEN 'weak_key' THEN account WHEN 'endpoint' THEN account AND secret ELSE secret END),
named AS (SELECT *, kind || ':' || start || ':' || stop AS shown FROM reported),
per AS (
  SELECT id, string_agg(shown, ',' ORDER BY start, place, stop) AS spans, string_agg(shown, ',' ORDER BY start, place, stop) FILTER (place <= 2) AS base,
         count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex FROM named GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN per USING (id)
""",
}
