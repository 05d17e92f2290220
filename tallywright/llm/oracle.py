"""DuckDB twins of the queries that SQL can express.

Not here: BPE merges, wrapper induction, components over fingerprints, match positions, table filling by turns and checksums of words;
their tests compare with brute force.
"""

from __future__ import annotations

from . import clustering, license, linededup, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOW, _HIGH = quality.MEAN_WORD_LENGTH

QUALITY = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
gram AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM d, range(1, len(w) - 1) r(i)),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM gram WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, host, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(again.n, 0) AS n_repeat_words FROM d LEFT JOIN again USING (rid)),
j AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed,
    base_failed OR 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines
      OR word_chars < {_LOW} * n_words OR word_chars > {_HIGH} * n_words AS failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS f FROM j GROUP BY host),
s AS (
  SELECT count(*) AS hosts, sum(n)::DOUBLE AS total, sum(f)::DOUBLE / sum(n) AS mean, mean * (1 - mean) AS chance, sum((f * f)::DOUBLE / n) AS squares,
    sum((n * n)::DOUBLE) AS sizes, squares - total * mean * mean - (hosts - 1) * chance AS excess, total - sizes / total - (hosts - 1) AS room FROM h),
prior AS (
  SELECT mean, CASE WHEN room > 0 AND excess > 1e-9 THEN greatest(chance / (excess / room) - 1, 1e-6) ELSE {quality.FLAT_PRIOR_WEIGHT} END AS weight,
    round(least({quality.MAX_HOST_RATE}, mean + {quality.HOST_DEVIATIONS} * sqrt(chance / (weight + 1))), 9) AS line FROM s),
rate AS (
  SELECT host, (f + mean * weight) / (n + weight) AS r, round(r - {quality.SURE_DEVIATIONS} * sqrt(r * (1 - r) / (n + weight + 1)), 9) > line AS poor FROM h, prior)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (poor AND failed) AS kept
FROM j JOIN rate USING (host)"""

WINNOWING = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS x FROM b, range(1, greatest(len(w) - 9, 1) + 1) r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(x) AS n FROM win),
hit AS (
  SELECT rid, i, n, item_id FROM (SELECT rid, i, n, w[i:i + n - 1] AS x FROM d, sizes, range(1, len(w) - n + 2) r(i)) JOIN win USING (x)),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""

WARC = """WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p"""

#: The given turns hold no tool calls, so the twin has messages only.
CHAT = """SELECT conv_id, turn, 'message' AS kind, NULL::VARCHAR AS call_id, NULL::BOOLEAN AS linked, NULL::BOOLEAN AS valid, NULL::VARCHAR AS problem,
  turn AS order_turn, 0 AS order_stage, 0 AS order_index,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, to_json({content: coalesce(text, ''), role: role})::VARCHAR) AS position, to_json({content: coalesce(text, ''), role: role})::VARCHAR AS json FROM conversations"""

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_TEMPLATES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license.TEMPLATES.items())
_SHINGLES = "SELECT {key}, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM {table}, range(1, len(w) - 3) r(i)"

LICENSES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT license, {_WORDS} AS w FROM (VALUES {_TEMPLATES}) v(license, text)),
ts AS (SELECT DISTINCT license, s FROM ({_SHINGLES.format(key='license', table='t')})),
size AS (SELECT license, pow(2, ceil(log2(len(w) - 4)))::BIGINT AS level, (SELECT count(*) FROM ts WHERE ts.license = t.license) AS n FROM t),
hit AS (
  SELECT rid, license, s, n, unnest(CASE WHEN pos >= level THEN [pos // level, pos // level - 1] ELSE [0] END) AS win
  FROM ({_SHINGLES.format(key='rid', table='d')}) JOIN ts USING (s) JOIN size USING (license)),
found AS (SELECT DISTINCT rid, license FROM (
  SELECT rid, license, win FROM hit GROUP BY rid, license, win, n HAVING count(DISTINCT s) >= {license.MIN_CONTAINMENT} * n)),
per AS (SELECT rid, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names FROM found GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN per USING (rid)"""

LINES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (
  SELECT rid, doc_id, i, x[i] AS line,
    translate(trim(x[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM d, range(1, len(x) + 1) r(i)),
g AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= {linededup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}),
m AS (SELECT l.*, g.k IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id"""

_DIMS = f"range(1, {clustering.DIMENSIONS + 1})"
_FAR = f"list_sum(list_transform({_DIMS}, lambda i: (v[i] - c[i]) * (v[i] - c[i])))"


def _assigned(k: int) -> str:
    """Each vector's nearest of the centroids c{k}."""
    return f"""a{k} AS MATERIALIZED (SELECT rid, vec_id, v, b.far AS far, b.no AS no FROM (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{far: {_FAR}, no: no}}) AS b FROM vec, c{k} GROUP BY rid))"""


def _moved(k: int) -> str:
    """The centroids c{k} at the floor of their vectors' means; those without vectors stay."""
    return f"""m{k} AS MATERIALIZED (SELECT no, list(f ORDER BY i) AS c FROM (
  SELECT no, i, floor(sum(v[i]) / count(*))::BIGINT AS f FROM a{k}, {_DIMS} r(i) GROUP BY no, i) GROUP BY no),
c{k + 1} AS MATERIALIZED (SELECT c{k}.no, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (no))"""


_STEPS = ",\n".join(f"{_assigned(k)},\n{_moved(k)}" for k in range(clustering.ROUNDS))
CLUSTERS = f"""WITH vec AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {clustering.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clustering.DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY mark, v) - 1 AS no, v AS c FROM (
    SELECT sha256('{clustering.SEED}:' || vec_id) AS mark, v FROM vec WHERE vec_id IS NOT NULL ORDER BY mark, v LIMIT {clustering.CLUSTERS})),
{_STEPS},
{_assigned(clustering.ROUNDS)}
SELECT vec_id, no::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY no))::BIGINT AS cluster_inertia,
  (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{clustering.ROUNDS} JOIN c{clustering.ROUNDS} USING (no)"""

ORACLE_SQL = {
    "op4_chat_formatting": CHAT,
    "op5_license_scan": LICENSES,
    "op8_warc_bundles": WARC,
    "op9_winnowing": WINNOWING,
    "op10_host_quality": QUALITY,
    "op11_centroid_clustering": CLUSTERS,
    "op12_line_dedup": LINES,
}
