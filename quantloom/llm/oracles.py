"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality

_PARTS = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_URL = rf"""
WITH u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, {_PARTS}, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, {_PARTS}, 2), '') AS path
  FROM pages),
listed AS (SELECT host FROM u GROUP BY host HAVING avg(CASE WHEN contains(url, 'utm_') THEN 1.0 ELSE 0.0 END) >= 0.2),
rules(rule, rule_host, rule_path, says) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
judged AS (
  SELECT u.*, (SELECT max_by(rule, length(rule)) FROM rules
               WHERE (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path)) AS rule
  FROM u)
SELECT page_id, host, path, j.rule, host IN (SELECT host FROM listed) AS listed,
       coalesce(r.says, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN rules r ON j.rule = r.rule"""


def _escaped(text: str) -> str:
    """SQL that escapes the template's control strings in text."""
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '\\', '\\\\', 'g'), '([<\[])(\||s>|/s>|INST\]|/INST\])', '\1\\\2', 'g'), '\|>', '|\\>', 'g')"


_CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped("text")}) + length(role) + CASE WHEN role = 'assistant' THEN 8 ELSE 17 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('42:' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / greatest(0.05::DOUBLE, coalesce((length(translate(text, '#*$%&|<>!', '')) / greatest(length(text), 1)::DOUBLE) ** 4, 0)) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][nth % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         (total - coalesce(sum(cap) OVER prior, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER prior, 0)) AS level
  FROM w WINDOW prior AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size,
         CASE WHEN level < ratio THEN (min_by(level, ratio) FILTER (level < ratio) OVER ()) * weight ELSE cap END AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - ahead)) AS BIGINT) AS taken
FROM r"""

_KEY = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER p" for k in range(1, 13))])
_REPEATS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
k AS (SELECT doc_id, i, {_KEY} AS key FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT key, min(doc_id) AS least FROM k WHERE key IS NOT NULL GROUP BY key),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM k JOIN f USING (key) WHERE least < doc_id),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_BYTES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200),
h AS (SELECT r, i, hash(b[i + 1 : i + 200]) AS h FROM w JOIN d USING (r)),
twice AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
run AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g
        FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -999) AS before FROM twice)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY r, g),
per AS (SELECT r, sum(z - a)::BIGINT AS gone, count(*) AS n, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM spans GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(range(0, n + 1), lambda k: b[CASE WHEN k = 0 THEN 1 ELSE ends[k] + 1 END : CASE WHEN k = n THEN octet_length(b) ELSE starts[k + 1] END]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN per USING (r)"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(c.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

#: quality.py's phrases, with the pattern's own characters as they are.
_PHRASES = quality.BOILERPLATE.replace("'", "''")
_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS k FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM g WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
repeated AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM d),
x AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
y AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY r, line ORDER BY j) > 1 AS again,
  len(list_filter(ws, lambda v: v IN ('|', '>', '/', '::', '»', '•', '·'))) AS marks, len(list_filter(ws, lambda v: regexp_matches(v, '[#*$%&|<>]|!!|\?\?|\.\.\.\.'))) AS noisy,
  len(list_filter(ws, lambda v: regexp_matches(v, '[A-Z]') AND NOT regexp_matches(v, '[a-z]') AND strlen(v) > 1)) AS loud FROM x WHERE len(ws) > 0),
z AS (SELECT r, n, again, again OR (marks >= 3 AND marks >= 0.2::DOUBLE * n) OR noisy > 0.3::DOUBLE * n
  OR (n >= 4 AND 3 * strlen(regexp_replace(line, '[A-Z]', '', 'g')) < 2 * strlen(line) AND loud > 0.6::DOUBLE * n)
  OR (n >= 8 AND NOT regexp_matches(ws[n], '[.!?:;…。！？"''”’»)\]]$') AND NOT contains(line, '.'))
  OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PHRASES}') AS gone FROM y),
s AS (SELECT r, count(*) FILTER (again) AS dup, coalesce(sum(n) FILTER (gone), 0) AS lost FROM z GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN s USING (r))
SELECT * EXCLUDE (lost), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.4::DOUBLE * n_words AS kept FROM m"""

_DISTANCE = " + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, 5))


def _round(n: int) -> str:
    """Assign by the codebooks c{n}, and move them to c{n + 1}."""
    mean = ", ".join(f"floor(sum(x[{k}]) / count(*)::DOUBLE)::BIGINT" for k in range(1, 5))
    return f"""a{n} AS (SELECT vec_id, label, part, x, min(({_DISTANCE}) * 64 + entry) AS best FROM p JOIN c{n} USING (part) GROUP BY ALL),
m{n} AS (SELECT part, best % 64 AS entry, [{mean}] AS c FROM a{n} GROUP BY ALL),
c{n + 1} AS (SELECT part, entry, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (part, entry))"""


#: For ids that are unique and vectors of 64 components.
_CODES = f"""
WITH p AS (
  SELECT vec_id, label, part, list_transform(embedding[part * 4 + 1 : part * 4 + 4], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings, range(16) r(part)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 64),
{_round(0)},
{_round(1)},
f AS (SELECT vec_id, label, part, min(({_DISTANCE}) * 64 + entry) AS best FROM p JOIN c2 USING (part) GROUP BY ALL),
v AS (SELECT vec_id, label, lower(string_agg(printf('%02x', best % 64), '' ORDER BY part)) AS code, sum(best // 64)::BIGINT AS error FROM f GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM v"""

_PHRASES = "\n  UNION ALL ".join(f"SELECT lang, {k} AS size, array_to_string(w[i : i + {k - 1}], ' ') AS phrase FROM p, unnest(range(1, len(w) - {k - 2})) s(i)" for k in range(1, 5))
_COLLOCATIONS = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
g AS ({_PHRASES}),
t AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 : c.size], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, a, array_to_string(string_split(phrase, ' ')[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, phrase, size, f AS a, unnest(range(2, size)) AS k FROM f WHERE size > 2), unnest(range(1, size - k + 2)) q(i)),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, n, score
FROM low LEFT JOIN around o ON o.lang = low.lang AND o.phrase = low.phrase JOIN t ON t.lang = low.lang
WHERE coalesce(100 * o.most < 80 * a, true)
QUALIFY rank <= 2000"""

_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often o ON k.key = o.key GROUP BY r, doc_id"""

ORACLES: dict[str, str] = {
    "op1_url_filter": _URL,
    "op2_chat_format": _CHAT,
    "op3_recompression": _REPEATS,
    "op4_source_mix": _MIX,
    "op5_kd_top_k": _TOP_K,
    "op6_quality_rules": _RULES,
    "op9_suffix_dedup": _BYTES,
    "op11_vector_codes": _CODES,
    "op12_collocations": _COLLOCATIONS,
    "op13_line_dedup": _LINES,
}
