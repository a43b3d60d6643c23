"""The queries that SQL can express, for DuckDB.  The others are tested against plain versions."""

from __future__ import annotations

from . import quality, urlfilter

W = r"[^\x20\x09-\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{W}')"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, line, regexp_extract_all(line, '{W}') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (SELECT doc_id, line, len(w) AS n, CASE WHEN len(w) = 0 THEN FALSE
  WHEN len(regexp_extract_all(line, '[{quality.SEPARATORS}]')) * 4 >= len(w) THEN TRUE
  WHEN len(regexp_extract_all(line, '[{quality.SYMBOLS}]')) * 2 > len(w) THEN TRUE
  WHEN len(w) >= 3 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}') OR len(line) - len(replace(line, '!!', '')) > len(w) THEN TRUE
  WHEN len(w) >= 20 AND len(list_distinct(w)) * 4 < len(w) THEN TRUE
  WHEN right(rtrim(line), 1) NOT IN ({_quoted(quality.ENDINGS)}) AND NOT (len(w) > 5 AND regexp_matches(line, '[.!?] ')) THEN TRUE
  WHEN len(w) < 30 AND len(list_filter([{_quoted(quality.BOILERPLATE)}], lambda p: contains(lower(line), p))) > 0 THEN TRUE ELSE FALSE END AS fails FROM lines),
by_line AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS n_clean_words FROM judged GROUP BY doc_id),
counts AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[{quality.SYMBOLS}]')) AS n_symbols,
  n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(n_clean_words AS BIGINT) AS n_clean_words FROM d LEFT JOIN repeats USING (doc_id) JOIN by_line USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_clean_words >= n_words * (1 - 0.4) AS kept FROM counts"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAIL = lambda h, k: f"array_to_string(string_split({h}, '.')[-{k}:], '.')"
_LONG = f"({_quoted(urlfilter.LONG_SUFFIXES)})"


def _rank(key: str, up: str, parent: str) -> str:
    """CTEs with the posterior of the groups ``key`` of hosts under ``parent`` (``up``, mean)."""
    return f"""{key}_groups AS (SELECT h.{key}, mean, sum(n) AS n, sum(bad) AS bad FROM hosts h JOIN {parent} p ON p.{up} = h.{up} GROUP BY h.{key}, mean),
    {key}_fit AS (SELECT sum(mean * (1 - mean) * n) / sum(n) AS noise, sum(n * (bad / n - mean) * (bad / n - mean)) AS square, count(*) AS g, sum(n) AS total FROM {key}_groups WHERE n > 0),
    {key}_strength AS (SELECT CASE WHEN total > g AND (square - noise * g) / (total - g) > 0 THEN least(greatest(round(noise / ((square - noise * g) / (total - g)) - 1, 6), 1.0), 1000.0) ELSE 1000.0 END AS s FROM {key}_fit),
    {key}_post AS (SELECT {key}, mean * s + bad AS a, (1 - mean) * s + n - bad AS b FROM {key}_groups, {key}_strength)"""


def url_filter(rules: list[urlfilter.Rule], limit: float = 1.0, z: float = 1.0) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in ordered) + " END"
    return f"""WITH parsed AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    named AS (SELECT *, CASE WHEN regexp_full_match(host, '[0-9.:\\[\\]]*') THEN host WHEN {_TAIL('host', 2)} IN {_LONG} THEN {_TAIL('host', 3)} ELSE {_TAIL('host', 2)} END AS domain FROM parsed),
    outcomes AS (SELECT n.*, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS bad FROM named n LEFT JOIN labels ON doc_id = page_id),
    hosts AS (SELECT host, domain, CASE WHEN {_TAIL('domain', 2)} IN {_LONG} AND domain <> {_TAIL('domain', 2)} THEN {_TAIL('domain', 2)} ELSE {_TAIL('domain', 1)} END AS suffix, '' AS root, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM outcomes GROUP BY host, domain),
    tops AS (SELECT root, (sum(bad) + 1) / (sum(n) + 2) AS mean FROM hosts GROUP BY root),
    {_rank('suffix', 'root', 'tops')}, suffixes AS (SELECT suffix, a / (a + b) AS mean FROM suffix_post),
    {_rank('domain', 'suffix', 'suffixes')}, domains AS (SELECT domain, a / (a + b) AS mean FROM domain_post),
    {_rank('host', 'domain', 'domains')}, bounds AS (SELECT host, a / (a + b) AS rate, a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound, mean AS overall FROM host_post, tops)
    SELECT page_id, host, path, {case(lambda r: r.text)} AS rule, coalesce({case(lambda r: r.verdict)}, CASE WHEN round(bound, 9) > round({limit} * overall, 9) THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound FROM parsed JOIN bounds USING (host)"""


SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

HARD_NEGATIVES = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and len(a.q) = len(b.q)),
positives as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score from scored where label = anchor_label and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id) where label <> scored.anchor_label and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""

#: The crc32 is computed from its generator; near words meet on what is left without one code point.
SPELLING = """
with recursive crc(i, k, c) as (
  select i, 0, i::bigint from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
steps as (select list(c order by i) as t from crc where k = 8),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select doc_id, run, count(*) as times, hex(encode(doc_id || ':' || run)) as h from runs where length(run) >= 7 group by all),
hashed as (
  select run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from counted, steps),
changed as (select case when crc % 31 = 0 then left(run, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end as word, times from hashed),
words as (select word, sum(times)::bigint as n from changed where length(word) >= 7 group by word having sum(times) >= 2),
holes as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, a.n, b.word as other, b.n as m from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select w.word, w.n, h.word, h.n from holes h join words w on w.word = h.rest
  union select h.word, h.n, w.word, w.n from holes h join words w on w.word = h.rest),
counts as (select word, count(*) as n_near from near group by word),
forms as (
  select word, other as form, m as form_n from (select *, row_number() over (partition by word order by m desc, other) as k from near) where k = 1 and m >= 10 * n),
chain(word, root) as (
  select word, form from forms
  union all select c.word, f.form from chain c join forms f on f.word = c.root),
roots as (select word, root from chain where root not in (select word from forms))
select w.word, form, coalesce(root, w.word) as root, n, coalesce(n_near, 0) as n_near, form_n
from words w left join counts using (word) left join forms using (word) left join roots using (word)
"""
