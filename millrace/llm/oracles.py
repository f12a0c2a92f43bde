"""The queries that SQL can express, as SQL for DuckDB. White space and letters are those of the operators' contracts."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"



def _apportioned(name: str, parts: str, part: str, votes: str, among: str) -> str:
    """SQL of the seats ``blocks`` of each group, dealt by the highest quotients: the table ``name`` of (number, part, won)."""
    return f"""
{name}_all AS (SELECT *, sum(CAST({votes} AS DOUBLE)) OVER (PARTITION BY {among}) AS v, count(*) OVER (PARTITION BY {among}) AS n FROM {parts} WHERE {votes} > 0),
{name}_claims AS (
  SELECT {among} AS g, {part} AS p, {votes} AS votes, blocks, unnest(range(1, CAST(floor({votes} * (blocks + n / 2.0 + 1) / v + 0.5) AS BIGINT) + 1)) AS k FROM {name}_all),
{name}_places AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY CAST(votes AS DOUBLE) / (2 * k - 1) DESC, p) AS place FROM {name}_claims),
{name} AS (SELECT g, p, count(*) AS won FROM {name}_places WHERE place <= blocks GROUP BY g, p)"""


SOURCE_MIXING = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM src),
weighed AS (SELECT *, 1 + (number - 1) % 3 AS weight FROM numbered),
levels AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goal AS (
  SELECT number, 0 AS whole, source, source_size, least(CAST(3 * source_size AS DOUBLE), max(CASE WHEN level * weight <= 3 * source_size THEN level END) OVER () * weight) AS target,
    CAST(sum(source_size) OVER () + 4 AS BIGINT) // 8 AS blocks FROM levels),{_apportioned("of_sources", "goal", "number", "target", "whole")},
dealt AS (
  SELECT d.*, number, source_size, target, coalesce(won, 0) AS blocks, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % (1 + source_size // 1048576) AS shard
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN of_sources ON p = number),
shards AS (SELECT number, shard, CAST(sum(size) AS BIGINT) AS words, any_value(blocks) AS blocks FROM dealt GROUP BY number, shard),{_apportioned("of_shards", "shards", "shard", "words", "number")},
placed AS (
  SELECT d.*, words, least(coalesce(won, 0) * 8, 3 * words) AS quota, CAST(sum(size) OVER (PARTITION BY d.number, d.shard ORDER BY o, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
  FROM dealt d JOIN shards s ON s.number = d.number AND s.shard = d.shard LEFT JOIN of_shards ON g = d.number AND p = d.shard)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN words > 0 THEN quota // words ELSE 0 END * size + greatest(0, least(quota - CASE WHEN words > 0 THEN quota // words ELSE 0 END * words - before, size)) AS BIGINT) AS taken
FROM placed"""

QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], chr(1)) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha_words, len(list_filter(ws, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) > 1 AND NOT regexp_matches(x, '[a-z]|[^\x00-\x7F]'))) AS n_upper_words
  FROM w LEFT JOIN covered USING (doc_id)),
d AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines FROM m),
b AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END + CASE WHEN 100 * n_alpha_words < 60 * n_words THEN 64 ELSE 0 END + CASE WHEN 2 * n_upper_words > n_words THEN 128 ELSE 0 END AS INTEGER) AS mask FROM d)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, mask & 3 <> 0 AS base_failed, mask = 0 AS kept, mask FROM b"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, chr(1))] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], chr(1))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.c)
SELECT reach.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY reach.doc_id"""
