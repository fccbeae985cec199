"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""

#: Rows of mixed documents from a table `mixing_input` (doc_id, source, body).
MIXING = """
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM mixing_input),
listed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
levels AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM listed),
rated AS (
  SELECT *, row_number() OVER (ORDER BY level, source NULLS LAST) AS nth,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM levels),
targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(rate, nth) FROM rated WHERE level >= rate)), cap) AS target
  FROM rated),
parts AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
ranked AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS missing,
         CASE WHEN p.source_size > 0 THEN (p.target - p.whole * p.source_size) / p.source_size ELSE 0 END AS part
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT *, (u / (1 - u)) / nullif(part / (1 - part), 0) AS rank FROM ranked),
taken AS (
  SELECT *, rank / (1 + rank) AS position FROM placed),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
         whole::BIGINT + CASE WHEN part > 0 AND sum(size) OVER (PARTITION BY source ORDER BY position)
           - sum(size) OVER (PARTITION BY source, position) / 2.0 <= missing THEN 1 ELSE 0 END AS copies
  FROM taken)
"""

_MIXING_QUERY = (
    "WITH mixing_input AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents)," + MIXING
    + "SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed")


def _listing(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def quality_rules_sql(stop_words) -> str:
    forms = _listing(sorted({f for w in stop_words for f in (w, w.capitalize())}))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
places AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS said
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, said) AS n FROM places) WHERE n > 1),
steps AS (SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS added FROM twice),
repeats AS (SELECT doc_id, sum(added)::BIGINT AS n_repeat_words FROM steps GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({forms}))) AS n_stop,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_again,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•·]'))) AS n_bullets
  FROM w LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_symbols > 0.2::DOUBLE * n_words
            OR (n_words >= 40 AND n_stop / n_words < 0.02::DOUBLE) OR n_repeat_words / n_words > 0.2::DOUBLE
            OR n_again / n_words > 0.3::DOUBLE OR n_dup_lines / n_lines > 0.5::DOUBLE OR (n_words >= 40 AND n_bullets / n_lines > 0.9::DOUBLE)) AS kept
FROM m
"""


def oracle_table() -> dict[str, str]:
    from shoplens.llm.quality_rules import STOP_WORDS

    return {"op3_source_mixing": _MIXING_QUERY, "op4_exact_dedup": _EXACT_DEDUP,
            "op6_quality_rules": quality_rules_sql(STOP_WORDS)}
