"""The same rows as SQL, where it can express an operator."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op11_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
far AS (
  SELECT n.anchor_id, n.positive_id, n.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY n.anchor_id, n.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM near n JOIN scored s ON s.anchor_id = n.anchor_id AND NOT s.same
    AND 50 * n.positive_score <= 100 * s.score AND 100 * s.score <= 95 * n.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM far WHERE rank <= 3
"""

ORACLES["op12_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS lines,
    regexp_replace(coalesce(text, ''), '[\p{Ll}\p{Lm}\p{Lo}\p{Lt}\p{M}\x20\x09-\x0D]+', '', 'g') AS rest
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(words, i, i + 7)) AS n
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
repeated AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(rest) - length(regexp_replace(rest, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(rest) - length(regexp_replace(rest, '[0-9]', '', 'g')) AS n_digits,
    length(regexp_replace(rest, '\p{Lu}', '', 'g')) AS others, length(rest) AS n_rest,
    len(list_filter(lines, lambda v: regexp_matches(v, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda v: regexp_matches(v, '^\s*[-*•]'))) AS n_bullet_lines
  FROM d LEFT JOIN repeated USING (r)),
bits AS (
  SELECT *, CAST(CASE WHEN n_words = 0 THEN 1 ELSE
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
    + CASE WHEN 10 * word_chars < 22 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 14 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 64 ELSE 0 END
    + CASE WHEN 100 * (word_chars - others) < 60 * word_chars THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_digits > 30 * word_chars THEN 256 ELSE 0 END
    + CASE WHEN 100 * (n_rest - others) > 50 * word_chars THEN 512 ELSE 0 END
    + CASE WHEN n_lines > 1 AND 100 * n_ellipsis_lines > 30 * n_lines THEN 1024 ELSE 0 END
    + CASE WHEN n_lines > 1 AND 100 * n_bullet_lines > 90 * n_lines THEN 2048 ELSE 0 END
    END AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM bits
"""
