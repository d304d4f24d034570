"""DuckDB twins of the operators that SQL can express.

Tokenizers, XXH64 fingerprints, differencing and page templates are not SQL;
tests/llm hold those operators against brute force.
"""

from __future__ import annotations

from . import hard_negatives, mixing, queries, quality_rules, voronoi_knn

BLANKS = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    checks = []
    for r in quality_rules.RULES:
        under = r.denominator or "1"
        ok = [f"{r.numerator} >= {r.low!r}::DOUBLE * {under}" if r.low is not None else "true",
              f"{r.numerator} <= {r.high!r}::DOUBLE * {under}" if r.high is not None else "true"]
        other = f" OR NOT coalesce(lang IN ({', '.join(map(repr, r.langs))}), false)" if r.langs else ""
        checks.append((r.name, f"(({' AND '.join(ok)}) OR {under} = 0 OR n_words < {r.from_words}{other})"))
    failed = ", ".join(f"CASE WHEN NOT {ok} THEN '{name}' END" for name, ok in checks)
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{BLANKS}') AS ws
  FROM documents),
grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n
  FROM (SELECT r, i, ws[i:i + 4] AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM grams, range(0, 5) AS offsets(k) WHERE n > 1 GROUP BY r),
lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{BLANKS}')) AS l FROM w),
stats AS (
  SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(l) AS n_lines
  FROM w JOIN lines USING (r) LEFT JOIN covered USING (r)),
base AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS}
            OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM stats)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_stop_words::BIGINT AS n_stop_words, n_lines::BIGINT AS n_lines, base_failed,
       NOT base_failed AND {' AND '.join(ok for _, ok in checks)} AS kept,
       concat_ws(',', {failed}) AS failed_rules
FROM base"""


def _mixing() -> str:
    weights, cap, bits = mixing.WEIGHTS, mixing.MAX_COPIES, 1 << 4 * mixing.HEX_DIGITS
    cycle = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '{BLANKS}'))::BIGINT AS size FROM documents),
leveled AS (
  SELECT *, CASE WHEN size < {mixing.SHORT_WORDS} THEN {mixing.LEVELS[1]} ELSE {mixing.LEVELS[0]} END AS level FROM d),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS n FROM d GROUP BY source),
weighted AS (SELECT *, (CASE n % {len(weights)} {cycle} END)::DOUBLE AS w FROM sources),
run AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / w, n {running}), 0)::BIGINT AS size_before,
         coalesce(sum(w) OVER (ORDER BY source_size / w, n {running}), 0)::DOUBLE AS w_before,
         (sum(source_size) OVER ())::BIGINT AS size_all, sum(w) OVER () AS w_all,
         row_number() OVER (ORDER BY source_size / w, n) AS place
  FROM weighted),
rated AS (
  SELECT *, (size_all * {mixing.SHARE_PERCENT} / 100.0::DOUBLE - {cap} * size_before) / (w_all - w_before) AS rate FROM run),
capped AS (SELECT *, rate * w >= ({cap} * source_size)::DOUBLE AS is_capped FROM rated),
final AS (SELECT arg_min(rate, place) AS rate FROM capped WHERE NOT is_capped),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN ({cap} * source_size)::DOUBLE ELSE (SELECT rate FROM final) * w END AS target
  FROM capped),
levels AS (
  SELECT source, level, sum(size)::BIGINT AS level_size FROM leveled WHERE size > 0 GROUP BY source, level),
level_rates AS (
  SELECT l.source, level,
         (target - {cap} * coalesce(sum(level_size) OVER (PARTITION BY l.source ORDER BY level DESC {running}), 0)::BIGINT)
         / (sum(level * level_size) OVER (PARTITION BY l.source ORDER BY level DESC
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rate
  FROM levels l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source),
rates AS (
  SELECT source, coalesce(arg_max(rate, level) FILTER (WHERE rate * level <= {cap}), {cap})::DOUBLE AS rate
  FROM level_rates GROUP BY source),
drawn AS (
  SELECT e.*, t.source_size, t.target, least({float(cap)!r}::DOUBLE, q.rate * level) AS copies,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, {mixing.HEX_DIGITS}))::BIGINT::DOUBLE
          + 0.5::DOUBLE) / {bits}::DOUBLE AS u
  FROM leveled e JOIN targets t ON e.source IS NOT DISTINCT FROM t.source
  LEFT JOIN rates q ON e.source IS NOT DISTINCT FROM q.source),
ranked AS (
  SELECT *, floor(copies)::INTEGER AS whole, copies - floor(copies) AS p,
         u * (1.0::DOUBLE - (copies - floor(copies)))
         / (u * (1.0::DOUBLE - (copies - floor(copies))) + (1.0::DOUBLE - u) * (copies - floor(copies))) AS pos
  FROM drawn WHERE size > 0),
units AS (
  SELECT source, pos, coalesce(doc_id::VARCHAR, '') AS k, sum(size)::BIGINT AS unit_size
  FROM ranked GROUP BY source, pos, coalesce(doc_id::VARCHAR, '')),
needs AS (SELECT source, any_value(target) - sum(size * whole)::BIGINT AS need FROM ranked GROUP BY source),
placed AS (
  SELECT u.*, need, (sum(unit_size) OVER (PARTITION BY u.source ORDER BY pos, k
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM units u JOIN needs n ON u.source IS NOT DISTINCT FROM n.source),
taken AS (SELECT source, pos, k FROM placed WHERE upto - need <= need - (upto - unit_size)),
chosen AS (
  SELECT r.r, least(whole + CASE WHEN t.pos IS NULL THEN 0 ELSE 1 END, {cap}) AS n
  FROM ranked r LEFT JOIN taken t ON r.source IS NOT DISTINCT FROM t.source AND r.pos = t.pos
                                     AND coalesce(r.doc_id::VARCHAR, '') = t.k)
SELECT doc_id, size, source_size, target, (size * coalesce(n, 0))::BIGINT AS taken
FROM drawn LEFT JOIN chosen USING (r)"""


def _top_k() -> str:
    finite = "list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))"
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor({voronoi_knn.SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite}),
scores AS (
  SELECT q.r AS q_row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {queries.EVERY_QUERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= {voronoi_knn.K}"""


def _hard_negatives() -> str:
    h = hard_negatives
    finite = "list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))"
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({h.SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {finite}),
scores AS (
  SELECT a.r AS a_row, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same,
         list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % {h.ANCHOR_EVERY} = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id, r) AS place
  FROM scores WHERE same),
found AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
         n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a_row, p.r ORDER BY n.score DESC, n.vec_id, n.r) AS rank
  FROM positives p JOIN scores n USING (a_row)
  WHERE place <= {h.POSITIVES} AND NOT n.same
    AND {h.LOW}::HUGEINT * p.score <= 100::HUGEINT * n.score
    AND 100::HUGEINT * n.score <= {h.HIGH}::HUGEINT * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= {h.NEGATIVES}"""


SQL: dict[str, str] = {
    "op5_exact_top_k": _top_k(),
    "op6_quality_rules": _quality(),
    "op8_mixing": _mixing(),
    "op11_hard_negatives": _hard_negatives(),
}
