"""DuckDB SQL for the queries that SQL can express."""

from .rules import GOOD_SHARE, PRIOR_VOTES, RIGHT_ON_GOOD, RIGHT_ON_OTHER, RIGHT_ON_OWN, ROUNDS, RULES

SQL: dict[str, str] = {}

SQL["op3_chat_format"] = """
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
prefixes AS (
  SELECT conv_id, pos, n, string_agg(
           CASE WHEN role IS NULL THEN 'n' ELSE 'r' || length(role) || ':' || role END
           || CASE WHEN text IS NULL THEN 'n' ELSE 't' || length(text) || ':' || text END, '')
         OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM turns),
finals AS (
  SELECT so_far, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixes WHERE pos = n GROUP BY so_far, n),
kept AS (
  SELECT conv_id, n, n_copies FROM finals f
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos < p.n AND p.pos = f.n AND p.so_far = f.so_far))
SELECT k.conv_id, any_value(k.n) AS n_turns, any_value(k.n_copies) AS n_copies,
       string_agg('<|im_start|>' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || chr(10)
                  || replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
FROM kept k JOIN turns t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id
"""

# Any line but an empty one goes if an earlier one is equal. Of two lines of 10 or more characters one edit apart, the first or the last five agree.
SQL["op4_line_dedup"] = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, generate_subscripts(a, 1) AS no, unnest(a) AS line FROM cut),
firsts AS (
  SELECT line, min((doc_id, no)) AS first FROM (SELECT line, doc_id, no FROM lines WHERE length(line) >= 1) GROUP BY line),
long AS (SELECT * FROM firsts WHERE length(line) >= 10),
near AS (
  SELECT DISTINCT b.line FROM long a JOIN long b
    ON left(a.line, 5) = left(b.line, 5) AND abs(length(a.line) - length(b.line)) <= 1 AND a.first < b.first
  WHERE levenshtein(a.line, b.line) <= 1
  UNION
  SELECT DISTINCT b.line FROM long a JOIN long b
    ON right(a.line, 5) = right(b.line, 5) AND abs(length(a.line) - length(b.line)) <= 1 AND a.first < b.first
  WHERE levenshtein(a.line, b.line) <= 1),
marked AS (
  SELECT l.doc_id, l.no, l.line, coalesce(f.first <> (l.doc_id, l.no), false) OR n.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near n ON n.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Lloyd's rounds one after another; whole numbers throughout. x - mod(mod(x, n) + n, n) is n times the floor of x / n.
_LLOYD = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, v) - 1 AS cluster, v
  FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('2:' || vec_id), vec_id, v LIMIT 40)"""
_LLOYD_ROUND = """,
a{now} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((distance, cluster)) AS best
  FROM (SELECT k.row, k.vec_id, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
        FROM kept k CROSS JOIN c{now} c)
  GROUP BY row)"""
_LLOYD_MOVE = """,
s{now} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT best[2] AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{now}) GROUP BY cluster, i),
c{next} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{now} c
  LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{now} GROUP BY cluster) m USING (cluster))"""
SQL["op11_lloyd"] = _LLOYD + "".join(_LLOYD_ROUND.format(now=i) + _LLOYD_MOVE.format(now=i, next=i + 1) for i in range(5)) + _LLOYD_ROUND.format(now=5) + """
SELECT a.vec_id, a.best[2]::INT AS cluster, a.best[1] AS distance, sum(a.best[1]) OVER (PARTITION BY a.best[2])::BIGINT AS cluster_inertia,
       sum(a.best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 a JOIN c5 c ON c.cluster = a.best[2]
"""

# Rules as rows: the votes of each document, distinct vote patterns, then rounds of expectation and maximisation.
_W = r"[^\x20\x09-\x0D]+"
_VOTES = ", ".join(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END" for good, bad in RULES.values())
_RULES = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT row, regexp_extract_all(text, '{_W}') AS ws FROM t)),
grams AS (
  SELECT * FROM (SELECT row, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY row ORDER BY pos))
  WHERE gram IS NOT NULL),
again AS (SELECT row, pos FROM (SELECT row, pos, count(*) OVER (PARTITION BY row, gram) AS times FROM grams) WHERE times > 1),
held AS (SELECT row, count(DISTINCT pos + i) AS n FROM again, range(3) r(i) GROUP BY row),
words AS (SELECT row, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY row),
lines AS (SELECT row, count(*) AS n, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (WHERE regexp_matches(line, '[.!?…。！？]["''»”)\\]]*[ \\t-\\r]*$')) AS ended
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_W}') GROUP BY row),
measured AS (
  SELECT t.row, doc_id, coalesce(w.n, 0) AS n_words, coalesce(w.chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '\\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^\\p{{Lu}}\\p{{Ll}}]+', '', 'g')) AS n_cased, coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines,
         coalesce(l.ended, 0) AS n_ended, coalesce(h.n, 0) AS n_repeat_words
  FROM t LEFT JOIN words w USING (row) LEFT JOIN lines l USING (row) LEFT JOIN held h USING (row)),
voted AS MATERIALIZED (SELECT *, [{_VOTES}] AS votes FROM measured),
pattern AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted GROUP BY votes),
votes AS MATERIALIZED (SELECT votes, n, unnest(votes) AS vote, generate_subscripts(votes, 1) AS rule FROM pattern),
k0 AS MATERIALIZED (
  SELECT kind, rule, CASE WHEN kind = 0 THEN {GOOD_SHARE} ELSE (1 - {GOOD_SHARE}) / {len(RULES)} END::DOUBLE AS share,
         CASE WHEN kind = 0 THEN {RIGHT_ON_GOOD} WHEN kind = rule THEN {RIGHT_ON_OWN} ELSE {RIGHT_ON_OTHER} END::DOUBLE AS correct
  FROM range({len(RULES) + 1}) k(kind), range(1, {len(RULES) + 1}) r(rule))"""
_EXPECTED = """,
l{now} AS (
  SELECT votes, kind, any_value(n) AS n, ln(any_value(share)) + sum(CASE WHEN vote = 0 THEN 0 WHEN (vote > 0) = (kind = 0) THEN ln(correct) ELSE ln(1 - correct) END) AS l
  FROM votes JOIN k{now} USING (rule) GROUP BY votes, kind),
e{now} AS (SELECT votes, kind, n, exp(l - max(l) OVER (PARTITION BY votes)) AS odds FROM l{now}),
p{now} AS MATERIALIZED (SELECT votes, kind, n, odds / sum(odds) OVER (PARTITION BY votes) AS p FROM e{now})"""
_MAXIMISED = f""",
s{{now}} AS (SELECT kind, sum(n * p) AS s, sum(sum(n * p)) OVER () AS total FROM p{{now}} GROUP BY kind),
k{{next}} AS MATERIALIZED (
  SELECT k.kind, k.rule, any_value((s.s + {PRIOR_VOTES} * k.share) / (s.total + {PRIOR_VOTES})) AS share,
         (sum(CASE WHEN v.vote <> 0 AND (v.vote > 0) = (k.kind = 0) THEN v.n * p.p ELSE 0 END) + {PRIOR_VOTES} * any_value(k.correct))
         / (sum(CASE WHEN v.vote <> 0 THEN v.n * p.p ELSE 0 END) + {PRIOR_VOTES}) AS correct
  FROM k0 k JOIN votes v USING (rule) JOIN p{{now}} p ON p.votes = v.votes AND p.kind = k.kind JOIN s{{now}} s ON s.kind = k.kind
  GROUP BY k.kind, k.rule)"""
SQL["op13_quality_rules"] = _RULES + "".join(
    _EXPECTED.format(now=i) + _MAXIMISED.format(now=i, next=i + 1) for i in range(ROUNDS)) + _EXPECTED.format(now=ROUNDS) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p >= 0.5 AS kept
FROM voted JOIN p{ROUNDS} USING (votes) WHERE kind = 0
"""
