"""SQL over the same tables for the queries that have an exact answer."""

from __future__ import annotations

from paceframe.llm import licenses
from paceframe.llm import quality_rules as quality

ORACLE: dict[str, str] = {}

ORACLE["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
      FROM d)
"""


def quality_sql(source: str, columns: str, false_rejection: float = 0.02, error: float = 0.05, min_bad_share: float = 0.9) -> str:
    """The verdicts on the rows of ``source``; ``columns`` are selected from them (alias ``v``)."""
    rate = false_rejection / len(quality.RULES)
    scores = ", ".join(
        f"CASE WHEN {whole} > 0 THEN least({top}, {part} * {top} // {whole}) ELSE 0 END AS {rule}"
        for rule, (part, whole, top) in quality.RULES.items()
    )
    values = " UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {r} AS value FROM labelled" for r in quality.RULES)
    fails = ", ".join(
        f"CASE WHEN {r} >= coalesce((SELECT cutoff FROM cutoffs c WHERE c.rule = '{r}' AND c.stratum = "
        f"coalesce(lang, '*')), 2147483647) THEN '{r}' END"
        for r in quality.RULES
    )
    return rf"""
WITH w AS (
  SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t,
         [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0] AS ls
  FROM {source}),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(i - before, 8)))::BIGINT AS n
        FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
c AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims
  FROM w LEFT JOIN rep USING (rid)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {scores} FROM c),
verdicts AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT coalesce(lang, '*') AS stratum, good, s.* EXCLUDE (lang) FROM s JOIN verdicts USING (doc_id) WHERE NOT base_failed),
vals AS ({values}),
cum AS (SELECT stratum, rule, value, sum(count(*) FILTER (good)) OVER up AS g, sum(count(*) FILTER (NOT good)) OVER up AS b
        FROM vals GROUP BY stratum, rule, value WINDOW up AS (PARTITION BY stratum, rule ORDER BY value DESC)),
sizes AS (SELECT stratum, rule, count(*) FILTER (good) AS n FROM vals GROUP BY stratum, rule),
terms AS (SELECT stratum, rule, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({rate}) + (n - k) * ln(1 - {rate})) AS p
          FROM (SELECT *, unnest(range(0, greatest(1, ceil(n * {rate})::BIGINT) + 1)) AS k FROM sizes) WHERE k <= n),
allowed AS (SELECT stratum, rule, max(k) FILTER (total <= {error} / (SELECT count(DISTINCT stratum) FROM vals) / {len(quality.RULES)}) AS k
            FROM (SELECT *, sum(p) OVER (PARTITION BY stratum, rule ORDER BY k) AS total FROM terms) GROUP BY stratum, rule),
cutoffs AS (SELECT stratum, rule, min(value) AS cutoff FROM cum JOIN allowed USING (stratum, rule)
            WHERE value >= 1 AND g <= k AND b > 0 AND b >= {min_bad_share} * (g + b) GROUP BY stratum, rule),
v AS (SELECT *, concat_ws(',', {fails}) AS rejected_by FROM s)
SELECT {columns} FROM v
"""


ORACLE["op7_quality_rules"] = quality_sql(
    "documents",
    "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
    "NOT base_failed AND rejected_by = '' AS kept, rejected_by",
)


def mixing_sql(entropy_share: float = 0.95, max_epochs: float = 4.0, budget_share: float = 1.0, seed: str = "mix") -> str:
    def key(*parts: str) -> str:
        return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 15) AS BIGINT)"

    def power(p: str) -> str:
        return f"list_sum([pow(x, {p}) FOR x IN ps])"

    def entropy(p: str) -> str:
        return f"(ln({power(p)}) - {p} * list_sum([pow(x, {p}) * ln(x) FOR x IN ps]) / {power(p)})"

    def repeated(p: str) -> str:
        return f"({budget_share} * pow(list_min(ps), {p} - 1) / {power(p)})"

    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS src,
         len([x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''])::BIGINT AS n_tokens
  FROM documents),
sizes AS (SELECT src, count(*) AS n_docs, sum(n_tokens)::BIGINT AS t FROM d GROUP BY src HAVING sum(n_tokens) > 0),
shares AS (SELECT list(t / total ORDER BY t) AS ps, any_value(total) AS total FROM sizes, (SELECT sum(t)::BIGINT AS total FROM sizes)),
bis AS (
  SELECT 0 AS i, ps, 0.0::DOUBLE AS hl, 1.0::DOUBLE AS hh, 0.0::DOUBLE AS rl, 1.0::DOUBLE AS rh FROM shares
  UNION ALL
  SELECT i + 1, ps, CASE WHEN flat THEN h ELSE hl END, CASE WHEN flat THEN hh ELSE h END,
         CASE WHEN seldom THEN rl ELSE r END, CASE WHEN seldom THEN r ELSE rh END
  FROM (SELECT *, {entropy('h')} >= {entropy_share} * ln(len(ps)) AS flat, {repeated('r')} <= {max_epochs} AS seldom
        FROM (SELECT *, (hl + hh) / 2 AS h, (rl + rh) / 2 AS r FROM bis WHERE i < 50))),
alpha AS (SELECT ps, greatest(CASE WHEN {entropy('1.0')} >= {entropy_share} * ln(len(ps)) THEN 1.0 ELSE hl END,
                              CASE WHEN {repeated('0.0')} <= {max_epochs} THEN 0.0 ELSE rh END) AS a FROM bis WHERE i = 50),
s AS (SELECT src, least(65536, ceil(n_docs / 1024))::BIGINT AS n_blocks, t, budget // t AS epochs, budget % t AS rest
      FROM (SELECT sizes.*, floor(pow(t / total, a) / {power('a')} * floor(total * {budget_share}::DOUBLE))::BIGINT AS budget
            FROM sizes, (SELECT total FROM shares), alpha)),
placed AS (SELECT d.*, {key('doc_id')} % n_blocks AS block FROM d JOIN s USING (src)),
blocks AS (SELECT src, block, sum(n_tokens)::BIGINT AS n, any_value(epochs) AS epochs, any_value(rest) AS rest
           FROM placed JOIN s USING (src) GROUP BY src, block),
ep AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM blocks),
ranked AS (SELECT *, row_number() OVER o AS block_place, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
           FROM (SELECT *, {key('src', 'epoch', 'block')} AS bk FROM ep) WINDOW o AS (PARTITION BY src, epoch ORDER BY bk, block)),
uses AS (SELECT *, epoch < epochs OR upto <= rest AS whole FROM ranked WHERE epoch < epochs OR upto - n < rest),
pairs AS (SELECT p.doc_id, p.source, p.n_tokens, u.epoch, u.block_place, u.whole, u.rest - u.upto + u.n AS room, p.src, p.block,
                 {key('u.epoch', 'p.doc_id')} AS key
          FROM placed p JOIN uses u USING (src, block))
SELECT doc_id, source, n_tokens, epoch, block_place, key
FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY src, block, epoch ORDER BY key) AS fits FROM pairs)
WHERE whole OR fits <= room
"""


ORACLE["op2_temperature_mixing"] = mixing_sql()


def license_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    templates = [*licenses.TEMPLATES, *licenses.NOTICES]
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    words = "[x FOR x IN string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' ') IF x <> '']"

    def runs(source: str, keys: str, size: str) -> str:
        return (
            f"SELECT DISTINCT {keys}, {size} AS size, array_to_string(list_slice(w, i, i + {size} - 1), ' ') AS s "
            f"FROM (SELECT {keys}, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM {source} WHERE len(w) >= {size})"
        )

    # A template has runs of five words, or is one run itself; a text has runs of every length.
    of_template = " UNION ALL ".join(
        runs(f"(SELECT * FROM tw WHERE len(w) {'>=' if n == 5 else '='} {n})", "template, license", str(n)) for n in range(1, 6)
    )
    of_text = " UNION ALL ".join(runs("dw", "rid, doc_id", str(n)) for n in range(1, 6))
    return f"""
WITH t(template, license, text) AS (VALUES {values}),
tw AS (SELECT *, {words} AS w FROM t),
ts AS ({of_template}),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
ds AS ({of_text}),
sizes AS (SELECT template, count(*) AS n_shingles FROM ts GROUP BY template)
SELECT doc_id, license, template, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM ts JOIN ds USING (size, s) JOIN sizes USING (template)
GROUP BY rid, doc_id, license, template HAVING count(*) * 100 >= any_value(n_shingles) * 80
"""


ORACLE["op6_license_scan"] = license_sql()


ORACLE["op12_hard_negatives"] = """
WITH given AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
    CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, r.q)]) AS BIGINT) AS score
  FROM given a JOIN given r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

# The cheapest repair as a walk through the states of the grammar: '' before any turn, else the
# initial of the last one. Each step takes a row and then inserts what is useful.
ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE white AS (SELECT chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' AS w),
named AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(
      flatten([[(CAST(ascii(substr(name, CAST(i AS BIGINT), 1)) AS BIGINT) >> CAST(k AS BIGINT)) & 1 FOR k IN range(0, 8)] FOR i IN range(1, len(name) + 1)]),
      lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fault
  FROM named),
hurt AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE fault <> 0),
placed AS (
  SELECT conv, turn, role, text, left(role, 1) AS initial, rtrim(text, w) AS body,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM hurt, white),
marked AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS duplicate,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair
  FROM placed),
faulty AS (SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM marked),
steps(st, initial, nxt) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts(st, nxt, cost, audit, made) AS (VALUES
  ('', '', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('', 'u', 2, 'I', 'user:'), ('', 'a', 4, 'II', 'user:' || chr(10) || 'assistant:'),
  ('s', 'u', 2, 'I', chr(10) || 'user:'), ('s', 'a', 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'a', 2, 'I', chr(10) || 'assistant:'), ('a', 'u', 2, 'I', chr(10) || 'user:')),
edits AS (
  SELECT conv, i, st, st AS nxt, 3 AS cost, 'D' AS audit, '' AS made FROM faulty, (VALUES (''), ('s'), ('u'), ('a')) v(st)
  UNION ALL
  SELECT conv, i, st, nxt, CAST(truncated AS INTEGER), 'K', CASE WHEN st = '' THEN '' ELSE chr(10) END || role || ':' || text
  FROM faulty JOIN steps USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL
  SELECT conv, i, st, nxt, 2 + CAST(truncated AS INTEGER), 'R',
    CASE WHEN st = '' THEN '' ELSE chr(10) END || CASE steps.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text
  FROM faulty, steps WHERE steps.initial <> 's' AND NOT blank AND NOT duplicate),
walk AS (
  SELECT conv, 0 AS i, nxt AS st, {'cost': cost, 'audit': audit, 'made': made} AS best
  FROM (SELECT DISTINCT conv FROM placed), inserts WHERE st = ''
  UNION ALL
  SELECT e.conv, e.i, n.nxt, min({'cost': w.best.cost + e.cost + n.cost, 'audit': w.best.audit || e.audit || n.audit, 'made': w.best.made || e.made || n.made})
  FROM walk w JOIN edits e ON e.conv = w.conv AND e.i = w.i + 1 AND e.st = w.st JOIN inserts n ON n.st = e.nxt
  GROUP BY e.conv, e.i, n.nxt),
counts AS (
  SELECT conv, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv),
ended AS (
  SELECT conv, min(best) AS best FROM walk JOIN counts USING (conv) WHERE walk.i = counts.n AND st IN ('', 'a') GROUP BY conv),
ids AS (SELECT DISTINCT conv_id, conv FROM named)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(best.made, '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (conv) LEFT JOIN ended USING (conv)
"""
