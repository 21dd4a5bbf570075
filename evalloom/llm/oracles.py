"""SQL for the queries of this subpackage that SQL can express, on the given tables."""

from __future__ import annotations

from .license_scan import CONFIDENCE, REACH, signatures
from .quality import PATH, RULES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

OP10 = rf"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    item_at AS (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0),
    windows AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM item_at),
    doc_at AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows)),
    hits AS (SELECT d.* FROM (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM doc_at) d SEMI JOIN windows USING (n, g)),
    covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
    named AS (SELECT rid, list_sort(list(DISTINCT item)) AS found FROM hits JOIN windows USING (n, g) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(found), 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


def op5(alpha: float, delta: float) -> str:
    measures = {r: f"({m})" for r, (m, _) in RULES.items()}
    lists = ", ".join(f"[{', '.join(f'count(*) FILTER (WHERE lays AND {measures[r]} > {c}::DOUBLE)' for c in cuts)}] AS k_{r}" for r, (_, cuts) in RULES.items())

    def cut(r: str) -> str:
        values = ", ".join(f"{c}::DOUBLE" for c in RULES[r][1])
        return f"[{values}][nullif(list_position(list_transform(k_{r}, lambda k: k <= share * n), true), 0) + notch] AS cut_{r}"

    steps = ", ".join(f"({t}, {share * alpha!r}::DOUBLE, {notch})" for t, (share, notch) in enumerate(PATH))
    rejects = " OR ".join(f"coalesce({measures[r]} > cut_{r}, false)" for r in RULES)
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
                         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
    places AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM docs WHERE len(ws) >= 8)),
    twice AS (SELECT rid, g FROM places GROUP BY rid, g HAVING count(*) > 1),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM places SEMI JOIN twice USING (rid, g)) GROUP BY rid),
    measured AS (SELECT rid, doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                        len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM docs LEFT JOIN covered USING (rid)),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
    good AS (SELECT j.*, substr(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1') AS lays FROM judged j
              SEMI JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1) g USING (doc_id) WHERE NOT base_failed),
    laid AS (SELECT stratum, count(*) FILTER (WHERE lays) AS n, {lists} FROM good GROUP BY stratum HAVING count(*) FILTER (WHERE lays) > 0),
    steps(step, share, notch) AS (VALUES {steps}),
    settings AS (SELECT stratum, step, {', '.join(cut(r) for r in RULES)} FROM laid CROSS JOIN steps),
    held AS (SELECT stratum, step, count(*) AS n, count(*) FILTER (WHERE {rejects}) AS k FROM good JOIN settings USING (stratum) WHERE NOT lays GROUP BY stratum, step),
    tested AS (SELECT stratum, step, k < n * {alpha!r} AND
               list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha!r}) + (n - j) * ln(1 - {alpha!r}))))
                 <= {delta!r} / (SELECT count(DISTINCT stratum) FROM docs) AS safe FROM held),
    chosen AS (SELECT stratum, coalesce(min(step) FILTER (WHERE NOT safe), {len(PATH)}) - 1 AS step FROM tested GROUP BY stratum),
    rejected AS (SELECT DISTINCT rid FROM judged JOIN settings USING (stratum) JOIN chosen USING (stratum, step) WHERE {rejects})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected.rid IS NULL AS kept
      FROM judged LEFT JOIN rejected USING (rid)"""


# crc32 of the decimal doc_id, bit by bit: each character, then eight shifts; runs from pairs of equal 16-word windows, whose
# places at one distance form stretches
OP11 = r"""
    WITH given AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                          xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                              lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                              lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END)) AS h FROM documents),
    shaped AS (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, h // 10 AS g FROM given),
    texts AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, len(ws)),
                     lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(ws) - a) // (3 + g % 8)) END]) END AS w FROM shaped),
    windows AS (SELECT rid, i, hash(array_to_string(w[i + 1:i + 16], ' ')) AS v, len(w) AS n FROM (SELECT rid, w, unnest(range(0, len(w) - 15)) AS i FROM texts WHERE len(w) >= 24)),
    again AS (SELECT * FROM windows SEMI JOIN (SELECT rid, v FROM windows GROUP BY rid, v HAVING count(*) > 1) USING (rid, v)),
    pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.rid = y.rid AND x.v = y.v AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
    stretches AS (SELECT rid, q, min(i) AS start, max(i) - min(i) + 16 + q AS length FROM
                   (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs) GROUP BY rid, q, island),
    runs AS (SELECT rid, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY rid, start, length),
    told AS (SELECT rid, count(*) AS n_runs, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS digest,
                    first(struct_pack(s := start, l := length, p := period) ORDER BY length / period DESC, start, period) AS top FROM runs GROUP BY rid),
    gone AS (SELECT rid, list(DISTINCT i) AS dropped FROM (SELECT rid, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY rid)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period, (1000 * top.l // top.p)::BIGINT AS exponent_milli,
           coalesce(digest, sha256('')) AS runs_sha256,
           sha256(CASE WHEN dropped IS NULL THEN array_to_string(w, ' ')
                       ELSE array_to_string(list_transform(list_filter(range(0, len(w)), lambda i: NOT list_contains(dropped, i)), lambda i: w[i + 1]), ' ') END) AS collapsed_sha256
      FROM texts LEFT JOIN told USING (rid) LEFT JOIN gone USING (rid)"""


OP13 = r"""
    WITH docs AS (SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    failed AS (SELECT doc_id, part, (len(w) < 50) AS fa, (100 * len(list_distinct(w)) < 65 * len(w)) AS fb,
                      (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
                      coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS fe FROM docs),
    told AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    counted AS (SELECT part, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS bits, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
                  FROM failed LEFT JOIN told USING (doc_id) GROUP BY ALL),
    letters(name, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.own, b.own, c.own, d.own, e.own] AS bits
                 FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.own, b.own, c.own, d.own, e.own])) = 5),
    steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits AS of_order FROM orders),
    placed AS (SELECT filter_order, step, of_order[step] AS own, coalesce(list_sum(of_order[1:step - 1]), 0)::INT AS before FROM steps),
    summed AS (SELECT part, filter_order, step, own, sum(CASE WHEN bits & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                      sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
                      sum(CASE WHEN bits & before <> 0 AND bits & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                      sum(CASE WHEN bits = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
                      sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                      sum(CASE WHEN bits & before = 0 AND bits & own <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
                 FROM counted CROSS JOIN placed GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed"""


def op12() -> str:
    values = ", ".join(f"({i}, '{label}', {level}, {base}, '{word}', '{needs}', '{pattern}')" for i, label, level, base, word, needs, pattern in signatures())
    confidence = ", ".join(repr(c) for c in CONFIDENCE)
    return rf"""
    WITH rules(rule, label, level, base, keyword, needs, pattern) AS (VALUES {values}),
    docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    words AS (SELECT rid, i, w[i + 1] AS keyword, w FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM docs WHERE len(w) > 0)),
    near AS (SELECT rid, i, keyword, concat(' ', array_to_string(list_concat(w[greatest(i - {REACH}, 0) + 1:i], ['<' || keyword || '>'], w[i + 2:i + 1 + {REACH}]), ' '), ' ') AS line
               FROM words SEMI JOIN rules USING (keyword)),
    met AS (SELECT rid, i, rule, label, level, base, regexp_extract(line, pattern, 1) AS m FROM near JOIN rules USING (keyword) WHERE contains(line, needs)),
    spans AS (SELECT DISTINCT rid, i - (len(string_split(string_split(m, '<')[1], ' ')) - 1) AS a, i - (len(string_split(string_split(m, '<')[1], ' ')) - 1) + len(string_split(m, ' ')) AS b,
                     rule, label, level, base FROM met WHERE m <> ''),
    kept AS (SELECT * FROM spans s WHERE base OR NOT EXISTS (SELECT 1 FROM spans t WHERE t.rid = s.rid AND t.a <= s.a AND t.b >= s.b AND
               (t.level < s.level OR (t.level = s.level AND (t.b - t.a > s.b - s.a OR (t.b - t.a = s.b - s.a AND t.rule < s.rule)))))),
    told AS (SELECT rid, count(*) FILTER (WHERE base) AS n, min(a) FILTER (WHERE base) AS first, max(a) FILTER (WHERE base) AS last,
                    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS bases, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
                    max(list_extract([{confidence}]::DOUBLE[], level + 1)) AS score FROM kept GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(bases, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM docs LEFT JOIN told USING (rid)"""
