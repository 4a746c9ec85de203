"""DuckDB SQL for the registered queries that SQL can express.

Written from the results' definitions; constants are spelled out here once more rather than read from the operators.
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d)
),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r
),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
doubled AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
rules AS (
  SELECT d.r, doc_id, source, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(doubled.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered ON covered.r = d.r LEFT JOIN doubled ON doubled.r = d.r
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM rules),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS failed FROM judged GROUP BY source),
total AS (SELECT sum(failed) / sum(n) AS p, sum(n)::DOUBLE AS all_n, count(*) AS k, sum(n::DOUBLE * n) AS squares FROM hosts),
moments AS (
  SELECT p, CASE WHEN p > 0 AND p < 1 AND all_n - squares / all_n - (k - 1) > 0
    THEN round(((SELECT sum(n * pow(failed / n - p, 2)) FROM hosts) / (p * (1 - p)) - (k - 1)) / (all_n - squares / all_n - (k - 1)), 9) ELSE 0 END AS rho
  FROM total
),
weight AS (SELECT p AS m, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1.0), 1000000.0) ELSE 1000000.0 END AS k FROM moments),
prior AS (SELECT round(m * k, 6) AS a, round((1 - m) * k, 6) AS b FROM weight),
verdicts AS (SELECT source, round((failed + a) / (n + a + b), 6) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
),
ranked AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
    first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept
  FROM d
)
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM ranked
"""

MIXING = rf"""
WITH d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS doc_key, doc_id, source, len({WORDS})::BIGINT AS size FROM documents
),
x AS (
  SELECT *, floor(1000 * size / (size + 256))::BIGINT AS priority,
    (('0x' || substr(md5(doc_key || ':' || size), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d
),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, sum(priority * size)::HUGEINT AS priority_sum,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS number
  FROM x GROUP BY source
),
t AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM s WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
c AS (SELECT *, 3 * source_size * (all_weights - weights) < weight * (total - caps) AS capped FROM t),
targets AS (
  SELECT source, source_size, priority_sum, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
    weight::DOUBLE * (total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
      / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM c
),
r AS (
  SELECT x.*, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS ratio,
    CASE WHEN source_size > 0 THEN priority_sum::DOUBLE / source_size::DOUBLE ELSE 0.0 END AS mean
  FROM x JOIN targets ON x.source IS NOT DISTINCT FROM targets.source
),
copies AS (
  SELECT *, least(greatest(round(ratio * (1 + 0.5::DOUBLE * (1 - ratio / 3) * ((priority - mean) / 1000)), 9), 0.0), 3.0) AS copies FROM r
),
odds AS (
  SELECT *, floor(copies)::BIGINT AS whole, round(copies - floor(copies), 9) AS p FROM copies
),
ranked AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(whole * size) OVER (PARTITION BY source) AS wanted FROM odds
),
drawn AS (
  SELECT *, CASE WHEN q IS NULL THEN 0
    ELSE (2 * sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_key ROWS UNBOUNDED PRECEDING) - size <= 2 * wanted)::BIGINT END AS more
  FROM ranked
),
gaps AS (SELECT *, target - sum((whole + more) * size) OVER (PARTITION BY source) AS gap FROM drawn),
changes AS (
  SELECT *, CASE WHEN size > 0 THEN CASE WHEN gap > 0 AND more = 0 AND whole < 3 THEN 1 WHEN gap < 0 AND more = 1 THEN -1 END END AS change FROM gaps
),
missed AS (SELECT *, abs(gap - change * size) AS miss FROM changes),
best AS (
  SELECT *, row_number() OVER (PARTITION BY source, miss < abs(gap) ORDER BY miss, doc_key) = 1 AND coalesce(miss < abs(gap), FALSE) AS chosen FROM missed
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  ((whole + more + CASE WHEN chosen THEN change ELSE 0 END) * size)::BIGINT AS taken, (whole + more + CASE WHEN chosen THEN change ELSE 0 END)::BIGINT AS copies
FROM best
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT r, words[i] || ' ' || words[i + 1] AS s FROM (SELECT r, words, unnest(range(1, len(words))) AS i FROM d)
  UNION ALL
  SELECT r, words[1] FROM d WHERE len(words) = 1
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.r < y.r GROUP BY 1, 2)
  JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)
),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT r AS start, r AS here FROM d
  UNION
  SELECT start, b FROM reached JOIN steps ON here = a
),
least AS (SELECT start, min(k) AS component FROM reached JOIN d ON d.r = here GROUP BY start)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, nullif(component, 9223372036854775807) AS component_id, k = component AS kept
FROM d LEFT JOIN sizes ON sizes.r = d.r JOIN least ON start = d.r
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, {WORDS} AS words FROM documents),
windows AS (
  SELECT r, k, i, array_to_string(words[i:i + 12], ' ') AS w FROM (SELECT r, k, words, unnest(range(1, len(words) - 11)) AS i FROM d)
),
covered AS (SELECT r, i FROM (SELECT r, i, k, min(k) OVER (PARTITION BY w) AS least FROM windows) WHERE least < k),
each_word AS (SELECT DISTINCT r, i + j AS i FROM covered, range(0, 13) AS t(j)),
gone AS (SELECT r, count(*) AS n, list(i) AS places FROM each_word GROUP BY r),
split AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
left_over AS (
  SELECT split.r, string_agg(word, ' ' ORDER BY split.i) AS kept FROM split LEFT JOIN each_word ON each_word.r = split.r AND each_word.i = split.i
  WHERE each_word.i IS NULL GROUP BY split.r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.r = d.r LEFT JOIN left_over ON left_over.r = d.r
"""

CHAT_FORMATTING = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || head || ': ' || body || '</turn>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

SUFFIX_DEDUP = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
),
strings AS (
  SELECT r, k, i, md5_number(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT r, k, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)
),
later AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY w ORDER BY k, i) AS n FROM strings) WHERE n > 1),
marked AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM later),
runs AS (
  SELECT r, min(i) AS a, max(i) + 100 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM marked) GROUP BY r, run
),
gone AS (SELECT r, sum(b - a) AS n, count(*) AS runs FROM runs GROUP BY r),
edges AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs
  UNION ALL SELECT d.r, coalesce(max(b), 0), max(length(h) // 2) FROM d LEFT JOIN runs ON runs.r = d.r GROUP BY d.r
),
kept AS (SELECT d.r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM edges JOIN d ON d.r = edges.r GROUP BY d.r)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON kept.r = d.r LEFT JOIN gone ON gone.r = d.r
"""

COLLOCATIONS = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
grams AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM pieces, range(1, 5) AS t(size))
),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS words FROM f WHERE size >= 2 AND n >= 30),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.n AS l, y.n AS r, (2000000::HUGEINT * a // (x.n::HUGEINT + y.n::HUGEINT))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
),
scored AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(words[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates WHERE size >= 3))
),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_parts GROUP BY lang, phrase),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer ON longer.lang = s.lang AND longer.phrase = s.phrase
  WHERE longer.a IS NULL OR 100::HUGEINT * longer.a < 80::HUGEINT * s.a
)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

#: Fixed values of XXH64, seed 42. Numbers of 128 bits hold products of two of 64; a turn to the left by b bits is a product by
#: 2 ** b modulo 2 ** 64 - 1.
XXH = {
    "p1": "11400714785074694791::UHUGEINT",
    "p2": "14029467366897019727::UHUGEINT",
    "p3": "1609587929392839161::UHUGEINT",
    "p4": "9650029242287828579::UHUGEINT",
    "p5": "2870177450012600261::UHUGEINT",
    "m": "18446744073709551615::UHUGEINT",
}


def _round(acc: str, lane: str) -> str:
    """One round of XXH64."""
    return "(((((({lane}) * {p2} & {m}) + ({acc})) & {m}) * 2147483648::UHUGEINT % {m}) * {p1} & {m})".format(acc=acc, lane=lane, **XXH)


def _steps(start: str, lanes: str, step: str) -> str:
    return f"list_reduce(list_concat([({start})::UHUGEINT], {lanes}), lambda h, x: {step})"


def _number(begin: str, size: int) -> str:
    """The bytes from a 0-based place of ``b`` as one number, the first byte the least."""
    return " + ".join(f"b[{begin} + {k + 1}] * {256**k}::UHUGEINT" for k in range(size))


SIMHASH_NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT r, array_to_string(words[i:i + 2], ' ') AS s FROM (SELECT r, words, unnest(range(1, greatest(2, len(words) - 1))) AS i FROM d WHERE len(words) > 0)
),
texts AS (SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM shingles)),
bytes AS (
  SELECT s, length(x) // 2 AS n, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UTINYINT::UHUGEINT) AS b FROM texts
),
stripes AS (
  SELECT s, n, b, n // 32 * 32 AS done, {accumulators} FROM bytes
),
begun AS (
  SELECT s, n, b, done, CASE WHEN n < 32 THEN {p5} + 42::UHUGEINT ELSE {merged} END + n::UHUGEINT AS h FROM stripes
),
eights AS (
  SELECT s, n, b, {eights} AS h FROM (SELECT s, n, b, done, h & {m} AS h FROM begun)
),
fours AS (
  SELECT s, n, b, CASE WHEN n % 8 >= 4 THEN ((xor(h, ({four}) * {p1} & {m}) * 8388608::UHUGEINT % {m}) * {p2} & {m}) + {p3} & {m} ELSE h END AS h FROM eights
),
ones AS (SELECT s, {ones} AS h FROM fours),
turned AS (SELECT s, xor(h, h >> 33::UHUGEINT) * {p2} & {m} AS h FROM ones),
mixed AS (SELECT s, xor(h, h >> 29::UHUGEINT) * {p3} & {m} AS h FROM turned),
hashes AS (SELECT s, xor(h, h >> 32::UHUGEINT)::UBIGINT AS h FROM mixed),
votes AS (
  SELECT r, bit, 2 * sum((h >> bit::UBIGINT & 1::UBIGINT)::BIGINT) > count(*) AS one
  FROM shingles JOIN hashes ON hashes.s = shingles.s, range(0, 64) AS t(bit) GROUP BY r, bit
),
prints AS (SELECT r, bit_or(CASE WHEN one THEN 1::UHUGEINT << bit::UHUGEINT ELSE 0::UHUGEINT END)::UBIGINT AS fp FROM votes GROUP BY r),
docs AS (SELECT d.r, doc_id, k, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN prints ON prints.r = d.r),
nodes AS (SELECT fp, min(k) AS k FROM docs GROUP BY fp),
steps AS (SELECT x.fp AS a, y.fp AS b FROM nodes x, nodes y WHERE x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)::BIT) <= 2),
reached AS (
  SELECT fp AS start, fp AS here FROM nodes
  UNION
  SELECT start, b FROM reached JOIN steps ON here = a
),
least AS (SELECT start, min(k) AS component FROM reached JOIN nodes ON nodes.fp = here GROUP BY start)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, nullif(component, 9223372036854775807) AS component_id FROM docs JOIN least ON start = fp
""".format(
    accumulators=", ".join(
        _steps(f"({seed}) & {XXH['m']}", f"list_transform(range(0, n // 32), lambda i: {_number(f'32 * i + {8 * k}', 8)})", _round("h", "x")) + f" AS v{k + 1}"
        for k, seed in enumerate((f"42::UHUGEINT + {XXH['p1']} + {XXH['p2']}", f"42::UHUGEINT + {XXH['p2']}", "42::UHUGEINT", f"18446744073709551658::UHUGEINT - {XXH['p1']}"))
    ),
    merged=_steps(
        f"((v1 * 2::UHUGEINT) % {XXH['m']}) + ((v2 * 128::UHUGEINT) % {XXH['m']}) + ((v3 * 4096::UHUGEINT) % {XXH['m']}) + ((v4 * 262144::UHUGEINT) % {XXH['m']}) & {XXH['m']}",
        "[v1, v2, v3, v4]",
        f"(xor(h, {_round('0::UHUGEINT', 'x')}) * {XXH['p1']} & {XXH['m']}) + {XXH['p4']} & {XXH['m']}",
    ),
    eights=_steps(
        "h",
        f"list_transform(range(0, n % 32 // 8), lambda i: {_number('done + 8 * i', 8)})",
        f"((xor(h, {_round('0::UHUGEINT', 'x')}) * 134217728::UHUGEINT % {XXH['m']}) * {XXH['p1']} & {XXH['m']}) + {XXH['p4']} & {XXH['m']}",
    ),
    four=_number("n // 8 * 8", 4),
    ones=_steps(
        "h",
        "list_transform(range(n // 4 * 4, n), lambda i: b[i + 1])",
        f"(xor(h, x * {XXH['p5']} & {XXH['m']}) * 2048::UHUGEINT % {XXH['m']}) * {XXH['p1']} & {XXH['m']}",
    ),
    **XXH,
)

FILTER_AUDIT = rf"""
WITH d AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS k, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS words FROM documents
),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
      + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * (k > min(k) OVER (PARTITION BY text))::INT AS mask
  FROM d LEFT JOIN flags ON flags.doc_id = d.doc_id
),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (
  SELECT [a.bit, b.bit, c.bit, x.bit, y.bit] AS bits, a.letter || b.letter || c.letter || x.letter || y.letter AS filter_order
  FROM letters a, letters b, letters c, letters x, letters y WHERE a.bit | b.bit | c.bit | x.bit | y.bit = 31
),
steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
),
found AS (
  SELECT part, filter_order, step::INT AS step, own,
    sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM found
"""

SQL: dict[str, str] = {
    "op1_quality_rules": QUALITY_RULES,
    "op4_exact_dedup": EXACT_DEDUP,
    "op5_mixing": MIXING,
    "op6_near_dedup": NEAR_DEDUP,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op10_suffix_dedup": SUFFIX_DEDUP,
    "op8_chat_formatting": CHAT_FORMATTING,
    "op11_collocations": COLLOCATIONS,
    "op12_simhash_near_dedup": SIMHASH_NEAR_DEDUP,
    "op13_filter_audit": FILTER_AUDIT,
}
