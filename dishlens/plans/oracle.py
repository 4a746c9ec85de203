"""The same results in plain SQL, for checking on small tables. Written from the definitions, not from the Spark plans."""

from __future__ import annotations

from dishlens.functions import lexicon as lx
from dishlens.functions import text as tx
from dishlens.operators import answers, metrics, pairs
from dishlens.plans import suite
from dishlens.sources import catalog

WS = tx.WS
K = suite.K
N = suite.NUM_PAIRS
SEED = 42
FACETS = ("cuisine_type", "food_type", "atmosphere", "price_level", "location")
WORD_GAP = r"[^\p{L}\p{M}\p{N}]+"
PRIME = 2147483647


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows) -> str:
    def one(v) -> str:
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def padded(c: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({c}), '{WORD_GAP}', ' ', 'g')) || ' ')"


def h32(s: str) -> str:
    return f"CAST(('0x' || substr(md5({s}), 1, 8))::UBIGINT AS BIGINT)"


def draw(strategy: str, slot: str, modulus: str, j: str = "j") -> str:
    return f"({h32(f'concat_ws(chr(58), {q(str(SEED))}, {q(strategy)}, CAST({j} AS VARCHAR), {q(slot)})')} % ({modulus}))"


def r6(e: str, name: str) -> str:
    return f"round(({e}) + 1e-10, 6) AS {name}"


def excerpt(c: str, n: int, stripped: bool = True, dots: bool = True) -> str:
    head = strip(f"substr({c}, 1, {n})") if stripped else f"substr({c}, 1, {n})"
    return f"CASE WHEN length({c}) > {n} THEN {head} || '...' ELSE {head} END" if dots else head


# --- shared pieces ------------------------------------------------------------------------------------------------

LEX_ROWS = [
    (e.facet, "location" if e.facet in ("place", "province") else e.facet, e.cat_rank + (1000 if e.facet == "province" else 0), e.category, e.keyword)
    for e in lx.shipped_entries()
]
CLEANED = f"""
rv AS (SELECT doc_id AS review_id, text, CAST(1 + doc_id % 5 AS INTEGER) AS star_rating FROM documents),
cl AS (SELECT review_id, star_rating, {collapse('text')} AS review_text FROM rv WHERE text IS NOT NULL),
cleaned AS MATERIALIZED (SELECT * FROM cl WHERE length(review_text) >= 20)"""
LEX = f"lex(facet, col, r, category, keyword) AS ({values(LEX_ROWS)})"
TAGS = CLEANED + f""",
{LEX},
tags AS MATERIALIZED (SELECT review_id, facet, col, category, min(r) AS r FROM cleaned, lex
  WHERE contains(lower(review_text), lower(keyword)) GROUP BY ALL)"""


def listed(col: str, top: int | None = None, source: str = "tags") -> str:
    limit = f" AND pos <= {top}" if top else ""
    return f"coalesce(string_agg(category, ', ' ORDER BY r) FILTER (WHERE col = {q(col)}{limit}), '')"


def tag_lists(source: str = "tags") -> str:
    return f"(SELECT review_id, {', '.join(f'{listed(f)} AS {f}' for f in FACETS)} FROM {source} GROUP BY review_id)"


OPENING_SQL = (
    "CASE WHEN concat_ws(' ', " + ", ".join(f"nullif({f}, '')" for f in FACETS) + ") <> '' THEN concat_ws(' ', "
    + ", ".join(f"nullif({f}, '')" for f in FACETS) + ") || ': ' || substr(review_text, 1, 500) ELSE substr(review_text, 1, 500) END"
)
SEARCH_TEXT_SQL = OPENING_SQL.replace("substr(review_text, 1, 500)", "review_text")
DICTIONARY = f"""
lines AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '{WORD_GAP}', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM benchmark),
terms AS (SELECT item_id * 1000000 + i AS rank, ws[i + 1] AS term FROM (SELECT item_id, ws, unnest(range(len(ws))) AS i FROM lines)),
dict AS MATERIALIZED (SELECT min(rank) AS rank, term FROM terms WHERE length(term) BETWEEN 4 AND 50 GROUP BY term)"""
MENTIONS = f"""
ment AS MATERIALIZED (SELECT review_id, string_agg(term, ', ' ORDER BY rank) AS mentioned_foods FROM (
  SELECT review_id, rank, term, row_number() OVER (PARTITION BY review_id ORDER BY rank) AS n
  FROM cleaned, dict WHERE contains(lower(review_text), lower(term))) WHERE n <= 5 GROUP BY review_id)"""
TAGGED = TAGS + f""",
tl AS {tag_lists()},
tagged0 AS (SELECT c.*, {', '.join(f"coalesce({f}, '') AS {f}" for f in FACETS)} FROM cleaned c LEFT JOIN tl USING (review_id)),
tagged AS MATERIALIZED (SELECT *, {SEARCH_TEXT_SQL} AS search_text FROM tagged0)"""
PROCESSED = TAGGED + f""",{DICTIONARY},{MENTIONS},
processed AS MATERIALIZED (SELECT t.*, coalesce(m.mentioned_foods, '') AS mentioned_foods FROM tagged t LEFT JOIN ment m USING (review_id))"""

USER_QUERIES = f"""
uq AS (SELECT conv_id * 1000 + turn AS query_id, {collapse("replace(text, '|', ' ')")} AS query FROM conversations
  WHERE role = 'user' AND {strip('text')} <> '')"""
BENCH_QUERIES = f"""
bq AS (SELECT item_id AS query_id, {collapse("replace(text, '|', ' ')")} AS query FROM benchmark WHERE {strip('text')} <> '')"""


def terms_list(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{WS}+'), lambda t: length(t) >= 3)"


# Dense spaces.
W = "[" + ", ".join(repr(w) for w in suite.TUNED_WEIGHTS) + "]"
DENSE = f"""
e0 AS (SELECT vec_id AS row_id, label, unnest(range(len(embedding))) AS pos, embedding FROM embeddings),
e1 AS (SELECT row_id, label, pos, CAST(embedding[pos + 1] AS DOUBLE) AS x, CAST(embedding[pos + 1] AS DOUBLE) * ({W})[pos + 1] AS y FROM e0),
e2 AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS nx, sqrt(sum(y * y) OVER (PARTITION BY row_id)) AS ny FROM e1),
cells AS MATERIALIZED (SELECT 'base' AS space, row_id, label, pos, CASE WHEN nx > 0 THEN x / nx ELSE x END AS x FROM e2
  UNION ALL SELECT 'tuned', row_id, label, pos, CASE WHEN ny > 0 THEN y / ny ELSE y END FROM e2),
c1 AS (SELECT space, label, pos, avg(x) AS x FROM cells GROUP BY ALL),
c2 AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY space, label)) AS n FROM c1),
dq AS MATERIALIZED (SELECT space, CAST(label AS BIGINT) AS query_id, pos, CASE WHEN n > 0 THEN x / n ELSE x END AS x FROM c2),
dqueries AS (SELECT DISTINCT query_id, 'topic ' || query_id AS query,
  ([{', '.join(q(k) for k, _ in catalog.CATEGORY_TITLES)}])[CAST(query_id % 5 AS INTEGER) + 1] AS category FROM dq),
dscores AS MATERIALIZED (SELECT space, query_id, row_id, round(sum(q.x * c.x), 9) AS score
  FROM dq q JOIN cells c USING (space, pos) JOIN cleaned r ON r.review_id = c.row_id GROUP BY ALL)"""
DRANK = "row_number() OVER (PARTITION BY space, query_id ORDER BY score DESC, row_id)"
DENSE_HITS = TAGGED + "," + DENSE + f""",
dranked AS (SELECT *, {DRANK} AS rank FROM dscores),
dhits AS MATERIALIZED (SELECT d.*, t.star_rating, t.review_text, t.cuisine_type, t.food_type, t.location,
  CASE WHEN t.cuisine_type || t.food_type || t.location <> '' THEN 1.0 ELSE 0.0 END AS covered
  FROM dranked d JOIN tagged t ON t.review_id = d.row_id WHERE rank <= {K})"""

# Hashed spaces.
DIM = suite.SPACE.dim


def cells(texts: str, name: str, key: str) -> str:
    """``name(key, f, tf)`` from a relation ``(key, txt)``."""
    return f"""
{name}_t AS (SELECT {key}, unnest(list_filter(string_split(trim(regexp_replace(lower(txt), '{WORD_GAP}', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM ({texts})),
{name} AS MATERIALIZED (SELECT {key}, {h32('w')} % {DIM} AS f, CAST(count(*) AS DOUBLE) AS tf FROM {name}_t GROUP BY ALL)"""


IDF = f"""
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM processed),
idf AS MATERIALIZED (SELECT f, count(*) AS df, ln((1 + (SELECT n FROM total)) / (count(*) + 1)) + 1 AS idf FROM rf GROUP BY f)"""
TEXT_INDEX = PROCESSED + "," + cells("SELECT review_id, 'passage: ' || search_text AS txt FROM processed", "rf", "review_id") + "," + IDF + """,
rw0 AS (SELECT 'base' AS space, review_id AS row_id, f, tf AS w FROM rf UNION ALL SELECT 'tuned', review_id, rf.f, tf * idf FROM rf JOIN idf USING (f)),
rw AS MATERIALIZED (SELECT space, row_id, f, w / sqrt(sum(w * w) OVER (PARTITION BY space, row_id)) AS w FROM rw0)"""
TEXT_SEARCH = TEXT_INDEX + "," + BENCH_QUERIES + "," + cells("SELECT query_id, 'query: ' || query AS txt FROM bq", "qf", "query_id") + """,
qw0 AS (SELECT 'base' AS space, query_id, f, tf AS w FROM qf
  UNION ALL SELECT 'tuned', query_id, qf.f, tf * coalesce(idf, ln(1 + (SELECT n FROM total)) + 1) FROM qf LEFT JOIN idf USING (f)),
qw AS (SELECT space, query_id, f, w / sqrt(sum(w * w) OVER (PARTITION BY space, query_id)) AS w FROM qw0),
shared_words AS (SELECT space, query_id, row_id, round(sum(qw.w * rw.w), 9) AS score FROM qw JOIN rw USING (space, f) GROUP BY ALL),
spaces(space) AS (VALUES ('base'), ('tuned')),
asked AS (SELECT space, query_id, review_id AS row_id FROM spaces, bq, processed WHERE query <> ''),
tscores AS MATERIALIZED (SELECT space, query_id, row_id, coalesce(score, 0.0) AS score FROM asked LEFT JOIN shared_words USING (space, query_id, row_id)),
tranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY space, query_id ORDER BY score DESC, row_id) AS rank FROM tscores)"""


def text_hits(k: int, space: str = "base") -> str:
    return TEXT_SEARCH + f""",
hits AS (SELECT h.*, p.* EXCLUDE (review_id) FROM tranked h JOIN processed p ON p.review_id = h.row_id WHERE space = '{space}' AND rank <= {k})"""


STARS = "repeat('*', star_rating)"
PERCENT0 = "CAST(CAST(round_even(score * 100, 0) AS INTEGER) AS VARCHAR) || '%'"
LABELS = "concat_ws(' | ', " + ", ".join(
    f"CASE WHEN {c} <> '' THEN {q(label)} || {c} END"
    for label, c in ((tx.LABEL_CUISINE, "cuisine_type"), (tx.LABEL_FOOD, "food_type"), (tx.LABEL_LOCATION, "location"))
) + ")"
NL = "chr(10)"
BLOCK = (
    f"concat_ws({NL}, {NL} || 'ร้านที่ ' || rank || ' (Rating: ' || star_rating || '/5 ' || {STARS} || ', ความเกี่ยวข้อง: ' || {PERCENT0} || ')', "
    f"nullif({LABELS}, ''), 'รีวิว: ' || {excerpt('review_text', 300)}, {q(answers.ANSWER_RULE)})"
)


def answer(queries: str, hits: str, keys: str) -> str:
    """``keys, query, num_results, answer`` from relations of queries and hits."""
    return f"""(SELECT {', '.join('u.' + k for k in keys.split(', '))}, u.query, coalesce(n, 0) AS num_results,
  CASE WHEN n IS NULL THEN {q(answers.NOT_FOUND)}
    ELSE 'จากการค้นหา "' || u.query || '" พบ ' || n || ' ร้านที่เกี่ยวข้อง:' || {NL} || {NL} || body END AS answer
  FROM {queries} u LEFT JOIN (SELECT {keys}, count(*) AS n, string_agg({BLOCK}, {NL} ORDER BY rank) AS body FROM {hits} GROUP BY ALL) b USING ({keys}))"""


def improvement(t: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({t} - {b}) / {b} * 100 WHEN {t} = 0 THEN 0.0 ELSE 100.0 END"


COMPARE = DENSE_HITS + f""",
cmp0 AS (SELECT u.*, coalesce(bs, 0) AS baseline_avg_score, coalesce(ts, 0) AS finetuned_avg_score,
    coalesce(br, 0) AS baseline_avg_rating, coalesce(tr, 0) AS finetuned_avg_rating
  FROM dqueries u LEFT JOIN (SELECT query_id, avg(score) FILTER (WHERE space = 'base') AS bs, avg(score) FILTER (WHERE space = 'tuned') AS ts,
    avg(star_rating) FILTER (WHERE space = 'base') AS br, avg(star_rating) FILTER (WHERE space = 'tuned') AS tr FROM dhits GROUP BY query_id) USING (query_id)),
cmp AS (SELECT *, {improvement('finetuned_avg_score', 'baseline_avg_score')} AS score_improvement FROM cmp0)"""
MEANS6 = ", ".join(r6(f"avg({c})", c) for c in metrics.MEANS) + ", " + r6("avg(score_improvement)", "avg_improvement")
SCORES6 = ", ".join(r6(c, c) for c in metrics.MEANS)


def select_tags(col: str) -> str:
    return f"WITH {TAGGED} SELECT review_id, {col} FROM tagged"


# Training pairs.
SEARCHABLE = TAGGED
QUERY_UNION = USER_QUERIES + "," + BENCH_QUERIES + """,
qu AS (SELECT DISTINCT query FROM (SELECT query FROM uq UNION ALL SELECT query FROM bq)),
""" + f"qn AS MATERIALIZED (SELECT query, row_number() OVER (ORDER BY {h32('query')}, query) - 1 AS query_id FROM qu)"


def matches(queries: str, name: str) -> str:
    return f"""
{name}_qt AS MATERIALIZED (SELECT DISTINCT query_id, unnest({terms_list('query')}) AS term FROM {queries}),
{name}_tr AS MATERIALIZED (SELECT term, review_id FROM (SELECT DISTINCT term FROM {name}_qt), cleaned WHERE contains(lower(review_text), term)),
{name} AS MATERIALIZED (SELECT DISTINCT query_id, review_id FROM {name}_qt JOIN {name}_tr USING (term))"""


def quota(s: str) -> int:
    return pairs.quota(s, N)


def two_distinct(strategy: str, n: str) -> str:
    first, step = draw(strategy, "first", n), draw(strategy, "step", f"{n} - 1")
    return f"{first} AS p1, ({first} + 1 + {step}) % ({n}) AS p2"


Q_PAIRS = QUERY_UNION + "," + matches("qn", "m") + f""",
qd AS (SELECT j, {draw('query', 'query', '(SELECT count(*) FROM qn)')} AS query_id FROM (SELECT unnest(range({quota('query') * 10})) AS j)),
qa AS (SELECT * FROM qd WHERE query_id IN (SELECT query_id FROM m) ORDER BY j LIMIT {quota('query')}),
qab AS (SELECT *, {draw('query', 'factor', str(PRIME - 1))} + 1 AS a, {draw('query', 'offset', str(PRIME))} AS b FROM qa),
qh AS (SELECT j, query_id, review_id, row_number() OVER (PARTITION BY j ORDER BY (a * ({h32('CAST(review_id AS VARCHAR)')} % {PRIME}) + b) % {PRIME}, review_id) AS n
  FROM qab JOIN m USING (query_id)),
p_query AS MATERIALIZED (SELECT 'query' AS strategy, j, qh.query_id AS left_id, qh.review_id AS right_id, qn.query AS text_a, t.search_text AS text_b
  FROM qh JOIN qn ON qn.query_id = qh.query_id JOIN tagged t ON t.review_id = qh.review_id WHERE n = 1)"""
RID = h32("CAST(review_id AS VARCHAR)")
S_PAIRS = f"""
mem AS (SELECT review_id, col AS facet, category AS value FROM tags WHERE col IN ('cuisine_type', 'food_type', 'location')),
num AS (SELECT *, row_number() OVER (PARTITION BY facet, value ORDER BY {RID}, review_id) - 1 AS o, count(*) OVER (PARTITION BY facet, value) AS size FROM mem),
grp AS (SELECT facet, value, size, row_number() OVER (ORDER BY {h32("facet || ':' || value")}, facet, value) - 1 AS g FROM (SELECT DISTINCT facet, value, size FROM num WHERE size >= 2)),
sd AS (SELECT j, {draw('similar', 'group', '(SELECT count(*) FROM grp)')} AS g FROM (SELECT unnest(range({quota('similar')})) AS j)),
sp AS (SELECT j, facet, value, {two_distinct('similar', 'size')} FROM sd JOIN grp USING (g)),
p_similar AS MATERIALIZED (SELECT 'similar' AS strategy, j, a.review_id AS left_id, b.review_id AS right_id, ta.search_text AS text_a, tb.search_text AS text_b
  FROM sp JOIN num a ON a.facet = sp.facet AND a.value = sp.value AND a.o = p1 JOIN num b ON b.facet = sp.facet AND b.value = sp.value AND b.o = p2
  JOIN tagged ta ON ta.review_id = a.review_id JOIN tagged tb ON tb.review_id = b.review_id)"""
R_PAIRS = f"""
hi AS (SELECT review_id, row_number() OVER (ORDER BY {RID}, review_id) - 1 AS o, string_split(food_type, ', ') AS foods, food_type, search_text FROM tagged WHERE star_rating >= 4),
rd AS (SELECT j, {draw('rating', 'first', '(SELECT count(*) FROM hi)')} AS p1, {draw('rating', 'second', '(SELECT count(*) FROM hi)')} AS p2
  FROM (SELECT unnest(range({quota('rating') * 5})) AS j)),
p_rating AS MATERIALIZED (SELECT 'rating' AS strategy, j, a.review_id AS left_id, b.review_id AS right_id, a.search_text AS text_a, b.search_text AS text_b
  FROM rd JOIN hi a ON a.o = p1 JOIN hi b ON b.o = p2
  WHERE p1 <> p2 AND a.food_type <> '' AND b.food_type <> '' AND list_has_any(a.foods, b.foods) ORDER BY j LIMIT {quota('rating')})"""


def fill(mined: str) -> str:
    return f"""
al AS (SELECT review_id, search_text, row_number() OVER (ORDER BY {RID}, review_id) - 1 AS o FROM tagged),
fd AS (SELECT j, {two_distinct('fill', '(SELECT count(*) FROM al)')} FROM (SELECT unnest(range({N})) AS j) WHERE j < {N} - (SELECT count(*) FROM {mined})),
p_fill AS MATERIALIZED (SELECT 'fill' AS strategy, j, a.review_id AS left_id, b.review_id AS right_id, a.search_text AS text_a, b.search_text AS text_b
  FROM fd JOIN al a ON a.o = p1 JOIN al b ON b.o = p2)"""


ALL_PAIRS = SEARCHABLE + "," + Q_PAIRS + "," + S_PAIRS + "," + R_PAIRS + f""",
mined AS (SELECT * FROM p_query UNION ALL SELECT * FROM p_similar UNION ALL SELECT * FROM p_rating),{fill('mined')},
every AS (SELECT * FROM mined UNION ALL SELECT * FROM p_fill),
ap AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {h32(f"'{SEED}:shuffle:' || strategy || ':' || j")}, strategy, j) - 1 AS pair_id, * FROM every)"""
PAIR_VIEW = "j, left_id, right_id, text_a, text_b"


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["dictionary_prepare"] = f"WITH {DICTIONARY} SELECT rank, term FROM dict"
    out["normalize_queries"] = f"WITH {USER_QUERIES} SELECT * FROM uq WHERE {strip('query')} <> ''"
    out["query_terms"] = f"WITH {USER_QUERIES} SELECT query_id, array_to_string(list_transform(list_filter(list_zip(ts, range(len(ts))), lambda p: list_position(ts, p[1]) = p[2] + 1), lambda p: p[1]), ' ') AS terms FROM (SELECT query_id, {terms_list('query')} AS ts FROM uq WHERE query <> '')"
    out["processed_roundtrip"] = f"WITH {PROCESSED} SELECT review_id, star_rating, CAST(length(search_text) AS INTEGER) AS n_chars, food_type, mentioned_foods FROM processed"
    out["index_roundtrip"] = f"WITH {TEXT_INDEX} SELECT space, count(DISTINCT row_id) AS n_vectors, count(*) AS n_features, {r6('sum(w * w)', 'sum_sq')}, 'query: ' AS query_prefix FROM rw GROUP BY space"
    cat_rows = catalog.evaluation_rows()
    out["query_catalog"] = f"WITH {CLEANED}, cat(query_id, category, query, description) AS ({values(cat_rows)}), qt AS (SELECT query_id, unnest({terms_list('query')}) AS term FROM cat), m AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM qt, documents WHERE contains(lower(text), term) GROUP BY 1) SELECT CAST(query_id AS BIGINT) AS query_id, category, query, description, coalesce(n, 0) AS n_matches FROM cat LEFT JOIN m USING (query_id)"
    out["lexicon_stats"] = f"WITH {TAGS}, k AS (SELECT facet, category, count(*) AS n_keywords FROM lex GROUP BY ALL), c AS (SELECT facet, category, count(*) AS n FROM tags GROUP BY ALL) SELECT facet, category, n_keywords, coalesce(n, 0) AS n_reviews FROM k LEFT JOIN c USING (facet, category)"
    out["filter_label_map"] = f"WITH {TAGS}, labels(facet, label, category) AS ({values(catalog.FILTER_LABELS)}), c AS (SELECT col AS facet, category, count(*) AS n FROM tags GROUP BY ALL) SELECT facet, category, label, coalesce(n, 0) AS n FROM labels LEFT JOIN c USING (facet, category)"
    out["clean_reviews"] = f"WITH {CLEANED} SELECT review_id, star_rating, review_text FROM cleaned"
    out["search_text"] = f"WITH {TAGGED} SELECT review_id, {OPENING_SQL} AS search_text FROM tagged"
    out["search_text_prefixed"] = f"WITH {TAGGED} SELECT review_id, 'passage: ' || search_text AS passage FROM tagged"
    out["excerpts"] = f"WITH {CLEANED} SELECT review_id, {excerpt('review_text', 300)} AS answer_excerpt, {excerpt('review_text', 400, False)} AS card_excerpt, {excerpt('review_text', 400, False, False)} AS prompt_excerpt FROM cleaned"
    out["star_display"] = f"WITH {CLEANED} SELECT review_id, {STARS} AS stars, repeat('★', star_rating) || repeat('☆', 5 - star_rating) AS slots FROM rv"
    for key, col in (("tag_cuisine", "cuisine_type"), ("tag_food_type", "food_type"), ("tag_atmosphere", "atmosphere"), ("tag_price", "price_level"), ("tag_location", "location")):
        out[key] = select_tags(col)
    word_lex = [(f, c, r, cat, " " + _as_words(k) + " ") for f, c, r, cat, k in LEX_ROWS]
    wtags = CLEANED + f""",
{LEX}, wlex(facet, col, r, category, keyword) AS ({values(word_lex)}),
ptext AS MATERIALIZED (SELECT review_id, {padded('review_text')} AS p FROM cleaned),
wtags AS MATERIALIZED (SELECT review_id, col, category, min(r) AS r FROM ptext, wlex WHERE contains(p, keyword) GROUP BY ALL)"""
    out["tag_wordmatch"] = f"WITH {wtags}, tl AS {tag_lists('wtags')} SELECT review_id, {', '.join(f'''coalesce({f}, '') AS {f}''' for f in FACETS)} FROM cleaned LEFT JOIN tl USING (review_id)"
    out["tag_false_hits"] = f"WITH {wtags}, tags AS (SELECT DISTINCT review_id, col, category FROM cleaned, lex WHERE contains(lower(review_text), lower(keyword))), j AS (SELECT t.*, w.review_id IS NOT NULL AS word FROM tags t LEFT JOIN (SELECT DISTINCT review_id, col, category FROM wtags) w USING (review_id, col, category)) SELECT col AS facet, category, count(*) AS n_substring, count(*) FILTER (WHERE word) AS n_word, count(*) FILTER (WHERE NOT word) AS n_false FROM j GROUP BY ALL"
    out["mentioned_terms"] = f"WITH {CLEANED},{DICTIONARY},{MENTIONS} SELECT review_id, coalesce(mentioned_foods, '') AS mentioned_foods FROM cleaned LEFT JOIN ment USING (review_id)"
    out["processed_reviews"] = f"WITH {PROCESSED} SELECT review_id, star_rating, search_text, {', '.join(FACETS)}, mentioned_foods FROM processed"
    out["rating_distribution"] = f"WITH {CLEANED} SELECT star_rating, count(*) AS n, {r6('count(*) * 100.0 / (SELECT count(*) FROM cleaned)', 'share_pct')} FROM cleaned GROUP BY star_rating"
    out["facet_groups"] = f"WITH {TAGS} SELECT col AS facet, category AS value, count(*) AS n FROM tags WHERE col IN ('cuisine_type', 'food_type', 'location') GROUP BY ALL HAVING count(*) >= 2"
    out["query_union"] = f"WITH {QUERY_UNION} SELECT query FROM qu"
    out["distinct_queries"] = f"WITH {USER_QUERIES},{BENCH_QUERIES} SELECT count(*) AS n_queries, count(DISTINCT query) AS n_distinct FROM (SELECT query FROM uq UNION ALL SELECT query FROM bq)"
    out["pipeline_counts"] = f"WITH {CLEANED} SELECT CAST(0 AS INTEGER) AS stage_rank, 'loaded' AS stage, count(text) AS n FROM rv UNION ALL SELECT 1, 'cleaned', count(*) FROM cleaned UNION ALL SELECT 2, 'sampled', least(count(*), {suite.SAMPLE_SIZE}) FROM cleaned"
    out["exact_sample"] = f"""WITH {CLEANED} SELECT review_id, star_rating FROM cleaned ORDER BY {h32(f"'{SEED}:' || review_id")}, review_id LIMIT {suite.SAMPLE_SIZE}"""
    out["l2_normalize"] = f"WITH {CLEANED},{DENSE} SELECT row_id, {r6('sqrt(sum(x * x))', 'norm')}, {r6('sum(x * pos)', 'weighted_sum')} FROM cells WHERE space = 'tuned' GROUP BY row_id"
    out["index_stats"] = f"WITH {CLEANED},{DENSE} SELECT space, count(DISTINCT row_id) AS n_vectors, max(pos) + 1 AS dim FROM cells JOIN cleaned ON review_id = row_id GROUP BY space"
    out["hashed_index"] = f"WITH {TEXT_INDEX} SELECT row_id, f AS feature, {r6('w', 'weight')} FROM rw WHERE space = 'base'"
    out["idf_index"] = f"WITH {TEXT_INDEX} SELECT row_id, f AS feature, {r6('w', 'weight')} FROM rw WHERE space = 'tuned'"
    out["feature_frequencies"] = f"WITH {TEXT_INDEX} SELECT f AS feature, df, {r6('idf', 'idf')} FROM idf"

    hit6 = "query_id, CAST(rank AS INTEGER) AS rank, row_id, " + r6("score", "score")
    out["dense_topk"] = f"WITH {DENSE_HITS} SELECT {hit6} FROM dhits WHERE space = 'base'"
    out["sparse_topk"] = f"WITH {TEXT_SEARCH} SELECT {hit6} FROM tranked WHERE space = 'base' AND rank <= {K}"
    out["tuned_topk"] = f"WITH {TEXT_SEARCH} SELECT {hit6} FROM tranked WHERE space = 'tuned' AND rank <= {K}"
    out["search_hits"] = f"WITH {DENSE_HITS} SELECT {hit6}, star_rating, review_text, food_type, location FROM dhits WHERE space = 'base'"
    passes = """(query_id % 4 = 0 OR star_rating >= query_id % 4)
  AND (query_id % 3 <> 0 OR list_contains(string_split(food_type, ', '), 'tea'))
  AND (query_id % 2 <> 0 OR list_contains(string_split(location, ', '), 'nan'))
  AND (query_id % 5 <> 4 OR list_contains(string_split(price_level, ', '), 'worth'))"""
    again = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank"
    out["filtered_topk_pre"] = f"WITH {TAGGED},{DENSE} SELECT {hit6} FROM (SELECT query_id, row_id, score, {again} FROM dscores JOIN tagged ON review_id = row_id WHERE space = 'base' AND {passes}) WHERE rank <= {K}"
    out["filtered_topk_post"] = f"WITH {TAGGED},{DENSE}, wide AS (SELECT * FROM (SELECT *, {DRANK} AS rank FROM dscores) WHERE space = 'base' AND rank <= {3 * K}) SELECT {hit6} FROM (SELECT query_id, row_id, score, {again} FROM wide JOIN tagged ON review_id = row_id WHERE {passes}) WHERE rank <= {K}"
    out["rerank_topk"] = f"""WITH {text_hits(3 * K)}, qt AS (SELECT query_id, unnest(list_distinct({terms_list('query')})) AS term FROM bq),
cov AS (SELECT h.query_id, h.row_id, any_value(h.rank) AS first_rank, any_value(h.score) AS score, avg(CASE WHEN contains(lower(h.review_text), term) THEN 1.0 ELSE 0.0 END) AS coverage FROM hits h JOIN qt USING (query_id) GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, row_id, CAST(first_rank AS INTEGER) AS first_rank, {r6('coverage', 'coverage')}, {r6('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, score DESC, row_id) AS rank FROM cov) WHERE rank <= {K}"""
    out["lsh_recall"] = f"""WITH {CLEANED},{DENSE}, mine AS MATERIALIZED (SELECT row_id, pos, x FROM cells JOIN cleaned ON review_id = row_id WHERE space = 'base'),
planes AS (SELECT pos, band, bit, CASE WHEN {h32("'42:' || band || ':' || bit || ':' || pos")} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS r
  FROM range({suite.EMBEDDING_DIM}) AS a(pos), range(128) AS b(band), range(8) AS c(bit)),
rs AS MATERIALIZED (SELECT row_id, band, sum(CASE WHEN s > 0 THEN 1 << bit ELSE 0 END) AS sig FROM (SELECT row_id, band, bit, sum(x * r) AS s FROM mine JOIN planes USING (pos) GROUP BY ALL) GROUP BY ALL),
scores AS MATERIALIZED (SELECT a.row_id AS query_id, b.row_id, round(sum(a.x * b.x), 9) AS score FROM mine a JOIN mine b USING (pos) WHERE a.row_id % 20 = 0 GROUP BY ALL),
near AS MATERIALIZED (SELECT DISTINCT a.row_id AS query_id, b.row_id FROM rs a JOIN rs b USING (band, sig) WHERE a.row_id % 20 = 0),
ranked AS (SELECT query_id, row_id, {again} FROM scores),
ranked_near AS (SELECT query_id, row_id, {again} FROM near JOIN scores USING (query_id, row_id)),
looked AS (SELECT query_id, count(*) AS n FROM near GROUP BY 1)
SELECT query_id, count(*) AS n_exact, count(a.row_id) AS n_found, {r6('count(a.row_id) / count(*)', 'recall')}, coalesce(any_value(n), 0) AS n_candidates
FROM (SELECT query_id, row_id FROM ranked WHERE rank <= {K}) e LEFT JOIN (SELECT query_id, row_id FROM ranked_near WHERE rank <= {K}) a USING (query_id, row_id) LEFT JOIN looked USING (query_id) GROUP BY query_id"""
    out["cell_topk"] = f"""WITH {CLEANED},{DENSE}, mine AS MATERIALIZED (SELECT row_id, pos, x FROM cells JOIN cleaned ON review_id = row_id WHERE space = 'base'),
scores AS (SELECT a.row_id AS query_id, b.row_id, round(sum(a.x * b.x), 9) AS score FROM mine a JOIN mine b USING (pos) WHERE a.row_id % 20 = 0 GROUP BY ALL)
SELECT {hit6} FROM (SELECT query_id, row_id, score, {again} FROM scores) WHERE rank <= {K}"""
    out["space_fallback"] = f"WITH {DENSE_HITS} SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'tuned' ELSE 'unbuilt' END AS space, space AS used_space, CAST(rank AS INTEGER) AS rank, row_id, {r6('score', 'score')} FROM dhits WHERE space = CASE WHEN query_id % 2 = 0 THEN 'tuned' ELSE 'base' END"

    out["answer_template"] = f"WITH {text_hits(K)} SELECT * FROM {answer('bq', 'hits', 'query_id')}"
    context = f"string_agg('รีวิว ' || rank || ' (Rating: ' || star_rating || '/5): ' || substr(review_text, 1, 400), {NL} || {NL} ORDER BY rank)"
    out["answer_prompt"] = f"WITH {text_hits(K)}, ctx AS (SELECT query_id, {context} AS c FROM hits GROUP BY 1) SELECT query_id, CAST(0 AS INTEGER) AS pos, 'system' AS role, {q(answers.PROMPT_SYSTEM)} AS content FROM ctx UNION ALL SELECT query_id, 1, 'user', 'คำถาม: ' || query || {NL} || {NL} || 'ข้อมูลรีวิว:' || {NL} || c FROM ctx JOIN bq USING (query_id)"

    out["answer_router"] = f"WITH {text_hits(K)}, ctx AS (SELECT query_id, {context} AS c FROM hits GROUP BY 1), t AS (SELECT * FROM {answer('bq', 'hits', 'query_id')}) SELECT query_id, CASE WHEN query_id % 2 = 0 AND c IS NOT NULL THEN NULL ELSE answer END AS answer, CASE WHEN query_id % 2 = 0 THEN 'คำถาม: ' || query || {NL} || {NL} || 'ข้อมูลรีวิว:' || {NL} || c END AS user_message FROM t LEFT JOIN ctx USING (query_id)"

    def first(c: str, n: int) -> str:
        return f"array_to_string((string_split({c}, ', '))[1:{n}], ', ') AS {c}_shown"

    out["display_rows"] = f"WITH {text_hits(K)} SELECT query_id, CAST(rank AS INTEGER) AS rank, row_id, star_rating, {STARS} AS star_display, repeat('★', star_rating) || repeat('☆', 5 - star_rating) AS star_slots, {r6('score', 'score')}, {first('cuisine_type', 3)}, {first('food_type', 3)}, {first('location', 2)}, {excerpt('review_text', 400, False)} AS review_shown FROM hits"
    out["display_nested"] = f"WITH {text_hits(K)}, n AS (SELECT query_id, count(*) AS num_results FROM hits GROUP BY 1) SELECT query_id, num_results, CAST(rank AS INTEGER) AS rank, star_rating, {STARS} AS star_display, {r6('score', 'relevance_score')}, mentioned_foods FROM hits JOIN n USING (query_id)"
    out["demo_answers"] = f"WITH {text_hits(3)} SELECT query_id, {excerpt('answer', 500, False)} AS preview FROM {answer('bq', 'hits', 'query_id')}"
    quick = text_hits(3).replace(BENCH_QUERIES, f"bq(query_id, query) AS ({values(list(enumerate(catalog.QUICK_QUERIES)))})")
    out["quick_demo"] = f"WITH {quick} SELECT query_id, {excerpt('answer', 500, False)} AS preview FROM {answer('bq', 'hits', 'query_id')}"
    out["csv_scan"] = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS review_id, CAST(1 + doc_id % 5 AS INTEGER) AS star_rating, text AS review_text FROM documents"
    out["text_scan"] = f"""WITH l AS (SELECT item_id, unnest(regexp_split_to_array(text, '[\\r\\n]')) AS line, unnest(range(len(regexp_split_to_array(text, '[\\r\\n]')))) AS pos FROM benchmark)
SELECT rank, {strip('line')} AS term FROM (SELECT row_number() OVER (ORDER BY item_id, pos) - 1 AS rank, line FROM l) WHERE {strip('line')} <> ''"""
    out["csv_export"] = f"WITH {TAGGED} SELECT review_id, star_rating, food_type, location FROM tagged"
    out["model_index"] = f"WITH {PROCESSED} SELECT review_id, CAST(length('passage: ' || search_text) % 8 AS INTEGER) AS pos, 1.0::DOUBLE AS x FROM processed"

    def answered(within: str) -> str:
        """Requests answered from the rows found ``within`` some rank."""
        return f"""WITH {TEXT_SEARCH},
req AS (SELECT query_id, query, 3 + query_id % 3 AS k, (['base', 'finetuned', 'compare'])[CAST(query_id % 3 AS INTEGER) + 1] AS mode, query_id % 4 AS min_rating,
  CASE WHEN query_id % 7 = 3 THEN 'thai' ELSE '' END AS cuisine, CASE WHEN query_id % 2 = 0 THEN 'tea' ELSE '' END AS food FROM bq),
want AS (SELECT *, unnest(CASE mode WHEN 'compare' THEN ['base', 'tuned'] WHEN 'finetuned' THEN ['tuned'] ELSE ['base'] END) AS side FROM req),
found AS (SELECT w.side, h.query_id, h.row_id, h.score, p.* EXCLUDE (review_id), w.k, row_number() OVER (PARTITION BY w.side, h.query_id ORDER BY h.rank) AS rank
  FROM want w JOIN tranked h ON h.query_id = w.query_id AND h.space = w.side {within} JOIN processed p ON p.review_id = h.row_id
  WHERE (min_rating = 0 OR star_rating >= min_rating) AND (cuisine = '' OR list_contains(string_split(cuisine_type, ', '), cuisine)) AND (food = '' OR list_contains(string_split(food_type, ', '), food))),
kept AS (SELECT * FROM found WHERE rank <= k)
SELECT a.query_id, side, mode, num_results, answer FROM {answer('want', 'kept', 'query_id, side')} a JOIN req USING (query_id)"""

    out["search_and_answer"] = answered("AND h.rank <= 3 * w.k")
    out["search_and_answer_pre"] = answered("")
    out["retrieval_metrics"] = f"WITH {DENSE_HITS} SELECT u.query_id, category, coalesce(n, 0) AS num_results, {r6('coalesce(s, 0)', 'avg_score')}, {r6('coalesce(r, 0)', 'avg_rating')}, {r6('coalesce(c, 0)', 'metadata_coverage')} FROM dqueries u LEFT JOIN (SELECT query_id, count(*) AS n, avg(score) AS s, avg(star_rating) AS r, avg(covered) AS c FROM dhits WHERE space = 'base' GROUP BY 1) USING (query_id)"
    out["retrieval_overall"] = f"WITH {DENSE_HITS} SELECT {r6('avg(score)', 'avg_retrieval_score')}, {r6('avg(star_rating)', 'avg_star_rating')}, {r6('avg(covered) * 100', 'metadata_coverage')}, count(*) AS total_results, (SELECT count(*) FROM dqueries) AS num_queries FROM dhits WHERE space = 'base'"
    out["compare_spaces"] = f"WITH {COMPARE} SELECT query_id, category, {SCORES6}, {r6('score_improvement', 'score_improvement')} FROM cmp"
    out["category_summary"] = f'WITH {COMPARE} SELECT category, count(*) AS "count", {MEANS6} FROM cmp GROUP BY category'
    out["comparison_overall"] = f"WITH {COMPARE} SELECT {MEANS6} FROM cmp"
    titles = [(i, k, t) for i, (k, t) in enumerate(catalog.CATEGORY_TITLES)]
    direction = f"CASE WHEN i > 0 THEN {q(metrics.BETTER)} WHEN i < 0 THEN {q(metrics.WORSE)} ELSE {q(metrics.UNCHANGED)} END"

    def verdict(which: int) -> str:
        return "CASE " + " ".join(f"WHEN i > {v[0]} THEN {q(v[which])}" for v in metrics.VERDICTS) + f" ELSE {q(metrics.VERDICT_ELSE[which - 1])} END"

    demo = (
        TEXT_SEARCH.replace(BENCH_QUERIES, f"""
listed(query_id, category, query, description) AS ({values(cat_rows)}),
bq AS (SELECT CAST(query_id AS BIGINT) AS query_id, category, query, description FROM listed)""")
        + f""",
dqueries AS (SELECT query_id, query, category FROM bq),
dhits AS MATERIALIZED (SELECT d.*, t.star_rating, t.review_text, t.cuisine_type, t.food_type, t.location,
  CASE WHEN t.cuisine_type || t.food_type || t.location <> '' THEN 1.0 ELSE 0.0 END AS covered
  FROM tranked d JOIN processed t ON t.review_id = d.row_id WHERE rank <= {K})"""
        + COMPARE.removeprefix(DENSE_HITS)
    )
    for key, compared in (("evaluation", COMPARE), ("demo", demo)):
        out[f"{key}_report" if key == "evaluation" else "demo_evaluation"] = f"""WITH {compared}, titles(title_rank, category, title) AS ({values(titles)}),
rep AS (SELECT CAST(title_rank AS INTEGER) AS row_rank, category AS section, any_value(title) AS title, count(*) AS "count", {MEANS6}, avg(score_improvement) AS i, false AS o FROM cmp JOIN titles USING (category) GROUP BY ALL
  UNION ALL SELECT 5, 'overall', NULL, count(*), {MEANS6}, avg(score_improvement), true FROM cmp)
SELECT * EXCLUDE (i, o), {direction} AS direction, CASE WHEN o THEN {verdict(1)} END AS status, CASE WHEN o THEN {verdict(2)} END AS recommendation FROM rep"""
        described = ", description" if key == "demo" else ""
        source = "JOIN (SELECT query_id, description FROM bq) USING (query_id)" if key == "demo" else ""
        out[f"{key}_detail"] = f"""WITH {compared}, sides AS (SELECT *, unnest(['base', 'tuned']) AS space FROM dqueries), ans AS {answer('sides', 'dhits', 'query_id, space')},
rows_found AS (SELECT query_id, coalesce(string_agg(row_id, ', ' ORDER BY rank) FILTER (WHERE space = 'base'), '') AS baseline_hits,
  coalesce(string_agg(row_id, ', ' ORDER BY rank) FILTER (WHERE space = 'tuned'), '') AS finetuned_hits FROM dhits GROUP BY query_id)
SELECT query_id, category, cmp.query{described}, {SCORES6}, {r6('score_improvement', 'score_improvement')}, b.answer AS baseline_answer, f.answer AS finetuned_answer,
  coalesce(baseline_hits, '') AS baseline_hits, coalesce(finetuned_hits, '') AS finetuned_hits
FROM cmp JOIN (SELECT query_id, answer FROM ans WHERE space = 'base') b USING (query_id) JOIN (SELECT query_id, answer FROM ans WHERE space = 'tuned') f USING (query_id)
LEFT JOIN rows_found USING (query_id) {source}"""
    out["ir_metrics"] = f"""WITH {DENSE_HITS}, rel AS (SELECT DISTINCT CAST(label AS BIGINT) AS query_id, row_id FROM cells JOIN cleaned ON review_id = row_id),
tot AS (SELECT query_id, count(*) AS nr FROM rel GROUP BY 1),
jd AS (SELECT h.query_id, rank, r.row_id IS NOT NULL AS ok FROM dhits h LEFT JOIN rel r ON r.query_id = h.query_id AND r.row_id = h.row_id WHERE space = 'base'),
g AS (SELECT query_id, count(*) FILTER (WHERE ok) AS nf, min(rank) FILTER (WHERE ok) AS fr, sum(CASE WHEN ok THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM jd GROUP BY 1),
ideal AS (SELECT query_id, sum(1 / log2(i + 1)) AS best FROM (SELECT query_id, unnest(range(1, least(nr, {K}) + 1)) AS i FROM tot) GROUP BY 1)
SELECT query_id, coalesce(nr, 0) AS num_relevant, coalesce(nf, 0) AS num_found, {r6(f'coalesce(nf, 0) / {K}.0', 'precision_at_k')}, {r6('coalesce(nf / nr, 0)', 'recall_at_k')}, {r6('coalesce(1.0 / fr, 0)', 'reciprocal_rank')}, {r6('coalesce(dcg / best, 0)', 'ndcg_at_k')}
FROM dqueries LEFT JOIN tot USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN ideal USING (query_id)"""

    out["query_review_matches"] = f"WITH {CLEANED},{USER_QUERIES},{matches('uq', 'm')} SELECT uq.query_id, count(m.review_id) AS n_matches FROM uq LEFT JOIN m USING (query_id) WHERE query <> '' GROUP BY 1"
    out["pairs_query"] = f"WITH {SEARCHABLE},{Q_PAIRS} SELECT {PAIR_VIEW} FROM p_query"
    out["pairs_similar"] = f"WITH {SEARCHABLE},{S_PAIRS} SELECT {PAIR_VIEW} FROM p_similar"
    out["pairs_rating"] = f"WITH {SEARCHABLE},{R_PAIRS} SELECT {PAIR_VIEW} FROM p_rating"
    out["pairs_fill"] = f"WITH {SEARCHABLE},{R_PAIRS},{fill('p_rating')} SELECT {PAIR_VIEW} FROM p_fill"
    out["pairs_all"] = f"WITH {ALL_PAIRS} SELECT pair_id, strategy, left_id, right_id, text_a, text_b FROM ap"
    out["training_batches"] = f"WITH {ALL_PAIRS} SELECT pair_id // 16 AS batch, count(*) AS n_pairs, CAST(ceil((SELECT count(*) FROM ap) / 16.0) * 3 AS BIGINT) AS total_steps FROM ap GROUP BY 1"
    out["in_batch_loss"] = f"""WITH {ALL_PAIRS},{cells("SELECT pair_id, 'query: ' || text_a AS txt FROM ap", 'fa', 'pair_id')},{cells("SELECT pair_id, 'passage: ' || text_b AS txt FROM ap", 'fb', 'pair_id')},
wa AS (SELECT pair_id AS i, pair_id // 16 AS batch, f, tf / sqrt(sum(tf * tf) OVER (PARTITION BY pair_id)) AS w FROM fa),
wb AS (SELECT pair_id AS k, pair_id // 16 AS batch, f, tf / sqrt(sum(tf * tf) OVER (PARTITION BY pair_id)) AS w FROM fb),
dots AS (SELECT batch, i, k, sum(wa.w * wb.w) AS d FROM wa JOIN wb USING (batch, f) GROUP BY ALL),
logits AS (SELECT a.pair_id // 16 AS batch, a.pair_id AS i, b.pair_id AS k, 20.0 * coalesce(d, 0) AS s FROM ap a JOIN ap b ON a.pair_id // 16 = b.pair_id // 16 LEFT JOIN dots ON dots.i = a.pair_id AND dots.k = b.pair_id),
per AS (SELECT batch, i, ln(sum(exp(s - 20.0))) + 20.0 - max(CASE WHEN i = k THEN s END) AS loss FROM logits GROUP BY ALL)
SELECT batch, count(*) AS n_pairs, {r6('avg(loss)', 'loss')} FROM per GROUP BY batch"""
    return out


def _as_words(keyword: str) -> str:
    import regex

    return regex.sub(WORD_GAP, " ", keyword.lower()).strip()
