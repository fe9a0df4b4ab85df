"""The registered queries in DuckDB's SQL, written for themselves."""

from __future__ import annotations

from matchloom.functions.text import ADDRESS_RULES, LEGAL_RULES, LEXICAL_RULES


def _ascii(c: str) -> str:
    """The tables of documents and parts have Latin letters only, for which marks and the sharp s are all there is."""
    return rf"regexp_replace(replace(strip_accents({c}), 'ß', 'ss'), '[^\x00-\x7F]', ' ', 'g')"


def _clean_text(c: str) -> str:
    e = f"lower({_ascii(f'coalesce({c}, chr(32))')})"
    for pattern, to in (*LEGAL_RULES, *ADDRESS_RULES):
        e = f"regexp_replace({e}, '{pattern}', '{to}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({e}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _clean(c: str) -> str:
    e = f"regexp_replace(lower({_ascii(f'coalesce({c}, chr(32))')}), '[^a-z0-9 ]+', ' ', 'g')"
    for what, to in LEXICAL_RULES:
        e = f"replace({e}, '{what}', '{to}')"
    e = rf"regexp_replace(regexp_replace({e}, '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g')"
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


_RECORDS = f"r AS MATERIALIZED (SELECT doc_id AS id, lang AS country, {_clean('text')} AS name FROM documents)"
_TOKENS = f"{_RECORDS}, k AS MATERIALIZED (SELECT DISTINCT id, country, unnest({_words('name')}) AS token FROM r)"


def _blocked(cap: int) -> str:
    return f"""{_TOKENS}, rare AS (SELECT country, token FROM k WHERE id % 3 <> 0 GROUP BY ALL HAVING count(*) <= {cap}),
    b AS MATERIALIZED (SELECT q.id AS query, p.id AS candidate, count(*) AS shared FROM k q JOIN rare USING (country, token)
          JOIN k p USING (country, token) WHERE q.id % 3 = 0 AND p.id % 3 <> 0 GROUP BY ALL)"""


_B = _blocked(40)
_STATE = "regexp_extract({}, '(?:^| )([a-z]{{2}}|[a-z ]{{4,25}})(?: |$)', 1)"
_HOUSE = "regexp_extract({}, '(?:^| )([0-9]{{1,6}})(?: |$)', 1)"
_TRUTH = "t AS MATERIALIZED (SELECT q.id AS query, p.id AS candidate FROM r q JOIN r p ON q.country = p.country AND q.name = p.name WHERE q.id % 3 = 0 AND p.id % 3 <> 0)"
_V = "v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, label FROM embeddings)"


def _knn(same: str) -> str:
    return f"""{_V}, s AS (SELECT a.id AS query, b.id AS candidate, round(list_inner_product(a.x, b.x) / (a.n * b.n), 6) AS sim
      FROM v a JOIN v b ON a.id <> b.id {same}),
    g AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, candidate)::INT AS rank FROM s) WHERE rank <= 10)"""


_G = _knn("AND a.label = b.label")
_NAMES = """n AS (SELECT DISTINCT p_name FROM part), nk AS (SELECT DISTINCT p_name, unnest(list_append(string_split(p_name, ' '), '^' || p_name[1:1])) AS t FROM n),
 p AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM nk x JOIN nk y USING (t) JOIN (SELECT t FROM nk GROUP BY 1 HAVING count(*) <= 64) USING (t))"""
_SETS = "list_distinct({0}) AS x, list_distinct({1}) AS y"
_JACCARD = "CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END"


def _grams(c: str) -> str:
    return f"list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substr({c}, i, 3))"


def _jaccard(a: str, b: str) -> str:
    return f"WITH {_NAMES}, q AS (SELECT a, b, {_SETS.format(a, b)} FROM p) SELECT a, b, round({_JACCARD}, 6) AS value FROM q"


_GRAM = f"""q AS (SELECT a, b, list_distinct({_grams('a')}) AS x, list_distinct({_grams('b')}) AS y, {_words('a')} AS u, {_words('b')} AS w FROM p),
 j AS (SELECT a, b, round(CASE WHEN length(a) < 3 OR length(b) < 3 THEN len(list_intersect(u, w))::DOUBLE / len(list_distinct(list_concat(u, w))) ELSE {_JACCARD} END, 6) AS value FROM q)"""
#: A row of the table of common subsequences from the one before: the last place of a letter up to k is the best to match.
_LCS = """list_transform(range(0, length(y)::BIGINT + 1), lambda k: greatest(r[k + 1], CASE WHEN strpos(reverse(substr(y, 1, k)), substr(x, i + 1, 1)) > 0
      THEN r[k + 1 - strpos(reverse(substr(y, 1, k)), substr(x, i + 1, 1))] + 1 ELSE 0 END))"""
_RATIO = "CASE WHEN x = '' AND y = '' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * r[-1] / (length(x) + length(y)) END"


def _edits(windows: bool) -> str:
    """e: of each pair of names, and of both reversed, the edit-based measures from their definitions; partial needs windows."""
    free = """list_filter(range(greatest(1, i + 1 - reach), least(length(y), i + 1 + reach) + 1),
      lambda k: substr(y, k, 1) = substr(x, i + 1, 1) AND NOT list_contains(taken, k))"""
    # every window as long as the shorter string, those that overhang the longer one's ends too
    cut = """, f AS (SELECT a, b, a AS short, b AS long FROM u WHERE length(a) <= length(b) UNION ALL SELECT a, b, b, a FROM u WHERE length(b) <= length(a)),
 g AS MATERIALIZED (SELECT DISTINCT a, b, short, substr(long, greatest(i, 1), i + length(short) - greatest(i, 1)) AS piece
       FROM (SELECT *, unnest(range(2 - length(short), length(long) + 1)) AS i FROM f))"""
    return f"""u AS MATERIALIZED (SELECT a, b FROM p UNION SELECT reverse(a), reverse(b) FROM p),
 d AS (SELECT a, b, list_sort({_words('a')}) AS sa, list_sort({_words('b')}) AS sb FROM u),
 h AS (SELECT *, list_sort(list_intersect(sa, sb)) AS common, list_sort(list_distinct(list_filter(sa, lambda t: NOT list_contains(sb, t)))) AS x1,
       list_sort(list_distinct(list_filter(sb, lambda t: NOT list_contains(sa, t)))) AS y1 FROM d),
 k AS MATERIALIZED (SELECT a, b, array_to_string(sa, ' ') AS sort_a, array_to_string(sb, ' ') AS sort_b, array_to_string(common, ' ') AS base,
       array_to_string(list_concat(common, x1), ' ') AS with_a, array_to_string(list_concat(common, y1), ' ') AS with_b,
       len(sa) = 0 OR len(sb) = 0 AS none, len(common) > 0 AND (len(x1) = 0 OR len(y1) = 0) AS inside FROM h){cut if windows else ''},
 s AS (SELECT a AS x, b AS y FROM u UNION SELECT sort_a, sort_b FROM k UNION SELECT with_a, with_b FROM k UNION SELECT base, with_a FROM k
       UNION SELECT base, with_b FROM k{' UNION SELECT short, piece FROM g' if windows else ''}),
 lc AS (SELECT x, y, 0::BIGINT AS i, list_transform(range(0, length(y)::BIGINT + 1), lambda k: 0::BIGINT) AS r FROM s
        UNION ALL SELECT x, y, i + 1, {_LCS} FROM lc WHERE i < length(x)),
 w AS MATERIALIZED (SELECT x, y, {_RATIO} AS ratio FROM lc WHERE i = length(x)),
 jc AS (SELECT a AS x, b AS y, 0::BIGINT AS i, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach, []::BIGINT[] AS taken, '' AS ours FROM u
        UNION ALL SELECT x, y, i + 1, reach, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit) END, CASE WHEN hit IS NULL THEN ours ELSE ours || substr(x, i + 1, 1) END
        FROM (SELECT *, {free}[1] AS hit FROM jc WHERE i < length(x))),
 js AS (SELECT x, y, len(taken) AS m, len(list_filter(range(1, len(taken) + 1), lambda k: substr(ours, k, 1) <> substr(y, list_sort(taken)[k], 1))) / 2.0::DOUBLE AS swaps,
        len(list_filter(range(1, 5), lambda k: k <= least(length(x), length(y)) AND substr(x, 1, k) = substr(y, 1, k))) AS start FROM jc WHERE i = length(x)),
 jw AS (SELECT x, y, start, CASE WHEN m = 0 THEN 0.0 ELSE (m / length(x)::DOUBLE + m / length(y)::DOUBLE + (m - swaps) / m) / 3 END AS jaro FROM js),
 e AS MATERIALIZED (SELECT k.a, k.b, w1.ratio, w2.ratio AS sort_ratio, jaro + start * 0.1::DOUBLE * (1 - jaro) AS winkler,
       CASE WHEN none THEN 0.0 WHEN inside THEN 100.0 WHEN base = '' THEN w3.ratio ELSE greatest(w3.ratio, w4.ratio, w5.ratio) END AS set_ratio
       {", (SELECT max(ratio) FROM g JOIN w ON w.x = g.short AND w.y = g.piece WHERE g.a = k.a AND g.b = k.b) AS partial" if windows else ""}
       FROM k JOIN w w1 ON w1.x = k.a AND w1.y = k.b JOIN w w2 ON w2.x = sort_a AND w2.y = sort_b JOIN w w3 ON w3.x = with_a AND w3.y = with_b
       JOIN w w4 ON w4.x = base AND w4.y = with_a JOIN w w5 ON w5.x = base AND w5.y = with_b JOIN jw ON jw.x = k.a AND jw.y = k.b)"""


def _edit(measure: str) -> str:
    return f"WITH RECURSIVE {_NAMES}, {_edits(measure == 'partial')} SELECT a, b, round({measure}, 6) AS value FROM p JOIN e USING (a, b)"


def _jaccards(c: str) -> str:
    """Token and 3-gram Jaccard of strings of at least three characters."""
    of = lambda f: f"(SELECT {_JACCARD} FROM (SELECT {_SETS.format(f('a' if c == '' else 'reverse(a)'), f('b' if c == '' else 'reverse(b)'))}))"
    return f"round({of(_words)}, 6) AS {'addr' if c else 'name'}_tokens, round({of(_grams)}, 6) AS {'addr' if c else 'name'}_grams"


_TRI = "(CASE WHEN {0} = '' OR {1} = '' THEN -1 WHEN {0} = {1} THEN 1 ELSE 0 END)::INT"
_PIN, _HOUSE_NO = ("substr(a, 1, 1)", "substr(b, 1, 1)"), ("substr(a, 2, 1)", "substr(b, 2, 1)")
_BONES = "substr(translate({0}, ' aeiou', ''), 1, 32)"
#: n and m: the measures of the names and of the reversed names, which stand for the addresses.
_FIELDED = "FROM j JOIN e n USING (a, b) JOIN e m ON m.a = reverse(j.a) AND m.b = reverse(j.b)"
_FEATURES_11 = f"""j.a AS query, j.b AS candidate, round(n.ratio / 100, 6) AS name_ratio, round(m.ratio / 100, 6) AS addr_ratio, round(n.set_ratio / 100, 6) AS name_set,
 round(m.set_ratio / 100, 6) AS addr_set, (substr(j.a, 1, 1) = substr(j.b, 1, 1))::INT AS pin, (substr(j.a, 2, 1) = substr(j.b, 2, 1))::INT AS house,
 ({_BONES.format('j.a')} = {_BONES.format('j.b')})::INT AS skeleton, 0.0::DOUBLE AS stage1, 0.0::DOUBLE AS rank, 0.0::DOUBLE AS gap, 0.0::DOUBLE AS support"""
_SCORED = "s AS MATERIALIZED (SELECT source AS query, doc_id AS candidate, (doc_id * 37 % 71 + 30 * quality) / 100.0::DOUBLE AS prob, quality AS label FROM documents JOIN labels USING (doc_id)), c AS (SELECT q.query, coalesce(n_true, 0) AS n_true FROM (SELECT DISTINCT source AS query FROM documents) q LEFT JOIN (SELECT query, count(*) AS n_true FROM s WHERE label = 1 GROUP BY 1) USING (query))"
_F = "CASE WHEN np = 0 AND n_true = 0 THEN 1.0 WHEN np = 0 OR n_true = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / n_true) / (0.25 * tp / np + tp / n_true) END"
_SWEEP = f"""{_SCORED}, g AS (SELECT round(0.05 + i * 0.01, 2) AS threshold FROM range(91) x(i)),
 m AS (SELECT threshold, c.query, n_true, count(s.candidate)::DOUBLE AS np, coalesce(sum(s.label), 0)::DOUBLE AS tp
       FROM g CROSS JOIN c LEFT JOIN s ON s.query = c.query AND s.prob >= threshold GROUP BY ALL),
 w AS (SELECT threshold::DOUBLE AS threshold, round(avg({_F}), 6) AS macro_f FROM m GROUP BY 1)"""
_PAIRS = "o AS MATERIALIZED (SELECT query, candidate, (query * 31 + candidate * 17) % 101 / 100.0::DOUBLE AS prob FROM (SELECT DISTINCT o_custkey AS query, l_partkey AS candidate FROM orders JOIN lineitem ON o_orderkey = l_orderkey))"
_OWN = f"{_PAIRS}, w AS (SELECT * FROM o WHERE prob >= 0.8 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY prob DESC, query) = 1)"
_ORDER = "('0x' || substr(md5('42:' || {0}), 1, 15))::BIGINT"
_LISTS = """l AS (SELECT c_custkey AS query, coalesce(m, []) AS members FROM customer LEFT JOIN (SELECT o_custkey,
 list(CASE WHEN o_orderkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END || o_orderkey) AS m FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
_MARKS = """l AS (SELECT o_orderkey AS row_no, 'S1-' || (o_orderkey - o_orderkey % 2) AS id,
   CASE WHEN o_orderkey % 50 = 0 THEN 'S2-' || o_custkey || ',S2-' || o_custkey WHEN o_orderkey % 51 = 0 THEN 'S1-' || o_custkey
        WHEN o_orderkey % 52 = 0 THEN 'S2-' || o_custkey || ',,S3-1' WHEN o_orderkey % 53 = 0 THEN '' ELSE 'S3-' || o_custkey END AS members FROM orders),
 m AS (SELECT row_no, id, unnest(CASE WHEN members = '' THEN [] ELSE string_split(members, ',') END) AS member FROM l),
 need AS (SELECT DISTINCT 'S1-' || (o_orderkey + 2) AS id FROM orders), have AS (SELECT DISTINCT id FROM l),
 ok AS (SELECT unnest(['S2-' || c_custkey, 'S3-' || c_custkey]) AS member FROM customer WHERE c_custkey % 10 <> 3),
 i AS (SELECT 'duplicate_row' AS rule, count(*) AS n FROM (SELECT id FROM l GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'repeated_member', count(DISTINCT row_no) FROM (SELECT row_no FROM m GROUP BY row_no, member HAVING count(*) > 1)
  UNION ALL SELECT 'self_match', count(*) FROM m WHERE starts_with(member, 'S1-')
  UNION ALL SELECT 'bad_prefix', count(*) FROM m WHERE NOT regexp_matches(member, '^S[123]-')
  UNION ALL SELECT 'missing_row', count(*) FROM need WHERE id NOT IN (SELECT id FROM have)
  UNION ALL SELECT 'unexpected_row', count(*) FROM have WHERE id NOT IN (SELECT id FROM need)
  UNION ALL SELECT 'unknown_member', count(DISTINCT member) FROM m WHERE regexp_matches(member, '^S[23]-') AND member NOT IN (SELECT member FROM ok))"""
_STRANGE = "CASE WHEN doc_id % 7 = 0 THEN ' NaN ' WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'None' ELSE text END"
_NO_NULL = "CASE WHEN lower(trim(coalesce({0}, ''))) IN ('nan', 'none', 'null') THEN '' ELSE trim(coalesce({0}, '')) END"

ORACLE_SQL = {
    "entity_clean_rules": f"SELECT doc_id, {_clean_text('text')} AS clean FROM documents",
    "entity_clean_lexical": f"WITH r AS (SELECT doc_id, {_clean('text')} AS clean FROM documents) SELECT doc_id, clean, substr(translate(clean, ' aeiou', ''), 1, 32) AS skeleton, len({_words('clean')})::BIGINT AS n_tokens FROM r",
    "extract_pin_house_state": rf"""WITH r AS (SELECT doc_id, {_ascii('text')} AS raw, {_clean('text')} AS clean FROM documents)
        SELECT doc_id, nullif(regexp_extract(raw, '\b(\d{{5,6}})\b', 1), '') AS pin, nullif(regexp_extract(raw, '(\d+)', 1), '') AS number,
        {_HOUSE.format('clean')} AS house, nullif(regexp_extract(clean, '\b(\d{{5,6}})\b', 1), '') AS clean_pin, {_STATE.format('clean')} AS state FROM r""",
    "record_text": f"""SELECT p_partkey, '[' || upper(trim(p_brand)) || '] ' || {_clean_text('p_name')} || ' | ' || {_clean_text('p_type')} AS entity,
        'Name: ' || trim(p_name) || ' | Address: ' || trim(p_type) || ', ' || trim(p_brand) AS labelled,
        'query: ' || {_clean('p_name')} || ' [SEP] ' || {_clean('p_type')} || ' [SEP] ' || {_clean('p_brand')} || ' [SEP] ' || substr(translate({_clean('p_name')}, ' aeiou', ''), 1, 32) || ' [SEP]  [SEP] ' AS encoder FROM part""",
    "null_token_clean": f"""WITH s AS (SELECT doc_id, source, {_STRANGE} AS v FROM documents)
        SELECT doc_id, {_NO_NULL.format('v')} AS value, CASE WHEN lower(coalesce(v, '')) = 'nan' THEN '' ELSE coalesce(v, '') END AS raw,
        coalesce(nullif({_NO_NULL.format('v')}, ''), nullif({_NO_NULL.format('source')}, ''), '') AS filled FROM s""",
    "pool_union": "SELECT 'S2-' || c_custkey AS entity_id, c_name AS name, c_nationkey AS nation, 1::INT AS is_s2 FROM customer UNION ALL SELECT 'S3-' || s_suppkey, s_name, s_nationkey, 0 FROM supplier",
    "token_df_cap": f"WITH {_TOKENS} SELECT country, token, count(*) AS df FROM k GROUP BY ALL HAVING count(*) <= 40",
    "block_token": f"WITH {_B} SELECT * FROM b",
    "block_house": f"""WITH {_RECORDS}, h AS (SELECT id, country, {_HOUSE.format('name')} AS token FROM r), few AS (SELECT country, token FROM h WHERE id % 3 <> 0 AND token <> '' GROUP BY ALL HAVING count(*) <= 40)
        SELECT q.id AS query, p.id AS candidate FROM h q JOIN few USING (country, token) JOIN h p USING (country, token) WHERE q.id % 3 = 0 AND p.id % 3 <> 0""",
    "block_union": f"""WITH {_B}, h AS (SELECT id, country, {_HOUSE.format('name')} AS token FROM r), few AS (SELECT country, token FROM h WHERE id % 3 <> 0 AND token <> '' GROUP BY ALL HAVING count(*) <= 40)
        SELECT query, candidate FROM b UNION SELECT q.id, p.id FROM h q JOIN few USING (country, token) JOIN h p USING (country, token) WHERE q.id % 3 = 0 AND p.id % 3 <> 0""",
    "lexical_candidates": f"""WITH RECURSIVE r AS MATERIALIZED (SELECT p_partkey AS id, {_clean('p_brand')} AS country, {_clean('p_name')} AS name, {_clean("p_size || ' ' || p_type")} AS addr FROM part),
        k AS MATERIALIZED (SELECT DISTINCT id, country, unnest(list_concat({_words('name')}, {_words('addr')})) AS token FROM r),
        rare AS (SELECT country, token FROM k WHERE id % 3 <> 0 GROUP BY ALL HAVING count(*) <= 40),
        b AS MATERIALIZED (SELECT DISTINCT q.id AS query, p.id AS candidate FROM k q JOIN rare USING (country, token) JOIN k p USING (country, token) WHERE q.id % 3 = 0 AND p.id % 3 <> 0),
        few AS (SELECT country, name[1:5] AS token FROM r WHERE id % 3 <> 0 GROUP BY ALL HAVING count(*) <= 160),
        c AS (SELECT * FROM b UNION SELECT q.id, p.id FROM r q JOIN few ON few.country = q.country AND token = q.name[1:5] JOIN r p ON p.country = q.country AND p.name[1:5] = token
              WHERE q.id % 3 = 0 AND p.id % 3 <> 0 AND q.id NOT IN (SELECT query FROM b)),
        t AS (SELECT id, name, addr, {_STATE.format('addr')} AS state FROM r),
        f AS MATERIALIZED (SELECT query, candidate, q.name AS qn, p.name AS pn, q.addr AS qa, p.addr AS pa FROM c JOIN t q ON q.id = query JOIN t p ON p.id = candidate
              WHERE q.state = '' OR p.state = '' OR q.state = p.state),
        s AS (SELECT qn AS x, pn AS y FROM f UNION SELECT qa, pa FROM f),
        lc AS (SELECT x, y, 0::BIGINT AS i, list_transform(range(0, length(y)::BIGINT + 1), lambda k: 0::BIGINT) AS r FROM s UNION ALL SELECT x, y, i + 1, {_LCS} FROM lc WHERE i < length(x)),
        w AS MATERIALIZED (SELECT x, y, {_RATIO} AS ratio FROM lc WHERE i = length(x)),
        z AS (SELECT query, candidate, round(0.55::DOUBLE * n.ratio + 0.45::DOUBLE * a.ratio, 6) AS score FROM f JOIN w n ON n.x = qn AND n.y = pn JOIN w a ON a.x = qa AND a.y = pa),
        o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate DESC)::INT AS rank FROM z)
        SELECT * FROM o WHERE rank <= 10""",
    "pair_attributes": f"""WITH {_PAIRS} SELECT query, candidate, prob, c_name AS left_name, c_mktsegment AS left_kind, CASE WHEN p_size > 9 THEN p_name ELSE '' END AS right_name, p_type AS right_kind
        FROM o JOIN customer ON c_custkey = query JOIN part ON p_partkey = candidate""",
    "train_text_pairs": f"""WITH {_RECORDS}, {_TRUTH}, x AS (SELECT doc_id AS id, source FROM documents WHERE doc_id % 9 <> 0 AND trim(source) <> '')
        SELECT DISTINCT query, candidate, a.source AS left, b.source AS right FROM t JOIN x a ON a.id = query JOIN x b ON b.id = candidate""",
    "limited_scan": "SELECT '7' AS asked, least(7, count(*)) AS n FROM supplier UNION ALL SELECT 'all', count(*) FROM supplier",
    "candidate_file_pairs": f"WITH {_OWN} SELECT query::VARCHAR AS query, candidate::VARCHAR AS candidate FROM w",
    "isotonic_calibrate": f"""WITH {_SCORED}, g AS (SELECT prob, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS n FROM s GROUP BY 1), u AS (SELECT *, row_number() OVER (ORDER BY prob) AS i, sum(y) OVER (ORDER BY prob) AS sy, sum(n) OVER (ORDER BY prob) AS sn FROM g),
        m AS (SELECT k.i, a.i AS first, min((b.sy - a.sy + a.y) / (b.sn - a.sn + a.n)) AS least FROM u k JOIN u a ON a.i <= k.i JOIN u b ON b.i >= k.i GROUP BY ALL),
        c2 AS (SELECT i, max(least) AS calibrated FROM m GROUP BY 1) SELECT candidate, prob, round(calibrated, 6) AS calibrated FROM s JOIN u USING (prob) JOIN c2 USING (i)""",
    "block_prefix_fallback": f"""WITH {_blocked(2)}, x AS (SELECT id, country, name[1:5] AS token FROM r),
        few AS (SELECT country, token FROM x WHERE id % 3 <> 0 GROUP BY ALL HAVING count(*) <= 160)
        SELECT DISTINCT q.id AS query, p.id AS candidate FROM x q JOIN few USING (country, token) JOIN x p USING (country, token)
        WHERE q.id % 3 = 0 AND p.id % 3 <> 0 AND q.id NOT IN (SELECT query FROM b)""",
    "block_topk_shared_tokens": f"""WITH {_B}, g AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, candidate) <= 10)
        SELECT id AS query, len(list_distinct({_words('name')}))::BIGINT AS n_tokens, coalesce(c, '') AS candidates FROM r
        LEFT JOIN (SELECT query, string_agg(candidate::VARCHAR, ',' ORDER BY shared DESC, candidate) AS c FROM g GROUP BY 1) ON query = id WHERE id % 3 = 0""",
    "block_state_compat": f"""WITH {_B}, s AS (SELECT id, {_STATE.format('name')} AS state FROM r)
        SELECT query, candidate FROM b JOIN s x ON x.id = query JOIN s y ON y.id = candidate WHERE NOT (x.state <> '' AND y.state <> '' AND x.state <> y.state)""",
    "knn_partitioned": f"WITH {_G} SELECT * FROM g",
    "knn_global": f"WITH {_knn('')} SELECT * FROM g",
    "rank_gap_features": f"""WITH {_G} SELECT query, candidate, sim, (rank - 1)::INT AS rank0, first_value(sim) OVER w AS top1, round(first_value(sim) OVER w - sim, 6) AS gap_top,
        round(coalesce(sim - lead(sim) OVER w, 0), 6) AS gap_next FROM g WINDOW w AS (PARTITION BY query ORDER BY sim DESC, candidate)""",
    "cascade_prune": f"""WITH {_G}, c AS (SELECT query, candidate, rank AS position, round(sim * 2 - 1, 6) AS s, (query + candidate) % 10 / 10.0::DOUBLE AS j, query * candidate % 10 / 10.0::DOUBLE AS t FROM g),
        e AS (SELECT *, round(0.6 * least(1.0, greatest(0.0, CASE WHEN s >= 0 THEN s ELSE (s + 1) / 2 END)) + 0.2 * j + 0.2 * t, 6) AS legacy_s,
              round(0.6 * least(1.0, greatest(0.0, s)) + 0.2 * j + 0.2 * t, 6) AS plain_s FROM c),
        f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY legacy_s DESC, position, candidate)::INT AS lr, row_number() OVER (PARTITION BY query ORDER BY plain_s DESC, position, candidate)::INT AS pr FROM e)
        SELECT query, candidate, CASE WHEN lr <= 4 THEN legacy_s ELSE -1 END AS legacy, CASE WHEN lr <= 4 THEN lr ELSE 0 END AS legacy_rank,
        CASE WHEN pr <= 4 THEN plain_s ELSE -1 END AS score, CASE WHEN pr <= 4 THEN pr ELSE 0 END AS rank FROM f WHERE lr <= 4 OR pr <= 4""",
    "sim_token_jaccard": _jaccard(_words("a"), _words("b")),
    "sim_regex_jaccard": _jaccard(r"regexp_extract_all(lower(a), '\w+')", r"regexp_extract_all(lower(b), '\w+')"),
    "sim_ngram_jaccard": f"WITH {_NAMES}, {_GRAM} SELECT * FROM j",
    "sim_jaro_winkler_gated": f"WITH {_NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS value FROM p",
    "sim_jaro_winkler_classic": _edit("winkler"),
    "sim_indel_ratio": _edit("ratio"), "sim_token_set": _edit("set_ratio"), "sim_token_sort": _edit("sort_ratio"), "sim_partial": _edit("partial"),
    "pair_features_8": f"""WITH RECURSIVE {_NAMES}, {_GRAM}, {_edits(False)}, v AS (SELECT a, b, value, {_jaccards('')}, {_jaccards('r')} FROM j)
        SELECT a AS query, b AS candidate, round(winkler, 6) AS name_jw, name_tokens, name_grams, addr_tokens, addr_grams, {_TRI.format(*_PIN)} AS pin, value AS cosine, (length(b) % 2)::INT AS is_s2 FROM v JOIN e USING (a, b)""",
    "pair_features_11": f"WITH RECURSIVE {_NAMES}, {_GRAM}, {_edits(False)} SELECT {_FEATURES_11} {_FIELDED}",
    "pair_features_12": f"WITH RECURSIVE {_NAMES}, {_GRAM}, {_edits(False)} SELECT {_FEATURES_11}, j.value AS cosine {_FIELDED}",
    "pair_features_19": f"""WITH RECURSIVE {_NAMES}, {_GRAM}, {_edits(True)}, v AS (SELECT j.a, j.b, j.value AS sim, round(n.ratio, 6) AS name_ratio, round(n.set_ratio, 6) AS name_set,
        round(n.sort_ratio, 6) AS name_sort, round(n.partial, 6) AS name_partial, round(m.ratio, 6) AS addr_ratio, round(m.set_ratio, 6) AS addr_set, round(m.sort_ratio, 6) AS addr_sort {_FIELDED}),
        z AS (SELECT *, round(least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)), 6) AS long FROM v)
        SELECT a AS query, b AS candidate, sim, (row_number() OVER o - 1)::INT AS rank0, first_value(sim) OVER o AS top1, round(first_value(sim) OVER o - sim, 6) AS gap_top,
        round(coalesce(sim - lead(sim) OVER o, 0), 6) AS gap_next, round(jaro_winkler_similarity(a, b), 6) AS name_jw, name_ratio, name_set, name_sort, name_partial, addr_ratio, addr_set, addr_sort,
        {_TRI.format(*_PIN)} AS pin, {_TRI.format(*_HOUSE_NO)} AS house, (length(b) % 2)::INT AS is_s2, long AS name_length, long AS addr_length, (a = '' OR b = '')::INT AS name_empty
        FROM z WINDOW o AS (PARTITION BY a ORDER BY sim DESC, b)""",
    "sim_tristate": f"WITH {_NAMES}, q AS (SELECT a, b, CASE WHEN length(a) % 3 = 0 THEN '' ELSE a END AS x FROM p) SELECT a, b, (CASE WHEN x = '' OR b = '' THEN -1 WHEN x = b THEN 1 ELSE 0 END)::INT AS tri, (x <> '' AND x = b)::INT AS same, (x = '' OR b = '')::INT AS empty FROM q",
    "sim_len_ratio": f"WITH {_NAMES} SELECT a, b, round(least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)), 6) AS value FROM p",
    "sim_cosine": f"""WITH {_V}, u AS (SELECT label, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v), m AS (SELECT label, i, avg(c) AS c FROM u GROUP BY ALL),
        z AS (SELECT label, list(c ORDER BY i) AS y FROM m GROUP BY 1) SELECT id, round(list_inner_product(x, y) / (n * sqrt(list_inner_product(y, y))), 6) AS value FROM v JOIN z USING (label)""",
    "context_features": f"""WITH {_NAMES}, {_GRAM} SELECT a AS query, b AS candidate, value AS prob, count(*) OVER (PARTITION BY a) AS support,
        round(row_number() OVER (PARTITION BY a ORDER BY value DESC, b) / count(*) OVER (PARTITION BY a), 6) AS relative_rank,
        round(coalesce(max(value) OVER (PARTITION BY a) - nth_value(value, 2) OVER (PARTITION BY a ORDER BY value DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6) AS best_gap FROM j""",
    "label_pairs": f"WITH {_B}, {_TRUTH} SELECT b.query, b.candidate, (t.query IS NOT NULL)::INT AS label FROM b LEFT JOIN t ON b.query = t.query AND b.candidate = t.candidate",
    "blocking_recall": f"WITH {_B}, {_TRUTH}, f AS (SELECT count(*) AS found FROM b JOIN t USING (query, candidate)) SELECT found, (SELECT count(*) FROM t) AS total, round(found / greatest((SELECT count(*) FROM t), 1), 6) AS recall FROM f",
    "macro_f05": f"WITH {_SCORED}, m AS (SELECT c.query, n_true, count(s.candidate)::DOUBLE AS np, coalesce(sum(s.label), 0)::DOUBLE AS tp FROM c LEFT JOIN s ON s.query = c.query AND prob >= 0.5 GROUP BY ALL) SELECT round(avg({_F}), 6) AS macro_f, count(*) AS n_queries FROM m",
    "f05_threshold_sweep": f"WITH {_SWEEP} SELECT * FROM w",
    "best_threshold": f"WITH {_SWEEP} SELECT * FROM w ORDER BY macro_f DESC, threshold LIMIT 1",
    "decide_threshold": f"WITH {_PAIRS} SELECT * FROM o WHERE prob >= 0.8",
    "decide_ownership": f"WITH {_OWN} SELECT * FROM w",
    "match_lists": f"WITH {_OWN}, l AS (SELECT query, string_agg(candidate::VARCHAR, ',' ORDER BY prob DESC, candidate) AS m FROM w GROUP BY 1) SELECT c_custkey AS query, coalesce(m, '') AS matched FROM customer LEFT JOIN l ON query = c_custkey",
    "candidate_lists": f"WITH {_G}, l AS (SELECT query, string_agg(candidate::VARCHAR, ',' ORDER BY rank) AS m FROM g GROUP BY 1) SELECT vec_id AS query, coalesce(m, '') AS candidates FROM embeddings LEFT JOIN l ON query = vec_id",
    "validator_issues": f"WITH {_MARKS} SELECT * FROM i WHERE n > 0",
    "matches_outside_candidates": f"WITH {_PAIRS} SELECT query, candidate FROM o WHERE prob >= 0.5 AND prob < 0.6",
    "audit_profile": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE text END AS text, lang, source FROM documents)
        SELECT c.column, (SELECT count(*) FROM d) AS n_rows, c.n_blank FROM (SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS n_blank FROM d
        UNION ALL SELECT 'text', count(*) FILTER (text IS NULL OR trim(text) = '') FROM d UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL OR trim(lang) = '') FROM d
        UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR trim(source) = '') FROM d) c""",
    "gt_summary": f"""WITH {_LISTS} SELECT count(*) AS n, count(*) FILTER (len(members) = 0) AS n_single, round(100 * avg((len(members) = 0)::INT), 2) AS single_percent, count(*) FILTER (len(members) > 0) AS n_matched,
        sum(len(members))::BIGINT AS n_members, round(avg(len(members)), 3) AS mean_members, sum(len(list_filter(members, lambda x: starts_with(x, 'S2-'))))::BIGINT AS n_s2, sum(len(list_filter(members, lambda x: starts_with(x, 'S3-'))))::BIGINT AS n_s3 FROM l""",
    "gt_size_histogram": f"WITH {_LISTS} SELECT len(members)::INT AS size, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, size LIMIT 10",
    "country_distribution": "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1",
    "dedupe_encode_join": f"SELECT doc_id, sha256({_clean('text')}) AS code FROM documents",
    "embedding_cache_join": "SELECT doc_id, sha256(text) AS content FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 6 = 1 AND text <> 'old')",
    "train_positives": f"WITH {_RECORDS}, {_TRUTH} SELECT DISTINCT query, candidate FROM t",
    "train_triplets": f"""WITH {_B}, z AS (SELECT id, country, row_number() OVER (PARTITION BY country ORDER BY {_ORDER.format('id')}, id) - 1 AS place, count(*) OVER (PARTITION BY country) AS size FROM r WHERE id % 3 <> 0),
        e AS (SELECT query, candidate, country, place AS own, {_ORDER.format("query || ':' || candidate")} % (size - 1) AS pick FROM b JOIN z ON z.id = candidate WHERE size > 1)
        SELECT query, candidate, z.id AS negative FROM e JOIN z ON z.country = e.country AND z.place = CASE WHEN pick >= own THEN pick + 1 ELSE pick END""",
    "holdout_split": f"SELECT doc_id, CASE WHEN {_ORDER.format('doc_id')} % 100 < 20 THEN 'holdout' ELSE 'train' END AS split FROM documents",
    "sample_rows": f"SELECT o_orderkey FROM orders ORDER BY {_ORDER.format('o_orderkey')}, o_orderkey LIMIT 250",
    "split_loader": f"WITH {_RECORDS}, {_TRUTH}, q AS (SELECT id FROM r WHERE id % 3 = 0 ORDER BY id LIMIT 20) SELECT 'queries' AS part, count(*) AS n FROM q UNION ALL SELECT 'pool', least(count(*), 100) FROM r WHERE id % 3 <> 0 UNION ALL SELECT 'truth', count(*) FROM t WHERE query IN (SELECT id FROM q)",
    "dummy_subset": f"""WITH {_RECORDS}, {_TRUTH}, q AS (SELECT id FROM r WHERE id % 3 = 0 ORDER BY id LIMIT 50)
        SELECT candidate AS id FROM t WHERE query IN (SELECT id FROM q) UNION (SELECT id FROM r WHERE id % 3 <> 0 ORDER BY id LIMIT 100)""",
    "row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders",
    "stream_ownership": "WITH p AS (SELECT user_id AS query, event_id % 97 AS candidate, event_id * 31 % 101 / 100.0::DOUBLE AS prob FROM events) SELECT candidate, query, prob FROM p WHERE prob >= 0.3 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY prob DESC, query) = 1",
    "tsv_round_trip": f"""WITH d AS (SELECT 'S1-' || p_partkey AS entity_id, '"' || p_name AS business_name, p_size || ' ' || p_type AS a, CASE WHEN p_partkey % 5 = 0 THEN 'US' ELSE {_clean('p_brand')} END AS country_n FROM part),
        e AS (SELECT *, {_clean('business_name')} AS name_n, {_clean('a')} AS addr_n FROM d)
        SELECT entity_id, business_name, country_n, name_n, substr(translate(name_n, ' aeiou', ''), 1, 32) AS skeleton, {_HOUSE.format('addr_n')} AS house, {_STATE.format('addr_n')} AS state FROM e""",
    "list_file_round_trip": f"WITH {_OWN}, l AS (SELECT query, count(*) AS n FROM w GROUP BY 1) SELECT c_custkey AS query, coalesce(n, 0) AS n FROM customer LEFT JOIN l ON query = c_custkey",
    "decide_ownership_ids": f"WITH {_PAIRS}, s AS (SELECT 'S1-' || query AS query, 'S2-' || candidate AS candidate, prob FROM o WHERE prob >= 0.8) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY prob DESC, query) = 1",
    "holdout_split_ids": "SELECT 'S1-' || doc_id AS doc_id, CASE WHEN ('0x' || substr(md5('42:S1-' || doc_id), 1, 15))::BIGINT % 100 < 20 THEN 'holdout' ELSE 'train' END AS split FROM documents",
    "train_triplets_ids": f"""WITH {_RECORDS}, {_TRUTH}, z0 AS (SELECT 'S2-' || id AS id, country FROM r WHERE id % 3 <> 0),
        z AS (SELECT id, country, row_number() OVER (PARTITION BY country ORDER BY {_ORDER.format('id')}, id) - 1 AS place, count(*) OVER (PARTITION BY country) AS size FROM z0),
        b AS (SELECT DISTINCT 'S1-' || query AS query, 'S2-' || candidate AS candidate FROM t),
        e AS (SELECT query, candidate, country, size, place AS own, {_ORDER.format("query || ':' || candidate")} AS h FROM b JOIN z ON z.id = candidate),
        w AS (SELECT query, candidate, country, h % (size - 1) + CASE WHEN h % (size - 1) >= own THEN 1 ELSE 0 END AS place FROM e WHERE size > 1
              UNION ALL SELECT query, candidate, 'en', h % (SELECT count(*) FROM z WHERE country = 'en') FROM e WHERE size = 1 AND country <> 'en')
        SELECT query, candidate, z.id AS negative FROM w JOIN z USING (country, place)""",
    "knn_partitioned_ids": f"""WITH {_V}, s AS (SELECT 'S2-' || a.id AS query, 'S2-' || b.id AS candidate, round(list_inner_product(a.x, b.x) / (a.n * b.n), 6) AS sim FROM v a JOIN v b ON a.id <> b.id AND a.label = b.label)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, candidate)::INT AS rank FROM s) WHERE rank <= 10""",
    "stream_ownership_ids": "WITH p AS (SELECT 'S1-' || user_id AS query, 'S3-' || event_id % 97 AS candidate, event_id * 31 % 101 / 100.0::DOUBLE AS prob FROM events) SELECT candidate, query, prob FROM p WHERE prob >= 0.3 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY prob DESC, query) = 1",
    "transliterated_names": """WITH n AS (SELECT p_partkey, ['aeroskobing lodz', 'moskva shchuka', 'nmste', 'ellada', 'tmilll', 'dorde pvtltd', 'strasse 2 nd fl', 'ltd'][p_partkey % 8 + 1] AS x,
        ['aeroskobing lodz', 'moskva shchuka', 'nmste', 'ellada', 'tmilll', 'dorde pvt ltd', 'strasse second floor', 'ltd'][p_partkey % 8 + 1] AS y FROM part)
        SELECT p_partkey, x || ' ' || p_partkey AS lexical, y || ' ' || p_partkey AS rules FROM n""",
    "short_names": """WITH n AS (SELECT p_partkey AS id, 'aei' || CASE WHEN p_brand[7:7] > '2' THEN p_brand[7:7] || 'bm ltd' ELSE '' END AS name FROM part)
        SELECT q.id AS query, p.id AS candidate, (replace(translate(q.name, 'aeiou', ''), ' ', '') = replace(translate(p.name, 'aeiou', ''), ' ', ''))::INT AS skeleton, 0 AS pin, 0 AS house
        FROM n q JOIN n p ON q.name[1:5] = p.name[1:5] WHERE q.id % 20 = 0 AND p.id % 20 BETWEEN 1 AND 2""",
    "nonblank_text": "SELECT doc_id, source AS text FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0 AND trim(source) <> ''",
    "pair_cap": f"WITH {_PAIRS} SELECT query, candidate FROM o ORDER BY query, candidate LIMIT 200",
    "positive_cap": f"WITH {_PAIRS} SELECT query, candidate FROM o WHERE prob >= 0.5 ORDER BY {_ORDER.format("query || ':' || candidate")}, query, candidate LIMIT 300",
    "ownership_f05": f"""WITH {_PAIRS}, w AS (SELECT * FROM o WHERE prob >= 0.6 QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY prob DESC, query) = 1),
        m AS (SELECT c_custkey AS query, (SELECT count(*) FROM o WHERE o.query = c_custkey AND o.query % 3 = o.candidate % 3) AS n_true, (SELECT count(*)::DOUBLE FROM w WHERE w.query = c_custkey) AS np,
              (SELECT count(*)::DOUBLE FROM w WHERE w.query = c_custkey AND w.query % 3 = w.candidate % 3) AS tp FROM customer)
        SELECT round(avg({_F}), 6) AS macro_f, count(*) AS n_queries FROM m""",
    "dummy_subset_test": f"""WITH {_RECORDS}, {_TRUTH}, q AS (SELECT id FROM r WHERE id % 3 = 0 ORDER BY id LIMIT 20 OFFSET 50)
        SELECT candidate AS id FROM t WHERE query IN (SELECT id FROM q) UNION (SELECT id FROM r WHERE id % 3 <> 0 ORDER BY id LIMIT 50 OFFSET 100)""",
    "file_rules": "SELECT 'comma_header' AS rule, 1::BIGINT AS n UNION ALL SELECT 'row_without_tab', count(*) FROM orders WHERE o_orderkey % 10 = 0",
    "embedding_cache_append": "SELECT doc_id, (1 + (doc_id % 4 <> 0 AND doc_id % 6 = 1 AND text <> 'new')::INT)::BIGINT AS versions, 16::INT AS dim FROM documents",
    "audit_output": """SELECT 'c_custkey' AS "column", count(*) AS n_rows, count(*) FILTER (c_custkey IS NULL) AS n_blank, count(*) AS json_rows FROM customer
        UNION ALL SELECT 'c_name', count(*), count(*) FILTER (trim(coalesce(c_name, '')) = ''), count(*) FROM customer
        UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (trim(coalesce(c_mktsegment, '')) = ''), count(*) FROM customer""",
    "pair_scorer": f"WITH {_NAMES}, q AS (SELECT a, b, {_SETS.format(_words('a'), _words('b'))} FROM p) SELECT a AS query, b AS candidate, round({_JACCARD}, 6) AS prob FROM q",
}
