"""Reference SQL for the catalogue, runnable by DuckDB over the same parquet
tables (views ``lineitem``, ``orders``, ``part``, ``embeddings`` ...).

Each statement restates a query's semantics independently of the Spark code:
the fixture derivation, the parser's accept/reject rules, the split rules,
scores as double dot products, ranks by (score desc, item_id asc), and floats
rounded to 6 decimals. Of the model queries (ALS) SQL gives what doesn't depend
on the fit: keys, counts, ranks, and that no check of theirs fails.
"""

from __future__ import annotations

# Python's str.strip() set (every code point with str.isspace()), as SQL and RE2.
_PY_WS = [ord(c) for c in map(chr, range(0x110000)) if c.isspace()]
WS = "(" + " || ".join(f"chr({c})" for c in _PY_WS) + ")"
_WS_RE = "[" + "".join(f"\\x{{{c:04x}}}" for c in _PY_WS) + "]"
INT_RE = f"'^{_WS_RE}*[+-]?[0-9]+{_WS_RE}*$'"
FLOAT_RE = (f"'(?i)^{_WS_RE}*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?"
            f"|inf|infinity|nan){_WS_RE}*$'")

CTE = {
    "ratings_all": """ratings_all AS (
    SELECT CAST(o.o_custkey AS INTEGER) AS user_id,
           CAST(l.l_partkey AS INTEGER) AS item_id,
           CAST(floor(l.l_quantity / 10) AS DOUBLE) AS rating,
           CAST(epoch(o.o_orderdate) AS BIGINT)
             + (l.l_orderkey * 7 + l.l_linenumber) % 86400 AS ts
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "base": "base AS (SELECT * FROM ratings_all WHERE user_id <> 0)",
    "personal": "personal AS (SELECT * FROM ratings_all WHERE user_id = 0 AND rating > 0)",
    "items": """items AS (
    SELECT CAST(p_partkey AS INTEGER) AS item_id,
           string_split(trim(concat_ws('::', p_partkey, p_name), {ws}), '::')[2] AS title
    FROM part)""".format(ws=WS),
    "bucketed": """bucketed AS (
    SELECT *, CASE WHEN ((ts % 10) + 10) % 10 < 6 THEN 'train'
                   WHEN ((ts % 10) + 10) % 10 < 8 THEN 'validation'
                   ELSE 'test' END AS split
    FROM base)""",
    "training": """training AS (
    SELECT user_id, item_id FROM bucketed WHERE split = 'train'
    UNION ALL SELECT user_id, item_id FROM personal)""",
    "known": """known AS (
    SELECT b.* FROM bucketed b WHERE b.split <> 'train'
      AND b.user_id IN (SELECT user_id FROM training)
      AND b.item_id IN (SELECT item_id FROM training))""",
    "spoiled": """spoiled AS (
    SELECT CASE (CAST(user_id AS BIGINT) * 7 + CAST(item_id AS BIGINT) * 3 + ts) % 20
             WHEN 0 THEN concat_ws('::', user_id, item_id, rating)
             WHEN 1 THEN concat_ws('::', 'u' || user_id, item_id, rating, ts)
             WHEN 2 THEN concat_ws('::', user_id, item_id || '.0', rating, ts)
             WHEN 3 THEN concat_ws('::', user_id, item_id, 'five', ts)
             WHEN 4 THEN concat_ws('::', user_id, item_id, rating, ts || 'e0')
             WHEN 5 THEN ' ' || chr(9) || concat_ws('::', user_id, item_id, rating, ts) || '  '
             WHEN 6 THEN concat_ws('::', user_id, item_id, rating, ts, 'more')
             WHEN 7 THEN concat_ws('::', user_id, item_id, rating, '-' || ts)
             ELSE concat_ws('::', user_id, item_id, rating, ts) END AS line
    FROM base)""",
    "counts": "counts AS (SELECT item_id, count(*) AS n_ratings FROM base GROUP BY item_id)",
    "rated": """rated AS (SELECT user_id, item_id FROM base
                 UNION ALL SELECT user_id, item_id FROM personal)""",
    "ufac": """ufac AS (SELECT CAST(vec_id AS INTEGER) AS user_id,
                        CAST(embedding AS DOUBLE[]) AS uf
                 FROM embeddings WHERE vec_id % 5 = 0)""",
    "ifac": """ifac AS (SELECT CAST(vec_id AS INTEGER) AS item_id,
                        CAST(embedding AS DOUBLE[]) AS vf
                 FROM embeddings WHERE vec_id % 5 <> 0)""",
    "titles": "titles AS (SELECT item_id, max(title) AS title FROM items GROUP BY item_id)",
    "candidates": """candidates AS (
    SELECT i.item_id FROM items i
    WHERE NOT EXISTS (SELECT 1 FROM personal p WHERE p.item_id = i.item_id))""",
    "train_stats": """train_stats AS (
    SELECT item_id, count(*) AS c, sum(rating) AS s FROM bucketed
    WHERE split = 'train' GROUP BY item_id)""",
    "heldout_pred": """heldout_pred AS (
    SELECT b.split, b.user_id, b.item_id, b.rating, t.s / t.c AS prediction
    FROM bucketed b JOIN train_stats t USING (item_id) WHERE b.split <> 'train')""",
    "damped": """damped AS (
    SELECT d.damping,
           sqrt(avg(power((t.s + d.damping * g.gm) / (t.c + d.damping) - b.rating, 2))) AS rmse
    FROM bucketed b JOIN train_stats t USING (item_id)
    JOIN (SELECT unnest([0.0, 5.0, 10.0, 25.0, 50.0]::DOUBLE[]) AS damping) d ON TRUE
    JOIN (SELECT avg(rating) AS gm FROM bucketed WHERE split = 'train') g ON TRUE
    WHERE b.split = 'validation'
    GROUP BY d.damping)""",
}

_DEPS = {
    "base": ["ratings_all"], "personal": ["ratings_all"], "bucketed": ["base"],
    "counts": ["base"], "rated": ["base", "personal"], "titles": ["items"],
    "training": ["bucketed", "personal"], "known": ["bucketed", "training"], "spoiled": ["base"],
    "candidates": ["items", "personal"], "train_stats": ["bucketed"],
    "heldout_pred": ["bucketed", "train_stats"], "damped": ["bucketed", "train_stats"],
}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n"


def _rating_parse(lines_sql: str) -> str:
    """The rating-line parser in SQL: fields, reason (NULL when accepted)."""
    return f"""parsed AS (
    SELECT line, f, len(f) AS nf,
           CASE WHEN regexp_full_match(f[1], {INT_RE}) THEN TRY_CAST(trim(f[1], {WS}) AS INTEGER) END AS user_id,
           CASE WHEN regexp_full_match(f[2], {INT_RE}) THEN TRY_CAST(trim(f[2], {WS}) AS INTEGER) END AS item_id,
           CASE WHEN regexp_full_match(f[3], {FLOAT_RE}) THEN TRY_CAST(trim(f[3], {WS}) AS DOUBLE) END AS rating,
           CASE WHEN regexp_full_match(f[4], {INT_RE}) THEN TRY_CAST(trim(f[4], {WS}) AS BIGINT) END AS ts
    FROM (SELECT line, string_split(trim(line, {WS}), '::') AS f FROM ({lines_sql}) src)),
  judged AS (
    SELECT *, CASE WHEN nf < 4 THEN 'too few fields'
                   WHEN user_id IS NULL THEN 'user_id'
                   WHEN item_id IS NULL THEN 'item_id'
                   WHEN rating IS NULL THEN 'rating'
                   WHEN ts IS NULL THEN 'ts' END AS reason
    FROM parsed)"""


def _ranked(scored: str, n: int) -> str:
    return f"""ranked AS (
    SELECT user_id, item_id, score,
           row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id ASC) AS rank
    FROM ({scored}) s)
  SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score
  FROM ranked WHERE rank <= {n}"""


def _profile_scores(item_filter: str) -> str:
    return f"""SELECT u.user_id, i.item_id, list_dot_product(u.uf, i.vf) AS score
      FROM ufac u JOIN ifac i ON u.user_id = 0 AND {item_filter}"""


SQL: dict[str, str] = {}

SQL["parse_ratings"] = _with("base") + """
SELECT user_id, item_id, rating, ts, CAST(((ts % 10) + 10) % 10 AS INTEGER) AS bucket FROM base"""

SQL["item_stats"] = _with("base") + """
SELECT item_id, count(*) AS n_ratings, round(avg(rating), 6) AS avg_rating
FROM base GROUP BY item_id"""

SQL["parse_items"] = _with("items") + "SELECT item_id, title FROM items"

SQL["parse_rejects"] = _with("spoiled", "items") + ",\n  " + _rating_parse(
    "SELECT line FROM spoiled "
    "UNION ALL SELECT concat_ws('::', item_id, title) AS line FROM items") + """
SELECT line, reason FROM judged WHERE reason IS NOT NULL"""

SQL["parse_text_files"] = _with("spoiled") + ",\n  " + _rating_parse("SELECT line FROM spoiled") + """
SELECT user_id, item_id, rating, ts, CAST(((ts % 10) + 10) % 10 AS INTEGER) AS bucket
FROM judged WHERE reason IS NULL"""

_POSTS = """posts AS (
    SELECT (l.l_orderkey * 3 + l.l_partkey + l.l_linenumber) % 16 AS kind,
           CAST(o.o_custkey AS INTEGER) AS user_id, CAST(l.l_partkey AS INTEGER) AS item_id,
           CAST(floor(l.l_quantity / 10) AS BIGINT) AS stars
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

SQL["posted_rejects"] = "WITH " + _POSTS + """
SELECT CASE kind WHEN 0 THEN 'post ' || item_id || ' {' WHEN 1 THEN NULL
            WHEN 2 THEN concat_ws(',', item_id, stars) WHEN 3 THEN CAST(item_id AS VARCHAR)
            WHEN 4 THEN concat_ws(',', 'p' || item_id, stars) ELSE item_id || ',high' END AS line,
       CASE kind WHEN 0 THEN 'corrupt record' WHEN 1 THEN 'no body' WHEN 2 THEN 'user_id'
            WHEN 3 THEN 'too few fields' WHEN 4 THEN 'item_id' ELSE 'rating' END AS reason
FROM posts WHERE kind < 6"""

SQL["ratings_with_posts"] = _with("base").replace("WITH ", "WITH " + _POSTS + ",\n", 1) + """
SELECT item_id, count(*) AS n_ratings, round(avg(rating), 6) AS avg_rating
FROM (SELECT item_id, rating FROM base
      UNION ALL SELECT item_id, CAST(stars AS DOUBLE) FROM posts WHERE kind >= 6) r
GROUP BY item_id"""

SQL["parse_posted"] = _with("ratings_all") + "SELECT user_id, item_id, rating FROM ratings_all"

SQL["positive_ratings"] = _with("ratings_all") + """
SELECT user_id, item_id, rating, ts, CAST(((ts % 10) + 10) % 10 AS INTEGER) AS bucket
FROM ratings_all WHERE rating > 0 AND ts % 17 <> 0"""

SQL["rating_stats"] = _with("base") + """
SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users,
       count(DISTINCT item_id) AS n_items FROM base"""

SQL["item_counts"] = _with("counts") + "SELECT item_id, n_ratings FROM counts"

SQL["split_bucket"] = _with("bucketed") + "SELECT user_id, item_id, rating, ts, split FROM bucketed"

SQL["split_hash"] = _with("base") + """
SELECT user_id, item_id, rating, ts,
       CASE WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', user_id, item_id, ts, 24)), 1, 8))::BIGINT % 10 AS h
      FROM base) t"""

SQL["split_exact"] = _with("base") + """
SELECT user_id, item_id, rating, ts,
       CASE WHEN r <= n * 6 // 10 THEN 'train' WHEN r <= n * 8 // 10 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', user_id, item_id, rating, ts, 24))) AS r,
             count(*) OVER () AS n FROM base) t"""

SQL["split_sizes"] = _with("bucketed") + """,
  hashed AS (
    SELECT CASE WHEN h < 6 THEN 'train' WHEN h < 8 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT ('0x' || substr(md5(concat_ws('|', user_id, item_id, ts, 24)), 1, 8))::BIGINT % 10 AS h
          FROM base) t)
SELECT 'bucket' AS method, split, count(*) AS n FROM bucketed GROUP BY split
UNION ALL
SELECT 'hash' AS method, split, count(*) AS n FROM hashed GROUP BY split"""

SQL["training_union"] = _with("bucketed", "personal") + """
SELECT user_id, item_id, rating FROM bucketed WHERE split = 'train'
UNION ALL SELECT user_id, item_id, rating FROM personal"""

SQL["training_union_presplit"] = _with("base", "personal") + """
SELECT user_id, item_id, rating
FROM (SELECT * FROM base UNION ALL SELECT * FROM personal) u
WHERE ((ts % 10) + 10) % 10 < 6"""

SQL["excluded_items"] = _with("personal") + "SELECT DISTINCT item_id FROM personal"

SQL["candidate_items"] = _with("candidates") + "SELECT item_id FROM candidates"

SQL["candidate_pairs"] = _with("candidates") + \
    "SELECT CAST(0 AS INTEGER) AS user_id, item_id FROM candidates"

SQL["unrated_pairs"] = _with("items", "rated") + """
SELECT CAST(0 AS INTEGER) AS user_id, i.item_id FROM items i
WHERE NOT EXISTS (SELECT 1 FROM rated r WHERE r.user_id = 0 AND r.item_id = i.item_id)"""

_SCORED_BASE = """scored AS (
    SELECT p.user_id, p.item_id, list_dot_product(u.uf, i.vf) AS score
    FROM (SELECT DISTINCT user_id, item_id FROM {src}) p
    JOIN ufac u ON u.user_id = p.user_id JOIN ifac i ON i.item_id = p.item_id)"""

SQL["score_pairs"] = _with("base", "ufac", "ifac") + ",\n  " + _SCORED_BASE.format(src="base") + """
SELECT user_id, item_id, round(score, 6) AS score FROM scored"""

SQL["enrich_predictions"] = _with("base", "ufac", "ifac", "titles", "counts") + ",\n  " + \
    _SCORED_BASE.format(src="base") + """
SELECT s.user_id, s.item_id, t.title, round(s.score, 6) AS score, c.n_ratings
FROM scored s JOIN titles t USING (item_id) JOIN counts c USING (item_id)"""

SQL["score_requested"] = _with("ratings_all", "base", "ufac", "ifac", "titles", "counts") + \
    ",\n  " + _SCORED_BASE.format(src="ratings_all") + """
SELECT s.user_id, s.item_id, t.title, round(s.score, 6) AS score, c.n_ratings
FROM scored s JOIN titles t USING (item_id) JOIN counts c USING (item_id)"""

SQL["hot_item_join"] = _with("base", "titles", "counts") + """
SELECT b.user_id, b.item_id, b.rating, b.ts, t.title, c.n_ratings
FROM base b LEFT JOIN (titles t JOIN counts c USING (item_id)) ON t.item_id = b.item_id"""

SQL["top_n_global"] = _with("ufac", "ifac", "candidates") + ",\n  " + _ranked(
    _profile_scores("i.item_id IN (SELECT item_id FROM candidates)"), 10)

SQL["popular_top_n"] = _with("ufac", "ifac", "items", "titles", "counts", "rated") + """,
  scored AS (""" + _profile_scores(
    "i.item_id IN (SELECT item_id FROM items) "
    "AND i.item_id IN (SELECT item_id FROM counts WHERE n_ratings >= 25) "
    "AND NOT EXISTS (SELECT 1 FROM rated r WHERE r.user_id = u.user_id AND r.item_id = i.item_id)") + """),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id ASC) AS rank
    FROM scored)
SELECT r.user_id, CAST(r.rank AS INTEGER) AS rank, r.item_id, t.title,
       round(r.score, 6) AS score, c.n_ratings
FROM ranked r JOIN titles t USING (item_id) JOIN counts c USING (item_id)
WHERE r.rank <= 10"""

SQL["top_n_per_user"] = _with("ufac", "ifac") + ",\n  " + _ranked(
    "SELECT u.user_id, i.item_id, list_dot_product(u.uf, i.vf) AS score FROM ufac u, ifac i", 5)

SQL["unrated_top_n"] = _with("ufac", "ifac", "counts", "rated") + ",\n  " + _ranked(
    """SELECT u.user_id, i.item_id, list_dot_product(u.uf, i.vf) AS score FROM ufac u, ifac i
       WHERE i.item_id IN (SELECT item_id FROM counts WHERE n_ratings >= 25)
         AND NOT EXISTS (SELECT 1 FROM rated r WHERE r.user_id = u.user_id AND r.item_id = i.item_id)""",
    10)

SQL["exclusion_sets"] = _with("rated", "ifac") + """
SELECT DISTINCT r.user_id, r.item_id FROM rated r JOIN ifac i USING (item_id)"""

SQL["pruned_top_n"] = SQL["unrated_top_n"]

SQL["recommend_titles"] = _with("ufac", "ifac", "candidates", "titles") + """,
  scored AS (""" + _profile_scores("i.item_id IN (SELECT item_id FROM candidates)") + """),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id ASC) AS rank
    FROM scored)
SELECT r.user_id, CAST(r.rank AS INTEGER) AS rank, r.item_id, t.title, round(r.score, 6) AS score
FROM ranked r JOIN titles t USING (item_id) WHERE r.rank <= 10"""

SQL["recs_json"] = _with("ufac", "ifac") + """,
  ranked AS (
    SELECT user_id, item_id, score,
           row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id ASC) AS rank
    FROM (SELECT u.user_id, i.item_id, list_dot_product(u.uf, i.vf) AS score
          FROM ufac u, ifac i) s)
SELECT user_id,
       CAST(to_json(list({'item_id': item_id, 'score': round(score, 6)} ORDER BY rank)) AS VARCHAR)
         AS recs
FROM ranked WHERE rank <= 5 GROUP BY user_id"""

SQL["rmse"] = _with("heldout_pred") + """
SELECT split, count(*) AS n, round(sqrt(avg(power(prediction - rating, 2))), 6) AS rmse
FROM heldout_pred GROUP BY split"""

SQL["rmse_pairwise"] = _with("heldout_pred") + """
SELECT p.split, count(*) AS n, round(sqrt(avg(power(p.prediction - a.rating, 2))), 6) AS rmse
FROM heldout_pred p JOIN bucketed a
  ON a.split = p.split AND a.user_id = p.user_id AND a.item_id = p.item_id
GROUP BY p.split"""

SQL["damped_mean_search"] = _with("damped") + "SELECT damping, round(rmse, 6) AS rmse FROM damped"

SQL["select_best"] = _with("damped") + """
SELECT damping, round(rmse, 6) AS rmse FROM damped ORDER BY rmse ASC, damping ASC LIMIT 1"""

SQL["stream_ingest"] = SQL["parse_posted"]

SQL["report_sink"] = SQL["recommend_titles"]

SQL["ratings_table"] = _with("base") + """
SELECT user_id, item_id, rating, ts, CAST(((ts % 10) + 10) % 10 AS INTEGER) AS bucket
FROM base WHERE ((ts % 10) + 10) % 10 < 6"""

SQL["stream_replayed_posts"] = SQL["parse_posted"]

SQL["sketched_stats"] = _with("ratings_all", "base") + """
SELECT (SELECT count(*) FROM base) + (SELECT count(*) FROM ratings_all) AS n_ratings,
       TRUE AS users_near, TRUE AS items_near"""

SQL["stream_item_stats"] = _with("ratings_all") + """
SELECT item_id, count(*) AS n_ratings, round(avg(rating), 6) AS avg_rating
FROM ratings_all GROUP BY item_id"""

# ---- model queries: what a correct fit of any quality must give ---------------

_KNOWN_REQUESTED = """SELECT DISTINCT user_id, item_id FROM ratings_all
    WHERE user_id IN (SELECT user_id FROM training) AND item_id IN (SELECT item_id FROM training)"""

SQL["als_rmse"] = _with("known") + """
SELECT split, count(*) AS n, TRUE AS measured FROM known GROUP BY split"""

SQL["als_score"] = _with("known") + """
SELECT user_id, item_id, rating, TRUE AS is_dot FROM known WHERE split = 'test'"""

SQL["model_roundtrip"] = _with("training") + """
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
       CAST(0 AS BIGINT) AS n_changed FROM training"""

SQL["als_rmse_pairwise"] = _with("known") + """
SELECT split, CAST(sum(k * k) AS BIGINT) AS n, TRUE AS measured
FROM (SELECT split, user_id, item_id, count(*) AS k FROM known GROUP BY ALL) p GROUP BY split"""

SQL["als_score_requested"] = _with("ratings_all", "training", "titles", "counts") + f"""
SELECT s.user_id, s.item_id, t.title, c.n_ratings, TRUE AS scored
FROM ({_KNOWN_REQUESTED}) s JOIN titles t USING (item_id) JOIN counts c USING (item_id)"""

SQL["als_rank_search"] = "SELECT CAST(unnest([4, 6, 8, 10, 12]) AS INTEGER) AS rank, TRUE AS measured"

SQL["als_select_best"] = """SELECT CAST(5 AS BIGINT) AS n_ranks, CAST(1 AS BIGINT) AS n_best,
       CAST(0 AS BIGINT) AS n_better"""


def _lists(users: str, n: int, items: str, rated: str | None) -> str:
    """Per user: the list's length, and that no row of it breaks a rule."""
    rated_too = (f"(SELECT count(DISTINCT r.item_id) FROM {rated} r WHERE r.user_id = u.user_id"
                 f" AND r.item_id IN ({items}))") if rated else "0"
    return f"""
SELECT u.user_id, CAST(least({n}, (SELECT count(*) FROM ({items}) i) - {rated_too}) AS BIGINT) AS n_items,
       CAST(0 AS BIGINT) AS n_broken
FROM (SELECT DISTINCT user_id FROM {users}) u
WHERE u.user_id IN (SELECT user_id FROM training)
  AND (SELECT count(*) FROM ({items}) i) > {rated_too}"""


_FITTED = "SELECT DISTINCT item_id FROM training"
SQL["als_recommend"] = _with("training", "counts", "rated") + _lists(
    "training", 10, _FITTED + " WHERE item_id IN (SELECT item_id FROM counts WHERE n_ratings >= 25)", "rated")
SQL["als_recommend_subset"] = _with("training", "known", "bucketed") + _lists(
    "(SELECT user_id FROM bucketed WHERE split = 'test') b", 5, _FITTED, None)
SQL["als_recommend_all"] = _with("training") + _lists("training", 10, _FITTED, None)
SQL["als_pruned"] = SQL["als_recommend_all"].replace("AS n_broken", "AS n_different")
SQL["als_refresh"] = _with("base", "items") + """,
  cut AS (SELECT max(ts) - 30 * 86400 AS since FROM base),
  fresh AS (SELECT * FROM base WHERE ts >= (SELECT since FROM cut)),
  rated AS (SELECT user_id, item_id FROM base),
  training AS (SELECT user_id, item_id FROM base WHERE ts < (SELECT since FROM cut) AND ((ts % 10) + 10) % 10 < 6
               UNION ALL SELECT user_id, item_id FROM fresh)""" + _lists(
    "fresh", 10, _FITTED + " WHERE item_id IN (SELECT item_id FROM items)", "rated")

SQL["als_fold_in"] = _with("base") + """,
  cut AS (SELECT max(ts) - 30 * 86400 AS since FROM base),
  fresh AS (SELECT * FROM base WHERE ts >= (SELECT since FROM cut)),
  training AS (SELECT user_id, item_id FROM base WHERE ts < (SELECT since FROM cut) AND ((ts % 10) + 10) % 10 < 6
               AND user_id % 3 <> 0),
  used AS (SELECT user_id, item_id FROM training WHERE user_id IN (SELECT user_id FROM fresh)
           UNION ALL SELECT user_id, item_id FROM fresh)
SELECT user_id, count(*) AS n_ratings, user_id NOT IN (SELECT user_id FROM training) AS newcomer, TRUE AS solved
FROM used WHERE item_id IN (SELECT item_id FROM training) GROUP BY user_id"""
