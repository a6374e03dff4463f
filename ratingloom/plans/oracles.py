"""The registered queries in ANSI SQL, over the same tables."""

from __future__ import annotations

RATINGS_BRAND = """
  SELECT o_custkey AS "user", CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS item,
         avg(l_quantity) / 10 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2"""

RATINGS_PART = """
  SELECT o_custkey AS "user", l_partkey AS item, avg(l_quantity) / 10 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""

RATINGS_SUPPLIER = """
  SELECT l_suppkey AS "user", l_partkey AS item, avg(l_quantity) / 10 AS rating
  FROM lineitem GROUP BY 1, 2"""

RAW = """
  SELECT 'C' || o_custkey AS raw_user, 'P' || l_partkey AS raw_item, l_quantity / 10 AS rating,
         l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, o_custkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

BASKETS = """
  SELECT DISTINCT l_orderkey AS basket, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey"""

LEVELS = f"""
RECURSIVE cells AS ({BASKETS}),
total AS (SELECT count(DISTINCT basket) AS n FROM cells),
subsets AS (
  SELECT basket, item AS last, CAST(item AS VARCHAR) AS items, CAST(1 AS BIGINT) AS size FROM cells
  UNION ALL
  SELECT s.basket, c.item, s.items || ',' || c.item, s.size + 1
  FROM subsets s JOIN cells c ON c.basket = s.basket AND c.item > s.last),
sets AS (SELECT items, size, count(*) AS freq FROM subsets GROUP BY 1, 2),
one AS (SELECT CAST(items AS BIGINT) AS a, freq FROM sets WHERE size = 1),
two AS (SELECT CAST(split_part(items, ',', 1) AS BIGINT) AS a, CAST(split_part(items, ',', 2) AS BIGINT) AS b, freq
        FROM sets WHERE size = 2)"""


def _r(value: str, digits: int = 6) -> str:
    return f"round({value} + 1e-10, {digits})"


def _sets(share: float, size: str = "size >= 1", test: str = ">= floor", columns: str = "items, size, freq") -> str:
    op, bound = test.split()
    return f"WITH {LEVELS} SELECT {columns} FROM sets, total WHERE {size} AND freq {op} {bound}(n * {share})"


def _percent(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(CAST('0x' || substr(md5({text} || ':42'), 1, 8) AS BIGINT) % 100)"


_SIDE = _percent('"user"', "item")


def _split(ratings: str, rate: int) -> str:
    return (
        f"cells AS ({ratings}), train AS (SELECT * FROM cells WHERE {_SIDE} < {rate}), "
        f"test AS (SELECT * FROM cells WHERE {_SIDE} >= {rate})"
    )


def _cosine(cells: str, row: str, col: str) -> str:
    return f"""
norms AS (SELECT {col} AS c, sqrt(sum(rating * rating)) AS norm FROM {cells} GROUP BY 1),
dots AS (SELECT x.{col} AS i, y.{col} AS j, sum(x.rating * y.rating) AS dot
         FROM {cells} x JOIN {cells} y ON x.{row} = y.{row} AND x.{col} < y.{col} GROUP BY 1, 2),
cosine AS (SELECT i, j, dot / (a.norm * b.norm) AS sim FROM dots
           JOIN norms a ON a.c = i JOIN norms b ON b.c = j),
both_ways AS (SELECT i, j, sim FROM cosine UNION ALL SELECT j, i, sim FROM cosine)"""


def _nearest(n: int) -> str:
    return f"""
near AS (SELECT * FROM (
  SELECT i, j, {_r('sim')} AS sim,
         CAST(row_number() OVER (PARTITION BY i ORDER BY {_r('sim')} DESC, j) AS BIGINT) AS rank
  FROM both_ways WHERE sim <> 0) WHERE rank <= {n})"""


def _item_scores(cells: str, pairs: str) -> str:
    return f"""
scores AS (
  SELECT p."user", p.item,
         sum((1 + coalesce(s.sim, 0)) * r.rating) / nullif(sum(1 + coalesce(s.sim, 0)), 0) AS score
  FROM {pairs} p JOIN {cells} r ON r."user" = p."user"
  LEFT JOIN both_ways s ON s.i = p.item AND s.j = r.item
  GROUP BY 1, 2)"""


def _user_scores(cells: str, pairs: str) -> str:
    return f"""
scores AS (
  SELECT p."user", p.item,
         sum((0.5 + 0.5 * s.sim) * r.rating) / nullif(sum(0.5 + 0.5 * s.sim), 0) AS score
  FROM {pairs} p JOIN {cells} r ON r.item = p.item
  JOIN both_ways s ON s.i = p."user" AND s.j = r."user"
  GROUP BY 1, 2)"""


_UNRATED = """
unrated AS (SELECT u."user", i.item FROM (SELECT DISTINCT "user" FROM cells) u
            CROSS JOIN (SELECT DISTINCT item FROM cells) i
            ANTI JOIN cells c ON c."user" = u."user" AND c.item = i.item)"""


def _top(n: int) -> str:
    return f"""
rounded AS (SELECT "user", item, {_r('score')} AS score FROM scores WHERE score IS NOT NULL),
ranked AS (SELECT "user", item, score,
                  row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM rounded),
best AS (SELECT "user", CAST(rank AS BIGINT) AS rank, item, score FROM ranked WHERE rank <= {n})"""


_RMSE = f"""
SELECT {_r('sqrt(avg((s.score - t.rating) * (s.score - t.rating)))')} AS rmse
FROM scores s JOIN test t ON s."user" = t."user" AND s.item = t.item"""

_LAST = f"""
  SELECT o_custkey AS "user", l_partkey AS item, arg_max(rating, (l_orderkey, l_linenumber, rating)) AS rating
  FROM ({RAW}) GROUP BY 1, 2"""

_NORMALISED = f"""
cells AS ({RATINGS_BRAND}),
um AS (SELECT "user", avg(rating) AS user_mean FROM cells GROUP BY 1),
im AS (SELECT item, avg(rating) AS item_mean FROM cells GROUP BY 1),
dense AS (SELECT u."user", i.item, coalesce(c.rating, item_mean) - user_mean AS value
          FROM um u CROSS JOIN im i LEFT JOIN cells c ON c."user" = u."user" AND c.item = i.item)"""

_ORDERED_LINES = """
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS pos FROM lineitem"""

_ITEM_IDS_SEEN = f"""
SELECT raw_item AS raw,
       CAST(row_number() OVER (ORDER BY min((l_orderkey, l_linenumber)), raw_item) - 1 AS BIGINT) AS idx
FROM ({RAW}) GROUP BY raw_item"""


_SQUARINGS = 15


def _leading(matrix: str) -> str:
    """The leading right factor ``lead(item, v)`` of ``matrix(user, item, rating)``.

    Squaring the Gram matrix again and again leaves its leading direction only.
    """
    power = "".join(
        f"""
p{n + 1} AS MATERIALIZED (
  SELECT x.i, y.j, sum(x.g * y.g) / (SELECT sum(g * g) FROM p{n}) AS g
  FROM p{n} x JOIN p{n} y ON x.j = y.i GROUP BY 1, 2),"""
        for n in range(_SQUARINGS)
    )
    return f"""
p0 AS MATERIALIZED (
  SELECT x.item AS i, y.item AS j, sum(x.rating * y.rating) AS g
  FROM {matrix} x JOIN {matrix} y ON x."user" = y."user" GROUP BY 1, 2),{power}
image AS (SELECT i AS item, sum(g * (1 + j / 100.0)) AS w FROM p{_SQUARINGS} GROUP BY 1),
lead AS MATERIALIZED (SELECT item, w / sqrt(sum(w * w) OVER ()) AS v FROM image),
along AS (SELECT "user", sum(rating * v) AS a FROM {matrix} JOIN lead USING (item) GROUP BY 1)"""


_RANK1_CELLS = """scores AS (SELECT "user", item, a * v AS score FROM along CROSS JOIN lead)"""


def _rank1_items(cells: str, pairs: str) -> str:
    weight = "(1 + CASE WHEN r.item = p.item THEN 0 ELSE sign(x.v) * sign(y.v) END)"
    return f"""
scores AS (
  SELECT p."user", p.item, sum({weight} * r.rating) / nullif(sum({weight}), 0) AS score
  FROM {pairs} p JOIN {cells} r ON r."user" = p."user"
  JOIN lead x ON x.item = p.item JOIN lead y ON y.item = r.item GROUP BY 1, 2)"""


def _normalised(cells: str) -> str:
    return f"""
um AS (SELECT "user", avg(rating) AS user_mean FROM {cells} GROUP BY 1),
im AS (SELECT item, avg(rating) AS item_mean FROM {cells} GROUP BY 1),
filled AS MATERIALIZED (
  SELECT u."user", i.item, coalesce(c.rating, item_mean) - user_mean AS rating
  FROM um u CROSS JOIN im i LEFT JOIN {cells} c ON c."user" = u."user" AND c.item = i.item)"""


def _rank1_plus(cells: str, pairs: str) -> str:
    weight = "(0.5 + 0.5 * CASE WHEN x.item = p.item THEN 0 ELSE sign(x.v) * sign(y.v) END)"
    return f"""
gaps AS (SELECT max(item) + 1 - count(DISTINCT item) AS n FROM {cells}),
scores AS (
  SELECT p."user", p.item,
         any_value(user_mean) + sum({weight} * a * x.v) / (sum({weight}) + 0.5 * any_value(gaps.n)) AS score
  FROM {pairs} p JOIN um ON um."user" = p."user" JOIN along ON along."user" = p."user"
  JOIN lead y ON y.item = p.item CROSS JOIN lead x CROSS JOIN gaps GROUP BY 1, 2)"""


_ALS_STEPS = """
steps AS (
  SELECT 0 AS t, item, CAST(1 AS DOUBLE) AS v FROM (SELECT DISTINCT item FROM train)
  UNION ALL
  SELECT t + 1, c.item, sum(c.rating * x) / (sum(x * x) + count(*))
  FROM train c JOIN (
    SELECT s.t, c."user", sum(c.rating * s.v) / (sum(s.v * s.v) + count(*)) AS x
    FROM steps s JOIN train c ON c.item = s.item WHERE s.t < 40 GROUP BY 1, 2) p ON p."user" = c."user"
  GROUP BY t, c.item),
lead AS (SELECT item, v FROM steps WHERE t = 40),
people AS (SELECT "user", sum(rating * v) / (sum(v * v) + count(*)) AS x FROM train JOIN lead USING (item) GROUP BY 1),
scores AS (SELECT "user", item, x * v AS score FROM people CROSS JOIN lead)"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    text_brand = f"""SELECT "user", item, {_r('rating', 4)} AS rating FROM ({RATINGS_BRAND})"""
    text_part = f"""SELECT "user", item, {_r('rating', 4)} AS rating FROM ({RATINGS_PART})"""
    item_best = (
        f"WITH cells AS ({RATINGS_BRAND}), {_cosine('cells', '\"user\"', 'item')}, {_UNRATED}, "
        f"{_item_scores('cells', 'unrated')}, {_top(100)}"
    )
    support = f"{_r('freq / n')}"
    related = f"""
WITH {LEVELS},
single AS (SELECT a AS item FROM one, total WHERE freq >= ceil(n * SHARE)),
pair AS (SELECT a, b FROM two, total WHERE freq >= ceil(n * SHARE)),
partner AS (SELECT a AS item, b AS partner FROM pair UNION ALL SELECT b, a FROM pair)
"""
    weights = f"""
SELECT items, CAST(count(*) AS BIGINT) AS weight
FROM (SELECT basket, string_agg(NAME, ',' ORDER BY NAME) AS items FROM ({BASKETS}) GROUP BY 1) GROUP BY 1"""
    sql = {
        "apriori_pairs": _sets(0.01, "size <= 2", "> floor"),
        "apriori_level1": _sets(0.002, "size = 1"),
        "apriori_level2": _sets(0.002, "size = 2"),
        "apriori_level3": _sets(0.002, "size = 3"),
        "fp_itemsets_all": _sets(0.002, test=">= ceil"),
        "fp_itemsets_by_count": _sets(0.01),
        "itemsets_by_size": f"WITH found AS ({_sets(0.002, test='>= ceil')}) "
        "SELECT size, count(*) AS itemsets FROM found GROUP BY 1",
        "fp_weighted_support": _sets(0.01, columns=f"items, size, freq, {support} AS support"),
        "related_items": related.replace("SHARE", "0.01")
        + "SELECT s.item, p.partner FROM single s LEFT JOIN partner p ON p.item = s.item",
        "related_item_lines": related.replace("SHARE", "0.03")
        + "SELECT s.item || ':' || coalesce(string_agg(partner, ',' ORDER BY partner), '') AS value "
        "FROM single s LEFT JOIN partner p ON p.item = s.item GROUP BY s.item",
        "basket_weights": weights.replace("NAME", "item"),
        "item_support_rank": f"""
SELECT item, freq, CAST(row_number() OVER (ORDER BY freq DESC, item) AS BIGINT) AS rank
FROM (SELECT item, count(*) AS freq FROM ({BASKETS}) GROUP BY 1)""",
        "rating_profile": f"""
SELECT count(*) AS ratings, count(DISTINCT "user") AS users, count(DISTINCT item) AS items FROM ({RATINGS_PART})""",
        "user_mean": f"""SELECT "user", {_r('avg(rating)')} AS user_mean FROM ({RATINGS_PART}) GROUP BY 1""",
        "item_mean": f"SELECT item, {_r('avg(rating)')} AS item_mean FROM ({RATINGS_PART}) GROUP BY 1",
        "matrix_width": f"SELECT CAST(max(item) + 1 AS BIGINT) AS width FROM ({RATINGS_PART})",
        "transposed_ratings": f"""SELECT item AS "user", "user" AS item, {_r('rating')} AS rating FROM ({RATINGS_PART})""",
        "implicit_ratings": f"""SELECT "user", item, {_r('rating - 2.5')} AS rating FROM ({RATINGS_BRAND})""",
        "duplicates_averaged": f"""
SELECT o_custkey AS "user", l_partkey AS item, {_r('avg(rating)')} AS rating
FROM ({RAW}) GROUP BY 1, 2 HAVING avg(rating) <> 0""",
        "duplicates_last": f"""SELECT "user", item, {_r('rating')} AS rating FROM ({_LAST})""",
        "id_map_sorted": f"""
SELECT raw, CAST(row_number() OVER (ORDER BY raw) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT raw_user AS raw FROM ({RAW}))""",
        "id_map_first_seen": _ITEM_IDS_SEEN,
        "mapped_ratings": f"""
WITH raw AS ({RAW}),
u AS (SELECT raw_user, row_number() OVER (ORDER BY min((l_orderkey, l_linenumber)), raw_user) - 1 AS idx FROM raw GROUP BY 1),
i AS (SELECT raw_item, row_number() OVER (ORDER BY min((l_orderkey, l_linenumber)), raw_item) - 1 AS idx FROM raw GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(u.idx AS BIGINT) AS "user", CAST(i.idx AS BIGINT) AS item, {_r('rating')} AS rating
FROM raw JOIN u USING (raw_user) JOIN i USING (raw_item)""",
        "split_train": f"""SELECT "user", item, {_r('rating')} AS rating FROM ({RATINGS_PART}) WHERE {_SIDE} < 90""",
        "split_test": f"""SELECT "user", item, {_r('rating')} AS rating FROM ({RATINGS_PART}) WHERE {_SIDE} >= 90""",
        "sample_lines": f"""
WITH lines AS ({_ORDERED_LINES}), half AS (SELECT count(*) // 2 AS m FROM lineitem),
hashed AS (SELECT lines.*, m, row_number() OVER (ORDER BY md5(pos || ':42'), pos) AS h FROM lines, half WHERE pos < m)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(pos AS BIGINT) AS pos FROM hashed WHERE h <= m // 50""",
        "sparse_rows_text": f"""
SELECT "user", string_agg(item || ':' || rating || ',', '' ORDER BY item) AS value FROM ({_LAST}) GROUP BY 1""",
        "item_cosine": f"WITH cells AS ({RATINGS_BRAND}), {_cosine('cells', '\"user\"', 'item')} SELECT i, j, {_r('sim')} AS sim FROM cosine",
        "item_cosine_sparse": f"WITH cells AS ({RATINGS_PART}), {_cosine('cells', '\"user\"', 'item')} SELECT i, j, {_r('sim')} AS sim FROM cosine",
        "item_gram": f"WITH cells AS ({RATINGS_BRAND}), {_cosine('cells', '\"user\"', 'item')} SELECT i, j, round(dot + 1e-6, 3) AS dot FROM dots",
        "user_cosine": f"WITH cells AS ({RATINGS_SUPPLIER}), {_cosine('cells', 'item', '\"user\"')} SELECT i, j, {_r('sim')} AS sim FROM cosine",
        "user_cosine_dense": f"WITH cells AS ({RATINGS_BRAND}), {_cosine('cells', 'item', '\"user\"')} SELECT i, j, {_r('sim')} AS sim FROM cosine",
        "user_similarity_table": f"WITH cells AS ({RATINGS_SUPPLIER}), {_cosine('cells', 'item', '\"user\"')} "
        f"SELECT i, j, {_r('0.5 + 0.5 * sim')} AS sim FROM both_ways",
        "item_cosine_above": f"WITH cells AS ({RATINGS_SUPPLIER}), {_cosine('cells', '\"user\"', 'item')} "
        f"SELECT i, j, {_r('sim')} AS sim FROM cosine WHERE sim >= 0.45",
        "user_cosine_above": f"WITH cells AS ({RATINGS_PART}), {_cosine('cells', 'item', '\"user\"')} "
        f"SELECT i, j, {_r('sim')} AS sim FROM cosine WHERE sim >= 0.1",
        "user_neighbours": f"WITH cells AS ({RATINGS_PART}), {_cosine('cells', 'item', '\"user\"')}, {_nearest(20)} "
        """SELECT i AS "user", rank, j AS neighbour, sim FROM near""",
        "usercf_predict_near": f"WITH cells AS ({RATINGS_PART}), {_cosine('cells', 'item', '\"user\"')}, {_nearest(20)}, "
        "named AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM near), "
        "kept AS (SELECT c.i, c.j, c.sim FROM cosine c JOIN named ON a = i AND b = j), "
        "both_kept AS (SELECT i, j, sim FROM kept UNION ALL SELECT j, i, sim FROM kept), "
        f"""{_user_scores('cells', 'cells').replace('both_ways', 'both_kept')}
SELECT "user", item, {_r('score')} AS score FROM scores WHERE score IS NOT NULL""",
        "itemcf_predict": f"WITH cells AS ({RATINGS_BRAND}), {_cosine('cells', '\"user\"', 'item')}, "
        f"""{_item_scores('cells', 'cells')} SELECT "user", item, {_r('score')} AS score FROM scores""",
        "itemcf_recommend": f"{item_best} SELECT * FROM best",
        "itemcf_rmse": f"WITH {_split(RATINGS_BRAND, 80)}, {_cosine('train', '\"user\"', 'item')}, {_item_scores('train', 'test')} {_RMSE}",
        "usercf_predict": f"WITH cells AS ({RATINGS_SUPPLIER}), {_cosine('cells', 'item', '\"user\"')}, "
        f"""{_user_scores('cells', 'cells')} SELECT "user", item, {_r('score')} AS score FROM scores WHERE score IS NOT NULL""",
        "usercf_recommend": f"WITH cells AS ({RATINGS_SUPPLIER}), {_cosine('cells', 'item', '\"user\"')}, {_UNRATED}, "
        f"{_user_scores('cells', 'unrated')}, {_top(100)} SELECT * FROM best",
        "usercf_rmse": f"WITH {_split(RATINGS_SUPPLIER, 80)}, {_cosine('train', 'item', '\"user\"')}, {_user_scores('train', 'test')} {_RMSE}",
        "normalised_observed": f"""WITH {_NORMALISED}
SELECT c."user", c.item, {_r('rating - user_mean')} AS value FROM cells c JOIN um ON um."user" = c."user" """,
        "normalised_dense": f"""WITH {_NORMALISED} SELECT "user", item, {_r('value')} AS value FROM dense""",
        "svd_reconstruct_full_rank": f"""
WITH cells AS ({RATINGS_BRAND})
SELECT u."user", i.item, abs({_r('coalesce(c.rating, 0)', 5)}) AS score
FROM (SELECT DISTINCT "user" FROM cells) u CROSS JOIN (SELECT DISTINCT item FROM cells) i
LEFT JOIN cells c ON c."user" = u."user" AND c.item = i.item""",
        "svd_energy": f"SELECT round(sum(rating * rating) + 1e-6, 3) AS energy FROM ({RATINGS_BRAND})",
        "svd_normalised_energy": f"WITH {_NORMALISED} SELECT round(sum(value * value) + 1e-6, 3) AS energy FROM dense",
        "svd_rank1_values": f"WITH RECURSIVE cells AS ({RATINGS_BRAND}), {_leading('cells')} "
        f"SELECT CAST(0 AS INT) AS f, {_r('sqrt(sum(a * a))', 4)} AS s FROM along",
        "svd_rank1_reconstruct": f"WITH RECURSIVE cells AS ({RATINGS_BRAND}), {_leading('cells')}, {_RANK1_CELLS} "
        f"""SELECT "user", item, {_r('score')} AS score FROM scores""",
        "svd_rank1_rmse": f"WITH RECURSIVE {_split(RATINGS_BRAND, 80)}, {_leading('train')}, {_RANK1_CELLS} {_RMSE}",
        "svditem_rank1_predict": f"WITH RECURSIVE cells AS ({RATINGS_BRAND}), {_leading('cells')}, "
        f"""{_rank1_items('cells', 'cells')} SELECT "user", item, {_r('score')} AS score FROM scores""",
        "svditem_rank1_recommend": f"WITH RECURSIVE cells AS ({RATINGS_BRAND}), {_leading('cells')}, {_UNRATED}, "
        f"{_rank1_items('cells', 'unrated')}, {_top(100)} SELECT * FROM best",
        "svdplus_rank1_predict": f"WITH RECURSIVE cells AS ({RATINGS_BRAND}), {_normalised('cells')}, {_leading('filled')}, "
        f"""{_rank1_plus('cells', 'cells')} SELECT "user", item, {_r('score')} AS score FROM scores""",
        "svdplus_rank1_rmse": f"WITH RECURSIVE {_split(RATINGS_BRAND, 80)}, {_normalised('train')}, {_leading('filled')}, "
        f"{_rank1_plus('train', 'test')} {_RMSE}",
        "als_rank1_rmse": f"WITH RECURSIVE {_split(RATINGS_BRAND, 80)}, {_ALS_STEPS} {_RMSE.replace('1e-10, 6', '1e-10, 4')}",
        "ratings_text": text_part,
        "ratings_text_transposed": f"""SELECT item AS "user", "user" AS item, {_r('rating', 4)} AS rating FROM ({RATINGS_PART})""",
        "raw_ratings_text": f"""
WITH raw AS (SELECT raw_item, min((l_orderkey, l_linenumber, l_partkey)) AS first FROM ({RAW}) GROUP BY 1)
SELECT raw_item AS raw, CAST(row_number() OVER (ORDER BY first) - 1 AS BIGINT) AS idx FROM raw""",
        "numbered_lines_text": f"""
SELECT l_orderkey || ',' || l_linenumber || ',' || l_partkey AS value, CAST(pos AS BIGINT) AS pos FROM ({_ORDERED_LINES})""",
        "id_map_text": f"""
SELECT raw, CAST(row_number() OVER (ORDER BY raw) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT raw_item AS raw FROM ({RAW}))""",
        "baskets_text": "SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem GROUP BY 1",
        "tid_baskets_text": weights.replace("NAME", "('B' || item)"),
        "itemset_lines_text": f"WITH found AS ({_sets(0.01, test='>= ceil')}) SELECT freq || ':' || items AS value FROM found",
        "pair_lines_text": f"WITH found AS ({_sets(0.01, 'size <= 2', '> floor')}) SELECT items AS value FROM found",
        "level_folders_text": f"WITH found AS ({_sets(0.01, 'size <= 2')}) "
        "SELECT '[' || replace(items, ',', ', ') || ']' AS value, size FROM found",
        "support_folders_text": _sets(0.01, columns=f"items || ':' || {_r('freq / n', 4)} AS value, size"),
        "recommendation_lines_text": f"""{item_best}
SELECT "user" || ':' || string_agg('(' || item || ',' || score || ')', ',' ORDER BY rank) AS value FROM best GROUP BY "user" """,
        "sparse_matrix_text": f"""
WITH cells AS ({text_brand}), people AS (SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS row FROM cells GROUP BY 1)
SELECT CAST(row AS BIGINT) AS row, CAST(item AS INT) AS col, rating AS value FROM cells JOIN people USING ("user")""",
        "dense_matrix_text": f"""
WITH cells AS ({text_brand}), people AS (SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS row FROM cells GROUP BY 1),
things AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS col FROM cells GROUP BY 1)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS INT) AS col, rating AS value
FROM cells JOIN people USING ("user") JOIN things USING (item) WHERE rating <> 0""",
    }
    sql["itemcf_recommend_part"] = sql["itemcf_recommend"].replace(RATINGS_BRAND, RATINGS_PART)
    sql["map_ids_text"] = f"""
WITH ids AS ({sql["raw_ratings_text"]})
SELECT raw, idx, n FROM ids JOIN (SELECT raw_item AS raw, count(*) AS n FROM ({RAW}) GROUP BY 1) USING (raw)"""
    sql["string_baskets_text"] = f"""
WITH cells AS ({BASKETS}), total AS (SELECT count(DISTINCT basket) AS n FROM cells)
SELECT 'B' || item AS items, count(*) AS freq FROM cells, total GROUP BY item, n HAVING count(*) >= ceil(n * 0.1)"""
    sql["full_shape_rows_text"] = f"""
WITH cells AS ({text_brand}),
people AS (SELECT CAST(unnest(generate_series(0, max("user") + 2)) AS BIGINT) AS row FROM cells),
things AS (SELECT CAST(unnest(generate_series(0, max(item) + 2)) AS INT) AS col FROM cells)
SELECT row, col, coalesce(rating, 0.0::DOUBLE) AS value
FROM people CROSS JOIN things LEFT JOIN cells ON "user" = row AND item = col"""
    sql["svd_bidiagonal_energy"] = sql["svd_energy"]
    sql["apriori_level3_bitmaps"] = sql["apriori_level3"]
    for name in ("itemcf_recommend", "usercf_predict", "usercf_recommend"):
        sql[f"{name}_blocks"] = sql[name]
    return sql
