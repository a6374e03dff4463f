"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

_SQL: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    """All SQL twins by query name."""
    return dict(_SQL)


def _lague(parts: str, group: str, key: str, vote: str, seats: str, out: str, keep: str) -> str:
    """Highest quotients as SQL: the same ranges, the same ties."""
    return f"""
    SELECT {keep}, any_value(low) + sum(CASE WHEN turn <= open AND {vote} > 0 THEN 1 ELSE 0 END) AS {out}
    FROM (
      SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {vote} / (seat * 2 + 1) DESC, {key}) AS turn
      FROM (
        SELECT *, unnest(generate_series(low, high)) AS seat
        FROM (
          SELECT *, {seats} - sum(low) OVER (PARTITION BY {group}) AS open
          FROM (
            SELECT *, greatest(quota - slack, 0) AS low, quota + slack AS high
            FROM (
              SELECT *, floor({seats} * part_share + 0.5)::BIGINT AS quota,
                     ceil(n * part_share / 2)::BIGINT + 1 AS slack
              FROM (
                SELECT *, count(*) OVER (PARTITION BY {group}) AS n,
                       CASE WHEN sum({vote}) OVER (PARTITION BY {group}) > 0
                            THEN {vote} / sum({vote}) OVER (PARTITION BY {group}) ELSE 0.0::DOUBLE END AS part_share
                FROM {parts}))))))
    GROUP BY {keep}"""


_SQL["op8_apportioned_mix"] = rf"""
WITH sized AS (
  SELECT row_number() OVER () AS line, doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
weighed AS (
  SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM placed),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER earlier, 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
  WINDOW earlier AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (
  SELECT *, min(CASE WHEN cap >= level * weight THEN cap / weight END) OVER () AS edge FROM levels),
targets AS (
  SELECT source, source_size, place,
         coalesce(least((SELECT level FROM settled s WHERE s.cap / s.weight = s.edge ORDER BY s.place LIMIT 1) * weight,
                        cap::DOUBLE), cap::DOUBLE) AS target
  FROM settled),
voted AS (
  SELECT *, floor(sum(target) OVER () / 32 + 0.5)::BIGINT AS all_blocks, 0 AS one FROM targets),
granted AS (
  {_lague("voted", "one", "place", "target", "all_blocks", "blocks", "place, source, source_size, target")}),
dealt AS (
  SELECT line, d.doc_id, size, place, blocks, g.source_size, target,
         ('0x' || substr(md5('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % ceil((g.source_size + 1) / 65536)::BIGINT AS shard
  FROM sized d JOIN granted g ON d.source IS NOT DISTINCT FROM g.source),
started AS (
  SELECT *, (sum(size) OVER (PARTITION BY place, shard ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
                             ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM dealt),
shards AS (
  SELECT place, shard, shard // 4096 AS part, sum(size)::BIGINT AS words, any_value(blocks) AS blocks
  FROM dealt GROUP BY place, shard),
parts AS (
  SELECT place, part, sum(words)::BIGINT AS part_words, any_value(blocks) AS blocks FROM shards GROUP BY place, part),
shared AS (
  {_lague("parts", "place", "part", "part_words", "blocks", "part_blocks", "place, part")}),
ranked AS (SELECT s.*, part_blocks FROM shards s JOIN shared USING (place, part)),
quotas AS (
  {_lague("ranked", "place, part", "shard", "words", "part_blocks", "quota", "place, shard, words")}),
shares AS (
  SELECT place, shard, least(quota, 2 * ceil(words / 32)::BIGINT) AS quota, ceil(words / 32)::BIGINT AS has
  FROM quotas WHERE words > 0),
spans AS (
  SELECT *, unnest(generate_series(start // 32, (start + size - 1) // 32)) AS block FROM started WHERE size > 0),
drawn AS (
  SELECT *, dense_rank() OVER (PARTITION BY place, shard
                               ORDER BY md5('7:' || place || ':' || shard || ':' || block), block) AS turn
  FROM spans),
took AS (
  SELECT line, sum((least(start + size, (block + 1) * 32) - greatest(start, block * 32))
                   * (quota // has + CASE WHEN turn <= quota % has THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM drawn JOIN shares USING (place, shard) GROUP BY line)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM dealt LEFT JOIN took USING (line)
"""

_SQL["op9_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 49], ' ')) AS run
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS pos FROM split WHERE len(words) >= 50)),
firsts AS (SELECT run, min(doc_id) AS smallest FROM windows GROUP BY run),
covered AS (
  SELECT DISTINCT doc_id, pos + step AS pos
  FROM windows JOIN firsts USING (run), (SELECT unnest(generate_series(0, 49)) AS step)
  WHERE doc_id > smallest),
numbered AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS pos FROM split),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(words[pos], ' ' ORDER BY pos) AS text
  FROM numbered ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT s.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""

_SQL["op5_ngram_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 3))) AS pos FROM split WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
directed AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, d.b FROM reached r JOIN directed d ON d.a = r.seen),
smallest AS (SELECT node AS doc_id, min(seen) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d JOIN smallest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_SQL["op1_threshold_topk"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.parts, c.parts)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""

_SQL["op3_forest_dedup"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.seen),
smallest AS (SELECT node AS vec_id, min(seen) AS component_id FROM reached GROUP BY node),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN smallest USING (vec_id) LEFT JOIN counted USING (vec_id)
"""

_SQL["op13_slot_negatives"] = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.parts, b.parts)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _rounds(count: int) -> str:
    """Rounds of assigning to the nearest centroid and taking floors of means."""
    return "".join(f"""
near{r} AS (
  SELECT vec_id, parts, arg_min(n, (d, n)) AS n, min(d) AS d
  FROM (SELECT v.vec_id, v.parts, c.n,
               list_dot_product(v.parts, v.parts) - 2 * list_dot_product(v.parts, c.parts)
               + list_dot_product(c.parts, c.parts) AS d
        FROM usable v, centroids{r} c)
  GROUP BY vec_id, parts),""" + (f"""
centroids{r + 1} AS (
  SELECT n, coalesce(m.parts, c.parts) AS parts
  FROM centroids{r} c LEFT JOIN (
    SELECT n, list(mean ORDER BY k) AS parts
    FROM (SELECT n, k, floor(sum(x) / count(*)) AS mean
          FROM (SELECT n, unnest(parts) AS x, generate_subscripts(parts, 1) AS k FROM near{r}) GROUP BY n, k)
    GROUP BY n) m USING (n)),""" if r < count else "") for r in range(count + 1))


_SQL["op11_curve_centroids"] = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centroids0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)))::INT - 1 AS n, parts
  FROM usable QUALIFY n < 40),{_rounds(5)}
sums AS (SELECT n, sum(d)::BIGINT AS cluster_inertia FROM near5 GROUP BY n)
SELECT vec_id, n::INT AS cluster, d::BIGINT AS distance, cluster_inertia,
       (SELECT sum(d)::BIGINT FROM near5) AS inertia,
       sha256(array_to_string(list_transform(c.parts, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM near5 JOIN sums USING (n) JOIN centroids5 c USING (n)
"""
