"""DuckDB SQL of the queries that SQL can express on whole tables."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_mix_water_filling"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u
  FROM documents),
s AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
fill AS (  -- budget and weights left after clamping, until no more source is above its cap
  SELECT 0 AS step, CAST(-1 AS BIGINT) AS n, CAST((SELECT sum(source_size) FROM s) AS HUGEINT) AS rest,
         CAST((SELECT sum(weight) FROM s) AS HUGEINT) AS w
  UNION ALL
  SELECT step + 1, c.n, c.rest, c.w FROM (
    SELECT f.step, f.n AS before,
           (SELECT count(*) FROM s WHERE s.weight * f.rest > 3 * s.source_size * f.w) AS n,
           CAST((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s WHERE s.weight * f.rest > 3 * s.source_size * f.w), 0) AS HUGEINT) AS rest,
           CAST((SELECT sum(weight) FROM s) - coalesce((SELECT sum(weight) FROM s WHERE s.weight * f.rest > 3 * s.source_size * f.w), 0) AS HUGEINT) AS w
    FROM fill f) c WHERE c.n <> c.before AND c.w > 0),
level AS (SELECT rest, w FROM fill ORDER BY step DESC LIMIT 1),
t AS MATERIALIZED (
  SELECT source, source_size, weight,
         CASE WHEN weight * rest > 3 * source_size * w THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(rest AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(w AS DOUBLE) END AS target
  FROM s, level),
g AS MATERIALIZED (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END) * source_size AS goal
  FROM t),
cum AS (
  SELECT d.source, d.u, g.goal, sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.u) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY d.source, d.u, g.goal),
cut AS (
  SELECT source, arg_min(u, (off, u)) AS cut FROM (
    SELECT source, u, abs(upto - goal) AS off FROM cum WHERE goal > 0
    UNION ALL SELECT source, '', goal FROM g WHERE goal > 0) GROUP BY source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, g.target,
       CAST(d.size * (g.whole + CASE WHEN d.u <= coalesce(cut.cut, '') THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

ORACLE_SQL["op3_exact_dedup_golomb"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ASC NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, keep_id IS NOT DISTINCT FROM doc_id AS kept, text_sha256 FROM k
"""

# crc32 bit by bit (reflected polynomial 0xEDB88320); positions are left out, SQL derives them only level by level.
ORACLE_SQL["op11_merkle_postorder_log"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
         list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                     lambda acc, b: list_reduce([CAST(k AS BIGINT) FOR k IN range(8)],
                                                lambda x, k: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)), xor(acc, b)),
                     CAST(4294967295 AS BIGINT)) AS crc
  FROM documents),
l AS MATERIALIZED (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS tree,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 3 = 0 AND text IS NOT NULL
              THEN sha256(head || strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
         END AS tampered
  FROM d),
r AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id ASC NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n
  FROM l),
nodes AS (
  SELECT tree, 0 AS h, i, leaf AS d, n FROM r
  UNION ALL
  SELECT tree, h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, h, i // 8, n),
subroots AS MATERIALIZED (
  SELECT tree, d, h AS height, row_number() OVER (ORDER BY tree) - 1 AS j, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS h, j AS i, d, n FROM subroots
  UNION ALL
  SELECT h + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY h, i // 8, n),
root AS (SELECT d AS root FROM tops WHERE n = 1),
around AS MATERIALIZED (  -- of every node below a top: the run's nodes before and after it
  SELECT a.tree, a.h, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS pre,
         coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS post
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.h = b.h AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY 1, 2, 3
  UNION ALL
  SELECT NULL, a.h, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), ''),
         coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '')
  FROM tops a JOIN tops b ON a.h = b.h AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY 2, 3),
steps AS MATERIALIZED (
  SELECT r.rid, a.h AS step, a.pre, a.post FROM r JOIN around a ON a.tree = r.tree AND a.i = r.i // CAST(pow(8, a.h) AS BIGINT)
  UNION ALL
  SELECT r.rid, s.height + a.h, a.pre, a.post FROM r JOIN subroots s ON s.tree = r.tree
  JOIN around a ON a.tree IS NULL AND a.i = s.j // CAST(pow(8, a.h) AS BIGINT)),
folds AS (
  SELECT rid, CAST(0 AS BIGINT) AS step, coalesce(tampered, leaf) AS d FROM r
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.pre || f.d || s.post) FROM folds f JOIN steps s ON s.rid = f.rid AND s.step = f.step),
folded AS (SELECT rid, arg_max(d, step) AS folded_root FROM folds GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(pre || post, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY rid)
SELECT r.doc_id, r.leaf, s.d AS subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
       f.folded_root = root.root AS verified
FROM r JOIN subroots s ON s.tree = r.tree CROSS JOIN root JOIN folded f ON f.rid = r.rid LEFT JOIN proof p ON p.rid = r.rid
"""

ORACLE_SQL["op13_hard_negatives_angular"] = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE_SQL["op12_near_duplicates_binary_codes"] = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN edges e ON e.a = r.seen),
c AS (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM edges GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
