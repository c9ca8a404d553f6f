"""DuckDB SQL with the results of the queries that SQL can express."""

_CLASSES = """
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, low) USING KEY (node) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT e.b, min(r.low) FROM reach r JOIN edges e ON e.a = r.node
  LEFT JOIN recurring.reach k ON k.node = e.b WHERE r.low < k.low GROUP BY e.b)
"""

OP1 = """
WITH lines AS (
  SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM counted),
-- the shortest run of 40 words or more from each line
runs AS (
  SELECT a.doc_id, a.pos, min(b.pos) AS last
  FROM summed a JOIN summed b ON b.doc_id = a.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 40
  GROUP BY a.doc_id, a.pos),
keyed AS (
  SELECT r.doc_id, r.pos, r.last, string_agg(l.line, chr(10) ORDER BY l.pos) AS run
  FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.pos AND r.last GROUP BY ALL),
late AS (
  SELECT doc_id, pos, last FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM keyed) WHERE nth > 1),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN late g ON g.doc_id = l.doc_id AND l.pos BETWEEN g.pos AND g.last),
marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS out,
    g.pos IS NOT NULL AND NOT coalesce(lag(g.pos IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false) AS first
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, count(*) FILTER (first) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT out), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS node FROM embeddings),
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
{_CLASSES},
degree AS (SELECT a AS node, count(*) AS n FROM edges GROUP BY a)
SELECT r.node AS vec_id, coalesce(d.n, 0) AS n_links, r.low AS component_id, r.low = r.node AS kept
FROM reach r LEFT JOIN degree d ON d.node = r.node
"""

OP6 = f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS node FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
      ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS shingle FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM s p JOIN s q ON p.shingle = q.shingle AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
{_CLASSES}
SELECT r.node AS doc_id, coalesce(z.n, 0) AS n_shingles, r.low AS component_id FROM reach r LEFT JOIN size z ON z.doc_id = r.node
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
  min(page_id) OVER (PARTITION BY html) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
FROM d
"""

OP10 = """
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    -ln((CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN q > 0 THEN 2.0::DOUBLE WHEN q = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS room, row_number() OVER o AS turn,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS rest,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS rest_w
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST),
    before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, min(CASE WHEN rest * w <= room * rest_w THEN turn END) OVER () AS stop FROM f),
t AS (
  SELECT g.source, g.source_size,
    CASE WHEN g.stop IS NULL OR g.turn < g.stop THEN CAST(g.room AS DOUBLE) ELSE (h.rest * g.w) / h.rest_w END AS target
  FROM g LEFT JOIN f h ON h.turn = g.stop),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d),
e AS (
  SELECT o.*, t.source_size, t.target, CAST(least(floor(t.target / greatest(t.source_size, 1)), 3) AS BIGINT) AS epochs
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN upto - size / 2 <= target - epochs * source_size AND epochs < 3 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": OP1,
    "op5_embedding_dedup": OP5,
    "op6_jaccard_join": OP6,
    "op7_warc_zip": OP7,
    "op10_mix_sources": OP10,
}
