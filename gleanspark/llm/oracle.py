"""SQL for DuckDB of those queries that SQL can express over whole tables."""

from __future__ import annotations

_BLANK = r"regexp_full_match(line, '[ \t\r]*')"

_BLOCKS = rf"""
WITH f AS (SELECT file_id, any_value(text) AS text, any_value(lower(regexp_extract(path, '\.([^.]*)$', 1))) AS ext FROM repo_files WHERE text IS NOT NULL AND contains(path, '.') GROUP BY file_id),
lim AS (SELECT f.file_id, f.text, min(l.max_lines) AS m FROM f JOIN split_limits l ON f.ext = lower(l.ext) GROUP BY ALL),
big AS (SELECT *, string_split(text, chr(10)) AS l FROM lim WHERE len(string_split(text, chr(10))) > m),
ln AS (SELECT file_id, m, len(l) AS n, i - 1 AS i, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM big)),
b AS (SELECT *, {_BLANK} AS blank, lag({_BLANK}) OVER (PARTITION BY file_id ORDER BY i) AS before FROM ln),
st AS (SELECT file_id, m, n, i AS s FROM b WHERE i = 0 OR (NOT blank AND before AND line[1] NOT IN (' ', chr(9)))),
blk AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY file_id ORDER BY s), n) - s AS size FROM st),
two AS (SELECT *, lag(size) OVER (PARTITION BY file_id ORDER BY s) AS size0 FROM blk)
"""

_TERMS = r"""
WITH c AS (SELECT chunk_key, any_value(coalesce(text, '') || chr(10) || coalesce(array_to_string(list_filter(defines, lambda x: x IS NOT NULL), chr(10)), '')) AS t FROM chunks WHERE chunk_key IS NOT NULL GROUP BY chunk_key),
w AS (SELECT chunk_key, lower(unnest(regexp_extract_all(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '[A-Za-z]+'))) AS term FROM c),
tf AS (SELECT chunk_key, term, count(*) AS tf FROM w GROUP BY ALL),
st AS (SELECT term, count(*) AS n_records, sum(tf)::BIGINT AS f FROM tf GROUP BY ALL),
len AS (SELECT chunk_key, sum(tf)::BIGINT AS len FROM tf GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM c), av AS (SELECT sum(len) / (SELECT n FROM nn)::DOUBLE AS a FROM len)
"""

SQL = {
    "p2_found": r"""
WITH r AS (SELECT 'chunk' AS kind, chunk_key AS id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_key
           UNION ALL SELECT 'file', file_id, any_value(text) FROM repo_files WHERE text IS NOT NULL GROUP BY file_id),
w AS (SELECT kind, id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM r),
s AS (SELECT DISTINCT kind, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT kind, id, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 40),
e AS (SELECT s.* FROM s SEMI JOIN n USING (kind, id)),
p AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM e a JOIN e b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT p.kind AS record_kind, id_a, id_b FROM p JOIN n x ON x.kind = p.kind AND x.id = id_a JOIN n y ON y.kind = p.kind AND y.id = id_b WHERE 10 * c >= 6 * (x.n + y.n - c)""",
    "p3_found": _BLOCKS + "SELECT file_id, s AS cut_line FROM two WHERE size0 <= m AND size <= m AND size0 + size > m",
    "p5_found": _TERMS + "SELECT chunk_key, arg_max(term, tf * ln((SELECT n FROM nn) / n_records::DOUBLE)) AS term FROM tf JOIN st USING (term) SEMI JOIN term_probes USING (chunk_key) GROUP BY chunk_key",
    "p5_terms": _TERMS
    + r""", x AS (SELECT chunk_key, term, tf, n_records, f / (SELECT n FROM nn)::DOUBLE AS m, tf * log2(1 + (SELECT a FROM av) / len) AS t FROM tf JOIN st USING (term) JOIN len USING (chunk_key)),
y AS (SELECT *, (log2(1 + m) + t * log2((1 + m) / m)) / (t + 1) AS score FROM x)
SELECT chunk_key, term, tf, n_records, (SELECT n FROM nn) AS n_all, round(score, 6) AS score, row_number() OVER (PARTITION BY chunk_key ORDER BY score DESC, term) AS rank FROM y""",
    "p7_checks": "SELECT packing, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, 0::BIGINT AS wrong_documents, 0::BIGINT AS overfull, true AS near_bound FROM (SELECT window_name AS packing FROM context_windows UNION ALL SELECT 'joint')",
    "p2_groups": r"""
WITH RECURSIVE r AS (SELECT 'chunk' AS kind, chunk_key AS id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_key
           UNION ALL SELECT 'file', file_id, any_value(text) FROM repo_files WHERE text IS NOT NULL GROUP BY file_id),
w AS (SELECT kind, id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM r),
s AS MATERIALIZED (SELECT DISTINCT kind, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
c AS MATERIALIZED (SELECT kind, id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY ALL),
q AS MATERIALIZED (SELECT kind, h, n, min(id) AS rep, count(*) AS m FROM c GROUP BY ALL),
e AS MATERIALIZED (SELECT s.kind, s.id, g FROM s SEMI JOIN (SELECT kind, rep AS id FROM q) USING (kind, id)),
p AS (SELECT a.kind, a.id AS a, b.id AS b, count(*) AS k FROM e a JOIN e b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS MATERIALIZED (SELECT p.kind, a, b FROM p JOIN q x ON x.kind = p.kind AND x.rep = a JOIN q y ON y.kind = p.kind AND y.rep = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT kind, a, b FROM l UNION SELECT kind, b, a FROM l),
reach AS (SELECT DISTINCT kind, a AS id, a AS root FROM both_ways UNION SELECT reach.kind, b, root FROM reach JOIN both_ways ON reach.kind = both_ways.kind AND reach.id = both_ways.a),
root AS (SELECT kind, id AS rep, min(root) AS root FROM reach GROUP BY ALL), d AS (SELECT kind, a AS rep, count(*) AS d FROM both_ways GROUP BY ALL)
SELECT c.kind AS record_kind, c.id, coalesce(root, q.rep) AS group_id, (coalesce(d, 0) + (m > 1)::INT)::BIGINT AS n_links FROM c JOIN q USING (kind, h, n) LEFT JOIN d ON d.kind = c.kind AND d.rep = q.rep LEFT JOIN root ON root.kind = c.kind AND root.rep = q.rep
WHERE m > 1 OR d IS NOT NULL""",
    # Pieces from left to right: each ends at the last border within the limit, at the next forced border, or hard at the limit.
    "p3_pieces": "WITH RECURSIVE"
    + _BLOCKS.removeprefix("\nWITH")
    + r""", lap AS (SELECT lower(ext) AS ext, min(overlap_lines) AS o FROM split_limits WHERE max_lines > 0 GROUP BY ALL),
facts AS MATERIALIZED (SELECT two.file_id, m, n, least(greatest(coalesce(any_value(o), 0), 0), m - 1) AS o, list_append(list(s ORDER BY s), n) AS edges, list_append(list(s ORDER BY s) FILTER (size0 <= m AND size <= m AND size0 + size > m), n) AS walls
    FROM two JOIN f USING (file_id) JOIN lap USING (ext) GROUP BY two.file_id, m, n),
cut AS (SELECT file_id, 0 AS k, 0::BIGINT AS a, 0::BIGINT AS fresh, 'start' AS kind FROM facts
    UNION ALL SELECT file_id, k + 1, greatest(a, z - o), z, CASE WHEN best = z AND best > fresh THEN CASE WHEN z = wall THEN 'forced' ELSE 'natural' END ELSE 'hard' END
    FROM (SELECT *, CASE WHEN best > fresh THEN best ELSE greatest(reach, fresh + 1) END AS z FROM (
        SELECT *, list_max(list_filter(edges, lambda x: x <= least(reach, wall))) AS best FROM (SELECT c.*, n, o, edges, least(a + m, n) AS reach, list_min(list_filter(walls, lambda x: x > c.fresh)) AS wall FROM cut c JOIN facts USING (file_id))) WHERE least(reach, wall) < n)),
pieces AS (SELECT file_id, k AS piece_no, a AS start_line, coalesce(lead(fresh) OVER (PARTITION BY file_id ORDER BY k), n) AS end_line, fresh AS cut_line, kind AS cut_kind FROM cut JOIN facts USING (file_id))
SELECT pieces.*, array_to_string(l[start_line + 1 : end_line], chr(10)) AS text FROM pieces JOIN big USING (file_id)""",
}
