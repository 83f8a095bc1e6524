"""The same queries as SQL for DuckDB, as chains of common table expressions."""

from __future__ import annotations

from gleanspark.operators import ingest, measure
from gleanspark.operators import retrieval as R


# The word lists, extensions and patterns stand here a second time, so that a mistake in the engine's is not one in the SQL too.
#: Words left out of a question.
STOP_WORDS = (
    "how does do the this that what when where why which who is are was were and or but for with from into onto on in at to of it its work works working use used uses get set make made "
    "can will would should there here than then all any some not you your way doing done"
).split()
#: Extensions, folders and files.
SOURCE_EXT = "ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|rb|php|md|c|h|cc|cpp|cxx|hpp|cu|cuh|cs|kt|swift|scala|m|mm"
MORE_CODE_EXT = "sh|bash|zsh|pl|lua|r|jl|dart|ex|exs|erl|hs|ml|clj|vue|svelte|sql|proto"
SKIP_DIR = "(^|/)(node_modules|[.]git|[.]github|dist|build|out|vendor|[.]next|coverage|__pycache__|test|tests|__tests__|fixtures|examples?)/"
SKIP_FILE = "(^|/)(CONTRIBUTING|CHANGELOG|CODE_OF_CONDUCT|SECURITY|LICENSE|MIGRATION)[.]md$"
#: Declarations, defined names and imports.
DECLARATION = r"^(export\s+)?(async\s+)?(function|class|const|let|var|interface|type|enum|def|struct|impl|fn|func|package|public|private|protected|typedef|template|namespace)\b"
DEFINED_NAME = r"\b(?:function|class|interface|type|enum|def|struct|fn|func|impl|typedef)\s+([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)"
IMPORTS = (
    r"""\bimport\s+[^'"]*?from\s*['"]([^'"]+)['"]""",
    r"""\bimport\s*['"]([^'"]+)['"]""",
    r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    r"""\bexport\s+[^'"]*?from\s*['"]([^'"]+)['"]""",
    r"""(?m)^\s*from\s+([\w.]+)\s+import\b""",
)
IMPORT_EXT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")

#: Fixed value: definitions in the manner of C, over many lines; the name is group 1.
C_DEFINED_NAME = r"(?m)^(?:[A-Za-z_]\w*\s+|\*)+\**([A-Za-z_]\w*)\s*\([^;]*$"

#: White space as the patterns mean it, within the brackets of a class of RE2.
_WHITE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _re(pattern: str) -> str:
    r"""A pattern as a literal for RE2, whose \s is narrower."""
    return _q(pattern.replace(r"\s", f"[{_WHITE}]"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _terms(x: str) -> str:
    parts = r"list_transform(list_filter(regexp_split_to_array(regexp_replace(t, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_$ ]+'), lambda z: length(z) > 2), lambda z: lower(z))"
    both = f"list_transform(regexp_extract_all({x}, '[A-Za-z_$][A-Za-z0-9_$]*'), lambda t: {{'w': lower(t), 'p': {parts}}})"
    return f"flatten(list_transform({both}, lambda s: CASE WHEN len(s.p) > 1 THEN list_concat([s.w], s.p) ELSE [s.w] END))"


def _proxy(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z]+|[0-9]{{1,3}}|[^A-Za-z0-9 \\t\\r\\n]'))::BIGINT"


_SLUG = "lower(trim(slug))"
_PATH = r"regexp_replace(replace(trim(path), '\', '/'), '^([.]/)+', '')"
_STOP = ", ".join(_q(w) for w in STOP_WORDS)
_UNITS = r"(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')))"
_EXT = "split_part(path, '.', -1)"
_BLANK = f"(NOT regexp_matches(line, '[^{_WHITE}]'))"
_HEAD, _TAIL = "split_part(line, '(', 1)", "substr(line, length(split_part(line, '(', 1)) + 1)"
# Lines end at four characters; RE2 knows one.
_C_NAMES = f"regexp_extract_all(regexp_replace(text, '[\\r\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), {_re(C_DEFINED_NAME)}, 1)"
_NAMES0 = f"list_concat(list_filter(list_transform(list_zip(regexp_extract_all(text, {_re(DEFINED_NAME)}, 1), regexp_extract_all(text, {_re(DEFINED_NAME)}, 2)), lambda x: CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END), lambda x: x <> ''), {_C_NAMES})"
_STRUCT = rf"""(contains(line, '(') AND NOT contains({_TAIL}, ';') AND regexp_matches({_HEAD}, '^[A-Za-z_*][A-Za-z0-9_{_WHITE}*]*$')
    AND NOT regexp_matches({_HEAD}, '(^|[{_WHITE}*])[0-9]') AND NOT regexp_matches({_HEAD}, '[A-Za-z0-9_]\*|\*[{_WHITE}]') AND regexp_matches({_HEAD}, '[{_WHITE}*][A-Za-z_][A-Za-z0-9_]*[{_WHITE}]*$'))"""
_DECL = rf"""(length(line) > 0 AND (regexp_matches(regexp_replace(line, '^[{_WHITE}]+', ''), {_re(DECLARATION)}) OR (NOT regexp_matches(line, '^[{_WHITE}]') AND {_STRUCT})))"""
_LATEST = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY indexed_at DESC, coalesce(tokens, -1) DESC) = 1"
_VARIANT = "unnest(CASE WHEN path LIKE '%.md' THEN ['all'] ELSE ['all', 'code'] END) AS variant"
_K = "variant, repo_id, question"


_CTE: list[tuple[str, str]] = [
    ("files0", f"SELECT file_id, {_SLUG} AS repo_id, {_PATH} AS path, file_ord, coalesce(text, '') AS text, indexed_at, tokens FROM repo_files {_LATEST.format('file_id')}"),
    ("files", f"SELECT file_id, repo_id, path, file_ord, text, {_proxy('text')} AS tokens FROM files0"),
    ("fate", f"""SELECT *, {_UNITS} AS units,
        coalesce(regexp_matches(path, '(?i)[.]({SOURCE_EXT}|{MORE_CODE_EXT})$') AND NOT regexp_matches(path, '(?i){SKIP_DIR}'), false) AS seen,
        coalesce(regexp_matches(path, '(?i)[.]({SOURCE_EXT})$') AND NOT regexp_matches(path, '(?i){SKIP_DIR}') AND NOT regexp_matches(path, '(?i){SKIP_FILE}') AND {_UNITS} <= {ingest.MAX_FILE_UNITS}, false) AS indexed FROM files"""),
    ("lines", r"SELECT file_id, path, i - 1 AS ln, l[i] AS line FROM (SELECT file_id, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT file_id, path, string_split(text, chr(10)) AS l FROM files))"),
    ("seg0", f"SELECT file_id, path, ln, {_BLANK} AS blank, (ln = 0 OR {_DECL}) AS head FROM lines"),
    ("seg1", "SELECT *, max(CASE WHEN head THEN ln END) OVER (PARTITION BY file_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS run FROM seg0"),
    ("seg2", f"SELECT *, sum(CASE WHEN (ln - run) % {ingest.MAX_LINES} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS idx FROM seg1"),
    ("segments", "SELECT file_id, path, idx::BIGINT AS idx, min(ln) AS start_line, max(ln) + 1 AS end_line, bool_and(blank) AS blank FROM seg2 GROUP BY ALL"),
    ("fold0", f"SELECT *, (NOT blank AND (end_line - start_line >= {ingest.MIN_LINES} OR idx = min(CASE WHEN NOT blank THEN idx END) OVER (PARTITION BY file_id))) AS push FROM segments"),
    ("fold1", "SELECT *, sum(push::INT) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS chunk FROM fold0"),
    ("fold2", f"SELECT file_id, path, chunk, max(CASE WHEN push THEN start_line END) AS s, max(end_line) AS e, max(CASE WHEN push THEN end_line END) AS e0 FROM fold1 WHERE chunk > 0 AND (push OR end_line - start_line < {ingest.MIN_LINES}) GROUP BY ALL"),
    ("specs", "SELECT DISTINCT repo_id, path, unnest(list_concat(" + ", ".join(f"regexp_extract_all(text, {_re(p)}, 1)" for p in IMPORTS) + ")) AS spec FROM files"),
    ("chunks0", f"SELECT * FROM chunks {_LATEST.format('chunk_key')}"),
    ("ch", f"""SELECT chunk_key, file_id, {_SLUG} AS repo_id, {_PATH} AS path, chunk_ord, least(start_line, end_line) AS start_line, greatest(start_line, end_line) AS end_line,
        coalesce(text, '') AS text, coalesce(defines, []) AS defines, {_proxy("coalesce(text, '')")} AS tokens FROM chunks0"""),
    ("ct", f"SELECT chunk_key, repo_id, path, {_terms('text')} AS terms FROM ch"),
    ("lens", "SELECT chunk_key, repo_id, path, len(terms)::BIGINT AS len FROM ct"),
    ("corpus", f"SELECT variant, repo_id, count(*) AS n_chunks, avg(len) AS avg_len FROM (SELECT *, {_VARIANT} FROM lens) GROUP BY ALL"),
    ("qs0", f"SELECT {_SLUG} AS repo_id, question, max(expectation) AS expectation, max(quarantined) AS quarantined FROM cases WHERE slug IS NOT NULL AND question IS NOT NULL GROUP BY ALL"),
    ("qs1", f"SELECT *, {_terms('question')} AS t FROM qs0"),
    ("qs", f"SELECT repo_id, question, expectation, quarantined, list_filter(list_filter(t, lambda x, i: list_position(t, x) = i), lambda x: x NOT IN ({_STOP})) AS qterms FROM qs1"),
    ("qt", "SELECT repo_id, question, i - 1 AS term_pos, qterms[i] AS term FROM (SELECT *, unnest(range(1, len(qterms) + 1)) AS i FROM qs)"),
    ("post", "SELECT repo_id, chunk_key, path, term, count(*) AS tf FROM (SELECT repo_id, chunk_key, path, unnest(terms) AS term FROM ct) SEMI JOIN qt USING (repo_id, term) GROUP BY ALL"),
    ("postv", f"SELECT *, {_VARIANT} FROM post"),
    ("dfreq", "SELECT variant, repo_id, term, count(*) AS df FROM postv GROUP BY ALL"),
    ("hits", f"""SELECT {_K}, chunk_key, term_pos, term, ln(1 + (n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * ({R.K1}::DOUBLE + 1) / (tf + {R.K1}::DOUBLE * (1 - {R.B}::DOUBLE + {R.B}::DOUBLE * len / (CASE WHEN avg_len = 0 THEN 1 ELSE avg_len END)))) AS part
        FROM postv JOIN dfreq USING (variant, repo_id, term) JOIN corpus USING (variant, repo_id) JOIN (SELECT chunk_key, len FROM lens) USING (chunk_key) JOIN qt USING (repo_id, term)"""),
    ("raw", f"SELECT {_K}, chunk_key, sum(part ORDER BY term_pos) AS raw, list(term ORDER BY term_pos) AS matched FROM hits GROUP BY ALL"),
    ("scored", f"""SELECT {_K}, chunk_key, matched, file_id, chunk_ord, path, start_line, end_line, tokens,
        raw * CASE WHEN list_has_any(list_transform(defines, lambda x: lower(x)), qterms) THEN {R.DEFINITION_BOOST}::DOUBLE ELSE 1::DOUBLE END AS score
        FROM raw JOIN (SELECT * EXCLUDE (repo_id, text) FROM ch) USING (chunk_key) JOIN qs USING (repo_id, question)"""),
    ("direct", f"SELECT * FROM scored WHERE score > {R.NOISE_FLOOR}::DOUBLE"),
    ("seeds", f"SELECT DISTINCT {_K}, path FROM (SELECT * FROM direct QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY score DESC, file_id, chunk_ord, chunk_key) <= {R.SEEDS})"),
    ("there", f"SELECT DISTINCT variant, repo_id, path FROM (SELECT repo_id, path, {_VARIANT} FROM files)"),
    ("wanted0", f"SELECT repo_id, path AS src, spec, {_VARIANT}, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder FROM specs"),
    ("wanted1", """SELECT *, CASE WHEN starts_with(spec, '.') THEN folder || '/' || spec WHEN starts_with(spec, '@/') THEN 'src/' || substr(spec, 3)
        WHEN contains(spec, '.') AND NOT contains(spec, '/') THEN replace(spec, '.', '/') END AS raw, starts_with(spec, '.') OR starts_with(spec, '@/') AS relative FROM wanted0"""),
    ("norm", """SELECT raw, list_filter(string_split(raw, '/'), lambda z: z NOT IN ('', '.')) AS todo, []::VARCHAR[] AS done FROM (SELECT DISTINCT raw FROM wanted1 WHERE relative)
        UNION ALL SELECT raw, todo[2:], CASE WHEN todo[1] = '..' AND len(done) > 0 AND done[-1] <> '..' THEN done[:-2] ELSE list_append(done, todo[1]) END FROM norm WHERE len(todo) > 0"""),
    ("normal", "SELECT raw, CASE WHEN len(done) = 0 THEN '.' ELSE array_to_string(done, '/') || CASE WHEN raw LIKE '%/' THEN '/' ELSE '' END END AS base FROM norm WHERE len(todo) = 0"),
    ("wanted", "SELECT variant, repo_id, src, spec, CASE WHEN relative THEN base ELSE w.raw END AS base FROM wanted1 w LEFT JOIN normal n ON w.raw = n.raw WHERE w.raw IS NOT NULL"),
    ("tries", "SELECT variant, repo_id, src, spec, c.place AS place, base || c.suffix AS path FROM wanted, (VALUES (0, '')" + "".join(f", ({3 * i + j + 1}, {_q(p + e)})" for i, e in enumerate(IMPORT_EXT) for j, p in enumerate(("", "/index", "/__init__"))) + ") c(place, suffix)"),
    ("edges", "SELECT DISTINCT repo_id, variant, src, dst FROM (SELECT variant, repo_id, src, spec, arg_min(path, place) AS dst FROM tries SEMI JOIN there USING (variant, repo_id, path) GROUP BY ALL) WHERE src <> dst"),
    ("links", "SELECT variant, repo_id, src AS path, dst AS target FROM edges UNION SELECT variant, repo_id, dst, src FROM edges"),
    ("hop1", f"SELECT DISTINCT {_K}, target AS path FROM seeds JOIN links USING (variant, repo_id, path)"),
    ("hop2", f"SELECT DISTINCT {_K}, target AS path FROM hop1 JOIN links USING (variant, repo_id, path)"),
    ("hops", f"SELECT {_K}, path, min(hop) AS hop FROM (SELECT {_K}, path, 0 AS hop FROM seeds UNION ALL SELECT {_K}, path, 1 FROM hop1 UNION ALL SELECT {_K}, path, 2 FROM hop2) GROUP BY ALL"),
    ("weakest", f"SELECT {_K}, min(score) AS weakest FROM direct GROUP BY ALL"),
    ("expansion", f"""SELECT {_K}, chunk_key, file_id, chunk_ord, path, start_line, end_line, tokens, hop, {R.SIBLING_WEIGHT}::DOUBLE * pow({R.HOP_DECAY}::DOUBLE, hop) AS weight, weakest * ({R.SIBLING_WEIGHT}::DOUBLE * pow({R.HOP_DECAY}::DOUBLE, hop)) AS score
        FROM (SELECT *, {_VARIANT} FROM ch) JOIN hops USING (variant, repo_id, path) JOIN weakest USING ({_K}) ANTI JOIN direct USING ({_K}, chunk_key)"""),
    ("tiers", f"""SELECT {_K}, chunk_key, file_id, chunk_ord, path, start_line, end_line, tokens, score, 0 AS hop, 0 AS tier, score AS worth, score AS tie, 'matched: ' || array_to_string(matched[1:3], ', ') AS reason FROM direct
        UNION ALL SELECT {_K}, chunk_key, file_id, chunk_ord, path, start_line, end_line, tokens, score, hop, 1, weight, 0, CASE hop WHEN 0 THEN 'same file as a match' WHEN 1 THEN 'imported by / imports a match' ELSE hop || ' hops from a match' END FROM expansion"""),
    ("ordered0", "SELECT *, CASE WHEN tokens = 0 THEN 'infinity'::DOUBLE ELSE worth / tokens END AS density FROM tiers"),
    ("ordered", f"""SELECT *, row_number() OVER w AS pos, (sum(tokens) OVER (PARTITION BY {_K} ORDER BY tier, density DESC, tie DESC, file_id, chunk_ord, chunk_key ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
        FROM ordered0 WINDOW w AS (PARTITION BY {_K} ORDER BY tier, density DESC, tie DESC, file_id, chunk_ord, chunk_key)"""),
    ("totals", f"""SELECT variant, repo_id, naive_tokens, n_files, coalesce(n_chunks, 0) AS n_chunks FROM (SELECT variant, repo_id, sum(tokens)::BIGINT AS naive_tokens, count(*) AS n_files FROM (SELECT *, {_VARIANT} FROM files) GROUP BY ALL)
        LEFT JOIN (SELECT variant, repo_id, count(*) AS n_chunks FROM (SELECT *, {_VARIANT} FROM ch) GROUP BY ALL) USING (variant, repo_id)"""),
    ("satur", f"SELECT {_K}, sum(tokens)::BIGINT AS saturation_tokens FROM direct GROUP BY ALL"),
    ("anch", f"SELECT DISTINCT {_SLUG} AS repo_id, question, {_PATH} AS path, line::BIGINT AS line FROM anchors WHERE path IS NOT NULL AND line IS NOT NULL"),
    ("asked", "SELECT * FROM anch JOIN (SELECT variant, repo_id FROM totals) USING (repo_id) SEMI JOIN qs USING (repo_id, question)"),
    ("depth", """SELECT a.variant, a.repo_id, a.question, a.path, a.line, min(o.cum) AS depth FROM asked a
        LEFT JOIN ordered o ON a.variant = o.variant AND a.repo_id = o.repo_id AND a.question = o.question AND a.path = o.path AND o.start_line <= a.line - 1 AND a.line - 1 < o.end_line GROUP BY ALL"""),
    ("need", f"SELECT {_K}, max(depth) AS t, count(*) FILTER (depth IS NULL) AS lost FROM depth GROUP BY ALL"),
    ("need1", f"SELECT {_K}, t, naive_tokens AS ceiling, (lost = 0 AND t <= naive_tokens) AS found FROM need JOIN totals USING (variant, repo_id)"),
    ("bisect", f"""SELECT {_K}, t, 0::BIGINT AS lo, ceiling::BIGINT AS hi, 1::BIGINT AS p FROM need1 WHERE found
        UNION ALL SELECT {_K}, t, CASE WHEN (lo + hi) // 2 >= t THEN lo ELSE (lo + hi) // 2 END, CASE WHEN (lo + hi) // 2 >= t THEN (lo + hi) // 2 ELSE hi END, p + 1 FROM bisect WHERE hi - lo > {measure.SEARCH_STEP}"""),
    ("settled", f"SELECT {_K}, hi, p FROM bisect WHERE hi - lo <= {measure.SEARCH_STEP}"),
    ("minimum", f"""SELECT n.variant, n.repo_id, n.question, coalesce(n.found, false) AS found, CASE WHEN n.found THEN n.t END AS exact_tokens, s.hi AS min_budget, coalesce(s.p + 1, 1) AS probes, u.tokens_used
        FROM need1 n LEFT JOIN settled s USING ({_K}) LEFT JOIN (SELECT {_K}, max(cum) AS tokens_used FROM settled JOIN ordered USING ({_K}) WHERE cum <= hi GROUP BY ALL) u USING ({_K})"""),
    ("ghits", "SELECT repo_id, question, term_pos, term, path, tokens FROM qt JOIN (SELECT repo_id, path, tokens, lower(text) AS low FROM files) USING (repo_id) WHERE length(term) > 3 AND contains(low, term)"),
    ("gunion", "SELECT repo_id, question, count(*) AS naive_files, sum(tokens)::BIGINT AS naive_tokens FROM (SELECT DISTINCT repo_id, question, path, tokens FROM ghits) GROUP BY ALL"),
    ("gbest", "SELECT repo_id, question, term AS best_term, n AS best_files, bt AS best_tokens FROM (SELECT repo_id, question, term, term_pos, count(*) AS n, sum(tokens)::BIGINT AS bt FROM ghits GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo_id, question ORDER BY n, term_pos) = 1"),
    ("grep", """SELECT repo_id, question, coalesce(naive_files, 0) AS naive_files, coalesce(naive_tokens, 0) AS naive_tokens, best_term, coalesce(best_files, 0) AS best_files, coalesce(best_tokens, 0) AS best_tokens
        FROM qs LEFT JOIN gunion USING (repo_id, question) LEFT JOIN gbest USING (repo_id, question)"""),
    ("rec", f"""SELECT {_K}, budget::INT AS budget, count(*) FILTER (depth <= budget) AS found, count(*) AS total FROM depth, (SELECT unnest([{', '.join(map(str, measure.BUDGETS))}]) AS budget) GROUP BY ALL"""),
    ("held", f"""SELECT {_K}, a.path, line, budget, coalesce(depth <= budget, false) AS held FROM depth a JOIN (SELECT variant, repo_id, naive_tokens FROM totals) USING (variant, repo_id), (SELECT unnest([{', '.join(map(str, measure.BUDGETS))}]) AS budget) WHERE budget <= naive_tokens"""),
    ("steps", "SELECT unnest([200, 270, 365, 493, 666, 900, 1215, 1641, 2216, 2992, 4040, 5454, 7363, 9941, 13421, 18119, 24461, 33023, 44582, 60186, 81252, 109691]) AS budget"),
    ("held22", f"SELECT {_K}, a.path, line, budget, coalesce(depth <= budget, false) AS held FROM depth a JOIN (SELECT variant, repo_id, naive_tokens FROM totals) USING (variant, repo_id), steps WHERE budget <= naive_tokens"),
    ("gbestv", """SELECT 'all' AS variant, repo_id, question, best_tokens AS bt FROM gbest UNION ALL SELECT 'code', repo_id, question, bt FROM (SELECT repo_id, question, term, term_pos, count(*) AS n, sum(tokens)::BIGINT AS bt FROM ghits WHERE path NOT LIKE '%.md' GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY repo_id, question ORDER BY n, term_pos) = 1"""),
    ("dvec", "SELECT vec_id, embedding::DOUBLE[] AS e, max(vec_id) OVER () + 1 AS nv FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL"),
    ("dasked", "SELECT repo_id, question, e AS qe FROM qs JOIN dvec ON length(question) % nv = vec_id"),
    ("drows", """SELECT repo_id, question, path, start_line, end_line, coalesce(tokens, 0) AS tokens, row_number() OVER w AS rank, sum(coalesce(tokens, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT *, list_dot_product(qe, e) AS dot FROM ch JOIN dvec ON chunk_key % nv = vec_id JOIN dasked USING (repo_id)) WINDOW w AS (PARTITION BY repo_id, question ORDER BY dot DESC, file_id, chunk_ord, chunk_key)"""),
    ("dfirst", """SELECT a.repo_id, a.question, a.path, a.line, min(rank)::BIGINT AS rank, min(s) AS s FROM (SELECT * FROM anch SEMI JOIN dasked USING (repo_id, question)) a
        LEFT JOIN drows o ON a.repo_id = o.repo_id AND a.question = o.question AND a.path = o.path AND o.start_line <= a.line - 1 AND a.line - 1 < o.end_line GROUP BY ALL"""),
    ("dranks", "SELECT repo_id, question, path, line, rank FROM dfirst"),
    ("dsums", "SELECT repo_id, question, bool_and(rank IS NOT NULL) AS reached, max(s) AS s FROM dfirst GROUP BY ALL"),
    ("dtop", "SELECT repo_id, question, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS top_paths FROM (SELECT repo_id, question, list(path ORDER BY rank) AS l FROM drows WHERE rank <= 5 GROUP BY ALL)"),
    ("against", """SELECT m.repo_id, m.question, m.found, t.naive_tokens, coalesce(m.tokens_used, t.naive_tokens) AS tokens, g.best_tokens AS grep_tokens, g.best_tokens / nullif(coalesce(m.tokens_used, t.naive_tokens), 0)::DOUBLE AS ratio, g.best_tokens / nullif(t.naive_tokens, 0)::DOUBLE AS share
        FROM minimum m JOIN totals t ON m.repo_id = t.repo_id AND t.variant = 'all' JOIN grep g ON m.repo_id = g.repo_id AND m.question = g.question WHERE m.variant = 'all'"""),
    ("listing", f"""SELECT repo_id, question, note, coalesce(n_files, 0) AS n_files, coalesce(n_chunks, 0) AS n_chunks, coalesce(tokens, 0) AS tokens, coalesce(code_tokens, 0) AS code_tokens
        FROM (SELECT {_SLUG} AS repo_id, question, note FROM repos WHERE slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_SLUG} ORDER BY indexed_at DESC, coalesce(question, '') DESC, coalesce(note, '') DESC) = 1)
        LEFT JOIN (SELECT repo_id, count(*) AS n_files, sum(tokens)::BIGINT AS tokens, sum(CASE WHEN path LIKE '%.md' THEN 0 ELSE tokens END)::BIGINT AS code_tokens FROM files GROUP BY ALL) USING (repo_id)
        LEFT JOIN (SELECT repo_id, count(*) AS n_chunks FROM ch GROUP BY ALL) USING (repo_id)"""),
]

_SCORE = f"SELECT {_K}, chunk_key, round(score, 6) AS score"
_SELECT = {
    "source_filter": "SELECT file_id, repo_id, path FROM fate WHERE indexed",
    "size_gate": f"SELECT repo_id, sum(units)::BIGINT AS source_units, sum(units) > {ingest.MAX_SOURCE_UNITS} AS refused FROM fate WHERE indexed GROUP BY repo_id",
    "coverage": "SELECT repo_id, s AS seen_units, i AS indexed_units, round(CASE WHEN s = 0 THEN 100 ELSE i * 100.0::DOUBLE / s END, 6) AS pct FROM (SELECT repo_id, sum(CASE WHEN seen THEN units ELSE 0 END)::BIGINT AS s, sum(CASE WHEN seen AND indexed THEN units ELSE 0 END)::BIGINT AS i FROM fate GROUP BY repo_id)",
    "skipped_by_ext": f"SELECT repo_id, ext, units, row_number() OVER (PARTITION BY repo_id ORDER BY units DESC, ext) AS place FROM (SELECT repo_id, lower({_EXT}) AS ext, sum(units)::BIGINT AS units FROM fate WHERE seen AND NOT indexed GROUP BY ALL) QUALIFY place <= 6",
    "naive_tokens": "SELECT variant, repo_id, naive_tokens AS tokens, n_files FROM totals",
    "file_tree": "SELECT repo_id, path, tokens FROM files",
    "line_grep": "SELECT file_id, path, ln + 1 AS line, substr(trim(line), 1, 100) AS shown FROM lines WHERE contains(line, 'return')",
    "decl_lines": f"SELECT file_id, ln FROM lines WHERE ln > 0 AND {_DECL}",
    "chunk_segments": "SELECT file_id, idx, start_line, end_line, blank FROM segments",
    "chunk_fold": f"""SELECT * EXCLUDE (d), array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ' ') AS defines FROM (SELECT *, {_NAMES0} AS d FROM (
        SELECT f.file_id, f.path, (chunk - 1)::INT AS chunk_ord, f.path || '#' || s || '-' || e0 AS id, s AS start_line, e AS end_line, array_to_string((string_split(text, chr(10)))[s + 1 : e], chr(10)) AS text FROM fold2 JOIN files f USING (file_id)))""",
    "defined_symbols": f"SELECT DISTINCT chunk_key, unnest({_NAMES0}) AS symbol FROM ch",
    "tokenize_terms": "SELECT chunk_key, term, count(*) AS tf FROM (SELECT chunk_key, unnest(terms) AS term FROM ct) GROUP BY ALL",
    "query_terms": "SELECT * FROM qt",
    "corpus_stats": "SELECT variant, repo_id, n_chunks, round(avg_len, 6) AS avg_len FROM corpus",
    "doc_freq": "SELECT * FROM dfreq",
    "bm25_scores": _SCORE + ", array_to_string(matched, ' ') AS matched FROM scored",
    "direct_tier": _SCORE + ", tokens FROM direct",
    "saturation": "SELECT * FROM satur",
    "seed_files": "SELECT * FROM seeds",
    "import_specs": "SELECT * FROM specs",
    "import_edges": "SELECT * FROM edges",
    "khop_neighbours": "SELECT * FROM hops",
    "expansion_tier": _SCORE + ", hop FROM expansion",
    "priority_order": f"SELECT {_K}, chunk_key, tier, hop, reason, pos, cum FROM ordered",
    "budget_pack": _SCORE + ", path, tokens FROM ordered WHERE cum <= 8000",
    "near_misses": _SCORE + f", row_number() OVER (PARTITION BY {_K} ORDER BY ordered.score DESC, pos) AS place FROM ordered WHERE cum > 2000 AND hop = 0 QUALIFY place <= {R.NEAR_MISSES}",
    "selection_report": f"""SELECT {_K}, naive_tokens, coalesce(u, 0) AS selected_tokens, round(CASE WHEN naive_tokens = 0 THEN 0 ELSE (naive_tokens - coalesce(u, 0)) / naive_tokens::DOUBLE * 100 END, 6) AS reduction_pct,
        coalesce(saturation_tokens, 0) AS saturation_tokens, n_files - coalesce(kf, 0) AS dropped_files, n_chunks - coalesce(kc, 0) AS dropped_chunks
        FROM totals JOIN qs USING (repo_id) LEFT JOIN (SELECT {_K}, sum(CASE WHEN cum <= 8000 THEN tokens ELSE 0 END)::BIGINT AS u, count(*) FILTER (cum <= 8000) AS kc, count(DISTINCT path) FILTER (cum <= 8000) AS kf FROM ordered GROUP BY ALL) USING ({_K}) LEFT JOIN satur USING ({_K})""",
    "context_render": f"""SELECT {_K}, 'QUESTION: ' || question || chr(10) || chr(10) || string_agg('--- ' || path || ':' || start_line || '-' || end_line || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY score DESC, pos) AS context
        FROM ordered JOIN (SELECT chunk_key, text FROM ch) USING (chunk_key) WHERE cum <= 2000 GROUP BY {_K}""",
    "grep_baseline": "SELECT * FROM grep",
    "missed_by_grep": "SELECT DISTINCT o.repo_id, o.question, o.path FROM ordered o ANTI JOIN (SELECT g.repo_id, g.question, g.path FROM ghits g JOIN gbest b ON g.repo_id = b.repo_id AND g.question = b.question AND g.term = b.best_term) x USING (repo_id, question, path) WHERE o.cum <= 8000 AND o.variant = 'all'",
    "anchor_depth": "SELECT * FROM depth",
    "recall": "SELECT *, round(found * 100.0::DOUBLE / total, 6) AS pct FROM rec",
    "budget_sweep": "SELECT variant, budget, round(avg(found * 100.0::DOUBLE / total), 6) AS mean_pct, count(*) AS n_questions FROM rec SEMI JOIN (SELECT * FROM qs WHERE quarantined IS NULL) q USING (repo_id, question) GROUP BY variant, budget",
    "packing_found": f"SELECT {_K}, budget::INT AS budget, count(*) FILTER (held) AS found FROM held GROUP BY ALL",
    "monotone_check": f"""SELECT {_K}, budget::INT AS budget, found, before FROM (SELECT *, lag(found) OVER (PARTITION BY {_K} ORDER BY budget) AS before FROM (SELECT {_K}, budget, count(*) FILTER (held) AS found FROM held22 GROUP BY ALL)) WHERE found < before""",
    "token_cost": """SELECT repo_id, question, naive_tokens AS all_tokens, best_term, best_tokens AS grep_tokens, coalesce(u, 0)::BIGINT AS selected_tokens FROM (SELECT * FROM totals WHERE variant = 'all') JOIN qs USING (repo_id) JOIN (SELECT repo_id, question, best_term, best_tokens FROM grep) USING (repo_id, question)
        LEFT JOIN (SELECT repo_id, question, sum(tokens) AS u FROM ordered WHERE variant = 'all' AND cum <= 8000 GROUP BY ALL) USING (repo_id, question)""",
    "best_files": "SELECT g.repo_id, g.question, g.path FROM ghits g JOIN gbest b ON g.repo_id = b.repo_id AND g.question = b.question AND g.term = b.best_term",
    "grep_ratio": f"""SELECT {_K}, CASE WHEN why IS NULL THEN round(bt / nullif(CASE WHEN at_min THEN tokens_used ELSE sel END, 0)::DOUBLE, 6) END AS ratio, at_min AS at_minimum, why AS withheld, CASE WHEN pct IS NULL THEN sat END AS bound_tokens FROM (
        SELECT *, CASE WHEN at_min THEN NULL WHEN sel = 0 THEN 'nothing selected' WHEN pct IS NULL THEN 'no anchors' WHEN pct < 100 THEN 'not retrieved' END AS why FROM (
            SELECT {_K}, coalesce(u, 0) AS sel, coalesce(saturation_tokens, 0) AS sat, pct, tokens_used, coalesce(found AND tokens_used > 0, false) AS at_min, coalesce(bt, 0) AS bt FROM totals JOIN qs USING (repo_id)
            LEFT JOIN (SELECT {_K}, sum(tokens)::BIGINT AS u FROM ordered WHERE cum <= 8000 GROUP BY ALL) USING ({_K}) LEFT JOIN satur USING ({_K}) LEFT JOIN (SELECT {_K}, found, tokens_used FROM minimum) USING ({_K})
            LEFT JOIN (SELECT {_K}, found * 100.0::DOUBLE / total AS pct FROM rec WHERE budget = 8000) USING ({_K}) LEFT JOIN gbestv USING ({_K})))""",
    "dense_ranks": "SELECT * FROM dranks",
    "dense_minimum": """SELECT repo_id, question, coalesce(reached, true) AS reached, CASE WHEN coalesce(reached, true) THEN coalesce(s, 0)::BIGINT END AS min_tokens, coalesce(top_paths, '') AS top_paths FROM dasked
        LEFT JOIN dsums USING (repo_id, question) LEFT JOIN dtop USING (repo_id, question)""",
    "dense_against_selector": """SELECT repo_id, question, a AS selector_tokens, b AS dense_tokens, CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL OR a < b THEN 'selector' WHEN a IS NULL OR b < a THEN 'dense' ELSE 'tie' END AS winner FROM (
        SELECT repo_id, question, m.tokens_used AS a, CASE WHEN coalesce(reached, true) THEN coalesce(s, 0)::BIGINT END AS b FROM (SELECT * FROM minimum WHERE variant = 'all') m JOIN dasked USING (repo_id, question) LEFT JOIN dsums USING (repo_id, question))""",
    "minimum_budget": "SELECT * FROM minimum",
    "markdown_effect": """SELECT repo_id, question, a.tokens_used AS with_md, c.tokens_used AS code_only, round((a.tokens_used - c.tokens_used) * 100.0::DOUBLE / nullif(a.tokens_used, 0), 6) AS change_pct,
        CASE WHEN a.tokens_used IS NULL AND c.tokens_used IS NOT NULL THEN 'NOW FOUND' WHEN a.tokens_used IS NOT NULL AND c.tokens_used IS NULL THEN 'NOW LOST' ELSE '-' END AS verdict
        FROM (SELECT * FROM minimum WHERE variant = 'all') a FULL JOIN (SELECT * FROM minimum WHERE variant = 'code') c USING (repo_id, question)""",
    "minimum_vs_grep": "SELECT * REPLACE (round(ratio, 6) AS ratio, round(share, 6) AS share) FROM against",
    "selectivity": "SELECT coalesce(ratio, 0) > 1 AS solved, count(*) AS n, round(avg(share), 6) AS mean_share, round(avg(ratio), 6) AS mean_ratio, round(avg(naive_tokens), 6) AS mean_tokens FROM against GROUP BY 1",
    "dense_rank": """SELECT q.vec_id AS question_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, v.e) DESC, v.vec_id) AS place
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) q JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v ON q.vec_id <> v.vec_id QUALIFY place <= 5""",
    "chunk_quality": f"""SELECT repo_id, count(*) AS n, list_sort(list(size))[(count(*) // 2) + 1] AS upper_median_lines, round(count(*) FILTER (size = {ingest.MAX_LINES}) * 100.0::DOUBLE / count(*), 6) AS pct_forced, round(count(*) FILTER (len(defines) > 0) * 100.0::DOUBLE / count(*), 6) AS pct_with_symbol
        FROM (SELECT *, (end_line - start_line)::BIGINT AS size FROM ch WHERE start_line IS NOT NULL AND end_line IS NOT NULL) GROUP BY repo_id""",
    "symbols_by_ext": f"SELECT repo_id, {_EXT} AS ext, count(*) AS n, round(count(*) FILTER (len(defines) > 0) * 100.0::DOUBLE / count(*), 6) AS pct_with_symbol, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, {_EXT}) AS place FROM ch GROUP BY repo_id, {_EXT} QUALIFY place <= 4",
    "repo_listing": "SELECT *, row_number() OVER (ORDER BY tokens, repo_id) AS place FROM listing",
    "landing_repo": "SELECT repo_id, tokens FROM listing ORDER BY (tokens <= 8000)::INT, tokens, repo_id LIMIT 1",
    "markdown_share": "SELECT repo_id, sum(tokens)::BIGINT AS tokens, round(coalesce(sum(CASE WHEN path LIKE '%.md' THEN tokens ELSE 0 END) * 100.0::DOUBLE / nullif(sum(tokens), 0), 0), 6) AS markdown_pct FROM files GROUP BY repo_id",
}


_LPATH = """CASE WHEN file_id % 9 = 8 THEN CASE WHEN file_id % 2 = 0 THEN 'src/m' || file_id || '.sh' ELSE 'src/m' || file_id || '/CHANGELOG.md' END
    ELSE CASE file_id % 5 WHEN 0 THEN 'src/m' || file_id || '.ts' WHEN 1 THEN 'src/m' || file_id || '/index.js' WHEN 2 THEN 'src/m' || file_id || '/__init__.py' WHEN 3 THEN 'src/deep/m' || file_id || '.mjs' ELSE 'src/m' || file_id || '.md' END END"""
_LKIND = "(((file_id - 20) % 5 + 5) % 5)"
_LTHERE = f"CASE {_LKIND} WHEN 3 THEN 'deep/m' || (file_id - 20) WHEN 4 THEN 'm' || (file_id - 20) || '.md' ELSE 'm' || (file_id - 20) END"
_LFOLDER = "CASE WHEN file_id % 9 = 8 THEN CASE WHEN file_id % 2 = 0 THEN './' ELSE '../' END WHEN file_id % 5 IN (1, 2) THEN '../' WHEN file_id % 5 = 3 THEN '.././' ELSE './' END"
_LIMPORT = f"""CASE WHEN file_id % 4 = 0 THEN 'import {{ a }} from "' || {_LFOLDER} || {_LTHERE} || '";' WHEN file_id % 4 = 1 THEN 'const b = require(' || chr(39) || {_LFOLDER} || {_LTHERE} || chr(39) || ');'
    WHEN file_id % 4 = 2 AND {_LKIND} <> 4 THEN 'from ' || replace('src/' || {_LTHERE}, '/', '.') || ' import c' ELSE 'export * from "@/' || {_LTHERE} || '"' END"""
#: The files that import each other, their chunks and questions: made from the plain ones, which keep their name with a stroke.
_LINKED = {
    "files": f"SELECT file_id, 'made/r' || (file_id % 20) AS repo_id, {_LPATH} AS path, file_ord, {_LIMPORT} || chr(10) || text AS text, tokens FROM files_ WHERE file_id IS NOT NULL",
    "ch": f"SELECT * REPLACE ('made/r' || (file_id % 20) AS repo_id, {_LPATH} AS path) FROM ch_ WHERE file_id IS NOT NULL",
    "qs0": "SELECT 'made/r' || (length(question) % 20) AS repo_id, question, max(expectation) AS expectation, max(quarantined) AS quarantined FROM qs0_ GROUP BY question",
}
_OF = {"specs": "import_specs", "edges": "import_edges", "skipped_by_ext": "skipped_by_ext", "coverage": "coverage", "neighbours": "khop_neighbours", "expansion": "expansion_tier", "order": "priority_order"}
_SELECT |= {f"linked_{n}": _SELECT[of] for n, of in _OF.items()}


def _linked() -> list[tuple[str, str]]:
    out = []
    for n, s in _CTE:
        out += [(f"{n}_", s), (n, _LINKED[n])] if n in _LINKED else [(n, s)]
    return out


def _needed(text: str, ctes: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The expressions that ``text`` reads, directly or not, in order."""
    import re

    names = {n for n, _ in ctes}
    body = dict(ctes)
    seen: set[str] = set()

    def visit(t: str) -> None:
        for w in set(re.findall(r"[a-z_0-9]+", t)) & names - seen:
            if re.search(rf"(FROM|JOIN|,)\s+{w}\b", t):
                seen.add(w)
                visit(body[w])

    visit(text)
    return [(n, s) for n, s in ctes if n in seen]


def sql() -> dict[str, str]:
    out = {}
    for name, select in _SELECT.items():
        with_ = ",\n".join(f"{n} AS MATERIALIZED ({s})" if n not in ("norm", "bisect") else f"{n} AS ({s})" for n, s in _needed(select, _linked() if name.startswith("linked_") else _CTE))
        out[name] = (f"WITH RECURSIVE {with_}\n{select}") if with_ else select
    return out
