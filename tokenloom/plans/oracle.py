"""DuckDB oracle: for each registered query, an independent SQL formulation.

The views come from ``views_sql`` (same fixture text as the Spark side); the
operator logic below is written again in plain SQL, usually in a different
shape (per-rule explode instead of combined regexes, unnest + join instead
of row-local arrays, brute-force containment instead of n-gram joins).
"""
from __future__ import annotations

import fnmatch

from tokenloom.functions.text import APPROX_TOKEN_RE, WORD_TOKEN_RE
from tokenloom.operators.filters import BASELINE_SKIP_DIRS, BINARY_SUFFIXES, DEFAULT_IGNORE_DIRS
from tokenloom.plans.views_sql import RULES_A, RULES_B, RULES_C, duckdb_with

ORACLE: dict[str, str] = {}


def _lst(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _approx(col: str) -> str:
    return f"CAST(len(regexp_extract_all({col}, $${APPROX_TOKEN_RE}$$, 0)) AS BIGINT)"


def _words(col: str) -> str:
    return f"list_transform(regexp_extract_all({col}, '{WORD_TOKEN_RE}', 1), lambda x: lower(x))"


def _glob(p: str) -> str:
    """The standard library's own translation of each rule of the proof view."""
    rules = {line.strip().rstrip("/") for text in (RULES_A, RULES_B, RULES_C) for line in text.splitlines()}
    cases = []
    for rule in sorted(rules):
        rx = fnmatch.translate(rule).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z")
        rx = rx.replace("(?>", "(?:").replace("(?!)", "[^\\x{0}-\\x{10FFFF}]").replace("'", "''")
        cases.append(f"WHEN '{rule.replace(chr(39), chr(39) * 2)}' THEN '(?s:{rx})'")
    return f"CASE {p} {' '.join(cases)} END"


# Parsed rules, per-rule match of every file, and the three file sets.
_RULES = f"""
rl AS (SELECT project, unnest(generate_series(1, len(string_split(content, chr(10))))) AS ord,
              unnest(string_split(content, chr(10))) AS line FROM v_rules_files),
rules AS (SELECT project, ord, trim(line) AS pattern FROM rl
          WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')),
rx AS (SELECT project, pattern, rtrim(pattern, '/') AS p, {_glob("rtrim(pattern, '/')")} AS g FROM rules),
has_rules AS (SELECT DISTINCT project FROM rules),
ft AS (SELECT project, path, content, {_approx('content')} AS tokens, string_split(path, '/') AS parts,
              regexp_extract(string_split(path, '/')[-1], '.(\\.[^.]+)$', 1) AS sfx FROM v_files),
hits AS (SELECT DISTINCT ft.project, ft.path FROM ft JOIN rx ON ft.project = rx.project
         WHERE list_contains(ft.parts, rx.p) OR regexp_full_match(ft.path, rx.g)
            OR len(list_filter(ft.parts, lambda x: regexp_full_match(x, rx.g))) > 0),
flags AS (SELECT ft.project, ft.path, ft.content, ft.tokens, ft.parts,
                 lower(ft.sfx) IN {tuple(BINARY_SUFFIXES)} AS is_binary,
                 h.project IS NOT NULL AS has_rules,
                 hi.path IS NOT NULL AS rule_ignored,
                 list_has_any(ft.parts, {_lst(DEFAULT_IGNORE_DIRS)}) AS in_default,
                 len(list_filter(ft.parts, lambda x: ends_with(x, '.egg-info'))) > 0 AS egg
          FROM ft LEFT JOIN has_rules h ON ft.project = h.project
                  LEFT JOIN hits hi ON ft.project = hi.project AND ft.path = hi.path),
sets AS (SELECT *, NOT is_binary AND NOT list_has_any(parts, {_lst(BASELINE_SKIP_DIRS)}) AS in_baseline,
                NOT is_binary AND CASE WHEN has_rules THEN NOT rule_ignored ELSE NOT (in_default OR egg) END AS in_optimized,
                NOT is_binary AND CASE WHEN has_rules THEN NOT rule_ignored ELSE NOT in_default END AS in_focus,
                NOT is_binary AND NOT in_default AND NOT (has_rules AND rule_ignored) AS in_slim
         FROM flags)
"""


def corpus_sql(body: str) -> str:
    return duckdb_with(["v_files", "v_rules_files"]) + "," + _RULES + body


ORACLE["ignore_rules"] = duckdb_with(["v_rules_files"]) + """,
rl AS (SELECT project, unnest(generate_series(1, len(string_split(content, chr(10))))) AS ord,
              unnest(string_split(content, chr(10))) AS line FROM v_rules_files)
SELECT project, CAST(ord AS BIGINT) AS ord, trim(line) AS pattern FROM rl
WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')
"""

ORACLE["word_tokens"] = f"""
SELECT doc_id, CAST(len({_words('text')}) AS BIGINT) AS n_words,
       CAST(len(list_distinct({_words('text')})) AS BIGINT) AS n_distinct,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
       {_approx('text')} AS approx_tokens
FROM documents
"""

def _short(x: str) -> str:
    return (f"CASE WHEN {x} >= 1000000 THEN format('{{:.2f}}M', ({x}) / 1000000.0) WHEN {x} >= 1000 THEN "
            f"CAST((({x}) + 50) // 1000 AS VARCHAR) || '.' || CAST((({x}) + 50) // 100 % 10 AS VARCHAR) || 'k' "
            f"ELSE CAST({x} AS VARCHAR) END")


ORACLE["size_labels"] = f"""
SELECT doc_id, {_short('n_chars')} AS chars, {_short('(n_chars * 997 + 13)')} AS scaled,
       CASE WHEN length(text) > 0 THEN round((1 - length(replace(text, ' ', '')) / length(text)) * 100.0, 1) ELSE 0.0 END AS blank_pct
FROM documents
"""

ORACLE["file_flags"] = corpus_sql("""
SELECT project, path, tokens, is_binary,
       list_has_any(parts, ['.venv', 'venv', '__pycache__', '.git', 'node_modules', 'dist', 'build', '.egg-info',
                            '.pytest_cache', '.mypy_cache']) AS in_parse_dirs,
       list_has_any(parts, ['tests', 'test', 'test-project']) AS is_test,
       has_rules, rule_ignored, in_baseline, in_optimized
FROM sets
""")

ORACLE["token_budget"] = corpus_sql("""
SELECT project, baseline, optimized, baseline - optimized AS saved,
       round(CASE WHEN baseline > 0 THEN (baseline - optimized) / baseline * 100.0 ELSE 0.0 END, 1) AS savings_pct
FROM (SELECT project, CAST(sum(CASE WHEN in_baseline THEN tokens ELSE 0 END) AS BIGINT) AS baseline,
             CAST(sum(CASE WHEN in_optimized THEN tokens ELSE 0 END) AS BIGINT) AS optimized
      FROM sets GROUP BY project) t
""")

_SLIM = """,
slim AS (SELECT project, path, tokens, parts FROM sets WHERE in_slim),
bydir AS (SELECT project, parts[1] AS top, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files
          FROM slim WHERE len(parts) > 1 GROUP BY project, parts[1]),
byext AS (SELECT project, ext, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS files FROM
            (SELECT project, tokens, CASE WHEN contains(path, '.') THEN '.' || string_split(path, '.')[-1] ELSE '' END AS ext
             FROM slim) s
          WHERE ext <> '' AND ext NOT IN ('.py', '.ts', '.js', '.go', '.rs', '.md') GROUP BY project, ext)
"""

ORACLE["tokens_by_dir"] = corpus_sql(_SLIM + "SELECT project, top, tokens, files FROM bydir")
ORACLE["tokens_by_ext"] = corpus_sql(_SLIM + "SELECT project, ext, tokens, files FROM byext")

_CLASSIFY = """CASE WHEN lower(top) IN ('docs', 'doc', 'documentation') THEN 'Documentation rarely needed during coding'
     WHEN lower(top) IN ('examples', 'example', 'samples', 'demo', 'demos') THEN 'Example files add noise without context value'
     WHEN lower(top) IN ('migrations', 'alembic') THEN 'DB migration history not needed in context'
     WHEN lower(top) IN ('static', 'assets', 'public', 'media') THEN 'Static assets are not source code'
     WHEN lower(top) IN ('coverage', 'htmlcov', 'reports') THEN 'Test reports are generated output'
     WHEN lower(top) IN ('vendor', 'third_party', 'third-party') THEN 'Vendored dependencies should be excluded'
     WHEN lower(top) IN ('node_modules', 'bower_components') THEN 'JS dependency tree — exclude entirely'
     WHEN lower(top) IN ('dist', 'build', 'out', 'output') THEN 'Build output is not source'
     WHEN lower(top) IN ('logs', 'log') THEN 'Log files are runtime output'
     ELSE '''' || top || '/'' directory — check if needed in context' END"""

_SUGGEST = _SLIM + f""",
dcand AS (SELECT project, top || '/' AS pattern, tokens AS saves_tokens, files AS files_affected,
                 {_CLASSIFY} AS reason, 0 AS kind
          FROM bydir WHERE NOT starts_with(top, '.') AND top NOT IN ('src', 'app', 'lib', 'core', 'tests', 'test')
                       AND tokens >= 500
                       AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.project = bydir.project AND r.pattern = bydir.top || '/')),
ecand AS (SELECT project, '*' || ext AS pattern, tokens AS saves_tokens, files AS files_affected,
                 ext || ' files rarely useful in context' AS reason, 1 AS kind
          FROM byext WHERE tokens >= 300 AND ext IN ('.lock', '.log', '.json', '.txt', '.csv', '.svg', '.html', '.css')
                       AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.project = byext.project AND r.pattern = '*' || byext.ext)),
top20 AS (SELECT * FROM (SELECT project, path, tokens,
                                row_number() OVER (PARTITION BY project ORDER BY tokens DESC, path) AS rn FROM slim) t
          WHERE rn <= 20),
fel AS (SELECT * FROM top20 t WHERE tokens > 3000
          AND NOT (starts_with(path, 'src/') OR starts_with(path, 'lib/') OR starts_with(path, 'app/') OR starts_with(path, 'core/'))
          AND NOT EXISTS (SELECT 1 FROM dcand c WHERE c.project = t.project AND contains(t.path, c.pattern))
          AND NOT EXISTS (SELECT 1 FROM ecand c WHERE c.project = t.project AND contains(t.path, c.pattern))),
fcand AS (SELECT project, path AS pattern, tokens AS saves_tokens, CAST(1 AS BIGINT) AS files_affected,
                 'Large file (' || format('{{:,}}', tokens) || ' tokens)' AS reason, 2 AS kind
          FROM fel a WHERE NOT EXISTS (SELECT 1 FROM fel b WHERE b.project = a.project AND b.rn < a.rn
                                                                AND contains(a.path, b.path))),
cands AS (SELECT * FROM dcand UNION ALL SELECT * FROM ecand UNION ALL SELECT * FROM fcand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY saves_tokens DESC, kind, pattern) AS rank FROM cands)
"""

ORACLE["suggest_rules"] = corpus_sql(_SUGGEST + """
SELECT project, CAST(rank AS BIGINT) AS rank, pattern, CAST(saves_tokens AS BIGINT) AS saves_tokens,
       CAST(files_affected AS BIGINT) AS files_affected, reason
FROM ranked WHERE rank <= 10
""")

ORACLE["slim_report"] = corpus_sql(_SUGGEST + """,
cur AS (SELECT project, CAST(sum(CASE WHEN in_optimized THEN tokens ELSE 0 END) AS BIGINT) AS current_tokens
        FROM sets GROUP BY project),
sg AS (SELECT project, CAST(sum(saves_tokens) AS BIGINT) AS cumulative, count(*) AS n FROM ranked WHERE rank <= 10
       GROUP BY project)
SELECT c.project, c.current_tokens, CAST(20000 AS BIGINT) AS budget, c.current_tokens > 20000 AS over_budget,
       CAST(coalesce(sg.n, 0) AS BIGINT) AS n_suggestions,
       CAST(least(coalesce(sg.cumulative, 0), c.current_tokens) AS BIGINT) AS potential_savings,
       CAST(c.current_tokens - least(coalesce(sg.cumulative, 0), c.current_tokens) AS BIGINT) AS tokens_after,
       CASE WHEN c.current_tokens > 0
            THEN round(least(coalesce(sg.cumulative, 0), c.current_tokens) / c.current_tokens * 100.0, 1)
            ELSE 0.0 END AS reduction_pct
FROM cur c LEFT JOIN sg ON c.project = sg.project
""")

ORACLE["excluded_files"] = corpus_sql("""
, ex AS (SELECT project, path, tokens FROM sets WHERE in_baseline AND NOT in_optimized),
tot AS (SELECT project, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS t FROM ex GROUP BY project),
rk AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY tokens DESC, path) AS rank FROM ex)
SELECT rk.project, CAST(rank AS BIGINT) AS rank, path, tokens, CAST(n AS BIGINT) AS excluded_files,
       t AS excluded_tokens, CAST(greatest(n - 8, 0) AS BIGINT) AS more_files
FROM rk JOIN tot ON rk.project = tot.project WHERE rank <= 8
""")

ORACLE["token_distribution"] = corpus_sql("""
, inc AS (SELECT project, path, tokens FROM sets WHERE in_optimized),
tot AS (SELECT project, sum(tokens) AS t FROM inc GROUP BY project)
SELECT inc.project, path, tokens, row_number() OVER (PARTITION BY inc.project ORDER BY tokens DESC, path) AS rank,
       round(CASE WHEN t > 0 THEN tokens / t * 100.0 ELSE 0.0 END, 1) AS pct,
       CASE WHEN t > 0 AND tokens / t * 100.0 > 20 THEN 'high' WHEN t > 0 AND tokens / t * 100.0 > 5 THEN 'medium'
            ELSE 'low' END AS band
FROM inc JOIN tot ON inc.project = tot.project
""")

ORACLE["rank_files"] = corpus_sql("""
, kw(k) AS (VALUES ('and'), ('docs'), ('examples'), ('the'), ('update'), ('vendor')),
vis AS (SELECT project, path, content FROM sets WHERE in_focus),
ct AS (SELECT project, path, unnest(""" + _words("content") + """) AS t FROM vis),
ntok AS (SELECT project, path, count(*) AS n FROM ct GROUP BY project, path),
cf AS (SELECT project, path, k, count(*) AS c FROM ct JOIN kw ON ct.t = kw.k GROUP BY project, path, k),
pt AS (SELECT project, path, unnest(""" + _words("path") + """) AS t FROM vis),
pm AS (SELECT DISTINCT project, path, k FROM pt JOIN kw ON contains(pt.t, kw.k)),
per AS (SELECT v.project, v.path, kw.k,
               CASE WHEN pm.k IS NOT NULL THEN 3.0 ELSE 0.0 END
               + CASE WHEN cf.c > 0 THEN 1.0 + least(cf.c - 1, 4) * 0.2 ELSE 0.0 END AS s
        FROM vis v CROSS JOIN kw
        LEFT JOIN pm ON pm.project = v.project AND pm.path = v.path AND pm.k = kw.k
        LEFT JOIN cf ON cf.project = v.project AND cf.path = v.path AND cf.k = kw.k),
sc AS (SELECT per.project, per.path, sum(s) / greatest(1.0, coalesce(max(ntok.n), 0) / 500.0) AS raw
       FROM per LEFT JOIN ntok ON ntok.project = per.project AND ntok.path = per.path
       GROUP BY per.project, per.path),
hit AS (SELECT sc.project, sc.path, round(raw, 2) AS score FROM sc WHERE raw > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, path) AS rank FROM hit),
rs AS (SELECT v.project, v.path,
              list_sort(list(CASE WHEN contains(lower(v.path), kw.k) THEN kw.k END)) AS inp,
              list_sort(list(CASE WHEN contains(lower(v.content), kw.k) THEN kw.k END)) AS inc
       FROM vis v CROSS JOIN kw GROUP BY v.project, v.path)
SELECT rk.project, CAST(rk.rank AS BIGINT) AS rank, rk.path, rk.score, """ + _approx("v.content") + """ AS tokens,
       concat_ws(' | ', CASE WHEN len(rs.inp) > 0 THEN 'path:' || array_to_string(rs.inp, ',') END,
                        CASE WHEN len(rs.inc) > 0 THEN 'content:' || array_to_string(rs.inc[1:5], ',') END) AS reason
FROM rk JOIN vis v ON v.project = rk.project AND v.path = rk.path
JOIN rs ON rs.project = rk.project AND rs.path = rk.path
WHERE rk.rank <= 8
""")


# ------------------------------------------------------------------ V_code
# Expected facts come from the template parameters, not from parsing.
_CODE = """,
cp AS (SELECT *, dir || '/m' || CAST(k AS STRING) || CASE lang_id WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS path
       FROM v_code_params),
lines AS (SELECT project, path, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS lines
          FROM v_code),
pyx AS (SELECT cp.project, cp.path, l.lines,
               'fn_' || k || '_0' || CASE WHEN nf >= 2 THEN ',fn_' || k || '_1' ELSE '' END
               || CASE WHEN nf >= 3 THEN ',fn_' || k || '_2' ELSE '' END || CASE WHEN nf >= 4 THEN ',fn_' || k || '_3' ELSE '' END
               || CASE WHEN k % 2 = 0 THEN ',describe' ELSE '' END AS functions,
               'Model' || k || 'X' AS classes,
               'os' || CASE WHEN nxt IS NOT NULL THEN ',pkg.m' || nxt ELSE '' END || ',' || fw
               || CASE WHEN k % 4 = 1 THEN ',pkg' ELSE '' END
               || CASE WHEN k % 5 = 0 AND prv2 IS NOT NULL THEN ',pkg.m' || prv2 ELSE '' END
               || CASE WHEN k % 11 = 0 THEN ',pkg.m' || k ELSE '' END AS imports,
               CAST(n_if + 2 AS BIGINT) AS complexity,
               CAST(1 + CASE WHEN nf >= 3 THEN 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS typed_functions,
               k % 50 = 0 AS has_syntax_error
        FROM cp JOIN lines l ON l.project = cp.project AND l.path = cp.path
        WHERE lang_id = 0 AND dir <> 'build'
        UNION ALL
        SELECT project, path, lines, '', '', '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), false
        FROM lines WHERE path = 'pkg/__init__.py'),
tsx AS (SELECT cp.project, cp.path, l.lines,
               'fn_' || k || '_0' || CASE WHEN nf >= 2 THEN ',fn_' || k || '_1' ELSE '' END AS functions,
               'Model' || k || 'X' AS classes, tsfw || ',' || tsfw || '-extra' AS imports,
               CAST(n_if + 1 + CASE WHEN nf >= 2 THEN 1 ELSE 0 END AS BIGINT) AS complexity,
               CAST(1 AS BIGINT) AS typed_functions, false AS has_syntax_error
        FROM cp JOIN lines l ON l.project = cp.project AND l.path = cp.path WHERE lang_id = 1 AND dir <> 'build'),
gox AS (SELECT cp.project, cp.path, l.lines, 'Describe,Fn' || k || 'Run' AS functions, 'Model' || k || 'X' AS classes,
               CASE WHEN k % 4 = 3 THEN 'fmt,signal' ELSE 'fmt,http,' || gofw END AS imports,
               CAST(n_if + 3 AS BIGINT) AS complexity, CAST(2 AS BIGINT) AS typed_functions, false AS has_syntax_error
        FROM cp JOIN lines l ON l.project = cp.project AND l.path = cp.path WHERE lang_id = 2 AND dir <> 'build'),
nodes AS (SELECT project, path FROM pyx),
pyfile AS (SELECT project, k, path FROM cp WHERE lang_id = 0 AND dir = 'pkg'),
eraw AS (SELECT cp.project, cp.path AS src, t.path AS dst FROM cp JOIN pyfile t ON t.project = cp.project AND t.k = cp.nxt
         WHERE cp.lang_id = 0 AND cp.dir <> 'build'
         UNION ALL SELECT cp.project, cp.path, t.path FROM cp JOIN pyfile t ON t.project = cp.project AND t.k = cp.prv2
         WHERE cp.lang_id = 0 AND cp.dir <> 'build' AND cp.k % 5 = 0
         UNION ALL SELECT cp.project, cp.path, t.path FROM cp JOIN pyfile t ON t.project = cp.project AND t.k = cp.k
         WHERE cp.lang_id = 0 AND cp.dir <> 'build' AND cp.k % 11 = 0
         UNION ALL SELECT project, path, 'pkg/__init__.py' FROM cp WHERE lang_id = 0 AND dir <> 'build' AND k % 4 = 1),
edges AS (SELECT DISTINCT project, src, dst FROM eraw),
indeg AS (SELECT n.project, n.path, CAST(count(e.src) AS BIGINT) AS imported_by
          FROM nodes n LEFT JOIN edges e ON e.project = n.project AND e.dst = n.path GROUP BY n.project, n.path)
"""


def code_sql(body: str, extra_views=()) -> str:
    return duckdb_with(["v_code", "v_code_params", *extra_views]) + _CODE + body


ORACLE["extract_python_facts"] = code_sql("SELECT * FROM pyx")
ORACLE["extract_ts_facts"] = code_sql("SELECT * FROM tsx")
ORACLE["extract_go_facts"] = code_sql("SELECT * FROM gox")
ORACLE["detect_languages"] = code_sql("""
SELECT project, 'python' || CASE WHEN bool_or(lang_id = 2) THEN ',go' ELSE '' END
                         || CASE WHEN bool_or(lang_id = 1) THEN ',typescript' ELSE '' END AS languages
FROM (SELECT project, lang_id FROM cp UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 0 FROM nation) t
GROUP BY project
""")
ORACLE["import_edges"] = code_sql("SELECT project, src, dst FROM edges")
ORACLE["in_degree"] = code_sql("SELECT * FROM indeg")
ORACLE["most_imported"] = code_sql("""
SELECT project, path, imported_by, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY imported_by DESC, path) AS BIGINT) AS rank
  FROM indeg WHERE imported_by > 0) t WHERE rank <= 10
""")

# Simple cycles by a recursive walk from each cycle's smallest node.
_CYCLES = """,
walk AS (WITH RECURSIVE w(project, start, cur, path, depth) AS (
           SELECT project, src, dst, [src, dst], 2 FROM {e} WHERE dst > src
           UNION ALL
           SELECT w.project, w.start, x.dst, list_append(w.path, x.dst), w.depth + 1
           FROM w JOIN {e} x ON x.project = w.project AND x.src = w.cur
           WHERE x.dst > w.start AND NOT list_contains(w.path, x.dst))
         SELECT * FROM w),
cycles AS (SELECT w.project, CAST(w.depth AS BIGINT) AS cycle_len,
                  array_to_string(list_append(w.path, w.start), ' -> ') AS chain
           FROM walk w JOIN {e} x ON x.project = w.project AND x.src = w.cur AND x.dst = w.start
           UNION ALL
           SELECT project, CAST(1 AS BIGINT), src || ' -> ' || src FROM {e} WHERE src = dst)
"""

ORACLE["find_cycles"] = duckdb_with(["v_transitions"]) + _CYCLES.format(e="v_transitions") + "SELECT *, false AS truncated FROM cycles"
ORACLE["code_cycles"] = code_sql(_CYCLES.format(e="edges") + "SELECT *, false AS truncated FROM cycles")
ORACLE["cycle_count"] = code_sql(_CYCLES.format(e="edges") + """
SELECT p.project, CAST(count(c.chain) AS BIGINT) AS n_cycles
FROM (SELECT DISTINCT project FROM nodes) p LEFT JOIN cycles c ON c.project = p.project GROUP BY p.project
""")
ORACLE["cycle_members"] = code_sql(_CYCLES.format(e="edges") + """
SELECT DISTINCT project, unnest(string_split(chain, ' -> ')) AS path FROM cycles
""")

# Components by the transitive closure; surplus edges give the least number of cycles.
_PROOF = """,
reach AS (WITH RECURSIVE r(project, a, b) AS (
            SELECT project, src, dst FROM edges UNION SELECT r.project, r.a, x.dst FROM r JOIN edges x ON x.project = r.project AND x.src = r.b)
          SELECT * FROM r),
comp AS (SELECT f.project, f.a AS path, min(f.b) AS component FROM reach f JOIN reach g
           ON g.project = f.project AND g.a = f.b AND g.b = f.a
         GROUP BY f.project, f.a HAVING count(*) > 1),
least AS (SELECT p.project,
                 (SELECT count(*) FROM edges x JOIN comp c ON c.project = x.project AND c.path = x.src
                    JOIN comp d ON d.project = x.project AND d.path = x.dst AND d.component = c.component
                  WHERE x.project = p.project AND x.src <> x.dst)
                 - (SELECT count(*) - count(DISTINCT component) FROM comp c WHERE c.project = p.project)
                 + (SELECT count(*) FROM edges x WHERE x.project = p.project AND x.src = x.dst) AS least
          FROM (SELECT DISTINCT project FROM nodes) p),
proof AS (SELECT l.project, CASE WHEN least >= 4 THEN least
                              ELSE (SELECT count(*) FROM cycles c WHERE c.project = l.project) END::BIGINT AS n_cycles, least < 4 AS exact
          FROM least l)
"""
ORACLE["strong_components"] = code_sql(_CYCLES.format(e="edges") + _PROOF + "SELECT project, path, component FROM comp")
ORACLE["cycle_proof"] = code_sql(_CYCLES.format(e="edges") + _PROOF + "SELECT * FROM proof")
ORACLE["related_files"] = code_sql(""",
nb AS (SELECT project, src AS path, dst AS file, 'imports' AS relation, 0 AS o FROM edges
       UNION ALL SELECT project, dst, src, 'imported_by', 1 FROM edges)
SELECT t.project, t.path, t.imported_by,
       coalesce(string_agg(nb.file || ':' || nb.relation, ';' ORDER BY nb.o, nb.file, nb.relation), '') AS related
FROM indeg t LEFT JOIN nb ON nb.project = t.project AND nb.path = t.path
GROUP BY t.project, t.path, t.imported_by
""")

_CODE_RANK = ORACLE["rank_files"].split(", kw(k) AS", 1)[1]
for _old, _new in (("(VALUES ('and'), ('docs'), ('examples'), ('the'), ('update'), ('vendor'))",
                    "(VALUES ('and'), ('command'), ('describe'), ('fastapi'), ('flask'), ('its'), ('model'), ('the'))"),
                   ("SELECT project, path, content FROM sets WHERE in_focus",
                    f"SELECT project, path, content FROM v_code WHERE NOT list_has_any(string_split(path, '/'), {_lst(DEFAULT_IGNORE_DIRS)})"),
                   ("SELECT rk.project, CAST(rk.rank AS BIGINT) AS rank", ", fr AS (SELECT rk.project, CAST(rk.rank AS BIGINT) AS rank")):
    assert _old in _CODE_RANK
    _CODE_RANK = _CODE_RANK.replace(_old, _new, 1)
ORACLE["focus_context"] = code_sql(", kw(k) AS" + _CODE_RANK + """),
nb AS (SELECT project, src AS path, dst AS file, 'imports' AS relation, 0 AS o FROM edges
       UNION ALL SELECT project, dst, src, 'imported_by', 1 FROM edges)
SELECT fr.*, coalesce((SELECT string_agg(nb.file || ':' || nb.relation, ';' ORDER BY nb.o, nb.file, nb.relation) FROM nb
                       WHERE nb.project = fr.project AND nb.path = fr.path), '') AS related
FROM fr
""")


# ------------------------------------------------------------------ sessions
from tokenloom.functions.scores import PRICE_CACHE_READ, PRICE_CACHE_WRITE, PRICE_INPUT, PRICE_OUTPUT  # noqa: E402


def _cost(i, o, w, r) -> str:
    return (f"round({i} * {PRICE_INPUT!r} + {o} * {PRICE_OUTPUT!r} + {w} * {PRICE_CACHE_WRITE!r}"
            f" + {r} * {PRICE_CACHE_READ!r}, 5)")


_SESS = f""",
pj AS (SELECT project, session_id, line_no, raw, mtime_s, json_valid(raw) AS ok FROM v_sessions),
ev AS (SELECT project, session_id, line_no,
              CASE WHEN ok THEN json_extract_string(raw, '$.type') END AS type,
              coalesce(CASE WHEN ok THEN json_extract_string(raw, '$.uuid') END, '') AS uuid,
              CASE WHEN ok THEN json_extract(raw, '$.message.usage') END AS usage
       FROM pj),
asst AS (SELECT * FROM ev WHERE type = 'assistant'),
ded AS (SELECT project, session_id, line_no, uuid, usage FROM
          (SELECT *, row_number() OVER (PARTITION BY project, session_id, uuid ORDER BY line_no) AS rn FROM asst WHERE uuid <> '') t
        WHERE rn = 1
        UNION ALL SELECT project, session_id, line_no, uuid, usage FROM asst WHERE uuid = ''),
dedc AS (SELECT project, session_id, line_no, uuid,
                usage IS NOT NULL AND json_type(usage) = 'OBJECT' AND CAST(usage AS VARCHAR) <> '{{}}' AS has_usage,
                coalesce(TRY_CAST(json_extract_string(usage, '$.input_tokens') AS BIGINT), 0) AS input_tokens,
                coalesce(TRY_CAST(json_extract_string(usage, '$.output_tokens') AS BIGINT), 0) AS output_tokens,
                coalesce(TRY_CAST(json_extract_string(usage, '$.cache_creation_input_tokens') AS BIGINT), 0) AS cache_write,
                coalesce(TRY_CAST(json_extract_string(usage, '$.cache_read_input_tokens') AS BIGINT), 0) AS cache_read
         FROM ded),
sess AS (SELECT project, session_id, max(mtime_s) AS mtime_s FROM v_sessions GROUP BY project, session_id),
sums AS (SELECT project, session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
                CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(cache_read) AS BIGINT) AS cache_read,
                count(*) AS turns
         FROM dedc WHERE has_usage GROUP BY project, session_id),
usage_t AS (SELECT s.session_id, substr(s.session_id, 1, 8) AS short_id, s.project, s.mtime_s,
                   coalesce(u.input_tokens, 0) AS input_tokens, coalesce(u.output_tokens, 0) AS output_tokens,
                   coalesce(u.cache_write, 0) AS cache_write, coalesce(u.cache_read, 0) AS cache_read,
                   CAST(coalesce(u.input_tokens, 0) + coalesce(u.output_tokens, 0) AS BIGINT) AS total_tokens,
                   CAST(coalesce(u.turns, 0) AS BIGINT) AS turns,
                   {_cost('coalesce(u.input_tokens, 0)', 'coalesce(u.output_tokens, 0)', 'coalesce(u.cache_write, 0)',
                          'coalesce(u.cache_read, 0)')} AS cost_usd
            FROM sess s LEFT JOIN sums u ON u.project = s.project AND u.session_id = s.session_id)
"""

ORACLE["session_usage"] = duckdb_with(["v_sessions"]) + _SESS + "SELECT * FROM usage_t"
ORACLE["dedupe_events"] = duckdb_with(["v_sessions"]) + _SESS + """
SELECT project, session_id, CAST(line_no AS BIGINT) AS line_no, uuid, has_usage, input_tokens, output_tokens, cache_write, cache_read
FROM dedc"""
ORACLE["recent_sessions"] = duckdb_with(["v_sessions"]) + _SESS + f"""
SELECT * FROM usage_t WHERE mtime_s > {1704067200 + 120 * 3600} - 48 * 3600 ORDER BY mtime_s DESC, session_id LIMIT 10"""
ORACLE["compare_sessions"] = duckdb_with(["v_sessions"]) + _SESS + """,
a AS (SELECT * FROM usage_t WHERE starts_with(session_id, 'c1') ORDER BY mtime_s DESC, session_id DESC LIMIT 1),
b AS (SELECT * FROM usage_t WHERE starts_with(session_id, 'c2') ORDER BY mtime_s DESC, session_id DESC LIMIT 1),
la AS (UNPIVOT (SELECT session_id, CAST(input_tokens AS DOUBLE) AS input_tokens, CAST(output_tokens AS DOUBLE) AS output_tokens,
                       CAST(cache_write AS DOUBLE) AS cache_write, CAST(cache_read AS DOUBLE) AS cache_read,
                       CAST(total_tokens AS DOUBLE) AS total_tokens, CAST(turns AS DOUBLE) AS turns, cost_usd FROM a)
       ON input_tokens, output_tokens, cache_write, cache_read, total_tokens, turns, cost_usd INTO NAME metric VALUE v),
lb AS (UNPIVOT (SELECT session_id, CAST(input_tokens AS DOUBLE) AS input_tokens, CAST(output_tokens AS DOUBLE) AS output_tokens,
                       CAST(cache_write AS DOUBLE) AS cache_write, CAST(cache_read AS DOUBLE) AS cache_read,
                       CAST(total_tokens AS DOUBLE) AS total_tokens, CAST(turns AS DOUBLE) AS turns, cost_usd FROM b)
       ON input_tokens, output_tokens, cache_write, cache_read, total_tokens, turns, cost_usd INTO NAME metric VALUE v)
SELECT coalesce(la.metric, lb.metric) AS metric, la.session_id AS a_session, lb.session_id AS b_session,
       la.v AS a, lb.v AS b, round(lb.v - la.v, 5) AS diff
FROM la FULL JOIN lb ON la.metric = lb.metric
"""
ORACLE["session_delta"] = duckdb_with(["v_sessions"]) + _SESS + f""",
prev AS (SELECT project, session_id, CAST(sum(input_tokens) AS BIGINT) AS pi, CAST(sum(output_tokens) AS BIGINT) AS po,
                CAST(sum(cache_write) AS BIGINT) AS pw, CAST(sum(cache_read) AS BIGINT) AS pr
         FROM dedc WHERE has_usage AND line_no <= 3 GROUP BY project, session_id),
prev_s AS (SELECT DISTINCT project, session_id FROM v_sessions WHERE line_no <= 3 AND regexp_matches(project, '[024]$'))
SELECT u.project, u.session_id,
       CAST(CASE WHEN ps.session_id IS NULL THEN 0 ELSE u.input_tokens - coalesce(p.pi, 0) END AS BIGINT) AS delta_input,
       CAST(CASE WHEN ps.session_id IS NULL THEN 0 ELSE u.output_tokens - coalesce(p.po, 0) END AS BIGINT) AS delta_output,
       CAST(CASE WHEN ps.session_id IS NULL THEN 0 ELSE u.cache_write - coalesce(p.pw, 0) END AS BIGINT) AS delta_cache_w,
       CAST(CASE WHEN ps.session_id IS NULL THEN 0 ELSE u.cache_read - coalesce(p.pr, 0) END AS BIGINT) AS delta_cache_r,
       CASE WHEN ps.session_id IS NULL THEN 0.0 ELSE
            {_cost('(u.input_tokens - coalesce(p.pi, 0))', '(u.output_tokens - coalesce(p.po, 0))',
                   '(u.cache_write - coalesce(p.pw, 0))', '(u.cache_read - coalesce(p.pr, 0))')} END AS delta_cost
FROM usage_t u LEFT JOIN prev_s ps ON ps.project = u.project AND ps.session_id = u.session_id
LEFT JOIN prev p ON p.project = u.project AND p.session_id = u.session_id
"""

# ------------------------------------------------------------------- history
_HOT = """
SELECT project, path, changes, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY changes DESC, path) AS BIGINT) AS rank FROM (
    SELECT project, path, CAST(count(*) AS BIGINT) AS changes FROM (
      SELECT project, a_path AS path FROM {t} WHERE commit_seq <= {n} AND has_parent AND ends_with(a_path, '.py')
      UNION ALL
      SELECT project, b_path FROM {t} WHERE commit_seq <= {n} AND has_parent AND b_path <> a_path AND ends_with(b_path, '.py')
    ) x GROUP BY project, path) c) r
WHERE rank <= 20
"""
ORACLE["hot_files"] = duckdb_with(["v_changes"]) + _HOT.format(t="v_changes", n=500)
ORACLE["file_overview"] = code_sql(""",
hot AS (""" + _HOT.format(t="v_code_changes", n=50) + """),
cnt AS (SELECT cp.project, cp.path, CAST(nf + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS functions,
               CAST(1 AS BIGINT) AS classes,
               CAST(3 + CASE WHEN nxt IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END
                      + CASE WHEN k % 5 = 0 AND prv2 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END
                      - 1 AS BIGINT) AS imports
        FROM cp WHERE lang_id = 0 AND dir <> 'build'
        UNION ALL SELECT project, path, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM lines
        WHERE path = 'pkg/__init__.py')
SELECT x.project, x.path, x.lines, c.functions, c.classes, c.imports, i.imported_by, h.path IS NOT NULL AS hot
FROM pyx x JOIN cnt c ON c.project = x.project AND c.path = x.path
JOIN indeg i ON i.project = x.project AND i.path = x.path
LEFT JOIN hot h ON h.project = x.project AND h.path = x.path
""", extra_views=("v_code_changes",))

# -------------------------------------------------------------------- ranges
_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_DIFF = rf""",
d1 AS (SELECT project, diff_id, line_no, line,
              CASE WHEN regexp_matches(line, '^diff --git a/(.+?) b/(.+)$')
                   THEN regexp_extract(line, '^diff --git a/(.+?) b/(.+)$', 2) END AS hdr FROM v_diff),
d2 AS (SELECT *, last_value(hdr IGNORE NULLS) OVER (PARTITION BY project, diff_id ORDER BY line_no
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file,
              count(hdr) OVER (PARTITION BY project, diff_id ORDER BY line_no
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM d1),
hk AS (SELECT project, diff_id, file, block, line_no,
              CAST(regexp_extract(line, '{_HUNK}', 3) AS BIGINT) AS st,
              CASE WHEN regexp_extract(line, '{_HUNK}', 4) = '' THEN 1
                   ELSE CAST(regexp_extract(line, '{_HUNK}', 4) AS BIGINT) END AS ln
       FROM d2 WHERE file IS NOT NULL AND regexp_matches(line, '{_HUNK}')),
hk2 AS (SELECT project, diff_id, file AS path, line_no, st AS start_line, st + greatest(ln, 1) - 1 AS end_line
        FROM hk WHERE (project, diff_id, file, block) IN (SELECT project, diff_id, file, max(block) FROM hk GROUP BY ALL))
"""
ORACLE["hunk_ranges"] = duckdb_with(["v_diff"]) + _DIFF + """
SELECT project, diff_id, path, CAST(line_no AS BIGINT) AS line_no, start_line, end_line FROM hk2"""


def _islands(src: str, keys: str, pad: int) -> str:
    return f"""
p AS (SELECT {keys}, greatest(start_line - {pad}, 1) AS s, end_line + {pad} AS e FROM {src}),
f AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                          IS NULL OR s > max(e) OVER (PARTITION BY {keys} ORDER BY s, e
                                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                     THEN 1 ELSE 0 END AS new FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
      FROM f)
SELECT {keys}, CAST(min(s) AS BIGINT) AS start_line, CAST(max(e) AS BIGINT) AS end_line FROM g GROUP BY {keys}, island
"""


ORACLE["merge_ranges"] = duckdb_with(["v_ranges"]) + "," + _islands("v_ranges", "project, path", 30)
ORACLE["diff_context"] = (duckdb_with(["v_diff"]) + _DIFF + ", hpy AS (SELECT * FROM hk2 WHERE ends_with(path, '.py')),"
                          + _islands("hpy", "project, diff_id, path", 3))


# ----------------------------------------------------------------- dead code
# Brute force: a symbol is used when any other source file contains it.
_SKIP = ("'__init__', '__repr__', '__str__', '__eq__', '__hash__', '__len__', '__iter__', '__next__', '__enter__', "
         "'__exit__', '__call__', '__getitem__', '__setitem__', '__contains__', 'main', 'visit', 'callback', 'handler'")

_DEAD = f""",
src AS (SELECT v.project, v.path, v.content FROM v_code v JOIN pyx x ON x.project = v.project AND x.path = v.path
        WHERE NOT list_has_any(string_split(v.path, '/'), ['tests', 'test', 'test-project'])),
sdef AS (SELECT x.project, x.path, unnest(string_split(x.functions || CASE WHEN x.functions <> '' AND x.classes <> '' THEN ',' ELSE '' END
                                                       || x.classes, ',')) AS symbol
         FROM pyx x JOIN src s ON s.project = x.project AND s.path = x.path),
deco AS (SELECT project, path, 'fn_' || k || '_0' AS symbol FROM cp WHERE lang_id = 0 AND k % 7 = 0),
cand AS (SELECT DISTINCT d.project, d.path, d.symbol FROM sdef d JOIN src s ON s.project = d.project AND s.path = d.path
         WHERE d.symbol <> '' AND NOT starts_with(d.symbol, '_') AND d.symbol NOT IN ({_SKIP})
           AND (length(s.content) - length(replace(s.content, d.symbol, ''))) // length(d.symbol) <= 1
           AND NOT EXISTS (SELECT 1 FROM deco WHERE deco.project = d.project AND deco.path = d.path AND deco.symbol = d.symbol)),
unused AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM src o WHERE o.project = c.project AND o.path <> c.path
                                                   AND contains(o.content, c.symbol)))
"""
ORACLE["unused_symbols"] = code_sql(_DEAD + "SELECT project, path, symbol FROM unused")
ORACLE["unused_per_file"] = code_sql(_DEAD + """,
ordered AS (SELECT u.project, u.path, u.symbol,
                   list_position(string_split(x.functions || ',' || x.classes, ','), u.symbol) AS pos
            FROM unused u JOIN pyx x ON x.project = u.project AND x.path = u.path)
SELECT project, path, string_agg(symbol, ', ' ORDER BY pos) AS symbols, CAST(count(*) AS BIGINT) AS n_symbols
FROM ordered GROUP BY project, path
""")
ORACLE["framework_decorated"] = code_sql(""",
src AS (SELECT x.project, x.path FROM pyx x WHERE NOT list_has_any(string_split(x.path, '/'), ['tests', 'test', 'test-project']))
SELECT cp.project, cp.path, 'fn_' || cp.k || '_0' AS symbol FROM cp JOIN src ON src.project = cp.project AND src.path = cp.path
WHERE cp.lang_id = 0 AND cp.k % 7 = 0
""")

# ------------------------------------------------------ summaries and health
from tokenloom.operators.facts import FRAMEWORKS  # noqa: E402

_FW = "fw(import_root, framework) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in FRAMEWORKS) + ")"

_ALL = """,
allx AS (SELECT * FROM pyx UNION ALL SELECT * FROM tsx UNION ALL SELECT * FROM gox),
allc AS (SELECT *, CASE WHEN functions = '' THEN 0 ELSE len(string_split(functions, ',')) END AS nfn,
                CASE WHEN classes = '' THEN 0 ELSE len(string_split(classes, ',')) END AS ncl FROM allx),
""" + _FW + """,
roots AS (SELECT DISTINCT project, split_part(m, '.', 1) AS import_root FROM
            (SELECT project, unnest(string_split(imports, ',')) AS m FROM allx WHERE imports <> '') t),
fws AS (SELECT r.project, r.import_root, fw.framework FROM roots r JOIN fw ON fw.import_root = r.import_root)
"""

ORACLE["detect_frameworks"] = code_sql(_ALL + "SELECT * FROM fws")
ORACLE["project_totals"] = code_sql(_ALL + """,
langs AS (SELECT project, 'python' || CASE WHEN bool_or(lang_id = 2) THEN ',go' ELSE '' END
                          || CASE WHEN bool_or(lang_id = 1) THEN ',typescript' ELSE '' END AS languages
          FROM (SELECT project, lang_id FROM cp UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 0 FROM nation) t
          GROUP BY project),
fwl AS (SELECT project, string_agg(DISTINCT framework, ', ' ORDER BY framework) AS frameworks FROM fws GROUP BY project)
SELECT a.project, CAST(count(*) AS BIGINT) AS files, CAST(sum(lines) AS BIGINT) AS total_lines,
       CAST(sum(nfn) AS BIGINT) AS total_functions, CAST(sum(ncl) AS BIGINT) AS total_classes,
       CAST(sum(typed_functions) AS BIGINT) AS typed_functions, any_value(l.languages) AS languages,
       coalesce(any_value(f.frameworks), '') AS frameworks
FROM allc a LEFT JOIN langs l ON l.project = a.project LEFT JOIN fwl f ON f.project = a.project
GROUP BY a.project
""")
ORACLE["quality_summary"] = code_sql(_ALL + """
SELECT project, round(sum(complexity) / count(*), 1) AS avg_complexity,
       round(sum(typed_functions) / greatest(sum(nfn), 1) * 100.0, 1) AS type_coverage_pct
FROM allc GROUP BY project
""")
ORACLE["quality_table"] = code_sql(_ALL + """
SELECT project, path, complexity,
       round(CASE WHEN nfn > 0 THEN typed_functions / nfn * 100.0 ELSE 0.0 END, 1) AS type_coverage,
       CASE WHEN complexity <= 5 THEN 'A' WHEN complexity <= 10 THEN 'B' WHEN complexity <= 20 THEN 'C' ELSE 'D' END AS grade,
       row_number() OVER (PARTITION BY project ORDER BY complexity DESC, path) AS rank
FROM allc
""")
ORACLE["written_tables"] = "SELECT s.sink, t.* FROM (VALUES ('table'), ('json')) s(sink), (" + ORACLE["quality_table"] + ") t"
_SYNTAX = """,
bad AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path) AS rn FROM pyx WHERE has_syntax_error),
syn AS (SELECT project, CAST(count(*) AS BIGINT) AS n_errors,
               string_agg(CASE WHEN rn <= 5 THEN path END, ', ' ORDER BY path) AS first_files,
               CASE WHEN count(*) > 5 THEN ' (+' || CAST(count(*) - 5 AS STRING) || ' more)' ELSE '' END AS more
        FROM bad GROUP BY project)
"""
ORACLE["syntax_errors"] = code_sql(_SYNTAX + "SELECT * FROM syn")

_CODE_BUDGET = f""",
cbud AS (SELECT project, CAST(sum(t) AS BIGINT) AS baseline,
                CAST(sum(CASE WHEN NOT list_has_any(string_split(path, '/'), {_lst(DEFAULT_IGNORE_DIRS)}) THEN t ELSE 0 END) AS BIGINT)
                  AS optimized
         FROM (SELECT project, path, {_approx('content')} AS t FROM v_code) x GROUP BY project),
ccount AS (SELECT p.project, CAST(count(c.chain) AS BIGINT) AS n_cycles
           FROM (SELECT DISTINCT project FROM nodes) p LEFT JOIN cycles c ON c.project = p.project GROUP BY p.project)
"""

ORACLE["health_score"] = code_sql(_DEAD + _CYCLES.format(e="edges") + _CODE_BUDGET + """,
srcf AS (SELECT x.* FROM pyx x WHERE NOT list_has_any(string_split(x.path, '/'), ['tests', 'test', 'test-project'])),
q AS (SELECT project,
             CASE WHEN sum(CASE WHEN functions = '' THEN 0 ELSE len(string_split(functions, ',')) END) > 0
                  THEN sum(typed_functions) / sum(CASE WHEN functions = '' THEN 0 ELSE len(string_split(functions, ',')) END) * 100.0
                  ELSE 100.0 END AS type_coverage,
             greatest(0.0, 100.0 - sum(complexity) / sum(greatest(CASE WHEN functions = '' THEN 0
                                                         ELSE len(string_split(functions, ',')) END, 1)) * 10.0) AS complexity_score
      FROM srcf GROUP BY project),
parts AS (SELECT q.project,
                 least(greatest(CASE WHEN b.baseline > 0 THEN (b.baseline - b.optimized) / b.baseline * 100.0 ELSE 0.0 END, 0.0), 100.0)
                   AS token_savings,
                 q.type_coverage, q.complexity_score,
                 greatest(0.0, 100.0 - coalesce(d.n, 0) * 10.0) AS dead_code_score,
                 greatest(0.0, 100.0 - coalesce(c.n_cycles, 0) * 33.0) AS cycle_score
          FROM q LEFT JOIN cbud b ON b.project = q.project
          LEFT JOIN (SELECT project, count(DISTINCT path) AS n FROM unused GROUP BY project) d ON d.project = q.project
          LEFT JOIN ccount c ON c.project = q.project),
tot AS (SELECT *, token_savings * 0.3 + type_coverage * 0.25 + complexity_score * 0.2 + dead_code_score * 0.15
                  + cycle_score * 0.1 AS total FROM parts)
SELECT project, round(total, 1) AS total,
       CASE WHEN total >= 90 THEN 'A' WHEN total >= 75 THEN 'B' WHEN total >= 60 THEN 'C' ELSE 'D' END AS grade,
       round(token_savings, 1) AS token_savings, round(type_coverage, 1) AS type_coverage,
       round(complexity_score, 1) AS complexity_score, round(dead_code_score, 1) AS dead_code_score,
       round(cycle_score, 1) AS cycle_score
FROM tot
""")

ORACLE["audit_checks"] = code_sql(_CYCLES.format(e="edges") + _CODE_BUDGET + _SYNTAX + """,
projects AS (SELECT DISTINCT project FROM v_code),
doc AS (SELECT project, max(mtime_s) AS doc_s FROM v_code WHERE path = 'CONTEXT.md' GROUP BY project),
newest AS (SELECT project, max(mtime_s) AS py_s FROM v_code WHERE ends_with(path, '.py') GROUP BY project),
j AS (SELECT p.project, d.doc_s, n.py_s, b.baseline, b.optimized, coalesce(c.n_cycles, 0) AS n_cycles,
             coalesce(s.n_errors, 0) AS n_errors, s.first_files, s.more
      FROM projects p LEFT JOIN doc d ON d.project = p.project LEFT JOIN newest n ON n.project = p.project
      LEFT JOIN cbud b ON b.project = p.project LEFT JOIN ccount c ON c.project = p.project
      LEFT JOIN syn s ON s.project = p.project),
rows AS (
  SELECT project, 'config_doc' AS "check", CASE WHEN doc_s IS NOT NULL THEN 'ok' ELSE 'issue' END AS status,
         CASE WHEN doc_s IS NOT NULL THEN 'present' ELSE 'missing' END AS detail FROM j
  UNION ALL
  SELECT project, 'freshness', CASE WHEN py_s > doc_s THEN 'issue' ELSE 'ok' END,
         CASE WHEN py_s > doc_s THEN 'stale by ' || CAST((py_s - doc_s) // 60 AS STRING) || ' minutes' ELSE 'fresh' END
  FROM j WHERE doc_s IS NOT NULL
  UNION ALL
  SELECT project, 'token_budget', CASE WHEN optimized > 60000 THEN 'issue' ELSE 'ok' END,
         CASE WHEN optimized > 100000 THEN 'too large: ' WHEN optimized > 60000 THEN 'large: ' ELSE '' END
         || format('{:,.1f}', CASE WHEN baseline > 0 THEN (baseline - optimized) / baseline * 100.0 ELSE 0.0 END)
         || '% saved (' || CAST(baseline AS STRING) || ' -> ' || CAST(optimized AS STRING) || ')'
  FROM j WHERE doc_s IS NOT NULL
  UNION ALL
  SELECT project, 'cycles', CASE WHEN n_cycles > 0 THEN 'issue' ELSE 'ok' END, CAST(n_cycles AS STRING) || ' cycles' FROM j
  UNION ALL
  SELECT project, 'syntax', CASE WHEN n_errors > 0 THEN 'issue' ELSE 'ok' END,
         CASE WHEN n_errors > 0 THEN CAST(n_errors AS STRING) || ' files: ' || first_files || more ELSE '0 files' END FROM j)
SELECT r.*, p.passed FROM rows r JOIN (SELECT project, bool_and(status = 'ok') AS passed FROM rows GROUP BY project) p
  ON p.project = r.project
""")


# ------------------------------------------------------------------- reports
_TREE = """,
vis AS (SELECT project, path FROM sets WHERE in_optimized),
pp AS (SELECT project, path, string_split(path, '/') AS parts FROM vis),
dirs AS (SELECT project, array_to_string(parts[1:i], '/') AS prefix, i - 1 AS depth, parts[i] AS name, path
         FROM (SELECT project, path, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM pp WHERE len(parts) > 1) t),
tree AS (SELECT project, min(path) AS sort_path, CAST(depth AS BIGINT) AS depth, repeat('  ', depth) || '  ' || name || '/' AS line
         FROM dirs GROUP BY project, prefix, depth, name
         UNION ALL
         SELECT project, path, CAST(len(parts) - 1 AS BIGINT), repeat('  ', len(parts) - 1) || '  ' || parts[-1] FROM pp)
"""
ORACLE["file_tree"] = corpus_sql(_TREE + "SELECT * FROM tree")
ORACLE["dir_tree"] = code_sql(""",
pp AS (SELECT project, path, string_split(path, '/') AS parts FROM pyx),
dirs AS (SELECT project, array_to_string(parts[1:i], '/') AS prefix, i - 1 AS depth, parts[i] AS name, path
         FROM (SELECT project, path, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM pp WHERE len(parts) > 1) t)
SELECT project, min(path) AS sort_path, CAST(depth AS BIGINT) AS depth, repeat('  ', depth) || name || '/' AS line
FROM dirs GROUP BY project, prefix, depth, name
UNION ALL
SELECT DISTINCT project, '' AS sort_path, CAST(0 AS BIGINT), '(flat project)' FROM pyx
WHERE project NOT IN (SELECT project FROM dirs)
""")
ORACLE["signature_index"] = code_sql(""",
sigs AS (SELECT project, path,
                'def fn_' || k || '_0(x) -> int'
                || CASE WHEN nf >= 2 THEN chr(10) || 'def fn_' || k || '_1(x)' ELSE '' END
                || CASE WHEN nf >= 3 THEN chr(10) || 'async def fn_' || k || '_2(x) -> int' ELSE '' END
                || CASE WHEN nf >= 4 THEN chr(10) || 'def fn_' || k || '_3(x)' ELSE '' END
                || chr(10) || 'class Model' || k || 'X'
                || CASE WHEN k % 2 = 0 THEN chr(10) || '  def describe(self) -> str' ELSE '' END AS signatures
         FROM cp WHERE lang_id = 0 AND dir <> 'build')
SELECT * FROM sigs
""")

# Documents as lines: fixed lines from value lists, the others from the parts above.
from tokenloom.operators import reports as _RP  # noqa: E402


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fixed(projects: str, section: int, *lines: str) -> str:
    """SQL of fixed lines; a line may be an SQL expression over the project in braces."""
    rows = [f"SELECT project, CAST({section} AS BIGINT) AS section, '' AS sort_key, CAST({i} AS BIGINT) AS pos, "
            f"{x[1:-1] if x.startswith('{') else _q(x)} AS line FROM {projects}" for i, x in enumerate(lines)]
    return " UNION ALL ".join(rows)


_VISIBLE = f"vis AS (SELECT project, path FROM v_code WHERE NOT list_has_any(string_split(path, '/'), {_lst(DEFAULT_IGNORE_DIRS)}))"
_SNAPSHOT = (_TREE.replace("vis AS (SELECT project, path FROM sets WHERE in_optimized)", _VISIBLE)
             + ORACLE["signature_index"].split("sigs AS", 1)[1].join([",sigs AS", ""]).replace("SELECT * FROM sigs", "") + f""",
allp AS (SELECT DISTINCT project FROM vis), pyp AS (SELECT DISTINCT project FROM vis WHERE ends_with(path, '.py')),
docp AS (SELECT project, content FROM v_code WHERE path = 'CONTEXT.md'),
sigl AS (SELECT project, path, ['### `' || path || '`', '```python'] || string_split(signatures, chr(10)) || ['```', ''] AS l FROM sigs),
docl AS (SELECT project, ['### `CONTEXT.md`', '```md', rtrim(content, chr(10)), '```', ''] AS l FROM docp),
snap AS (
  {_fixed("allp", 0, "{" + _q(_RP.SNAPSHOT_TITLE) + " || project}", "", _RP.SNAPSHOT_NOTE, "", _RP.SNAPSHOT_SECTIONS[0], "```")}
  UNION ALL SELECT project, 1, sort_path, depth, line FROM tree
  UNION ALL {_fixed("allp", 2, "```", "")} UNION ALL {_fixed("pyp", 3, _RP.SNAPSHOT_SECTIONS[1], "")}
  UNION ALL SELECT project, 4, path, unnest(range(len(l))), unnest(l) FROM sigl
  UNION ALL {_fixed("(SELECT DISTINCT project FROM docp) t", 5, _RP.SNAPSHOT_SECTIONS[2], "")}
  UNION ALL SELECT project, 6, 'CONTEXT.md', unnest(range(len(l))), unnest(l) FROM docl)
""")
ORACLE["snapshot_doc"] = code_sql(_SNAPSHOT + """
SELECT project, row_number() OVER (PARTITION BY project ORDER BY section, sort_key, pos) AS line_no, line FROM snap""")
ORACLE["checkpoint_doc"] = code_sql(_SNAPSHOT + f"""
SELECT * FROM snap UNION ALL
{_fixed("allp", -1, "{'# ' || project || ' — Checkpoint'}", "", *_RP.CHECKPOINT_NOTES, "", "## Project overview", "")}
UNION ALL {_fixed("allp", 7, "## Next task", "", "Merge the two readers", "")}""")
ORACLE["snapshot_stats"] = code_sql(_SNAPSHOT + _CYCLES.format(e="edges") + _CODE_BUDGET + f"""
SELECT s.project, b.optimized AS with_rules_tokens, s.t AS snapshot_tokens,
       CASE WHEN b.optimized > 0 THEN round((1 - s.t / b.optimized) * 100.0, 1) ELSE 0.0 END AS reduction_pct
FROM (SELECT project, CAST(sum({_approx("line || chr(10)")}) AS BIGINT) AS t FROM snap GROUP BY project) s
JOIN cbud b ON b.project = s.project""")

_RANKED = """,
core AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY imported_by DESC, path) AS rank FROM indeg),
hot AS (""" + _HOT.format(t="v_code_changes", n=50) + """)
"""
ORACLE["project_doc"] = code_sql(_DEAD + _CYCLES.format(e="edges") + _CODE_BUDGET + _RANKED + f""",
{_FW},
pfw AS (SELECT project, string_agg(DISTINCT framework, ', ' ORDER BY framework) AS fw
        FROM (SELECT project, split_part(unnest(string_split(imports, ',')), '.', 1) AS r FROM pyx WHERE imports <> '') t
        JOIN fw ON fw.import_root = t.r GROUP BY project),
fn AS (SELECT *, CASE WHEN functions = '' THEN 0 ELSE len(string_split(functions, ',')) END AS nfn, classes <> '' AS ncl FROM pyx),
ov AS (SELECT project, count(*) AS n, sum(lines) AS lines, sum(nfn) AS fns, count(*) FILTER (ncl) AS cls, sum(typed_functions) AS typed,
              sum(complexity) AS cx FROM fn GROUP BY project),
ovl AS (SELECT o.project, list_filter([{", ".join(_q(x) for x in (_RP.GUIDE_TITLE, "", *_RP.GUIDE_NOTES, "", "## Project Overview", ""))},
          '- **Files:** ' || n || ' Python files', '- **Lines of code:** ' || format('{{:,}}', CAST(lines AS BIGINT)),
          '- **Functions:** ' || fns || '  |  **Classes:** ' || cls,
          '- **Type coverage:** ' || CAST(round(CASE WHEN fns > 0 THEN typed / fns * 100.0 ELSE 0.0 END, 0) AS BIGINT)
            || '%  |  **Avg complexity:** ' || CAST(round(cx / n, 1) AS VARCHAR),
          '- **Estimated token reduction with ignore rules:** ' || CAST(round(CASE WHEN b.baseline > 0
            THEN (b.baseline - b.optimized) / b.baseline * 100.0 ELSE 0.0 END, 1) AS VARCHAR) || '%',
          '- **Detected frameworks:** ' || fw], lambda x: x IS NOT NULL) AS l
        FROM ov o JOIN cbud b ON b.project = o.project LEFT JOIN pfw ON pfw.project = o.project),
allp AS (SELECT DISTINCT project FROM pyx),
pp AS (SELECT project, path, string_split(path, '/') AS parts FROM pyx),
dirs AS (SELECT project, array_to_string(parts[1:i], '/') AS prefix, i - 1 AS depth, parts[i] AS name, path
         FROM (SELECT project, path, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM pp WHERE len(parts) > 1) t),
core8 AS (SELECT * FROM core WHERE rank <= 8 AND imported_by > 0), hot8 AS (SELECT * FROM hot WHERE rank <= 8),
dead AS (SELECT u.project, u.path, string_agg('`' || u.symbol || '`', ', ' ORDER BY
                  list_position(string_split(x.functions || ',' || x.classes, ','), u.symbol)) AS symbols,
                row_number() OVER (PARTITION BY u.project ORDER BY u.path) AS rank
         FROM unused u JOIN pyx x ON x.project = u.project AND x.path = u.path GROUP BY u.project, u.path),
dead10 AS (SELECT * FROM dead WHERE rank <= 10)
SELECT project, CAST(0 AS BIGINT) AS section, '' AS sort_key, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS line FROM ovl
UNION ALL {_fixed("allp", 1, "", "## Project Structure", "", "```")}
UNION ALL SELECT project, 2, min(path), depth, repeat('  ', depth) || name || '/' FROM dirs GROUP BY project, prefix, depth, name
UNION ALL SELECT project, 2, '', 0, '(flat project)' FROM allp WHERE project NOT IN (SELECT project FROM dirs)
UNION ALL {_fixed("allp", 3, "```", "")}
UNION ALL {_fixed("(SELECT DISTINCT project FROM core8) t", 4, *_RP.CORE)}
UNION ALL SELECT project, 5, '', rank, '| `' || path || '` | ' || imported_by || CASE WHEN imported_by = 1 THEN ' file |' ELSE ' files |' END
          FROM core8
UNION ALL {_fixed("(SELECT DISTINCT project FROM core8) t", 6, "")}
UNION ALL {_fixed("(SELECT DISTINCT project FROM hot8) t", 7, *_RP.HOT)}
UNION ALL SELECT project, 8, '', rank, '| `' || path || '` | ' || changes || ' |' FROM hot8
UNION ALL {_fixed("(SELECT DISTINCT project FROM hot8) t", 9, "")}
UNION ALL {_fixed("(SELECT DISTINCT project FROM dead10) t", 10, *_RP.DEAD)}
UNION ALL SELECT project, 11, '', rank, '- **`' || path || '`**: ' || symbols FROM dead10
UNION ALL {_fixed("(SELECT DISTINCT project FROM dead10) t", 12, "")}
UNION ALL {_fixed("allp", 14, "## Recommended ignore rules", "", "```", *_RP.RECOMMENDED_RULES, "```", "")}
""", extra_views=("v_code_changes",))

_JSON_LIST = """'[' || coalesce(array_to_string(list_transform({}, lambda x: '"' || x || '"'), ','), '') || ']'"""
ORACLE["analysis_json"] = code_sql(_CYCLES.format(e="edges") + _CODE_BUDGET + _RANKED + f""",
tot AS ({ORACLE["project_totals"].split(_CODE, 1)[1].lstrip(", ").join(["SELECT * FROM (WITH ", ") y"])}),
qs AS (SELECT project, round(sum(complexity) / count(*), 1) AS cx, round(sum(typed_functions) / greatest(sum(CASE WHEN functions = '' THEN 0
         ELSE len(string_split(functions, ',')) END), 1) * 100.0, 1) AS ty
       FROM (SELECT * FROM pyx UNION ALL SELECT * FROM tsx UNION ALL SELECT * FROM gox) z GROUP BY project),
mi AS (SELECT project, string_agg('{{"file":"' || path || '","count":' || imported_by || '}}', ',' ORDER BY rank) AS j
       FROM core WHERE rank <= 10 AND imported_by > 0 GROUP BY project),
ht AS (SELECT project, string_agg('"' || path || '":' || changes, ',' ORDER BY path) AS j FROM hot GROUP BY project),
cy AS (SELECT project, list_sort(list(chain)) AS l FROM cycles GROUP BY project)
SELECT t.project, '{{"project":"' || t.project || '","languages":' || {_JSON_LIST.format("string_split(t.languages, ',')")}
       || ',"files":' || files || ',"total_lines":' || total_lines || ',"total_functions":' || total_functions
       || ',"total_classes":' || total_classes
       || ',"frameworks":' || {_JSON_LIST.format("list_filter(string_split(t.frameworks, ', '), lambda x: x <> '')")}
       || ',"most_imported":[' || coalesce(mi.j, '') || '],"hot_files":{{' || coalesce(ht.j, '') || '}},"tokens":{{"baseline":' || b.baseline
       || ',"optimized":' || b.optimized || ',"savings_pct":' || CAST(CASE WHEN b.baseline > 0
            THEN round((b.baseline - b.optimized) / b.baseline * 100.0, 1) ELSE 0.0 END AS VARCHAR)
       || '}},"cycles":' || {_JSON_LIST.format("cy.l")} || ',"quality":{{"avg_complexity":' || CAST(qs.cx AS VARCHAR)
       || ',"type_coverage_pct":' || CAST(qs.ty AS VARCHAR) || '}}}}' AS json
FROM tot t JOIN cbud b ON b.project = t.project JOIN qs ON qs.project = t.project LEFT JOIN mi ON mi.project = t.project
LEFT JOIN ht ON ht.project = t.project LEFT JOIN cy ON cy.project = t.project
""", extra_views=("v_code_changes",))
ORACLE["small_docs"] = duckdb_with(["v_conf"]) + """
SELECT project, path, ext,
       CASE WHEN ext IN ('toml', 'yml') THEN
              'key_a = ' || n || '  # inline' || chr(10) || '; note line' || chr(10) || '[section]' || chr(10)
              || 'title = ' || title || chr(10) || 'end = 1'
            WHEN ext IN ('ini', 'cfg') THEN
              'key_a = ' || n || '  # inline' || chr(10) || '[section]' || chr(10) || 'title = ' || title || chr(10) || 'end = 1'
            ELSE '# config for doc ' || doc_id || chr(10) || 'key_a = ' || n || '  # inline' || chr(10) || '; note line'
              || chr(10) || '   # indented comment' || chr(10) || '[section]' || chr(10) || 'title = ' || title || chr(10)
              || 'end = 1' END AS body
FROM (SELECT c.*, CAST(d.n_chars AS STRING) AS n FROM v_conf c JOIN documents d ON d.doc_id = c.doc_id) t
WHERE strlen(content) < 4096
"""
ORACLE["focus_budget"] = ORACLE["rank_files"].replace("SELECT rk.project, CAST(rk.rank AS BIGINT) AS rank", """,
top AS (SELECT rk.project, CAST(rk.rank AS BIGINT) AS rank""", 1).replace("WHERE rk.rank <= 8", """WHERE rk.rank <= 8),
opt AS (SELECT project, CAST(sum(CASE WHEN in_optimized THEN tokens ELSE 0 END) AS BIGINT) AS project_tokens FROM sets
        GROUP BY project)
SELECT t.project, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(t.tokens) AS BIGINT) AS focus_tokens, o.project_tokens,
       CAST(o.project_tokens - sum(t.tokens) AS BIGINT) AS saved_tokens,
       CASE WHEN o.project_tokens > 0 THEN round((o.project_tokens - sum(t.tokens)) / o.project_tokens * 100.0, 1)
            ELSE 0.0 END AS saved_pct
FROM top t JOIN opt o ON o.project = t.project GROUP BY t.project, o.project_tokens""", 1)


# ------------------------------------------- sources, incremental, streaming
ORACLE["scan_files"] = duckdb_with(["v_code"]) + """
SELECT project, path, CAST(strlen(content) AS BIGINT) AS size_bytes,
       CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT) AS lines
FROM v_code
"""
ORACLE["stream_files"] = duckdb_with(["v_code"]) + """
SELECT project, path, CAST(strlen(content) AS BIGINT) AS size_bytes,
       CAST(CASE WHEN length(path) % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS versions
FROM v_code
"""
ORACLE["changed_files"] = code_sql(_ALL + """,
ks AS (SELECT project, path, TRY_CAST(regexp_extract(path, '/m(\\d+)\\.', 1) AS BIGINT) AS k FROM allc)
SELECT a.project, a.path, CASE WHEN ends_with(a.path, '.py') THEN 'python' WHEN ends_with(a.path, '.ts') THEN 'typescript'
                               ELSE 'go' END AS language,
       a.lines, CAST(a.nfn AS BIGINT) AS n_functions, NOT coalesce(ks.k % 6 = 0, false) AS reused
FROM allc a JOIN ks ON ks.project = a.project AND ks.path = a.path
WHERE NOT coalesce(ks.k % 13 = 0, false)
""")
ORACLE["append_rules"] = corpus_sql(_SUGGEST + """,
sg AS (SELECT project, pattern, min(rank) AS rk FROM ranked WHERE rank <= 10 GROUP BY project, pattern),
fresh AS (SELECT * FROM sg WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.project = sg.project AND r.pattern = sg.pattern)),
last AS (SELECT project, max(ord) AS last_ord FROM rules GROUP BY project)
SELECT f.project, CAST(coalesce(l.last_ord, 0) + row_number() OVER (PARTITION BY f.project ORDER BY f.rk, f.pattern) AS BIGINT) AS ord,
       f.pattern
FROM fresh f LEFT JOIN last l ON l.project = f.project
""")
ORACLE["stream_session_usage"] = duckdb_with(["v_sessions"]) + _SESS + """
SELECT session_id, project, mtime_s, input_tokens, output_tokens, cache_write, cache_read, total_tokens, turns, cost_usd
FROM usage_t"""
ORACLE["stream_reanalyze"] = code_sql(_ALL + """,
ks AS (SELECT project, path, TRY_CAST(regexp_extract(path, '/m(\\d+)\\.', 1) AS BIGINT) AS k,
              CAST(substr(project, 2) AS INT) AS n FROM allc)
SELECT a.project, a.path, CASE WHEN ends_with(a.path, '.py') THEN 'python' WHEN ends_with(a.path, '.ts') THEN 'typescript'
                               ELSE 'go' END AS language, a.lines, CAST(a.nfn AS BIGINT) AS n_functions
FROM allc a JOIN ks ON ks.project = a.project AND ks.path = a.path
WHERE ks.n > 0 AND NOT (ks.n < 10 AND coalesce(ks.k % 13 = 0, false))
""")

ORACLE["rank_files_batch"] = corpus_sql(f""",
qs AS (SELECT 'p' || CAST(item_id % 7 AS STRING) AS project, item_id AS query_id, text FROM benchmark),
kw AS (SELECT DISTINCT project, query_id, unnest({_words('text')}) AS k FROM qs),
vis AS (SELECT project, path, content FROM sets WHERE in_focus AND project IN (SELECT DISTINCT project FROM v_docs)),
ct AS (SELECT project, path, unnest({_words('content')}) AS t FROM vis),
ntok AS (SELECT project, path, count(*) AS n FROM ct GROUP BY project, path),
cf AS (SELECT ct.project, ct.path, kw.query_id, kw.k, count(*) AS c FROM ct JOIN kw ON kw.project = ct.project AND ct.t = kw.k
       GROUP BY ct.project, ct.path, kw.query_id, kw.k),
pt AS (SELECT project, path, unnest({_words('path')}) AS t FROM vis),
pm AS (SELECT DISTINCT pt.project, pt.path, kw.query_id, kw.k FROM pt JOIN kw ON kw.project = pt.project AND contains(pt.t, kw.k)),
per AS (SELECT project, path, query_id, 1.0 + least(c - 1, 4) * 0.2 AS v FROM cf
        UNION ALL SELECT project, path, query_id, 3.0 FROM pm),
sc AS (SELECT per.project, per.path, per.query_id, sum(v) / greatest(1.0, max(ntok.n) / 500.0) AS raw
       FROM per JOIN ntok ON ntok.project = per.project AND ntok.path = per.path GROUP BY per.project, per.path, per.query_id),
rk AS (SELECT *, round(raw, 2) AS score FROM sc WHERE raw > 0)
SELECT project, query_id, rank, path, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project, query_id ORDER BY score DESC, path) AS BIGINT) AS rank FROM rk) t
WHERE rank <= 8
""")

# T2 + T4: three arrivals (lines <= 3, 4..7, >= 8); a session emits in each
# arrival that has its lines; the last emission's delta is against the one before.
_CUT_TOTALS = """
t{i} AS (SELECT project, session_id, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o,
                CAST(sum(cache_write) AS BIGINT) AS w, CAST(sum(cache_read) AS BIGINT) AS r
         FROM dedc_all WHERE has_usage AND line_no <= {cut} GROUP BY project, session_id)"""

ORACLE["stream_session_delta"] = duckdb_with(["v_sessions"]) + _SESS + """,
dedc_all AS (SELECT * FROM dedc),""" + ",".join(_CUT_TOTALS.format(i=i, cut=c) for i, c in ((1, 3), (2, 7), (3, 1000000000))) + f""",
arr AS (SELECT project, session_id, max(mtime_s) AS mtime_s,
               bool_or(line_no <= 3) AS a1, bool_or(line_no BETWEEN 4 AND 7) AS a2, bool_or(line_no >= 8) AS a3
        FROM v_sessions GROUP BY project, session_id),
lastprev AS (SELECT project, session_id, mtime_s,
                    CASE WHEN a3 THEN 3 WHEN a2 THEN 2 ELSE 1 END AS last_a,
                    CASE WHEN a3 THEN (CASE WHEN a2 THEN 2 WHEN a1 THEN 1 END)
                         WHEN a2 THEN (CASE WHEN a1 THEN 1 END) END AS prev_a
             FROM arr),
tt AS (SELECT l.project, l.session_id, l.mtime_s, l.prev_a,
              CASE l.last_a WHEN 3 THEN coalesce(t3.i, 0) WHEN 2 THEN coalesce(t2.i, 0) ELSE coalesce(t1.i, 0) END
                - CASE l.prev_a WHEN 2 THEN coalesce(t2.i, 0) WHEN 1 THEN coalesce(t1.i, 0) ELSE 0 END AS di,
              CASE l.last_a WHEN 3 THEN coalesce(t3.o, 0) WHEN 2 THEN coalesce(t2.o, 0) ELSE coalesce(t1.o, 0) END
                - CASE l.prev_a WHEN 2 THEN coalesce(t2.o, 0) WHEN 1 THEN coalesce(t1.o, 0) ELSE 0 END AS do_,
              CASE l.last_a WHEN 3 THEN coalesce(t3.w, 0) WHEN 2 THEN coalesce(t2.w, 0) ELSE coalesce(t1.w, 0) END
                - CASE l.prev_a WHEN 2 THEN coalesce(t2.w, 0) WHEN 1 THEN coalesce(t1.w, 0) ELSE 0 END AS dw,
              CASE l.last_a WHEN 3 THEN coalesce(t3.r, 0) WHEN 2 THEN coalesce(t2.r, 0) ELSE coalesce(t1.r, 0) END
                - CASE l.prev_a WHEN 2 THEN coalesce(t2.r, 0) WHEN 1 THEN coalesce(t1.r, 0) ELSE 0 END AS dr
       FROM lastprev l LEFT JOIN t1 ON t1.project = l.project AND t1.session_id = l.session_id
       LEFT JOIN t2 ON t2.project = l.project AND t2.session_id = l.session_id
       LEFT JOIN t3 ON t3.project = l.project AND t3.session_id = l.session_id)
SELECT project, session_id,
       CAST(CASE WHEN prev_a IS NULL THEN 0 ELSE di END AS BIGINT) AS delta_input,
       CAST(CASE WHEN prev_a IS NULL THEN 0 ELSE do_ END AS BIGINT) AS delta_output,
       CAST(CASE WHEN prev_a IS NULL THEN 0 ELSE dw END AS BIGINT) AS delta_cache_w,
       CAST(CASE WHEN prev_a IS NULL THEN 0 ELSE dr END AS BIGINT) AS delta_cache_r,
       CASE WHEN prev_a IS NULL THEN 0.0 ELSE {_cost('di', 'do_', 'dw', 'dr')} END AS delta_cost
FROM tt WHERE mtime_s > {1704067200 + 120 * 3600} - 48 * 3600
"""
