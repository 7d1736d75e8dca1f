"""Proof views: the driver tables re-mapped to the inputs of the operators.

Each view is one SELECT that runs unchanged in Spark SQL and in DuckDB, apart
from the placeholders in ``DIALECTS``.  Spark builds the input tables from
them; the DuckDB oracle inlines the same text as CTEs and then computes the
expected answer its own way.  Literal braces are doubled (``str.format``).

Table placeholders: ``{documents}``, ``{pages}``, ``{customer}``, ``{nation}``,
``{conversations}``, ``{orders}``, ``{lineitem}``, ``{events}``; other views
are referenced as ``{v_<name>}``.
"""
from __future__ import annotations

DIALECTS = {
    # EPOCH_TS: whole seconds of the naive event timestamp ``ts`` since 1970 (time-zone free)
    # ROWS3: three rows per input row (0, 1, 2), one pass over the input
    "spark": {"OCTETS": "octet_length", "EPOCH_TS": "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
              "ROWS3": "explode(array(0, 1, 2))"},
    "duckdb": {"OCTETS": "strlen", "EPOCH_TS": "CAST(floor(epoch(ts)) AS BIGINT)", "ROWS3": "unnest([0, 1, 2])"},
}

# V_docs: one file per document.  7 projects; 6 top directories; 6 suffixes.
V_DOCS = """
SELECT 'p' || CAST(doc_id % 7 AS STRING) AS project,
       CASE doc_id % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'docs' WHEN 2 THEN 'tests'
                       WHEN 3 THEN 'examples' WHEN 4 THEN 'vendor' ELSE 'build' END
       || '/' || source || '/doc_' || CAST(doc_id AS STRING)
       || CASE CAST(floor(doc_id / 6) AS BIGINT) % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.json'
                       WHEN 3 THEN '.py' WHEN 4 THEN '.log' ELSE '.PNG' END AS path,
       text AS content,
       CAST({OCTETS}(text) AS BIGINT) AS size_bytes,
       CAST(1704067200 + doc_id * 60 AS BIGINT) AS mtime_s
FROM {documents}
"""

# V_pages: project = URL host, path = URL path without query and fragment;
# a path ending in '/' (or empty) names the folder's index.html; a URL with a
# query or fragment lives in a sub-folder named after the page id (unique).
V_PAGES = """
SELECT project,
       CASE WHEN instr(url, '?') > 0 OR instr(url, '#') > 0
            THEN regexp_extract(p, '^(.*/)?[^/]*$', 1) || 'q' || CAST(page_id AS STRING) || '/'
                 || regexp_extract(p, '([^/]*)$', 1)
            ELSE p END AS path,
       content, size_bytes, mtime_s
FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS project,
             CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) = '' THEN 'index.html'
                  WHEN right(regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1), 1) = '/'
                  THEN regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) || 'index.html'
                  ELSE regexp_extract(url, '^[a-z]+://[^/?#]+/?([^?#]*)', 1) END AS p,
             html AS content,
             CAST({OCTETS}(html) AS BIGINT) AS size_bytes,
             CAST(1704067200 + page_id * 60 AS BIGINT) AS mtime_s
      FROM {pages}) u
"""

V_FILES = """
SELECT project, path, content, size_bytes, mtime_s FROM {v_docs}
UNION ALL
SELECT project, path, content, size_bytes, mtime_s FROM {v_pages}
"""

# The three rule files handed to projects (A, B = comments only, C).
RULES_A = "# project rules\n*.log\n\nvendor/\n  examples  \ndoc_1?.md\nen/*\n*doc_[*]1*\n[z-a]*\n[[]x\n*doc_[!0-4]*[?]x\n"
RULES_B = "# nothing but comments\n\n   \n# more\n"
RULES_C = "*.json\nbuild\n[!s]*.txt\nfr/\n*.html\n*doc_[5-7][1-]*.md\n*[]9].py\n"

V_RULES_FILES = """
SELECT project,
       CASE (length(project) + ascii(right(project, 1))) % 4
            WHEN 0 THEN '""" + RULES_A + """'
            WHEN 1 THEN '""" + RULES_B + """'
            ELSE '""" + RULES_C + """' END AS content
FROM (SELECT DISTINCT project FROM {v_files}) p
WHERE (length(project) + ascii(right(project, 1))) % 4 <> 3
"""

# V_code parameters: one source file per customer; the facts follow from these.
V_CODE_PARAMS = """
SELECT c_custkey AS k, c_nationkey AS n, 'n' || CAST(c_nationkey AS STRING) AS project,
       CAST(c_custkey % 3 AS INT) AS lang_id,
       CASE WHEN c_custkey % 10 = 9 THEN 'tests' WHEN c_custkey % 10 = 8 THEN 'build' ELSE 'pkg' END AS dir,
       CAST(1 + c_custkey % 4 AS INT) AS nf,
       CAST(c_custkey % 5 AS INT) AS n_if,
       lead(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS nxt,
       lag(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS prv,
       lag(c_custkey, 2) OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_custkey) AS prv2,
       CASE c_custkey % 8 WHEN 0 THEN 'fastapi' WHEN 1 THEN 'flask' WHEN 2 THEN 'json'
            WHEN 3 THEN 'pandas' WHEN 4 THEN 'sqlalchemy.orm' WHEN 5 THEN 'click'
            WHEN 6 THEN 'collections' ELSE 'requests' END AS fw,
       CASE c_custkey % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'axios' WHEN 2 THEN 'express' ELSE 'lodash' END AS tsfw,
       CASE c_custkey % 3 WHEN 0 THEN 'chi' WHEN 1 THEN 'gin' ELSE 'zap' END AS gofw
FROM {customer}
"""

_PY = """
CASE WHEN lang_id = 0 THEN
'\"\"\"Module m' || CAST(k AS STRING) || ' of nation ' || CAST(n AS STRING) || '.\"\"\"
import os
' || CASE WHEN nxt IS NOT NULL THEN 'import pkg.m' || CAST(nxt AS STRING) || '
' ELSE '' END || 'from ' || fw || ' import thing
' || CASE WHEN k % 4 = 1 THEN 'from pkg import m' || CAST(k AS STRING) || '
' ELSE '' END || CASE WHEN k % 5 = 0 AND prv2 IS NOT NULL THEN 'import pkg.m' || CAST(prv2 AS STRING) || '
' ELSE '' END || CASE WHEN k % 11 = 0 THEN 'import pkg.m' || CAST(k AS STRING) || '
' ELSE '' END || '

' || CASE WHEN k % 7 = 0 THEN '@app.command()
' ELSE '' END || 'def fn_' || CAST(k AS STRING) || '_0(x) -> int:
    y = x
' || repeat('    if x > 0:
        y = y + 1
', n_if) || '    z = x and y and ' || CAST(k AS STRING) || '
' || CASE WHEN prv IS NOT NULL THEN '    w = fn_' || CAST(prv AS STRING) || '_0
' ELSE '' END || '    return y
' || CASE WHEN nf >= 2 THEN '

def fn_' || CAST(k AS STRING) || '_1(x):
    return x
' ELSE '' END || CASE WHEN nf >= 3 THEN '

async def fn_' || CAST(k AS STRING) || '_2(x) -> int:
    return x
' ELSE '' END || CASE WHEN nf >= 4 THEN '

def fn_' || CAST(k AS STRING) || '_3(x):
    return x
' ELSE '' END || '

class Model' || CAST(k AS STRING) || 'X:
    value = ' || CAST(k AS STRING) || '
' || CASE WHEN k % 2 = 0 THEN '
    def describe(self) -> str:
        return "m"
' ELSE '' END || CASE WHEN k % 50 = 0 THEN 'broken = (
' ELSE '' END
"""

_TS = """
WHEN lang_id = 1 THEN
'import {{ thing }} from "' || tsfw || '";
import helper from "./m' || CAST(coalesce(prv, 0) AS STRING) || '";
const lib = require("' || tsfw || '-extra/sub");

export function fn_' || CAST(k AS STRING) || '_0(x: number): number {{
' || repeat('  if (x > 0) {{ x = x + 1; }}
', n_if) || '  return x > 1 ? x : 0;
}}
' || CASE WHEN nf >= 2 THEN '
export const fn_' || CAST(k AS STRING) || '_1 = async (y) => {{
  for (let i = 0; i < 3; i++) {{ y = y + i; }}
  return y;
}};
' ELSE '' END || '
class Model' || CAST(k AS STRING) || 'X {{
  value = ' || CAST(k AS STRING) || ';
}}
'
"""

_GO = """
ELSE
'package m' || CAST(k AS STRING) || '

' || CASE WHEN k % 4 = 3 THEN 'import "fmt"
import "os/signal"
' ELSE 'import (
    "fmt"
    "net/http"
    "github.com/acme/' || gofw || '"
)
' || CASE WHEN k % 4 = 1 THEN 'import "strings"
' ELSE '' END END || '
type Model' || CAST(k AS STRING) || 'X struct {{
    Value int
}}

func (m *Model' || CAST(k AS STRING) || 'X) Describe() string {{
    return "m"
}}

func Fn' || CAST(k AS STRING) || 'Run(x int) int {{
' || repeat('    if x > 0 {{
        x = x + 1
    }}
', n_if) || '    for i := 0; i < 2; i++ {{
        x = x + i
    }}
    switch x {{
    case 1:
        return 1
    }}
    return x
}}
'
END
"""

V_CODE = """
SELECT project,
       dir || '/m' || CAST(k AS STRING) || CASE lang_id WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS path,
       content, CAST({OCTETS}(content) AS BIGINT) AS size_bytes,
       CAST(1704067200 + k * 60 AS BIGINT) AS mtime_s
FROM (SELECT *, """ + _PY + _TS + _GO + """ AS content FROM {v_code_params}) t
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING) AS project, 'pkg/__init__.py' AS path,
       '\"\"\"Package of nation ' || CAST(n_nationkey AS STRING) || '.\"\"\"
' AS content, CAST(40 AS BIGINT) AS size_bytes, CAST(1704067200 AS BIGINT) AS mtime_s
FROM {nation}
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 'CONTEXT.md', '# Notes for nation ' || CAST(n_nationkey AS STRING) || '
', CAST(20 AS BIGINT), CAST(1704067200 + n_nationkey * 3000 AS BIGINT)
FROM {nation} WHERE n_nationkey % 3 = 0
"""

# V_conf: documents rendered as small config files, suffix by doc_id % 5.
V_CONF = """
SELECT 'p' || CAST(doc_id % 7 AS STRING) AS project,
       'conf/c' || CAST(doc_id AS STRING) || '.' || ext AS path, ext, doc_id, title,
       '# config for doc ' || CAST(doc_id AS STRING) || '

key_a = ' || CAST(n_chars AS STRING) || '  # inline
; note line
   # indented comment
[section]
title = ' || title || '
end = 1
' AS content
FROM (SELECT doc_id, n_chars,
             CASE doc_id % 5 WHEN 0 THEN 'toml' WHEN 1 THEN 'ini' WHEN 2 THEN 'cfg' WHEN 3 THEN 'yml' ELSE 'md' END AS ext,
             replace(replace(text, chr(10), ' '), chr(13), ' ') AS title
      FROM {documents}) d
"""

# V_sessions: conversations as session log lines (JSON text per line); two
# projects share each session id and some uuids.
V_SESSIONS = """
SELECT 'proj' || CAST(conv_id % 5 AS STRING) AS project,
       'c' || CAST(conv_id - conv_id % 2 AS STRING) || '-5e55-4a1b' AS session_id,
       CAST(turn AS INT) AS line_no,
       CASE WHEN conv_id % 17 = 0 AND turn = 1 THEN '{{"type":"assistant","uuid":"broken'
       ELSE '{{"type":"' || role || '"'
            || CASE WHEN turn % 7 = 3 THEN '' ELSE ',"uuid":"' || CAST(conv_id - conv_id % 2 AS STRING) || '-'
                    || CAST(CAST(floor(turn / 4) AS BIGINT) AS STRING) || '"' END
            || ',"message":{{"role":"' || role || '"'
            || CASE WHEN conv_id % 13 = 5 THEN '' ELSE ',"usage":{{"input_tokens":' || CAST(length(text) AS STRING)
                    || ',"output_tokens":' || CAST(length(text) - length(replace(text, ' ', '')) AS STRING)
                    || ',"cache_creation_input_tokens":' || CAST(turn * 10 AS STRING)
                    || ',"cache_read_input_tokens":' || CAST(conv_id AS STRING) || '}}' END
            || '}}}}' END AS raw,
       CAST(1704067200 + conv_id * 3600 AS BIGINT) AS mtime_s
FROM {conversations}
"""

# V_changes: orders are commits (newest first by date then key), line items are
# changed files; every 4th line is a rename; orders with key % 97 = 0 are roots.
V_CHANGES = """
SELECT o.project, o.o_orderkey AS commit_id, o.commit_seq, o.o_orderkey % 97 <> 0 AS has_parent,
       'p' || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN '.md' ELSE '.py' END AS a_path,
       CASE WHEN l_linenumber % 4 = 0 THEN 'q' || CAST(l_partkey AS STRING) || '.py'
            ELSE 'p' || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN '.md' ELSE '.py' END END AS b_path
FROM (SELECT o_orderkey, 'r' || CAST(o_custkey % 4 AS STRING) AS project,
             CAST(row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS commit_seq
      FROM {orders}) o
JOIN {lineitem} ON l_orderkey = o.o_orderkey
"""

# The same log as a commit table and the files of each commit.
V_COMMITS = """
SELECT o_orderkey AS commit_id, 'r' || CAST(o_custkey % 4 AS STRING) AS project, o_orderdate AS committed,
       o_orderkey % 97 <> 0 AS has_parent
FROM {orders}
"""

V_COMMIT_FILES = """
SELECT l_orderkey AS commit_id,
       'p' || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN '.md' ELSE '.py' END AS a_path,
       CASE WHEN l_linenumber % 4 = 0 THEN 'q' || CAST(l_partkey AS STRING) || '.py'
            ELSE 'p' || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN '.md' ELSE '.py' END END AS b_path
FROM {lineitem}
"""

# V_ranges: per user, one changed range per event: start minute since 2024-01-01.
V_RANGES = """
SELECT 'u' || CAST(user_id % 5 AS STRING) AS project,
       'f' || CAST(user_id AS STRING) || '.py' AS path,
       CAST(floor({EPOCH_TS} / 60) - 28401120 AS BIGINT) AS start_line,
       CAST(floor({EPOCH_TS} / 60) - 28401120 + greatest(CAST(floor(value) AS BIGINT), 1) - 1 AS BIGINT) AS end_line
FROM {events}
"""

# V_diff: one unified diff per user: a file header whenever the file changes,
# then one hunk header per event and one added line.
V_DIFF_EVENTS = """
SELECT user_id, event_id, ts, value,
       CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'docs/' || event_type || '.md'
            ELSE 'src/' || event_type || '.py' END AS file,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS r,
       CAST(floor({EPOCH_TS} / 60) % 1440 AS BIGINT) AS c,
       CAST(floor(value) AS BIGINT) % 8 AS d
FROM {events}
"""

V_DIFF = """
SELECT 'u' || CAST(user_id % 5 AS STRING) AS project, user_id AS diff_id, CAST(r * 3 + j AS INT) AS line_no,
       CASE j WHEN 0 THEN 'diff --git a/' || file || ' b/' || file
              WHEN 1 THEN CASE WHEN CAST(floor(value * 10) AS BIGINT) % 10 = 9
                               THEN '@@ -' || CAST(c AS STRING) || ' +' || CAST(c AS STRING) || ' @@'
                               ELSE '@@ -' || CAST(c AS STRING) || ',' || CAST(d + 1 AS STRING) || ' +' || CAST(c AS STRING)
                                    || ',' || CAST(d AS STRING) || ' @@ ctx' END
              ELSE '+changed line ' || CAST(event_id AS STRING) END AS line
FROM (SELECT *, {ROWS3} AS j
      FROM (SELECT *, lag(file) OVER (PARTITION BY user_id ORDER BY r) AS prev_file FROM {v_diff_events}) e) x
WHERE j > 0 OR prev_file IS NULL OR prev_file <> file
"""

# V_transitions: event type -> next event type of the same user (distinct).
V_TRANSITIONS = """
SELECT DISTINCT 'events' AS project, event_type AS src, nxt AS dst
FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) t
WHERE nxt IS NOT NULL
"""

# V_code_changes: each order is a commit of its customer's nation; it touches
# the customer's file (and the previous customer's file on every 3rd order).
V_CODE_CHANGES = """
SELECT p.project, o.o_orderkey AS commit_id,
       CAST(row_number() OVER (PARTITION BY p.project ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS BIGINT) AS commit_seq,
       o.o_orderkey % 97 <> 0 AS has_parent,
       p.dir || '/m' || CAST(p.k AS STRING) || CASE p.lang_id WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END AS a_path,
       CASE WHEN o.o_orderkey % 3 = 0 AND p.prv IS NOT NULL
            THEN 'pkg/m' || CAST(p.prv AS STRING) || CASE p.lang_id WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END
            ELSE p.dir || '/m' || CAST(p.k AS STRING) || CASE p.lang_id WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END
       END AS b_path
FROM {orders} o JOIN {v_code_params} p ON o.o_custkey = p.k
"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_code_changes": (V_CODE_CHANGES, ("orders", "v_code_params")),
    "v_docs": (V_DOCS, ("documents",)),
    "v_pages": (V_PAGES, ("pages",)),
    "v_files": (V_FILES, ("v_docs", "v_pages")),
    "v_rules_files": (V_RULES_FILES, ("v_files",)),
    "v_code_params": (V_CODE_PARAMS, ("customer",)),
    "v_code": (V_CODE, ("v_code_params", "nation")),
    "v_conf": (V_CONF, ("documents",)),
    "v_sessions": (V_SESSIONS, ("conversations",)),
    "v_commits": (V_COMMITS, ("orders",)),
    "v_commit_files": (V_COMMIT_FILES, ("lineitem",)),
    "v_changes": (V_CHANGES, ("orders", "lineitem")),
    "v_ranges": (V_RANGES, ("events",)),
    "v_diff_events": (V_DIFF_EVENTS, ("events",)),
    "v_diff": (V_DIFF, ("v_diff_events",)),
    "v_transitions": (V_TRANSITIONS, ("events",)),
}

BASE_TABLES = ("documents", "pages", "customer", "nation", "conversations", "orders", "lineitem", "events")


def _closure(names) -> list[str]:
    """Views needed for ``names`` in dependency order."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out or n not in VIEWS:
            return
        for dep in VIEWS[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def render(name: str, dialect: str, table_names: dict[str, str]) -> str:
    sql, _ = VIEWS[name]
    d = DIALECTS[dialect]
    fmt = dict(d)
    fmt.update(table_names)
    return sql.format(**fmt)


def duckdb_with(views: list[str]) -> str:
    """``WITH`` clause defining the given views (and their dependencies) for DuckDB."""
    names = {t: t for t in BASE_TABLES}
    names.update({v: v for v in VIEWS})
    parts = [f"{v} AS ({render(v, 'duckdb', names)})" for v in _closure(views)]
    return "WITH " + ",\n".join(parts) + "\n"
