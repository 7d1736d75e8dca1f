"""Extraction jobs ``files -> code_facts``.

TypeScript/JavaScript and Go facts are native Catalyst regex expressions.
Python facts need a real parser: an Arrow-batched pandas UDF sends only the
``content`` column to Python, one ``ast`` parse per file.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark import cloudpickle

from tokenloom.functions.text import line_count
from tokenloom.operators import pyfacts as _pyfacts
from tokenloom.operators.filters import GO_EXTENSIONS, TS_EXTENSIONS, in_dirs

# Executors need not have this package installed: the per-row helper travels
# with the UDF (pickled by value).
cloudpickle.register_pickle_by_value(_pyfacts)

FACT_COLUMNS = ["project", "path", "language", "lines", "functions", "classes", "imports",
                "complexity", "typed_functions", "has_syntax_error"]

_PY_SCHEMA = ("functions array<string>, classes array<string>, imports array<string>, "
              "complexity long, typed_functions long, has_syntax_error boolean")


def _python_facts_udf():
    python_facts = _pyfacts.python_facts

    @F.pandas_udf(_PY_SCHEMA)
    def py_facts(src: pd.Series) -> pd.DataFrame:
        none = python_facts("")  # rows of other languages
        rows = [python_facts(s) if isinstance(s, str) else none for s in src]
        return pd.DataFrame(rows, columns=["functions", "classes", "imports", "complexity",
                                           "typed_functions", "has_syntax_error"])

    return py_facts


def parse_scope(files: DataFrame) -> DataFrame:
    """Files the parsers look at: outside the parse ignore directories."""
    return files.where(~in_dirs("parse"))


def extract_python_facts(files: DataFrame, keep_content: bool = False) -> DataFrame:
    """U1 + U1b: ``.py`` files -> code_facts rows (language 'python').

    ``keep_content`` carries the text along (row-local) for jobs that need
    facts and text together (dead code), so no join on the text is needed.
    """
    py = parse_scope(files).where(F.col("path").endswith(".py")).select("project", "path", "content")
    f = py.select("project", "path", "content", line_count("content").alias("lines"),
                  _python_facts_udf()(F.col("content")).alias("f"))
    extra = ["content"] if keep_content else []
    return f.select("project", "path", F.lit("python").alias("language"), "lines",
                    "f.functions", "f.classes", "f.imports", "f.complexity", "f.typed_functions",
                    "f.has_syntax_error", *extra)


def _two_group(text: Column, rx: str) -> Column:
    """Matches of a two-alternative regex in position order; the group that
    participated wins."""
    g1 = F.regexp_extract_all(text, F.lit(rx), 1)
    g2 = F.regexp_extract_all(text, F.lit(rx), 2)
    both = F.zip_with(g1, g2, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b))
    return F.filter(both, lambda x: F.coalesce(x, F.lit("")) != "")


# TypeScript/JavaScript patterns.
TS_FUNC_RE = r"(?U)(?:function\s+(\w+))|(?:(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\()"
TS_CLASS_RE = r"(?U)\bclass\s+(\w+)"
TS_IMPORT_RE = r"""(?:import|from)\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
TS_RETURN_RE = r"(?U)\)\s*:\s*\w"
TS_BRANCH_RE = r"(?U)\bif\s*\(|\bfor\s*\(|\bwhile\s*\(|\bswitch\s*\(|\bcatch\s*\(|\?(?!=)"


def _language(path: str = "path") -> Column:
    """The language whose facts a file gets, by suffix; null for other files."""
    out = F.when(F.col(path).endswith(".py"), "python")
    for name, suffixes in (("typescript", TS_EXTENSIONS), ("go", GO_EXTENSIONS)):
        for e in suffixes:
            out = out.when(F.col(path).endswith(e), name)
    return out


def _ts_columns() -> dict[str, Column]:
    """Facts of a row with ``src`` and ``functions``."""
    raw_imports = _two_group(F.col("src"), TS_IMPORT_RE)
    return {"classes": F.regexp_extract_all("src", F.lit(TS_CLASS_RE), 1),
            "imports": F.transform(F.filter(raw_imports, lambda i: ~i.startswith(".")),
                                   lambda i: F.substring_index(F.regexp_replace(i, r"^[./]+", ""), "/", 1)),
            "complexity": F.regexp_count("src", F.lit(TS_BRANCH_RE)).cast("long"),
            "typed_functions": F.least(F.regexp_count("src", F.lit(TS_RETURN_RE)), F.size("functions")).cast("long")}


def extract_ts_facts(files: DataFrame) -> DataFrame:
    """TS/JS facts by regex; language 'typescript' for all six suffixes."""
    return extract_all_facts(files, ("typescript",))


# Go patterns.
GO_FUNC_RE = r"(?U)\bfunc\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?(\w+)\s*\("
GO_TYPE_RE = r"(?U)\btype\s+(\w+)\s+(?:struct|interface)\b"
GO_IMPORT_BLOCK_RE = r"(?s)import\s*\(([^)]*)\)"
GO_IMPORT_SINGLE_RE = r"""import\s+"([^"]+)\""""
GO_IMPORT_PATH_RE = r"""\"([^"]+)\""""
GO_RETURN_RE = r"(?U)\bfunc\s+(?:\([^)]+\)\s+)?\w+\s*\([^)]*\)\s+\(?[\w\*\[\]]+"
GO_BRANCH_RE = r"(?U)\bif\b|\bfor\b|\bswitch\b|\bcase\b|\bselect\b"


def _go_columns() -> dict[str, Column]:
    """Facts of a row with ``src``, ``functions`` and ``blocks``; single imports
    count only when no import block exists."""
    singles = F.regexp_extract_all("src", F.lit(GO_IMPORT_SINGLE_RE), 1)
    in_blocks = F.flatten(F.transform("blocks", lambda b: F.regexp_extract_all(b, F.lit(GO_IMPORT_PATH_RE), 1)))
    return {"classes": F.regexp_extract_all("src", F.lit(GO_TYPE_RE), 1),
            "imports": F.transform(F.when(F.size("blocks") > 0, in_blocks).otherwise(singles),
                                   lambda p: F.substring_index(p, "/", -1)),
            "complexity": F.regexp_count("src", F.lit(GO_BRANCH_RE)).cast("long"),
            "typed_functions": F.least(F.regexp_count("src", F.lit(GO_RETURN_RE)), F.size("functions")).cast("long")}


def extract_go_facts(files: DataFrame) -> DataFrame:
    """Go facts by regex."""
    return extract_all_facts(files, ("go",))


def extract_all_facts(files: DataFrame, languages=("python", "typescript", "go")) -> DataFrame:
    """The facts of all files in one pass over the texts.  A row's language
    decides which branch computes it: native expressions for TypeScript and Go,
    while only Python texts are sent to the parser (other rows send a null)."""
    rows = parse_scope(files).withColumn("language", _language()).where(F.col("language").isin(*languages)).select(
        "project", "path", "language", F.col("content").alias("src"))
    lang, src = F.col("language"), F.col("src")
    step, columns = [], {}
    functions = F.lit(None).cast("array<string>")
    if "typescript" in languages:
        functions = F.when(lang == "typescript", _two_group(src, TS_FUNC_RE)).otherwise(functions)
        columns["typescript"] = _ts_columns()
    if "go" in languages:
        functions = F.when(lang == "go", F.regexp_extract_all("src", F.lit(GO_FUNC_RE), 1)).otherwise(functions)
        step.append(F.when(lang == "go", F.regexp_extract_all("src", F.lit(GO_IMPORT_BLOCK_RE), 1)).alias("blocks"))
        columns["go"] = _go_columns()
    if "python" in languages:
        step.append(_python_facts_udf()(F.when(lang == "python", src)).alias("py"))
        columns["python"] = {c: F.col(f"py.{c}") for c in ("classes", "imports", "complexity", "typed_functions")}
    pre = rows.select("project", "path", "language", "src", functions.alias("functions"), *step)

    def of(name: str) -> Column:
        out = None
        for k, c in columns.items():
            out = F.when(lang == k, c[name]) if out is None else out.when(lang == k, c[name])
        return out.alias(name)

    python = "python" in languages
    own = F.when(lang == "python", F.col("py.functions")).otherwise(F.col("functions")) if python else F.col("functions")
    broken = F.when(lang == "python", F.col("py.has_syntax_error")).otherwise(False) if python else F.lit(False)
    return pre.select("project", "path", "language", line_count("src").cast("long").alias("lines"), own.alias("functions"), of("classes"),
                      of("imports"), of("complexity"), of("typed_functions"), broken.alias("has_syntax_error"))


def detect_languages(files: DataFrame) -> DataFrame:
    """Extra languages present per project (any file with the suffix;
    directories are not filtered, as in the reference)."""
    ts = F.max(F.exists(F.array(*[F.lit(e) for e in TS_EXTENSIONS]), lambda e: F.col("path").endswith(e)).cast("int"))
    go = F.max(F.col("path").endswith(".go").cast("int"))
    g = files.groupBy("project").agg(ts.alias("has_ts"), go.alias("has_go"))
    langs = F.array_compact(F.array(F.when(F.col("has_go") == 1, F.lit("go")),
                                    F.when(F.col("has_ts") == 1, F.lit("typescript"))))
    return g.select("project", langs.alias("extra_languages"))


def with_derived(facts: DataFrame) -> DataFrame:
    """Generated columns of a code_facts row: counts and type coverage."""
    return (facts.withColumn("function_count", F.size("functions").cast("long"))
            .withColumn("class_count", F.size("classes").cast("long"))
            .withColumn("type_coverage", F.when(F.size("functions") > 0,
                                                F.col("typed_functions") / F.size("functions") * 100.0)
                        .otherwise(F.lit(0.0))))
