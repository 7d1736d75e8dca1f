"""Path filters and predicates."""
from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.paths import _glob_regex, path_parts, suffix

# Suffixes never read as text.
BINARY_SUFFIXES = (".pyc", ".pyo", ".exe", ".dll", ".so", ".dylib",
                   ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico",
                   ".zip", ".gz", ".tar", ".whl", ".db", ".sqlite")

# The three directory sets.
PARSE_IGNORE_DIRS = (".venv", "venv", "__pycache__", ".git", "node_modules",
                     "dist", "build", ".egg-info", ".pytest_cache", ".mypy_cache")
DEFAULT_IGNORE_DIRS = (".venv", "venv", "__pycache__", ".git", "node_modules",
                       "dist", "build", "egg-info", ".pytest_cache", ".mypy_cache")
BASELINE_SKIP_DIRS = (".venv", "venv", "env", ".git", "node_modules", "__pycache__")
TEST_DIRS = ("tests", "test", "test-project")

DIR_SETS = {"parse": PARSE_IGNORE_DIRS, "default": DEFAULT_IGNORE_DIRS, "baseline": BASELINE_SKIP_DIRS}


def is_binary(path: Column | str = "path") -> Column:
    """F1 predicate: lower-cased file suffix is a binary one."""
    return F.lower(suffix(path)).isin(*BINARY_SUFFIXES)


def drop_binary(files: DataFrame) -> DataFrame:
    """F1."""
    return files.where(~is_binary("path"))


def in_dirs(which: str = "default", extra=(), egg_info_suffix: bool = False,
            path: Column | str = "path") -> Column:
    """F2 predicate: some relative path part is in the chosen set (plus extras)."""
    names = tuple(DIR_SETS[which]) + tuple(extra)
    parts = path_parts(path)
    cond = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    if egg_info_suffix:
        cond = cond | F.exists(parts, lambda p: p.endswith(".egg-info"))
    return cond


def exclude_dirs(files: DataFrame, which: str = "default", extra=(), egg_info_suffix: bool = False) -> DataFrame:
    """F2."""
    return files.where(~in_dirs(which, extra, egg_info_suffix))


def is_test_path(path: Column | str = "path") -> Column:
    return F.arrays_overlap(path_parts(path), F.array(*[F.lit(n) for n in TEST_DIRS]))


def source_only(files: DataFrame) -> DataFrame:
    """drop files below tests / test / test-project."""
    return files.where(~is_test_path("path"))


#: Distinct general globs up to which each becomes a constant pattern of the plan.
CONSTANT_GLOBS = 64


def rule_sets(rules: DataFrame) -> DataFrame:
    """Per project, the rules by kind (one row per project, native expressions).

    ``rule_parts``: the patterns without trailing '/', compared with path parts
    and, without wildcards, with the whole path; ``affixes``: patterns of one
    ``*`` as what stands before and after it; ``inner``: patterns ``*text*``;
    ``globs``: all others (``?``, sets, more stars)."""
    r = rules.select("project", F.regexp_replace(F.col("pattern"), "/+$", "").alias("p"))
    plain = ~F.col("p").rlike("[?\\[]")
    stars = F.length("p") - F.length(F.replace("p", F.lit("*")))
    inner = plain & F.col("p").rlike("^\\*[^*]*\\*$") & (stars == 2)
    affix = F.struct(F.substring_index("p", "*", 1).alias("pre"), F.substring_index("p", "*", -1).alias("suf"))
    kind = F.when(plain & (stars == 0), "name").when(plain & (stars == 1), "affix").when(inner, "inner").otherwise("glob")
    r = r.withColumn("kind", kind)
    return r.groupBy("project").agg(
        F.collect_set("p").alias("rule_parts"),
        F.collect_set(F.when(F.col("kind") == "affix", affix)).alias("affixes"),
        F.collect_set(F.when(F.col("kind") == "inner", F.expr("substring(p, 2, length(p) - 2)"))).alias("inner"),
        F.collect_set(F.when(F.col("kind") == "glob", F.col("p"))).alias("globs"))


def _glob_matcher():
    """Any glob of a row's list against its path or one of the parts; one compiled
    matcher per list and Python process."""
    @F.pandas_udf(T.BooleanType())
    def match(paths: pd.Series, globs: pd.Series) -> pd.Series:
        compiled: dict[tuple, re.Pattern] = {}

        def of(names):
            key = tuple(names)
            if key not in compiled:
                compiled[key] = re.compile("|".join(f"(?:{fnmatch.translate(p)})" for p in key))
            return compiled[key].match
        return pd.Series([names is not None and len(names) > 0 and any(map(of(names), (path, *path.split("/"))))
                          for path, names in zip(paths, globs)], dtype=bool)
    return match


def _matches_globs(globs: list[str] | None) -> Column:
    """``path`` against the project's general globs: constant patterns where the
    plan knows them all, a compiled matcher per project otherwise."""
    if globs is None:
        return _glob_matcher()(F.col("path"), F.col("globs"))
    out = F.lit(False)
    for g in globs:
        whole, part = (f"(?s)\\A(?:{_glob_regex(g, within)})\\z" for within in (False, True))
        out = out | (F.array_contains("globs", g) & (F.col("path").rlike(whole) | F.exists(path_parts("path"), lambda x: x.rlike(part))))
    return out


def with_rule_match(files: DataFrame, rules: DataFrame, constant_globs: int = CONSTANT_GLOBS) -> DataFrame:
    """F3 building block: adds ``has_rules`` and ``rule_ignored`` to ``files``.

    The per-project rule rows (one per project with rules) are materialised
    and broadcast when their measured size is small: the file side is then
    not shuffled at all, and a later per-project top-k can cut rows before
    its own shuffle.  A large rule table is joined by shuffle instead.  Names,
    prefixes and suffixes are string comparisons on the row; no pattern is
    compiled per row.
    """
    from tokenloom.session import small_side
    rs = small_side(rule_sets(rules))
    # at most one more than fit the plan
    known = [r.g for r in rs.select(F.explode("globs").alias("g")).distinct().limit(constant_globs + 1).collect()]
    j = files.join(rs, "project", "left")
    names = path_parts("path")
    fits = F.exists(F.array_append(names, F.col("path")), lambda x: F.exists("affixes", lambda a: (
        F.length(x) >= F.length(a["pre"]) + F.length(a["suf"])) & x.startswith(a["pre"]) & x.endswith(a["suf"])))
    matched = (F.arrays_overlap(names, F.col("rule_parts")) | F.array_contains("rule_parts", F.col("path")) & ~F.col("path").rlike("[*?\\[]")
               | fits | F.exists("inner", lambda x: F.col("path").contains(x)))
    if known:
        matched = matched | _matches_globs(sorted(known) if len(known) <= constant_globs else None)
    return (j.withColumn("has_rules", F.col("rule_parts").isNotNull())
             .withColumn("rule_ignored", F.coalesce(matched, F.lit(False)))
             .drop("rule_parts", "affixes", "inner", "globs"))


def apply_ignore_rules(files: DataFrame, rules: DataFrame, extra=()) -> DataFrame:
    """the optimized file set.  Rules replace the default directories;
    a project without rules falls back to F2 (default set + extras + egg-info)."""
    return with_token_flags(files, rules, extra).where("in_optimized").drop("in_baseline", "in_optimized", "has_rules", "rule_ignored")


def visible(egg_info_suffix: bool, extra=()):
    """Predicate on a ``with_rule_match`` row: the project's rules if it has
    any, else the default directories (+ extras, + egg-info suffix)."""
    return ~is_binary("path") & F.when(F.col("has_rules"), ~F.col("rule_ignored")).otherwise(
        ~in_dirs("default", extra, egg_info_suffix=egg_info_suffix))


def with_token_flags(files: DataFrame, rules: DataFrame, extra=()) -> DataFrame:
    """Adds ``in_baseline`` and ``in_optimized`` (A3's two file sets) in one pass."""
    j = with_rule_match(files, rules)
    return (j.withColumn("in_baseline", ~is_binary("path") & ~in_dirs("baseline"))
             .withColumn("in_optimized", visible(True, extra)))


def slim_candidates_flags(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files seen by the rule suggester: not binary, outside the default dirs,
    and not already ignored by the project's rules."""
    j = with_rule_match(files, rules)
    return j.where(~is_binary("path") & ~in_dirs("default") & ~(F.col("has_rules") & F.col("rule_ignored")))


def recent(df: DataFrame, now: Column, hours: float, mtime_col: str = "mtime") -> DataFrame:
    """modified strictly after ``now - hours``."""
    return df.where(F.col(mtime_col) > now - F.make_interval(secs=F.lit(hours * 3600.0)))


# Extension sets.
TS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
GO_EXTENSIONS = (".go",)
DOC_EXTENSIONS = (".md", ".toml", ".cfg", ".ini", ".env", ".yml", ".yaml")


def by_suffix(files: DataFrame, suffixes) -> DataFrame:
    """files whose path ends with one of ``suffixes``."""
    cond = None
    for s in suffixes:
        c = F.col("path").endswith(s)
        cond = c if cond is None else cond | c
    return files.where(cond)


# Names never reported as unused.
SKIP_SYMBOLS = ("__init__", "__repr__", "__str__", "__eq__", "__hash__",
                "__len__", "__iter__", "__next__", "__enter__", "__exit__",
                "__call__", "__getitem__", "__setitem__", "__contains__",
                "main", "visit", "callback", "handler")


def is_public_symbol(sym: Column) -> Column:
    """F7 predicate."""
    return ~sym.startswith("_") & ~sym.isin(*SKIP_SYMBOLS)


def syntax_errors(facts: DataFrame, show: int = 5) -> DataFrame:
    """per project, number of files with a syntax error and the first
    ``show`` names (by path) plus "(+k more)"."""
    from pyspark.sql import Window
    bad = facts.where("has_syntax_error")
    w = Window.partitionBy("project").orderBy("path")
    first = (bad.select("project", "path").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= show)
             .groupBy("project").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("first_files")))
    return (bad.groupBy("project").agg(F.count(F.lit(1)).alias("n_errors")).join(first, "project")
        .withColumn("more", F.when(F.col("n_errors") > show,
                                   F.concat(F.lit(" (+"), (F.col("n_errors") - show).cast("string"), F.lit(" more)")))
                    .otherwise(F.lit("")))
        .withColumn("n_errors", F.col("n_errors").cast("long")))
