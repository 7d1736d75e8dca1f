"""Path scalar functions (C4, C5, C9, C10, C15) and glob translation."""
from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import _c


def path_parts(path: Column | str) -> Column:
    """POSIX parts of a relative path."""
    return F.split(_c(path), "/")


def basename(path: Column | str) -> Column:
    return F.element_at(path_parts(path), -1)


def top_dir(path: Column | str) -> Column:
    """First part when the path has more than one part, else ''."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(""))


def extension(path: Column | str) -> Column:
    """C5: '.' + text after the last '.' of the whole path, '' when no '.'."""
    p = _c(path)
    return F.when(F.instr(p, ".") > 0, F.concat(F.lit("."), F.substring_index(p, ".", -1))).otherwise(F.lit(""))


def suffix(path: Column | str) -> Column:
    """Suffix of the file name (pathlib rule): '' for dot-files, names without
    '.', and names ending in '.'."""
    return F.regexp_extract(basename(path), r".(\.[^.]+)$", 1)


def import_root(module: Column | str) -> Column:
    """Text before the first '.'."""
    return F.substring_index(_c(module), ".", 1)


def module_candidates(module: Column | str) -> Column:
    """``a.b`` -> [(0, 'a/b.py'), (1, 'a/b/__init__.py')]."""
    base = F.regexp_replace(_c(module), r"\.", "/")
    return F.array(
        F.struct(F.lit(0).alias("prio"), F.concat(base, F.lit(".py")).alias("path")),
        F.struct(F.lit(1).alias("prio"), F.concat(base, F.lit("/__init__.py")).alias("path")),
    )


def file_sig(mtime: Column | str, size: Column | str) -> Column:
    """``<mtime in ns>:<size>``."""
    return F.concat_ws(":", (F.unix_micros(_c(mtime)) * 1000).cast("string"), _c(size).cast("string"))


def _glob_regex(pattern: str, within_part: bool) -> str:
    """Java regex body of one fnmatch pattern.  A set that can match nothing
    becomes a pattern that never matches; nothing here can fail to compile."""
    any_char = "[^/]" if within_part else "."
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(any_char + "*")
        elif c == "?":
            out.append(any_char)
        elif c == "[":
            negated = pattern[i:i + 1] == "!"
            first = i + negated
            close = pattern.find("]", first + 1)  # a ']' in first place is a member
            if close < 0:
                out.append("\\[")
                continue
            out.append(_set_regex(pattern[first:close], negated, within_part))
            i = close + 1
        else:
            out.append(c if c.isalnum() or c == "_" else "\\" + c if ord(c) < 128 else c)
    return "".join(out)


def _set_regex(members: str, negated: bool, within_part: bool) -> str:
    """A bracket set: single members and ascending ranges; descending ranges are empty."""
    def quote(c: str) -> str:
        return "\\" + c if ord(c) < 128 and not c.isalnum() else c

    parts, i = [], 0
    while i < len(members):
        if i + 2 < len(members) and members[i + 1] == "-":
            if members[i] <= members[i + 2]:
                parts.append(f"{quote(members[i])}-{quote(members[i + 2])}")
            i += 3
        else:
            parts.append(quote(members[i]))
            i += 1
    if negated:
        return "[^" + "".join(parts) + ("/" if within_part else "") + "]" if parts or within_part else "."
    return "[" + "".join(parts) + "]" if parts else "(?!)"


def glob_to_regex(pattern: Column | str, within_part: bool = False) -> Column:
    """C4: fnmatch pattern -> regex body (caller anchors it; dot matches all).

    Runs once per distinct rule, before any join.  With ``within_part`` the
    wildcards and negated sets cannot cross ``/`` (used to test every path
    part with one regex).
    """
    @F.pandas_udf("string")
    def translate(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else _glob_regex(p, within_part))

    return translate(_c(pattern))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
