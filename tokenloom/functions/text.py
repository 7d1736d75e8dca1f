"""Text scalar functions (C1, C2, C3, C6, C7): Catalyst expressions only."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define the results (must stay as written):
# identifier tokens are ASCII words of length >= 3, lower-cased.
WORD_TOKEN_RE = r"([a-zA-Z_][a-zA-Z0-9_]{2,})"

# Native token approximation: one token per pre-tokenizer piece of the
# cl100k-style splitting rule (contractions, letter runs with one leading
# symbol, up to three digits, punctuation runs, newline runs, spaces).
# Same matches in Java regex and RE2, so the DuckDB oracle can count it too.
APPROX_TOKEN_RE = (
    r"'(?:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column | str) -> Column:
    """Lower-case ASCII letters only (identifier tokens are ASCII)."""
    return F.translate(_c(text), _UPPER, _LOWER)


def word_tokens(text: Column | str) -> Column:
    """Identifier-like words of length >= 3, lower-cased, in text order."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD_TOKEN_RE), 1)


def word_token_count(text: Column | str) -> Column:
    """Number of C1 tokens without building the array."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(WORD_TOKEN_RE)), F.lit(0))


def keyword_hits(text: Column | str, keywords: list[str]) -> Column:
    """C1 tokens of ``text`` that equal one of ``keywords`` (lower-case
    identifiers), in text order.  One regex pass: a token starts at a letter or
    '_' whose run so far holds only digits, and ends where the run ends."""
    alt = "|".join(sorted(set(keywords), key=lambda k: (-len(k), k)))
    rx = rf"(?<![a-z0-9_])[0-9]*({alt})(?![a-z0-9_])"
    return F.regexp_extract_all(ascii_lower(text), F.lit(rx), 1)


def line_count(text: Column | str) -> Column:
    """Newline count + 1 (an empty text has one line)."""
    t = _c(text)
    return (F.length(t) - F.length(F.regexp_replace(t, "\n", "")) + 1).cast("long")


def approx_tokens(text: Column | str) -> Column:
    """C3 (native counter): number of pre-token pieces; null text counts 0."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(APPROX_TOKEN_RE)), F.lit(0)).cast("long")


def split_lines(text: Column | str) -> Column:
    """Lines of a text; a trailing newline does not yield an extra empty line."""
    t = _c(text)
    return F.split(F.regexp_replace(t, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")


def pystrip(text: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def signature_lines(source: Column | str) -> Column:
    """``def``/``async def``/``class`` lines, trailing ':' removed, whitespace
    collapsed, indented by two spaces per four leading characters."""
    lines = split_lines(source)
    sig = F.filter(lines, lambda ln: ln.rlike(r"^\s*(def |async def |class )"))

    def render(ln: Column) -> Column:
        stripped = F.regexp_replace(ln, r"^\s+", "")
        indent = F.length(ln) - F.length(stripped)
        body = F.regexp_replace(F.regexp_replace(stripped, r":+$", ""), r"\s+$", "")
        body = F.regexp_replace(body, r"\s+", " ")
        return F.concat(F.repeat(F.lit("  "), F.floor(indent / 4).cast("int")), body)

    return F.transform(sig, render)


# Full-line comment prefixes per file extension (markdown has none).
COMMENT_PREFIXES = {
    "toml": "#",
    "cfg": "#;",
    "ini": "#;",
    "yml": "#",
    "yaml": "#",
    "env": "#",
}


def comment_prefixes(ext: Column | str) -> Column:
    """Characters that start a whole-line comment for an extension ('' if none)."""
    e = _c(ext)
    out = F.lit("")
    for k, v in COMMENT_PREFIXES.items():
        out = F.when(e == k, F.lit(v)).otherwise(out)
    return out


def strip_boilerplate(text: Column | str, ext: Column | str) -> Column:
    """Drop blank lines and whole-line comments; keep inline comments.

    The text is stripped first, as the snapshot builder does.
    """
    prefix = comment_prefixes(ext)

    def keep(ln: Column) -> Column:
        s = pystrip(ln)
        first = F.substring(s, 1, 1)
        return (s != "") & ~((F.length(prefix) > 0) & prefix.contains(first))

    return F.array_join(F.filter(split_lines(pystrip(text)), keep), "\n")
