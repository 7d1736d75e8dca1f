"""Grades, labels and money."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import _c

# USD per token for input, output, cache write, cache read.
PRICE_INPUT = 3.00 / 1_000_000
PRICE_OUTPUT = 15.00 / 1_000_000
PRICE_CACHE_WRITE = 3.75 / 1_000_000
PRICE_CACHE_READ = 0.30 / 1_000_000


def session_cost(inp, out, cache_w, cache_r) -> Column:
    """Cost in USD rounded to 5 places."""
    return F.round(
        _c(inp) * PRICE_INPUT + _c(out) * PRICE_OUTPUT
        + _c(cache_w) * PRICE_CACHE_WRITE + _c(cache_r) * PRICE_CACHE_READ, 5)


def human_count(n: Column | str) -> Column:
    """C14: 1.23M / 4.5k / n."""
    x = _c(n)
    return (F.when(x >= 1_000_000, F.concat(F.format_number(x / 1_000_000, 2), F.lit("M")))
            .when(x >= 1_000, F.concat(F.format_string("%.1f", x / 1_000), F.lit("k")))
            .otherwise(x.cast("string")))


def savings_pct(baseline: Column | str, optimized: Column | str) -> Column:
    """(b - o) / b * 100, 0 when b = 0."""
    b, o = _c(baseline), _c(optimized)
    return F.when(b > 0, (b - o) / b * 100.0).otherwise(F.lit(0.0))


def reduction_pct(part: Column | str, whole: Column | str) -> Column:
    """C17: round((1 - part/whole) * 100, 1), 0 when whole = 0."""
    p, w = _c(part), _c(whole)
    return F.when(w > 0, F.round((1 - p / w) * 100.0, 1)).otherwise(F.lit(0.0))


def complexity_grade(cx: Column | str) -> Column:
    x = _c(cx)
    return F.when(x <= 5, "A").when(x <= 10, "B").when(x <= 20, "C").otherwise("D")


def health_grade(total: Column | str) -> Column:
    t = _c(total)
    return F.when(t >= 90, "A").when(t >= 75, "B").when(t >= 60, "C").otherwise("D")


def share_band(pct: Column | str) -> Column:
    p = _c(pct)
    return F.when(p > 20, "high").when(p > 5, "medium").otherwise("low")


# Directory groups and the reason shown for each.
DIR_REASONS = [
    (("docs", "doc", "documentation"), "Documentation rarely needed during coding"),
    (("examples", "example", "samples", "demo", "demos"), "Example files add noise without context value"),
    (("migrations", "alembic"), "DB migration history not needed in context"),
    (("static", "assets", "public", "media"), "Static assets are not source code"),
    (("coverage", "htmlcov", "reports"), "Test reports are generated output"),
    (("vendor", "third_party", "third-party"), "Vendored dependencies should be excluded"),
    (("node_modules", "bower_components"), "JS dependency tree — exclude entirely"),
    (("dist", "build", "out", "output"), "Build output is not source"),
    (("logs", "log"), "Log files are runtime output"),
]


def classify_dir(name: Column | str) -> Column:
    """C11: reason text for a top-level directory."""
    n = F.lower(_c(name))
    expr = None
    for names, reason in DIR_REASONS:
        expr = (F.when(n.isin(*names), reason) if expr is None else expr.when(n.isin(*names), reason))
    return expr.otherwise(F.concat(F.lit("'"), _c(name), F.lit("/' directory — check if needed in context")))
