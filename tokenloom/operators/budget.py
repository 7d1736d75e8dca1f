"""Token budget family: A3, A4, A5, J4, W5, W6, A14.

Inputs are file rows ``(project, path, tokens)`` (tokens from U4) and the
parsed rule table ``(project, ord, pattern)``.  Every per-project total is a
``groupBy`` (partial + final aggregation), joined back where needed, so no
project is ever pulled into one task by a window over the whole project.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.paths import extension, top_dir
from tokenloom.functions.scores import classify_dir, savings_pct, share_band
from tokenloom.operators.filters import slim_candidates_flags, with_token_flags
from tokenloom.operators.ranking import ranked


def token_budget(files: DataFrame, rules: DataFrame, extra=()) -> DataFrame:
    """A3: baseline vs optimized tokens per project in one pass (conditional sums)."""
    f = with_token_flags(files, rules, extra)
    agg = f.groupBy("project").agg(
        F.sum(F.when(F.col("in_baseline"), F.col("tokens")).otherwise(0)).cast("long").alias("baseline"),
        F.sum(F.when(F.col("in_optimized"), F.col("tokens")).otherwise(0)).cast("long").alias("optimized"),
    )
    return (agg.withColumn("saved", (F.col("baseline") - F.col("optimized")).cast("long"))
               .withColumn("savings_pct", F.round(savings_pct("baseline", "optimized"), 1)))


def tokens_by_dir(slim_files: DataFrame) -> DataFrame:
    """A4: tokens and file count per top directory (files at the root have none)."""
    t = slim_files.withColumn("top", top_dir("path")).where(F.col("top") != "")
    return t.groupBy("project", "top").agg(F.sum("tokens").cast("long").alias("tokens"),
                                           F.count(F.lit(1)).alias("files"))


# code/doc extensions left out of the per-extension view, and the
# extensions worth a rule.
KEEP_EXTS = (".py", ".ts", ".js", ".go", ".rs", ".md")
NOISY_EXTS = (".lock", ".log", ".json", ".txt", ".csv", ".svg", ".html", ".css")
SKIP_SUGGEST_DIRS = ("src", "app", "lib", "core", "tests", "test")
SOURCE_PREFIXES = ("src/", "lib/", "app/", "core/")


def tokens_by_ext(slim_files: DataFrame) -> DataFrame:
    """A5: tokens and file count per extension of the whole path."""
    t = slim_files.withColumn("ext", extension("path")).where((F.col("ext") != "") & ~F.col("ext").isin(*KEEP_EXTS))
    return t.groupBy("project", "ext").agg(F.sum("tokens").cast("long").alias("tokens"),
                                           F.count(F.lit(1)).alias("files"))


def slim_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    return slim_candidates_flags(files, rules).select("project", "path", "tokens")


# Tokens from which a directory, an extension or a single file is suggested, and the reason texts.
DIR_TOKENS, EXT_TOKENS, FILE_TOKENS = 500, 300, 3000
EXT_REASON, FILE_REASON = " files rarely useful in context", ("Large file (", " tokens)")


def suggest_rules(files: DataFrame, rules: DataFrame, max_suggestions: int = 10, top_files: int = 20) -> DataFrame:
    """Rule suggestions per project ranked by tokens saved.

    Three candidate kinds (directory, noisy extension, single large file) are
    built as separate branches and unioned; the large-file branch drops a path
    that contains an already chosen pattern.  The containment test against
    directory and extension patterns is an equi-join on generated substrings
    (part suffixes + '/', and the eight '*.ext' strings), so no pairs are
    formed; only the <= ``top_files`` file candidates of one project are
    compared with each other.
    """
    from tokenloom.session import materialize
    # the (narrow) visible file set feeds five branches: compute it once
    sf = materialize(slim_files(files, rules))
    existing = rules.select("project", "pattern").distinct()

    dirs = (tokens_by_dir(sf)
            .where(~F.col("top").startswith(".") & ~F.col("top").isin(*SKIP_SUGGEST_DIRS) & (F.col("tokens") >= DIR_TOKENS))
            .select("project", F.concat("top", F.lit("/")).alias("pattern"), F.col("tokens").alias("saves_tokens"),
                    F.col("files").alias("files_affected"), classify_dir("top").alias("reason"), F.lit(0).alias("kind"))
            .join(existing, ["project", "pattern"], "left_anti"))
    exts = (tokens_by_ext(sf)
            .where((F.col("tokens") >= EXT_TOKENS) & F.col("ext").isin(*NOISY_EXTS))
            .select("project", F.concat(F.lit("*"), "ext").alias("pattern"), F.col("tokens").alias("saves_tokens"),
                    F.col("files").alias("files_affected"),
                    F.concat("ext", F.lit(EXT_REASON)).alias("reason"), F.lit(1).alias("kind"))
            .join(existing, ["project", "pattern"], "left_anti"))
    group_patterns = dirs.select("project", "pattern").unionByName(exts.select("project", "pattern"))

    w = Window.partitionBy("project").orderBy(F.desc("tokens"), "path")
    top = sf.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_files)
    big = materialize(top.where((F.col("tokens") > FILE_TOKENS) & ~F.exists(F.array(*[F.lit(p) for p in SOURCE_PREFIXES]),
                                                                      lambda p: F.col("path").startswith(p))))
    # substrings of the path that can equal a directory or extension pattern
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    dir_keys = F.flatten(F.transform(parts, lambda p: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(p), F.lit(1))), lambda i: F.concat(F.substring(p, i, F.length(p)), F.lit("/")))))
    ext_keys = F.filter(F.array(*[F.lit("*" + e) for e in NOISY_EXTS]), lambda x: F.col("path").contains(x))
    keys = big.select("project", "path", F.explode(F.array_union(dir_keys, ext_keys)).alias("pattern"))
    blocked = keys.join(group_patterns, ["project", "pattern"], "left_semi").select("project", "path").distinct()
    eligible = big.join(blocked, ["project", "path"], "left_anti")
    earlier = eligible.select("project", F.col("path").alias("p1"), F.col("rn").alias("rn1"))
    shadowed = (eligible.join(earlier, "project")
                .where((F.col("rn1") < F.col("rn")) & F.col("path").contains(F.col("p1")))
                .select("project", "path").distinct())
    files_c = (eligible.join(shadowed, ["project", "path"], "left_anti")
               .select("project", F.col("path").alias("pattern"), F.col("tokens").alias("saves_tokens"),
                       F.lit(1).cast("long").alias("files_affected"),
                       F.concat(F.lit(FILE_REASON[0]), F.format_number("tokens", 0), F.lit(FILE_REASON[1])).alias("reason"),
                       F.lit(2).alias("kind")))

    cands = dirs.unionByName(exts).unionByName(files_c)
    wr = Window.partitionBy("project").orderBy(F.desc("saves_tokens"), "kind", "pattern")
    return (cands.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= max_suggestions)
            .select("project", F.col("rank").cast("long"), "pattern", F.col("saves_tokens").cast("long"),
                    F.col("files_affected").cast("long"), "reason"))


def slim_report(files: DataFrame, rules: DataFrame, budget: int = 20_000, max_suggestions: int = 10) -> DataFrame:
    """Current tokens vs budget, savings of all suggestions capped at current."""
    current = token_budget(files, rules).select("project", F.col("optimized").alias("current_tokens"))
    sugg = suggest_rules(files, rules, max_suggestions).groupBy("project").agg(
        F.sum("saves_tokens").cast("long").alias("cumulative"), F.count(F.lit(1)).alias("n_suggestions"))
    r = current.join(sugg, "project", "left").fillna(0, ["cumulative", "n_suggestions"])
    potential = F.least(F.col("cumulative"), F.col("current_tokens"))
    return r.select(
        "project", "current_tokens", F.lit(budget).cast("long").alias("budget"),
        (F.col("current_tokens") > budget).alias("over_budget"),
        F.col("n_suggestions").cast("long").alias("n_suggestions"),
        potential.cast("long").alias("potential_savings"),
        (F.col("current_tokens") - potential).cast("long").alias("tokens_after"),
        F.when(F.col("current_tokens") > 0, F.round(potential / F.col("current_tokens") * 100.0, 1))
         .otherwise(F.lit(0.0)).alias("reduction_pct"))


def excluded_files(files: DataFrame, rules: DataFrame, top: int = 8) -> DataFrame:
    """Files in the baseline set but not in the optimized set; top ``top`` by
    tokens per project with the project's excluded total and count."""
    f = with_token_flags(files, rules).where(F.col("in_baseline") & ~F.col("in_optimized"))
    totals = f.groupBy("project").agg(F.count(F.lit(1)).alias("excluded_files"),
                                      F.sum("tokens").cast("long").alias("excluded_tokens"))
    w = Window.partitionBy("project").orderBy(F.desc("tokens"), "path")
    ranked = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return (ranked.join(totals, "project")
            .select("project", F.col("rank").cast("long"), "path", F.col("tokens").cast("long"), "excluded_files",
                    "excluded_tokens",
                    F.greatest(F.col("excluded_files") - top, F.lit(0)).cast("long").alias("more_files")))


def token_distribution(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Optimized files by tokens, largest first (ties by path), with their
    rank, their share of the project total and a band."""
    f = with_token_flags(files, rules).where("in_optimized").select("project", "path", "tokens")
    totals = f.groupBy("project").agg(F.sum("tokens").alias("total"))
    pct = F.when(F.col("total") > 0, F.col("tokens") / F.col("total") * 100.0).otherwise(F.lit(0.0))
    shares = (f.join(totals, "project")
              .select("project", "path", F.col("tokens").cast("long"), F.round(pct, 1).alias("pct"),
                      share_band(pct).alias("band")))
    return ranked(shares, F.desc("tokens"), F.asc("path"))
