"""Task focus: W7 rank_files, J3 related_files, A9 focus_budget.

The query is a parameter: its keywords become a literal array, so scoring
is a row-local expression over each file (no explode, no shuffle before the
top-k).  The per-project top-k is a ``row_number`` filter, which Spark plans
as a partial window-group limit before the shuffle.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.text import approx_tokens, keyword_hits, word_token_count, word_tokens


def query_keywords(query: str) -> list[str]:
    """Distinct keywords of a task text (same rule as ``word_tokens``), sorted."""
    return sorted({w.lower() for w in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]*", query) if len(w) >= 3})


def _count_pred(k: str):
    return lambda t: t == k


def focus_score(keywords: list[str], path: Column, content: Column) -> Column:
    """Unrounded relevance score of one file for the given keywords (one
    expression; for large inputs use ``scored_files`` which evaluates the two
    regex passes once per row)."""
    if not keywords:
        return F.lit(0.0)
    return _score_from(keywords, word_tokens(path), keyword_hits(content, keywords), word_token_count(content))


def _score_from(keywords: list[str], ptoks: Column, hits: Column, n_tokens: Column) -> Column:
    total = F.lit(0.0)
    for k in keywords:
        in_path = F.exists(ptoks, _contains_of(k))
        cnt = F.size(F.filter(hits, _count_pred(k)))
        total = (total + F.when(in_path, F.lit(3.0)).otherwise(F.lit(0.0))
                 + F.when(cnt > 0, F.lit(1.0) + F.least(cnt - 1, F.lit(4)) * 0.2).otherwise(F.lit(0.0)))
    return total / F.greatest(F.lit(1.0), n_tokens / 500.0)


def scored_files(files: DataFrame, keywords: list[str], keep=()) -> DataFrame:
    """Adds ``raw_score``.  One regex pass per text: the identifier tokens
    are extracted once (projected, so Spark does not inline the extraction
    into each use); the token count and the keyword hits come from that array."""
    if not keywords:
        return files.select("project", "path", *keep, F.lit(0.0).alias("raw_score"))
    pre = files.select("project", "path", *keep, word_tokens("content").alias("_toks"),
                       word_tokens("path").alias("_ptoks"))
    mid = pre.select("project", "path", *keep, "_ptoks", F.size("_toks").alias("_ntok"),
                     F.filter("_toks", lambda t: t.isin(*keywords)).alias("_hits"))
    return mid.select("project", "path", *keep,
                      _score_from(keywords, F.col("_ptoks"), F.col("_hits"), F.col("_ntok")).alias("raw_score"))


def _contains_of(k: str):
    return lambda t: t.contains(k)


def focus_reason(keywords: list[str], path: Column, content: Column, lowered: Column | None = None) -> Column:
    """``path:k1,k2 | content:k1,...`` (content part at most 5 keywords);
    substring tests on the lower-cased path and text.  Pass ``lowered`` when
    the lower-cased text is already a column."""
    lp, lc = F.lower(path), (lowered if lowered is not None else F.lower(content))
    in_path = [F.when(lp.contains(k), F.lit(k)) for k in keywords]
    in_content = [F.when(lc.contains(k), F.lit(k)) for k in keywords]
    if not keywords:
        return F.lit("")
    ip = F.filter(F.array(*in_path), lambda x: x.isNotNull())
    ic = F.slice(F.filter(F.array(*in_content), lambda x: x.isNotNull()), 1, 5)
    p = F.when(F.size(ip) > 0, F.concat(F.lit("path:"), F.array_join(ip, ",")))
    c = F.when(F.size(ic) > 0, F.concat(F.lit("content:"), F.array_join(ic, ",")))
    return F.concat_ws(" | ", p, c)


def rank_files(files: DataFrame, query: str, top: int = 8, rules: DataFrame | None = None,
               tokens_col: str | None = None) -> DataFrame:
    """Per project, the ``top`` files most relevant to ``query``.

    Output ``project, rank, path, score, tokens, reason``; ties by path.
    ``rules`` (F1-F3 visibility, default dirs when a project has none) decide
    on paths first, so the text of an ignored file is never tokenised; the rule
    rows are broadcast while they are small.  Score, tokens and reason are then
    computed row-locally and only narrow rows enter the per-project top-k.
    Pass ``tokens_col`` when the files already carry U4 token counts.
    """
    from tokenloom.operators.filters import visible, with_rule_match

    kws = query_keywords(query)
    # every expression over the text in one projection: the text is lowered
    # and tokenised once per file
    tok = F.col(tokens_col) if tokens_col else approx_tokens("content")
    if rules is not None:
        files = with_rule_match(files, rules).where(visible(egg_info_suffix=False))
    pre = files.select("project", "path", tok.alias("tokens"), F.lower("content").alias("_lc"),
                       word_tokens("content").alias("_toks"), word_tokens("path").alias("_ptoks"))
    mid = pre.select("project", "path", "tokens", "_ptoks", F.size("_toks").alias("_ntok"),
                     F.filter("_toks", lambda t: t.isin(*kws)).alias("_hits") if kws else F.array().alias("_hits"),
                     focus_reason(kws, F.col("path"), None, F.col("_lc")).alias("reason"))
    raw = _score_from(kws, F.col("_ptoks"), F.col("_hits"), F.col("_ntok")) if kws else F.lit(0.0)
    # The "score > 0" test is applied after ranking (positive scores sort
    # first): a filter before it would be pushed below the projection and
    # re-evaluate the score expression per use.
    hits = (mid.select("project", "path", raw.alias("raw_score"), "tokens", "reason")
            .withColumn("score", F.round("raw_score", 2)))
    w = Window.partitionBy("project").orderBy(F.desc("score"), F.desc(F.col("raw_score") > 0), "path")
    ranked = (hits.withColumn("rank", F.row_number().over(w))
              .where((F.col("rank") <= top) & (F.col("raw_score") > 0)))
    return ranked.select("project", F.col("rank").cast("long"), "path", "score", F.col("tokens").cast("long"), "reason")


def related_files(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of each ranked file: successors ('imports') then
    predecessors ('imported_by'); an empty array when the file has none."""
    out_e = edges.select("project", F.col("src").alias("path"), F.col("dst").alias("file"),
                         F.lit("imports").alias("relation"), F.lit(0).alias("o"))
    in_e = edges.select("project", F.col("dst").alias("path"), F.col("src").alias("file"),
                        F.lit("imported_by").alias("relation"), F.lit(1).alias("o"))
    nb = out_e.unionByName(in_e).join(ranked.select("project", "path"), ["project", "path"], "left_semi")
    grouped = nb.groupBy("project", "path").agg(
        F.array_sort(F.collect_list(F.struct("o", "file", "relation"))).alias("rel"))
    rel = F.transform(F.col("rel"), lambda s: F.struct(s["file"].alias("file"), s["relation"].alias("relation")))
    return (ranked.join(grouped, ["project", "path"], "left")
            .withColumn("related", F.coalesce(rel, F.array().cast("array<struct<file:string,relation:string>>")))
            .drop("rel"))


def rank_files_with_context(files: DataFrame, query: str, edges: DataFrame, top: int = 8, rules: DataFrame | None = None,
                            tokens_col: str | None = None) -> DataFrame:
    """W7 + J3: the ranked files, each with its import neighbours; neighbours are
    named beside a result and are no results themselves."""
    return related_files(rank_files(files, query, top, rules, tokens_col), edges)


def focus_budget(ranked: DataFrame, budget: DataFrame) -> DataFrame:
    """Tokens of the ranked files vs the optimized project total."""
    r = ranked.groupBy("project").agg(F.sum("tokens").cast("long").alias("focus_tokens"),
                                      F.count(F.lit(1)).alias("n_files"))
    j = r.join(budget.select("project", F.col("optimized").alias("project_tokens")), "project")
    saved = F.col("project_tokens") - F.col("focus_tokens")
    return j.select("project", F.col("n_files").cast("long"), "focus_tokens", "project_tokens",
                    saved.cast("long").alias("saved_tokens"),
                    F.when(F.col("project_tokens") > 0, F.round(saved / F.col("project_tokens") * 100.0, 1))
                     .otherwise(F.lit(0.0)).alias("saved_pct"))


def rank_files_batch(files: DataFrame, queries: DataFrame, top: int = 8) -> DataFrame:
    """W7, batch form: many task texts at once, ``queries(project, query_id,
    query)``; each query ranks the files of its project.

    Without a cross join: file tokens that are keywords of the project (the
    keyword set is broadcast after a size check) are counted per file, path
    tokens meet the keywords through their stretches of the keywords' lengths
    (equi-join; rows grow with a token's length, not its square), and the
    per-keyword parts are summed per (query, file).  ``files`` must be the
    visible set.  Output ``project, query_id, rank, path, score``.
    """
    from tokenloom.session import small_side

    kw = queries.select("project", "query_id",
                        F.explode(F.array_distinct(word_tokens("query"))).alias("kw")).distinct()
    kwset = small_side(kw.select("project", F.col("kw").alias("tok")).distinct())
    base = files.select("project", "path", word_tokens("content").alias("_toks"), word_tokens("path").alias("_ptoks"))
    ntok = base.select("project", "path", F.size("_toks").alias("ntok"))
    counts = (base.select("project", "path", F.explode("_toks").alias("tok"))
              .join(kwset, ["project", "tok"], "left_semi")
              .groupBy("project", "path", "tok").agg(F.count(F.lit(1)).alias("cnt")))
    content_part = counts.join(kw.withColumnRenamed("kw", "tok"), ["project", "tok"]).select(
        "project", "query_id", "path", (F.lit(1.0) + F.least(F.col("cnt") - 1, F.lit(4)) * 0.2).alias("v"))
    # stretches of a path token of the lengths that the project's keywords have
    sizes = small_side(kw.groupBy("project").agg(F.collect_set(F.length("kw")).alias("sizes")))
    of_size = lambda t: lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))
    subs = base.join(sizes, "project").select("project", "path", F.explode(F.array_distinct(F.flatten(F.flatten(F.transform(
        "_ptoks", lambda t: F.transform(F.filter("sizes", lambda n: n <= F.length(t)), of_size(t))))))).alias("tok"))
    path_part = (subs.join(kwset, ["project", "tok"], "left_semi")
                 .join(kw.withColumnRenamed("kw", "tok"), ["project", "tok"])
                 .select("project", "query_id", "path", F.lit(3.0).alias("v")).distinct())
    parts = content_part.unionByName(path_part)
    raw = (parts.groupBy("project", "query_id", "path").agg(F.sum("v").alias("s"))
           .join(ntok, ["project", "path"])
           .select("project", "query_id", "path",
                   (F.col("s") / F.greatest(F.lit(1.0), F.col("ntok") / 500.0)).alias("raw_score")))
    scored = raw.where(F.col("raw_score") > 0).withColumn("score", F.round("raw_score", 2))
    w = Window.partitionBy("project", "query_id").orderBy(F.desc("score"), "path")
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("project", "query_id", F.col("rank").cast("long"), "path", "score"))
