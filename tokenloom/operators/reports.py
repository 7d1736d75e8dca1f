"""Report builders (R1-R7) and their token statistics (A9 is in focus, A10 here).

Trees, indexes and documents are rows: a document's line is ``(project, section,
sort_key, pos, line)``, ordered by these columns.  ``sinks.write_lines`` writes
the lines range-partitioned in that order and ``numbered`` gives them line
numbers, so a project of any size is never gathered into one task or cell.  Only
``as_text``, for projects known to be small, joins a project's lines to one text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.scores import reduction_pct
from tokenloom.functions.text import approx_tokens, pystrip, signature_lines, strip_boilerplate
from tokenloom.operators.filters import DOC_EXTENSIONS
from tokenloom.operators.ranking import ranked
from tokenloom.session import Tables


def _prefix_rows(paths: DataFrame, with_files: bool) -> DataFrame:
    """Directory prefixes (and optionally the files) of each path with the
    first path (in sort order) that shows them."""
    parts = F.split("path", "/")
    n = F.size(parts)
    dirs = paths.select("project", "path", F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).alias("i"),
                        parts.alias("parts"), n.alias("n")).where(F.col("i") < F.col("n"))
    d = (dirs.select("project", F.array_join(F.slice("parts", 1, F.col("i")), "/").alias("prefix"),
                     (F.col("i") - 1).alias("depth"), F.element_at("parts", F.col("i")).alias("name"), "path")
         .groupBy("project", "prefix", "depth", "name").agg(F.min("path").alias("sort_path"))
         .select("project", "sort_path", "depth", "name", F.lit(True).alias("is_dir")))
    if not with_files:
        return d
    f = paths.select("project", F.col("path").alias("sort_path"), (n - 1).alias("depth"),
                     F.element_at(parts, -1).alias("name"), F.lit(False).alias("is_dir"))
    return d.unionByName(f)


def file_tree(paths: DataFrame) -> DataFrame:
    """Indented tree lines of the visible files; a directory line comes
    right before the first file below it.  Order by (project, sort_path, depth)."""
    r = _prefix_rows(paths, with_files=True)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("  "), F.col("name"),
                    F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
    return r.select("project", "sort_path", F.col("depth").cast("long"), line.alias("line"))


def dir_tree(facts: DataFrame) -> DataFrame:
    """R2: directories only; a project without any gets "(flat project)"."""
    r = _prefix_rows(facts.select("project", "path"), with_files=False)
    rows = r.select("project", "sort_path", F.col("depth").cast("long"),
                    F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name"), F.lit("/")).alias("line"))
    flat = (facts.select("project").distinct().join(rows.select("project").distinct(), "project", "left_anti")
            .select("project", F.lit("").alias("sort_path"), F.lit(0).cast("long").alias("depth"),
                    F.lit("(flat project)").alias("line")))
    return rows.unionByName(flat)


def signature_index(files: DataFrame) -> DataFrame:
    """Per ``.py`` file its def/class signature lines (files without any dropped)."""
    py = files.where(F.col("path").endswith(".py"))
    s = py.select("project", "path", signature_lines("content").alias("sigs"))
    return s.where(F.size("sigs") > 0)


def small_docs(files: DataFrame, max_bytes: int = 4096) -> DataFrame:
    """doc/config files under ``max_bytes``, blank and comment lines removed."""
    cond = None
    for e in DOC_EXTENSIONS:
        c = F.col("path").endswith(e)
        cond = c if cond is None else cond | c
    d = files.where(cond & (F.col("size_bytes") < max_bytes))
    ext = F.substring_index("path", ".", -1)
    return d.select("project", "path", ext.alias("ext"), strip_boilerplate(pystrip("content"), ext).alias("body"))


LINE_ORDER = ("section", "sort_key", "pos")


def _lines(rows: DataFrame, section: int, lines: Column, key: Column | str | None = None) -> DataFrame:
    """One row per element of the array ``lines``."""
    key = F.lit("") if key is None else F.col(key) if isinstance(key, str) else key
    return rows.select("project", F.lit(section).cast("long").alias("section"), key.alias("sort_key"),
                       F.posexplode(lines).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def _said(*lines) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _stack(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numbered(lines: DataFrame) -> DataFrame:
    """A document's lines with ``line_no`` from 1 within the project."""
    return ranked(lines, *LINE_ORDER, name="line_no")


def as_text(lines: DataFrame) -> DataFrame:
    """(project, doc): all lines of a project in one string; for small projects."""
    g = lines.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "line"))).alias("s"))
    return g.select("project", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("doc"))


# Headings and sentences of the snapshot and the checkpoint.
SNAPSHOT_TITLE = "# Project Snapshot — "
SNAPSHOT_NOTE = "> Auto-generated snapshot. Read this file instead of individual source files."
SNAPSHOT_SECTIONS = ("## File Tree", "## Signatures", "## Config & Docs")
CHECKPOINT_NOTES = ("> Generated checkpoint. Paste this into a new conversation.",
                    "> Do NOT read source files — work only from the signatures below unless you need a specific file.")
NO_TASK = "_(describe what to do next)_"


def snapshot_lines(tree: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines of each project's snapshot: header, file tree, signatures
    (if it shows a Python file), small config and doc files (if any)."""
    projects = tree.select("project").distinct()
    python = tree.where(F.col("sort_path").endswith(".py")).select("project").distinct()
    tick = F.lit("`")
    return _stack(
        _lines(projects, 0, _said(F.concat(F.lit(SNAPSHOT_TITLE), "project"), "", SNAPSHOT_NOTE, "", SNAPSHOT_SECTIONS[0], "```")),
        tree.select("project", F.lit(1).cast("long").alias("section"), F.col("sort_path").alias("sort_key"), F.col("depth").alias("pos"), "line"),
        _lines(projects, 2, _said("```", "")),
        _lines(python, 3, _said(SNAPSHOT_SECTIONS[1], "")),
        _lines(sigs, 4, F.concat(_said(F.concat(F.lit("### `"), "path", tick), "```python"), "sigs", _said("```", "")), "path"),
        _lines(docs.select("project").distinct(), 5, _said(SNAPSHOT_SECTIONS[2], "")),
        _lines(docs, 6, F.concat(_said(F.concat(F.lit("### `"), "path", tick), F.concat(F.lit("```"), "ext")), F.split("body", "\n"),
                                 _said("```", "")), "path"))


def checkpoint_lines(snapshot: DataFrame, next_task: str = "") -> DataFrame:
    """R5, checkpoint form: the snapshot between a header and the next task."""
    projects = snapshot.select("project").distinct()
    head = _lines(projects, -1, _said(F.concat(F.lit("# "), "project", F.lit(" — Checkpoint")), "", *CHECKPOINT_NOTES, "",
                                      "## Project overview", ""))
    return _stack(head, snapshot, _lines(projects, 7, _said("## Next task", "", next_task.strip() or NO_TASK, "")))


def line_tokens(lines: DataFrame) -> DataFrame:
    """Tokens per project, counted line by line with the newline (partial sums)."""
    return lines.groupBy("project").agg(F.sum(approx_tokens(F.concat("line", F.lit("\n")))).cast("long").alias("tokens"))


def snapshot_stats(snapshot: DataFrame, budget: DataFrame) -> DataFrame:
    """A10: tokens of the snapshot's lines vs the optimized project tokens."""
    j = line_tokens(snapshot).withColumnRenamed("tokens", "snapshot_tokens").join(
        budget.select("project", F.col("optimized").alias("with_rules_tokens")), "project")
    return j.select("project", "with_rules_tokens", "snapshot_tokens",
                    reduction_pct("snapshot_tokens", "with_rules_tokens").alias("reduction_pct"))


# Rules recommended in the generated project doc.
RECOMMENDED_RULES = ["__pycache__/", "*.pyc", ".venv/", "venv/", ".git/", "*.egg-info/", "dist/", "build/",
                     ".pytest_cache/", ".mypy_cache/", "*.log", "*.lock"]
# Headings and sentences of the project doc.
GUIDE_TITLE, GUIDE_NOTES = "# Project guide", ("> Auto-generated.", "> Review and edit before committing.")
CORE = ("## Core Files (High Dependency Impact)", "", "Changes here affect many other modules - review carefully:", "",
        "| File | Imported by |", "|------|-------------|")
HOT = ("## Hot Files (Change Frequently)", "", "Based on recent git history:", "", "| File | Changes |", "|------|---------|")
DEAD = ("## Possible Dead Code", "", "> Defined but never imported elsewhere. Verify before removing - ",
        "> dynamic access or `__all__` usage may not be detected.", "")
DECISIONS = ("## Architecture Decisions", "", "> See [DECISIONS.md](DECISIONS.md) for WHY the code is structured this way.",
             "> Read it before making structural changes.", "")


def project_lines(facts: DataFrame, dirs: DataFrame, most: DataFrame, hot: DataFrame, unused_files: DataFrame,
                  frameworks: DataFrame, files: DataFrame, budget: DataFrame | None = None) -> DataFrame:
    """The lines of each project's guide: overview, structure, core files (8,
    count > 0), hot files (8), possible dead code (10 files), decisions pointer
    when a DECISIONS.md exists, recommended rules.  With a ``budget`` (A3) the
    overview names the reduction that the ignore rules bring."""
    ov = facts.groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.sum(F.size("functions")).alias("fns"),
        F.sum(F.size("classes")).alias("cls"), F.sum("typed_functions").alias("typed"), F.sum("complexity").alias("cx"))
    cov = F.when(F.col("fns") > 0, F.col("typed") / F.col("fns") * 100.0).otherwise(F.lit(0.0))
    ov = ov.join(frameworks.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("framework")), ", ").alias("fw")),
                 "project", "left")
    ov = (ov.join(budget.select("project", F.col("savings_pct").alias("saved")), "project", "left") if budget is not None
          else ov.withColumn("saved", F.lit(None).cast("double")))
    overview = _lines(ov, 0, F.array_compact(_said(
        GUIDE_TITLE, "", *GUIDE_NOTES, "", "## Project Overview", "",
        F.concat(F.lit("- **Files:** "), F.col("n").cast("string"), F.lit(" Python files")),
        F.concat(F.lit("- **Lines of code:** "), F.format_number("lines", 0)),
        F.concat(F.lit("- **Functions:** "), F.col("fns").cast("string"), F.lit("  |  **Classes:** "), F.col("cls").cast("string")),
        F.concat(F.lit("- **Type coverage:** "), F.round(cov, 0).cast("long").cast("string"), F.lit("%  |  **Avg complexity:** "),
                 F.round(F.col("cx") / F.col("n"), 1).cast("string")),
        F.concat(F.lit("- **Estimated token reduction with ignore rules:** "), F.round("saved", 1).cast("string"), F.lit("%")),
        F.concat(F.lit("- **Detected frameworks:** "), "fw"))))
    projects = facts.select("project").distinct()
    written = Tables(facts.sparkSession, "guide")

    def table(rows: DataFrame, section: int, head: tuple, line: Column) -> list[DataFrame]:
        """Heading, ranked lines and a blank line where there are any: a few rows a
        project, computed once."""
        rows = written.keep(rows)
        any_ = rows.select("project").distinct()
        body = rows.select("project", F.lit(section + 1).cast("long").alias("section"), F.lit("").alias("sort_key"),
                           F.col("rank").cast("long").alias("pos"), line.alias("line"))
        return [_lines(any_, section, _said(*head)), body, _lines(any_, section + 2, _said(""))]

    name = F.concat(F.lit("| `"), "path", F.lit("` | "))
    imported = F.concat(name, F.col("imported_by").cast("string"), F.when(F.col("imported_by") == 1, " file |").otherwise(" files |"))
    first = Window.partitionBy("project").orderBy("path")
    dead = unused_files.select("project", "path", "symbols").withColumn("rank", F.row_number().over(first)).where("rank <= 10")
    symbols = F.array_join(F.transform("symbols", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    return _stack(
        overview, _lines(projects, 1, _said("", "## Project Structure", "", "```")),
        dirs.select("project", F.lit(2).cast("long").alias("section"), F.col("sort_path").alias("sort_key"), F.col("depth").alias("pos"), "line"),
        _lines(projects, 3, _said("```", "")),
        *table(most.where((F.col("imported_by") > 0) & (F.col("rank") <= 8)), 4, CORE, imported),
        *table(hot.where(F.col("rank") <= 8), 7, HOT, F.concat(name, F.col("changes").cast("string"), F.lit(" |"))),
        *table(dead, 10, DEAD, F.concat(F.lit("- **`"), "path", F.lit("`**: "), symbols)),
        _lines(files.where(F.col("path") == "DECISIONS.md").select("project").distinct(), 13, _said(*DECISIONS)),
        _lines(projects, 14, _said("## Recommended ignore rules", "", "```", *RECOMMENDED_RULES, "```", "")))


def _parts(joined: str, sep: str) -> Column:
    """The parts of a joined list; none of an empty one."""
    return F.filter(F.split(joined, sep), lambda x: x != "")


def analysis_json(totals: DataFrame, most: DataFrame, hot: DataFrame, budget: DataFrame, cycles: DataFrame,
                  quality: DataFrame) -> DataFrame:
    """One JSON document per project (A1 + tokens + cycles + quality)."""
    mi = most.where(F.col("imported_by") > 0).groupBy("project").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("path").alias("file"), F.col("imported_by").alias("count"))))
        .alias("most_imported"))
    ht = hot.groupBy("project").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "changes"))))
                                    .alias("hot_files"))
    cy = cycles.groupBy("project").agg(F.array_sort(F.collect_list("chain")).alias("cycles"))
    j = (totals.join(mi, "project", "left").join(ht, "project", "left").join(budget, "project", "left")
         .join(cy, "project", "left").join(quality, "project", "left"))
    doc = F.struct(
        "project", _parts("languages", ",").alias("languages"), "files", "total_lines", "total_functions",
        "total_classes", _parts("frameworks", ", ").alias("frameworks"),
        F.transform(F.coalesce("most_imported", F.array()), lambda x: F.struct(x["file"].alias("file"),
                                                                                x["count"].alias("count"))).alias("most_imported"),
        F.coalesce("hot_files", F.expr("map()").cast("map<string,bigint>")).alias("hot_files"), F.struct("baseline", "optimized", "savings_pct").alias("tokens"),
        F.coalesce("cycles", F.array().cast("array<string>")).alias("cycles"),
        F.struct("avg_complexity", "type_coverage_pct").alias("quality"))
    return j.select("project", F.to_json(doc).alias("json"))
