"""Dead code: F7 public_symbols, J6 framework_decorated, J5 unused_symbols,
A13 unused_per_file.

A symbol counts as used when its text occurs (as a substring) in another
source file of the project.  Every occurrence lies inside one maximal word run,
so the test runs against each project's distinct words.  Symbols that are
themselves words of several files fall out by one aggregate; the others are
looked up among the words' suffixes in sorted order, in time linear in the
letters of the words however many words share a stretch.  "In another file" is
decided from the per-word first and last file (partial aggregates), never from a
list of files.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import split_lines
from tokenloom.operators.filters import is_public_symbol
from tokenloom.session import Tables, small_side

# Fixed value: decorators that register a function with a framework or mark a
# built-in kind of method.
FRAMEWORK_DECORATOR_RE = (r"(?i)@(?:app|router|blueprint|server|mcp|pytest|fixture"
                          r"|property|staticmethod|classmethod|abstractmethod)\b")
DEF_LINE_RE = r"^\s*(?:async\s+)?def\s+(\w+)\s*[:(]"
WORD_RUN_RE = r"(?U)\w+"


def decorated_names(content: Column) -> Column:
    """J6 (row-local): names of ``def`` lines whose contiguous block of '@'
    lines directly above holds a framework decorator — one pass over lines."""
    lines = split_lines(content)
    init = F.struct(F.lit(False).alias("fw"), F.array().cast("array<string>").alias("names"))

    def step(acc, ln):
        s = F.regexp_replace(ln, r"^\s+|\s+$", "")
        is_deco = s.startswith("@")
        name = F.regexp_extract(ln, "(?U)" + DEF_LINE_RE, 1)
        is_def = ln.rlike("(?U)" + DEF_LINE_RE)
        fw = F.when(is_deco, acc["fw"] | ln.rlike(FRAMEWORK_DECORATOR_RE)).otherwise(F.lit(False))
        names = F.when(is_def & acc["fw"], F.concat(acc["names"], F.array(name))).otherwise(acc["names"])
        return F.struct(fw.alias("fw"), names.alias("names"))

    return F.array_distinct(F.aggregate(lines, init, step)["names"])


def framework_decorated(defs: DataFrame) -> DataFrame:
    """``(project, path, symbol)`` of framework-decorated functions."""
    return defs.select("project", "path", F.explode(decorated_names(F.col("content"))).alias("symbol"))


# Symbols shorter than this are looked up among the words' grams; suffixes are
# dealt by their first letters, so many.
GRAM = 3
# Letters of a suffix that are kept; longer symbols are verified in the words themselves.
SUFFIX = 64
#: Suffixes with the same first letters up to which they meet their symbols in one sorted stretch.
HOT_WORDS = 50_000


def _grams(word: Column, size: int) -> Column:
    """Distinct substrings of ``size`` letters of a word of at least that many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - size + 1),
                                        lambda i: F.substring(word, i, size)))


def _times(text: Column, symbol: Column) -> Column:
    """Occurrences of a symbol that do not overlap; null for an empty symbol."""
    return F.floor((F.length(text) - F.length(F.replace(text, symbol, F.lit("")))) / F.length(symbol))


def summary_columns(content: Column, symbols: Column, checked: Column | None = None) -> dict[str, Column]:
    """Row-local part of J5/J6 as expressions: candidate symbols (public, at
    most one occurrence in their own file) with their position,
    framework-decorated names, and the distinct word runs of the text.

    Where ``checked`` is false the occurrences are left to the join, which adds
    them up over the words: all word runs are kept and only symbols that are not
    of word letters alone are counted here."""
    pos_syms = F.transform(symbols, lambda s, i: F.struct(i.alias("pos"), s.alias("symbol")))
    words = F.regexp_extract_all(content, F.lit(WORD_RUN_RE), 0)
    if checked is None:
        few = lambda s: _times(content, s) <= 1
    else:
        few = lambda s: F.when(checked | s.rlike(r"(?U)\W"), _times(content, s) <= 1).otherwise(content.isNotNull() & (F.length(s) > 0))
        words = F.when(checked, F.array_distinct(words)).otherwise(words)
    return {
        "cands": F.filter(pos_syms, lambda x: is_public_symbol(x["symbol"]) & few(x["symbol"])),
        "deco": decorated_names(content),
        "words": F.array_distinct(words) if checked is None else words,
    }


def _merged(rows: DataFrame) -> DataFrame:
    """Occurrences of each symbol: first and last file, how many (overlapping
    ones included), and the span of words and places they are spread over."""
    return rows.groupBy("project", "symbol").agg(
        F.min("first_file").alias("first_file"), F.max("last_file").alias("last_file"), F.sum("n").alias("n"),
        F.min("word_lo").alias("word_lo"), F.max("word_hi").alias("word_hi"), F.min("at_lo").alias("at_lo"), F.max("at_hi").alias("at_hi"))


def _scan(rows: DataFrame, file_type: str) -> DataFrame:
    """Occurrences of symbols (kind 0) as beginnings of suffixes (kind 1), both
    sorted: the symbols that begin the current string form a stack."""
    names = ["project", "symbol", "first_file", "last_file", "n", "word_lo", "word_hi", "at_lo", "at_hi"]
    files = pa.string() if file_type == "string" else pa.int64()
    types = [pa.string(), pa.string(), files, files, *[pa.int64()] * 5]

    def scan(batches):
        out, stack, group = [], [], None

        def close():
            done = stack.pop()
            if done[3]:
                out.append((group[0], *done))
                if stack:
                    add(stack[-1], *done[1:])

        def add(to, first, last, n, word_lo, word_hi, at_lo, at_hi):
            if not to[3]:
                to[1:] = first, last, n, word_lo, word_hi, at_lo, at_hi
                return
            to[1], to[2], to[3] = min(to[1], first), max(to[2], last), to[3] + n
            to[4], to[5], to[6], to[7] = min(to[4], word_lo), max(to[5], word_hi), min(to[6], at_lo), max(to[7], at_hi)

        def table():
            columns = list(zip(*out)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names)

        for batch in batches:
            for project, split, text, kind, first, last, n, word, at in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)):
                if group != (project, split):
                    while stack:
                        close()
                    group = (project, split)
                while stack and not text.startswith(stack[-1][0]):
                    close()
                if not kind:
                    stack.append([text, None, None, 0, 0, 0, 0, 0])
                elif stack:
                    add(stack[-1], first, last, n, word, word + (n > 1), at, at)
            yield table()
        while stack:
            close()
        yield table()

    dealt = rows.repartition("project", "split", F.substring("text", 1, GRAM)).sortWithinPartitions("project", "split", "text", "kind")
    return dealt.select("project", "split", "text", "kind", "first_file", "last_file", "n", "word", "at").mapInArrow(
        scan, f"project string, symbol string, first_file {file_type}, last_file {file_type}, n long, word_lo long, word_hi long, "
              "at_lo long, at_hi long")


def _occurrences(t: Tables, words: DataFrame, asked: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """Where the symbols of ``asked`` (written, distinct) occur in ``words``:
    ``project, w, n, first_file, last_file``, one row per word.

    A symbol occurs in a word where it begins one of its suffixes.  Symbols and
    suffixes are dealt by their first ``GRAM`` letters and sorted, so one pass over
    them finds every occurrence; first letters of more than ``hot_words`` suffixes
    are split: the words are dealt to more stretches and the symbols sent to each.
    No pair of a symbol and a word is formed but for symbols beyond ``SUFFIX``
    letters, which are looked up by their first ones and verified."""
    file_type = dict(words.dtypes)["first_file"]
    w = words.withColumn("word", F.monotonically_increasing_id())
    short_sizes = [F.count_if(F.length("symbol") == n).alias(f"n{n}") for n in range(1, GRAM)]
    sizes = asked.agg(*short_sizes, F.count_if(F.length("symbol") > SUFFIX).alias("long")).first()

    def places(size: int) -> Column:
        return F.explode(F.sequence(F.lit(1), F.length("w") - size + 1)).alias("at")

    begins = ["project", F.substring("text", 1, GRAM).alias("begin")]
    suffix = (w.where(F.length("w") >= GRAM).select("project", "w", "first_file", "last_file", "n", "word", places(GRAM))
              .select("project", F.expr(f"substring(w, at, {SUFFIX})").alias("text"), F.lit(1).alias("kind"), "first_file", "last_file", "n",
                      "word", F.col("at").cast("long")))
    symbol = asked.where(F.length("symbol").between(GRAM, SUFFIX)).select(
        "project", F.col("symbol").alias("text"), F.lit(0).alias("kind"), *[F.lit(0).cast(c).alias(n) for n, c in (
            ("first_file", file_type), ("last_file", file_type), ("n", "long"), ("word", "long"), ("at", "long"))])
    hot, seen = t.keep(suffix.groupBy(*begins).agg(F.ceil(F.count(F.lit(1)) / hot_words).cast("int").alias("splits"))
                       .where("splits > 1"), n=F.count(F.lit(1)))
    if seen["n"]:
        hot, begin = small_side(hot), begins[1]
        suffix = (suffix.withColumn("begin", begin).join(hot, ["project", "begin"], "left")
                  .withColumn("split", F.pmod(F.xxhash64("word"), F.coalesce("splits", F.lit(1))).cast("int")).drop("begin", "splits"))
        symbol = (symbol.withColumn("begin", begin).join(hot, ["project", "begin"], "left")
                  .withColumn("split", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1))).drop("begin", "splits"))
    else:
        suffix, symbol = suffix.withColumn("split", F.lit(0)), symbol.withColumn("split", F.lit(0))
    found = _scan(suffix.unionByName(symbol), file_type)

    # a word that occurs more than once spreads over two
    spread = ["first_file", "last_file", "n", F.col("word").alias("word_lo"), (F.col("word") + (F.col("n") > 1).cast("long")).alias("word_hi")]
    for size in range(1, GRAM):
        if sizes[f"n{size}"]:
            grams = w.where(F.length("w") >= size).select("project", "w", *spread, places(size)).withColumn(
                "symbol", F.expr(f"substring(w, at, {size})")).withColumn("at", F.col("at").cast("long"))
            found = found.unionByName(
                grams.join(asked.where(F.length("symbol") == size), ["project", "symbol"], "left_semi")
                .select("project", "symbol", "first_file", "last_file", "n", "word_lo", "word_hi", F.col("at").alias("at_lo"), F.col("at").alias("at_hi")))
    if sizes["long"]:
        lookup = asked.where(F.length("symbol") > SUFFIX).withColumn("begin", F.substring("symbol", 1, SUFFIX))
        held = (w.where(F.length("w") > SUFFIX).select("project", "w", "first_file", "last_file", "n", "word", F.explode(_grams(F.col("w"), SUFFIX)).alias("begin"))
                .join(lookup, ["project", "begin"]).where(F.contains("w", "symbol")))
        times = _times(F.col("w"), F.col("symbol"))
        found = found.unionByName(held.select("project", "symbol", "first_file", "last_file", (F.col("n") * times).alias("n"), *spread[3:],
                                              F.lit(0).cast("long").alias("at_lo"), ((times - 1) * F.length("symbol")).alias("at_hi")))
    return _merged(found)


def symbol_usage(summary: DataFrame, symbols: DataFrame, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per ``(project, symbol)`` the first and last source file (by path) whose
    text contains the symbol."""
    t = Tables(summary.sparkSession, "usage")
    named = summary.where(F.col("project").isNotNull() & F.col("path").isNotNull())
    words = named.select("project", "path", F.explode("words").alias("w")).groupBy("project", "w").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_file"), F.max("path").alias("last_file"))
    asked = t.keep(symbols.select("project", "symbol").distinct())
    return _occurrences(t, t.keep(words), asked, hot_words).select("project", "symbol", "first_file", "last_file")


def _with_file(t: Tables, rows: DataFrame) -> DataFrame:
    """Adds ``file``, a number per (project, path), and ``repeated``: more rows
    have that path.  Only those are joined."""
    again, seen = t.keep(rows.groupBy("project", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "project", "path", (-1 - F.monotonically_increasing_id()).alias("again")), n=F.count(F.lit(1)))
    if not seen["n"]:
        return rows.withColumn("file", F.monotonically_increasing_id()).withColumn("repeated", F.lit(False))
    return (rows.withColumn("file", F.monotonically_increasing_id()).join(small_side(again), ["project", "path"], "left")
            .withColumn("file", F.coalesce("again", "file")).withColumn("repeated", F.col("again").isNotNull()).drop("again"))


def _unused(t: Tables, summary: DataFrame) -> DataFrame:
    """J5 on a written summary with ``file`` and ``checked``.

    One aggregate over all words and candidates leaves the symbols that are a
    word of no file or of one; only these are looked up inside the words.  A row
    that is not ``checked`` (it has its path alone) holds a symbol at most once
    if all words of the project do.  Rows without project or path have no
    neighbours."""
    named = F.col("project").isNotNull() & F.col("path").isNotNull()
    cands = (summary.select("project", "path", "file", "checked", "deco", F.explode("cands").alias("c"))
             .where(~F.array_contains("deco", F.col("c.symbol")))
             .select("project", "path", "file", "checked", F.col("c.symbol").alias("symbol"), F.col("c.pos").alias("pos")))
    keyed = cands.where(named).drop("path")
    words = summary.where(named).select("project", "file", "checked", F.explode("words").alias("symbol"), F.lit(None).cast("int").alias("pos"))
    word, cand = F.col("pos").isNull(), F.col("pos").isNotNull()
    tokens = words.unionByName(keyed).groupBy("project", "symbol").agg(
        F.count_if(word).alias("n"), F.min(F.when(word, F.col("file"))).alias("first_file"), F.max(F.when(word, F.col("file"))).alias("last_file"),
        F.bool_and(F.when(word, F.col("checked"))).alias("word_checked"), F.min(F.when(cand, F.col("file"))).alias("file"),
        F.max(F.when(cand, F.col("file"))).alias("last_cand"), F.bool_and(F.when(cand, F.col("checked"))).alias("checked"), F.min("pos").alias("pos"))
    one_file = F.col("first_file").isNull() | (F.col("first_file") == F.col("last_file"))
    open_ = F.col("file").isNotNull() & one_file & ((F.col("n") <= 1) | F.col("word_checked"))
    several = F.col("file") != F.col("last_cand")
    tokens, seen = t.keep(tokens.withColumn("open", open_), several=F.count_if(F.col("open") & several))
    asked = t.keep(tokens.where("open").select("project", "symbol"))
    usage = _occurrences(t, tokens.where("n > 0").select("project", F.col("symbol").alias("w"), "n", "first_file", "last_file"), asked)
    # overlapping occurrences in one word count once
    twice = (F.col("n") > 1) & ((F.col("word_lo") != F.col("word_hi")) | (F.col("at_hi") - F.col("at_lo") >= F.length("symbol")))
    usage = usage.select("project", "symbol", "first_file", "last_file", twice.alias("twice"))
    rows = tokens.where(F.col("open") & ~several).select("project", "symbol", "file", "checked", "pos")
    if seen["several"]:
        more = tokens.where(F.col("open") & several).select("project", "symbol")
        rows = rows.unionByName(keyed.join(more, ["project", "symbol"], "left_semi").groupBy("project", "symbol", "file", "checked")
                                .agg(F.min("pos").alias("pos")))
    here = (F.col("first_file") == F.col("file")) & (F.col("last_file") == F.col("file")) & (F.col("checked") | ~F.col("twice"))
    unused = rows.join(usage, ["project", "symbol"], "left").where(F.col("first_file").isNull() | here)
    paths = summary.where(named).select("file", "path").distinct()
    alone = cands.where(~named).groupBy("project", "path", "symbol").agg(F.min("pos").alias("pos"))
    return unused.join(paths, "file").select("project", "path", "symbol", "pos").unionByName(alone).withColumn("pos", F.col("pos").cast("long"))


def unused_from_summary(summary: DataFrame) -> DataFrame:
    """J5 on ``summary_columns`` with all occurrences counted."""
    t = Tables(summary.sparkSession, "unused")
    rows = _with_file(t, summary).select("project", "path", "file", F.lit(True).alias("checked"), "cands", "deco", "words")
    return _unused(t, t.keep(rows))


def unused_symbols(defs: DataFrame) -> DataFrame:
    """Public, not framework-decorated symbols occurring at most once in
    their own file and in no other source file of the project.

    ``defs``: source files (F4 already applied) with ``content`` and the
    ordered ``symbols`` array (functions then classes).  Output:
    ``project, path, symbol, pos``.  The text is read once: the row-local
    summary is written before the joins.
    """
    t = Tables(defs.sparkSession, "unused")
    checked = F.col("repeated") | F.col("project").isNull() | F.col("path").isNull()
    rows = _with_file(t, defs.select("project", "path", "content", "symbols")).withColumn("checked", checked)
    columns = summary_columns(F.col("content"), F.col("symbols"), F.col("checked"))
    return _unused(t, t.keep(rows.select("project", "path", "file", "checked", *[c.alias(n) for n, c in columns.items()])))


def unused_per_file(unused: DataFrame) -> DataFrame:
    """Per file its unused symbols in definition order."""
    g = unused.groupBy("project", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("s"))
    return g.select("project", "path", F.transform("s", lambda x: x["symbol"]).alias("symbols"),
                    F.size("s").cast("long").alias("n_symbols"))
