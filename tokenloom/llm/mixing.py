"""Mixing sources to target weights by entropy balancing (native).

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; the
total of all sizes is shared by weight, no source gets more than ``max_copies``
times its own size, and the excess is shared again by weight until none is
above (a closed-form water level over the source table).

Rates: the entropy-balancing problem over word mass, min sum s_i (r_i log r_i -
r_i + 1) subject to sum_{i in g} s_i r_i = T_g, has the convex dual
sum s_i exp(lambda_g(i)) - sum lambda_g T_g.  It is solved by distributed Newton
iterations over pre-aggregated cells; every document gets the exponentially
tilted rate exp(lambda of its source).

Copies: the whole part of a rate is copied for every document; the fraction is
spread by systematic rounding along falling sizes.  Per (source, size class)
cell the number of extra copies is fixed by prefix sums of counts, and the
documents with the smallest keyed hash in the cell get them.  The hash limit of
each cell is found by radix selection (256-row histograms per cell and digit),
so no cell, however hot, is ever ranked whole, and the decision itself is
row-local: texts are not shuffled.

Edge cases: null or wordless texts have size 0 and are never taken; rows with
one id share one decision; null ids hash as the empty string; an empty table
gives an empty result.  Reruns agree, since every choice is a hash of the id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch, small, text_or_empty

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
Q = 1_000_000  # fixed-point unit of fractional rates
SIZE_COLS = ["source", "size_class"]


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes within about 3 % share a class: bit length and leading six bits."""
    bits = F.bin(size)
    return (F.length(bits) * 64 + F.conv(F.substring(bits, 1, 6), 2, 10).cast("long")).cast("long")


def id_hash(id_col: Column, seed: str = "") -> Column:
    """60 bits of the MD5 of the seed and the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 15),
                  16, 10).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_copies: int = 3) -> DataFrame:
    """(source, source_size) -> with target.  The table has one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = (sources.withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("total") - F.col("spent")) / F.col("left_weight")))
    # the first source whose cap lies above the level that holds if it and all later ones stay uncapped
    water = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return (t.withColumn("water", water)
            .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("water"), F.col("cap"))))
            .select("source", "source_size", "target"))


def entropy_balance(cells: DataFrame, targets: DataFrame, scratch: Scratch,
                    tolerance: float = 1e-12, max_iterations: int = 60) -> DataFrame:
    """Newton's method on the dual: (source, mass) cells and (source, target)
    -> (source, target, rate).  The dual's Hessian is diagonal in the sources,
    so each iteration is one partially aggregated sum of the tilted masses."""
    state = scratch.keep(targets.select("source", "source_size", "target", F.lit(0.0).alias("lam")))
    for _ in range(max_iterations):
        s = state.select(F.col("source").alias("_s"), "lam")
        moments = (cells.join(small(s), F.col("source").eqNullSafe(F.col("_s")))
                   .groupBy("source").agg(F.sum(F.col("mass") * F.exp("lam")).alias("moment"))
                   .select(F.col("source").alias("_s"), "moment"))
        m = F.col("moment")
        stepped = (state.join(moments, F.col("source").eqNullSafe(F.col("_s")), "left")
                   .withColumn("step", F.when((F.col("target") > 0) & (m > 0), (F.col("target") - m) / m).otherwise(0.0)))
        newer = scratch.keep(stepped.select("source", "source_size", "target",
                                            (F.col("lam") + F.col("step")).alias("lam"), F.abs("step").alias("error")))
        scratch.drop(state)
        state = newer
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.select("source", "source_size", "target",
                        F.round(F.when(F.col("target") > 0, F.exp("lam")).otherwise(0.0), 9).alias("rate"))


def _radix_limit(slim: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, k) -> (cell, limit): the k-th smallest hash of the cell."""
    digits = [("d1", 52), ("d2", 44)]
    rows, need = slim, wanted
    done: list[str] = []
    for name, shift in digits:
        rows = rows.withColumn(name, F.shiftright("h", shift).bitwiseAND(255))
        keyed = need.select(*[F.col(c).alias(f"_{c}") for c in ["cell", *done]], "k")
        on = F.col("cell") == F.col("_cell")
        for d in done:
            on = on & (F.col(d) == F.col(f"_{d}"))
        rows = rows.join(small(keyed), on).drop(*[f"_{c}" for c in ["cell", *done]])
        hist = rows.groupBy("cell", "k", *done, name).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("cell").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
        done = [*done, name]
        need = scratch.keep(hist.filter("below < k and k <= below + n")
                            .select("cell", *done, (F.col("k") - F.col("below")).alias("k")))
        rows = rows.drop("k")
    keyed = need.select(*[F.col(c).alias(f"_{c}") for c in ["cell", *done]], "k")
    on = F.col("cell") == F.col("_cell")
    for d in done:
        on = on & (F.col(d) == F.col(f"_{d}"))
    last = rows.join(small(keyed), on)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("h"))
    return last.withColumn("r", rank).filter("r = k").select("cell", F.col("h").alias("limit"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, max_copies: int, seed: str):
    """Slim rows and the written cell table (one row per source and size class)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    slim = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                    word_count(text_col).alias("size"))
                        .withColumn("size_class", size_class(F.col("size"))).withColumn("h", id_hash(F.col("doc_id"), seed)))
    cells = scratch.keep(slim.groupBy(*SIZE_COLS).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("mass")))
    targets = source_targets(cells.groupBy("source").agg(F.sum("mass").alias("source_size")), weights, max_copies)
    rates = scratch.keep(entropy_balance(cells, targets, scratch))

    r = rates.withColumnRenamed("source", "_s")
    before = Window.partitionBy("source").orderBy(F.desc("size_class")).rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.least(F.round(F.col("rate") * Q), F.lit(max_copies * Q)).cast("long")
    off = F.coalesce(F.sum("n").over(before), F.lit(0))
    cells = (cells.join(small(r), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
             .withColumn("fixed", fixed).withColumn("whole", F.expr(f"fixed div {Q}")).withColumn("part", F.col("fixed") % Q)
             .withColumn("off", off)
             .withColumn("k", F.expr(f"({Q // 2} + (off + n) * part) div {Q} - ({Q // 2} + off * part) div {Q}"))
             .withColumn("cell", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "size_class"))
             .select("source", "size_class", "cell", "n", "source_size", "target", "rate", "whole", "k"))
    cells = scratch.keep(cells)
    keyed = slim.select(F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "size_class").alias("cell"), "h")
    limits = _radix_limit(keyed, cells.filter("k > 0").select("cell", "k"), scratch)
    limits = scratch.keep(limits.withColumnRenamed("cell", "_cell"))
    cells = scratch.keep(cells.join(small(limits), F.col("cell") == F.col("_cell"), "left").drop("_cell"))
    return slim, cells


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("h") <= F.col("limit"), 1).otherwise(0)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, max_copies: int = 3, seed: str = "") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate,
    copies, taken (words the mix takes, repeats counted)."""
    slim, cells = _plan(docs, id_col, text_col, source_col, weights, max_copies, seed)
    c = cells.select(F.col("source").alias("_s"), F.col("size_class").alias("_c"),
                     "source_size", "target", "rate", "whole", "limit")
    out = slim.join(small(c), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size_class") == F.col("_c")))
    return (out.withColumn("copies", _copies())
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, max_copies: int = 3, seed: str = "") -> DataFrame:
    """The mixed documents: every row as often as its copies say, columns
    unchanged.  The cell table is joined to the documents; texts stay put."""
    _, cells = _plan(docs, id_col, text_col, source_col, weights, max_copies, seed)
    c = cells.select(F.col("source").alias("_tl_s"), F.col("size_class").alias("_tl_c"), "whole", "limit")
    c = c.select("_tl_s", "_tl_c", F.col("whole").alias("_tl_whole"), F.col("limit").alias("_tl_limit"))
    keyed = docs.withColumns({"_tl_src": F.col(source_col).cast("string"),
                              "_tl_cls": size_class(word_count(text_col)), "_tl_h": id_hash(F.col(id_col), seed)})
    copies = F.col("_tl_whole") + F.when(F.col("_tl_h") <= F.col("_tl_limit"), 1).otherwise(0)
    return (keyed.join(small(c), F.col("_tl_src").eqNullSafe(F.col("_tl_s")) & (F.col("_tl_cls") == F.col("_tl_c")))
            .withColumn("_tl_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
            .select(*docs.columns))
