"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 2- and 3-grams per language over all labelled rows:
each task sums its rows into one vector per language, Spark adds the vectors.
The log-probability matrix (at most ``MAX_LANGUAGES`` rows of ``BUCKETS``
single-precision values, checked) is broadcast; scoring gathers and sums its
entries in numpy, block by block.

Texts are lower-cased, every run of non-letters counts as one blank; 2-grams
without a letter and 3-grams without one in the middle are skipped.  Very long texts are read in slices cut at a
blank (inside a word only if it alone is longer than a slice), so memory stays
bounded whatever the length.

Edge cases: a null text or one without a letter gets ``und`` and score 0; with
no training row every prediction is ``und``; equal scores go to the language
that sorts first.  Null ids count as the empty string for the fold; repeated
rows give repeated predictions; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import by_value, held_out, process_store

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
MAX_LANGUAGES = 500
SLICE = 1 << 20  # characters of one text handled at a time
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    store = process_store()
    if "letters" not in store:
        store["letters"] = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    return store["letters"]


def _blocks(texts):
    """(row numbers, lower-cased slices) of about ``SLICE`` characters together."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        text, lo = text.lower().replace("\x00", " "), 0
        while lo < len(text):
            hi = min(len(text), lo + SLICE)
            if hi < len(text):
                hi = max(text.rfind(" ", lo, hi), lo) or hi
                hi = hi if hi > lo else min(len(text), lo + SLICE)
            rows.append(i)
            parts.append(text[lo:hi])
            size += hi - lo
            lo = hi
            if size >= SLICE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _grams(parts):
    """(slice number, bucket) of every 2- and 3-gram, as two pairs of arrays."""
    code = np.frombuffer((" " + " \x00 ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[code], code, np.uint32(32))
    c[code == 0] = 0
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    own = np.cumsum(c == 0)
    shift = np.uint32(32 - BUCKET_BITS)
    x, y, z = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77), c * np.uint32(0xC2B2AE3D)
    two = ((x[:-1] ^ y[1:]) * np.uint32(0x27D4EB2F)) >> shift
    three = ((x[:-2] ^ y[1:-1] ^ z[2:]) * np.uint32(0x165667B1)) >> shift
    whole2 = (np.minimum(c[:-1], c[1:]) > 0) & (np.maximum(c[:-1], c[1:]) > 32)
    whole3 = (c[:-2] > 0) & (c[1:-1] > 32) & (c[2:] > 0)  # around a letter, so never across words
    return ((own[:-1][whole2], two[whole2]), (own[:-2][whole3], three[whole3]))


def _count(batches):
    """Per task: one (lang, counts) row for each language it met."""
    total: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            rows[lang] = rows.get(lang, 0) + len(part)
            for _, parts in _blocks(part["text"]):
                for _, bucket in _grams(parts):
                    counts += np.bincount(bucket, minlength=BUCKETS)
    for lang, counts in total.items():
        b = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": b.astype(np.int64), "n": counts[b], "n_rows": 0})
        yield pd.DataFrame({"lang": [lang], "bucket": [-1], "n": [0], "n_rows": [rows[lang]]})


class LanguageModel:
    """Languages in order, priors and the log-probability matrix (BUCKETS x languages)."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Fit on every row of ``labelled`` that has a text and a language."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = (rows.filter("text is not null and lang is not null")
               .mapInPandas(_count, "lang string, bucket long, n long, n_rows long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))
               # one row for each language, of at most BUCKETS + 1 entries
               .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n", "n_rows")).alias("c")))
    table = {r["lang"]: r["c"] for r in counted.limit(MAX_LANGUAGES + 1).collect()}
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the broadcast matrix has a bound")
    langs = sorted(table)
    counts, prior = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        c = np.array([(x["bucket"], x["n"], x["n_rows"]) for x in table[lang]], dtype=np.int64).reshape(-1, 3)
        prior[k] = c[:, 2].sum()
        c = c[c[:, 0] >= 0]
        counts[c[:, 0], k] = c[:, 1]
    logp = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * BUCKETS)
    with np.errstate(divide="ignore"):
        return LanguageModel(langs, np.log(prior / max(prior.sum(), 1)), logp.astype(np.float32))


def _scores(texts, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log posteriors up to a constant, and whether the text has a letter."""
    out = np.tile(model.prior, (len(texts), 1))
    seen = np.zeros(len(texts), bool)
    for rows, parts in _blocks(texts):
        rows = np.array(rows)
        for own, bucket in _grams(parts):
            if not len(own):
                continue
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            at = rows[own[first]]
            seen[at] = True
            for k in range(len(model.langs)):
                np.add.at(out[:, k], at, np.add.reduceat(model.logp[:, k][bucket].astype(np.float64), first))
    return out, seen


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus lang_pred and score (posterior probability)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.prior, np.asfortranarray(model.logp)))

    @F.pandas_udf("lang_pred string, score double")
    def tell(texts: pd.Series) -> pd.DataFrame:
        m = LanguageModel(*shared.value)
        if not m.langs:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0})
        total, seen = _scores(texts, m)
        best = total.argmax(1)
        p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return pd.DataFrame({"lang_pred": np.where(seen, np.array(m.langs, dtype=object)[best], UNDETERMINED),
                             "score": np.where(seen, p, 0.0)})

    told = docs.withColumn("_tl_lang", tell(F.col(text_col).cast("string")))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return told.select(*keep, F.col("_tl_lang.lang_pred").alias("lang_pred"), F.col("_tl_lang.score").alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train outside the held-out fold, predict every row: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    return predict(slim, model).drop("text")


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The documents whose language is determined with at least ``min_score``,
    columns unchanged; rejected are texts without a letter and unsure ones."""
    model = train(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    told = predict(docs.withColumn("_tl_text", F.col(text_col).cast("string")).select(
        F.struct(*docs.columns).alias("_tl_row"), "_tl_text"), model, "_tl_text")
    kept = told.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return kept.select("_tl_row.*")


by_value(__name__)
