"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in surface features of its text.  Preference
pairs (a document marked good, one marked bad) give the logistic loss
log(1 + exp(-w.(x_good - x_bad))), fitted by Newton steps.  The threshold is a
quantile of the scores: the share of bad documents among the labelled ones.
The score maps the strength to (0, 1) so that the threshold lands on 0.7.

The weights are fitted on a bounded sample: at most ``SAMPLE`` labelled documents
outside the held-out fold (smallest keyed hashes of the id) and ``PAIRS`` pairs
from them.  Means, scales, spread and the threshold are aggregates over all
labelled documents outside the fold.  Scoring reads every document; labels, lang, source and id play no part.

Edge cases: a null or empty text has all features at their empty value and gets
a score like any other; labels that are null are not used, several labels of
one id are averaged (a tie counts as good); without both labels, or on an empty
table, every score is 0.5; repeated rows get equal scores.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import BROADCAST_ROWS, Scratch, by_value, held_out
from tokenloom.llm.mixing import id_hash

SAMPLE = 20_000
PAIRS = 60_000
ACCURACY = 100_000  # of the quantile: exact up to so many rows, then off by 1 / ACCURACY of them at most
THRESHOLD = 0.7
MARKS = [ord(c) for c in ".,!?;:'\"()|#$%&*+-=/<>@[]_{}~^`\\"]


def features(text) -> list[float]:
    """Shares of byte classes and marks, repetition of words and lines, lengths."""
    text = text if isinstance(text, str) else ""
    h = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(int(h.sum()), 1)
    words, lines = text.split(), text.split("\n")
    n_words, distinct = max(len(words), 1), len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    blank = int(h[9:14].sum() + h[32])
    return [np.log1p(n), h[97:123].sum() / n, h[65:91].sum() / n, h[48:58].sum() / n, blank / n, h[10] / n,
            h[128:].sum() / n, *(h[MARKS] / n_words), distinct / n_words, again / n_words,
            len(set(lines)) / len(lines), (n - blank) / n_words, np.log1p(len(lines)), distinct / n_words ** 0.75]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


class QualityModel:
    def __init__(self, mean, scale, weights, threshold: float, spread: float):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.threshold, self.spread = threshold, spread

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        z = (self.strength(x) - self.threshold) / self.spread + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Bradley-Terry weights from the features of pairs (row i of ``better`` is
    preferred to row i of ``worse``)."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / len(d) - penalty * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, mean: np.ndarray, scale: np.ndarray, pairs: int = PAIRS) -> np.ndarray | None:
    """Weights from a labelled sample; pairs are drawn with a fixed seed."""
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return None
    z = np.clip((x - mean) / scale, -5, 5)
    draw = np.random.default_rng(7)
    return fit_pairs(z[draw.choice(up, pairs)], z[draw.choice(down, pairs)])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE, pairs: int = PAIRS) -> QualityModel:
    """Weights from at most ``sample`` labelled rows outside the held-out fold,
    everything else from all of them."""
    scratch = Scratch(docs.sparkSession, "quality")
    marked = scratch.keep(
        labels.select(F.col(id_col).alias("_tl_id"), F.col(label_col).cast("double").alias("_tl_mark"))
        .filter(F.col("_tl_id").isNotNull() & F.col("_tl_mark").isNotNull() & ~held_out(F.col("_tl_id")))
        .groupBy("_tl_id").agg((F.avg("_tl_mark") >= 0.5).alias("good")))
    texts = (docs.select(F.col(id_col).alias("_tl_id"), F.col(text_col).cast("string").alias("_tl_text"))
             .filter(F.col("_tl_id").isNotNull() & ~held_out(F.col("_tl_id"))))
    if marked.count() <= BROADCAST_ROWS:
        rows = texts.join(F.broadcast(marked), "_tl_id").withColumn("x", _features("_tl_text"))
    else:  # features, not texts, are shuffled
        rows = texts.select("_tl_id", _features("_tl_text").alias("x")).join(marked, "_tl_id")
    rows = scratch.keep(rows.select("_tl_id", "good", "x"))
    width = range(len(features("")))
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("good")).alias("bad"),
                    *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in width],
                    *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in width]).first()
    if not 0 < told["bad"] < told["n"]:
        return QualityModel(None, None, None, 0.0, 1.0)
    mean, scale = np.array([told[f"m{k}"] for k in width]), np.array([told[f"s{k}"] for k in width]) + 1e-9
    ids = scratch.keep(marked.orderBy(id_hash(F.col("_tl_id"), "quality"), "_tl_id").limit(sample).select("_tl_id"))
    chosen = rows.join(F.broadcast(ids), "_tl_id", "left_semi").limit(sample).collect()  # bounded by the sample
    chosen = sorted(chosen, key=lambda r: (r["_tl_id"], r["x"]))
    w = fit(np.array([r["x"] for r in chosen]), np.array([r["good"] for r in chosen], dtype=bool), mean, scale, pairs)
    if w is None:
        return QualityModel(None, None, None, 0.0, 1.0)

    @F.pandas_udf("double")
    def strength(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        return pd.Series(QualityModel(mean, scale, w, 0.0, 1.0).strength(np.array(x.tolist())))

    # the quantile between the bad and the good share: the middle of two neighbours in the order
    n, bad = told["n"], told["bad"]
    at = [(bad - 0.5) / n, (bad + 0.5) / n]
    cut = rows.select(strength("x").alias("s")).agg(
        F.percentile_approx("s", at, ACCURACY).alias("q"), F.stddev_pop("s").alias("spread")).first()
    return QualityModel(mean, scale, w, float(sum(cut["q"]) / 2), float(cut["spread"] + 1e-9))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    state = vars(model)

    @F.pandas_udf("double")
    def tell(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(QualityModel(**state).score(np.array([features(t) for t in texts])))

    i = F.col(id_col)
    scored = docs.select(i.alias("doc_id"), held_out(i).alias("held_out"), tell(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


by_value(__name__)
