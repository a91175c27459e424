"""Toxicity: character n-gram linear classifier scaled by naive Bayes log-count
ratios (operator 3).

Features are the distinct character n-grams (orders 4 to 6, hashed) of the
lower-cased text with whitespace runs as one space.  From labelled texts the
log-count ratio r of each n-gram is taken; a logistic regression is fitted on
presence vectors scaled by r; the score is its probability.  A text longer than
``WINDOW`` characters is scored in windows that cover it and overlap by half, and takes the
largest score.  The fit uses at most
``PER_CLASS`` labelled texts of each class, chosen by hash of the id, one text an id, and
of these as many as hold at most ``FEATURES`` n-grams a class (documented bounds of what
the driver gets); scoring covers every whole text.

Edge cases: null and empty texts have no n-grams and score by the intercept;
without labels of both classes the score is the smoothed share of the positive
class; documents with several label rows use the largest; an id with several texts is
learnt by the one of smallest hash; extra columns pass through, but
for those named ``tx_...`` like the operator's own.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, keep, with_text_columns, without_own

ORDERS = (4, 5, 6)
DIM_BITS = 19
PER_CLASS = 1500
FEATURES = 12_000_000  # n-grams of the fit's texts of one class
ALPHA = 1.0
MIN_RATIO = 1.0       # only n-grams that speak for the class
WINDOW = 4000         # characters scored together: many n-grams never outweigh a toxic passage
L2 = 2e-4
STEPS = 120
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(r"\s+")


def _codes(text: str | None) -> np.ndarray:
    """Characters of the lower-cased text between two spaces; none of an empty text."""
    t = _SPACE.sub(" ", text or "").strip().lower()
    t = f" {t} " if t else ""
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct feature numbers of a run of characters."""
    seen = np.zeros(1 << DIM_BITS, dtype=bool)
    h = codes
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + codes[order - 1:] + np.uint64(1)
        if order in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * _MULT
            seen[(mixed >> np.uint64(64 - DIM_BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    return _grams(_codes(text))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """Log-count ratios and logistic weights, folded into one weight vector."""
    dim = 1 << DIM_BITS
    y = np.asarray(labels, dtype=np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    base = {"w": np.zeros(dim, dtype=np.float32), "b": float(np.log(prior / (1 - prior)))}
    if not len(y) or y.min() == y.max():
        return base
    counts = [np.full(dim, ALPHA), np.full(dim, ALPHA)]
    for f, label in zip(rows, y):
        counts[int(label)][f] += 1
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    r = np.log((counts[1] / (n_pos + 2 * ALPHA)) / (counts[0] / (n_neg + 2 * ALPHA)))
    used = np.flatnonzero((counts[0] + counts[1] - 2 * ALPHA >= 3) & (r > MIN_RATIO))
    back = np.full(dim, -1, dtype=np.int32)
    back[used] = np.arange(len(used))
    rows = [x[x >= 0] for x in (back[f] for f in rows)]
    sizes = np.array([len(f) for f in rows])
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    scale = r[used]
    x = scale[flat]
    w, b = np.zeros(len(used)), base["b"]
    weight = np.where(y == 1, 0.5 / n_pos, 0.5 / n_neg)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, x * w[flat], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.append(np.bincount(flat, x * g[owner], len(used)) + L2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    base["w"][used] = w * scale
    base["b"] = float(b)
    return base


def score(found: np.ndarray, model: dict) -> float:
    z = float(model["w"][found].sum()) + model["b"]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score_text(text: str | None, model: dict) -> float:
    """The largest score of the text's windows, which cover it and overlap by half."""
    codes = _codes(text)
    starts = range(0, max(len(codes) - WINDOW // 2, 1), WINDOW // 2)
    return max(score(_grams(codes[a:a + WINDOW]), model) for a in starts)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic",
          per_class: int = PER_CLASS, max_features: int = FEATURES) -> dict:
    """Fit on at most ``per_class`` labelled texts of each class, chosen by id hash, with at
    most ``max_features`` n-grams a class (the first text counts whole)."""
    return fit(*sample(docs, labels, key, label, per_class, max_features))


def sample(docs: DataFrame, labels: DataFrame, key: str, label: str, per_class: int,
           max_features: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the fit's texts: one text for each picked id."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(
        F.col(key).alias("tx_key")).agg(F.max(label).cast("int").alias("tx_label"))
    known = docs.select(F.col(key).alias("tx_key")).distinct().join(marked, "tx_key")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("tx_label") == value).orderBy(
            F.xxhash64("tx_key"), "tx_key").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # At most 2 * per_class rows of two integers: small by its bound.
    texts = docs.select(F.col(key).alias("tx_key"), F.col("text").alias("tx_text")).join(
        F.broadcast(picked), "tx_key").groupBy("tx_key", "tx_label").agg(
        F.min_by("tx_text", F.struct(F.xxhash64("tx_text"), "tx_text")).alias("tx_text"))

    def run(batches):
        for pdf in batches:
            found = [features(t) for t in pdf["tx_text"]]
            yield pd.DataFrame({"key": pdf["key"], "label": pdf["tx_label"],
                                "n": [len(f) for f in found], "found": [f.tobytes() for f in found]})
    stored = keep(texts.select(F.xxhash64("tx_key").alias("key"), "tx_label", "tx_text").mapInPandas(
        run, "key long, label int, n long, found binary"), "toxicity-sample")
    # At most 2 * per_class rows of three numbers.
    sizes = stored.select("key", "label", "n").toPandas().sort_values(["label", "key"])
    held = sizes.groupby("label")["n"].cumsum()
    sizes = sizes[(held <= max_features) | (held == sizes["n"])]
    last = sizes.groupby("label")["key"].max().to_dict()
    chosen = F.lit(False)
    for value, most in last.items():
        chosen = chosen | ((F.col("label") == int(value)) & (F.col("key") <= int(most)))
    # Feature numbers travel as bytes: four a feature on the driver, not a Python integer each.
    taken = stored.where(chosen).select("label", "found").toArrow()
    return ([np.frombuffer(f.as_buffer(), dtype=np.int32) for f in taken["found"]],
            taken["label"].to_numpy())


def classify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``tx_score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**DIM_BITS floats

    def make():
        return lambda texts: [[score_text(t, shared.value) for t in texts]]
    return with_text_columns(without_own(docs, "tx_"), text, [("tx_score", T.DoubleType())], make)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest: labels are learnt outside fold 0 of 5, all rows scored."""
    texts = docs.select("doc_id", "text")
    model = train(texts.where(crc_fold(F.col("doc_id"), 5) != 0), labels)
    return classify(texts, model).select(
        "doc_id", (F.coalesce(crc_fold(F.col("doc_id"), 5), F.lit(-1)) == 0).alias("held_out"),
        F.col("tx_score").alias("score"),
        F.when(F.col("tx_score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
