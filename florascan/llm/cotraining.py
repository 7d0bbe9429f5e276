"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view sees only the text: its words, as shares of ``WORD_BUCKETS`` hashed buckets, its length, and word-weighted
means of its lines' features. The metadata view sees only language, source and recorded length; the languages and sources
with most documents have weights of their own (``LANGS`` and ``SOURCES`` of them at most), all others share one. Each is a
logistic regression. Labelled documents start both; in every later round
a view is fitted on the labelled documents and on the pseudo-labels that the *other* view is confident of, over all
unlabelled documents. Pseudo-labels are never written: a pass derives them from the last round's weights.

Fitting is Newton's method. A pass over the feature table sums gradients and Hessians of both views by tasks, and Spark
adds them up by entry, so every document counts and the driver receives a few thousand numbers whatever the input is.
Positive and negative rows of labelled and of pseudo-labelled documents get equal weight within their kind, the latter
``pseudo_weight`` of the former.

A fifth of the labelled documents (by id hash) is not fitted on. On at most ``max_calibration`` of them each view's
log-odds are calibrated by a logistic curve; the sum of the calibrated log-odds, less the base rate's, is the score.

Defined results: null and empty texts have zero features, null metadata values have categories of their own. Equal rows
get equal scores; ids that are labelled more than once take their largest label. Without labels of both kinds all scores
are 0.5. Input columns are not passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florascan.llm.common import stored, table
from florascan.llm.line_crf import FEATURES, text_features

WORD_BUCKETS = 64
N_TEXT = len(FEATURES) + 5 + WORD_BUCKETS
#: Entries of a category: one for null, one for all that are not among the most frequent, and these.
LANGS, SOURCES, LENGTHS = 16, 64, 12
N_META = 1 + LANGS + SOURCES + LENGTHS
VIEWS = "doc_id long, text_view array<float>, meta_view array<int>"


def text_view(text: str | None) -> list[float]:
    (n, chars, symbols, repeats, windows), rows, sizes = text_features(text)
    if not n:
        return [1.0] + [0.0] * (N_TEXT - 1)
    means = (np.array(rows) * np.array(sizes)[:, None]).sum(0) / n
    hashed = np.bincount([crc32(w) % WORD_BUCKETS for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], minlength=WORD_BUCKETS) / n
    return [*means.tolist(), math.log1p(n) / 5, chars / n / 10, min(1.0, symbols / n), repeats / len(rows), windows / n, *hashed.tolist()]


def views(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """(doc_id, text_view, meta_view): dense text features, and the metadata's entries that are one."""

    def category(name: str, size: int):
        if name not in docs.columns:
            return F.lit(0)
        most = docs.groupBy(F.col(name).cast("string").alias("v")).count().filter("v is not null").orderBy(F.desc("count"), "v").limit(size - 2).collect()
        at = F.lit(1)
        if most:
            numbers = F.create_map(*[F.lit(x) for k, r in enumerate(most) for x in (r.v, k + 2)])
            at = F.coalesce(numbers[F.col(name).cast("string")], at)
        return F.when(F.col(name).isNull(), F.lit(0)).otherwise(at)

    length = F.col(n_chars).cast("double") if n_chars in docs.columns else F.lit(None).cast("double")
    bucket = F.when(length.isNull(), F.lit(LENGTHS - 1)).otherwise(F.least(F.lit(LENGTHS - 2), F.floor(F.log2(1 + F.greatest(length, F.lit(0.0))) / 1.5).cast("int")))
    entries = F.array(F.lit(0), 1 + category(lang, LANGS), 1 + LANGS + category(source, SOURCES), 1 + LANGS + SOURCES + bucket.cast("int"))

    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([text_view(t) for t in texts])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.pandas_udf(features, "array<float>")(F.col(text)).alias("text_view"), entries.alias("meta_view"))


def _matrices(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(batch["text_view"].to_numpy()).astype(float)
    m = np.zeros((len(batch), N_META))
    m[np.arange(len(batch))[:, None], np.stack(batch["meta_view"].to_numpy())] = 1.0
    return x, m


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pseudo(p: np.ndarray, low: float, high: float) -> np.ndarray:
    """Confident labels, NaN where there is none."""
    return np.where(p >= high, 1.0, np.where(p <= low, 0.0, np.nan))


def _sums(rows: DataFrame, weights: dict, taught: dict | None, low: float, high: float) -> dict[str, np.ndarray]:
    """Per view and kind (labelled or pseudo, label 0 or 1): row count, gradient and Hessian over all rows."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            seen = dict(zip("tm", _matrices(batch)))
            label = batch["label"].to_numpy(dtype=float, na_value=np.nan)
            held = batch["held"].to_numpy(dtype=bool)
            for view, other in ("tm", "mt"):
                x = seen[view]
                p = _chance(x @ weights[view])
                known = np.where(held, np.nan, label)
                kinds = {"l": known}
                if taught:
                    kinds["p"] = np.where(np.isnan(label), _pseudo(_chance(seen[other] @ taught[other]), low, high), np.nan)
                for kind, y in kinds.items():
                    for value in (0.0, 1.0):
                        at = y == value
                        if at.any():
                            rest, slope = value - p[at], p[at] * (1 - p[at])
                            flat = np.concatenate([[at.sum()], x[at].T @ rest, ((x[at] * slope[:, None]).T @ x[at]).ravel()])
                            key = f"{view}{kind}{int(value)}"
                            total[key] = total.get(key, 0) + flat
        for key, flat in total.items():
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"key": key, "entry": at, "value": flat[at]})

    found = rows.mapInPandas(add, "key string, entry int, value double").groupBy("key", "entry").agg(F.sum("value").alias("value")).collect()
    sums: dict[str, np.ndarray] = {}
    for r in found:
        n = N_TEXT if r.key[0] == "t" else N_META
        sums.setdefault(r.key, np.zeros(1 + n + n * n))[r.entry] = r.value
    return sums


def _newton(rows: DataFrame, weights: dict, taught: dict | None, steps: int, low: float, high: float, pseudo_weight: float, penalty: float) -> dict:
    for _ in range(steps):
        sums, new = _sums(rows, weights, taught, low, high), {}
        for view, n in (("t", N_TEXT), ("m", N_META)):
            grad, hess = -penalty * weights[view], penalty * np.eye(n)
            for kind, share in (("l", 1.0), ("p", pseudo_weight)):
                pair = [sums.get(f"{view}{kind}{v}") for v in (0, 1)]
                if kind == "p" and any(s is None for s in pair):
                    continue  # one-sided lessons would only move the base rate
                for s in pair:
                    if s is not None:
                        grad, hess = grad + share * s[1 : n + 1] / s[0], hess + share * s[n + 1 :].reshape(n, n) / s[0]
            step = np.linalg.solve(hess, grad)
            new[view] = np.round(weights[view] + step * min(1.0, 5 / (np.abs(step).max() + 1e-9)), 9)
        weights = new
    return weights


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate log-odds z, held near (1, the base rate's log-odds)."""
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    theta, x, centre = np.array([1.0, base]), np.stack([z, np.ones_like(z)], 1), np.array([1.0, base])
    for _ in range(30):
        p = _chance(x @ theta)
        theta = theta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (y - p) - (theta - centre))
    return float(max(0.0, theta[0])), float(theta[1])


def co_train(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = 3, steps: int = 3, low: float = 0.1, high: float = 0.9, pseudo_weight: float = 0.5, penalty: float = 1e-2, max_calibration: int = 20000, **names: str) -> DataFrame:
    """(doc_id, text_score, meta_score, score): calibrated chances of good quality by either view and by both."""
    seen = stored(views(docs, **names), "cotraining-views")
    doc_id = names.get("doc_id", "doc_id")
    known = labels.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("label")).filter("__id is not null and label in (0, 1)").groupBy("__id").agg(F.max("label").alias("label"))
    rows = stored(seen.join(known, F.col("doc_id") == F.col("__id"), "left").drop("__id").withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0), "cotraining-rows")

    weights = _newton(rows.filter("label is not null"), {"t": np.zeros(N_TEXT), "m": np.zeros(N_META)}, None, 2 * steps, low, high, 0.0, penalty)
    for _ in range(rounds):
        weights = _newton(rows, weights, dict(weights), steps, low, high, pseudo_weight, penalty)

    held = rows.filter("label is not null and held").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_calibration).toPandas()
    curves, base = {"t": (1.0, 0.0), "m": (1.0, 0.0)}, 0.0
    if len(held) and 0 < held["label"].sum() < len(held):
        held = held.sort_values("doc_id")
        y = held["label"].to_numpy(dtype=float)
        base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        curves = {view: _curve(x @ weights[view], y) for view, x in zip("tm", _matrices(held))}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = {v: (x @ weights[v]) * curves[v][0] + curves[v][1] for v, x in zip("tm", _matrices(batch))} if len(batch) else {"t": np.empty(0), "m": np.empty(0)}
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_score": _chance(z["t"]), "meta_score": _chance(z["m"]), "score": _chance(z["t"] + z["m"] - base)})

    return rows.select("doc_id", "text_view", "meta_view").mapInPandas(score, "doc_id long, text_score double, meta_score double, score double")


def op3_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = co_train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("kept", F.col("score") >= 0.5)
