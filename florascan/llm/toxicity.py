"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are whole words and word beginnings (4 to 6 letters) of the lower-cased text, with their real counts. The cosine is
over the terms that a labelled sample, without its copies, ties to the toxic label: all those whose G statistic and odds
reach ``min_g`` and ``min_odds``, however many they are (of terms that begin alike, the one tied most). Over all terms the
words of a subject outweigh a few insults in a long text (see README for figures). ``fit`` counts in how many of *all*
documents each term occurs, and indexes the sample's vectors, (1 + ln count) * idf, with one more term that every text has. The index holds, for each term,
postings in blocks of 64 examples with the largest weight of each block; a search visits blocks by falling upper bound and
ends when no block can reach the k-th cosine, so its neighbours are exactly those of a full scan (ties: the smaller
example number). Votes are weighted by squared cosine, shrunk towards the sample's base rate, and calibrated by a logistic
curve fitted on leave-one-out votes. The neighbours are returned as evidence.

Bound: at most ``max_labelled`` labelled rows (smallest id hashes); terms and index, and so what each task holds, come from
these alone. Document frequencies and scores cover every document and whole texts.

Defined results: a null or empty text, or one without any tied term, has no neighbours; its score is the toxic share of
the examples without terms. Without labelled rows every score is 0. Equal texts have equal scores. Of rows that repeat a
labelled id the one with the smallest hash of its text is the example. Input columns named score, predicted or evidence
are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florascan.llm.common import hidden, stored, table
from florascan.llm.simhash import shingle_hashes

NOT_LETTERS = re.compile(r"[\W\d_]+")
PREFIXES = (4, 5, 6)
#: A term is tied to the label by its occurring at least once, twice ... so many times.
TIED_COUNTS = 3
BLOCK = 64
#: A term that ends every text; beside it a cosine tells one mention from many.
END, END_WEIGHT = -1, 3.0
SCORED = "score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,label:int>>"


def plain(text: str | None) -> str:
    """Lower-case words of letters, each between single spaces."""
    return f" {NOT_LETTERS.sub(' ', (text or '').lower())} "


def text_terms(text: str | None) -> dict[str, int]:
    """Counts of a text's patterns, to look for in plain(): " word " for its whole words, " wor" for their beginnings."""
    words = Counter(plain(text).split(" "))
    del words[""]
    counts: Counter = Counter()
    for w, n in words.items():
        counts[f" {w} "] += n
        for size in PREFIXES:
            if len(w) >= size:
                counts[f" {w[:size]}"] += n
    return counts


#: (term number, count) of the terms that a text has, ascending.
Features = tuple[tuple[int, int], ...]


class Matcher:
    """Counts the tied terms in a text, all in one pass."""

    def __init__(self, terms: list[str]) -> None:
        self.machine = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            self.machine.add_word(term, k)
        if terms:
            self.machine.make_automaton()
        self.empty = not terms

    def __call__(self, text: str | None) -> Features:
        if self.empty or not text:
            return ()
        return tuple(sorted(Counter(k for _, k in self.machine.iter(plain(text))).items()))


class BlockMaxIndex:
    """Unit vectors of the examples as postings in blocks of BLOCK examples, with each block's largest weight."""

    def __init__(self, vectors: list[Features], idf: np.ndarray) -> None:
        self.idf, self.n_blocks = idf, len(vectors) // BLOCK + 1
        by_term: dict[int, list[tuple[int, float]]] = {}
        for example, features in enumerate(vectors):
            for term, weight in self.unit(features):
                by_term.setdefault(term, []).append((example, weight))
        self.postings = {}
        for term, pairs in by_term.items():
            who = np.array([p[0] for p in pairs], dtype=np.int64)
            weight = np.array([p[1] for p in pairs])
            blocks, first = np.unique(who // BLOCK, return_index=True)
            self.postings[term] = (who, weight, blocks, np.append(first, len(who)), np.maximum.reduceat(weight, first))

    def unit(self, features: Features) -> list[tuple[int, float]]:
        weights = [(END, END_WEIGHT)] + [(t, (1 + math.log(n)) * float(self.idf[t])) for t, n in features]
        norm = math.sqrt(sum(w * w for _, w in weights)) or 1.0
        return [(t, w / norm) for t, w in weights]

    def nearest(self, features: Features, k: int, without: int = -1) -> list[tuple[int, float]]:
        """The k examples of largest cosine above zero."""
        query = [(w, *self.postings[t]) for t, w in self.unit(features) if t in self.postings]
        if not query:
            return []
        bound = np.zeros(self.n_blocks)
        for w, _, _, blocks, _, largest in query:
            bound[blocks] += w * largest
        found: list[tuple[float, int]] = []
        least = 0.0
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or bound[block] + 1e-9 < least:
                break
            cosine = np.zeros(BLOCK)
            for w, who, weight, blocks, first, _ in query:
                at = int(np.searchsorted(blocks, block))
                if at < len(blocks) and blocks[at] == block:
                    a, b = first[at], first[at + 1]
                    cosine[who[a:b] - block * BLOCK] += w * weight[a:b]
            found += [(round(float(cosine[j]), 9), int(j) + block * BLOCK) for j in np.flatnonzero(cosine > 0) if j + block * BLOCK != without]
            if len(found) >= k:
                found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                least = found[-1][0]
        return [(j, c) for c, j in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]


def _vote(neighbours: list[tuple[int, float]], labels: list[int], base: float, prior_votes: float = 1.0) -> float:
    weight = sum(c * c for _, c in neighbours)
    return (sum(c * c * labels[j] for j, c in neighbours) + prior_votes * base) / (weight + prior_votes)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _calibrate(votes: list[float], labels: list[int], penalty: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a vote's log-odds to the label, by Newton steps."""
    x = np.array([[_logit(v), 1.0] for v in votes])
    up = (sum(labels) + 1) / (sum(labels) + 2)
    y = np.where(np.array(labels) == 1, up, 1 / (len(labels) - sum(labels) + 2))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (y - p) - penalty * (theta - [1.0, 0.0])
        theta = theta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(2), grad)
    return (float(theta[0]), float(theta[1])) if np.isfinite(theta).all() and theta[0] > 0 else (1.0, 0.0)


def _tied_terms(sample: DataFrame, min_g: float, min_odds: float) -> list[str]:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [Counter(), Counter()]
            for text, label in zip(batch["__text"], batch["__label"]):
                own[label].update((term, least) for term, n in text_terms(text).items() for least in range(1, min(n, TIED_COUNTS) + 1))
            seen = list(own[1].keys() | own[0].keys())
            yield pd.DataFrame({"term": [t for t, _ in seen], "least": [n for _, n in seen], "toxic": [own[1][t] for t in seen], "clean": [own[0][t] for t in seen]})

    size = sample.agg(F.sum("__label").cast("double"), F.count(F.lit(1)).cast("double")).first()
    toxic, rows = size[0] or 0.0, size[1]
    if not 0 < toxic < rows:
        return []
    distinct = _one_of_each(sample)
    counts = distinct.mapInPandas(count, "term string, least int, toxic long, clean long").groupBy("term", "least").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).filter("a > 1")
    share, seen = F.lit(toxic / rows), F.col("a") + F.col("b")

    def part(n, expected):
        return F.when(n > 0, 2 * n * F.ln(n / expected)).otherwise(F.lit(0.0))

    out_a, out_b = F.lit(toxic) - F.col("a"), F.lit(rows - toxic) - F.col("b")
    g = part(F.col("a"), seen * share) + part(F.col("b"), seen * (1 - share)) + part(out_a, (out_a + out_b) * share) + part(out_b, (out_a + out_b) * (1 - share))
    odds = (F.col("a") + 0.5) * (out_b + 0.5) / ((F.col("b") + 0.5) * (out_a + 0.5))
    kept = counts.withColumns({"g": F.round(g, 6), "odds": odds}).filter((F.col("g") >= min_g) & (F.col("odds") >= min_odds))
    best = kept.groupBy("term").agg(F.max("g").alias("g"))
    found = [r.term for r in best.orderBy(F.desc("g"), F.desc(F.length("term")), "term").collect()]
    terms: list[str] = []
    for pattern in found:  # of patterns that begin alike, the one tied most
        if not any(pattern.strip().startswith(t.strip()) or t.strip().startswith(pattern.strip()) for t in terms):
            terms.append(pattern)
    return terms


def _one_of_each(sample: DataFrame) -> DataFrame:
    """One text of those that share the smallest hash of their word shingles: copies must not make their words look tied."""

    @F.pandas_udf("long")
    def least_hash(texts: pd.Series) -> pd.Series:
        return pd.Series([int(h.min() >> np.uint64(1)) if len(h) else -1 for h in (shingle_hashes(t, 5) for t in texts)], dtype="int64")

    hashed = sample.withColumn("__least", least_hash("__text"))
    return hashed.groupBy("__least", "__label").agg(F.min_by("__text", "__id").alias("__text"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    max_labelled: int = 12000,
    min_g: float = 20.0,
    min_odds: float = 6.0,
    neighbours: int = 15,
) -> dict:
    """The model: terms, their frequencies over all docs, the sample's vectors and labels, base rates and calibration."""
    chosen = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")).filter("__id is not null and __label in (0, 1)")
    chosen = chosen.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    sample = stored(texts.join(F.broadcast(chosen), "__id"), "toxicity-sample")
    terms = _tied_terms(sample, min_g, min_odds)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, seen, n = Matcher(terms), Counter(), 0
        for batch in batches:
            for t in batch["__text"]:
                seen.update(k for k, _ in match(t))
            n += len(batch)
        yield pd.DataFrame({"term": [-1, *seen], "n": [n, *seen.values()]})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(terms)
        for batch in batches:
            found = [match(t) for t in batch["__text"]]
            yield pd.DataFrame({"id": batch["__id"], "label": batch["__label"], "tie": batch["tie"], "terms": [[k for k, _ in f] for f in found], "counts": [[n for _, n in f] for f in found]})

    df = dict(map(tuple, texts.select("__text").mapInPandas(frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect()))
    n_docs = df.pop(-1, 0)
    hashed = sample.withColumn("tie", F.xxhash64(F.coalesce("__text", F.lit(""))))
    each = hashed.mapInPandas(vectors, "id long, label int, tie long, terms array<int>, counts array<int>").groupBy("id").agg(F.min_by(F.struct("label", "terms", "counts"), "tie").alias("x"))
    rows = each.select("id", "x.*").collect()
    rows.sort(key=lambda r: r.id)
    examples = [(r.id, r.label, tuple(zip(r.terms, r.counts))) for r in rows]
    idf = [math.log((1 + n_docs) / (1 + df.get(k, 0))) + 1 for k in range(len(terms))]
    model = {"terms": terms, "idf": idf, "examples": [x for x in examples if x[2]], "k": neighbours}
    model["base"] = (sum(x[1] for x in examples) + 0.1) / (len(examples) + 1) if examples else 0.0
    bare = [x[1] for x in examples if not x[2]]
    model["bare"] = (sum(bare) + model["base"]) / (len(bare) + 1) if examples else 0.0
    index, known = BlockMaxIndex([x[2] for x in model["examples"]], np.array(idf)), [x[1] for x in model["examples"]]
    votes = [_vote(index.nearest(x[2], neighbours, without=k), known, model["base"]) for k, x in enumerate(model["examples"])]
    model["curve"] = _calibrate(votes + [model["bare"]] * len(bare), known + bare) if examples else (1.0, 0.0)
    return model


class Scorer:
    """Scores texts by a model; the index is built once for all of a task's texts."""

    def __init__(self, model: dict) -> None:
        self.model, self.match, self.seen = model, Matcher(model["terms"]), {}
        self.index = BlockMaxIndex([x[2] for x in model["examples"]], np.array(model["idf"]))
        self.labels = [x[1] for x in model["examples"]]

    def score(self, text: str | None) -> tuple:
        model, features = self.model, self.match(text)
        if features not in self.seen:
            near = self.index.nearest(features, model["k"]) if features else []
            vote = _vote(near, self.labels, model["base"]) if near else model["bare"]
            slope, offset = model["curve"]
            score = 1 / (1 + math.exp(-(slope * _logit(vote) + offset))) if model["base"] else 0.0
            evidence = [{"doc_id": model["examples"][j][0], "cosine": c, "label": self.labels[j]} for j, c in near]
            if len(self.seen) >= 2_000:  # bounds what a task remembers
                self.seen.clear()
            self.seen[features] = (score, int(score >= 0.5), evidence)
        return self.seen[features]

    def __call__(self, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([self.score(t) for t in texts], columns=["score", "predicted", "evidence"])


def score_toxicity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with score, predicted (1 from 0.5 on) and evidence (the nearest labelled examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield scorer(texts)

    judged = docs.withColumn("__scored", F.pandas_udf(scored, SCORED)(F.col(text)))
    return hidden(judged, "score", "predicted", "evidence").select("*", "__scored.*").drop("__scored")


def _remainder(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows whose labels may be learnt from."""
    return labels.filter(_remainder("doc_id") != 0)


def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (_remainder("doc_id") == 0).alias("held_out"), "score", "predicted", "evidence")
