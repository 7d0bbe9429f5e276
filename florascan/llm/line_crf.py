"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

A line is a ``\\n``-separated piece with at least one word (``[^\\x20\\x09-\\x0D]+``). Each line has a feature vector; the
field scores a state (content or boilerplate) by its features and by the state of the line before, and Viterbi decoding
gives the most likely sequence for the whole text. A document is kept if it passes the base rules (enough words, few
words in repeated windows) and the words of its content lines are at least ``min_content`` of its words.

The field is fitted by maximum likelihood on all lines of at most ``max_labelled`` labelled documents (those whose ids have
the smallest hashes; documents of more than ``max_lines`` lines are not fitted on). A line of a rejected document is
boilerplate, one of a good document content, unless it is shared: a line that stands between different neighbours in
``shared_contexts`` places or more (a licence, a notice, a passage that many documents carry) is boilerplate in good
documents, too. Copies of a document have the same neighbours, so they do not make their lines shared. Only line features
and hashes reach the driver. All documents are then decoded whole.

Defined results: a null or empty text has no words, fails the base rules and has content share zero. Repeated rows are
judged one by one; of rows that repeat a labelled id the one with the smallest hash of its text is fitted on. Without any
labelled document the field has the fixed weights of ``DEFAULT_MODEL``. Input columns named like an output column are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florascan.llm.common import hidden, table

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Marks of a notice, without their first letters, whose case differs.
NOTICES = ("icense", "opyright", "ights reserved", "ookie", "ubscribe", "erms of use")
DIGITS = re.compile(r"[0-9]")
FEATURES = ("bias", "log_words", "short", "symbols", "upper", "stutter", "shouts", "bars", "ends", "repeated", "notice", "digits")
WINDOW = 8
#: Lines of a sequence that is fitted on; longer documents are fitted on piece by piece.
PIECE = 64

#: Weights of content against boilerplate for each feature; score of staying in boilerplate, of staying in content; start.
DEFAULT_MODEL = {"emit": [1.0, 0.5, -0.3, -4.0, -4.0, -5.0, -4.0, -3.0, 0.5, -1.5, -1.0, -1.0], "stay": [0.5, 0.5], "start": 0.5}

VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, line_marks string, kept boolean"
COLUMNS = tuple(c.split()[0] for c in VERDICT.split(", "))


def repeated_window_words(words: list, window: int = WINDOW) -> int:
    """Words in windows found twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    rank = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    mixed = rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rolled = mixed[:n].copy()
    for k in range(1, window):  # windows whose hashes all differ all differ
        rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():
        return 0
    length = 1
    while length < window:  # exact: ranks of windows of 1, 2, 4, 8 words
        step = min(length, window - length)
        _, rank = np.unique(rank[: len(rank) - step] * (rank.max() + 1) + rank[step:], return_inverse=True)
        length += step
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_features(text: str | None) -> tuple[tuple, list[list[float]], list[int]]:
    """Base figures (words, their characters, symbols, repeated lines, repeated words); each line's features and words."""
    words, rows, sizes, seen = [], [], [], set()
    symbols = repeats = 0
    for line in (text or "").split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        n = len(own)
        if not n:
            continue
        words += own
        marks = len(SYMBOLS.findall(line))
        symbols += marks
        again = line in seen
        seen.add(line)
        repeats += again
        rows.append([
            1.0, np.log1p(n) / 3, float(n < 4), min(1.0, marks / n), sum(map(bytes.isupper, own)) / n, sum(map(eq, own, own[1:])) / n, min(1.0, line.count("!!") / n), min(1.0, line.count("|") / n),
            float(own[-1][-1:] in b".!?"), float(again), float(any(mark in line for mark in NOTICES)), min(1.0, len(DIGITS.findall(line)) / n),
        ])
        sizes.append(n)
    text = text or ""
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (len(words), chars, symbols, repeats, repeated_window_words(words)), rows, sizes


def viterbi(scores: np.ndarray, model: dict) -> list[int]:
    """The best states (1 content, 0 boilerplate) for lines whose content scores are given; content wins ties."""
    stay_off, stay_on = model["stay"]
    off, on, back = 0.0, model["start"], []
    for k, s in enumerate(scores.tolist()):
        if k:
            to_off = (off + stay_off, 0) if off + stay_off > on else (on, 1)
            to_on = (on + stay_on, 1) if on + stay_on >= off else (off, 0)
            back.append((to_off[1], to_on[1]))
            off, on = to_off[0], to_on[0]
        on += s
    if not len(scores):
        return []
    state = int(on >= off)
    path = [state]
    for moves in reversed(back):
        state = moves[state]
        path.append(state)
    return path[::-1]


def _verdicts(texts: pd.Series, model: dict, min_words: int, max_repeat: int, min_content: float) -> pd.DataFrame:
    parsed = [text_features(t) for t in texts]
    scores = np.array([row for _, rows, _ in parsed for row in rows], dtype=float).reshape(-1, len(FEATURES)) @ np.array(model["emit"])
    out, at = [], 0
    for base, rows, sizes in parsed:
        states = viterbi(scores[at : at + len(rows)], model)
        at += len(rows)
        content = sum(n for n, s in zip(sizes, states) if s)
        share = content / base[0] if base[0] else 0.0
        failed = base[0] < min_words or 100 * base[4] > max_repeat * base[0]
        out.append((*base, failed, len(rows), sum(states), share, "".join("bc"[s] for s in states), not failed and share >= min_content))
    return pd.DataFrame(out, columns=list(COLUMNS))


def line_labels(hashes: list[np.ndarray], labels: list[int], shared_contexts: int = 4) -> list[np.ndarray]:
    """Labels of each document's lines: the document's own, but 0 for lines that several different neighbours surround."""
    around: dict[int, set] = {}
    for own in hashes:
        own = own.tolist()
        for k, h in enumerate(own):
            seen = around.setdefault(h, set())
            if len(seen) < shared_contexts:
                seen.add((own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None))
    shared = {h for h, seen in around.items() if len(seen) >= shared_contexts}
    return [np.array([float(label == 1 and h not in shared) for h in own.tolist()]) for own, label in zip(hashes, labels)]


def fit_field(lines: list[np.ndarray], states: list[np.ndarray], steps: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> dict:
    """Maximum likelihood by gradient ascent on documents with labelled lines; sums run over all pieces at once.

    Every document counts alike.
    """
    good = sum(y.mean() for y in states) if states else 0.0
    if not 0 < good < len(states):
        return DEFAULT_MODEL
    cut = [(rows[k : k + PIECE], y[k : k + PIECE], 1 / len(rows)) for rows, y in zip(lines, states) for k in range(0, len(rows), PIECE)]
    longest = max(len(rows) for rows, _, _ in cut)
    x = np.zeros((len(cut), longest, len(FEATURES)))
    there, y, weight = np.zeros((len(cut), longest)), np.zeros((len(cut), longest)), np.zeros((len(cut), longest))
    for k, (rows, own, share) in enumerate(cut):
        x[k, : len(rows)] = rows
        there[k, : len(rows)], y[k, : len(rows)] = 1, own
        weight[k, : len(rows)] = share
    theta = np.zeros(len(FEATURES) + 3)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    pair = there[:, 1:]
    for step in range(1, steps + 1):
        emit, stay, start = theta[:-3], theta[-3:-1], theta[-1]
        s = np.stack([np.zeros(x.shape[:2]), x @ emit], axis=2)  # sequence, line, state
        move = np.array([[stay[0], 0.0], [0.0, stay[1]]])
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0] + np.array([0.0, start])
        for t in range(1, longest):
            new = np.logaddexp(fwd[:, t - 1, :1] + move[0], fwd[:, t - 1, 1:] + move[1]) + s[:, t]
            fwd[:, t] = np.where(there[:, t, None] > 0, new, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = bwd[:, t + 1] + s[:, t + 1]
            new = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
            bwd[:, t] = np.where(there[:, t + 1, None] > 0, new, 0.0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        on = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * there
        both = [np.exp(fwd[:, :-1, a] + stay[a] + s[:, 1:, a] + bwd[:, 1:, a] - z[:, None]) * pair for a in (0, 1)]
        grad = np.zeros_like(theta)
        grad[:-3] = np.einsum("nt,ntf->f", (y - on) * weight, x)
        grad[-3] = (((1 - y[:, :-1]) * (1 - y[:, 1:]) - both[0]) * pair * weight[:, 1:]).sum()
        grad[-2] = ((y[:, :-1] * y[:, 1:] - both[1]) * pair * weight[:, 1:]).sum()
        grad[-1] = ((y[:, 0] - on[:, 0]) * weight[:, 0]).sum()
        grad = grad / len(states) - penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    theta = np.round(theta, 6)
    return {"emit": theta[:-3].tolist(), "stay": theta[-3:-1].tolist(), "start": float(theta[-1])}


def train_field(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", max_labelled: int = 2000, max_lines: int = 10_000, shared_contexts: int = 4) -> dict:
    """Fit on the lines of at most max_labelled labelled documents; line features are computed where the texts are."""
    chosen = labels.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("__label")).filter("__id is not null and __label in (0, 1)")
    chosen = chosen.groupBy("__id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie")).join(F.broadcast(chosen), "__id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for i, y, tie, t in zip(batch["__id"], batch["__label"], batch["tie"], batch["__text"]):
                own = [line for line in (t or "").split("\n") if line.encode("utf-8", "surrogatepass").split()]
                if 0 < len(own) <= max_lines:
                    flat = [v for row in text_features(t)[1] for v in row]
                    found.append((i, y, tie, flat, [xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) >> 1 for line in own]))
            yield pd.DataFrame(found, columns=["id", "label", "tie", "flat", "hashes"])

    each = rows.mapInPandas(features, "id long, label int, tie long, flat array<float>, hashes array<long>").groupBy("id").agg(F.min_by(F.struct("label", "flat", "hashes"), "tie").alias("x"))
    found = each.orderBy("id").select("x.*").collect()
    lines = [np.array(r.flat, dtype=float).reshape(-1, len(FEATURES)) for r in found]
    return fit_field(lines, line_labels([np.array(r.hashes, dtype=np.int64) for r in found], [r.label for r in found], shared_contexts))


def judge_lines(docs: DataFrame, model: dict, text: str = "text", min_words: int = 20, max_repeat: int = 30, min_content: float = 0.5) -> DataFrame:
    """docs with the base figures, the marks of their lines (c or b), the content share and the verdict."""

    @F.pandas_udf(VERDICT)
    def verdicts(texts: pd.Series) -> pd.DataFrame:
        parts = [_verdicts(texts.iloc[k : k + 500], model, min_words, max_repeat, min_content) for k in range(0, len(texts), 500)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=list(COLUMNS))

    judged = docs.withColumn("__verdict", verdicts(F.col(text)))
    return hidden(judged, *COLUMNS).select("*", "__verdict.*").drop("__verdict")


def op4_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge_lines(docs, train_field(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *COLUMNS)
