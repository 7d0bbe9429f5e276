"""Ranked lexical search by best-first document intervals over range-maximum tables.

Items (the queries) are taken in blocks of a bounded number of characters; a block's terms go to the tasks, which read all
documents once and gather shards of some ``shard_docs`` documents: each document's length and, for the block's terms, posting
lists in document order. Shards are written to shared storage; corpus counts (documents, all terms, document frequencies) are
summed from them over every document. Then each shard gets the impacts that these counts define and, for every posting list,
a sparse table of range maxima: level j holds the place of the largest impact among 2^j postings, so the maximum over any run
of postings takes two look-ups.

A search keeps intervals of documents in a heap by upper bound: the sum over the item's terms of weight times the largest
impact in the interval. The interval of largest bound is split at the document where the heaviest term has its maximum; that
document is scored in full, the two remaining intervals get bounds of their own. Intervals of at most ``SMALL`` documents are
scored whole. The search ends when no bound reaches the k-th score, which a task carries from shard to shard, so results are
those of a full scan, ties included. A task sends k rows an item at most.

Defined results: a null text has no terms, nor do texts without ASCII letters, digits or characters beyond ASCII; such documents
count nowhere and are never found, and such items have no rows. Every row is a document or an item of its own, ids may repeat;
a null document id follows all others of its score. Empty tables give an empty one. Other columns are not carried.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.llm.common import stored, table
from florascan.llm.vectors import nullable_ids

#: Terms are runs of ASCII letters, digits and bytes of characters beyond ASCII; only A-Z are lower-cased.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD = "docs binary, nulls binary, lengths binary, terms array<int>, sizes array<int>, places binary, tfs binary, n_docs long, n_terms long"
SMALL = 256


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The part of a score that a term's count and the document's length give."""
    m = 25 + (75 * length * n_docs) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """Posting lists of a shard one after the other, with a sparse table of range maxima over all of them.

    A run of postings never leaves its list, so one table serves all lists; its level j holds for each posting the place
    of the largest impact among the 2^j postings from there on.
    """

    def __init__(self, n_docs: int, starts: dict[int, tuple[int, int]], places: np.ndarray, impact: np.ndarray) -> None:
        self.starts, self.n_docs, self.places, self.impact = starts, n_docs, places, impact
        # one ascending sequence over all postings: list, then document
        self.span = n_docs + 1
        self.lists = {t: k for k, t in enumerate(starts)}
        sizes = np.array([b - a for a, b in starts.values()], dtype=np.int64)
        self.keys = np.repeat(np.arange(len(sizes)) * self.span, sizes) + places
        self.levels = [np.arange(len(places), dtype=np.int32)]
        longest = max((b - a for a, b in starts.values()), default=0)
        while 2 << (len(self.levels) - 1) <= longest:
            half, low = 1 << (len(self.levels) - 1), self.levels[-1]
            level = low.copy()
            left, right = low[:-half], low[half:]
            level[:-half] = np.where(impact[right] > impact[left], right, left)
            self.levels.append(level)
        self.table = np.concatenate(self.levels) if len(places) else np.zeros(0, np.int32)
        self.log = np.zeros(longest + 2, dtype=np.int64)
        for j in range(2, longest + 2):
            self.log[j] = self.log[j >> 1] + 1

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the largest impact of each run [a, b) of postings; runs are not empty."""
        level = self.log[b - a]
        at = level * len(self.places)
        one, two = self.table[at + a], self.table[at + b - (1 << level)]
        return np.where(self.impact[two] > self.impact[one], two, one)


class Searcher:
    """One item's terms in one shard."""

    def __init__(self, shard: Shard, terms: list[tuple[int, int]]) -> None:
        """terms: (term, weight times repeats)."""
        self.shard = shard
        there = [(*shard.starts[t], shard.lists[t] * shard.span, w) for t, w in terms if t in shard.starts and w > 0]
        self.low, self.high, self.base, self.weight = (np.array([x[k] for x in there], dtype=np.int64) for k in range(4))
        self.scored = 0

    def _cut(self, doc: int, which: np.ndarray) -> np.ndarray:
        """For each of the given lists the place of its first posting of doc or a later document."""
        return self.shard.keys.searchsorted(self.base[which] + doc)

    def _bounded(self, low: int, high: int, which: np.ndarray, a: np.ndarray, b: np.ndarray):
        """(-bound, low, high, lists with postings in the interval, their runs, the document to split at)."""
        filled = b > a
        which, a, b = which[filled], a[filled], b[filled]
        if low >= high or not len(which):
            return None
        place = self.shard.largest(a, b)
        reach = self.weight[which] * self.shard.impact[place]
        return -int(reach.sum()), low, high, which, a, b, int(self.shard.places[place[reach.argmax()]])

    def best(self, least: int, offer) -> None:
        """Offer (document, score) of all documents that may reach the least score; offer returns the new least score."""
        count = 0
        whole = self._bounded(0, self.shard.n_docs, np.arange(len(self.low)), self.low, self.high)
        heap = [(whole[0], count, whole)] if whole else []
        while heap and -heap[0][0] >= least:
            _, _, (_, low, high, which, a, b, split) = heapq.heappop(heap)
            if high - low <= SMALL:
                least = offer(*self._scores(low, high, which, a, b))
                continue
            left = self._cut(split, which)
            right = left + (self.shard.places[np.minimum(left, b - 1)] == split)
            has = right > left
            score = (self.weight[which[has]] * self.shard.impact[left[has]]).sum()
            self.scored += 1
            least = offer(np.array([split]), np.array([score]))
            for part in (self._bounded(low, split, which, a, left), self._bounded(split + 1, high, which, right, b)):
                if part and -part[0] >= least:
                    count += 1
                    heapq.heappush(heap, (part[0], count, part))

    def _scores(self, low: int, high: int, which: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the documents of an interval that have one of the terms."""
        lengths = b - a
        rows = np.repeat(a - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        total = np.zeros(high - low, dtype=np.int64)
        np.add.at(total, self.shard.places[rows] - low, np.repeat(self.weight[which], lengths) * self.shard.impact[rows])
        docs = total.nonzero()[0]
        self.scored += len(docs)
        return docs + low, total[docs]


def _gather(vocabulary: dict[bytes, int], shard_docs: int, shard_postings: int):
    """Documents to shards: lengths and the postings of the vocabulary's terms."""

    def shard(ids: list, lengths: list[int], docs: list[int], terms: list[int], tfs: list[int]) -> pd.DataFrame:
        numbers, nulls = nullable_ids(pd.Series(ids, dtype="object"))
        term = np.array(terms, dtype=np.int32)
        order = np.argsort(term, kind="stable")
        seen, sizes = np.unique(term, return_counts=True)
        return pd.DataFrame({
            "docs": [numbers.tobytes()], "nulls": [nulls.tobytes()], "lengths": [np.array(lengths, dtype=np.int64).tobytes()], "terms": [seen], "sizes": [sizes.astype(np.int32)],
            "places": [np.array(docs, dtype=np.int32)[order].tobytes()], "tfs": [np.array(tfs, dtype=np.int32)[order].tobytes()], "n_docs": [len(ids)], "n_terms": [sum(lengths)],
        })

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, docs, terms, tfs = [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = terms_of(text)
                if not words:
                    continue
                own = Counter(filter(vocabulary.__contains__, words))
                docs += [len(ids)] * len(own)
                terms += map(vocabulary.__getitem__, own)
                tfs += own.values()
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) >= shard_docs or len(docs) >= shard_postings:
                    yield shard(ids, lengths, docs, terms, tfs)
                    ids, lengths, docs, terms, tfs = [], [], [], [], []
        if ids:
            yield shard(ids, lengths, docs, terms, tfs)

    return gather


def _search(items: list[tuple[int, list[tuple[int, int]]]], n_docs: int, all_terms: int, k: int):
    """The k best documents of each item among a task's shards."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[tuple[int, int, bool]]] = {}
        for batch in batches:
            for r in batch.itertuples():
                length = np.frombuffer(r.lengths, np.int64)
                places, tf = np.frombuffer(r.places, np.int32), np.frombuffer(r.tfs, np.int32).astype(np.int64)
                ends = np.cumsum(np.asarray(r.sizes, dtype=np.int64))
                starts = {int(t): (int(e) - int(s), int(e)) for t, s, e in zip(r.terms, r.sizes, ends)}
                shard = Shard(r.n_docs, starts, places, impacts(tf, length[places], n_docs, all_terms))
                ids, nulls = np.frombuffer(r.docs, np.int64), np.frombuffer(r.nulls, bool)
                for number, terms in items:
                    own = best.setdefault(number, [])

                    def offer(docs: np.ndarray, scores: np.ndarray, own=own, ids=ids, nulls=nulls) -> int:
                        least = -own[-1][0] if len(own) == k else 1
                        good = (scores >= least).nonzero()[0]
                        if len(good):
                            own += [(-int(scores[j]), int(ids[docs[j]]), bool(nulls[docs[j]])) for j in good]
                            own.sort()
                            del own[k:]
                        return -own[-1][0] if len(own) == k else 1

                    Searcher(shard, terms).best(-own[-1][0] if len(own) == k else 1, offer)
        rows = [(number, None if null else doc_id, -score) for number, own in best.items() for score, doc_id, null in own]
        out = pd.DataFrame(rows, columns=["item", "doc_id", "score"])
        yield out.astype({"item": "int64", "doc_id": "Int64", "score": "int64"})

    return search


def _block(items: list, docs: DataFrame, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """(item, doc_id, score): the k best documents in each task of a block's items."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    counted = []
    for r in items:
        own = Counter(terms_of(r.text))
        counted.append((r.item, [(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in own.items()]))
    shards = stored(docs.mapInPandas(_gather(vocabulary, shard_docs, shard_postings), SHARD), "range-shards")
    n_docs, all_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not n_docs:
        return spark.createDataFrame([], "item long, doc_id long, score long")
    each = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    weights = {r.terms: weight_of(n_docs, r.df) for r in each.collect()}  # the block's terms at most
    weighed = [(number, [(t, n * weights[t]) for t, n in own if t in weights]) for number, own in counted]
    return shards.select("docs", "nulls", "lengths", "terms", "sizes", "places", "tfs", "n_docs").mapInPandas(_search(weighed, n_docs, all_terms, k), "item long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shard_docs: int = 8192, shard_postings: int = 1 << 20, block_chars: int = 1 << 22,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0."""
    asked = stored(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.monotonically_increasing_id().alias("item")), "range-items")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    block = F.pmod(F.xxhash64(F.lit("block"), "item"), F.lit(blocks))
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    found = None
    for number in range(blocks):  # a block has some block_chars characters
        part = _block(asked.filter(block == number).select("item", "text").collect(), corpus, k, shard_docs, shard_postings)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
with d as materialized (select doc_id, unnest({_TERMS}) term from documents),
t as materialized (select doc_id, term, count(*)::bigint tf from d group by all),
n as (select doc_id, sum(tf)::bigint n from t group by doc_id),
c as (select count(*)::bigint big_n, sum(n)::bigint big_l from n),
m as (select doc_id, 25 + (75 * n * big_n) // big_l m from n, c),
w as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint w from t, c group by term, big_n),
q as (select item_id, term, count(*)::bigint times from (select item_id, unnest({_TERMS}) term from benchmark) group by all),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from q join t using (term) join w using (term) join m using (doc_id) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 10
"""
