"""SimHash near-duplicates, candidates by the pigeonring principle.

A fingerprint holds, bit by bit, the majority of the 64-bit hashes of a text's word shingles. Fingerprints within
``tau`` bits are linked, and connected fingerprints form a group.

Candidates come from distinct fingerprints only, so copies meet once. A fingerprint is cut into ``tau + 1`` segments on
a ring. For two fingerprints within tau bits, some segment i starts a chain in which every run of l consecutive segments
differs in at most ``l * tau / (tau + 1)`` bits. The first two budgets of the chain are the join key: segment i is equal
(budget 0) and segment i + 1 differs in at most one bit, so one side is listed under its two segments and the other under
each value within one bit of its second. Every key holds two thirds of the bits, whatever the size of the corpus; the
budgets of the longer runs prune the pairs, and the full Hamming distance is checked last. No link is lost.

``similar_groups`` and ``near_dedup`` serve corpora: they group texts of a similarity of 0.8 or more on five-word shingles,
by wide fingerprints (see there).

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like any other. A text
with fewer words than a shingle has one shingle of all its words. Equal ids are one document; a null id counts only where
a group has no other: ``near_groups`` gives such a group a null component, ``near_dedup`` keeps all of its rows. Of rows
with the same id ``near_dedup`` keeps all or none. An empty table gives an empty one. Input columns named fingerprint or
component_id are replaced.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florascan.llm.common import hidden, spread_join, stored, table
from florascan.operators.graph import connected_components

CHUNK = 1 << 16


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of width words (A-Z lower-cased, joined by spaces); of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = list(accumulate(map(len, words)))
    n = len(words) - width + 1
    starts = [0] + [e + k for k, e in enumerate(ends[: n - 1], 1)]
    stops = [e + k for k, e in enumerate(ends[width - 1 :], width - 1)]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)


def simhash(text: str | None, width: int = 5) -> int:
    """The signed 64-bit fingerprint."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 5, text: str = "text") -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return fingerprint(F.col(text))


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _segments(tau: int) -> list[tuple[int, int]]:
    """(lowest bit, bit after the highest) of the tau + 1 segments."""
    edges = [round(64 * k / (tau + 1)) for k in range(tau + 2)]
    return list(zip(edges, edges[1:]))


def _mask(tau: int, i: int) -> int:
    low, high = _segments(tau)[i % (tau + 1)]
    return (1 << high) - (1 << low)


def chain_holds(x: Column, i: int, tau: int) -> Column:
    """Every run of l segments from segment i on is within its proportional budget; x holds the differing bits."""
    mask, holds = 0, F.lit(True)
    for length in range(1, tau + 2):
        mask |= _mask(tau, i + length - 1)
        holds = holds & (F.bit_count(x.bitwiseAND(F.lit(_signed(mask)))) <= (length * tau) // (tau + 1))
    return holds


def links(prints: DataFrame, tau: int = 2) -> DataFrame:
    """(a, b) with a > b: all pairs of distinct fingerprints of the column fp that are within tau bits."""
    fp = F.col("fp")
    own, near = [], []
    for i in range(tau + 1):
        key = fp.bitwiseAND(F.lit(_signed(_mask(tau, i) | _mask(tau, i + 1))))
        low, high = _segments(tau)[(i + 1) % (tau + 1)]
        flips = [0] + [_signed(1 << bit) for bit in range(low, high) if tau]
        own.append(F.struct(F.lit(i).alias("i"), key.alias("key")))
        near += [F.struct(F.lit(i).alias("i"), key.bitwiseXOR(F.lit(flip)).alias("key")) for flip in flips]
    left = prints.select(fp.alias("a"), F.explode(F.array(*own)).alias("at")).select("a", "at.i", "at.key")
    right = prints.select(fp.alias("b"), F.explode(F.array(*near)).alias("at")).select("b", "at.i", "at.key")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(False)
    for i in range(tau + 1):
        chain = chain | ((F.col("i") == i) & chain_holds(differing, i, tau))
    return left.join(right, ["i", "key"]).filter((F.col("a") > F.col("b")) & chain & (F.bit_count(differing) <= tau)).select("a", "b").distinct()


def near_groups(docs: DataFrame, width: int = 5, tau: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of docs, with the smallest id of its group."""
    docs = hidden(docs, *({"fingerprint", "component_id"} - {doc_id, text}))
    printed = stored(docs.select(F.col(doc_id), fingerprints(docs, width, text).alias("fp")), "simhash-prints")
    classes = stored(printed.groupBy("fp").agg(F.min(doc_id).alias("least")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), tau))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return spread_join(printed, named, "fp", doc_id).select(doc_id, digits.alias("fingerprint"), "component_id")


# --- similarity of 0.8: wide fingerprints ----------------------------------------------------------------------------

#: Words of a fingerprint, and those of them from whose bits the rings of segments are cut.
WIDE_WORDS, RING_WORDS = 32, 8
#: Segments of the chain: runs of as many words.
CHAIN = 8
#: Share of SimHash bits in which two texts of a similarity of 0.8 differ: the angle of cosine 2 * 0.8 / 1.8.
APART = math.acos(1.6 / 1.8) / math.pi
#: What makes many hashes of one.
MIXERS = np.array([2 * k + 1 for k in range(1, WIDE_WORDS + 1)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    z = (hashes ^ MIXERS[k]) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def wide_simhash(texts: list[str | None], width: int = 5) -> np.ndarray:
    """Signed 64-bit words, WIDE_WORDS for each text: SimHash over that many independent hashes of each shingle.

    Bits are counted by bytes: how often each of 256 values stands at a place, times its bits.
    """
    out = np.zeros((len(texts), WIDE_WORDS), dtype=np.int64)
    group, size, start = [], 0, 0
    for at, text in enumerate(texts):
        group.append(shingle_hashes(text, width))
        size += len(group[-1])
        if size < (1 << 20) and len(group) < 512 and at < len(texts) - 1:
            continue
        hashes = np.concatenate(group)
        counts = np.array([len(h) for h in group], dtype=np.int64)
        base = np.repeat(np.arange(len(group)) * 256, counts)
        for k in range(WIDE_WORDS):
            places = _mixed(hashes, k).view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(base + places[:, j], minlength=256 * len(group)).reshape(-1, 256) @ BYTE_BITS for j in range(8)], axis=1)
            out[start : at + 1, k] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
        group, size, start = [], 0, at + 1
    return out


def ring_shape(nodes: int, found: float = 0.97, spare_bits: int = 4) -> tuple[int, int]:
    """(bits of a segment, segments) for so many fingerprints.

    A segment has a few bits more than the fingerprints have numbers, so that a bucket holds as many strangers at every
    size of a corpus. There are as many segments as it takes for two texts of a similarity of 0.8 to agree in one of them
    with the chance ``found``, which therefore is the same at every size, too.
    """
    bits = min(56, max(8, math.ceil(math.log2(max(nodes, 2)) + spare_bits)))
    return bits, math.ceil(math.log(1 - found) / math.log(1 - (1 - APART) ** bits))


def ring_segments(prints: np.ndarray, bits: int, segments: int) -> np.ndarray:
    """Keys of the segments: rings are fixed permutations of the first words' bits, cut into consecutive segments."""
    ringed = np.ascontiguousarray(prints[:, :RING_WORDS], dtype=np.int64)
    set_bits = np.unpackbits(ringed.view(np.uint8), axis=1, bitorder="little")
    weights, keys, on_ring = np.int64(1) << np.arange(bits, dtype=np.int64), [], 64 * RING_WORDS // bits
    for ring in range(-(-segments // on_ring)):
        order = np.random.RandomState(ring).permutation(64 * RING_WORDS)[: on_ring * bits]
        keys.append(set_bits[:, order].reshape(len(prints), on_ring, bits).astype(np.int64) @ weights)
    return np.concatenate(keys, axis=1)[:, :segments]


def wide_chain_holds(gaps: Column, tau: int) -> Column:
    """Some segment starts a chain on the ring in which every run of l differs in at most l * tau / CHAIN bits."""
    holds = F.lit(False)
    for i in range(CHAIN):
        run, chain = F.lit(0), F.lit(True)
        for length in range(1, CHAIN + 1):
            run = run + gaps[(i + length - 1) % CHAIN]
            chain = chain & (run <= length * tau // CHAIN)
        holds = holds | chain
    return holds


def similar_groups(docs: DataFrame, width: int = 5, tau: int = 332, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id): groups of texts whose shingles have a similarity of about 0.8 or more.

    At that similarity SimHash bits differ in 15 % of places, ten of 64: too many for an index of 64-bit fingerprints, and
    too few places to tell 0.8 from 0.7. Fingerprints have 2,048 bits here and tau is 332 of these, which nine in ten pairs
    of a similarity of 0.8 keep, one in ten at 0.75 and none at 0.7. Rings of segments give the candidates: an equal
    segment starts the chain, the running budgets over the ring of words prune, the full distance decides. With so large
    a tau no segment must be equal, so a candidate is found with a chance, which ``ring_shape`` holds at 97 in 100 for 0.8
    and which grows with the similarity. ``wide_roots`` loses no pair of a bucket.
    """

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(list(wide_simhash(texts.tolist(), width)))

    printed = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.pandas_udf(prints, "array<bigint>")(F.col(text)).alias("fp")), "simhash-prints")
    classes = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"), "simhash-classes")
    roots = wide_roots(classes, tau)
    named = classes.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return spread_join(printed, named, "fp", "doc_id").select("doc_id", "component_id")


def _apart(words: int) -> Column:
    return sum((F.bit_count(F.col("a_fp")[k].bitwiseXOR(F.col("b_fp")[k])) for k in range(words)), F.lit(0))


def _wide_within(tau: int) -> Column:
    """Whether a_fp and b_fp keep the chain's budgets and tau."""
    each = WIDE_WORDS // CHAIN
    gaps = F.array(*[sum((F.bit_count(F.col("a_fp")[k].bitwiseXOR(F.col("b_fp")[k])) for k in range(i * each, (i + 1) * each)), F.lit(0)) for i in range(CHAIN)])
    # A list of one, so that the gaps are computed once for all conditions on them.
    return F.exists(F.array(gaps), lambda g: (F.aggregate(g, F.lit(0), lambda x, y: x + y) <= tau) & wide_chain_holds(g, tau))


def _wide_near(pairs: DataFrame, classes: DataFrame, tau: int, salts: int = 4) -> DataFrame:
    """(a, b) of the pairs (a, b) of nodes that are near; a node stands in many pairs as b only."""
    pairs = stored(pairs, "simhash-pairs")
    a, b = classes.select(F.col("node").alias("a"), F.col("fp").alias("a_fp")), classes.select(F.col("node").alias("b"), F.col("fp").alias("b_fp"))
    named = b.join(pairs.select("b").distinct(), "b", "left_semi")
    return spread_join(pairs, named, "b", "a", salts=salts).join(a, "a").filter(_wide_within(tau)).select("a", "b")


def _apart_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, ring, segment, root, size) of the members of buckets that hold several roots; a node without a root is its own."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("ring", "segment").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    return rooted.join(mixed.select("ring", "segment", "size"), ["ring", "segment"])


def _hub_pairs(rooted: DataFrame) -> DataFrame:
    """(a, b): each node with the hub of another root that it meets in most buckets; a bucket's hub is the least node of its least root."""
    hubs = rooted.groupBy("ring", "segment").agg(F.min(F.struct("root", "node")).alias("hub"))
    met = rooted.join(hubs, ["ring", "segment"]).filter("root <> hub.root").groupBy("node", "hub.node").agg(F.count(F.lit(1)).alias("n")).toDF("a", "hub", "n")
    return met.groupBy("a").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("b"))


def wide_roots(classes: DataFrame, tau: int = 332, slice_rows: int = 256, hub_rounds: int = 2) -> DataFrame:
    """(node, root) of the linked nodes of classes (node, fp): those that share a segment and are within tau bits.

    In ``hub_rounds`` rounds each node is compared with one other, the hub that it meets in most buckets, which connects
    large groups without their pairs. Members of a bucket that are connected by then need no further link; all others are
    compared, each with each: a hub may be a stranger to them. Buckets are compared in slices of about slice_rows members,
    so no task holds a large one.
    """
    bits, count = ring_shape(classes.count())

    def segments(values: pd.Series) -> pd.Series:
        parts = [ring_segments(np.stack(values.iloc[k : k + 1000].to_numpy()), bits, count) for k in range(0, len(values), 1000)]
        return pd.Series([row for part in parts for row in part], dtype=object)

    keyed = classes.select("node", F.posexplode(F.pandas_udf(segments, "array<bigint>")("fp")).alias("ring", "segment")).select("node", F.col("ring").cast("short").alias("ring"), "segment")
    several = keyed.groupBy("ring", "segment").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    members = stored(keyed.join(several.select("ring", "segment"), ["ring", "segment"]), "simhash-members")
    roots = classes.select("node", F.col("node").alias("root")).limit(0)
    for _ in range(hub_rounds):
        found = _wide_near(_hub_pairs(_apart_roots(members, roots)), classes, tau)
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))

    rest = stored(_apart_roots(members, roots).join(classes, "node"), "simhash-mixed")
    slices = F.ceil(F.col("size") / slice_rows).cast("int")
    left = rest.select("ring", "segment", F.pmod(F.xxhash64("node"), slices).cast("int").alias("slice"), F.col("fp").alias("a_fp"), F.col("root").alias("a"))
    right = rest.select("ring", "segment", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.col("fp").alias("b_fp"), F.col("root").alias("b"))
    # The first words tell most strangers: half a thousand bits, three and a half deviations above what 0.8 gives.
    alike = _apart(RING_WORDS) <= math.ceil(64 * RING_WORDS * APART + 3.5 * math.sqrt(64 * RING_WORDS * APART * (1 - APART)))
    more = left.join(right, ["ring", "segment", "slice"]).filter((F.col("a") > F.col("b")) & alike & _wide_within(tau)).select("a", "b")
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_dedup(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that a group of similar ones has a smaller id for."""
    found = similar_groups(docs, width, doc_id=doc_id, text=text)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), width=3)
