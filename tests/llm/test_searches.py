"""Cover-tree codes, ranked lexical search, metric search: against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from florascan.llm import cover_codes, metric_tree, range_search

VECTORS = "vec_id long, embedding array<float>, label int, score string, row string"


def some_vectors(n, width, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in np.float32(rng.normal(0, 0.3, width))], k % 3, "mine", "mine") for k in range(n)]
    rows += [(n + k, rows[0][1], 1, "mine", "mine") for k in range(copies)]
    return rows


ODD = [(900, None, 1, None, None), (901, [0.5, None, 0.1], 1, None, None), (902, [float("nan")] * 4, None, None, None), (903, [float("inf"), 0.0], 2, None, None), (904, [], None, None, None), (905, [1.0], None, None, None), (None, [0.25] * 20, 0, None, None), (905, [1.0], 7, None, None), (1000, [1e30] * 3, 0, None, None)]


def kept_integers(rows, scale, width):
    out = []
    for vec_id, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [max(-(1 << 26), min(1 << 26, math.floor(scale * float(np.float32(x))))) for x in v]
            out.append((vec_id, ints + [0] * (width - len(ints)), label))
    return out


# --- cover-tree codes -------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, width):
    kept = kept_integers(rows, 256, width)
    w = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[list(r[1][k * w : k * w + w]) for r in first] for k in range(parts)]

    def nearest(k, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[k * w : k * w + w], e)), i) for i, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(k, v)[1]].append(v[k * w : k * w + w])
            for i, members in groups.items():
                books[k][i] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for vec_id, v, label in kept:
        chosen = [nearest(k, v) for k in range(parts)]
        out.append((vec_id, label, "".join(f"{i:02x}" for _, i in chosen), sum(d for d, _ in chosen)))
    return out, books


def shown(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("rows, parts, entries", [(some_vectors(300, 16, 1, copies=150), 4, 16), (some_vectors(60, 30, 2) + ODD, 16, 64), (some_vectors(5, 16, 3), 16, 64)])
def test_codes_equal_brute_force(spark, rows, parts, entries):
    widest = max(len(r[1]) for r in rows if r[1] is not None and r[0] not in (901, 902, 903))
    width = -(-widest // parts) * parts
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got, books = cover_codes.cover_codes(df, parts=parts, entries=entries, chunk_rows=50)
    expected, expected_books = brute_codes(rows, parts, entries, 2, width)
    assert books.tolist() == expected_books
    assert shown(tuple(r) for r in got.collect()) == shown(expected)


def test_codes_of_an_empty_table(spark):
    got, books = cover_codes.cover_codes(spark.createDataFrame([], VECTORS))
    assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error"] and books.size == 0
    only_bad = spark.createDataFrame(ODD[:4], VECTORS)
    assert cover_codes.cover_codes(only_bad)[0].count() == 0


def test_codes_of_text_labels_and_the_query(spark, tmp_path):
    rows = [(k, v, None if k % 4 == 0 else f"l{k % 2}") for k, v, *_ in some_vectors(100, 16, 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = cover_codes.op11_cover_codes(spark, f"file://{tmp_path}").collect()
    expected, books = brute_codes(rows, 16, 64, 2, 16)
    total = Counter()
    for _, label, _, error in expected:
        total[label] += error
    digest = hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
    assert shown((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == shown((i, code, error, total[label], digest) for i, label, code, error in expected)


def test_cover_tree_keeps_its_invariants():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-60, 60, (400, 3)), np.repeat(rng.integers(-60, 60, (1, 3)), 300, axis=0)])
    tree = cover_codes.build_tree(points, leaf=4)
    assert sorted(tree["order"].tolist()) == list(range(700)) and (tree["points"] == points[tree["order"]]).all()
    for (low, high, child, children), radius, centre in zip(tree["runs"].tolist(), tree["radius"], tree["centres"]):
        gaps = np.sqrt(((tree["points"][low:high] - centre) ** 2).sum(1))
        assert gaps.max() <= radius + 1e-9
        runs = tree["runs"][child : child + children]
        if children:
            assert runs[0, 0] == low and runs[-1, 1] == high and (runs[1:, 0] == runs[:-1, 1]).all()
            own = tree["centres"][child : child + children]
            apart = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) + np.eye(children) * 1e9
            assert apart.min() > radius / 2 and (own[0] == centre).all()


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.integers(-5, 5, (500, 4)), rng.integers(995, 1005, (500, 4))])
    runs, compared = cover_codes.assign(cover_codes.build_tree(points), np.array([[0] * 4, [1000] * 4]))
    assert compared == 0 and sum((high - low).sum() for low, high, _ in runs) == 1000


# --- metric search ----------------------------------------------------------------------------------------------------


def brute_products(rows, asks, k, width):
    kept = kept_integers(rows, 1024, width)
    out = []
    for i, (query_id, q, _) in enumerate(kept):
        if query_id is not None and asks(query_id):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), c is None, c or 0) for j, (c, v, _) in enumerate(kept) if j != i)[:k]
            out += [(query_id, rank, None if null else c, -s) for rank, (s, null, c) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("rows, part_rows", [(some_vectors(700, 8, 7, copies=400), 100), (some_vectors(200, 20, 8) + ODD, 64), (some_vectors(4, 8, 9), 8192)])
def test_products_equal_brute_force(spark, rows, part_rows):
    width = max(len(r[1]) for r in rows if r[1] is not None)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = metric_tree.top_products(df, F.col("vec_id") % 5 == 0, part_rows=part_rows, block_queries=37)
    assert shown(tuple(r) for r in got.collect()) == shown(brute_products(rows, lambda i: i % 5 == 0, 10, width))


def test_products_of_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert metric_tree.top_products(empty, F.col("vec_id") % 5 == 0).count() == 0
    assert metric_tree.top_products(spark.createDataFrame(ODD[:3], VECTORS), F.lit(True)).count() == 0
    one = spark.createDataFrame(some_vectors(1, 8, 1), VECTORS)
    assert metric_tree.top_products(one, F.lit(True)).count() == 0
    assert metric_tree.top_products(spark.createDataFrame(some_vectors(30, 8, 1), VECTORS), F.lit(None).cast("boolean")).count() == 0


def test_bounds_spare_computations():
    rng = np.random.default_rng(10)
    centres = rng.integers(-1000, 1000, (40, 6))
    vectors = np.concatenate([c + rng.integers(-8, 8, (200, 6)) for c in centres])
    pages = metric_tree.build_pages(vectors)
    tree = metric_tree.MetricTree(metric_tree.prepared(pages), pages[0]["centre"], np.arange(len(vectors)), np.arange(len(vectors)))
    for q in vectors[::97]:
        best = [-s for s, _, _ in tree.nearest(q, 10)]
        assert best == sorted((vectors @ q).tolist(), reverse=True)[:10]
    assert tree.compared < 0.25 * len(vectors) * len(vectors[::97])


# --- ranked lexical search --------------------------------------------------------------------------------------------


def brute_ranks(docs, items, k=10):
    def terms(text):
        out, word = [], ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z":
                ch = ch.lower()
            if "a" <= ch <= "z" or "0" <= ch <= "9" or ord(ch) > 0x7F:
                word += ch
            else:
                out += [word] if word else []
                word = ""
        return out

    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    big_n, big_l = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        asked = Counter(terms(text))
        scores = []
        for doc_id, c, n in counted:
            m = 25 + (75 * n * big_n) // big_l
            score = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranks_equal_brute_force(spark):
    draw = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["É", "naïve", "ŒUVRE", "x1"]
    docs = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 40))).replace("w1", "W1-")) for k in range(600)]
    docs += [(None, "w3 w4 w5"), (7, "w3 w4 w5"), (601, None), (602, ""), (603, "--- !"), (604, "w9 " * 50_000)] + [(700 + k, "w2 w3 common") for k in range(500)]
    items = [(1, "w3 W4 w5 w5"), (2, None), (3, ""), (4, "unknown words"), (5, "É naïve œuvre ŒUVRE common"), (5, "w2"), (None, "w11 x1 W1 1"), (6, " ".join(words) * 3)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("mine"), "item": F.lit("mine")}).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("mine"))
    expected = shown(brute_ranks(docs, items))
    assert shown(tuple(r) for r in range_search.ranked_search(table, asked, shard_docs=150).collect()) == expected
    assert shown(tuple(r) for r in range_search.ranked_search(table, asked, shard_docs=7, shard_postings=40, block_chars=100).collect()) == expected
    assert range_search.ranked_search(table.limit(0), asked).count() == 0
    assert range_search.ranked_search(table, asked.limit(0)).count() == 0


def test_intervals_are_pruned():
    rng = np.random.default_rng(12)
    places = np.concatenate([np.arange(5000), np.arange(0, 5000, 3)]).astype(np.int32)
    impact = np.concatenate([rng.integers(1, 50, 5000), rng.integers(1, 50, 1667)])
    impact[[1234, 4321]] = 10_000
    shard = range_search.Shard(5000, {0: (0, 5000), 1: (5000, 6667)}, places, impact)
    for low, high in ((0, 5000), (17, 18), (1200, 1300), (5000, 6667), (5003, 5009)):
        at = shard.largest(np.array([low]), np.array([high]))[0]
        assert low <= at < high and shard.impact[at] == impact[low:high].max()
    searcher, found = range_search.Searcher(shard, [(0, 2), (1, 1), (9, 5)]), []

    def offer(docs, scores):
        found.extend(zip(scores.tolist(), docs.tolist()))
        return 20_000

    searcher.best(1, offer)
    assert {d for s, d in found if s >= 20_000} == {1234, 4321} and searcher.scored < 600
