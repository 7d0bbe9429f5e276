"""URL filter, source mixing, line labelling, quality and toxicity classifiers."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from florascan.llm import cotraining, line_crf, mixing, registry, toxicity, url_filter
from florascan.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


def test_all_operators_are_there():
    assert {re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES} == {str(k) for k in range(1, 14)}


def odd_docs(spark):
    """Nulls, empty texts, ties, repeated rows, clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, "a b c", "en", "src0", 5), (3, "a b c", "en", "src0", 5), (None, "word " * 300, "en", None, 1500), (5, "x" * 200_000, "de", "src1", 200_000)]
    return spark.createDataFrame(rows, DOCS).withColumns({"copy": F.lit("mine"), "kept": F.lit("mine"), "score": F.lit("mine"), "fingerprint": F.lit("mine")})


def test_url_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Bad.ORG:80/x/?q#f", "a://b://c", "http://bad.org/x", "http://good.net?x", "http://bad.org/x", "http://notexample.org/es/", "http://a.example.org/es/1", "http://example.org"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.org/x",), ("bad.org/x",), (None,), ("",)], "canonical_url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, listed, url_filter.QUERY_RULES[1:]).collect()}
    assert len(got) == len(urls) and got[4].host == "www.bad.org:80" and got[4].path == "/x/"
    assert got[5].host == "b:" and got[5].path == "//c"
    assert {k for k, r in got.items() if r.listed} == {6, 8} and got[6].verdict == "block"
    assert got[9].rule is None and got[10].rule == "example.org/es/" and got[0].host == "" and got[0].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).filter("listed").count() == 0


def test_bloom_has_no_false_negatives(spark):
    urls = spark.range(5000).select(F.concat(F.lit("http://h"), "id", F.lit(".org/p")).alias("url"))
    listed = spark.range(0, 5000, 2).select(F.concat(F.lit("h"), "id", F.lit(".org/p")).alias("canonical_url"))
    out = url_filter.filter_urls(urls, listed, n_blocks=64)  # far too small: nearly all are possible hits
    assert out.filter("listed").count() == 2500 and out.filter("possible_hit").count() >= 2500


def test_mixing_edges(spark):
    out = mixing.mix_sources(odd_docs(spark), {"src0": 0.5}, 0.5)
    assert dict(out.dtypes)["copy"] == "bigint" and out.columns.count("copy") == 1
    assert mixing.mix_sources(odd_docs(spark).limit(0), {"src0": 0.5}, 0.5).count() == 0
    three = out.filter("doc_id = 3").groupBy("copy").count().collect()
    assert all(r["count"] == 2 for r in three)


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "src0").otherwise("other").alias("source"), F.lit("t" * 99).alias("text"))
    out = mixing.mix_sources(docs, {"src0": 0.1}, 0.9).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["src0"] / sum(n.values()) - 0.1) < 0.01 and abs(sum(n.values()) / 20000 - 1) < 0.03


def test_mixing_splits_large_rates(spark):
    docs = spark.range(1001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("other").alias("source"), F.lit("t" * 9).alias("text"))
    out = mixing.mix_sources(docs, {"rare": 0.9}, 0.1, budget=50_000.0).cache()
    rare = out.filter("doc_id = 0")
    n = rare.count()
    assert abs(n - 4500) < 6 * 4500**0.5 and rare.select("copy").distinct().count() == n and out.filter("doc_id > 0").select("doc_id", "copy").distinct().count() == out.count() - n
    assert rare.agg(F.max("copy")).first()[0] // mixing.DRAW_COPIES == -(-4500 // mixing.MAX_RATE) - 1


def base_figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered, seen, dup = Counter(windows), set(), set(), 0
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_figures_by_brute_force():
    random.seed(5)
    for _ in range(1500):
        text = "".join(random.choice(["a", "é", "\n", " ", "\t", "a b c d e f g h i", "\x0b", "*", "x y", "\x85", "\u2003"]) for _ in range(random.randint(0, 60)))
        assert base_figures(text) == line_crf.text_features(text)[0]


def test_quality_query_by_brute_force(spark, sf):
    got = {r.doc_id: r for r in registry.QUERIES["op4_quality_lines"](spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        b, g = base_figures(r.text), got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == b
        assert g.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (g.base_failed and g.kept)


def test_viterbi_is_the_best_path():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 7)
        scores = np.array([random.uniform(-3, 3) for _ in range(n)])
        model = {"stay": [random.uniform(0, 2), random.uniform(0, 2)], "start": random.uniform(-1, 1)}

        def value(path):
            v = model["start"] * path[0]
            for k, s in enumerate(path):
                v += s * scores[k]
                if k and path[k - 1] == s:
                    v += model["stay"][s]
            return v

        best = max(value([p >> k & 1 for k in range(n)]) for p in range(2**n))
        assert abs(value(line_crf.viterbi(scores, model)) - best) < 1e-9


def test_quality_edges(spark):
    out = line_crf.judge_lines(odd_docs(spark), line_crf.DEFAULT_MODEL)
    assert dict(out.dtypes)["kept"] == "boolean" and out.count() == 6
    assert {r.n_words for r in out.filter("doc_id in (1, 2)").collect()} == {0}
    assert line_crf.judge_lines(odd_docs(spark).limit(0), line_crf.DEFAULT_MODEL).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_crf.train_field(odd_docs(spark), none) == line_crf.DEFAULT_MODEL


def test_boilerplate_lines_are_found(spark):
    """Lines that many documents share, and the lines of rejected documents, against lines of prose."""
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(8, 20))).capitalize() + "."
    notice, menu = "Copyright 2020 by the owner. All rights reserved.", "home | news | sport | about | contact | more"
    rows, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        body = [prose() for _ in range(rng.randint(3, 6))] if good else [" | ".join(prose().lower().split()[:9]) for _ in range(5)]
        rows.append((k, "\n".join([menu, *body, notice] if k % 2 else body)))
        labels.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = line_crf.train_field(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    tests = [(1, "\n".join([menu, prose(), prose(), prose(), notice])), (2, "\n".join([menu, notice] * 6)), (3, "\n".join(prose() for _ in range(5)))]
    judged = {r.doc_id: r for r in line_crf.judge_lines(spark.createDataFrame(tests, "doc_id long, text string"), model, max_repeat=100).collect()}
    assert judged[1].line_marks == "bcccb" and judged[1].kept and set(judged[2].line_marks) == {"b"} and not judged[2].kept and judged[3].line_marks == "ccccc" and judged[3].kept


def test_lines_of_copies_are_not_shared():
    a, b = np.array([1, 2, 3]), np.array([7, 2, 9])
    assert [y.tolist() for y in line_crf.line_labels([a, a, a, a, b], [1, 1, 1, 1, 0])] == [[1, 1, 1]] * 4 + [[0, 0, 0]]
    rest = [np.array([k, 2, k + 1]) for k in range(10, 50, 10)]
    assert line_crf.line_labels([a, *rest], [1] * 5)[0].tolist() == [1, 0, 1]


def test_quality_rejects_what_labels_reject(spark):
    sf = "/root/testdata/sf0.01"
    bad = table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    judged = registry.QUERIES["op4_quality_lines"](spark, sf).join(bad, "doc_id")
    assert judged.filter("not kept").count() >= 0.9 * judged.count()


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    judged = registry.QUERIES["op4_quality_lines"](spark, sf).join(labels, "doc_id").filter("not base_failed")
    assert judged.filter("kept").count() >= 0.98 * judged.count()


def test_cotraining_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    seen, unseen = (labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == k) for k in (0, 1))
    seen = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) != 1)
    scored = cotraining.co_train(table(spark, sf, "documents"), seen)
    assert scored.count() == table(spark, sf, "documents").count()
    right = scored.join(unseen, "doc_id").select(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    assert right > 0.95


def test_cotraining_sums_by_brute_force(spark):
    """Gradients and Hessians of both views of one round, row by row."""
    sf = "/root/testdata/sf0.001"
    known = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = cotraining.views(table(spark, sf, "documents")).join(known, "doc_id", "left").withColumn("held", F.col("doc_id") % 5 == 0)
    rng = np.random.default_rng(2)
    weights = {"t": rng.normal(size=cotraining.N_TEXT) / 9, "m": rng.normal(size=cotraining.N_META) / 9}
    taught = {"t": rng.normal(size=cotraining.N_TEXT), "m": rng.normal(size=cotraining.N_META)}
    got = cotraining._sums(rows, weights, taught, 0.3, 0.7)
    want = {}
    for r in rows.collect():
        x = {"t": np.array(r.text_view), "m": np.zeros(cotraining.N_META)}
        x["m"][list(r.meta_view)] = 1
        for view, other in ("tm", "mt"):
            p, lesson = (1 / (1 + np.exp(-x[v] @ w[v])) for v, w in ((view, weights), (other, taught)))
            y, kind = (r.label, "l") if r.label is not None else (1 if lesson >= 0.7 else 0 if lesson <= 0.3 else None, "p")
            if y is not None and not (kind == "l" and r.held):
                flat = np.concatenate([[1], x[view] * (y - p), np.outer(x[view], x[view]).ravel() * p * (1 - p)])
                want[f"{view}{kind}{y}"] = want.get(f"{view}{kind}{y}", 0) + flat
    assert set(got) == set(want) and len(want) >= 6 and all(np.allclose(got[k], want[k]) for k in want)


def test_categories_have_their_own_entries(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.least(F.col("id") % 100, F.lit(80))).alias("source"), F.lit(3).alias("n_chars"))
    seen = cotraining.views(docs).join(docs.select("doc_id", "source"), "doc_id").select("source", F.col("meta_view")[2].alias("at")).distinct().groupBy("at").count().collect()
    assert sorted(r["count"] for r in seen) == [1] * (cotraining.SOURCES - 2) + [81 - (cotraining.SOURCES - 2)]


def test_cotraining_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = cotraining.co_train(odd_docs(spark), none)
    assert out.count() == 6 and {round(r.score, 6) for r in out.collect()} == {0.5}
    assert cotraining.co_train(odd_docs(spark).limit(0), none).count() == 0


def full_scan(vectors, idf, query, k):
    def unit(v):
        w = {t: (1 + np.log(n)) * idf[t] for t, n in v} | {-1: 3.0}
        norm = sum(x * x for x in w.values()) ** 0.5
        return {t: x / norm for t, x in w.items()}

    u = unit(query)
    full = sorted((-round(sum(w * unit(v).get(t, 0) for t, w in u.items()), 9), j) for j, v in enumerate(vectors))
    return [(j, -c) for c, j in full[:k] if c < 0]


def test_index_finds_what_a_full_scan_finds():
    random.seed(4)
    idf = np.array([random.uniform(1, 5) for _ in range(30)])
    some = lambda most: tuple((t, random.randint(1, 4)) for t in sorted(random.sample(range(30), random.randint(1, most))))
    vectors = [some(6) for _ in range(500)]
    index = toxicity.BlockMaxIndex(vectors, idf)
    for _ in range(100):
        q = some(5)
        assert index.nearest(q, 15) == full_scan(vectors, idf, q, 15)


def test_toxicity_query_by_full_scan(spark):
    """Terms and frequencies counted anew, and the neighbours of every text by comparing it with all examples."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf, "labels")))
    found = {r.doc_id: r for r in registry.QUERIES["op7_toxicity_neighbours"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    plain = {i: " " + re.sub(r"[\W\d_]+", " ", t.lower()) + " " for i, t in texts.items()}
    terms = model["terms"]
    counts = {i: tuple((k, n) for k, t in enumerate(terms) if (n := len(re.findall(f"(?={re.escape(t)})", p)))) for i, p in plain.items()}
    seen = Counter(k for f in counts.values() for k, _ in f)
    assert len(terms) > 5 and np.allclose(model["idf"], [np.log((1 + len(texts)) / (1 + seen[k])) + 1 for k in range(len(terms))])
    assert all(counts[i] == f for i, _, f in model["examples"]) and all(i in texts for i, _, _ in model["examples"])
    vectors, ids = [f for _, _, f in model["examples"]], [i for i, _, _ in model["examples"]]
    for i, f in counts.items():
        assert [(e.doc_id, e.cosine) for e in found[i].evidence] == ([(ids[j], c) for j, c in full_scan(vectors, model["idf"], f, 15)] if f else [])


def test_toxicity_edges_and_copies(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_toxicity(odd_docs(spark), toxicity.fit(odd_docs(spark), none))
    assert {r.score for r in out.collect()} == {0.0} and out.columns.count("score") == 1
    rows = [(k, ("good day to all of you " if k % 2 else "you utter villain of the town ") + f"w{k} z{k * 7}") for k in range(60)]
    docs = spark.createDataFrame(rows + [(100, None), (101, "villain villain"), (102, "a good day")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert got[101].predicted == 1 and got[102].predicted == 0 and got[100].predicted == 0 and got[101].evidence[0].label == 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES["op7_toxicity_neighbours"](spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id").select("toxic", "predicted", "score").toPandas()
    caught, spared = got[got.toxic == 1].predicted.mean(), 1 - got[got.toxic == 0].predicted.mean()
    assert caught > 0.85 and spared > 0.985 and got.score.between(0, 1).all()
    assert isinstance(got, pd.DataFrame)
