"""Exact top-k inner products by best-first search in M-trees.

Vectors are dealt to parts of some ``part_rows`` rows: by the nearest of a bounded number of pivots, and by a hash where a
pivot draws more (a cluster of any size spreads over parts). Each part becomes an M-tree of pages. A page holds up to PAGE
entries; an entry of an inner page has a routing vector, the covering radius of what lies below, the largest norm there and
its distance to the routing vector of its own page; an entry of a leaf has a vector and that distance.

With d the distance of a query q to a vector v, <q, v> = (|q|^2 + |v|^2 - d^2) / 2, so every lower bound of d gives an upper
bound of the score. A search keeps pages in a heap by upper bound. Within a page the stored distances to the parent bound
d from below without a computation (triangle inequality); only entries that can still reach the k-th score are compared.
The search ends when no page can reach it, so results are exact, ties (smaller id first) included.

A query is first searched in its own part; its k-th score there is the least that other parts have to reach, and parts whose
root cannot are not visited. Queries and parts meet by a shuffle in blocks of bounded size: a search of one part by at most
some ``block_queries`` queries is a task's unit. Roots are broadcast ``ROOTS`` at a time.

Defined results: rows whose vector is null or holds a null or non-finite component take no part. Vectors of different
lengths compare as if the shorter ended in zeros. Every row is its own candidate and its own query, ids may repeat: a row's
candidates are all rows but itself, and rows that share an id are ranked each for itself. A null id is no query and, as a
candidate, follows all other ids of its score. Fewer than k other rows: all of them. An empty table gives an empty one.
Components are integers of at most 2^26; scores are exact. Other columns of the input are not carried.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.llm.common import stored, table
from florascan.llm.vectors import integer_vectors, matrix, nullable_ids

PAGE = 128
MAX_PIVOTS = 256
ROOTS = 1 << 15
PAGES = "part int, page int, leaf boolean, size int, vectors binary, to_parent binary, radius binary, reach binary, child binary, ids binary, nulls binary, rows binary"
FOUND = "row long, query_id long, vec_id long, score long"


def products(page: dict, use: np.ndarray | slice, q: np.ndarray, as_float: np.ndarray) -> np.ndarray:
    """Exact inner products of some of a page's integer vectors with an integer vector; in floats while these are exact."""
    if page["largest"] * float(np.abs(as_float).max(initial=0)) * len(q) < 2.0**52:
        return page["as_float"][use] @ as_float
    return page["vectors"][use].astype(np.int64) @ q.astype(np.int64)


def _distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = rows.astype(np.float64) - centre.astype(np.float64)
    return np.sqrt((gap * gap).sum(1))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    a, c = rows.astype(np.float64), centres.astype(np.float64)
    return ((c * c).sum(1)[None, :] - 2 * (a @ c.T)).argmin(1)


def build_pages(vectors: np.ndarray, page: int = PAGE) -> list[dict]:
    """The pages of a tree over the rows of ``vectors``; page 0 is the root, whose own routing vector is the mean."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    pages: list[dict] = [{"members": np.arange(len(vectors)), "centre": np.round(vectors.mean(0)).astype(np.int64)}]
    at = 0
    while at < len(pages):
        own = pages[at]
        members, centre = own["members"], own["centre"]
        if len(members) <= page:
            own |= {"leaf": True, "vectors": vectors[members], "to_parent": _distances(vectors[members], centre), "radius": np.zeros(len(members)), "reach": norms[members], "child": members}
        else:
            routing = members[np.linspace(0, len(members) - 1, page).astype(np.int64)]
            nearest = _nearest(vectors[members], vectors[routing])
            if np.bincount(nearest).max() == len(members):  # copies of one vector: any split does
                nearest = np.arange(len(members)) * page // len(members)
            kept, groups = [], []
            for k in np.unique(nearest):
                kept.append(routing[k])
                groups.append(members[nearest == k])
            own |= {"leaf": False, "vectors": vectors[kept], "to_parent": _distances(vectors[kept], centre), "child": np.arange(len(groups)) + len(pages)}
            own["radius"] = np.array([_distances(vectors[g], vectors[c]).max() for g, c in zip(groups, kept)])
            own["reach"] = np.array([norms[g].max() for g in groups])
            pages += [{"members": g, "centre": vectors[c]} for g, c in zip(groups, kept)]
        del own["members"]
        at += 1
    return pages


class MetricTree:
    """A tree read back from its pages; ``compared`` counts the vectors that searches compared in full."""

    def __init__(self, pages: list[dict], centre: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.pages, self.centre, self.ids, self.rows, self.compared = pages, centre, ids, rows, 0

    def nearest(self, q: np.ndarray, k: int, least: float = -math.inf, own: int = -1) -> list[tuple[int, int, int]]:
        """(-score, id, place) of the k best with a score of ``least`` or more, without the row ``own``; best first."""
        as_float = q.astype(np.float64)
        square = float(as_float @ as_float)
        length = math.sqrt(square)
        best: list[tuple[int, int, int]] = []
        heap = [(-math.inf, 0, float(_distances(self.centre[None, :], q)[0]))]
        while heap:
            bound, number, to_centre = heapq.heappop(heap)
            if -bound < least:
                break
            page = self.pages[number]
            slack = 1e-9 * (square + page["most"]) + 1e-6
            gap = np.maximum(np.abs(to_centre - page["to_parent"]) - page["radius"], 0)
            use = ((square + slack + slack + page["reach2"] - gap * gap) >= 2 * least).nonzero()[0]
            if not len(use):
                continue
            self.compared += len(use)
            scores = products(page, use if len(use) < len(gap) else slice(None), q, as_float)
            if page["leaf"]:
                good = (scores >= least).nonzero()[0]
                if len(good):
                    places = page["child"][use[good]]
                    found = [(-int(s), int(self.ids[p]), int(p)) for s, p in zip(scores[good], places) if self.rows[p] != own]
                    best = sorted(best + found)[:k]
                    if len(best) == k:
                        least = max(least, -best[-1][0])
                continue
            reach2, radius = page["reach2"][use], page["radius"][use]
            apart = np.sqrt(np.maximum(square + page["norm2"][use] - 2.0 * scores, 0))
            low = np.maximum(apart - radius, 0)
            bounds = np.minimum((square + reach2 - low * low) / 2, scores + length * radius) + slack
            for j in (bounds >= least).nonzero()[0]:
                heapq.heappush(heap, (-float(bounds[j]), int(page["child"][use[j]]), float(apart[j])))
        return best


def prepared(pages: list[dict]) -> list[dict]:
    """Pages with what searches take from them worked out once."""
    for p in pages:
        p["reach2"] = p["reach"] ** 2
        p["as_float"] = p["vectors"].astype(np.float64)
        p["norm2"] = (p["as_float"] ** 2).sum(1)
        p["largest"] = float(np.abs(p["as_float"]).max(initial=0))
        p["most"] = float(p["reach2"].max(initial=0))
    return pages


def _tree_rows(width: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        vectors = matrix(rows["v"], width)
        ids, nulls = nullable_ids(rows["vec_id"])
        place = rows["row"].to_numpy(dtype=np.int64)
        out = []
        for number, p in enumerate(build_pages(vectors)):
            leaf = p["leaf"]
            own = p["child"] if leaf else np.array([], dtype=np.int64)
            fields = {"vectors": p["vectors"].astype(np.int32), "to_parent": p["to_parent"], "radius": p["radius"], "reach": p["reach"], "child": p["child"].astype(np.int64)}
            fields |= {"ids": ids[own], "nulls": nulls[own], "rows": place[own]}
            if number == 0:  # the root's own routing vector goes last
                fields["vectors"] = np.vstack([fields["vectors"], p["centre"].astype(np.int32)])
            out.append({"part": rows["part"].iloc[0], "page": number, "leaf": leaf, "size": len(p["to_parent"])} | {k: v.tobytes() for k, v in fields.items()})
        return pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return build


def _read_tree(pages: pd.DataFrame, width: int) -> tuple[MetricTree, np.ndarray]:
    """The tree of a part's pages, and which of its places have a null id."""
    pages = pages.sort_values("page")
    out, total = [], int(pages["size"][pages["leaf"]].sum())
    ids, rows, nulls = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)
    centre = None
    for p in pages.itertuples():
        vectors = np.frombuffer(p.vectors, np.int32).reshape(-1, width) if width else np.zeros((p.size + (p.page == 0), 0), np.int32)
        if p.page == 0:
            centre, vectors = vectors[-1].astype(np.int64), vectors[:-1]
        child = np.frombuffer(p.child, np.int64)
        if p.leaf:
            ids[child], rows[child], nulls[child] = np.frombuffer(p.ids, np.int64), np.frombuffer(p.rows, np.int64), np.frombuffer(p.nulls, bool)
        out.append({"leaf": p.leaf, "vectors": vectors, "to_parent": np.frombuffer(p.to_parent), "radius": np.frombuffer(p.radius), "reach": np.frombuffer(p.reach), "child": child})
    return MetricTree(prepared(out), centre, ids, rows), nulls


def _searched(width: int, k: int):
    """A function of (queries, pages) of one part: each query's best rows there."""

    def search(queries: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(pages):
            tree, nulls = _read_tree(pages, width)
            for q, row, query_id, least in zip(matrix(queries["v"], width), queries["row"], queries["query_id"], queries["least"]):
                for score, vec_id, place in tree.nearest(q, k, -math.inf if pd.isna(least) else int(least), int(row)):
                    out.append((row, query_id, None if nulls[place] else vec_id, -score))
        frame = pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])
        return frame.astype({"row": "int64", "query_id": "int64", "vec_id": "Int64", "score": "int64"})

    return search


def _dealt(vectors: DataFrame, n: int, width: int, part_rows: int) -> DataFrame:
    """vectors with their part: by the nearest pivot, and by a hash where a pivot has more than part_rows."""
    chosen = vectors.orderBy(F.xxhash64("v", "row"), "row").select("v").limit(min(MAX_PIVOTS, -(-n // part_rows))).toPandas()["v"]
    pivots = matrix(chosen, width)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(matrix(v, width), pivots), dtype="int32")

    celled = stored(vectors.withColumn("cell", cell("v")), "mtree-cells")
    slots = {r.cell: -(-r["count"] // part_rows) for r in celled.groupBy("cell").count().collect()}
    first, at = {}, 0
    for c in sorted(slots):
        first[c], at = at, at + slots[c]
    cells = sorted(slots)
    begins = F.array(*[F.lit(first.get(c, 0)) for c in range(max(cells) + 1)])
    counts = F.array(*[F.lit(slots.get(c, 1)) for c in range(max(cells) + 1)])
    salt = F.pmod(F.xxhash64(F.lit("part"), "row"), F.get(counts, F.col("cell"))).cast("int")
    return celled.select("vec_id", "row", "v", (F.get(begins, F.col("cell")) + salt).alias("part"))


def _routed(width: int, roots: list[tuple], k: int):
    """Each query once for every other part whose root may reach its k-th score."""
    parts = np.array([r[0] for r in roots], dtype=np.int64)
    centres = np.array([r[1] for r in roots], dtype=np.float64).reshape(len(roots), width)
    radius, reach = np.array([r[2] for r in roots]), np.array([r[3] for r in roots])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.iloc[start : start + 256]
                q = matrix(some["v"], width).astype(np.float64)
                square = (q * q).sum(1)[:, None]
                apart = np.sqrt(np.maximum(square + (centres * centres).sum(1) - 2 * (q @ centres.T), 0))
                low = np.maximum(apart - radius - 1e-3, 0)
                bound = (square + reach**2 - low * low) / 2 * (1 + 1e-9) + 1e-3
                least = some["least"].astype("float64").fillna(-math.inf).to_numpy()
                i, j = np.nonzero((bound >= least[:, None]) & (parts[None, :] != some["part"].to_numpy()[:, None]))
                if len(i):
                    out = some.iloc[i].copy()
                    out["part"] = parts[j].astype("int32")
                    yield out

    return route


def top_products(
    df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", part_rows: int = 8192, block_queries: int = 16384
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds the k other rows of largest inner product."""
    spark = df.sparkSession
    chosen = F.coalesce(is_query, F.lit(False)).alias("asks")
    vectors = stored(integer_vectors(df, scale, vec_id, embedding, chosen).withColumn("row", F.monotonically_increasing_id()), "mtree-vectors")
    n, width, asked = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = _dealt(vectors.drop("asks"), n, width, part_rows)
    pages = stored(dealt.groupBy("part").applyInPandas(_tree_rows(width), PAGES), "mtree-pages")

    # vec_id is null for no query, so the ids of queries stay whole numbers in pandas
    queries = vectors.filter("asks and vec_id is not null").select("row").join(dealt, "row")
    queries = queries.select("row", F.col("vec_id").alias("query_id"), "v", "part", F.lit(None).cast("double").alias("least"))
    queries = stored(queries, "mtree-queries")
    home = stored(queries.groupBy("part").cogroup(pages.groupBy("part")).applyInPandas(_searched(width, k), FOUND), "mtree-home")

    kth = home.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    ready = queries.drop("least").join(kth, "row", "left").withColumn("least", F.when(F.col("n") >= k, F.col("kth").cast("double"))).drop("n", "kth")
    blocks = -(-asked // block_queries) or 1
    ready = stored(ready.select("row", "query_id", "v", "part", "least", F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks)).cast("int").alias("block")), "mtree-ready")
    spread = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = home
    n_parts = pages.agg(F.max("part")).first()[0] + 1
    for start in range(0, n_parts, ROOTS):
        roots = pages.filter((F.col("page") == 0) & F.col("part").between(start, start + ROOTS - 1)).select("part", "vectors", "to_parent", "radius", "reach").toPandas()
        known = []
        for r in roots.itertuples():
            centre = np.frombuffer(r.vectors, np.int32)[-width:] if width else np.zeros(0)
            known.append((r.part, centre, (np.frombuffer(r.to_parent) + np.frombuffer(r.radius)).max(), np.frombuffer(r.reach).max()))
        routed = ready.mapInPandas(_routed(width, known, k), ready.schema)
        some = spread.filter(F.col("part").between(start, start + ROOTS - 1))
        found = found.unionByName(routed.groupBy("part", "block").cogroup(some.groupBy("part", "block")).applyInPandas(_searched(width, k), FOUND))
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP13_SQL = """
with kept as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) score
  from kept q, kept c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
