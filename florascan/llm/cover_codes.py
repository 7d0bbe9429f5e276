"""Vector codes by product quantisation: Lloyd rounds over partition-local cover trees.

A task gathers its vectors in chunks of ``chunk_rows`` rows. For each of the parts into which vectors are cut, a chunk gets a
cover tree of its sub-vectors: a node covers all that lie within its radius of its centre; its children's centres are further
apart than half of that radius and cover the node within it; the first child keeps the centre. Rows are laid out in tree
order, so a subtree is a run of rows, and cumulative sums give the sum over any subtree by one subtraction. The trees are
written once and serve every round.

In a round a node of radius R at distance d1 of its nearest and d2 of its second nearest entry gives all of its rows to the
nearest if d1 + 2 R < d2 (triangle inequality): one subtraction adds the subtree to the entry. Ambiguous nodes pass to their
children, ambiguous leaves compare their rows exactly, in integers, ties to the lower index. Per task and round one row an
entry leaves for the driver: parts x entries sums in all, whatever the size of the table.

Defined results: rows whose vector is null or holds a null or non-finite component are left out. A vector shorter than the
longest ends in zeros; so does the longest up to a multiple of the number of parts. Fewer rows than entries: so many entries.
The first entries come from the rows with the smallest ids (of rows with one id those with the smaller vector; null ids come
last). Every row has its own code, ids may repeat. Labels may be of any type that can be grouped; null labels count as equal. An empty table gives
an empty one. Components are integers of at most 2^26 in magnitude; all figures are exact. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florascan.llm.common import spread_join, stored, table
from florascan.llm.vectors import integer_vectors, matrix

#: A node of so many rows is not divided further.
LEAF = 24


def build_tree(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """The cover tree of integer points: ``order`` (rows in tree order), ``points`` in that order, their cumulative sums
    and, for each node, its run of rows, centre, radius and run of children (none for leaves)."""
    nodes: list[list] = []  # first row, row after the last, centre (place in points), radius, first child, children
    exact = points.astype(np.float64)
    order = np.empty(len(points), dtype=np.int64)

    def spread(members: np.ndarray, centre: int) -> np.ndarray:
        gap = exact[members] - exact[centre]
        return np.sqrt((gap * gap).sum(1))

    groups = [(np.arange(len(points)), 0, 0)] if len(points) else []
    at = 0
    if groups:
        nodes.append([0, len(points), 0, float(spread(groups[0][0], 0).max()), 0, 0])
    while at < len(groups):
        members, centre, low = groups[at]
        radius = nodes[at][3]
        if len(members) <= leaf or radius == 0:
            order[low : low + len(members)] = members
        else:
            nodes[at][4] = len(nodes)
            left, left_apart, pick = members, spread(members, centre), centre
            while len(left):
                near = left_apart <= radius / 2
                own = left[near]
                nodes.append([low, low + len(own), pick, float(left_apart[near].max()), 0, 0])
                groups.append((own, pick, low))
                low += len(own)
                left = left[~near]
                if len(left):
                    pick = int(left[0])
                    left_apart = spread(left, pick)
            nodes[at][5] = len(nodes) - nodes[at][4]
        at += 1
    table_of = np.array(nodes, dtype=np.float64).reshape(-1, 6)
    laid = points[order]
    sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
    np.cumsum(laid, axis=0, out=sums[1:])
    runs = table_of[:, [0, 1, 4, 5]].astype(np.int32)
    return {"order": order.astype(np.int32), "points": laid.astype(np.int32), "sums": sums, "runs": runs, "radius": table_of[:, 3], "centres": exact[table_of[:, 2].astype(np.int64)]}


def assign(tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Runs (first rows, rows after the last, entries) that cover all rows, and how many rows were compared one by one."""
    found, compared = [], 0
    if not len(tree["runs"]) or not len(book):
        return found, 0
    entries = book.astype(np.float64)
    size = (entries * entries).sum(1)
    points = tree["points"]
    frontier = np.array([0])
    while len(frontier):
        runs, centres = tree["runs"][frontier], tree["centres"][frontier]
        scale = (centres * centres).sum(1)
        apart = np.sqrt(np.maximum(scale[:, None] + size[None, :] - 2 * (centres @ entries.T), 0))
        nearest = apart.argmin(1)
        first = apart[np.arange(len(frontier)), nearest]
        apart[np.arange(len(frontier)), nearest] = np.inf
        # the square root of a rounded difference is off by the root of its rounding at most
        slack = 1e-3 + 1e-6 * np.sqrt(scale + size.max())
        whole = first + 2 * tree["radius"][frontier] + slack < apart.min(1)
        found.append((runs[whole, 0], runs[whole, 1], nearest[whole]))
        open_runs = runs[~whole]
        leaves, inner = open_runs[open_runs[:, 3] == 0], open_runs[open_runs[:, 3] > 0]
        if len(leaves):
            lengths = leaves[:, 1] - leaves[:, 0]
            rows = np.repeat(leaves[:, 0] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            compared += len(rows)
            for part in np.array_split(rows, -(-len(rows) // 4096)):
                own = exact_nearest(points[part], book)
                found.append((part, part + 1, own))
        lengths = inner[:, 3]
        frontier = np.repeat(inner[:, 2] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    return found, compared


def exact_nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each point, ties to the lower index; in integers."""
    p, b = points.astype(np.int64), book.astype(np.int64)
    if max(np.abs(p).max(initial=0), np.abs(b).max(initial=0)) ** 2 * 4 * b.shape[1] < 2**51:  # floats are exact, too
        pf, bf = p.astype(np.float64), b.astype(np.float64)
        return ((bf * bf).sum(1)[None, :] - 2 * (pf @ bf.T)).argmin(1)
    return ((b * b).sum(1)[None, :] - 2 * (p @ b.T)).argmin(1)


def _packed(trees: list[dict[str, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{name}_{k}": array for k, tree in enumerate(trees) for name, array in tree.items()})
    return out.getvalue()


def _unpacked(data: bytes, parts: int) -> list[dict[str, np.ndarray]]:
    with np.load(io.BytesIO(data)) as arrays:
        return [{name: arrays[f"{name}_{k}"] for name in ("order", "points", "sums", "runs", "radius", "centres")} for k in range(parts)]


def tree_chunks(vectors: DataFrame, width: int, parts: int, chunk_rows: int) -> DataFrame:
    """(ids, labels, trees): a row for each chunk of a partition, written to shared storage."""
    label = vectors.schema["label"].dataType
    whole = isinstance(label, T.IntegralType)  # nulls among them make pandas read them as floats
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("trees", T.BinaryType())])

    def chunk(ids: list, labels: list, rows: list[np.ndarray]) -> pd.DataFrame:
        points = np.concatenate(rows).reshape(len(ids), parts, width // parts)
        trees = _packed([build_tree(np.ascontiguousarray(points[:, k])) for k in range(parts)])
        return pd.DataFrame({"ids": [ids], "labels": [labels], "trees": [trees]})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, rows = [], [], []
        for batch in batches:
            for start in range(0, len(batch), chunk_rows):
                some = batch.iloc[start : start + chunk_rows]
                ids += [None if pd.isna(v) else int(v) for v in some["vec_id"]]
                labels += [None if pd.isna(v) else int(v) if whole else v for v in some["label"]]
                rows.append(matrix(some["v"], width))
                if len(ids) >= chunk_rows:
                    yield chunk(ids, labels, rows)
                    ids, labels, rows = [], [], []
        if ids:
            yield chunk(ids, labels, rows)

    return stored(vectors.mapInPandas(chunks, schema), "cover-trees")


def lloyd_round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry becomes the floored mean of its sub-vectors, unused ones stay."""
    parts, entries, width = books.shape

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for data in batch["trees"]:
                for k, tree in enumerate(_unpacked(data, parts)):
                    for low, high, entry in assign(tree, books[k])[0]:
                        np.add.at(sums[k], entry, tree["sums"][high] - tree["sums"][low])
                        np.add.at(counts[k], entry, high - low)
        k, entry = np.nonzero(counts)
        yield pd.DataFrame({"part": k.astype("int32"), "entry": entry.astype("int32"), "n": counts[k, entry], "sums": list(sums[k, entry])})

    each = chunks.select("trees").mapInPandas(totals, "part int, entry int, n long, sums array<long>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)])
    out = books.copy()
    for r in total.collect():  # parts x entries rows at most
        out[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return out


def codes(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    parts = len(books)
    label = chunks.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("codes", T.ArrayType(T.StringType())), T.StructField("errors", T.ArrayType(T.LongType()))])
    digits = np.array([f"{k:02x}" for k in range(256)])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, labels, data in zip(batch["ids"], batch["labels"], batch["trees"]):
                n = len(ids)
                chosen, errors = np.zeros((n, parts), dtype=np.int64), np.zeros(n, dtype=np.int64)
                for k, tree in enumerate(_unpacked(data, parts)):
                    laid = np.zeros(n, dtype=np.int64)
                    for low, high, entry in assign(tree, books[k])[0]:
                        lengths = high - low
                        laid[np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())] = np.repeat(entry, lengths)
                    gap = tree["points"].astype(np.int64) - books[k][laid]
                    errors[tree["order"]] += (gap * gap).sum(1)
                    chosen[tree["order"], k] = laid
                yield pd.DataFrame({"ids": [ids], "labels": [labels], "codes": [["".join(r) for r in digits[chosen]]], "errors": [errors]})

    rows = chunks.mapInPandas(coded, schema)
    flat = rows.select(F.explode(F.arrays_zip("ids", "labels", "codes", "errors")).alias("x"))
    return flat.select(F.col("x.ids").alias("vec_id"), F.col("x.labels").alias("label"), F.col("x.codes").alias("code"), F.col("x.errors").alias("error"))


def cover_codes(
    df: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", chunk_rows: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every row, the codebooks: part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256, two hexadecimal digits")
    vectors = integer_vectors(df, scale, vec_id, embedding, F.col(label).alias("label"))
    widest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-widest // parts) * parts
    # at most ``entries`` rows reach the driver
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).toPandas()["v"]
    books = matrix(first, width).reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if width else np.zeros((parts, min(1, len(first)), 0), dtype=np.int64)
    chunks = tree_chunks(vectors, width, parts, chunk_rows)
    if len(first):
        for _ in range(rounds):
            books = lloyd_round(chunks, books)
    return codes(chunks, books), books


def op11_cover_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = cover_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = stored(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "cover-codes")
    totals = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    return spread_join(coded, totals, "key", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


_ASSIGNED = """
  select s.vec_id, s.p, min(((s.a - b.a) ** 2 + (s.b - b.b) ** 2 + (s.c - b.c) ** 2 + (s.d - b.d) ** 2)::bigint * 64 + b.i) best
  from subs s join {book} b using (p) group by s.vec_id, s.p"""
_UPDATED = """
  select o.p, o.i, coalesce(n.a, o.a) a, coalesce(n.b, o.b) b, coalesce(n.c, o.c) c, coalesce(n.d, o.d) d from {book} o left join (
    select s.p, (x.best % 64)::int i, floor(sum(s.a)::double / count(*))::bigint a, floor(sum(s.b)::double / count(*))::bigint b,
      floor(sum(s.c)::double / count(*))::bigint c, floor(sum(s.d)::double / count(*))::bigint d
    from subs s join {assigned} x using (vec_id, p) group by s.p, i) n on o.p = n.p and o.i = n.i"""

#: For vectors of 64 components and distinct ids, as in the given tables.
OP11_SQL = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
subs as materialized (select vec_id, p, v[4 * p + 1] a, v[4 * p + 2] b, v[4 * p + 3] c, v[4 * p + 4] d from kept, (select unnest(range(16))::int p)),
b0 as materialized (select p, i, a, b, c, d from subs join (select vec_id, (row_number() over (order by vec_id) - 1)::int i from kept order by vec_id limit 64) using (vec_id)),
x0 as materialized ({_ASSIGNED.format(book='b0')}),
b1 as materialized ({_UPDATED.format(book='b0', assigned='x0')}),
x1 as materialized ({_ASSIGNED.format(book='b1')}),
b2 as materialized ({_UPDATED.format(book='b1', assigned='x1')}),
x2 as materialized ({_ASSIGNED.format(book='b2')}),
coded as (select vec_id, label, string_agg(printf('%02x', (best % 64)::int), '' order by p) code, sum(best // 64)::bigint error from x2 join kept using (vec_id) group by vec_id, label)
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
  (select sha256(string_agg(concat_ws(',', a, b, c, d), ',' order by p, i)) from b2) codebooks_sha256 from coded
"""
