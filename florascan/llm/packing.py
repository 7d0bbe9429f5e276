"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens to target proportions.

Texts are tokenised once; their ids are written, compressed, to the shared folder with a packing part. A task deals the
rows of each source to the parts in turn, so that parts have like mixtures and equal rows, too, spread over all of them;
within a part rows are in the order of a hash of their position in the input. Token counts by part and source give every part the deficits that the parts before it left behind
(target share times their tokens, less what their sources had); all of it is paid, a tenth of a source's share in each
window, so that no window strays far from the targets. Within a part the queues of its sources are visited in a
ring: a visit adds the source's share of a window to its deficit, and takes that many tokens once they are ``min_piece``
or the queue's last. Windows fill in that order, so each gets the target proportions up to ``min_piece`` tokens a source,
and what is missing is carried to the next window and the next part. An empty queue leaves the ring, and the others share
its place. Documents are cut wherever a take ends; every id lies in exactly one piece.

All windows of a part are full but the last, which is split into sequences whose lengths are powers of two, so that
nothing is padded. A part holds about ``part_bytes`` of text; parts are packed independently and in bounded memory.

Defined results: a null or empty text is the single closing id. A null source is a queue of its own. Equal rows are packed
as often as they occur. Without targets, a source's target is its share of all tokens; given targets are divided by the
sum of those in use. An empty table has no pieces. Columns of the input that are not named are not passed on.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.llm.common import stored, table

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _slow_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _added_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file)["added_tokens"])


#: White space that the fast library's pattern matcher does not get through.
LONG_BLANK = re.compile(r"\s{5000}")


class TextEncoder:
    """Ids of the byte-level vocabulary at path; its ranks serve the fast library, itself the texts that one cannot do.

    Those are texts with one of its added tokens, which the ranks do not have, and texts with very long white space.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str) -> None:
        self.path, self.ranks_path, self.pattern = path, ranks_path, pattern

    def __call__(self, text: str) -> list[int]:
        if any(token in text for token in _added_tokens(self.path)) or (len(text) >= 5000 and LONG_BLANK.search(text)):
            return _slow_encoder(self.path).encode(text, add_special_tokens=False).ids
        return _encoder(self.ranks_path, self.pattern).encode_ordinary(text)


def public_encoder(name: str = "byte_bpe_50k") -> TextEncoder:
    import public_tokenizers

    return TextEncoder(public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN)


def tokenised(docs: DataFrame, encode: TextEncoder, end_id: int = 0, part_bytes: int = 2_000_000, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, place, source, doc_id, n, ids): ids as unsigned 16-bit numbers with the closing id, written to the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1)).first()[0] or 0
    n_parts = max(1, -(-size // part_bytes))
    group = F.col(source) if source in docs.columns else F.lit(None)
    rows = docs.select(F.xxhash64(F.monotonically_increasing_id()).alias("place"), group.cast("string").alias("source"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, following = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = [np.array([*encode(t), end_id] if t else [end_id], dtype="<u2") for t in batch["text"]]
            out, parts = batch[["place", "source", "doc_id"]].copy(), []
            for s in batch["source"]:
                at = following.get(s)
                parts.append(zlib.crc32(f"{task}|{s}".encode()) % n_parts if at is None else at)
                following[s] = (parts[-1] + 1) % n_parts
            out["part"], out["n"], out["ids"] = parts, [len(x) for x in ids], [x.tobytes() for x in ids]
            yield out

    codec = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        return stored(rows.mapInPandas(encoded, "part int, place long, source string, doc_id long, n long, ids binary"), "packing-ids")
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", codec)


def _before(counts: DataFrame, keys: list[str], value: str, name: str, block_parts: int = 1000) -> DataFrame:
    """counts with the sum of value over the earlier parts of the same keys: sums of blocks of parts, then within a block.

    Only the sums of blocks, one row for block_parts parts and each key, are ordered as a whole.
    """
    counts = counts.withColumn("__block", F.floor(F.col("part") / block_parts))
    blocks = counts.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")
    same = F.lit(True)
    for k in [*keys, "__block"]:
        blocks = blocks.withColumnRenamed(k, f"__of_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    within = W.partitionBy(*keys, "__block").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    joined = counts.join(blocks, same).withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
    return joined.drop("__block", "__start", *[f"__of_{k}" for k in [*keys, "__block"]])


def deficits(tokens: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """(part, source, share, carried): target shares, and the tokens that earlier parts owe the source (below 0: that it had too many)."""
    counts = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "packing-counts")
    if targets is None:
        weights = counts.groupBy("source").agg(F.sum("n").cast("double").alias("weight"))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
        weights = counts.groupBy("source").agg(F.max(weight).alias("weight"))
    total = weights.agg(F.sum("weight")).first()[0] or 0.0
    shares = weights.select(F.col("source").alias("__source"), (F.col("weight") / F.lit(total) if total > 0 else F.lit(0.0)).alias("share"))
    parts = _before(counts.groupBy("part").agg(F.sum("n").alias("part_n")), [], "part_n", "all_before").select("part", "all_before")
    counted = _before(counts, ["source"], "n", "own_before")
    joined = counted.join(parts, "part").join(shares, F.col("source").eqNullSafe(F.col("__source")))
    return joined.select("part", "source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("carried"))


def pack_part(docs: pd.DataFrame, owed: pd.DataFrame, window: int, min_piece: int, repaid: float = 0.1) -> Iterator[tuple]:
    """(row, start, length, sequence, offset) for one part; docs in the order of the queues, with columns source and n."""
    names = docs["source"].tolist()
    sizes = docs["n"].tolist()
    queues: dict = {}
    for row, name in enumerate(names):
        queues.setdefault(name, []).append(row)
    share = dict(zip(owed["source"], owed["share"]))
    owes = {s: dict(zip(owed["source"], owed["carried"])).get(s, 0.0) for s in queues}
    left = {s: sum(sizes[r] for r in queues[s]) for s in queues}
    front, deficit = dict.fromkeys(queues, (0, 0)), dict.fromkeys(queues, 0.0)  # front: place in the queue, ids taken from that document
    ring, pieces, at, quantum = list(queues), [], 0, {}
    while ring:
        if len(quantum) != len(ring):  # queues in the ring share a whole window
            here = sum(share.get(s, 0.0) for s in ring)
            quantum = {s: max(1.0, window * (share.get(s, 0.0) / here if here > 0 else 1 / len(ring))) for s in ring}
        rest = []
        for s in ring:
            paid = min(max(owes[s], -repaid * quantum[s]), repaid * quantum[s])
            owes[s] -= paid
            deficit[s] += quantum[s] + paid
            take = min(int(deficit[s]), left[s])
            if take < min(min_piece, left[s]):
                rest.append(s)
                continue
            deficit[s] -= take
            left[s] -= take
            place, used = front[s]
            while take:
                row = queues[s][place]
                n = min(take, sizes[row] - used, window - at % window)
                pieces.append((row, used, n, at // window, at % window))
                at, take, used = at + n, take - n, used + n
                if used == sizes[row]:
                    place, used = place + 1, 0
            front[s] = (place, used)
            if left[s]:
                rest.append(s)
        ring = rest
    return _split_last(pieces, at, window)


def _split_last(pieces: list[tuple], total: int, window: int) -> Iterator[tuple]:
    """Cut the window that is not full into sequences of power-of-two lengths, largest first."""
    full, rest = divmod(total, window)
    bounds, at = [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            bounds.append((at, at + (1 << bit)))
            at += 1 << bit
    for row, start, n, sequence, offset in pieces:
        if sequence < full:
            yield row, start, n, sequence, offset
            continue
        for k, (a, b) in enumerate(bounds):
            lo, hi = max(a, offset), min(b, offset + n)
            if lo < hi:
                yield row, start + lo - offset, hi - lo, full + k, lo - a


def pack(docs: DataFrame, encode: TextEncoder, targets: Mapping[str, float] | None = None, window: int = 1024, min_piece: int = 32, end_id: int = 0, part_bytes: int = 2_000_000, **names: str) -> DataFrame:
    """One row for each piece of a document: where its ids lie, in the document and in a sequence, and their CRC-32."""
    tokens = tokenised(docs, encode, end_id, part_bytes, **names)
    owed = stored(deficits(tokens, targets), "packing-deficits")

    def packed(docs: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["place", "doc_id"], kind="stable", na_position="last").reset_index(drop=True)
        docs["source"] = docs["source"].astype(object).where(docs["source"].notna(), None)
        owed["source"] = owed["source"].astype(object).where(owed["source"].notna(), None)
        base = int(docs["part"].iloc[0]) << 32 if len(docs) else 0
        found = list(pack_part(docs, owed, window, min_piece))
        rows = [p[0] for p in found]
        crcs, last, ids = [], -1, None
        by_row = sorted(range(len(found)), key=rows.__getitem__)
        crcs = [0] * len(found)
        for k in by_row:
            row, start, n = found[k][:3]
            if row != last:
                last, ids = row, memoryview(np.frombuffer(docs["ids"].iat[row], dtype="<u2").astype("<u4").tobytes())
            crcs[k] = zlib.crc32(ids[4 * start : 4 * (start + n)])
        chosen = docs.iloc[rows]
        return pd.DataFrame({
            "doc_id": chosen["doc_id"].array, "start": [p[1] for p in found], "length": [p[2] for p in found], "ids_crc32": crcs, "doc_tokens": chosen["n"].array,
            "sequence_id": [base + p[3] for p in found], "offset": [p[4] for p in found], "source": chosen["source"].array,
        })

    return tokens.groupBy("part").cogroup(owed.groupBy("part")).applyInPandas(packed, PIECE)


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_encoder())
