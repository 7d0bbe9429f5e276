"""Document fingerprints: canonical exact digests, checked byte by byte.

The canonical form of a text is its NFKC form, case-folded, NFKC again, with every run of white space as one space and
none at the ends. A fingerprint is the 128-bit XXH3 of that form in UTF-8. Where several documents share a digest their
canonical texts are compared byte by byte: documents are grouped by digest and canonical text, which Spark pre-aggregates
before it shuffles, so that a group of copies travels as one text a task. If a digest turns out to have several texts, a
second, independently seeded digest is appended for its documents, and their fingerprints differ as they should.

Which documents share a digest is counted on digests alone. Only they are canonicalised again, picked out of the corpus
by a blocked Bloom filter of bounded size over their ids; a document it lets through in error adds a text to compare and
changes nothing.

Likeness of two exact fingerprints is 1 if they are equal and 0 if not. ``with_next`` compares the bytes of a text's
canonical form with those of its edited and of the next text where it has them; where bytes differ under one digest, that
digest gets the second one appended, too.

Defined results: a null text counts as empty; the empty canonical form has a fingerprint like any other. Equal rows have
equal fingerprints. In the order of ``with_next`` null ids come last and equal ids are ordered by their texts' hashes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.llm.common import spread_join, stored, table, text_or_empty
from florascan.llm.url_filter import _block, _words, blocked_bloom

PROOF_SEED = 7919
PRINT = "digest string, proof string"


def canonical_text(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def digests(canonical: str) -> tuple[str, str]:
    raw = canonical.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_128_hexdigest(raw), xxhash.xxh3_128_hexdigest(raw, PROOF_SEED)


def _prints(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([digests(canonical_text(t)) for t in texts], columns=["digest", "proof"])


def _canonicals(texts: pd.Series) -> pd.DataFrame:
    forms = [canonical_text(t) for t in texts]
    return pd.DataFrame({"digest": [digests(c)[0] for c in forms], "canonical": forms})


def _id_key(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def colliding_digests(docs: DataFrame, printed: DataFrame, doc_id: str = "doc_id", text: str = "text", n_blocks: int = 1 << 17) -> DataFrame:
    """(digest,): digests under which the bytes of several canonical texts lie. printed: (doc_id, digest, ...) of docs."""
    shared = printed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    ids = spread_join(printed.select("digest", _id_key(doc_id).alias("__key")), shared, "digest", "__key")
    bloom = blocked_bloom(ids, "__key", n_blocks)
    here, hit = _id_key(doc_id), F.lit(True)
    rows = docs.select(F.col(text).alias("__text"), here.alias("__key")).withColumn("__at", _block(F.col("__key"), n_blocks))
    for k, word in enumerate(_words(F.col("__key"))):
        hit = hit & (F.col(f"w{k}").bitwiseAND(word) == word)
    picked = rows.join(F.broadcast(bloom), F.col("__at") == F.col("block")).filter(hit)  # at most n_blocks rows
    texts = picked.select(F.pandas_udf(_canonicals, "digest string, canonical string")("__text").alias("c")).groupBy("c.digest", "c.canonical").agg(F.count(F.lit(1)).alias("n"))
    return stored(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "fingerprint-collisions")


def _verified(rows: DataFrame, collisions: DataFrame, digest: str, proof: str, out: str) -> DataFrame:
    seen = collisions.select(F.col("digest").alias("__seen"))
    joined = rows.join(seen, F.col(digest) == F.col("__seen"), "left")
    return joined.withColumn(out, F.when(F.col("__seen").isNull(), F.col(digest)).otherwise(F.concat(digest, proof))).drop("__seen")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, copies, first_id): verified fingerprints, how many documents share each, and the least id of these."""
    printed = stored(docs.select(doc_id, F.pandas_udf(_prints, PRINT)(F.col(text)).alias("p")).select(doc_id, "p.digest", "p.proof"), "fingerprints")
    checked = _verified(printed, colliding_digests(docs, printed, doc_id, text), "digest", "proof", "fingerprint").select(doc_id, "fingerprint")
    groups = checked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min(doc_id).alias("first_id"))
    return spread_join(checked, groups, "fingerprint", doc_id).select(doc_id, "fingerprint", "copies", "first_id")


PAIRED = "part int, kind string, doc_id long, n_chars long, edited_sha256 string, digest string, proof string, edited_digest string, edited_proof string, next_digest string, next_proof string, same_edited boolean, same_next boolean, text string"
_NAMES = [c.split()[0] for c in PAIRED.split(", ")]


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _pair(part: int, doc_id, text: str, canonical: str, following: str, next_canonical: str) -> tuple:
    changed = edited(text, following)
    raw, folded = changed.encode("utf-8", "surrogatepass"), canonical_text(changed)
    return (part, "row", doc_id, len(text), hashlib.sha256(raw).hexdigest(), *digests(canonical), *digests(folded), *digests(next_canonical), canonical == folded, canonical == next_canonical, None)


def _end(part: int, kind: str, doc_id, text: str) -> tuple:
    return (part, kind, doc_id, len(text), *[None] * (len(_NAMES) - 5), text)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text, of its edited form and of the next document's text (by descending id, after the last the first).

    Range partitions are sorted and read as streams. The first and the last text of each leave it, too, and are paired
    over the partitions' borders by partition number.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            ids = [None if i is None or i != i else int(i) for i in batch["doc_id"]]
            for i, t in zip(ids, batch["text"]):
                own = canonical_text(t)
                rows.append(_end(part, "first", i, t) if last is None else _pair(part, *last, t, own))
                last = (i, t, own)
            yield pd.DataFrame(rows, columns=_NAMES).astype({"doc_id": "Int64"})
        if last is not None:
            yield pd.DataFrame([_end(part, "last", *last[:2])], columns=_NAMES).astype({"doc_id": "Int64"})

    found = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInPandas(stream, PAIRED), "fingerprint-pairs")

    firsts = found.filter("kind = 'first'")
    by_number = W.orderBy("part")  # one small row for each partition
    follows = firsts.select("part").withColumn("then", F.coalesce(F.lead("part").over(by_number), F.min("part").over(W.partitionBy(F.lit(0)))))
    heads = firsts.select(F.col("part").alias("then"), F.col("text").alias("next_text"))
    border = found.filter("kind = 'last'").select("part", "doc_id", "text").join(follows, "part").join(heads, "then").select("part", "doc_id", "text", "next_text")

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if i is None or i != i else int(i) for i in batch["doc_id"]]
            rows = [_pair(p, i, t, canonical_text(t), n, canonical_text(n)) for p, i, t, n in zip(batch["part"], ids, batch["text"], batch["next_text"])]
            yield pd.DataFrame(rows, columns=_NAMES).astype({"doc_id": "Int64"})

    return found.filter("kind = 'row'").unionByName(border.mapInPandas(pair, PAIRED)).drop("part", "kind", "text")


def op2_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    paired = with_next(docs)
    own = paired.select("doc_id", "digest", "proof")
    both = [paired.select(F.col(f"{k}digest").alias("digest"), F.col(f"{k}proof").alias("proof")) for k in ("", "edited_")]
    proofs = both[0].unionByName(both[1]).groupBy("digest").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).filter("a <> b").select("digest")
    differ = paired.filter("digest = edited_digest and not same_edited or digest = next_digest and not same_next").select("digest")
    collisions = stored(colliding_digests(docs, own).unionByName(proofs).unionByName(differ).distinct(), "fingerprint-collisions")
    rows = paired
    for digest, proof, out in (("digest", "proof", "fingerprint"), ("edited_digest", "edited_proof", "edited_fingerprint")):
        rows = _verified(rows, collisions, digest, proof, out)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("same_edited").cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"))
