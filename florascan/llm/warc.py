"""WARC archives: writing, normalising whole-file gzip streams, and reading back by a sidecar index.

``write_archives`` writes one archive a task, compressed as one gzip stream, as many crawls come. ``normalise`` inflates
each such stream once, front to back in bounded memory, cuts it into records by their Content-Length, writes every record
as a gzip member of its own and an index line with its offset and length beside the archive. ``read_records`` takes the
records back one member at a time by the index.

Of records with equal payloads of at least ``min_bytes`` the one with the largest id is a response; the others are revisit
records, which carry the payload's digest and length and the response's id instead of the payload. Copies are grouped by
SHA-1 and length; of a group only its response is joined back, under several salts, so that a large group spreads.

Files go to the folder that driver and executors share, through pyarrow's file systems. A task writes under a name of its
own attempt and the manifest names the files that count; manifests are written tables, so a lost executor does not make a
task write again behind a reader's back.

Defined results: a null html is an empty payload; null urls and ids are written as empty headers and read back as null.
A record without an id revisits the largest id of its payload; without any id in a group all of it are responses, as a
revisit has to name one. Rows that repeat the largest id revisit it but for one. Line breaks in a url become spaces in its
header. Equal rows are written as often as they occur; an empty table gives no archives. Other columns are not passed on.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florascan.llm.common import new_path, stored, table

CHUNK = 1 << 20
END = b"\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def decide_types(pages: DataFrame, min_bytes: int = 1000, salts: int = 16, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.monotonically_increasing_id().alias("tag"), F.length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    rows = stored(rows, "warc-rows")  # fixes the tags, which tell equal rows apart
    groups = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "tag")).alias("main"), F.count(F.lit(1)).alias("copies"))
    mains = stored(groups.filter("copies > 1 and main.page_id is not null").select(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"), "main"), "warc-mains")
    spread = mains.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes")) & (F.pmod("tag", F.lit(salts)) == F.col("__copy"))
    # Spark broadcasts the responses of groups where their measured size allows; else rows travel, html included.
    refers_to = F.when(F.col("tag") != F.col("main.tag"), F.col("main.page_id"))
    kind = F.when(refers_to.isNull(), "response").otherwise("revisit")
    return rows.join(spread, same, "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", kind.alias("record_type"), refers_to.alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    named = page_id is not None and page_id == page_id
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{int(page_id) if named else ''}>", f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{int(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + END + payload + END


def parsed_headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)


def write_archives(decided: DataFrame, folder: str, records: int = 5000, archive_bytes: int = 256 << 20) -> DataFrame:
    """Manifest of whole-file gzip archives, written by the tasks that hold the rows: an archive ends after ``records`` records or with the one that brings it to ``archive_bytes``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        found, out, squeeze, n, size, name = [], None, None, 0, 0, ""

        def close():
            out.write(squeeze.flush())
            out.close()
            found.append((f"{folder}/{name}", n, size))

        for batch in batches:
            for page_id, url, html, digest, kind, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["payload_digest"], batch["record_type"], batch["refers_to"]):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, squeeze = system.open_output_stream(f"{at}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                record = record_bytes(page_id, url, (html or "").encode(), digest, kind, refers_to)
                out.write(squeeze.compress(record))
                n, size = n + 1, size + len(record)
                if n == records or size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(found, columns=["path", "records", "bytes"])

    return stored(decided.mapInPandas(write, MANIFEST), "warc-written")


def records_of(stream) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record of a gzip stream (of one or more members), read once and in pieces."""
    inflate, held = zlib.decompressobj(31), bytearray()
    more = True

    def fill() -> bool:
        nonlocal inflate, more
        while more:
            raw = inflate.unused_data if inflate.eof else b""
            raw = raw or stream.read(CHUNK)
            if not raw:
                more = False
                break
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            got = inflate.decompress(raw)
            held.extend(got)
            if got:
                return True
        return False

    start = 0
    while True:
        while (end := held.find(END, start)) < 0:
            if not fill():
                if bytes(held[start:]).strip():
                    raise ValueError("an archive ends within a record")
                return
        head = bytes(held[start:end])
        length = int(parsed_headers(head)["Content-Length"])
        stop = end + 4 + length
        while len(held) < stop + 4:
            if not fill():
                raise ValueError("an archive ends within a record")
        yield head, bytes(held[end + 4 : stop])
        start = stop + 4
        if start > CHUNK:
            del held[:start]
            start = 0


def _dealt(manifest: DataFrame) -> DataFrame:
    """A manifest with an archive a task; its few bytes would else be one partition."""
    return manifest.repartition(max(1, manifest.count()))


def normalise(manifest: DataFrame, folder: str, keep_source: bool = False) -> DataFrame:
    """Manifest of archives with a member for each record and an index beside them (path + ".index": JSON lines)."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        for batch in batches:
            for source in batch["path"]:
                origin, where = _opened(source)
                name, offset, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                with origin.open_input_stream(where, compression=None) as stream, system.open_output_stream(f"{at}/{name}", compression=None) as out, system.open_output_stream(f"{at}/{name}.index", compression=None) as index:
                    for head, block in records_of(stream):
                        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = squeeze.compress(head + END + block + END) + squeeze.flush()
                        out.write(member)
                        index.write(json.dumps({"id": parsed_headers(head)["WARC-Record-ID"], "offset": offset, "length": len(member)}).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield pd.DataFrame([(f"{folder}/{name}", n, offset)], columns=["path", "records", "bytes"])

    done = stored(_dealt(manifest).mapInPandas(rewrite, MANIFEST), "warc-normal")
    if not keep_source:
        manifest.foreachPartition(_remove)
    return done


def _remove(rows) -> None:
    for row in rows:
        system, at = _opened(row.path)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            system.delete_file(at)


def _number(text: str) -> int | None:
    digits = text.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record, found by its index line; intact tells whether its payload has the digest that its head names."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, at = _opened(path)
                with system.open_input_stream(f"{at}.index", compression=None) as lines:
                    index = [json.loads(x) for x in lines.read().splitlines()]
                rows = []
                with system.open_input_file(at) as archive:
                    for entry in index:
                        archive.seek(entry["offset"])
                        head, _, rest = zlib.decompress(archive.read(entry["length"]), 31).partition(END)
                        said = parsed_headers(head)
                        block, digest = rest[:-4], said["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = said["WARC-Type"] == "revisit"
                        size = int(said["X-Payload-Length"]) if revisit else len(block)
                        intact = len(block) == int(said["Content-Length"]) and (revisit or hashlib.sha1(block).hexdigest() == digest)
                        rows.append((_number(said["WARC-Record-ID"]), said.get("WARC-Target-URI") or None, size, digest, said["WARC-Type"], _number(said["WARC-Refers-To"]) if revisit else None, intact))
                for k in range(0, len(rows), 10_000):
                    out = pd.DataFrame(rows[k : k + 10_000], columns=[c.split()[0] for c in RECORD.split(", ")])
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return _dealt(manifest).mapInPandas(read, RECORD)


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    written = write_archives(decide_types(table(spark, sf_dir, "pages")), f"{folder}/whole")
    records = read_records(normalise(written, f"{folder}/members"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP8_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
m as (select *, max(page_id) over (partition by payload_digest) as main, row_number() over (partition by payload_digest order by page_id desc nulls last) as place from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and place > 1 and main is not null then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and place > 1 then main end as refers_to, true as intact
from m
"""
