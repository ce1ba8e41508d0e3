"""WARC archives with revisit records.

Headers (payload digest, size, page_id) are shuffled by digest; of equal payloads of at least ``least`` bytes the row
with the largest page_id is the response and the others become revisit records that refer to it. Archives are
written by tasks as gzip members a record, with fresh headers, and read back from the manifest of finished files.

A null html is an empty payload, a null or odd url a urn; rows with a null page_id are responses of their own; repeated
rows of the largest page_id are all responses; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampletide.llm.common import batch_of, partitions, shared_dir, slices, written

LEAST, FILE_BYTES = 1000, 64 << 20
#: A key is hot if it has more than one in so many of all counted rows, and more rows than this.
HOT = 1000
DATE = "2024-01-01T00:00:00Z"


def joined_to(rows: DataFrame, key: str, few: DataFrame, count: str) -> DataFrame:
    """``rows`` with the columns of ``few``, whose ``key`` is unique and which says how many rows have it; null where it has none.

    Keys with more than a ``HOT``-th of all counted rows, of which there are fewer than ``HOT``, are broadcast, and their rows stay where they are; all others
    meet by a shuffle in which no key is hot.
    """
    few, _ = written(few, "few")
    total = few.agg(F.sum(count)).head()[0] or 0
    names = [c for c in few.columns if c not in (key, count)]
    hot = few.where(F.col(count) > max(HOT, total // HOT)).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    cold = few.where(F.col(count) <= max(HOT, total // HOT)).select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in names])
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    # what has been met, or has no key, gets one that nothing has, so that it spreads
    apart = F.concat(F.lit("-"), F.xxhash64("page_id", F.rand(3)).cast("string"))
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(apart))
    rows = rows.join(cold, F.col("_key") == F.col("_cold"), "left")
    return rows.withColumns({c: F.coalesce(f"_hot_{c}", f"_cold_{c}") for c in names}).drop("_key", "_hot", "_cold", *[f"_{k}_{c}" for k in ("hot", "cold") for c in names])


def resolved(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest (lower-case hex SHA-1) and refers_to (null for responses).

    Only digests that occur more than once stand on the small side of the join.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    heads = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    originals = heads.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    rows = joined_to(rows, "digest", originals, "n")
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("original"), F.col("original")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, gzipped."""
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": date}
    head["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%") if url else "urn:page:unknown"
    head["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        body += payload
    else:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "WARC-Truncated": "length"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body)), "Page-ID": "" if page_id is None else str(page_id)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + body + b"\r\n\r\n", 6, mtime=0)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield head, block


def write_archives(rows: DataFrame, directory: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``resolved`` rows; the manifest: path and n_records of each finished file."""
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(directory)
        files.create_dir(root, recursive=True)
        out, name, held, n = None, "", 0, 0
        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, held, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                data = record(*row)
                out.write(data)
                held, n = held + len(data), n + 1
                if held >= file_bytes:
                    out.close()
                    out = None
                    yield batch_of(schema, {"path": [f"{directory}/{name}"], "n_records": [n]})
        if out is not None:
            out.close()
            yield batch_of(schema, {"path": [f"{directory}/{name}"], "n_records": [n]})

    return written(rows.mapInArrow(run, "path string, n_records long"), "warc-manifest")[0]


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record: page_id, record_id, record_type, payload_bytes and payload_digest (null for revisits but for the digest), target (the record a revisit refers to)."""
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, name = pyarrow.fs.FileSystem.from_uri(path)
                out: dict[str, list] = {k: [] for k in schema.names}
                with files.open_input_stream(name, compression=None) as stream, gzip.GzipFile(fileobj=stream) as plain:
                    for head, block in records(io.BufferedReader(plain, 1 << 20)):
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = None
                        if head["WARC-Type"] == "response":
                            payload = block[re.search(rb"\r\n\r\n", block).end() :]
                            size = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{head['WARC-Record-ID']} has another payload than its digest says")
                        page_id = int(head["Page-ID"]) if head["Page-ID"] else None
                        for k, x in zip(schema.names, (page_id, head["WARC-Record-ID"], head["WARC-Type"], size, digest, head.get("WARC-Refers-To")), strict=True):
                            out[k].append(x)
                        if len(out["target"]) >= 5000:
                            yield batch_of(schema, out)
                            out = {k: [] for k in schema.names}
                if out["target"]:
                    yield batch_of(schema, out)

    fields = "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, target string"
    return manifest.select("path").repartition(partitions(manifest.sparkSession)).mapInArrow(run, fields)


def followed(found: DataFrame) -> DataFrame:
    """Every record with its full payload's size and the page_id it refers to. Only responses that revisits name are looked up."""
    responses, revisits = found.where("record_type = 'response'"), found.where("record_type = 'revisit'").drop("payload_bytes")
    named = revisits.groupBy("target").agg(F.count("*").alias("n"))
    sizes = responses.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes").join(named, "target")
    originals = sizes.groupBy("target").agg(F.max("refers_to").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"), F.max("n").alias("n"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(joined_to(revisits, "target", originals, "n").select(columns))


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and follow their revisits."""
    found, _ = written(read_archives(write_archives(resolved(pages), shared_dir(spark, "warc"))), "warc-records")
    return followed(found)
