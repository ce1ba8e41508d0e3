"""Token ids as binary files, coded by a static range asymmetric numeral system.

Documents are laid out in ascending ``doc_id`` order (nulls first, repeated ids as the table has them) in segments of whole
documents. A segment has one frequency table, counted over all its ids, that its blocks share; blocks decode
independently, each of interleaved lanes with its start states as checkpoint and a CRC-32. A manifest row
names each finished segment, so files of lost attempts are never read. Texts are shuffled once, before they become ids.

Null and empty texts have the end id alone; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sampletide.llm.common import batch_of, partitions, shared_dir, slices, written
from sampletide.llm.tokenizing import encoder

#: Frequencies sum to 2 ** PRECISION; states lie in [2 ** 31, 2 ** 63) and shed 32 bits at a time.
PRECISION = 20
MAGIC = b"RANSEG1\n"
BLOCK_IDS = 1 << 18
SEGMENT_IDS = 1 << 21
LANES = 1024
_HEAD, _BLOCK = struct.Struct("<8sQQQI"), struct.Struct("<QIIII")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies for 2 ** PRECISION in all, at least 1 where the count isn't 0, near proportion."""
    total, whole = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.uint32)
    seen = counts > 0
    if seen.sum() > whole:
        raise ValueError("more distinct ids than the frequency table can tell apart")
    freq = np.where(seen, np.maximum(1, np.floor(counts * (whole / total))), 0).astype(np.int64)
    over = int(freq.sum()) - whole
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    while over > 0:  # the rounding up to 1 is paid back by the most frequent ids in proportion
        spare = freq[order] - 1
        take = np.minimum(spare, np.ceil(spare * (over / spare.sum())).astype(np.int64))
        take = np.where(np.cumsum(take) > over, np.maximum(0, over - (np.cumsum(take) - take)), take)
        freq[order] -= take
        over = int(freq.sum()) - whole
    return freq.astype(np.uint32)


def encode_block(ids: np.ndarray, freq: np.ndarray, first: np.ndarray) -> tuple[int, bytes]:
    """Lanes used, and their final states followed by the words in the order a decoder asks for them."""
    lanes = min(LANES, max(1, len(ids) // 64))
    state, out = np.full(lanes, 1 << 31, np.uint64), []
    f, c = freq[ids].astype(np.uint64), first[ids].astype(np.uint64)
    top = f << np.uint64(63 - PRECISION)
    for begin in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        end = min(begin + lanes, len(ids))
        x, fx = state[: end - begin], f[begin:end]
        full = x >= top[begin:end]
        out.append(x[full].astype(np.uint32))
        x[full] >>= np.uint64(32)
        quotient = x // fx
        state[: end - begin] = (quotient << np.uint64(PRECISION)) + (x - quotient * fx) + c[begin:end]
    return lanes, state.tobytes() + np.concatenate(out[::-1]).tobytes()


def decode_block(data: bytes, n: int, lanes: int, freq: np.ndarray, first: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    state = np.frombuffer(data, np.uint64, lanes).copy()
    words, at = np.frombuffer(data, np.uint32, offset=lanes * 8), 0
    ids, mask = np.empty(n, symbol.dtype), np.uint64((1 << PRECISION) - 1)
    for begin in range(0, n, lanes):
        end = min(begin + lanes, n)
        x = state[: end - begin]
        slot = x & mask
        got = symbol[slot]
        x = freq[got] * (x >> np.uint64(PRECISION)) + slot - first[got]
        low = np.flatnonzero(x < np.uint64(1 << 31))
        x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
        state[: end - begin] = x
        ids[begin:end] = got
    if at != len(words) or (state != np.uint64(1 << 31)).any():
        raise ValueError("a block doesn't end where its encoder began")
    return ids


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = freq.astype(np.uint64)
    return wide, np.cumsum(wide) - wide


def segment_bytes(doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    ids = np.concatenate(parts)
    freq = frequencies(np.bincount(ids))
    tables = _tables(freq)
    blocks, rows = [], []
    for begin in range(0, len(ids), BLOCK_IDS):
        lanes, data = encode_block(ids[begin : begin + BLOCK_IDS], *tables)
        rows.append((len(data), lanes, min(BLOCK_IDS, len(ids) - begin), zlib.crc32(data)))
        blocks.append(data)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    index = known.tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([len(x) for x in parts], "<u8").tobytes()
    index += b"".join(_BLOCK.pack(*row, 0) for row in rows) + freq.astype("<u4").tobytes()
    packed = zlib.compress(index, 6)
    return b"".join([_HEAD.pack(MAGIC, len(parts), len(rows), len(packed), zlib.crc32(packed)), packed, *blocks])


def segment_documents(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and token ids; checksums are verified."""
    magic, n, n_blocks, size, crc = _HEAD.unpack_from(data)
    at = _HEAD.size + size
    if magic != MAGIC or zlib.crc32(data[_HEAD.size : at]) != crc:
        raise ValueError("not a segment, or its index is damaged")
    index, ids = zlib.decompress(data[_HEAD.size : at]), []
    known, doc_ids, sizes = np.frombuffer(index, np.uint8, n), np.frombuffer(index, "<i8", n, n), np.frombuffer(index, "<u8", n, n * 9)
    freq = np.frombuffer(index, "<u4", offset=n * 17 + n_blocks * _BLOCK.size)
    tables = *_tables(freq), np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
    for i in range(n_blocks):
        size, lanes, count, crc, _ = _BLOCK.unpack_from(index, n * 17 + i * _BLOCK.size)
        block, at = data[at : at + size], at + size
        if zlib.crc32(block) != crc:
            raise ValueError("a block is damaged")
        ids.append(decode_block(block, count, lanes, *tables))
    ids = np.concatenate(ids)
    ends = np.cumsum(sizes.astype(np.int64)).tolist()
    for i, end in enumerate(ends):
        yield int(doc_ids[i]) if known[i] else None, ids[end - int(sizes[i]) : end]


def placement(docs: DataFrame) -> tuple[Column, int]:
    """The bucket of each row of ``docs``, a table's scan, and how many there are: ranges of doc_id of about equal size, nulls first.

    An id, or null, with more rows than a bucket has several; its rows go to them by where they stand in the table.
    """
    n, parts = partitions(docs.sparkSession), max(1, docs.rdd.getNumPartitions())
    cuts = F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)
    cuts, rows, nulls = docs.select(cuts, F.count("*"), F.count_if(F.col("doc_id").isNull())).head()
    cuts = list(cuts or []) if n > 1 else []
    first = -(-nulls * n // rows) if nulls else 0  # the buckets of null ids
    nth = lambda many: F.least(F.floor(F.spark_partition_id() * many / parts), F.greatest(many - 1, F.lit(0)))
    below = F.size(F.filter(F.lit(cuts), lambda x: x < F.col("doc_id"))) if cuts else F.lit(0)
    same = F.size(F.filter(F.lit(cuts), lambda x: x == F.col("doc_id"))) if cuts else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), nth(F.lit(first))).otherwise(first + below + nth(same))
    return bucket.cast("int"), n + first


def write_ids(docs: DataFrame, tokenizer: str, directory: str, keeps_space: bool = True, end_id: int = 0) -> DataFrame:
    """Encode all rows into segment files under ``directory``; the manifest.

    Manifest: path, bucket and seq (their order is doc_id order), start (ids in segments before), n_ids, n_docs.
    The files' number follows the input; a task holds one segment and a slice of texts at a time.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bucket, n = placement(docs)
    schema = pa.schema([("path", pa.string()), ("bucket", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space)
        files, root = pyarrow.fs.FileSystem.from_uri(directory)
        files.create_dir(root, recursive=True)
        seqs: dict[int, int] = {}
        now, doc_ids, parts, held = None, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal doc_ids, parts, held
            if parts:
                name = f"ids-{now:06d}-{uuid.uuid4().hex}.bin"
                with files.open_output_stream(f"{root}/{name}") as out:
                    out.write(segment_bytes(doc_ids, parts))
                yield batch_of(schema, {"path": [f"{directory}/{name}"], "bucket": [now], "seq": [seqs.setdefault(now, 0)], "n_ids": [held], "n_docs": [len(parts)]})
                seqs[now] += 1
            doc_ids, parts, held = [], [], 0

        for batch in slices(batches, "text"):
            for b, doc_id, ids in zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                if b != now or held >= SEGMENT_IDS:
                    yield from flush()
                    now = b
                doc_ids.append(doc_id)
                parts.append(np.append(ids, end_id).astype("<u4"))
                held += len(parts[-1])
        yield from flush()

    placed = docs.withColumn("bucket", bucket).withColumn("row", F.monotonically_increasing_id()).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "row")
    manifest, _ = written(placed.mapInArrow(run, "path string, bucket int, seq int, n_ids long, n_docs long"), "manifest")
    before = manifest.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # one row a bucket
    before = before.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(F.broadcast(before), "bucket").select("path", "bucket", "seq", (F.col("base") + F.col("inside")).alias("start"), "n_ids", "n_docs")


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of each document, segments decoded in parallel."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, name = pyarrow.fs.FileSystem.from_uri(path)
                with files.open_input_stream(name) as stream:
                    data = stream.read()
                got, held = [], 0
                for doc_id, ids in segment_documents(data):
                    got.append((doc_id, start, ids.astype("<u4").tobytes()))
                    start, held = start + len(ids), held + len(ids)
                    if held > 1 << 18:
                        yield batch_of(schema, dict(zip(schema.names, map(list, zip(*got, strict=True)), strict=True)))
                        got, held = [], 0
                if got:
                    yield batch_of(schema, dict(zip(schema.names, map(list, zip(*got, strict=True)), strict=True)))

    return manifest.select("path", "start").repartition(partitions(manifest.sparkSession)).mapInArrow(run, "doc_id long, start long, ids binary")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids of ``read_ids``."""
    return documents.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to files in the shared folder, read them back, and digest what was read."""
    return digests(read_ids(write_ids(docs, tokenizer, shared_dir(spark, "id-files"))))
