"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A shard file is a row of records: the payload's length (8 bytes), the masked CRC-32C of those 8
bytes (4), the payload, its masked CRC-32C (4), all little-endian. The payload is the ids of one
document, 2 bytes each if every id of the vocabulary fits, else 4. The index is a Parquet table
with a row for each record: ``shard, ordinal, doc_id, offset, size, n_tokens, before`` (bytes of
the record, ids of the shard's documents before it).
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checksums import crc32c, masked
from .common import shuffle_width, text_bytes
from .tokens import encoder

_HEAD = struct.Struct("<QI")
INDEX = "shard long, ordinal long, doc_id long, offset long, size long, n_tokens long, before long, id_bytes int, file string"
_INDEX_ARROW = pa.schema([
    ("shard", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()),
    ("n_tokens", pa.int64()), ("before", pa.int64()), ("id_bytes", pa.int32()), ("file", pa.string()),
])


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def frame(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and both checksums."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [n + struct.pack("<I", h) + p + struct.pack("<I", b) for n, h, p, b in zip(lengths, heads, payloads, bodies, strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """The payloads; a record that does not match its checksums raises."""
    payloads = []
    for r in records:
        n, _ = _HEAD.unpack_from(r)
        if len(r) != n + 16:
            raise ValueError(f"a record of {len(r)} bytes says it holds {n}")
        payloads.append(r[12:-4])
    heads = np.array([struct.unpack_from("<I", r, 8)[0] for r in records], np.uint32)
    bodies = np.array([struct.unpack_from("<I", r, len(r) - 4)[0] for r in records], np.uint32)
    if (heads != masked(crc32c([r[:8] for r in records]))).any() or (bodies != masked(crc32c(payloads))).any():
        raise ValueError("a record does not match its checksum")
    return payloads


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them as records in ascending id order; return the index.

    Rows are dealt by ranges of the id, so shard k holds smaller ids than shard k + 1, and sorted in
    each shard; a task streams its shard to one file under a name of its own and moves it into place
    when it is whole, so a task that runs again writes the same file. ``shards`` is the number of
    ranges (default: the session's shuffle partitions).

    Null text: an empty document, so its record holds the end id alone. Null ids: first. Repeated ids:
    a record each, ordered by text. No rows: an empty index and no file. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    rows = rows.repartitionByRange(shards or shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "raw")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        width, shard = tok.id_bytes, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        at = before = ordinal = 0
        out = files = own = None
        name = f"shard-{shard:06d}.records"
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    every = [ids + end for ids in tok.many(part.column("raw").to_pylist())]
                    payloads = [np.frombuffer(ids, "<u4").astype("<u2").tobytes() for ids in every] if width == 2 else every
                    records = frame(payloads)
                    if out is None:
                        files, root = _files(path)
                        files.create_dir(root, recursive=True)
                        own = f"{root}/.{name}.{uuid.uuid4().hex}"
                        out = files.open_output_stream(own)
                    out.write(b"".join(records))
                    sizes = np.fromiter(map(len, records), np.int64, len(records))
                    counts = np.fromiter(map(len, payloads), np.int64, len(payloads)) // width
                    n = len(records)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, shard)), pa.array(np.arange(ordinal, ordinal + n)), part.column("doc_id"),
                        pa.array(at + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(counts),
                        pa.array(before + np.cumsum(counts) - counts), pa.array(np.full(n, width, np.int32)), pa.array([name] * n),
                    ], schema=_INDEX_ARROW)
                    at, before, ordinal = at + int(sizes.sum()), before + int(counts.sum()), ordinal + n
            if out is not None:
                out.close()
                files.move(own, f"{root}/{name}")
                own = None
        finally:
            if own is not None:
                out.close()
                files.delete_file(own)

    index = f"{path}/index"
    rows.mapInArrow(write, INDEX).write.mode("overwrite").parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``, the ids of all records before, over all shards.

    One row for each shard is summed up in order; the rows of the index stay where they are.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    earlier = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(totals.select("shard", earlier.alias("base")), "shard").withColumn("start", F.col("base") + F.col("before"))


def read_records(index: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Read the records that the rows of ``index`` name, in any order or choice, and check them.

    Returns the columns ``keep`` of the index and ``ids``: little-endian unsigned 32-bit integers.
    A record that does not match its checksums raises.
    """
    asked = index.select(*dict.fromkeys([*keep, "file", "offset", "size", "id_bytes"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name in keep) + ", ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        opened, name = None, None
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    records, wanted = [], list(zip(*(part.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True))
                    for f, run in itertools.groupby(wanted, key=lambda r: r[0]):
                        if f != name:
                            if opened is not None:
                                opened.close()
                            opened, name = files.open_input_file(f"{root}/{f}"), f
                        run = list(run)
                        first, last = run[0][1], run[-1][1] + run[-1][2]
                        if last - first <= 2 * sum(size for _, _, size in run):  # neighbours: one read
                            block = opened.read_at(last - first, first)
                            records += [block[at - first : at - first + size] for _, at, size in run]
                        else:
                            records += [opened.read_at(size, at) for _, at, size in run]
                    widths = part.column("id_bytes").to_pylist()
                    ids = [np.frombuffer(p, f"<u{w}").astype("<u4").tobytes() for p, w in zip(unframe(records), widths, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(ids, pa.binary())], names=[*keep, "ids"])
        finally:
            if opened is not None:
                opened.close()

    return asked.sortWithinPartitions("file", "offset").mapInArrow(read, schema)
