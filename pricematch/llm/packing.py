"""Token sequences packed into training windows of a fixed size, in bounded space."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, text_bytes
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_STAGED = PIECES + ", part long, ids binary"
_STAGED_ARROW = pa.schema([
    *((c, pa.int64()) for c in "doc_id start length ids_crc32 doc_tokens sequence_id offset part".split()), ("ids", pa.binary()),
])
_ROUND, _PART = 56, 32  # where a sequence id has the round and the task


class Packer:
    """Keeps at most ``windows`` open windows and gives out closed ones.

    A piece goes to the open window that it fills best. If it fits into none and all windows are in
    use, the fullest is given out. So that this leaves little padding, the piece's head first fills it
    up, if both the head and what remains have at least ``least`` ids.
    """

    def __init__(self, size: int, windows: int, least: int):
        self.size, self.windows, self.least = size, windows, least
        self.room: list[tuple[int, int]] = []  # (free ids, window number), sorted
        self.open: dict[int, list] = {}
        self.made = 0

    def add(self, piece: tuple) -> Iterator[list]:
        """A piece is (doc_id, start, ids, doc_tokens); yields the pieces of each window that closes."""
        doc, start, ids, total = piece
        n = len(ids) // 4
        while n > self.size:
            yield [(doc, start, ids[: 4 * self.size], total)]
            ids, start, n = ids[4 * self.size :], start + self.size, n - self.size
        at = bisect.bisect_left(self.room, (n, -1))
        if at == len(self.room) and len(self.room) >= self.windows:
            free, number = self.room.pop(0)
            if free >= self.least and n - free >= self.least:
                self.open[number].append((doc, start, ids[: 4 * free], total))
                ids, start, n = ids[4 * free :], start + free, n - free
            yield self.open.pop(number)
            at = bisect.bisect_left(self.room, (n, -1))
        if at < len(self.room):
            free, number = self.room.pop(at)
        else:
            free, number, self.made = self.size, self.made, self.made + 1
            self.open[number] = []
        self.open[number].append((doc, start, ids, total))
        if free == n:
            yield self.open.pop(number)
        else:
            bisect.insort(self.room, (free - n, number))

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [self.open[number] for _, number in self.room]


def _even(rest: list[list], size: int) -> Iterator[list]:
    """The last leftovers joined: full windows, then one for each power of two in what remains."""
    pieces = [p for window in rest for p in window]
    left = sum(len(p[2]) // 4 for p in pieces)
    while left:
        want = size if left >= size else 1 << (left.bit_length() - 1)
        window, filled = [], 0
        while filled < want:
            doc, start, ids, total = pieces.pop(0)
            take = min(want - filled, len(ids) // 4)
            window.append((doc, start, ids[: 4 * take], total))
            if take < len(ids) // 4:
                pieces.insert(0, (doc, start + take, ids[4 * take :], total))
            filled += take
        left -= want
        yield window


class _Rows:
    """Pieces of windows as Arrow batches; an open window's pieces carry their ids."""

    def __init__(self, first: int, part: int, most: int = 4000):
        self.first, self.part, self.made, self.most = first, part, 0, most
        self.rows: list[tuple] = []

    def window(self, pieces: list, closed: bool) -> None:
        offset, number = 0, self.first + self.made
        self.made += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            if closed:
                self.rows.append((doc, start, n, zlib.crc32(ids), total, number, offset, self.part, None))
            else:
                self.rows.append((doc, start, n, None, total, None, None, self.part, ids))
            offset += n

    def full(self) -> bool:
        return len(self.rows) >= self.most

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) or [()] * len(_STAGED_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STAGED_ARROW, strict=True)], schema=_STAGED_ARROW)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, windows: int = 64, least: int = 64, end_id: int = 1, merge: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and pack them into sequences of at most ``size`` ids.

    Each input partition is packed as it streams by, with ``windows`` open windows (bounded space: so
    many times ``size`` ids). What is still open at its end goes on, with its ids, to a merge: groups of
    ``merge`` partitions are packed together the same way, and so on until one group is left, whose
    windows are filled one after the other; the last remainder becomes windows of power-of-two length,
    which need no padding. Texts are not shuffled. Each round is written to the shared folder, so a
    sequence id, made of round, task and number, stays what it is when an executor is lost.

    Returns a row for each piece: ``doc_id, start`` (ids of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens`` (with the end id), ``sequence_id, offset``.

    Null text: an empty document, the end id alone. Null or repeated ids: packed as any other row.
    Very long texts: cut into full windows and a remainder. No rows: no pieces. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        packer, out = Packer(size, windows, least), _Rows(task << _PART, task)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), tok.many(part.column("raw").to_pylist()), strict=True):
                    ids += end
                    for window in packer.add((doc, 0, ids, len(ids) // 4)):
                        out.window(window, True)
                    if out.full():
                        yield out.batch()
        for window in packer.rest():
            out.window(window, False)
        yield out.batch()

    path = new_folder(spark, "packing")

    def staged(df: DataFrame, turn: int) -> DataFrame:
        df.write.parquet(f"{path}/{turn}")
        return spark.read.schema(_STAGED).parquet(f"{path}/{turn}")

    done, turn = [], 0
    now = staged(rows.mapInArrow(first, _STAGED), turn)
    while True:
        done.append(now.filter("ids is null").select(*[c.strip().split()[0] for c in PIECES.split(",")]))
        open_ = now.filter("ids is not null")
        parts = open_.agg(F.max("part")).first()[0]
        if parts is None:
            break
        turn += 1
        last = parts < merge
        now = staged(_merged(open_, turn, size, windows, least, merge, last), turn)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _merged(open_: DataFrame, turn: int, size: int, windows: int, least: int, merge: int, last: bool) -> DataFrame:
    """Leftovers of ``merge`` partitions at a time, longest piece first; the last group leaves none open.

    A group holds at most ``merge * windows`` windows, whatever the size of the table.
    """

    def group(key: tuple, pieces: pa.Table) -> pa.Table:
        part = key[0].as_py()
        packer, out = Packer(size, windows, least), _Rows(turn << _ROUND | part << _PART, part)
        rows = list(zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True))
        rows.sort(key=lambda r: (-len(r[2]), r[0] is None, r[0], r[1], r[2]))
        for row in rows:
            for window in packer.add(row):
                out.window(window, True)
        rest = packer.rest()
        for window in _even(rest, size) if last else rest:
            out.window(window, last)
        return pa.Table.from_batches([out.batch()])

    groups = open_.withColumn("grp", F.floor(F.col("part") / merge).cast("long"))
    return groups.groupBy("grp").applyInArrow(group, _STAGED)
