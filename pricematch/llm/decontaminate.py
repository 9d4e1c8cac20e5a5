"""Benchmark passages in texts: SimHash of item-sized windows, Hamming blocks, weighted-shingle similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, stored, text_bytes
from .shingles import WordHashes, mixed, shingle_row, words_of


def _hashes() -> WordHashes:
    return held("word hashes", WordHashes)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of a shingle's hash."""
    both = np.stack([mixed(shingles ^ np.uint64(0x1234567)), mixed(shingles ^ np.uint64(0xABCDEF01234))], axis=1)
    bits = np.unpackbits(both.view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _fingerprints(row: np.ndarray, size: int, starts: np.ndarray, reach: int = 4096) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at the sorted ``starts``, 16 bytes each.

    A window's counts are differences of running sums, which are kept for a stretch of the text at a time.
    """
    out = []
    for some in np.split(starts, np.flatnonzero(np.diff(starts // reach)) + 1):
        first = int(some[0])
        sums = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(_signs(row[first : int(some[-1]) + size]), axis=0)])
        out.append(np.packbits(sums[some - first + size] > sums[some - first], axis=1))
    return np.concatenate(out)


@dataclass
class Index:
    """Benchmark items as flat arrays: about 25 bytes for each word, and 40 for each item.

    Fingerprints have 16 blocks of 8 bits. If two of them differ in at most ``radius`` bits, they differ in at most
    ``radius // 16`` bits in one block at least.
    """

    width: int
    radius: int
    ids: np.ndarray
    n_words: np.ndarray
    at: np.ndarray  # where an item's shingles begin in ``rows``
    rows: np.ndarray
    prints: np.ndarray  # item x 16 bytes
    shingles: np.ndarray  # distinct and sorted
    first: np.ndarray  # where a shingle's items begin in ``owners``
    owners: np.ndarray

    def row(self, item: int) -> np.ndarray:
        return self.rows[self.at[item] : self.at[item + 1]]

    def size(self, item: int) -> int:
        """Shingles of a window of the item's size; for items of fewer words than a shingle, their number below zero."""
        words = int(self.n_words[item])
        return words - self.width + 1 if words >= self.width else -words

    @property
    def sizes(self) -> list[int]:
        """The sizes below zero: widths of shingles that texts are read in besides the usual one."""
        return sorted({-int(n) for n in np.unique(self.n_words[self.n_words < self.width])})

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, f).nbytes for f in ("ids", "n_words", "at", "rows", "prints", "shingles", "first", "owners"))

    def near(self, prints: np.ndarray, item: int) -> np.ndarray:
        """Which fingerprints are within the radius of an item's: first by their blocks, then by all bits."""
        differ = np.bitwise_count(prints ^ self.prints[item])
        some = np.flatnonzero((differ <= self.radius // 16).any(axis=1))
        return some[differ[some].sum(axis=1, dtype=np.int64) <= self.radius]


def build(items: list[tuple[int, bytes]], width: int = 5, radius: int = 44) -> Index:
    """An index of (item_id, UTF-8 text). Items without a word are left out."""
    hashes, ids, n_words, rows, prints = WordHashes(), [], [], [], []
    for item_id, raw in items:
        words = words_of(raw)
        if words:
            row = shingle_row(hashes.of(words), width)
            ids.append(item_id)
            n_words.append(len(words))
            rows.append(row)
            prints.append(np.packbits(_signs(row).sum(axis=0) > 0))
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)])
    sizes = np.array([len(r) for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.lexsort((owner, flat))
    shingle, owner = flat[order], owner[order]
    new = np.ones(len(order), bool)  # a shingle's item counts once, however often it holds it
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    shingle, owner = shingle[new], owner[new]
    distinct, first = np.unique(shingle, return_index=True)
    return Index(width, radius, np.array(ids, np.int64), np.array(n_words, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat,
                 np.array(prints, np.uint8).reshape(-1, 16), distinct, np.append(first, len(shingle)).astype(np.int64), owner)


def similarity(a: Counter, b: Counter) -> tuple[int, int]:
    """Weighted similarity as (sum of least counts, sum of greatest counts)."""
    shared = sum((a & b).values())
    return shared, sum(a.values()) + sum(b.values()) - shared


def matches(index: Index, raw: bytes, percent: int = 80) -> dict[int, tuple[int, int, int, int]]:
    """Items whose passage the text holds: number -> (least sum, greatest sum, start word, words) of the best window, the first of equals.

    A window can be similar to an item only if it holds one of its shingles, so windows are fingerprinted
    around shared shingles alone: every window of that item's size over each of them, and only with that item. There
    the Hamming blocks tell which windows are compared. A text shorter than the item is one window of all its words.
    """
    best: dict[int, tuple[int, int, int, int]] = {}
    if not len(index.ids):
        return best
    hashed = _hashes().of(words_of(raw))
    n_words = len(hashed)
    if not n_words:
        return best
    todo: dict[int, set[int]] = {}
    rows: dict[int, np.ndarray] = {}
    for width in {min(index.width, n_words), *(-s for s in index.sizes)}:
        if width > n_words:
            continue
        row = rows[width] = shingle_row(hashed, width)
        at = np.minimum(np.searchsorted(index.shingles, row), len(index.shingles) - 1)
        for p in np.flatnonzero(index.shingles[at] == row).tolist():
            for i in index.owners[index.first[at[p]] : index.first[at[p] + 1]].tolist():
                size = int(index.at[i + 1] - index.at[i])
                whole = min(size, len(row))
                todo.setdefault(i, set()).update(range(max(0, p - whole + 1), min(p, len(row) - whole) + 1))
    by_size: dict[int, list[int]] = {}
    for i in todo:
        by_size.setdefault(index.size(i), []).append(i)
    for size, members in by_size.items():
        width = min(index.width, n_words) if size > 0 else -size
        row = rows.get(width)
        if row is None:
            continue
        whole = min(max(size, 1), len(row))
        starts = np.array(sorted({s for i in members for s in todo[i] if s + whole <= len(row)}), np.int64)
        if not len(starts):
            continue
        prints = _fingerprints(row, whole, starts)
        for i in members:
            own = np.array(sorted(s for s in todo[i] if s + whole <= len(row)), np.int64)
            counts = None
            for start in own[index.near(prints[np.searchsorted(starts, own)], i)].tolist():
                counts = counts or Counter(index.row(i).tolist())
                low, high = similarity(Counter(row[start : start + whole].tolist()), counts)
                if 100 * low >= percent * high and (i not in best or low * best[i][1] > best[i][0] * high):
                    best[i] = (low, high, start, whole + width - 1)
    return best


def load(benchmark: DataFrame, width: int = 5, radius: int = 44, most_bytes: int = 16 << 20, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of all items, each of at most ``most_bytes`` of text (an item longer than that has one of its own), which
    is about 70 MB of index. They are made one at a time, as they are asked for: what the driver holds, and what a task
    gets, is bounded however large the benchmark is. Equal items stay apart by id. Null ids and texts are left out.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"), F.col(text_col).isNotNull().alias("has")).filter("id is not null and has").drop("has").distinct()
    block, size = [], 0
    for row in items.orderBy("id", "raw").toLocalIterator():
        if block and size + len(row.raw) > most_bytes:
            yield build(block, width, radius)
            block, size = [], 0
        block.append((row.id, bytes(row.raw)))
        size += len(row.raw)
    if block:
        yield build(block, width, radius)


def _sent(spark: SparkSession, indexes: Iterable[Index], use: Callable[[Broadcast], DataFrame], label: str) -> Iterator[DataFrame]:
    """``use`` of each index, broadcast. Of several, each is worked through and written before the next one is made."""
    rest = iter(indexes)
    now, only = next(rest, None), True
    while now is not None:
        sent = spark.sparkContext.broadcast(now)
        now = next(rest, None)
        only = only and now is None
        if only:
            yield use(sent)
        else:
            yield stored(use(sent), label)
            sent.unpersist()


def find(docs: DataFrame, indexes: Iterable[Index], percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, shared, total, start_word, n_words``: a row for each document and item whose passage it holds.

    The similarity of window and item is ``shared / total``: over ``width``-word shingles weighted by their
    counts, the sum of the lesser weights by that of the greater; it is ``percent`` at least. The best window is
    given, the first of equals. At that similarity about 1 - cos of 0.89 of 128 bits differ, 19.4 with a deviation
    of 4.1, so a radius of 44 misses one in a thousand million.

    Null or blank text: no match. Null and repeated ids: rows of their own. Fewer words than a shingle: one
    shingle of them all. Very long texts are read whole. No rows or no items: none. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, shared long, total long, start_word long, n_words long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))

    def matched(sent: Broadcast) -> DataFrame:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows = []
                for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                    found = matches(index, raw, percent)
                    rows += [(doc, int(index.ids[i]), *found[i]) for i in sorted(found)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "shared", "total", "start_word", "n_words"])

        return texts.mapInArrow(look, schema)

    out = None
    for part in _sent(spark, indexes, matched, "matches"):
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, indexes: Iterable[Index], percent: int = 80, text_col: str = "text") -> DataFrame:
    """The rows, as they are, whose text holds no item."""
    out = docs

    def freed(sent: Broadcast) -> DataFrame:
        def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not matches(sent.value, (t or "").encode("utf-8", "replace"), percent) for t in texts], pa.bool_()))

        return out.mapInArrow(free, docs.schema)

    for out in _sent(docs.sparkSession, indexes, freed, "clean"):
        pass
    return out
