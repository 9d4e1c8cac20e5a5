"""Words that are one edit apart, each with the commoner form it is likely meant to be, by dense prefix-suffix tiles."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_bytes

_RUN = re.compile("[a-zÀ-ÿ]+").findall  # in texts whose A-Z are in lower case
_CELLS = 1 << 21  # code points that are compared at a time
_TILE = 512  # words on a side of a tile of short words


def _spelled(rows: DataFrame, every: int, least_length: int) -> DataFrame:
    """``word, n``: occurrences in parts of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for i, raw in zip(part.column("doc_id").to_pylist(), part.column("raw").to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for run, n in Counter(_RUN(raw.lower().decode("utf-8", "replace"))).items():
                        if len(run) >= least_length:
                            h = zlib.crc32(run.encode(), start)
                            if h % every == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                                if len(run) < least_length:
                                    continue
                            total[run] += n
                if len(total) > 300_000:
                    yield told()
                    total.clear()
        if total:
            yield told()

    return rows.mapInArrow(count, "word string, n long")


def words(docs: DataFrame, every: int = 199, least_length: int = 6, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` for the words of at least ``least_length`` code points and ``least`` occurrences.

    Words are the runs of ASCII and Latin-1 letters (U+00C0 to U+00FF) with A-Z in lower case. Where ``every`` divides
    the unsigned crc32 ``h`` of ``<doc_id>:<run>``, the run's code point ``h % length`` is left out. Tasks count first,
    so a frequent word is one row for each task.

    Null text: no words. Null id: the empty string before the colon. Repeated rows: each counts. A run of any length is a
    word. No rows: none. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    return _spelled(rows, every, least_length).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _padded(some: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of Latin-1 words, one word a row, at the left and at the right end of rows of ``width + 1``."""
    flat = np.frombuffer(b"".join(some), np.uint8)
    sizes = np.fromiter(map(len, some), np.int64, len(some))
    row = np.repeat(np.arange(len(some)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left, right = np.zeros((len(some), width + 1), np.uint8), np.zeros((len(some), width + 1), np.uint8)
    left[row, column] = flat
    right[row, (sizes[row] - 1 - column)] = flat
    return left, right


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points rows of ``a`` and of ``b`` begin with in common; equal rows count to their width."""
    differ = a[..., :, None, :] != b[..., None, :, :]
    differ[..., -1] = True
    return differ.argmax(-1)


class _Tiles:
    """Near words of the tiles that follow each other in a partition: each as ``(word, n, n_near, best_n, best)``."""

    def __init__(self):
        self.out: list[tuple] = []

    def compare(self, rows: list[tuple[bytes, int, int]], length: int, suffix: bool) -> None:
        """``rows``: word, n and side (0 and 1: two blocks that are compared; 2: one block with itself)."""
        a = [r for r in rows if r[2] != 1]
        b = [r for r in rows if r[2] == 1] or a
        if a and b:
            self._add(a, b, *self.near([r[0] for r in a], [r[0] for r in b], length, suffix, a is b))

    @staticmethod
    def near(a: list[bytes], b: list[bytes], length: int, suffix: bool, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows one edit apart, the longer word of ``length`` code points. Pairs that share the first half are
        found by their prefix, others by their suffix."""
        la, ra = _padded(a, length)
        lb, rb = (la, ra) if same else _padded(b, length)
        size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        step, found = max(1, _CELLS // (len(b) * (length + 1))), []
        for k in range(0, len(a), step):
            head, tail = _common(la[k : k + step], lb), _common(ra[k : k + step], rb)
            longer = np.maximum(size_a[k : k + step, None], size_b[None, :])
            hit = (longer == length) & (head + tail >= length - 1) & (head < length)
            hit &= (head < length // 2) if suffix else (head >= length // 2)
            i, j = np.nonzero(hit)
            found.append((i + k, j))
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])

    def _add(self, a: list[tuple], b: list[tuple], i: np.ndarray, j: np.ndarray) -> None:
        """One row for each word with near ones; of a block with itself both directions are in ``i, j``."""
        for own, other, x, y in ((a, b, i, j),) if a is b else ((a, b, i, j), (b, a, j, i)):
            if not len(x):
                continue
            rank = np.empty(len(other), np.int64)
            order = sorted(range(len(other)), key=lambda k: (-other[k][1], other[k][0]))  # Latin-1 bytes are in code-point order
            rank[order] = np.arange(len(other))
            by = np.lexsort((rank[y], x))
            x, y = x[by], y[by]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            count = np.diff(np.append(first, len(x)))
            self.out += [(own[k][0], own[k][1], c, other[m][1], other[m][0]) for k, c, m in zip(x[first].tolist(), count.tolist(), y[first].tolist(), strict=True)]

    def batch(self) -> pa.RecordBatch:
        cut = [list(c) for c in zip(*self.out, strict=True)] or [[]] * 5
        self.out = []
        text = [pa.array([w.decode("latin-1") for w in c], pa.string()) for c in (cut[0], cut[4])]
        return pa.RecordBatch.from_arrays([text[0], *(pa.array(c, pa.int64()) for c in cut[1:4]), text[1]], names=["word", "n", "n_near", "best_n", "best"])


def neighbours(counted: DataFrame) -> DataFrame:
    """``word, n, n_near, best_n, best`` for the words of ``counted`` (``word, n``) that have near ones.

    Two words are near if they differ by one inserted, deleted or replaced code point; then the lengths of their common
    prefix and suffix add up to the longer one's length less one, at least. One of both is half of it or more, so near
    words meet in a bucket of the longer length and that prefix, or that suffix. Buckets are cut into blocks by a hash
    of the word, and every two blocks are a tile: two padded matrices of code points, compared with each other whole.
    A large bucket is many tiles, in tasks of their own; nothing is left out. A tile gives one row for each word.
    """
    half = lambda c: F.floor(c / 2).cast("int")
    sized = counted.select("word", "n", F.char_length("word").alias("size"))
    # as the longer word or one of the same length, and as the shorter
    sized = sized.withColumn("length", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    keys = F.array(F.struct(F.lit(False).alias("suffix"), F.left("word", half(F.col("length"))).alias("part")), F.struct(F.lit(True).alias("suffix"), F.right("word", half(F.col("length"))).alias("part")))
    keyed = sized.select("word", "n", "length", F.explode(keys).alias("e")).select("word", "n", "length", "e.suffix", "e.part")
    key = ["length", "suffix", "part"]
    # a bucket without a word of the full length has no pair of its own
    full = F.max(F.char_length("word") == F.col("length")).alias("full")
    buckets = keyed.groupBy(*key).agg(F.count("*").alias("m"), full).filter("m > 1 and full")
    side = F.greatest(F.lit(16), F.floor(F.lit(_TILE * 16) / F.col("length"))).cast("int")
    buckets = buckets.select(*key, F.ceil(F.col("m") / F.least(F.lit(_TILE), side)).cast("int").alias("blocks"))
    rows = keyed.join(buckets, key).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("word", "n", *key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                       F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    tile = [*key, "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, at, now = _Tiles(), None, []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in tile), strict=True))
            held = zip([w.encode("latin-1") for w in batch.column("word").to_pylist()], batch.column("n").to_pylist(), batch.column("side").to_pylist(), strict=True)
            for name, row in zip(names, held, strict=True):
                if name != at:
                    if len(now) > 1:
                        tiles.compare(now, at[0], at[1])
                    at, now = name, []
                now.append(row)
            if len(tiles.out) > 10_000:
                yield tiles.batch()
        if len(now) > 1:
            tiles.compare(now, at[0], at[1])
        yield tiles.batch()

    dealt = rows.repartition(*[F.col(c) for c in tile]).sortWithinPartitions(*tile)
    found = dealt.select("word", "n", "side", *tile).mapInArrow(compare, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best"))


def variants(counted: DataFrame, times: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``counted`` (``word, n``, words unique).

    ``form`` is the near word of largest ``n`` (ties: the smallest), if that is at least ``times`` the word's own, else
    null; ``root`` is where forms lead, the word itself without one. Each step makes n ``times`` larger, so chains are
    short; they are halved in rounds of joins, as many as the largest n allows.

    No rows: none. Words must be of code points below U+0100.
    """
    counted = stored(counted.select("word", "n"), "words")
    near = neighbours(counted).select("word", "n_near", "best_n", "best")
    fits = F.col("best_n") >= times * F.col("n")
    out = counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    out = stored(out.withColumn("root", F.col("form")), "forms")
    most = out.filter("form is not null").agg(F.max("form_n")).first()[0]
    steps = 0 if most is None else int(math.log(most, times)) + 1  # forms on the longest chain there can be
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = out.filter("root is not null").select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = stored(out.join(ahead, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next"), "forms")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
