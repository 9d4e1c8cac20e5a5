"""Which sources of a language use its terms otherwise than the language, by factorization into whitespace chunks.

Rows between the steps are packed: one row holds what a block of documents has for one hash part of all chunks or terms,
as byte strings, so the work for each chunk is done on arrays in the tasks.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored, text_bytes

#: A term: a run of ASCII letters and of signs beyond ASCII. White space below 0x80 never stands in one.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
_DOC = 16  # bits of a posting that name the document in its block; the rest holds a count
_MOST = (1 << 32 - _DOC) - 1
_JOIN = b"\x01"  # between the terms of a chunk; chunks of a part have a space between them, terms have neither in them


class _Codes(dict):
    """A number for each chunk or term, in order of appearance."""

    def __missing__(self, name: bytes) -> int:
        out = self[name] = len(self)
        return out


def _parts_of(names: list[bytes], parts: int) -> np.ndarray:
    return (np.fromiter(map(zlib.crc32, names), np.uint32, len(names)) % np.uint32(parts)).astype(np.int64)


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches of these starts and sizes, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _counted(docs: DataFrame, parts: int, words: int) -> DataFrame:
    """``block, part, chunks, sizes, posts``: the chunks of a block of documents in a hash part, and for each which of the
    documents hold it, how often. Part -1 lists the (language, source) of the block's documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = itertools.count(TaskContext.get().partitionId() << 32)
        codes, held, groups, total = _Codes(), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            listed = _Codes()
            of_doc = [listed[g] for g in groups]
            block, said = next(blocks), json.dumps([json.loads(g) for g in listed]).encode()
            rows = [(block, -1, said, np.array(of_doc, "<u2").tobytes(), b"")]
            if total:
                chunks = list(codes)
                part = _parts_of(chunks, parts)
                order = np.argsort(part, kind="stable")
                place = np.empty(len(chunks), np.uint64)
                place[order] = np.arange(len(chunks), dtype=np.uint64)
                doc = np.repeat(np.arange(len(held), dtype=np.uint64), [len(h) for h in held])
                both, times = np.unique(place[np.concatenate(held)] << np.uint64(_DOC) | doc, return_counts=True)
                if (times > _MOST).any():  # a count that fills its bits goes on in further postings
                    again = -(-times // _MOST)
                    both, last = np.repeat(both, again), np.cumsum(again) - 1
                    rest, times = times - (again - 1) * _MOST, np.full(len(both), _MOST)
                    times[last] = rest
                posts = (times.astype(np.uint64) << np.uint64(_DOC) | both & np.uint64((1 << _DOC) - 1)).astype("<u4")
                ends = np.searchsorted(both >> np.uint64(_DOC), np.arange(len(chunks) + 1, dtype=np.uint64))
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    x, y = int(cuts[k]), int(cuts[k + 1])
                    rows.append((block, k, b" ".join([chunks[i] for i in order[x:y].tolist()]), np.diff(ends[x : y + 1]).astype("<u4").tobytes(), posts[ends[x] : ends[y]].tobytes()))
            for k in range(0, len(rows), 64):
                columns = zip(*rows[k : k + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "chunks", "sizes", "posts"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                for raw, lang, source in zip(*(some.column(c).to_pylist() for c in ("raw", "lang", "source")), strict=True):
                    chunks = raw.lower().split()  # of bytes: A-Z alone, and at the six ASCII blanks
                    held.append(np.fromiter(map(codes.__getitem__, chunks), np.int64, len(chunks)))
                    groups.append(json.dumps([lang, source]))
                    total += len(chunks)
                    if total >= words or len(held) == 1 << _DOC:
                        yield from flush()
                        codes, held, groups, total = _Codes(), [], [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(count, "block long, part int, chunks binary, sizes binary, posts binary")


def _termed(counted: DataFrame) -> DataFrame:
    """``block, part, terms``: the terms of each row's chunks. A task holds the chunks of a part, each cut once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            terms = []
            for part, chunks in zip(batch.column("part").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                if part != now:
                    now, known = part, {}
                listed = chunks.split(b" ")
                for chunk in set(listed).difference(known):
                    known[chunk] = _JOIN.join(TERM.findall(chunk))
                terms.append(b" ".join(map(known.__getitem__, listed)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(terms, pa.binary())], names=["block", "part", "terms"])

    rows = counted.filter("part >= 0").select("block", "part", "chunks")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(cut, "block long, part int, terms binary")


class _Block:
    """A block of documents, put together again from its parts."""

    def __init__(self, said: list[list[str]], of_doc: bytes):
        self.said, self.of_doc = said, np.frombuffer(of_doc, "<u2").astype(np.uint64)
        self.codes, self.keys, self.times = _Codes(), [], []

    def add(self, terms: bytes, sizes: bytes, posts: bytes) -> None:
        listed = terms.replace(_JOIN, b" " + _JOIN).split(b" ")
        more = np.fromiter((t[:1] == _JOIN for t in listed), bool, len(listed))
        full = np.fromiter(map(len, listed), np.int64, len(listed)) > 0
        chunk = np.cumsum(~more) - 1
        code = np.fromiter((self.codes[t.lstrip(_JOIN)] for t in listed if t), np.uint64, int(full.sum()))
        size = np.frombuffer(sizes, "<u4").astype(np.int64)
        start, chunk = np.cumsum(size) - size, chunk[full]
        post = np.frombuffer(posts, "<u4")[_gathered(start[chunk], size[chunk])].astype(np.uint64)
        self.keys.append(np.repeat(code, size[chunk]) << np.uint64(_DOC) | post & np.uint64((1 << _DOC) - 1))
        self.times.append((post >> np.uint64(_DOC)).astype(np.int64))

    def rows(self, parts: int) -> Iterator[tuple]:
        """``lang, part, sources, terms, sizes, entries``: for each term, its sources with documents and occurrences."""
        if not self.codes:
            return
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, times = key[first], np.add.reduceat(times, first)
        # the document's group in place of the document: now by term and group
        key = (key >> np.uint64(_DOC)) << np.uint64(_DOC) | self.of_doc[(key & np.uint64((1 << _DOC) - 1)).astype(np.int64)]
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        docs, occ, key = np.diff(np.append(first, len(key))), np.add.reduceat(times, first), key[first]
        names = list(self.codes)
        langs = sorted({lang for lang, _ in self.said})
        lang_of = np.array([langs.index(lang) for lang, _ in self.said])
        term, group = (key >> np.uint64(_DOC)).astype(np.int64), (key & np.uint64((1 << _DOC) - 1)).astype(np.int64)
        lang, part = lang_of[group], _parts_of(names, parts)[term]
        order = np.lexsort((group, term, part, lang))
        term, group, lang, part, docs, occ = (x[order] for x in (term, group, lang, part, docs, occ))
        cuts = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (part[1:] != part[:-1]), [True]]))
        for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            own = np.flatnonzero(np.concatenate([[True], term[x + 1 : y] != term[x : y - 1]]))
            entries = np.stack([group[x:y].astype("<u8"), docs[x:y].astype("<u8"), occ[x:y].astype("<u8")])
            yield (langs[lang[x]], int(part[x]), json.dumps([source for _, source in self.said]), b" ".join([names[t] for t in term[x:y][own].tolist()]),
                   np.diff(np.append(own, y - x)).astype("<u4").tobytes(), entries.tobytes())


_PACKED = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("sources", pa.string()), ("terms", pa.binary()), ("sizes", pa.binary()), ("entries", pa.binary())])


def _by_block(counted: DataFrame, termed: DataFrame, parts: int) -> DataFrame:
    """The terms of each block by language and hash part, from its postings and the terms of its chunks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, posts = None, None, None

        def told() -> Iterator[pa.RecordBatch]:
            rows = list(block.rows(parts)) if block else []
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 64], strict=True), _PACKED, strict=True)], schema=_PACKED)

        for batch in batches:
            for k in range(batch.num_rows):
                number, part, chunks, sizes, own, terms = (batch.column(c)[k].as_py() for c in ("block", "part", "chunks", "sizes", "posts", "terms"))
                if number != now:
                    yield from told()
                    now, block = number, None
                if part < 0:
                    block = _Block(json.loads(chunks), sizes)
                elif terms is None:
                    posts = sizes, own
                else:
                    block.add(terms, *posts)
        yield from told()

    empty = F.lit(None).cast("binary")
    chunks = F.when(F.col("part") < 0, F.col("chunks"))
    rows = counted.select("block", "part", chunks.alias("chunks"), "sizes", "posts", empty.alias("terms"))
    rows = rows.unionByName(termed.select("block", "part", empty.alias("chunks"), empty.alias("sizes"), empty.alias("posts"), "terms"))
    dealt = rows.repartition("block").sortWithinPartitions("block", "part", F.col("terms").isNotNull())
    return dealt.mapInArrow(merge, "lang string, part int, sources string, terms binary, sizes binary, entries binary")


def _kept_terms(packed: DataFrame, least: int) -> DataFrame:
    """``lang, term, occ, by``: terms of at least ``least`` documents of the language, with occurrences in all and by source.

    Entries of a part's blocks are summed as they come, and again whenever they have doubled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, terms, sources, held, size, bound = None, _Codes(), _Codes(), [], 0, 1 << 20

        def summed() -> np.ndarray:
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            first = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]))
            return np.concatenate([rows[:2, first], np.add.reduceat(rows[2:], first, axis=1)])

        def told() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = summed()
            first = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            docs, occ = np.add.reduceat(rows[2], first), np.add.reduceat(rows[3], first)
            enough = np.flatnonzero(docs >= least)
            sizes = np.diff(np.append(first, rows.shape[1]))[enough]
            names, listed = list(terms), list(sources)
            own = rows[:, _gathered(first[enough], sizes)] if len(enough) else rows[:, :0]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            source = pa.array(listed, pa.string()).take(pa.array(own[1]))
            by = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([source, pa.array(own[3])], ["source", "occ"]))
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(enough), pa.string()), pa.array([names[t].decode("utf-8", "replace") for t in rows[0, first[enough]].tolist()], pa.string()), pa.array(occ[enough]), by], names=["lang", "term", "occ", "by"])

        for batch in batches:
            for lang, part, said, listed, sizes, entries in zip(*(batch.column(f.name).to_pylist() for f in _PACKED), strict=True):
                if (lang, part) != at:
                    yield from told()
                    at, terms, sources, held, size, bound = (lang, part), _Codes(), _Codes(), [], 0, 1 << 20
                code = np.fromiter(map(terms.__getitem__, listed.split(b" ")), np.int64, len(sizes) // 4)
                own = np.frombuffer(entries, "<u8").astype(np.int64).reshape(3, -1)
                names = np.array([sources[s] for s in json.loads(said)], np.int64)
                held.append(np.stack([np.repeat(code, np.frombuffer(sizes, "<u4")), names[own[0]], own[1], own[2]]))
                size += own.shape[1]
                if size > bound:
                    held = [summed()]
                    size = held[0].shape[1]
                    bound = max(bound, 2 * size)
        yield from told()

    dealt = packed.repartition("lang", "part").sortWithinPartitions("lang", "part")
    return dealt.mapInArrow(add, "lang string, term string, occ long, by array<struct<source:string,occ:long>>")


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kinds))``, exact."""
    scaled = (count + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return F.lit(1) + F.call_function("div", scaled, (total + 2 * kinds).cast("decimal(20,0)")).cast("long")


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10, words: int = 3_000_000, parts: int | None = None, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from the others, and by which terms.

    1. Tasks count the chunks between white space of each document. A block of documents, of about ``words`` words, gives a
       row for each hash part: its chunks there, and for each who holds it, how often.
    2. The chunks of a part, from all blocks, come together and are cut into terms, each distinct one once. Only chunks
       travel, one for each block that has it, so a frequent one weighs no more than others.
    3. The terms join their block's postings, which are united, as several chunks of a document may hold a term: distinct
       documents and occurrences by source. Those are sums from here on, added up by language and hash part of the term.
    4. Each language keeps the terms of at least ``least`` documents. Every (language, source) and every language gives
       a kept term ``p = 1 + floor(10**9 * (count + 2) / (N + 2 V))``. Part ``pair`` sums ``f = floor((p-q)**2 / (p+q))``
       over all kept terms for each other source of the language; part ``term`` has the ``top`` terms with a count that
       the source uses more than its language, by f.

    A language's sources are one row of an array, as the result has a row for each two of them.

    Null text, language or source: empty. Texts without terms: their group still has its pairs (0 where nothing is kept).
    Repeated rows are documents of their own. Ties: items in UTF-8 order. No rows: none. Other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), text_bytes(text_col).alias("raw"))
    parts = parts or shuffle_width(docs.sparkSession)
    counted = stored(_counted(rows, parts, words), "chunks")
    kept = stored(_kept_terms(_by_block(counted, _termed(counted), parts), least), "terms")

    langs = kept.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("occ").alias("total"))
    totals = kept.select("lang", F.explode("by").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.occ").alias("own"))
    sides = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("own", F.lit(0)).alias("own")).alias("g"))
    # one row for each language: its sources in order
    sides = sides.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("gs")).join(langs, "lang", "left")
    sides = stored(sides.select("lang", "gs", F.coalesce("kinds", F.lit(0)).alias("kinds"), F.coalesce("total", F.lit(0)).alias("total")), "languages")

    found = F.map_from_entries("by")
    dense = kept.join(sides, "lang").withColumn("counts", F.transform("gs", lambda g: F.coalesce(F.try_element_at(found, g["source"]), F.lit(0))))
    dense = dense.withColumn("ps", F.zip_with("gs", "counts", lambda g, c: _share(c, g["own"], F.col("kinds")))).withColumn("q", _share(F.col("occ"), F.col("total"), F.col("kinds")))

    each = dense.select("lang", "ps", F.posexplode("ps").alias("i", "p"))
    each = each.select("lang", "i", "p", F.posexplode(F.slice("ps", F.col("i") + 2, F.size("ps"))).alias("k", "q"))
    sums = each.groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum(_distance(F.col("p"), F.col("q"))).alias("value"))
    # every two sources of a language, as the result has them
    pairs = sides.select("lang", "gs", F.posexplode("gs").alias("i", "a")).select("lang", "i", "a", F.posexplode("gs").alias("j", "b")).filter("i < j")
    pairs = pairs.select("lang", "i", "j", F.col("a.source").alias("a"), F.col("b.source").alias("b")).join(sums, ["lang", "i", "j"], "left")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", F.coalesce("value", F.lit(0)).alias("value"), both.alias("e")).select("lang", "e.source", "e.item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = dense.select("lang", "term", "q", F.explode(F.arrays_zip("gs", "counts", "ps")).alias("e")).filter("e.counts > 0 and e.ps > q")
    terms = used.select("lang", F.col("e.gs.source").alias("source"), F.col("term").alias("item"), _distance(F.col("e.ps"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return columns(pairs, "pair").union(columns(terms, "term"))


AUDIT_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), said AS (
    SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (
    SELECT lang, term, count(*) AS occ FROM said GROUP BY ALL HAVING count(DISTINCT d) >= 10
), sizes AS (
    SELECT lang, count(*) AS v, sum(occ) AS n FROM kept GROUP BY lang
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS c FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL
), own AS (
    SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
    SELECT o.lang, o.source, k.term, coalesce(c.c, 0) AS c,
           (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (o.n + 2 * s.v)::HUGEINT)::HUGEINT AS p,
           (1 + 1000000000::HUGEINT * (k.occ + 2) // (s.n + 2 * s.v)::HUGEINT)::HUGEINT AS q
    FROM own o JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN apart USING (lang, source, item)
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""
