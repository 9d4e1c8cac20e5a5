"""Near-duplicates by b-bit MinHash: banded candidates, bit-count estimates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, stored, text_bytes
from .graph import components
from .shingles import WordHashes, mixed, overlap, shingle_set

BITS = 4  # kept of each minimum
_FIELDS = 16  # fields of BITS bits in a long
_BLOCK = 1 << 15  # shingles that are hashed together, so that they stay in the processor's cache


def _word_hashes() -> WordHashes:
    return held("word hashes", WordHashes)


class Signer:
    """Minima of ``bands * rows`` hash functions, as band keys and as packed low bits."""

    def __init__(self, bands: int, rows: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.flips = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.longs = -(-bands * rows // _FIELDS)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of minima for each set; the sets are not empty."""
        out = np.empty((len(sets), len(self.factors)), np.uint32)
        at = 0
        while at < len(sets):
            end, total = at, 0
            while end < len(sets) and (end == at or total + len(sets[end]) <= _BLOCK):
                total += len(sets[end])
                end += 1
            x = (mixed(np.concatenate(sets[at:end])) >> np.uint64(32)).astype(np.uint32)
            sizes = [len(s) for s in sets[at:end]]
            first = np.cumsum([0, *sizes[:-1]])
            held = np.empty_like(x)
            for k, (flip, factor) in enumerate(zip(self.flips, self.factors, strict=True)):
                np.bitwise_xor(x, flip, out=held)
                np.multiply(held, factor, out=held)
                out[at:end, k] = np.minimum.reduceat(held, first)
            at = end
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        parts = minima.reshape(-1, self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2])
        for k in range(self.rows):
            key = mixed(key * np.uint64(0x100000001B3) + parts[:, :, k])
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of each minimum, ``_FIELDS`` in a long. Minima are scrambled first: low bits of a product depend on few bits."""
        low = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64)
        wide = np.zeros((len(minima), self.longs * _FIELDS), np.uint64)
        wide[:, : low.shape[1]] = low
        shifts = np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS)
        return np.bitwise_or.reduce(wide.reshape(len(minima), self.longs, _FIELDS) << shifts, axis=2).view(np.int64)


def estimate(a: list[Column], b: list[Column], fields: int) -> Column:
    """Similarity by bit counts: the share of equal fields, less what is equal by chance."""
    differ = []
    for x, y in zip(a, b, strict=True):
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        differ.append(F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))))
    chance = 1.0 / (1 << BITS)
    return (1.0 - sum(differ[1:], differ[0]) / fields - chance) / (1.0 - chance)


def _signed(docs: DataFrame, width: int, signer: Signer) -> DataFrame:
    longs = [f"s{k}" for k in range(signer.longs)]
    schema = "doc_id long, n long, fp_a long, fp_b long, keys array<long>, " + ", ".join(f"{s} long" for s in longs)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingle_set(raw, width, hashes) for raw in part.column("raw").to_pylist()]
                n = len(sets)
                prints = np.zeros((n, 2), np.uint64)
                for i, s in enumerate(sets):
                    prints[i] = s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                keys, packed = np.zeros((n, signer.bands), np.int64), np.zeros((n, signer.longs), np.int64)
                distinct: dict[tuple, int] = {}
                copy_of = [distinct.setdefault((a, b, len(s)), i) for i, ((a, b), s) in enumerate(zip(prints.tolist(), sets, strict=True))]
                own = [i for i, c in enumerate(copy_of) if c == i and len(sets[i])]
                if own:
                    minima = signer.minima([sets[i] for i in own])
                    keys[own], packed[own] = signer.keys(minima), signer.packed(minima)
                keys, packed = keys[copy_of], packed[copy_of]
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * signer.bands)
                prints = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                     pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), *(pa.array(packed[:, j]) for j in range(signer.longs))],
                    names=["doc_id", "n", "fp_a", "fp_b", "keys", *longs],
                )

    return docs.mapInArrow(sign, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are as similar as asked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, set_a = _word_hashes(), None, None
        for batch in batches:
            kept = []
            for raw_a, raw_b in zip(batch.column("raw_a").to_pylist(), batch.column("raw_b").to_pylist(), strict=True):
                if raw_a != last:
                    last, set_a = raw_a, shingle_set(raw_a, width, hashes)
                set_b = shingle_set(raw_b, width, hashes)
                both = overlap(set_a, set_b)
                kept.append(100 * both >= percent * (len(set_a) + len(set_b) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("raw").alias("raw_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("raw").alias("raw_a")), "a")
    return both.select("a", "b", "raw_a", "raw_b").mapInArrow(confirm, "a long, b long")


def _sets(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``rep, shingles`` of the texts with these ids."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _word_hashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingle_set(raw, width, hashes).view(np.int64) for raw in part.column("raw").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["rep", "shingles"])

    return texts.join(ids, texts["doc_id"] == ids["rep"], "left_semi").mapInArrow(build, "rep long, shingles array<long>")


def _tiled(rows: DataFrame, place: list[str], blocks: DataFrame) -> DataFrame:
    """Each row once for every tile that its block has at its place: two blocks ``lo, hi``, and the row's ``side``: 0 and 1
    are compared with each other, 2 is one block with itself. ``blocks``: how many a place has."""
    rows = rows.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    rows = rows.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other"), "side": side})
    return rows.drop("blocks", "block", "other")


class _Crowd:
    """Texts of a tile, compared with each other."""

    def __init__(self, percent: int, slack: float, fields: int):
        self.percent, self.slack, self.fields = percent, slack, fields

    def likely(self, a: dict, b: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Strips of the table of pairs, each with its first row: which are of different components, and allowed a link by
        their sizes and bit counts."""
        step = max(1, (1 << 20) // max(1, b["v"].size))
        chance = 1.0 / (1 << BITS)
        for k in range(0, len(a["rep"]), step):
            z = a["v"][k : k + step, None, :] ^ b["v"][None, :, :]
            z |= z >> np.uint64(1)
            z |= z >> np.uint64(2)
            differ = np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int64)
            near = (1.0 - differ / self.fields - chance) / (1.0 - chance) >= self.percent / 100 - self.slack
            n, m = a["n"][k : k + step, None], b["n"][None, :]
            near &= (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent) & (a["comp"][k : k + step, None] != b["comp"][None, :])
            yield k, near

    @staticmethod
    def sides(rows: dict) -> tuple[dict, dict]:
        """The texts that are compared with each other; of a block with itself, its texts twice."""
        def part(of: np.ndarray) -> dict:
            return {k: [v[x] for x in np.flatnonzero(of)] if k == "sets" else v[of] for k, v in rows.items()}

        return part(rows["side"] != 1), part(rows["side"] != 0)

    def partners(self, rows: dict) -> np.ndarray:
        """The texts of a tile with another one there that they may be linked with."""
        a, b = self.sides(rows)
        if not len(a["rep"]) or not len(b["rep"]):
            return np.zeros(0, np.int64)
        on_a, on_b = np.zeros(len(a["rep"]), bool), np.zeros(len(b["rep"]), bool)
        for k, near in self.likely(a, b):
            on_a[k : k + len(near)] = near.any(axis=1)
            on_b |= near.any(axis=0)
        return np.unique(np.concatenate([a["rep"][on_a], b["rep"][on_b]]))

    @staticmethod
    def shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The sizes of the intersections of sets ``a[i]`` and ``b[j]``."""
        if len(i) < 2000:
            return np.array([overlap(a[x], b[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        # shingles that both sides have, as the columns of two tables of zeros and ones
        both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
        total = np.zeros((len(a), len(b)), np.float32)

        def table(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
            out = np.zeros((len(sets), len(columns)), np.float32)
            for row, s in zip(out, sets, strict=True):
                s = s[np.searchsorted(s, columns[0]) : np.searchsorted(s, columns[-1], "right")]
                at = np.searchsorted(columns, s)
                row[at[columns[at] == s]] = 1
            return out

        for k in range(0, len(both), 8192):
            some = both[k : k + 8192]
            total += table(a, some) @ table(b, some).T
        return total[i, j].astype(np.int64)

    def links(self, rows: dict, place: int, whole: bool) -> list[tuple[int, int]]:
        """Linked pairs that join the components of the tile's texts, as few as do."""
        a, b = self.sides(rows)
        if not len(a["rep"]) or not len(b["rep"]):
            return []
        found = [(k, *np.nonzero(near)) for k, near in self.likely(a, b)]
        i, j = np.concatenate([i + k for k, i, _ in found]), np.concatenate([j for _, _, j in found])
        if (rows["side"] == 2).all():
            i, j = i[i < j], j[i < j]
        if not whole and len(i):  # a pair of several shared buckets counts in the first
            equal = a["keys"][i] == b["keys"][j]
            first = equal.argmax(axis=1)
            mine = equal.any(axis=1) & (a["keys"][i, first] == place)
            i, j = i[mine], j[mine]
        if not len(i):
            return []
        both = self.shared(a["sets"], b["sets"], i, j)
        hit = 100 * both >= self.percent * (a["n"][i] + b["n"][j] - both)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        out = []
        for x, y in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
            p, q = top(int(a["comp"][x])), top(int(b["comp"][y]))
            if p != q:
                up[p] = q
                out.append((int(a["rep"][x]), int(b["rep"][y])))
        return out


def _over_tiles(rows: DataFrame, place: list[str], longs: list[str], more: list[str], work, schema: str) -> DataFrame:
    """``work(place, rows)`` for each tile of ``rows``; its results are the columns of ``schema``."""
    tile = [*place, "lo", "hi"]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, []

        def settled() -> Iterator[pa.RecordBatch]:
            if sum(len(p["rep"]) for p in now) > 1:
                found = work(at, {k: [s for p in now for s in p[k]] if k == "sets" else np.concatenate([p[k] for p in now]) for k in now[0]})
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

        for batch in batches:
            told = list(zip(*(batch.column(c).to_pylist() for c in tile), strict=True))
            cuts = [k for k in range(len(told)) if k == 0 or told[k] != told[k - 1]] + [len(told)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if told[x] != at:
                    yield from settled()
                    at, now = told[x], []
                part = batch.slice(x, y - x)
                own = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "comp", "n", "side")}
                own["v"] = np.stack([part.column(c).to_numpy() for c in longs], axis=1).view(np.uint64)
                if more:
                    own["keys"] = np.stack([np.asarray(k) for k in part.column("keys").to_numpy(zero_copy_only=False)])
                    own["sets"] = [np.array(k, np.int64).view(np.uint64) for k in part.column("shingles").to_numpy(zero_copy_only=False)]
                now.append(own)
        yield from settled()

    dealt = rows.repartition(*[F.col(c) for c in tile]).sortWithinPartitions(*tile)
    return dealt.select(*tile, "side", "rep", "comp", "n", *longs, *more).mapInArrow(run, schema)


def more_links(open_: DataFrame, texts: DataFrame, longs: list[str], width: int, percent: int, slack: float, fields: int, bits_block: int = 2048, sets_block: int = 512) -> DataFrame:
    """Links ``a, b`` between texts of different components that share an open bucket; no such link is left out.

    Each text is one row of ``open_`` with its buckets. Those are cut into blocks, and bit counts of every two blocks, a
    task's work however large the bucket, tell which texts have a partner to test there. Only their sets are built. Texts
    that partners hold together are a crowd, and meet either as a crowd or in the buckets with partners, whichever sends
    their sets fewer times. These places are cut into blocks again, smaller ones where texts are long, and every two
    blocks are compared: bit counts first, then full sets. A tile gives the few links that join its components.
    """
    spread = open_.select("rep", "comp", "n", *longs, F.explode("open").alias("key"))
    blocks = spread.groupBy("key").agg(F.ceil(F.count("*") / bits_block).alias("blocks"))
    crowd = _Crowd(percent, slack, fields)

    def partners(place: tuple, rows: dict) -> list:
        reps = crowd.partners(rows)
        return [reps, np.full(len(reps), place[0])]

    partnered = stored(_over_tiles(_tiled(spread, ["key"], blocks), ["key"], longs, [], partners, "rep long, key long").distinct(), "partnered")

    least = partnered.groupBy("key").agg(F.min("rep").alias("b"), F.count("*").alias("m"))
    crowds = components(partnered.join(least, "key").select(F.col("rep").alias("a"), "b")).withColumnRenamed("component", "crowd")
    crowds = stored(crowds, "crowds")
    sent = lambda m: m * F.ceil(m / sets_block)
    by_keys = least.join(crowds, least["b"] == crowds["node"]).groupBy("crowd").agg(F.sum(sent(F.col("m"))).alias("by_keys"))
    by_crowd = crowds.groupBy("crowd").agg(sent(F.count("*")).alias("by_crowd"))
    whole = by_keys.join(by_crowd, "crowd").select("crowd", (F.col("by_crowd") <= F.col("by_keys")).alias("whole"))
    spots = partnered.groupBy("rep").agg(F.collect_set("key").alias("spots"))
    places = crowds.withColumnRenamed("node", "rep").join(whole, "crowd").join(spots, "rep")
    places = stored(places.select("rep", "whole", F.when(F.col("whole"), F.array("crowd")).otherwise(F.col("spots")).alias("places")), "places")

    sets = _sets(texts, places.select("rep"), width)
    rows = open_.drop("open").join(places, "rep").join(sets, "rep").withColumn("place", F.explode("places")).drop("places")
    size = places.join(open_.select("rep", "n"), "rep").select(F.explode("places").alias("place"), "whole", "n").groupBy("place", "whole")
    # blocks of so many texts, or of about a million shingles
    size = size.agg(F.ceil(F.greatest(F.count("*") / sets_block, F.sum("n") / (1 << 20))).alias("blocks"))

    def linked(place: tuple, rows: dict) -> list:
        found = crowd.links(rows, *place[:2])
        return [[x[k] for x in found] for k in (0, 1)]

    return stored(_over_tiles(_tiled(rows, ["place", "whole"], size), ["place", "whole"], longs, ["keys", "shingles"], linked, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 52, rows: int = 6, slack: float = 0.11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Two documents are linked when ``100 * shared >= percent * union`` over their sets of ``width``-word
    shingles. ``component_id`` is the smallest id that links reach, ``kept`` marks the rows that bear it.

    1. One pass makes each text's set, its fingerprint, MinHash minima, a key for each band of ``rows``
       minima and 4 low bits of every minimum. Rows of equal sets become one class.
    2. The smallest id of a band's bucket is its hub. Every document is paired with the smallest of its
       hubs, then with those hubs that are not yet in its component: a few pairs for each document. Bit
       counts, corrected for chance, drop pairs that are more than ``slack`` (4.6 standard errors) below
       the threshold, and full sets confirm the rest.
    3. Where a bucket still holds several components of those links, members of different components are
       compared too, if sizes and bit counts allow (``more_links``), in tiles of two blocks of a bucket. Pairs
       inside a component can't change the answer, so large groups of copies never meet pair by pair; none is
       skipped otherwise.

    A pair at the threshold misses all bands with a chance of (1 - 0.8**6)**52, 1 in 7 million, and a
    more similar pair less.

    Null or blank text: an empty set, linked with nothing. Null ids: linked with nothing, ``component_id``
    null, kept. Repeated ids: one node, a row each. Fewer words than ``width``: one shingle of them all.
    No rows: none. Other columns are not read.
    """
    signer, fields = Signer(bands, rows), bands * rows
    longs = [f"s{k}" for k in range(signer.longs)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    signed = stored(_signed(texts, width, signer), "signed")
    classes = signed.filter("doc_id is not null and n > 0").groupBy("fp_a", "fp_b", "n")
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("keys", *longs), "doc_id").alias("v")).select("fp_a", "fp_b", "n", "rep", "v.*"), "classes")

    member = classes.select(F.posexplode("keys").alias("band", "key"), "rep")
    hubs = member.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).filter("hub < most").select("key", "hub")
    members = stored(member.join(hubs, "key"), "members")
    # only texts that share a bucket are compared: whole texts are shuffled once
    chosen = members.select("rep").distinct()
    texts = stored(texts.join(chosen, texts["doc_id"] == chosen["rep"], "left_semi"), "texts")

    sides = classes.select("rep", F.struct("n", *longs).alias("v"))
    x, y = sides.select(F.col("rep").alias("a"), F.col("v").alias("x")), sides.select(F.col("rep").alias("b"), F.col("v").alias("y"))
    near = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    near &= estimate([F.col(f"x.{c}") for c in longs], [F.col(f"y.{c}") for c in longs], fields) >= percent / 100 - slack

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = pairs.join(x, "a").join(y, "b").filter(near).select("a", "b")
        return stored(_confirmed(likely, texts, width, percent).distinct(), "links")

    def placed(links: DataFrame) -> DataFrame:
        now = components(links)
        return stored(now, "components")

    def component(of: str, name: str) -> DataFrame:
        return first.select(F.col("node").alias(of), F.col("component").alias(name))

    hub = members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    found = confirmed(hub.groupBy("b").agg(F.min("a").alias("a")))
    first = placed(found)
    apart = hub.distinct().join(component("a", "ca"), "a", "left").join(component("b", "cb"), "b", "left")
    found = found.union(confirmed(apart.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")))
    first = placed(found)

    now = members.join(component("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    mixed_up = now.join(several, "key").filter("rep <> hub")
    # a row for each text, with the buckets that are still open
    opened = mixed_up.groupBy("rep").agg(F.first("comp").alias("comp"), F.collect_set("key").alias("open"))
    open_ = stored(opened.join(classes.select("rep", "n", "keys", *longs), "rep"), "open")
    if not open_.isEmpty():
        found = found.union(more_links(open_, texts, longs, width, percent, slack, fields))
    linked = placed(found)

    own = classes.select("fp_a", "fp_b", "n", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    # a repeated id with two texts is one node, so it may be in a component below its class's smallest id
    out = signed.select("doc_id", "n", "fp_a", "fp_b").join(own.select("fp_a", "fp_b", "n", F.coalesce("component", "rep").alias("c")), ["fp_a", "fp_b", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
