"""Byte-fallback BPE ids of whole texts by a prefix table, as a sentencepiece model gives them, and back to text.

A *pair* of pieces is compatible if merging their joint text gives just these two. Merges go by score, then from the
left, so what happens on either side of a boundary that no merge crosses is the same as without the other side. Hence
a row of pieces is the model's own for a text exactly if each of its neighbours are compatible, and each prefix of a
text has exactly one last piece. An automaton finds the pieces that end at a place; the one that is compatible with
the last piece of the prefix before it goes into the table, and the ids are read from the table backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, text_bytes

SPACE = "▁"  # fixed value: the sign that sentencepiece writes for a space
_DONE = float("-inf")
_NONE = -1  # the last piece is a character that no piece holds: it never merges


class PieceTable:
    """The pieces of a BPE model with byte fallback, and what it takes to encode by them.

    ``longest`` is the length up to which stretches are remembered, ``limit`` how many of them, and of pairs.
    """

    def __init__(self, path: str, longest: int = 48, limit: int = 400_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        kinds = spec.SentencePiece.Type
        odd = {kinds.Value("USER_DEFINED"), kinds.Value("UNUSED")}
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback or any(p.type in odd for p in spec.pieces):
            raise ValueError("a BPE model with byte fallback and plain pieces alone is needed")
        self.scores = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type == kinds.Value("NORMAL")}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.Value("BYTE")}
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        # where no piece holds a space after another sign, stretches from one run of spaces to the next are apart
        apart = all(SPACE not in p.lstrip(SPACE) for p in self.scores)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall if apart else None
        rules = spec.normalizer_spec
        self.plain = rules.name == "identity" and not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        self.longest, self.limit = longest, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # characters that are no piece themselves but part of one can merge, so they are in the table too
        self.names = [p for p in self.scores if self.steps(p)[1] == [p]]
        self.names += sorted({c for p in self.scores for c in p} - self.scores.keys())
        self.history = [[*self.steps(p)[0], (_DONE, p, p)] for p in self.names]
        self.out = [np.array([self.scores[p][0]] if p in self.scores else self._fallback(p), "<u4").tobytes() for p in self.names]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.names]
        self.tested = 0
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.names):
            self.automaton.add_word(p, (k, len(p) - 1))
        self.automaton.make_automaton()

    def _fallback(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode()]

    def steps(self, text: str) -> tuple[list[tuple[float, str, str]], list[str]]:
        """Merging a short text: the best pair, from the left among equals, until none is left.

        Gives the merges in order, each with its score and the first and last part before it, and the parts at the end.
        """
        parts, done = list(text), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                break
            done.append((best, parts[0], parts[-1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return done, parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces gives the two: their own merges are gone through in the order they would
        be made in, and no merge over the boundary may come first. Among equals the left one does."""
        out = self.pairs[a].get(b)
        if out is None:
            self.tested += 1
            if self.tested > self.limit:
                self.pairs, self.tested = [{} for _ in self.names], 0
            out = self.pairs[a][b] = self._apart(self.history[a], self.history[b])
        return out

    def _apart(self, left: list[tuple[float, str, str]], right: list[tuple[float, str, str]]) -> bool:
        i = j = 0
        while True:
            (own, _, last), (other, first, _) = left[i], right[j]
            across = self.scores.get(last + first)
            if across is not None and across[1] > own and across[1] >= other:
                return False
            if own == other == _DONE:
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> list[int]:
        """For each prefix of ``text``, from the empty one on, the number of its last piece."""
        last = [_NONE] * (len(text) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (piece, back) in self.automaton.iter(text):
            if last[end + 1] == _NONE:
                before = last[end - back]
                # a start that no piece ends at is the text's own, or follows a character that no piece holds
                if before == _NONE:
                    last[end + 1] = piece
                else:
                    fits = pairs[before].get(piece)
                    if fits or (fits is None and compatible(before, piece)):
                        last[end + 1] = piece
        return last

    def stretch(self, text: str) -> bytes:
        """The ids of a stretch, little-endian unsigned 32-bit integers."""
        last, at, out = self.table(text), len(text), []
        while at:
            piece = last[at]
            if piece == _NONE:
                out.append(np.array(self._fallback(text[at - 1]), "<u4").tobytes())
                at -= 1
            else:
                out.append(self.out[piece])
                at -= len(self.names[piece])
        return b"".join(out[::-1])

    def _learn(self, part: str, first: str) -> bytes:
        ids = self.known.get(part) or self.older.get(part) if first else None
        if ids is None:
            ids = self.stretch(first + part)
        if first and len(part) <= self.longest:
            self.known[part] = ids
        return ids

    def ids(self, raw: bytes, begin: bool = True, end: bool = True) -> bytes:
        """The ids of a UTF-8 text; a stretch met before is looked up."""
        text = raw.decode("utf-8", "replace")
        text = (text and SPACE + text.replace(" ", SPACE)) if self.plain else self.library.normalize(text)
        # stretches are remembered without their first space
        parts = text[1:].split(SPACE) if self.cut and text[:1] == SPACE else [""]
        if "" in parts:
            parts = [p[1:] if p[0] == SPACE else p for p in self.cut(text)] if self.cut else [text]
        known = self.known
        out = list(map(known.get, parts))
        first = SPACE if text[:1] == SPACE and self.cut else ""
        if parts and not first:
            out[0] = None
        if None in out:
            if len(known) > self.limit:
                self.older, self.known = known, {}
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = self._learn(parts[k], SPACE if k else first)
        ends = [np.array([i], "<u4").tobytes() for i in (self.begin, self.end)]
        return b"".join([ends[0] * begin, *out, ends[1] * end])


def piece_table(path: str) -> PieceTable:
    """One table for each worker process, however many tasks it runs."""
    return held(f"pieces {path}", lambda: PieceTable(path))


def encode(docs: DataFrame, model: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text: little-endian unsigned 32-bit integers, as the sentencepiece library encodes it.

    The text is normalised by the model and cut before each run of spaces if no piece reaches over such a place; the ids
    of each stretch come from its prefix table. ``begin`` and ``end`` add the model's ids for both.

    Null or empty text: those two ids alone. Null and repeated ids: a row each. A very long text, or a long stretch without
    spaces, takes time and memory in proportion. No rows: none. Other columns are not read. No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [table.ids(raw, begin, end) for raw in part.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of :func:`encode` with ``text``, what the library's decoder makes of ``ids``. Null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [None if ids is None else library.decode(np.frombuffer(ids, "<u4").tolist()) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
