"""Secrets in texts: three fixed patterns, and what a conditional random field trained on them adds."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import held, text_bytes

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_TABLE = bytes(120 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
#: The same patterns for the server side, to find texts to learn from.
_ANY = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8})|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
_WINDOW = 17


def _codes() -> crf.Codes:
    return held("token codes", crf.Codes)


def base_spans(raw: bytes, text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in code points, in order. ``raw`` is the text's UTF-8, to skip what can't match."""
    out = []
    if b"=" in raw or b":" in raw:
        low = raw.lower()
        if any(name in low for name in _NAMES):
            out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    if b"x" * 32 in raw.translate(_HEX_TABLE):
        out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def _windows(raw: bytes, most: int) -> list[tuple[list[int], list[int], int]]:
    """Training windows of a text, each with the class of the whole text: around tokens in values of base spans, around other odd tokens, and around every so many plain ones."""
    text = raw.decode("utf-8", "replace")
    codes = _codes().of(text)
    if not len(codes):
        return []
    labels = np.zeros(len(codes), np.int8)
    spans = base_spans(raw, text)
    if spans:
        tokens = list(crf.TOKEN.finditer(text))
        for _, _, end, value in spans:
            inside = [i for i, t in enumerate(tokens) if t.start() >= value and t.end() <= end + 2]
            inside = [i for i in inside if tokens[i].start() < end]
            for k, i in enumerate(inside):
                if labels[i] == crf.OUT:
                    labels[i] = crf.BEGIN if k == 0 else crf.INSIDE
    kinds = codes >> 3
    odd = (labels > 0) | ((codes & 7) > 0) | (kinds // 4 % 12 >= 9) | (kinds // 4 % 12 == 3)
    centres = np.concatenate([np.flatnonzero(labels)[:most], np.flatnonzero(odd & (labels == 0))[:most], np.arange(0, len(codes), max(1, len(codes) // 4))[:4]])
    pad, half = np.int32(crf.shape(".") * 8), _WINDOW // 2
    wide = np.concatenate([np.full(half, pad), codes, np.full(half, pad)])
    wide_labels = np.concatenate([np.zeros(half, np.int8), labels, np.zeros(half, np.int8)])
    kind = crf.file_class(codes)
    return [(wide[c : c + _WINDOW].tolist(), wide_labels[c : c + _WINDOW].tolist(), kind) for c in centres.tolist()]


def _variants(codes: np.ndarray, labels: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The window with its secrets in other spellings: hex of 12 and 20 characters, base64 of 14 without signs, of 24 and
    40, capitals and digits of 20, each with and without quotes; those of 20 and more also without any sign of an
    assignment around them, as in a file without one. Then with a word, a short one and a number in their place, and,
    without such signs, with a time, a name of a file, a path and a version: no secrets."""
    secret = hashlib.sha256(codes.tobytes()).digest()
    spelled = base64.b64encode(secret).decode()
    letters = "".join(c for c in spelled if c.isalnum())
    quoteless = np.where((codes & 7) == 3, codes & ~np.int32(7), codes)
    put = lambda around, token: np.where(labels > 0, np.int32(crf.shape(token) * 8 + crf.near(token)), around)
    for token in (secret.hex()[:12], letters[:14], secret.hex()[:20], spelled[:24], spelled[:40], base64.b32encode(secret).decode()[:20]):
        for around in (codes, quoteless):
            yield put(around, token), labels, kind
        if len(token) >= 20:
            yield put(codes & ~np.int32(7), token), labels, 0
    for word in ("changed", "on", "42"):
        yield put(quoteless, word), np.zeros_like(labels), kind
    for word in ("2024-01-15T12", "IMG_20240115_1200.jpg", "/usr/lib/python3/x1.py", "release-1.20.3-rc1", "20240115"):
        yield put(codes & ~np.int32(7), word), np.zeros_like(labels), 0


def _lowest(rows: DataFrame, order: tuple[Column, ...], found: Column, size: int, most: int) -> DataFrame:
    """The first ``most`` of the ``size`` rows that ``found`` holds for, ordered by a hash and what follows it."""
    share = 3 * most / max(size, 1)
    while share < 1:
        below = rows.filter(order[0] < F.lit(int((2 * share - 1) * 2**63))).filter(found)
        if below.select("doc_id").limit(most).count() == most:
            return below.orderBy(*order).limit(most)
        share *= 2
    return rows.filter(found).orderBy(*order).limit(most)


def fit(docs: DataFrame, sample: int = 300, per_text: int = 12, most_respelled: int = 150, id_col: str = "doc_id", text_col: str = "text") -> crf.Model:
    """Learn from a bounded sample: ``sample`` texts with a base span and as many of all, by the order of a
    hash of the id, and at most ``2 * per_text + 4`` windows of 17 tokens of each.

    Rows whose hash is below a threshold are ordered; counts set it so that about three times ``sample`` are, and it
    doubles until ``sample`` are found. So the sample is that of the whole order, but few texts travel.

    Tokens in the values of base spans count as secrets. Every second window with a secret is given once
    more without what its neighbours say, so that shape alone can also mark a secret, and the first
    ``most_respelled`` with their secrets in other spellings.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    order = F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [w for raw in batch.column("raw").to_pylist() for w in _windows(raw, per_text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int32())], names=["codes", "labels", "file"])

    marked = F.col("text").rlike(_ANY)
    sizes = texts.agg(F.count_if(marked).alias("marked"), F.count("*").alias("all")).first()
    codes, labels, files, respelled = [], [], [], 0
    for found, size in ((marked, sizes["marked"]), (F.lit(True), sizes["all"])):
        some = _lowest(texts, order, found, size, sample).select(text_bytes().alias("raw"))
        for k, row in enumerate(some.mapInArrow(windows, "codes array<int>, labels array<int>, file int").collect()):
            c, y = np.array(row.codes, np.int32), np.array(row.labels, np.int8)
            codes.append(c)
            labels.append(y)
            files.append(row.file)
            if k % 2 and (y > 0).any():
                codes.append(c & ~np.int32(7))
                labels.append(y)
                files.append(0)  # so it would be without any such sign in the file
            if (y > 0).any():
                respelled += 1
                for c, y, kind in _variants(c, y, row.file) if respelled <= most_respelled else ():
                    codes.append(c)
                    labels.append(y)
                    files.append(kind)
    return crf.train(codes, labels, files)


def crf_spans(model: crf.Model, text: str) -> list[tuple[int, int]]:
    """Spans of tokens the model marks: from a begin over what follows inside; inside after outside begins one too."""
    labels = model.decode(_codes().of(text))
    if not labels.any():
        return []
    out: list[tuple[int, int]] = []
    last = crf.OUT
    for token, label in zip(crf.TOKEN.finditer(text), labels.tolist(), strict=True):
        if label == crf.INSIDE and last != crf.OUT:
            out[-1] = (out[-1][0], token.end())
        elif label != crf.OUT:
            out.append((token.start(), token.end()))
        last = label
    return out


def all_spans(model: crf.Model, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end): base spans, and the model's that lie in none of them."""
    text = raw.decode("utf-8", "replace")
    base = [(a, kind, b) for a, kind, b, _ in base_spans(raw, text)]
    extra = [(a, 3, b) for a, b in crf_spans(model, text) if not any(x <= a and b <= y for x, _, y in base)]
    return sorted(base + extra)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, model: crf.Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans`` for each row.

    Spans are kind:start:end in code points of the whole text, ordered by start, then kind. Base spans
    (assign, access, hex) come from fixed patterns; crf spans are those the model adds. Without a model one is
    trained by ``fit``.

    Null or empty text: no span. Null and repeated ids: a row each. Equal texts give equal spans. Overlapping
    spans of different kinds all stay. No rows: none. Other columns are not read.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_spans(model, raw) for raw in batch.column("raw").to_pylist()]
            counts = [pa.array([sum(kind == k for _, kind, _ in r) for r in rows], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(_joined([s for s in r if s[1] < 3]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(list(map(_joined, rows)), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("raw"))
    return texts.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: crf.Model | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span (base or crf) in ``text_col`` replaced by ``mark``; spans that touch or overlap give one mark. Null texts stay null."""
    model = model or fit(docs, text_col=text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for text in batch.column(at).to_pylist():
                if text is not None:
                    pieces, end = [], 0
                    for a, _, b in all_spans(model, text.encode("utf-8", "replace")):
                        if a > end or not pieces:
                            pieces += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join([*pieces, text[end:]])
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(clean, docs.schema)
