"""Piece ids by prefix tables against the sentencepiece library."""
import hashlib
import random

import duckdb
import numpy as np
import pytest

from pricematch.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable(queries.PIECES)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_any_text_encodes_as_the_library_does(table):
    rng = random.Random(7)
    signs = [*"abehint THE▁ \x00\n\t日本😀éßﬁ..12/-<>", "  ", "   ", "the", " and", "<s>", "<0x41>", "word", "Ω", "́", "𐍈"]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert ids(table.ids(text.encode())) == [1, *table.library.encode(text), 2]
    long = "".join(rng.choice("abcdeti") for _ in range(30_000))
    assert ids(table.ids(long.encode(), begin=False, end=False)) == table.library.encode(long)


def test_each_prefix_has_the_last_piece_of_its_own_encoding(table):
    for text in ("▁internationalisation", "▁▁▁▁▁x", "▁日本語abc", "▁\x01tokenizers..."):
        last = table.table(text)
        for n in range(1, len(text) + 1):
            want = table.library.id_to_piece(table.library.encode(text[1:n]))
            assert want == [] or last[n] == -1 or table.names[last[n]] == want[-1] or want[-1].startswith("<0x")


def test_pairs_are_compatible_if_merging_gives_them(table):
    rng = random.Random(11)
    for _ in range(4000):
        a, b = rng.randrange(len(table.names)), rng.randrange(len(table.names))
        assert table.compatible(a, b) == (table.steps(table.names[a] + table.names[b])[1] == [table.names[a], table.names[b]])


def test_small_tables_forget_and_stay_right():
    small = pieces.PieceTable(queries.PIECES, longest=6, limit=20)
    texts = [f"some words number {k} again and again, wordless{k * 7919}" for k in range(200)]
    assert all(ids(small.ids(t.encode())) == [1, *small.library.encode(t), 2] for t in texts)


def test_query_on_all_documents(spark, table):
    docs = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.QUERIES["op11_pieces"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        want = [1, *table.library.encode(t), 2]
        digests = hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(table.library.decode(want).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), *digests)


def test_odd_tables(spark, table):
    rows = [(1, "a", "x", b"y"), (1, "a", "x", b"y"), (None, "no id", None, None), (2, None, "x", b""), (3, "", "x", b""), (4, " \t\n ", "x", b""), (5, "word " * 30_000, "x", b""), (6, "x" * 200_000, "x", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, raw string, ids binary")
    got = sorted(((r.doc_id, bytes(r.ids), r.text) for r in pieces.decode(pieces.encode(df, queries.PIECES), queries.PIECES).collect()), key=repr)
    want = sorted(((i, np.array([1, *table.library.encode(t or ""), 2], "<u4").tobytes(), t or "") for i, t, *_ in rows), key=repr)
    assert got == want
    assert pieces.encode(df.limit(0), queries.PIECES).count() == 0
