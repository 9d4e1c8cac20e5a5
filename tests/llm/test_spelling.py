"""Spelling variants against brute force over all pairs of words."""
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pricematch.llm import queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(docs):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def grouped(words):
    """A row for each word, with all pairs compared."""
    pairs = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in pairs.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(pairs[w]), words.get(form[w])))
    return out


def rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_on_all_documents(spark):
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    words = counted(docs)
    # as `near`, by what is left when one code point goes
    left = {}
    for w in words:
        for k in range(len(w)):
            left.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    pairs = {w: {x for k in range(len(w)) for x in left[w[:k] + w[k + 1 :]] if near(w, x)} | {x for x in left.get(w, ()) if near(w, x)} | {w[:k] + w[k + 1 :] for k in range(len(w)) if w[:k] + w[k + 1 :] in words} for w in words}
    got = rows(queries.QUERIES["op13_spelling"](spark, SF))
    assert {r[0]: (r[3], r[4]) for r in got} == {w: (words[w], len(pairs[w])) for w in words}
    some = dict(sorted(words.items())[:700])
    assert rows(spelling.variants(spark.createDataFrame(list(some.items()), "word string, n long"))) == grouped(some)


def test_chains_ties_and_crowded_buckets(spark, monkeypatch):
    rng = random.Random(3)
    words = {"chained": 5, "chainen": 25, "chaines": 10, "chainenx": 125, "chainenxx": 625, "chainenxxx": 3125, "chainenxxxx": 3125 * 5}
    words |= {"tiedup": 5, "tiedua": 40, "tiedub": 40, "tieduptiedup": 7, "aaaaaaa": 100, "aaaaaaaa": 100, "aaaaaaaaa": 3, "éàüöäßé": 9, "éàüöäß": 50}
    words |= {"common" + "".join(rng.choice("abcd") for _ in range(4)): rng.randrange(5, 300) for _ in range(250)}
    words |= {"".join(rng.choice("abcd") for _ in range(4)) + "endings": rng.randrange(5, 300) for _ in range(250)}
    words |= {"x" * 3000 + end: n for end, n in (("a", 5), ("b", 50), ("ab", 9))}
    want = grouped(words)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows(spelling.variants(df)) == want
    monkeypatch.setattr(spelling, "_TILE", 16)  # every crowded bucket in many tiles
    assert rows(spelling.variants(df)) == want


def test_tiles_hold_for_any_block_of_memory(monkeypatch):
    rng = random.Random(4)
    some = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (6, 7) for _ in range(60)})
    raw = [w.encode() for w in some]
    want = {(a, b) for a in some for b in some if near(a, b) and max(len(a), len(b)) == 7}
    for cells in (1, 1 << 21):
        monkeypatch.setattr(spelling, "_CELLS", cells)
        got = [spelling._Tiles.near(raw, raw, 7, suffix, True) for suffix in (False, True)]
        found = [(some[i], some[j]) for x, y in got for i, j in zip(x.tolist(), y.tolist())]
        assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("copies", [1, 5])
def test_odd_tables(spark, copies):
    data = [(1, "Wonder wonders wondere " * 9, "x", 1), (1, "Wonder wonders wondere " * 9, "x", 1), (None, "Nothing " * 6, "y", 2), (2, None, None, 3), (3, "", "", 4), (4, "ÀÉtoile étoile " * 5 + "×÷" * 20, "z", 5), (5, "letter" * 20_000, "z", 6), (6, "word " * 30_000, "z", 7)] * copies
    df = spark.createDataFrame(data, "doc_id long, text string, word string, n int")
    want = counted([r[:2] for r in data])
    assert {r.word: r.n for r in spelling.words(df).collect()} == want
    assert rows(spelling.variants(spelling.words(df))) == grouped(want)
    assert spelling.variants(spelling.words(df.limit(0))).count() == 0


def test_common_lengths():
    left, right = spelling._padded([b"abcd", b"abd", b"abcd"], 4)
    assert spelling._common(left, left).tolist() == [[4, 2, 4], [2, 4, 2], [4, 2, 4]]
    assert spelling._common(right, right)[0].tolist() == [4, 1, 4] and left.dtype == np.uint8
