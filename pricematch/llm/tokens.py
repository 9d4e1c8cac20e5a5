"""Token ids of whole texts by a public tokenizer."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import held

#: Printable ASCII, and the letters from U+00C0 to U+00FF.
_PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _byte_signs() -> dict[int, str]:
    """How byte-level models write those letters: a sign for each byte, itself if it is printable in Latin-1, else the next
    one from U+0100 on."""
    other = (b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))
    spelled = {b: chr(256 + n) for n, b in enumerate(other)}
    return {c: "".join(spelled.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTE_SIGNS = _byte_signs()


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    Where the tokenizer drops white space before it looks for words (its splitter keeps matches
    alone and none of them can hold a blank), a text's ids are those of its words, one after the
    other. Words are then encoded together and kept in a table of at most ``limit`` words. Other
    tokenizers encode each text in one piece. Either way the ids are the library's for the text.

    Words of printable ASCII and Latin-1 letters that hold no added token skip the library's normaliser, which leaves
    them as they are but for their case, and its splitter: its own pattern cuts them here, and each piece
    goes to the library's model. Words used before the table last filled up are looked up in the one before.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.words, self.older = limit, {}, {}
        self.by_word = _drops_blanks(path)
        self.mark = self._separator() if self.by_word else None
        self.pieces, self.lower, self.added = _plain_words(path) if self.by_word else (None, False, None)
        self.tokenize = self.tokenizer.model.tokenize

    @property
    def id_bytes(self) -> int:
        """Bytes that hold any id."""
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def ids(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._plain(text)
        return self.many([text])[0]

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; words that are new to all of them are encoded together."""
        if not self.by_word:
            return [self._plain(t) for t in texts]
        if len(self.words) > self.limit:
            self.words, self.older = {}, self.words
        known = self.words.get
        split = [t.split() for t in texts]
        parts = [list(map(known, words)) for words in split]
        open_ = [[i for i, p in enumerate(found) if p is None] for found in parts]
        new = {words[i] for words, at in zip(split, open_, strict=True) for i in at}
        if new:
            if self.older:
                again = {w: p for w in new if (p := self.older.get(w)) is not None}
                self.words.update(again)
                new -= again.keys()
            self._learn(list(new))
            for words, found, at in zip(split, parts, open_, strict=True):
                for i in at:
                    found[i] = self.words[words[i]]
        return list(map(b"".join, parts))

    def _plain(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _separator(self) -> tuple[str, int] | None:
        """A sign that is one id and that stands between words encoded together."""
        for sign in "♥★→©":
            ids = self.tokenizer.encode(sign, add_special_tokens=False).ids
            if len(ids) == 1:
                return sign, ids[0]
        return None

    def _plain_word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.lower:
            text = text.lower()
        pieces = [text] if text.isalpha() else self.pieces(text)
        if not text.isascii():
            pieces = [p.translate(_BYTE_SIGNS) for p in pieces]
        return array("I", [t.id for p in pieces for t in self.tokenize(p)]).tobytes()

    def _learn(self, words: list[bytes], together: int = 2000) -> None:
        if self.pieces is not None:
            plain = {w for w in words if _PLAIN(w) and not (self.added and self.added.search(w))}
            self.words.update((w, self._plain_word(w)) for w in plain)
            words = [w for w in words if w not in plain]
        if self.mark is None:
            self.words.update((w, self._plain(w)) for w in words)
            return
        sign, mark = self.mark
        for i in range(0, len(words), together):
            some = words[i : i + together]
            text = f" {sign} ".join(w.decode("utf-8", "replace") for w in some)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) != len(some) - 1:  # a word holds the sign itself
                self.words.update((w, self._plain(w)) for w in some)
                continue
            raw = ids.tobytes()
            for w, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                self.words[w] = raw[4 * a : 4 * b]


def _drops_blanks(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    normal = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    known = all(n.get("type") in (None, "NFC", "Lowercase") or n.get("content") == " " for n in normal)
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(known and kept and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"))


def _plain_words(path: str) -> tuple:
    """For words of printable ASCII and Latin-1 letters: what cuts them into pieces, whether they are put in lower case, and a pattern of
    the added tokens (in either case). Without a cut if the tokenizer does more to them."""
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    normal = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    same = all(n.get("type") in (None, "NFC", "Lowercase") or n == blanks for n in normal)
    if not same or len(steps) != 2 or steps[1].get("type") != "ByteLevel" or steps[1].get("add_prefix_space") or steps[1].get("use_regex"):
        return None, False, None
    added = [re.escape(t["content"].encode()) for t in spec.get("added_tokens") or []]
    cut = regex.compile(steps[0]["pattern"]["Regex"]).findall
    return cut, any(n.get("type") == "Lowercase" for n in normal), re.compile(b"|".join(added), re.I) if added else None


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, however many tasks it runs."""
    return held(f"tokens {path}", lambda: Encoder(path))
