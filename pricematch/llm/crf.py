"""A linear-chain conditional random field over tokens: begin, inside and outside of a secret."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

OUT, BEGIN, INSIDE = 0, 1, 2
TOKEN = re.compile(r"[\w+/.\-]{16,}={0,2}|[\w+/.\-]+|[^\w\s]")
#: Words that announce a secret.
KEYS = frozenset("password passwd pwd passphrase secret token apikey api_key api-key key auth bearer credential credentials access_key secret_key private_key client_secret".split())
_LENGTHS = (1, 3, 7, 11, 15, 19, 31, 39)
_SETS, _SWITCHES, _NEAR, _FILES = 12, 4, 5, 4
SHAPES = (len(_LENGTHS) + 1) * _SETS * _SWITCHES


def shape(token: str) -> int:
    """Length, kinds of characters and turns between letters and digits, as one number."""
    size = sum(len(token) > x for x in _LENGTHS)
    ascii_ = token.isascii()
    digits = sum(c.isdigit() for c in token)
    lower, upper = sum(c.islower() for c in token), sum(c.isupper() for c in token)
    signs = len(token) - digits - lower - upper
    if not ascii_:
        kind = 0
    elif digits + lower + upper == 0:
        kind = 1
    elif signs:
        kind = 2 if not digits else 3 if lower or upper else 4
    elif not digits:
        kind = 5 if not upper else 6 if not lower else 7 if upper == 1 and token[0].isupper() else 8
    elif not lower and not upper:
        kind = 9
    elif not upper and all(c in "0123456789abcdef" for c in token):
        kind = 10
    else:
        kind = 11
    turns = sum((a.isdigit() != b.isdigit()) for a, b in zip(token, token[1:])) if digits else 0
    return (size * _SETS + kind) * _SWITCHES + (0 if turns == 0 else 1 if turns <= 2 else 2 if turns <= 5 else 3)


def near(token: str) -> int:
    """What a token tells its neighbours: an announcing word, an assignment, a quote, a number, or nothing."""
    if token in "=:":
        return 2
    if token in "\"'`":
        return 3
    low = token.lower()
    return 1 if low in KEYS else 4 if token[0].isdigit() else 0


class Codes(dict):
    """Shape and neighbour class of a token, worked out once."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, token: str) -> int:
        if len(self) > self.limit:
            self.clear()
        out = self[token] = shape(token) * 8 + near(token)
        return out

    def of(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


def file_class(codes: np.ndarray) -> int:
    """Features of the whole file: whether it assigns anything, and whether much of it is numbers."""
    kinds = codes & 7
    return int((kinds == 2).any()) * 2 + int((kinds == 4).sum() * 20 > len(codes))


def features(codes: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Active feature numbers of each token, one column for each template; ``kind`` is the class of the file that the
    tokens are a window of, else they are the file."""
    n = len(codes)
    kind = file_class(codes) if kind is None else kind
    shapes, kinds = codes >> 3, np.concatenate([np.zeros(3, np.int32), codes & 7, np.zeros(1, np.int32)])
    columns = [
        shapes // (_SETS * _SWITCHES), shapes // _SWITCHES % _SETS, shapes % _SWITCHES, shapes,
        kinds[2 : n + 2], kinds[1 : n + 1], kinds[:n], kinds[4 : n + 4], np.full(n, kind, np.int32),
    ]
    return np.stack([c + at for c, at in zip(columns, _OFFSETS, strict=True)], axis=1)


_WIDTHS = [len(_LENGTHS) + 1, _SETS, _SWITCHES, SHAPES, _NEAR, _NEAR, _NEAR, _NEAR, _FILES]
_OFFSETS = [0, *np.cumsum(_WIDTHS)[:-1].tolist()]
DIM = sum(_WIDTHS)


@dataclass
class Model:
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x next label

    def __post_init__(self) -> None:
        t = self.moves
        one = [0.0] + [t[y, b] - t[OUT, b] for y in (1, 2) for b in range(3)]
        other = [0.0] + [t[a, y] - t[a, OUT] for y in (1, 2) for a in range(3)]
        both = [t[a, y] + t[y, b] - t[a, OUT] - t[OUT, b] for y in (1, 2) for a in range(3) for b in range(3)]
        self.gain = float(max(one + other + both))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.weights[features(codes)].sum(axis=1)

    def best(self, scores: np.ndarray, before: int | None = None, after: int | None = None) -> list[int]:
        """Viterbi: the labels of highest score, between given labels or the ends."""
        t = self.moves.tolist()
        rows = scores.tolist()
        now = [e + (t[before][y] if before is not None else 0.0) for y, e in enumerate(rows[0])]
        back = []
        for row in rows[1:]:
            froms = [max(range(3), key=lambda a: now[a] + t[a][y]) for y in range(3)]
            now = [now[a] + t[a][y] + row[y] for y, a in enumerate(froms)]
            back.append(froms)
        if after is not None:
            now = [x + t[y][after] for y, x in enumerate(now)]
        labels = [max(range(3), key=lambda y: now[y])]
        for froms in reversed(back):
            labels.append(froms[labels[-1]])
        return labels[::-1]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best labels of a whole file.

        A token whose lead for outside is above anything that moves between labels could win back is
        outside on the best path, as turning it so would raise any other path. The stretches between such
        tokens are decoded one by one, which is the same as decoding them all at once.
        """
        labels = np.zeros(len(codes), np.int8)
        if not len(codes):
            return labels
        scores = self.scores(codes)
        open_ = np.flatnonzero(scores[:, 1:].max(axis=1) - scores[:, 0] + self.gain >= 0)
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                a, b = int(run[0]), int(run[-1]) + 1
                labels[a:b] = self.best(scores[a:b], OUT if a else None, OUT if b < len(codes) else None)
        return labels


def never() -> Model:
    """Marks nothing; for a corpus without an example to learn from."""
    weights = np.zeros((DIM, 3))
    weights[:, OUT] = 100.0
    return Model(weights, np.zeros((3, 3)))


def train(codes: list[np.ndarray], labels: list[np.ndarray], files: list[int], rounds: int = 120, penalty: float = 2e-4, rate: float = 0.15) -> Model:
    """Conditional likelihood with a quadratic penalty by Adam, on windows of one common length and the classes of their
    files."""
    if not any((y > 0).any() for y in labels):
        return never()
    x, y = np.stack([features(c, f) for c, f in zip(codes, files, strict=True)]), np.stack(labels).astype(int)
    n, length, _ = x.shape
    theta, moves = np.zeros((DIM, 3)), np.zeros((3, 3))
    m, v = [np.zeros_like(theta), np.zeros_like(moves)], [np.zeros_like(theta), np.zeros_like(moves)]
    gold = np.eye(3)[y]
    total = n * length
    flat = x.reshape(total, -1)
    pair_gold = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, rounds + 1):
        e = theta[flat].sum(axis=1).reshape(n, length, 3)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            alpha[:, t] = e[:, t] + np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1)
            s = length - 1 - t
            beta[:, s] = np.logaddexp.reduce(moves + (e[:, s + 1] + beta[:, s + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)[:, None, None]
        miss = np.exp(alpha + beta - z) - gold
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None]).sum(axis=(0, 1)) - pair_gold
        grad = np.stack([np.bincount(flat.ravel(), np.repeat(miss.reshape(total, 3)[:, k], flat.shape[1]), DIM) for k in range(3)], axis=1)
        for k, (p, g) in enumerate(((theta, grad / n + penalty * theta), (moves, pair / n + penalty * moves))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(theta, moves)
