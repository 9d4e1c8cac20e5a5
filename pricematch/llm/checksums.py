"""CRC-32C (Castagnoli) of many byte strings at once, and its masked form."""

from __future__ import annotations

import numpy as np

#: The reversed polynomial, and what the mask of a stored checksum adds.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
_CHUNK = 256  # bytes that are folded together before chunks are joined


def _table16() -> np.ndarray:
    state = np.arange(65536, dtype=np.uint32)
    for _ in range(16):
        state = (state >> 1) ^ np.where(state & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return state


_STEP = _table16()


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product over GF(2) of a 32 x 32 bit matrix, given by columns, and each state of ``x``."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _powers() -> list[np.ndarray]:
    """What 1, 2, 4, ... zero bytes do to the state."""
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        state = (state >> 1) ^ np.where(state & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    out = [state]
    for _ in range(40):
        out.append(_times(out[-1], out[-1]))
    return out


_ZEROS = _powers()


def _after_zeros(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The states after ``n`` zero bytes each."""
    state, bit = state.copy(), 0
    while (n >> bit).any():
        on = ((n >> bit) & 1).astype(bool)
        state[on] = _times(_ZEROS[bit], state[on])
        bit += 1
    return state


def crc32c(strings: list[bytes]) -> np.ndarray:
    """The checksum of each byte string.

    Zeros before a string do not change a register that starts at 0, so each string is padded in
    front to whole chunks, all chunks are folded side by side, and the results joined.
    """
    if not strings:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    chunks = np.maximum(1, -(-sizes // _CHUNK))
    zeros = bytes(_CHUNK)
    padded = b"".join(x for s, pad in zip(strings, (chunks * _CHUNK - sizes).tolist(), strict=True) for x in (zeros[:pad], s))
    lanes = np.ascontiguousarray(np.frombuffer(padded, "<u2").reshape(-1, _CHUNK // 2).T)
    state = np.zeros(lanes.shape[1], np.uint32)
    for pair in lanes:
        state = (state >> np.uint32(16)) ^ _STEP[(state ^ pair) & np.uint32(0xFFFF)]
    first = np.cumsum(chunks) - chunks
    behind = np.repeat(chunks, chunks) - 1 - (np.arange(len(state)) - np.repeat(first, chunks))
    joined = np.bitwise_xor.reduceat(_after_zeros(state, behind * _CHUNK), first)
    return joined ^ _after_zeros(np.full(len(sizes), 0xFFFFFFFF, np.uint32), sizes) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum as it is stored: turned and shifted, as checksums of checksums are weak."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
