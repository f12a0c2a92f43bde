"""Argon2 (RFC 9106) on NumPy: a block of 1024 bytes is 128 words that are mixed eight rows or columns at a time."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

VARIANTS = {"argon2d": 0, "argon2i": 1, "argon2id": 2}
SLICES = 4
_LOW = np.uint64(0xFFFFFFFF)


def _le(n: int, size: int = 4) -> bytes:
    return n.to_bytes(size, "little")


def _long_hash(data: bytes, size: int) -> bytes:
    """BLAKE2b of any length: all but the last digest give their first half."""
    data = _le(size) + data
    if size <= 64:
        return blake2b(data, digest_size=size).digest()
    out, last = b"", blake2b(data).digest()
    while size - len(out) > 64:
        out += last[:32]
        left = size - len(out)
        last = blake2b(last, digest_size=min(64, left)).digest()
    return out + last


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint64(bits) | x << np.uint64(64 - bits)


def _add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x + y + ((x & _LOW) * (y & _LOW) << np.uint64(1))


def _quarter(a, b, c, d):
    for first, second in ((32, 24), (16, 63)):
        a = _add(a, b)
        d = _turn(d ^ a, first)
        c = _add(c, d)
        b = _turn(b ^ c, second)
    return a, b, c, d


def _permute(x: np.ndarray) -> np.ndarray:
    """Eight groups of 16 words, each a square of 4 by 4: its columns, then its diagonals."""
    a, b, c, d = _quarter(*(x.reshape(8, 4, 4)[:, k] for k in range(4)))
    a, b, c, d = _quarter(a, np.roll(b, -1, 1), np.roll(c, -2, 1), np.roll(d, -3, 1))
    return np.stack((a, np.roll(b, 1, 1), np.roll(c, 2, 1), np.roll(d, 3, 1)), axis=1).reshape(8, 16)


def _compress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mixed = x ^ y
    rows = _permute(mixed.reshape(8, 16))
    columns = _permute(rows.reshape(8, 8, 2).transpose(1, 0, 2).reshape(8, 16))
    return columns.reshape(8, 8, 2).transpose(1, 0, 2).reshape(128) ^ mixed


@lru_cache(64)
def digest(secret: bytes, salt: bytes, variant: str, version: int, memory: int, passes: int, lanes: int, size: int) -> bytes:
    """The hash of ``size`` bytes; ``memory`` in KiB. It takes that memory once, and about 0.2 ms for each KiB and pass."""
    kind = VARIANTS[variant]
    head = b"".join(map(_le, (lanes, size, memory, passes, version, kind)))
    seed = blake2b(head + _le(len(secret)) + secret + _le(len(salt)) + salt + _le(0) + _le(0)).digest()
    part = memory // (SLICES * lanes)
    row = part * SLICES
    block = np.zeros((lanes, row, 128), dtype=np.uint64)
    for lane in range(lanes):
        for k in range(2):
            block[lane, k] = np.frombuffer(_long_hash(seed + _le(k) + _le(lane), 1024), dtype="<u8")
    for turn in range(passes):
        for piece in range(SLICES):
            for lane in range(lanes):
                _fill(block, kind, version, passes, turn, piece, lane, part)
    last = np.bitwise_xor.reduce(block[:, -1], axis=0)
    return _long_hash(last.astype("<u8").tobytes(), size)


def _fill(block: np.ndarray, kind: int, version: int, passes: int, turn: int, piece: int, lane: int, part: int) -> None:
    """One slice of one lane."""
    lanes, row, _ = block.shape
    steady = kind == 1 or kind == 2 and turn == 0 and piece < 2
    zero, source = np.zeros(128, dtype=np.uint64), np.zeros(128, dtype=np.uint64)
    picks = zero
    source[:6] = turn, lane, piece, lanes * row, passes, kind
    for k in range(part):
        if steady and k % 128 == 0:
            source[6] += np.uint64(1)
            picks = _compress(zero, _compress(zero, source))
        at = piece * part + k
        if turn == 0 and at < 2:
            continue
        before = block[lane, at - 1]
        pick = int(picks[k % 128] if steady else before[0])
        other = lane if turn == 0 and piece == 0 else (pick >> 32) % lanes
        done = piece * part if turn == 0 else row - part
        size = done + k - 1 if other == lane else done - (k == 0)
        start = 0 if turn == 0 else (piece + 1) * part
        near = (pick & 0xFFFFFFFF) ** 2 >> 32
        found = (start + size - 1 - (size * near >> 32)) % row
        fresh = _compress(before, block[other, found])
        block[lane, at] = fresh ^ block[lane, at] if turn and version == 19 else fresh
