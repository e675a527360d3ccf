"""md5 of numbered texts, many at once: the draws and orders of resampling, which any engine can make again."""

from __future__ import annotations

import hashlib
from math import floor, sin

import numpy as np

# md5's shifts, constants and first state.
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
#: Numbers that are hashed at once: some hundred KB of words.
BLOCK = 32768


def _rounds(words: list[int | np.ndarray], n: int) -> np.ndarray:
    """The four words of each of n digests, from the sixteen of a message of one block: a number where all n share it."""
    a, b, c, d = (np.full(n, s, np.uint32) for s in _STATE)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[_PLACES[i]]
        if isinstance(word, np.ndarray):
            f += word
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        f <<= np.uint32(_SHIFTS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _STATE, strict=True)])


def _alike(prefix: bytes, numbers: np.ndarray, digits: int) -> np.ndarray:
    """md5 words of numbers of so many digits."""
    length = len(prefix) + digits
    if length > 55:
        return np.array([np.frombuffer(hashlib.md5(prefix + b"%d" % i).digest(), "<u4") for i in numbers.tolist()], np.uint32).T
    block = (prefix + b"0" * digits + b"\x80").ljust(56, b"\0") + (8 * length).to_bytes(8, "little")
    words: list[int | np.ndarray] = np.frombuffer(block, "<u4").tolist()
    left = numbers.astype(np.uint32) if int(numbers[-1]) < 2**32 else numbers.astype(np.uint64)
    for at in range(length - 1, len(prefix) - 1, -1):
        tenth = left // left.dtype.type(10)
        own = ((left - tenth * left.dtype.type(10)).astype(np.uint32)) << np.uint32(8 * (at % 4))
        words[at // 4] = own + (words[at // 4] if isinstance(words[at // 4], np.ndarray) else np.uint32(words[at // 4]))
        left = tenth
    return _rounds(words, len(numbers))


def md5_of(prefix: str, start: int, stop: int) -> np.ndarray:
    """Digests of the prefix with each of the whole numbers start .. stop - 1 behind it: four rows of words, each as its hex digits read."""
    out, head = [], prefix.encode()
    while start < stop:
        digits = len(str(start))
        upto = min(stop, 10**digits, start + BLOCK)
        out.append(_alike(head, np.arange(start, upto, dtype=np.int64), digits))
        start = upto
    return np.concatenate(out, axis=1).byteswap() if out else np.empty((4, 0), np.uint32)


def drawn(prefix: str, start: int, stop: int, n: int) -> np.ndarray:
    """What functions.stats.draw() gives for these places: a number in 0 .. n - 1 each."""
    first = md5_of(prefix, start, stop)[0]
    if n >= 2**32:
        return first.astype(np.int64)
    return (first - first // np.uint32(n) * np.uint32(n)).astype(np.intp)


def in_md5_order(prefix: str, n: int) -> np.ndarray:
    """0 .. n - 1 in the order of their digests, and of the numbers where these are equal."""
    words = np.empty((2, n), np.uint32)
    for at in range(0, n, BLOCK):
        words[:, at : at + BLOCK] = md5_of(prefix, at, min(n, at + BLOCK))[:2]
    key = words[0].astype(np.uint64) << np.uint64(32) | words[1]
    order = np.argsort(key, kind="stable")
    key = key[order]
    if (key[1:] == key[:-1]).any():
        rest = md5_of(prefix, 0, n)
        order = np.lexsort((np.arange(n), *rest[::-1]))
    return order


def first_in_md5_order(prefix: str, start: int, stop: int, most: int) -> tuple[np.ndarray, list[bytes]]:
    """The numbers of start .. stop - 1 that come first in that order, and their digests."""
    words = md5_of(prefix, start, stop)
    if words.shape[1] > most:
        near = np.flatnonzero(words[0] <= np.partition(words[0], most - 1)[most - 1])
    else:
        near = np.arange(words.shape[1])
    near = near[np.lexsort((near, *words[::-1, near]))[:most]]
    return start + near, [bytes(x) for x in np.ascontiguousarray(words[:, near].T).astype(">u4").view("V16").ravel()]
