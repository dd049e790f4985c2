"""Words of many texts at once, in numpy.

A text's words are runs of anything but space and \\t \\n \\v \\f \\r. Their hashes are taken eight
bytes at a time, each eight mixed into what came before, so that they depend on a salt that no
text knows; words beyond LONG bytes go through blake2b. Hashes find what may be equal; whether it
is equal, operators check on the words themselves, by exact numbers of words or by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are taken in one go.
PIECE_BYTES = 1 << 19
LONG = 256

_SPACE = bytes(0x20 if c in (0x20, 9, 10, 11, 12, 13) else c for c in range(256))
_SPACE_LOWER = bytes(0x20 if c in (0x20, 9, 10, 11, 12, 13) else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_STEP = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_KEY = 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Words(NamedTuple):
    """Where the words of some texts stand in ``joined``, and where each text's words begin among them (one more than texts)."""

    joined: bytes
    starts: np.ndarray
    ends: np.ndarray
    begins: np.ndarray


def words(texts: list[bytes], lower: bool = False) -> Words:
    joined = b" ".join(texts).translate(_SPACE_LOWER if lower else _SPACE)
    solid = np.zeros(len(joined) + 2, np.int8)
    solid[1:-1] = np.frombuffer(joined + b" ", np.uint8)[:-1] != 0x20
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(joined, starts, ends, np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _eights(joined: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(joined) + 1,), "<u8", joined + b"\0" * 8, strides=(1,))


def _key(lane: int, salt: int) -> np.uint64:
    return mix(np.array([(_KEY * (2 * salt + lane + 1)) % (1 << 64)], np.uint64))[0]


def hashes(found: Words, lane: int = 0, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; lanes are independent, and so are salts."""
    eights, sizes = _eights(found.joined), found.ends - found.starts
    out = _key(lane, salt) + sizes.astype(np.uint64) * np.uint64(_STEP[0])
    going, at = np.flatnonzero(sizes <= LONG), 0
    while len(going):
        left = sizes[going] - at
        out[going] = mix(out[going] ^ (eights[found.starts[going] + at] & _MASKS[np.minimum(left, 8)]))
        going, at = going[left > 8], at + 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(found.joined[found.starts[i] : found.ends[i]], digest_size=8, key=b"%d:%d" % (lane, salt)).digest(), "little")
    return out


def prefix_hashes(found: Words, sizes: tuple[int, ...]) -> np.ndarray:
    """A row for each size up to 8: hashes of the words' first bytes, 0 for shorter words."""
    first, lengths = _eights(found.joined)[found.starts], found.ends - found.starts
    return np.array([np.where(lengths >= n, mix((first & _MASKS[n]) ^ _key(n, 1 << 20)), np.uint64(0)) for n in sizes], np.uint64).reshape(len(sizes), len(first))


def codes(found: Words) -> np.ndarray:
    """A number for each word, equal exactly where words are."""
    if not len(found.starts):
        return np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
    data = [None, pa.py_buffer(offsets), pa.py_buffer(found.joined.translate(None, b" "))]
    return pa.Array.from_buffers(pa.large_binary(), len(found.starts), data).dictionary_encode().indices.to_numpy().astype(np.int64)


def pieces(texts: list[bytes | str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about PIECE_BYTES; null texts are empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "replace") if isinstance(t, str) else t or b""
        if held and size + len(raw) > PIECE_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def windows(hashed: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive words of the whole array of hashed words."""
    if len(hashed) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashed) - k + 1, np.uint64)
    step = np.uint64(_STEP[seed])
    for i in range(k):
        out *= step
        out += hashed[i : len(hashed) - k + 1 + i]
    return mix(out)


def numbered(codes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all runs of k consecutive codes, equal exactly where the runs are equal."""
    if len(codes) < k:
        return np.zeros(0, np.int64)
    out, length, power, step = None, 0, codes, 1
    while k:
        if k & 1:
            out, length = (power, step) if out is None else (_pairs(out, power, length), length + step)
        k >>= 1
        if k:
            power, step = _pairs(power, power, step), 2 * step
    return out


def _pairs(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    n = min(len(left), len(right) - apart)
    keys = left[:n] * (int(right.max()) + 1) + right[apart : apart + n]
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)
