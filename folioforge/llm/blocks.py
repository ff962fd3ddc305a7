"""Vectorised word kernels over Arrow string columns.

Texts are handled as UTF-8 bytes in blocks of a megabyte, so memory is
bounded by the block (or by one text, if a text is longer).  A word class is a
256-entry table over bytes: all the separators in use are ASCII, so every byte of
a multi-byte character belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
#: Start values of two hashes that share no state.
SEED, OTHER_SEED = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D
#: Ranges of more bytes than this are hashed one by one.
_LONG_RANGE = 1 << 12
_TAIL = np.array([2 ** (8 * k) - 1 for k in range(8)], np.uint64)


def byte_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased first.
ALNUM = byte_table(bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)))
#: Maps A-Z to a-z and leaves other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


class Block(NamedTuple):
    """Consecutive rows of a batch and the bytes of their texts."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a block: byte ranges, hashes, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


#: What a worker keeps from task to task.  Workers outlive stages, so other work lets go of it.
kept: list = []


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> Iterator[Block]:
    """Cut a string column into blocks of whole rows; null counts as empty."""
    if not keep:
        kept.clear()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), len(column))
        low, high = int(offsets[first]), int(offsets[last])
        yield Block(first, last - first, data[low:high], offsets[first : last + 1] - low)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """64-bit content hashes of byte ranges, eight bytes a step through a finaliser.

    Every step is a bijection of the state and of the eight bytes, but no sum over positions, so no
    pattern of a text (as there is for rolling polynomials) makes two ranges agree.
    """
    sizes = ends - starts
    first = mix(np.array([seed], np.uint64))[0]
    out = mix(sizes.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + first)
    step = _U(seed) ^ _U(0xC2B2AE3D27D4EB4F)
    eights = _eights(data)
    long = np.flatnonzero(sizes > _LONG_RANGE)
    for k in long.tolist():
        body = blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[k] ^= _U(int.from_bytes(body, "little"))
    left = np.flatnonzero((sizes > 0) & (sizes <= _LONG_RANGE))
    at, rest = starts[left], sizes[left]
    while len(left):
        part = eights[at]
        short = rest < 8
        part[short] &= _TAIL[rest[short]]
        out[left] = mix((out[left] ^ part) + step)
        more = rest > 8
        left, at, rest = left[more], at[more] + 8, rest[more] - 8
    return out


def same_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> bool:
    """Whether every range holds the same bytes as the range whose number `others` gives."""
    sizes = ends - starts
    if (sizes != sizes[others]).any():
        return False
    eights = _eights(data)
    left = np.flatnonzero(others != np.arange(len(others)))
    here, there, rest = starts[left], starts[others[left]], sizes[left]
    while len(here):
        differ = eights[here] ^ eights[there]
        short = rest < 8
        differ[short] &= _TAIL[rest[short]]
        if differ.any():
            return False
        more = rest > 8
        here, there, rest = here[more] + 8, there[more] + 8, rest[more] - 8
    return True


def split_words(block: Block, inside: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Find and hash the words of every row of a block."""
    data = fold[block.data]
    member = np.zeros(len(data) + 2, bool)
    member[1:-1] = inside[data]
    heads = member[1:-1] & ~member[:-2]
    tails = member[1:-1] & ~member[2:]
    edges = block.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    heads[edges] = member[edges + 1]
    tails[edges - 1] = member[edges]
    starts = np.flatnonzero(heads)
    ends = np.flatnonzero(tails) + 1
    return Words(starts, ends, range_hashes(data, starts, ends), np.searchsorted(starts, block.offsets))


def grams_at(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` values from each of the given positions on."""
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[at + k]) * _U(0xC2B2AE3D27D4EB4F)
        out ^= out >> _U(29)
    return mix(out)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` values from each position on; the last size-1 positions are absent."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * _U(0xC2B2AE3D27D4EB4F)
        out ^= out >> _U(29)
    return mix(out)


def whole_positions(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """True where a run of `size` words from that position stays inside its row."""
    ok = np.ones(max(n, 0), bool)
    for k in range(1, size):
        at = bounds - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok
