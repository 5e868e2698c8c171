"""Words of many texts at once, as numpy arrays over Arrow's own buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D, in UTF-8. Texts are handled in blocks of a few MB, cut
between documents; a text longer than a block is a block of its own and is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (9, 10, 11, 12, 13, 32)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
#: Odd multipliers of the hash functions (any would do; all tasks need the same).
BASE, MIX1, MIX2, MIX3 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0xD6E8FEB86659FD93)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    x = x ^ (x >> U(33))
    x *= MIX1
    x ^= x >> U(33)
    x *= MIX2
    x ^= x >> U(33)
    return x


@dataclass
class Block:
    """Some documents: ``first`` is the place of the first of them in the column, ``bounds`` are byte offsets in ``data``."""

    first: int
    bounds: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_bounds: np.ndarray  # places of each document's words in starts and ends

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.word_bounds))

    def text(self, k: int) -> bytes:
        return self.data[self.bounds[k] : self.bounds[k + 1]].tobytes()

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(LOWER[self.data] if lower else self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans.

    The span's lanes of eight bytes go one after another through a keyed mixing that starts from its length. Each step is
    a bijection of the lane, so spans of up to eight bytes never collide with others of their length, and no arrangement
    of letters makes longer ones collide by design (as it does for polynomials modulo 2**64). A span of more than
    LONG_WORD bytes is hashed by BLAKE2b.
    """
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(sizes.astype(U) * MIX3 + BASE)
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    done = 0
    while len(at):
        left = sizes[at] - done
        lane = lanes[starts[at] + done]
        lane &= np.where(left >= 8, U(2**64 - 1), (U(1) << (np.minimum(left, 7) * 8).astype(U)) - U(1))
        out[at] = mix((out[at] ^ lane) * MIX2 + BASE)
        done += 8
        at = at[left > 8]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> bool:
    """Have the spans at ``starts`` the bytes of those (as long) at ``others``?"""
    step = 1 << 16  # spans at a time
    for k in range(0, len(starts), step):
        n = sizes[k : k + step]
        if (data[ranges(starts[k : k + step], n)] != data[ranges(others[k : k + step], n)]).any():
            return False
    return True


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place): one of each of the distinct spans, and which of them each span is. Exact.

    Spans are told apart by their hashes. Those of more than eight bytes are compared with what they are taken for byte
    by byte (shorter ones of one length can't collide); should two differ all the same, whole bytes are told apart.
    """
    _, first, place = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    sizes, taken_for = ends - starts, first[place]
    long = np.flatnonzero((sizes > 8) & (taken_for != np.arange(len(sizes))))
    if (sizes != sizes[taken_for]).any() or not same_bytes(data, starts[long], sizes[long], starts[taken_for[long]]):
        spans = np.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())], object)
        _, first, place = np.unique(spans, return_index=True, return_inverse=True)
    return first, place


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (sizes[0] of them), then from begin[1] on, and so forth."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def column(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array without nulls (null: empty)."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(values, "") if values.null_count else values


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and bytes of a string array."""
    _, offsets, data = values.buffers()
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    off = np.frombuffer(offsets, kind)[values.offset : values.offset + len(values) + 1].astype(np.int64) if len(values) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(values: pa.Array, size: int = 2 << 20) -> Iterator[Block]:
    off, data = raw(column(values))
    k = 0
    while k < len(off) - 1:
        m = max(k + 1, int(np.searchsorted(off, off[k] + size, "right")) - 1)
        part, bounds = data[off[k] : off[m]], off[k : m + 1] - off[k]
        word = IS_WORD[part]
        before, after = np.empty_like(word), np.empty_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = bounds[:-1][bounds[:-1] < len(part)]
        before[inner] = False
        last = bounds[1:][bounds[1:] > 0] - 1
        after[last] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        yield Block(k, bounds, part, starts, ends, np.searchsorted(starts, bounds))
        k = m
