"""Vectorised byte-level tokenising and hashing of Arrow string batches.

Small numpy helpers shared by the operators that run inside Arrow tasks.  A
batch of texts is one UTF-8 buffer with offsets; words, word windows and byte
windows are hashed for the whole buffer at once, so the cost per word is a few
array passes and no Python object is made for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=U, endpoint=False)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Separators of the white-space rule: \x20 and \x09-\x0D.
IS_WORD_WS = np.ones(256, bool)
IS_WORD_WS[[0x20, 9, 10, 11, 12, 13]] = False
#: Word bytes of the alphanumeric rule, after lower-casing: 0-9, a-z, non-ASCII.
IS_WORD_ALNUM = np.zeros(256, bool)
IS_WORD_ALNUM[0x30:0x3A] = True
IS_WORD_ALNUM[0x41:0x5B] = True
IS_WORD_ALNUM[0x61:0x7B] = True
IS_WORD_ALNUM[0x80:] = True

_HASH_LOWER = _TABLE[_LOWER]

#: Bytes of text that are worked on at once; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 18

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.full(size, base, U)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads the weak low bits of polynomial hashes."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Chunk(NamedTuple):
    """Some consecutive rows of a batch: first row, and their bytes and byte offsets."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into runs of rows of about `size` bytes; null is empty."""
    if len(texts) == 0:
        return
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("")
    wide = pa.types.is_large_string(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield Chunk(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Words(NamedTuple):
    """Words of a chunk in order: hash, row within the chunk, and byte span."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of table[data[j]] * R**j over j < i."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * _power(_R, len(data)), out=out[1:])
    return out


def words(chunk: Chunk, is_word: np.ndarray = IS_WORD_WS) -> Words:
    """Words of every row, A-Z lower-cased, hashed to 64 bits; words never cross rows."""
    data, offsets = chunk.data, chunk.offsets
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    if len(data):
        edge[0], edge[-1] = True, True
        edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = inside[start] if len(data) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    with np.errstate(over="ignore"):
        h = prefix_hash(data, _HASH_LOWER)
        out = mix((h[end] - h[start]) * _power(_RINV, len(data) + 1)[start] + (end - start).astype(U))
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(out, row, start, end)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie in one row, and the index of their first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U)
        for j in range(k):
            h = h * U(0xD6E8FEB86659FD93) + w.hash[j : j + n]
        h = mix(h)
    first = np.flatnonzero(w.row[:n] == w.row[k - 1 : k - 1 + n])
    return h[first], first


def signed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return h.view(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, compressed."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], width * n, "zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=U)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of `key`, of a stream sorted by it."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.names.index(key)).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and int(k[s]) != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(k[s])
            held.append(b.slice(s, e - s))
    if held:
        yield at, pa.Table.from_batches(held)
