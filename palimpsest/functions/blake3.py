"""BLAKE3 (256 bit), after the published specification, vectorised over chunks with numpy."""

from __future__ import annotations

import struct

import numpy as np

# The initial state words and the message word permutation.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64

_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15))
_DIAGONALS = ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, n) of n compressions; ``block`` is (16, n)."""
    n = cv.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8] = cv
    for i in range(4):
        v[8 + i] = IV[i]
    v[12] = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    v[13] = (counter >> np.uint64(32)).astype(np.uint32)
    v[14], v[15] = length, flags
    order = list(range(16))
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_COLUMNS + _DIAGONALS):
            for word, (r1, r2) in ((order[2 * k], (16, 12)), (order[2 * k + 1], (8, 7))):
                v[a] += v[b] + block[word]
                v[d] = _rotate(v[d] ^ v[a], r1)
                v[c] += v[d]
                v[b] = _rotate(v[b] ^ v[c], r2)
        order = [order[p] for p in PERMUTATION]
    return v[:8] ^ v[8:]


def _chunk_values(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values (8, chunks) of all chunks of all inputs, and the number of each input's."""
    lengths = np.array([len(x) for x in data], np.int64)
    per = np.maximum(1, -(-lengths // CHUNK))
    n = int(per.sum())
    number = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
    sizes = np.minimum(CHUNK, np.repeat(lengths, per) - number * CHUNK)
    words = np.frombuffer(b"".join([x.ljust(int(k) * CHUNK, b"\0") for x, k in zip(data, per, strict=True)]), "<u4").reshape(n, 16, 16)
    alone = np.repeat(per == 1, per)
    cv = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
    counter = number.astype(np.uint64)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    for k in range(int(blocks.max())):
        live = np.flatnonzero(blocks > k)
        last = blocks[live] == k + 1
        length = np.where(last, sizes[live] - k * BLOCK, BLOCK).astype(np.uint32)
        flags = np.where(last, CHUNK_END | np.where(alone[live], ROOT, 0), 0) | (CHUNK_START if k == 0 else 0)
        cv[:, live] = _compress(cv[:, live], words[live, k].T, counter[live], length, flags.astype(np.uint32))
    return cv, per


def _parents(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> np.ndarray:
    n = left.shape[1]
    cv = np.repeat(np.array(IV, np.uint32)[:, None], n, axis=1)
    flags = np.where(root, PARENT | ROOT, PARENT).astype(np.uint32)
    return _compress(cv, np.concatenate([left, right]), np.zeros(n, np.uint64), np.full(n, BLOCK, np.uint32), flags)


def _hash_together(data: list[bytes]) -> list[bytes]:
    with np.errstate(over="ignore"):
        level, per = _chunk_values(data)
        # Neighbours are paired level by level; an odd last value moves up, as in the left-full tree.
        while per.max() > 1:
            start = np.cumsum(per) - per
            place = np.arange(level.shape[1]) - np.repeat(start, per)
            left = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(per, per)))
            level[:, left] = _parents(level[:, left], level[:, left + 1], np.repeat(per, per)[left] == 2)
            level = level[:, place % 2 == 0]
            per = (per + 1) // 2
    out = np.ascontiguousarray(level.T).astype("<u4")
    return [row.tobytes() for row in out]


def blake3_many(data: list[bytes], together: int = 4 << 20) -> list[bytes]:
    """The 32-byte BLAKE3 hash of each input; inputs are compressed side by side, so that many
    small ones cost little more than one."""
    out: list[bytes] = []
    group: list[bytes] = []
    size = 0
    for x in data:
        group.append(x)
        size += max(CHUNK, len(x))
        if size >= together:
            out += _hash_together(group)
            group, size = [], 0
    return out + (_hash_together(group) if group else [])


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash of ``data``."""
    return _hash_together([data])[0]


def tree_root(domain: bytes, size: int, chunk_size: int, digests: list[bytes], digest=blake3) -> bytes:
    """The root digest of a file from its ordered chunk digests."""
    return digest(domain + struct.pack("<QQQ", size, chunk_size, len(digests)) + b"".join(digests))
