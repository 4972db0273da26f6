"""BLAKE3 over many chunks at a time, as arrays of 32-bit words."""

from __future__ import annotations

import numpy as np

# Fixed values.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK, ROUNDS = 1024, 64, 7


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(value: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8, n) from those before, message words (16, n), chunk counters, block lengths and flags (n each)."""
    n = value.shape[1]
    s = np.empty((16, n), np.uint32)
    s[:8], s[8:12] = value, IV[:4, None]
    s[12], s[13], s[14], s[15] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), length, flags
    rows, turn = np.arange(4), [np.roll(np.arange(4), -k) for k in range(4)]
    for r in range(ROUNDS):
        # columns, then diagonals: four mixings at once
        for first, shift in ((0, 0), (8, 1)):
            a, b, c, d = (4 * k + (turn[k] if shift else rows) for k in range(4))
            x, y = words[first : first + 8 : 2], words[first + 1 : first + 8 : 2]
            sa, sb, sc, sd = s[a], s[b], s[c], s[d]
            sa = sa + sb + x
            sd = _rotated(sd ^ sa, 16)
            sc = sc + sd
            sb = _rotated(sb ^ sc, 12)
            sa = sa + sb + y
            sd = _rotated(sd ^ sa, 8)
            sc = sc + sd
            sb = _rotated(sb ^ sc, 7)
            s[a], s[b], s[c], s[d] = sa, sb, sc, sd
        if r < ROUNDS - 1:
            words = words[PERMUTATION]
    return s[:8] ^ s[8:]


def chunks(data: bytes | memoryview, first: int, root: bool = False) -> np.ndarray:
    """Chaining values (8, n) of the chunks of some consecutive bytes, the first of them of that number; the last may be short. root: they are all there is."""
    raw = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(raw) // CHUNK))
    held = np.zeros(n * CHUNK, np.uint8)
    held[: len(raw)] = raw
    words = np.ascontiguousarray(held.view("<u4").reshape(n, CHUNK // BLOCK, 16).transpose(1, 2, 0))
    left = np.full(n, CHUNK)
    left[-1] = len(raw) - (n - 1) * CHUNK
    blocks = np.maximum(1, -(-left // BLOCK))
    counter = np.arange(first, first + n, dtype=np.uint64)
    value = np.repeat(IV[:, None], n, axis=1)
    for b in range(blocks.max()):
        here = n if blocks[-1] > b else n - 1  # only the last chunk may be short
        length = np.clip(left[:here] - b * BLOCK, 0, BLOCK).astype(np.uint32)
        flags = np.full(here, CHUNK_START if b == 0 else 0, np.uint32) | np.where(blocks[:here] == b + 1, CHUNK_END | (ROOT if root and n == 1 else 0), 0).astype(np.uint32)
        value[:, :here] = compress(value[:, :here], words[b][:, :here], counter[:here], length, flags)
    return value


def parent(value: np.ndarray, root: bool) -> np.ndarray:
    """The chaining value (8, 1) of the tree over nodes (8, n) in order: neighbours are joined level by level, an odd last one goes up as it is."""
    while value.shape[1] > 1:
        n = value.shape[1] // 2
        words = np.concatenate([value[:, 0 : 2 * n : 2], value[:, 1 : 2 * n : 2]])
        flags = np.full(n, PARENT | (ROOT if root and value.shape[1] == 2 else 0), np.uint32)
        joined = compress(np.repeat(IV[:, None], n, axis=1), words, np.zeros(n, np.uint64), np.full(n, BLOCK, np.uint32), flags)
        value = np.concatenate([joined, value[:, 2 * n :]], axis=1)
    return value


def packed(value: np.ndarray) -> bytes:
    return value[:, 0].astype("<u4").tobytes()


def unpacked(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u4").reshape(-1, 8).T.astype(np.uint32)


def digest(data: bytes) -> str:
    """Lowercase hex of the hash of a short content."""
    value = chunks(data, 0, root=True)
    return packed(parent(value, True)).hex()


def digests(contents: list[bytes]) -> list[str]:
    """digest() of each; those of a chunk or less side by side."""
    out = [""] * len(contents)
    short = [i for i, c in enumerate(contents) if len(c) <= CHUNK]
    for i in set(range(len(contents))) - set(short):
        out[i] = digest(contents[i])
    for at in range(0, len(short), 4096):
        part = sorted(short[at : at + 4096], key=lambda i: -len(contents[i]))
        size = np.array([len(contents[i]) for i in part])
        blocks = np.maximum(1, -(-size // BLOCK))
        held = np.zeros((len(part), int(blocks[0]) * BLOCK), np.uint8)
        held[np.arange(held.shape[1]) < size[:, None]] = np.frombuffer(b"".join(contents[i] for i in part), np.uint8)
        words = np.ascontiguousarray(held.view("<u4").reshape(len(part), -1, 16).transpose(1, 2, 0))
        value = np.repeat(IV[:, None], len(part), axis=1)
        for b in range(int(blocks[0])):
            here = int((blocks > b).sum())  # the longest come first
            length = np.clip(size[:here] - b * BLOCK, 0, BLOCK).astype(np.uint32)
            flags = np.full(here, CHUNK_START if b == 0 else 0, np.uint32) | np.where(blocks[:here] == b + 1, CHUNK_END | ROOT, 0).astype(np.uint32)
            value[:, :here] = compress(value[:, :here], words[b][:, :here], np.zeros(here, np.uint64), length, flags)
        raw = np.ascontiguousarray(value.T.astype("<u4")).tobytes()
        for k, i in enumerate(part):
            out[i] = raw[32 * k : 32 * k + 32].hex()
    return out
