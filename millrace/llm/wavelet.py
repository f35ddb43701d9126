"""Token ids as one wavelet-matrix file image per shard.

File layout (little-endian): magic ``WVM2``; uint32 header length; header JSON (n, levels, n_symbols, n_docs, zeros per level,
place and length of each section); then the sections: symbols (uint32, ascending) and document ends (uint64, ids up to and with
each document), both squeezed as a whole; the directory, for each level and block of 2**15 bits the ones before the block and
where its bytes begin (uint32 and uint64, plain); and the blocks of all planes, each squeezed on its own.  Symbols are the ids that
occur in the shard; planes hold indices into them, the highest bit first.

Opening a file reads header, symbols, ends and directory; access, rank and select then read and inflate the blocks they touch,
one or two a level.  ``source`` is the image's bytes or a function (offset, size) that reads from a file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC, BLOCK = b"WVM2", 1 << 15


def encode(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """File image of these ids; ``ends`` gives the number of ids up to the end of each document."""
    used = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    used[ids] = True
    symbols = np.flatnonzero(used).astype(np.uint32)
    back = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
    x = back[ids] if len(symbols) > 65536 else back.astype(np.uint16)[ids]
    levels = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blocks, ones, zeros = [], [], []
    for level in range(levels - 1, -1, -1):
        bit = (x & x.dtype.type(1 << level)) != 0
        raw = np.packbits(bit).tobytes()
        blocks += [squeeze(raw[k : k + BLOCK // 8]) for k in range(0, len(raw), BLOCK // 8)]
        ones.append(np.concatenate(([0], np.cumsum(np.add.reduceat(bit, np.arange(0, len(bit), BLOCK), dtype=np.int64))))[:-1])
        low, high = np.compress(~bit, x), np.compress(bit, x)  # far faster than indexing by a mask
        zeros.append(len(low))
        x = np.concatenate((low, high))
    starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    counts = np.concatenate(ones).astype("<u4") if ones else np.empty(0, "<u4")
    sections = [squeeze(symbols.tobytes()), squeeze(np.asarray(ends, "<u8").tobytes()), counts.tobytes(), starts.tobytes()]
    head = json.dumps({"n": len(ids), "levels": levels, "n_symbols": len(symbols), "n_docs": len(ends), "zeros": zeros, "sections": [len(s) for s in sections]}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, *sections, *blocks))


class WaveletFile:
    """Access, rank, select and counting on a file image; each takes one position or an array of them."""

    def __init__(self, source: bytes | Callable[[int, int], bytes], kept_blocks: int = 4096):
        self.read = source if callable(source) else lambda at, size: source[at : at + size]
        if self.read(0, 4) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (size,) = struct.unpack("<I", self.read(4, 4))
        head = json.loads(self.read(8, size))
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        at, parts = 8 + size, []
        for length in head["sections"]:
            parts.append(self.read(at, length))
            at += length
        self.inflate = zstandard.ZstdDecompressor().decompress
        self.symbols = np.frombuffer(self.inflate(parts[0]), "<u4")
        self.ends = np.frombuffer(self.inflate(parts[1]), "<u8").astype(np.int64)
        self.per_level = -(-self.n // BLOCK)
        self.before = np.frombuffer(parts[2], "<u4").astype(np.int64).reshape(self.levels, self.per_level)
        self.starts, self.base = np.frombuffer(parts[3], "<u8").astype(np.int64), at
        self.kept, self.kept_blocks = {}, kept_blocks

    def _block(self, level: int, block: int) -> np.ndarray:
        """Bytes of one block of a plane; the last ones read are kept."""
        k = level * self.per_level + block
        if k not in self.kept:
            if len(self.kept) >= self.kept_blocks:
                self.kept.clear()
            self.kept[k] = np.frombuffer(self.inflate(self.read(self.base + int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))), np.uint8)
        return self.kept[k]

    def _bits(self, level: int, block: int) -> np.ndarray:
        return np.unpackbits(self._block(level, block), count=min(BLOCK, self.n - block * BLOCK))

    def _by_block(self, level: int, at: np.ndarray, body: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """``body(bits, places)`` of the positions of each block."""
        out, block = np.empty(len(at), np.int64), at // BLOCK
        for b in np.unique(block).tolist():
            own = block == b
            out[own] = body(self._bits(level, b), at[own] - b * BLOCK)
        return out

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        out, block = np.empty(len(at), np.int64), np.minimum(at // BLOCK, self.per_level - 1)
        for b in np.unique(block).tolist():
            own = block == b
            p, raw = at[own] - b * BLOCK, np.append(self._block(level, b), np.uint8(0))
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(raw), dtype=np.int64)))
            out[own] = self.before[level, b] + ones[p >> 3] + np.bitwise_count(raw[p >> 3].astype(np.int64) >> (8 - (p & 7)))
        return out

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest up."""
        x = np.zeros(self.n, np.uint16 if len(self.symbols) <= 65536 else np.uint32)
        for level in range(self.levels):
            k = self.levels - 1 - level
            z, raw = self.zeros[k], np.concatenate([self._block(k, b) for b in range(self.per_level)])
            bit = np.unpackbits(raw, count=self.n).view(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~bit)] = x[:z]
            y[np.flatnonzero(bit)] = x[z:] | x.dtype.type(1 << level)
            x = y
        return self.symbols[x] if self.n else np.empty(0, np.uint32)

    def access(self, i):
        """The id at each position."""
        at = np.atleast_1d(np.asarray(i, np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(i)
        code = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit = self._by_block(k, at, lambda bits, p: bits[p].astype(np.int64))
            ones = self._ones(k, at)
            code = code << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        out = self.symbols[code].astype(np.int64)
        return int(out[0]) if np.ndim(i) == 0 else out

    def _code(self, symbol: int) -> int | None:
        k = int(np.searchsorted(self.symbols, symbol))
        return k if k < len(self.symbols) and self.symbols[k] == symbol else None

    def _down(self, code: int, at: np.ndarray) -> np.ndarray:
        """Where positions of the ids lie below the last plane, on the way of ``code``."""
        for k in range(self.levels):
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if code >> (self.levels - 1 - k) & 1 else at - ones
        return at

    def rank(self, symbol: int, i):
        """Occurrences of the symbol before each position."""
        at = np.clip(np.atleast_1d(np.asarray(i, np.int64)), 0, self.n)
        code = self._code(symbol)
        out = np.zeros(len(at), np.int64)
        if code is not None:
            low = self._down(code, np.concatenate((at, [0])))
            out = low[:-1] - low[-1]
        return int(out[0]) if np.ndim(i) == 0 else out

    def count(self, symbol: int, lo=0, hi=None):
        """Occurrences of the symbol in each range."""
        return self.rank(symbol, self.n if hi is None else hi) - self.rank(symbol, lo)

    def _select_bit(self, level: int, bit: int, j: np.ndarray) -> np.ndarray:
        """Position of each j-th (from 0) such bit."""
        before = self.before[level] if bit else np.arange(self.per_level) * BLOCK - self.before[level]
        block = np.searchsorted(before, j, side="right") - 1
        out = np.empty(len(j), np.int64)
        for b in np.unique(block).tolist():
            own = block == b
            out[own] = b * BLOCK + np.flatnonzero(self._bits(level, b) == bit)[j[own] - before[b]]
        return out

    def select(self, symbol: int, j):
        """Position of each j-th (from 0) occurrence of the symbol."""
        want, code = np.atleast_1d(np.asarray(j, np.int64)), self._code(symbol)
        lo, hi = self._down(code, np.array([0, self.n])).tolist() if code is not None else (0, 0)
        if len(want) and not (0 <= want.min() and want.max() < hi - lo):
            raise IndexError(j)
        if not len(want):
            return want
        at = lo + want
        for k in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - k) & 1
            at = self._select_bit(k, bit, at - self.zeros[k] if bit else at)
        return int(at[0]) if np.ndim(j) == 0 else at
