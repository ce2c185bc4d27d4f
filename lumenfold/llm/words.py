"""Vectorised word tables over batches of texts, for the operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text worked on at once; one longer text makes a chunk of its own. Arrays over a chunk take many times its size.
CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 512

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of some texts. ``buf`` has them normalised: one space between words, a line feed after each text.

    start, end: byte offsets of each word in ``buf``; first: index of each text's first word, and the total at the end.
    """

    __slots__ = ("buf", "start", "end", "first")

    def __init__(self, texts: list[bytes | None], table: bytes | None = None):
        """table: a 256-byte translation to apply first. Words are what ASCII white space separates."""
        if table is not None:
            parts = [b" ".join(t.translate(table).split()) if t else b"" for t in texts]
        else:
            parts = [b" ".join(t.split()) if t else b"" for t in texts]
        parts.append(b"")
        self._index(b"\n".join(parts))

    @classmethod
    def packed(cls, buf: bytes) -> Words:
        """Of texts that are normalised already, each followed by a line feed."""
        w = cls.__new__(cls)
        w._index(buf)
        return w

    def _index(self, buf: bytes) -> None:
        self.buf = buf
        a = np.frombuffer(self.buf, np.uint8)
        stops = np.flatnonzero((a == 32) | (a == 10))
        starts = np.empty_like(stops)
        if len(stops):
            starts[0] = 0
            starts[1:] = stops[:-1] + 1
        full = stops > starts
        upto = np.cumsum(full)
        self.first = np.concatenate([[0], upto[a[stops] == 10]]).astype(np.int64)
        self.start, self.end = starts[full], stops[full]

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.start
        padded = np.frombuffer(self.buf + bytes(8), np.uint8)
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [_M64], np.uint64)
        h = mix(size.astype(np.uint64) + _U(_BASE))
        at = np.flatnonzero(size <= LONG_WORD)
        step = 0
        while len(at):
            left = size[at] - step
            v = eight[self.start[at] + step] & keep[np.minimum(left, 8)]
            h[at] = mix((h[at] ^ v) * _U(_BASE) + _U(step + 1))
            step += 8
            at = at[left > 8]
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.buf[self.start[i] : self.end[i]])
        return h


def _spans(x: np.ndarray, n: int, join) -> np.ndarray:
    """Fold each run of n neighbours, out of folds of runs of powers of two. join(a, b, size of b's run)."""
    out, have, run, size = None, 0, x, 1
    while True:
        if n & size:
            if out is None:
                out, have = run, size
            else:
                k = len(run) - have
                out, have = join(out[: max(k, 0)], run[have:], size), have + size
        if size * 2 > n:
            return out
        k = len(run) - size
        run = join(run[: max(k, 0)], run[size:], size)
        size *= 2


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n neighbouring hashes (texts' borders are the caller's)."""
    return mix(_spans(h, n, lambda a, b, size: a * _U(pow(_BASE, size, 1 << 64)) + b[: len(a)]))


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n neighbours."""
    return _spans(x, n, lambda a, b, _: np.minimum(a, b[: len(a)]))


def greatest(x: np.ndarray, n: int) -> np.ndarray:
    """Maximum of each run of n neighbours."""
    return _spans(x, n, lambda a, b, _: np.maximum(a, b[: len(a)]))


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that memory is bounded by that or the longest text."""
    limit = limit or CHUNK_BYTES
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(_binary(b.column(text))), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield b.slice(lo, hi - lo)


def _binary(col) -> pa.Array:
    return col.cast(pa.binary())


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A column's texts as UTF-8 bytes."""
    return _binary(batch.column(name)).to_pylist()
