"""Array helpers shared by the text operators; they run inside tasks, on a chunk of documents at a time.

Texts travel as UTF-8 bytes. A chunk is one byte array in which every text is followed by one space, so
no word crosses a document. Hashes are 64 bits wide; the operators verify or widen them where it matters.
Spans below ``LONG_SPAN`` values are hashed as polynomials modulo 2**64, from running sums. Repetitive strings of two symbols
can cancel in such a polynomial once they are long, so longer spans are hashed by XXH64 from their values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
CHUNK_BYTES = 1 << 20
LONG_SPAN = 32

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F
_Q_INV = pow(_Q, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept between calls up to a few chunks' length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class SpanHash:
    """Hashes of any spans ``[s, e)`` of a sequence of 64-bit values: short ones from running sums, long ones one by one."""

    def __init__(self, values: np.ndarray, base: int = _P, inverse: int = _P_INV):
        n = len(values)
        self.inverse, self.values = inverse, np.ascontiguousarray(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def __call__(self, s: np.ndarray, e: np.ndarray, telling: bool = True) -> np.ndarray:
        """``telling``: equal hashes are to mean equal spans; where they only deal spans out, running sums do for long ones too."""
        h = self.sums[e] - self.sums[s]
        h *= powers(self.inverse, len(self.sums))[s]
        h = mix(h + (e - s).astype(np.uint64) * U(_Q))
        long = np.flatnonzero(e - s >= LONG_SPAN) if telling else ()
        if len(long):
            raw = memoryview(self.values).cast("B")
            h[long] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip((8 * s[long]).tolist(), (8 * e[long]).tolist(), strict=True)), dtype=np.uint64, count=len(long))
        return h


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def word_table(lower_ascii_only: bool) -> np.ndarray:
    """Which bytes belong to words: all but ASCII white space, or letters a-z, digits and all non-ASCII."""
    t = np.ones(256, dtype=bool)
    if lower_ascii_only:
        t[:128] = False
        for a, b in ((48, 58), (97, 123)):
            t[a:b] = True
    else:
        t[[32, *range(9, 14)]] = False
    return t


BLANK_WORDS = word_table(False)
ALNUM_WORDS = word_table(True)


class Chunk:
    """Some documents: ``rows`` are their places in the record batch, ``texts`` their bytes."""

    def __init__(self, rows: list[int], texts: list[bytes]):
        self.rows, self.texts = rows, texts
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.lengths + 1) - 1
        self.starts = self.ends - self.lengths

    def buffer(self) -> np.ndarray:
        return np.frombuffer(b" ".join(self.texts) + b" ", dtype=np.uint8)


class Words:
    """Word spans of a chunk and, per document, the range ``[first[i], first[i + 1])`` of its words."""

    def __init__(self, chunk: Chunk, table: np.ndarray, lower: bool = False):
        raw = chunk.buffer()
        if lower:
            raw = np.frombuffer(raw.tobytes().lower(), dtype=np.uint8)
        self.raw = raw
        inside = np.zeros(len(raw) + 1, dtype=np.int8)
        inside[1:] = table[raw]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, np.append(chunk.starts, len(raw)))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """Of the words as they stand; a long text goes piece by piece, which gives the same."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + 4 * CHUNK_BYTES, side="right")))
            lo = self.starts[a]
            out[a:b] = SpanHash(byte_values(self.raw[lo : self.ends[b - 1]]))(self.starts[a:b] - lo, self.ends[a:b] - lo)
            a = b
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_span_hash(words: np.ndarray) -> SpanHash:
    return SpanHash(words, _Q, _Q_INV)


def binary(column: pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Documents in order, up to ``limit`` bytes together; a longer document makes a chunk of its own."""
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if rows and size + len(t) > limit:
            yield Chunk(rows, [texts[j] for j in rows])
            rows, size = [], 0
        rows.append(i)
        size += len(t) + 1
    if rows:
        yield Chunk(rows, [texts[j] for j in rows])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``values[i : i + width]`` for each i that has so many."""
    m, have = values, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the concatenated ranges ``[start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the spans."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def columns(rows: list[tuple], n: int) -> list[tuple]:
    """Rows as ``n`` columns, none of them missing when there are no rows."""
    return list(zip(*rows, strict=True)) if rows else [()] * n
